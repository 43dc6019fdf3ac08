"""Scalar functions on variants, as column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the allele hash: modulus, a base for each half, and the number of leading characters hashed.
HASH_MODULUS = (1 << 31) - 1
HASH_BASES = (257, 263)
HASH_CHARS = 150
#: Tokens that stand for a missing number.
MISSING = ("", "NaN", "nan", "NA", "N/A", "na", "NULL", "null")


def _lane(allele: Column, base: int) -> Column:
    codes = F.transform(F.split(allele, ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(1).cast("long"), lambda h, x: (h * base + x + 1) % HASH_MODULUS)


def allele_hash64(allele: Column) -> Column:
    """Two polynomial hashes of an ASCII allele in one long, below 2**63."""
    head = F.substring(allele, 1, HASH_CHARS)
    high, low = (_lane(head, base) for base in HASH_BASES)
    return F.when(allele.isNotNull() & (allele != ""), F.shiftleft(high, 32) + low).when(allele == "", F.lit((1 << 32) + 1))


def match_allele(allele: Column) -> Column:
    """What of an allele counts for matching: as many characters as are hashed."""
    return F.substring(allele, 1, HASH_CHARS)


def is_dna(allele: Column) -> Column:
    return F.coalesce(F.rlike(allele, F.lit("^[ACGT]+$")), F.lit(False))


def is_single_nucleotide(a1: Column, a2: Column) -> Column:
    return a1.isin("A", "C", "G", "T") & a2.isin("A", "C", "G", "T")


def is_strand_ambiguous(a1: Column, a2: Column) -> Column:
    return F.concat(a1, a2).isin("AT", "TA", "CG", "GC")


def neg_log10(p: Column) -> Column:
    """-log10(p) for 0 < p <= 1, infinity for 0, null for other values."""
    return F.when(p == 0, F.lit(float("inf"))).when((p > 0) & (p <= 1), -F.log10(p) + F.lit(0.0))


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(F.abs(x) < float("inf"), x)


def number(token: Column) -> Column:
    """A double; null for tokens that stand for a missing number and for what is no number."""
    return F.when(~token.isin(*MISSING), token.try_cast("double"))


def is_no_number(token: Column) -> Column:
    """True for tokens that neither are a number nor stand for a missing one."""
    return token.isNotNull() & ~token.isin(*MISSING) & token.try_cast("double").isNull()


def ploidy_scaled(call: Column, sex: Column, ploidy_male: Column, ploidy_female: Column) -> Column:
    """A call as a double, times the ploidy of the sample's sex over 2; null where missing."""
    ploidy = F.when(sex == 2, ploidy_female).otherwise(ploidy_male)
    return F.when(call >= 0, call.cast("double") * ploidy / 2)
