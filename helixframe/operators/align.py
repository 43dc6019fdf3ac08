"""Matching of a source to the variants of a reference: exactly on contig, position and both alleles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.variants import match_allele
from helixframe.tables import check_unique

KEY = ("chr", "bp", "a1", "a2")
_MATCH = ("chr", "bp", "m1", "m2")


def with_match_key(df: DataFrame, swapped: bool = False) -> DataFrame:
    one, two = ("a2", "a1") if swapped else ("a1", "a2")
    return df.withColumns({"m1": match_allele(F.col(one)), "m2": match_allele(F.col(two))})


def check_keys(df: DataFrame, where: str) -> None:
    """Raises where two rows of one shard would match the same variant."""
    check_unique(with_match_key(df), _MATCH, f"{where}: ambiguous matching key")


def align(variants: DataFrame, source: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All variants, with the source's columns where a row of it matches and null elsewhere.

    A source row matches by contig, position and both alleles as given; alleles are never exchanged.
    """
    own = with_match_key(source).select(*_MATCH, *columns)
    return with_match_key(variants).join(own, list(_MATCH), "left").drop("m1", "m2")


def swapped_counts(variants: DataFrame, source: DataFrame) -> DataFrame:
    """(chr, n): source rows that match no variant but would with their alleles exchanged. They stay unmatched."""
    known = with_match_key(variants).select(*_MATCH)
    left = with_match_key(source).join(known, list(_MATCH), "left_anti").drop("m1", "m2")
    return with_match_key(left, swapped=True).join(known, list(_MATCH), "left_semi").groupBy("chr").agg(F.count(F.lit(1)).alias("n"))


def source_rows(variants: DataFrame, keys: DataFrame) -> DataFrame:
    """keys (chr, bp, a1, a2, …) with the variant they name; raises where there is none."""
    found = keys.join(variants.select(*KEY, "local_idx"), list(KEY), "left")
    if missing := found.filter("local_idx IS NULL").limit(1).collect():
        raise ValueError("no such variant: " + ":".join(str(missing[0][k]) for k in KEY))
    return found
