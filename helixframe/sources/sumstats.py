"""Summary statistics from tab-separated text, plain or gzipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.contigs import CONTIGS, IGNORED, is_styled
from helixframe.functions.variants import finite, is_dna, is_no_number, number
from helixframe.sources.text import first_line, numbered_lines
from helixframe.tables import check_rows

#: Names of columns, and other names for them.
REQUIRED = ("chr", "bp", "a1", "a2", "p")
OPTIONAL = ("z", "n", "beta", "se", "eaf", "info")
ALIASES = {"pos": "bp", "effectallele": "a1", "otherallele": "a2"}


def column_places(header: list[str], where: str) -> dict[str, int]:
    """Where each known column stands. Names count in any case, and a column must not be there under two names."""
    known = {**{n: n for n in (*REQUIRED, *OPTIONAL)}, **ALIASES}
    found = [(known.get(name, name), at) for at, name in enumerate(map(str.lower, header))]
    places = dict(found)
    if len(places) < len(found):
        raise ValueError(f"{where}: duplicate columns: {', '.join(n for n in places if sum(m == n for m, _ in found) > 1)}")
    if not set(REQUIRED) <= places.keys():
        raise ValueError(f"{where}: missing columns: {', '.join(n for n in REQUIRED if n not in places)}")
    return {n: at for n, at in places.items() if n in known}


def read_sumstats(spark: SparkSession, path: str) -> DataFrame:
    """chr, bp, a1, a2, p and those of the optional columns that the file has; rows of ignored contigs are dropped first.

    Every row has as many fields as the header. Blank lines are skipped.
    """
    head = first_line(spark, path)
    if head is None:
        raise ValueError(f"{path}: no header")
    header = head.split("\t")
    places = column_places(header, path)
    parts = F.split("value", "\t")
    lines = numbered_lines(spark, path).filter("row0 > 0 AND value <> ''")
    rows = lines.select("row0", F.size(parts).alias("n_fields"), *(F.get(parts, F.lit(at)).alias(n) for n, at in places.items()))
    check_rows(rows, [(f"expected {len(header)} columns", F.col("n_fields") != len(header))], path)
    return typed_sumstats(rows.drop("n_fields").filter(~F.coalesce(F.col("chr").isin(*IGNORED), F.lit(False))), path)


def typed_sumstats(rows: DataFrame, where: str) -> DataFrame:
    """Checks rows of strings and gives numbers their types; non-finite optional values become null."""
    c = F.col
    numeric = [n for n in rows.columns if n in OPTIONAL or n in ("bp", "p")]
    p, bp = number(c("p")), number(c("bp"))
    rules = [
        ("alleles must not be empty", F.coalesce(c("a1"), F.lit("")).isin("") | F.coalesce(c("a2"), F.lit("")).isin("")),
        ("labels such as chr1 are not allowed", is_styled(c("chr"))),
        ("unknown contig", ~F.coalesce(c("chr").isin(*CONTIGS), F.lit(False))),
        ("alleles must be of A, C, G and T", ~is_dna(c("a1")) | ~is_dna(c("a2"))),
        ("a1 and a2 must differ", c("a1") == c("a2")),
        *((f"{n} must be a number", is_no_number(c(n))) for n in numeric),
        ("bp must be an integer", bp.isNull() | (F.floor(bp) != bp)),
        ("p must be finite and in [0, 1]", p.isNull() | F.isnan(p) | (p < 0) | (p > 1)),
    ]
    check_rows(rows, rules, where)
    return rows.select("chr", bp.cast("long").alias("bp"), "a1", "a2", p.alias("p"), *(finite(number(c(n))).alias(n) for n in rows.columns if n in OPTIONAL))
