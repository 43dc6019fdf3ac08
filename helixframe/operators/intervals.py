"""Half-open intervals on contigs: union, overlap, and painting of positions.

There are only 23 contigs, so no rows of data are dealt by the contig alone: positions and intervals meet in bins
of fixed width, and what earlier bins reach is carried over as one row for each bin.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BIN = 1 << 16


def _carried(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """df (with _bin) and the greatest value in the bins before: a contig's bins are few, whatever its rows are. Null keys are equal."""
    tops = df.groupBy(*keys, "_bin").agg(F.max(value).alias("_top"))
    earlier = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    at = [*keys, "_bin"]
    before = tops.select(*(F.col(k).alias(f"_of_{k}") for k in at), F.max("_top").over(earlier).alias(name))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in at))
    return df.join(before, same).drop(*(f"_of_{k}" for k in at))


def _reached(df: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """df with _bin, that of the start, and _reach: the greatest end of the rows before (by start, then end, then row0 if there)."""
    own = _carried(df.withColumn("_bin", F.floor(F.col("start0") / width)), keys, "end0", "_before")
    w = Window.partitionBy(*keys, "_bin").orderBy("start0", "end0", *(["row0"] if "row0" in df.columns else []))
    return own.withColumn("_reach", F.greatest("_before", F.max("end0").over(w.rowsBetween(Window.unboundedPreceding, -1)))).drop("_before")


def union_intervals(df: DataFrame, keys: Sequence[str] = ("chr",), width: int = BIN) -> DataFrame:
    """(keys, start0, end0): intervals that overlap or touch become one."""
    own = _reached(df.select(*keys, "start0", "end0"), keys, width)
    opens = F.when(F.col("_reach").isNull() | (F.col("start0") > F.col("_reach")), F.col("start0"))
    marked = _carried(own.withColumn("_opens", opens), keys, "_opens", "_before")
    w = Window.partitionBy(*keys, "_bin").orderBy("start0").rangeBetween(Window.unboundedPreceding, Window.currentRow)  # of equal starts only one opens
    first = F.greatest("_before", F.max("_opens").over(w))  # starts grow: the greatest is the last
    return marked.withColumn("_first", first).groupBy(*keys, "_first").agg(F.max("end0").alias("end0")).select(*keys, F.col("_first").alias("start0"), "end0")


def overlapping(df: DataFrame, keys: Sequence[str] = ("chr",), width: int = BIN) -> DataFrame:
    """Rows that start before an earlier one (by start, then end) ends; touching is no overlap."""
    return _reached(df, keys, width).filter("start0 < _reach").select(*df.columns)


def _in_bins(intervals: DataFrame, width: int) -> DataFrame:
    ends = F.floor((F.col("end0") - 1) / width)
    return intervals.filter("end0 > start0").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start0") / width), ends)))


def containing(variants: DataFrame, intervals: DataFrame, columns: Sequence[str] = (), how: str = "inner", width: int = BIN) -> DataFrame:
    """variants joined with the intervals that contain bp - 1. how: inner or left_semi."""
    own = variants.withColumn("_bin", F.floor((F.col("bp") - 1) / width))
    other = _in_bins(intervals.select(F.col("chr").alias("_chr"), "start0", "end0", *columns), width).withColumnRenamed("_bin", "_ibin")
    inside = (F.col("chr") == F.col("_chr")) & (F.col("_bin") == F.col("_ibin")) & (F.col("bp") - 1 >= F.col("start0")) & (F.col("bp") - 1 < F.col("end0"))
    return own.join(other, inside, how).drop("_bin", "_ibin", "_chr", *(() if how == "left_semi" else ("start0", "end0")))


def paint(variants: DataFrame, intervals: DataFrame, width: int = BIN) -> DataFrame:
    """The variants that some interval contains."""
    return containing(variants, intervals, how="left_semi", width=width)


def paint_groups(variants: DataFrame, intervals: DataFrame, group: str, width: int = BIN) -> DataFrame:
    """A row for each variant and group with an interval that contains it."""
    disjoint = union_intervals(intervals, ("chr", group))
    return containing(variants, disjoint, [group], width=width)


def paint_values(variants: DataFrame, intervals: DataFrame, values: Sequence[str], width: int = BIN) -> DataFrame:
    """Long rows (…, name, value) of the interval that contains a variant; zeros are left out. Intervals must not overlap."""
    found = containing(variants, intervals, values, width=width)
    long = found.unpivot([c for c in found.columns if c not in values], list(values), "name", "value")
    return long.filter("value <> 0")
