"""Linkage disequilibrium: construction, validation, weighted sums and pruning.

Correlations are long rows (chr, i, j, r) with both triangles and a unit diagonal; i and j count within the contig.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.operators.blocks import build_blocks, pairs_of
from helixframe.operators.prune import prune_blocks
from helixframe.tables import stored

#: Defaults of a build: window in thousands of base pairs, least squared correlation that is kept.
WINDOW_KB = 10_000
LEAST_R2 = 0.05
TOLERANCE = 1e-6
ROWS = 64  # of calls that are looked at at once


def allele_frequency(calls: DataFrame) -> DataFrame:
    """calls: variant columns and `calls` (array of 0, 1, 2, -1). Adds n_obs and a1freq (null without calls)."""
    seen = F.filter("calls", lambda c: c >= 0)
    total = F.aggregate(seen, F.lit(0).cast("long"), lambda a, c: a + c)
    return calls.withColumn("n_obs", F.size(seen).cast("long")).withColumn("a1freq", F.when(F.col("n_obs") > 0, total / (2 * F.col("n_obs"))))


def by_samples(calls: DataFrame, work: Callable[[np.ndarray], dict[str, np.ndarray]], fields: str) -> DataFrame:
    """calls with more columns, or others of a name that is there, from the matrix of calls (a row for each variant) of some rows at a time."""
    added = T._parse_datatype_string(fields).fields
    names = {f.name for f in added}
    schema = T.StructType([*(f for f in calls.schema.fields if f.name not in names), *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), ROWS):
                batch = whole.slice(lo, ROWS)
                found = work(np.stack(batch.column("calls").to_numpy(zero_copy_only=False)))
                columns = {f.name: batch.column(f.name) for f in schema.fields if f.name not in found}
                columns |= {k: pa.array(list(v) if v.ndim > 1 else v, from_pandas=True) for k, v in found.items()}
                yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema.fields], schema.names)

    return calls.mapInArrow(run, schema)


def select_samples(calls: DataFrame, places: list[int]) -> DataFrame:
    """calls of the samples at these places."""
    at = np.array(places, np.int64)
    return by_samples(calls, lambda c: {"calls": c[:, at].astype(np.int8)}, "calls array<tinyint>")


def haploid_frequency(calls: DataFrame, sexes: list[int]) -> DataFrame:
    """As allele_frequency where samples of sex 1 have one copy: a call of 2 counts as one of one, 1 is not valid."""
    male = np.array(sexes) == 1

    def work(c: np.ndarray) -> dict[str, np.ndarray]:
        seen = (c >= 0) & ~(male & (c == 1))
        copies, room = np.where(seen, np.where(male, c / 2, c), 0).sum(axis=1), np.where(seen, np.where(male, 1, 2), 0).sum(axis=1)
        return {"n_obs": seen.sum(axis=1).astype(np.int64), "a1freq": np.where(room > 0, copies / np.maximum(room, 1), np.nan)}

    return by_samples(calls, work, "n_obs long, a1freq double")


def is_monomorphic(a1freq: Column) -> Column:
    return a1freq.isin(0.0, 1.0)


def build_pairs(calls: DataFrame, window_kb: float = WINDOW_KB, least_r2: float = LEAST_R2) -> DataFrame:
    """(chr, i, j, r), i before j: variants at most window_kb apart with r * r of at least least_r2; calls as `blocks.build_blocks` wants them."""
    return pairs_of(build_blocks(calls, window_kb, least_r2))


def symmetric(pairs: DataFrame, axis: DataFrame) -> DataFrame:
    """Both triangles and the unit diagonal as float, from one triangle and the axis (chr, local_idx)."""
    r = F.col("r").cast("float")
    one = pairs.select("chr", "i", "j", r.alias("r"))
    two = pairs.select("chr", F.col("j").alias("i"), F.col("i").alias("j"), r.alias("r"))
    return one.unionByName(two).unionByName(axis.select("chr", F.col("local_idx").alias("i"), F.col("local_idx").alias("j"), F.lit(1.0).cast("float").alias("r")))


def check_pairs(pairs: DataFrame, axis: DataFrame) -> None:
    """Raises for pairs out of bounds, on the diagonal, not finite, beyond 1 or given twice."""
    sizes = axis.groupBy("chr").agg(F.max("local_idx").alias("last"))
    own = pairs.join(F.broadcast(sizes), "chr", "left")  # at most 23 rows
    bad = F.count_if
    found = own.agg(
        bad(F.col("last").isNull() | (F.least("i", "j") < 0) | (F.greatest("i", "j") > F.col("last"))).alias("out of bounds"),
        bad(F.col("i") == F.col("j")).alias("on the diagonal"),
        bad(F.col("r").isNull() | F.isnan("r") | (F.abs("r") == float("inf"))).alias("not finite"),
        bad(F.abs("r") > 1).alias("beyond 1"),
    ).first()
    for name, n in found.asDict().items():
        if n:
            raise ValueError(f"{n} correlations are {name}")
    if own.groupBy("chr", F.least("i", "j"), F.greatest("i", "j")).count().filter("count > 1").limit(1).collect():
        raise ValueError("a pair is given more than once")


def validation(ld: DataFrame) -> DataFrame:
    """(chr, nnz, asymmetric, bad_diagonal, beyond): counts that all but nnz should be 0."""
    other = ld.select("chr", F.col("j").alias("i"), F.col("i").alias("j"), F.col("r").alias("r_other"))
    both = ld.join(other, ["chr", "i", "j"], "left")
    off = F.col("r_other").isNull() | (F.abs(F.col("r").cast("double") - F.col("r_other")) > TOLERANCE)
    return both.groupBy("chr").agg(
        F.count(F.lit(1)).alias("nnz"), F.count_if(off).alias("asymmetric"),
        F.count_if((F.col("i") == F.col("j")) & (F.abs(F.col("r") - 1) > TOLERANCE)).alias("bad_diagonal"),
        F.count_if(F.isnan("r") | (F.abs("r") > 1 + TOLERANCE)).alias("beyond"),
    )


def fast_prune(scores: DataFrame, blocks: DataFrame, threshold: float = 0.2) -> DataFrame:
    """scores (chr, local_idx, score) with null for what is pruned.

    By decreasing absolute score, then index, a finite score that is still there removes its neighbours with r * r of at
    least threshold (compared as float). Infinite scores remove nothing but can be removed. See `prune.prune_blocks`.
    """
    if not math.isfinite(threshold) or threshold < 0:
        raise ValueError("threshold must be finite and not negative")
    own = scores.select("chr", "local_idx", F.array(F.col("score").cast("double")).alias("scores"))
    gone = prune_blocks(own, blocks, threshold).filter(F.col("gone")[0]).select("chr", "local_idx", F.lit(True).alias("gone"))
    return scores.join(gone, ["chr", "local_idx"], "left").select("chr", "local_idx", F.when(F.col("gone").isNull(), F.col("score")).alias("score"))


def prune_frequency(axis: DataFrame, blocks: DataFrame, score: Callable[[Column], Column], n_iter: int, threshold: float = 0.2) -> DataFrame:
    """(chr, local_idx, frequency): in which part of n_iter prunings a variant stays.

    score: a variant's score, by axis columns and the number of the pruning (from 1). All prunings go over one copy of the links, with a bit for each.
    """
    if n_iter < 1:
        raise ValueError("there must be one pruning at least")
    scores = stored(axis.select("chr", "local_idx", F.transform(F.sequence(F.lit(1), F.lit(n_iter)), lambda k: score(k).cast("double")).alias("scores")), "prune-scores")
    gone = prune_blocks(scores, blocks, threshold)
    stays = F.size(F.filter(F.arrays_zip("scores", "gone"), lambda x: x["scores"].isNotNull() & ~x["gone"]))
    return scores.join(gone, ["chr", "local_idx"]).select("chr", "local_idx", (stays / n_iter).alias("frequency"))
