"""Summary statistics of one trait, aligned to a reference."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.contigs import check_request
from helixframe.functions.variants import neg_log10
from helixframe.operators.align import align, check_keys, swapped_counts
from helixframe.reference import ReferencePanel, check_stored, save_shards
from helixframe.sources.sumstats import OPTIONAL, read_sumstats


@dataclass(frozen=True)
class Sumstats:
    """values: chr, local_idx, logp and the fields that the source has (others are no columns); null where missing."""

    values: DataFrame
    labels: tuple[str, ...]
    fields: tuple[str, ...]
    reference: ReferencePanel | None = None

    def is_present(self) -> DataFrame:
        return self.values.select("chr", "local_idx", F.col("logp").isNotNull().alias("is_present"))

    def select_shards(self, labels: Sequence[str]) -> Sumstats:
        wanted = check_request(labels, self.labels, "Sumstats.select_shards")
        return Sumstats(self.values.filter(F.col("chr").isin(wanted)), tuple(wanted), self.fields, self.reference.select_shards(wanted) if self.reference else None)

    def summary(self) -> str:
        return f"<Sumstats: {self.values.count()} variants across {len(self.labels)} shard(s): {', '.join(self.labels)}>"

    def save(self, path: str) -> None:
        """Parquet by shard, and what shards of the reference these are."""
        self.values.write.partitionBy("chr").parquet(f"{path}/values")
        save_shards(self.reference, path)


def aligned_sumstats(reference: ReferencePanel, source: DataFrame) -> DataFrame:
    """source: chr, bp, a1, a2, p and optional fields. Every variant, with logp and the fields of its row."""
    extra = [c for c in OPTIONAL if c in source.columns]
    found = align(reference.variants, source, ["p", *extra])
    return found.select("chr", "local_idx", neg_log10(F.col("p")).alias("logp"), *extra)


def completeness(values: DataFrame) -> DataFrame:
    """One row: present variants, and how many of them lack z and n (all, if the source has no such column)."""
    there = F.col("logp").isNotNull()
    lacks = lambda c: (F.count_if(there & F.col(c).isNull()) if c in values.columns else F.count_if(there)).alias(f"no_{c}")
    return values.agg(F.count_if(there).alias("present"), lacks("z"), lacks("n"))


def load_sumstats(spark: SparkSession, path: str, reference: ReferencePanel, source: DataFrame | None = None) -> Sumstats:
    """Aligns a file's rows; warns of shards without rows, of rows that would match with alleles exchanged, and of gaps in z or n."""
    rows = read_sumstats(spark, path) if source is None else source
    rows = rows.filter(F.col("chr").isin(*reference.labels))
    check_keys(reference.variants, "reference")
    check_keys(rows, path)
    there = {r["chr"] for r in rows.select("chr").distinct().collect()}
    for label in reference.labels:
        if label not in there:
            warnings.warn(f"{path}: no rows for shard {label!r}", RuntimeWarning, stacklevel=2)
    for r in swapped_counts(reference.variants, rows).collect():
        warnings.warn(f"{path}: shard {r['chr']}: {r['n']} unmatched variant(s) would match with alleles exchanged; they stay unmatched", RuntimeWarning, stacklevel=2)
    values = aligned_sumstats(reference, rows)
    gaps = completeness(values).first()
    for name in ("z", "n"):
        if gaps[f"no_{name}"]:
            warnings.warn(f"{path}: {name} is missing for {gaps[f'no_{name}']} of {gaps['present']} present variants", RuntimeWarning, stacklevel=2)
    return Sumstats(values, reference.labels, tuple(c for c in OPTIONAL if c in values.columns), reference)


def create_sumstats(reference: ReferencePanel, rows: DataFrame) -> Sumstats:
    """rows: snp_idx, p and optional fields, exactly one row for each variant of the axis."""
    extra = [c for c in OPTIONAL if c in rows.columns]
    joined = reference.indexed().select("chr", "local_idx", "snp_idx").join(rows.withColumn("there", F.lit(True)), "snp_idx", "full")
    bad_p = F.col("p").isNull() | F.isnan("p") | (F.col("p") < 0) | (F.col("p") > 1)
    found = joined.agg(
        F.count_if(F.col("there").isNull()).alias("variants without a row"), F.count_if(F.col("chr").isNull()).alias("rows off the axis"),
        (F.count(F.lit(1)) - F.count_distinct("snp_idx")).alias("repeated rows"), F.count_if(F.col("there") & bad_p).alias("p out of [0, 1]"),
        *(F.count_if(F.abs(c) == float("inf")).alias(f"infinite {c}") for c in extra),
    ).first()
    for what, n in found.asDict().items():
        if n:
            raise ValueError(f"create_sumstats: {n} {what}")
    values = joined.select("chr", "local_idx", neg_log10(F.col("p")).alias("logp"), *(F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in extra))
    return Sumstats(values, reference.labels, tuple(extra), reference)


def load_sumstats_cache(spark: SparkSession, path: str, reference: ReferencePanel, shards: Sequence[str] | None = None) -> Sumstats:
    """reference: the panel of all shards that were saved; its shards must be those that the cache says."""
    labels = check_stored(spark, path, reference)
    values = spark.read.parquet(f"{path}/values").withColumn("chr", F.col("chr").cast("string"))
    found = Sumstats(values, labels, tuple(c for c in OPTIONAL if c in values.columns), reference)
    return found if shards is None else found.select_shards(shards)
