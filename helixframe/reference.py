"""Reference panels: the ordered variant axis that every other object is aligned to."""

from __future__ import annotations

import hashlib
import json
import logging
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.contigs import CONTIGS, check_request, chr_rank
from helixframe.functions.variants import allele_hash64, is_single_nucleotide, is_strand_ambiguous
from helixframe.operators.align import source_rows

_LOG = logging.getLogger("helixframe")


def shard_checksums(variants: DataFrame) -> DataFrame:
    """(chr, checksum): MD5 of the lines chr:bp:a1:a2 in order, streamed so that a shard is never held whole."""
    lines = variants.select("chr", "local_idx", F.concat_ws(":", "chr", "bp", "a1", "a2").alias("line"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, object] = {}
        for batch in batches:
            chrs, texts = batch.column("chr").to_pylist(), batch.column("line").to_pylist()
            start = 0
            for i in range(1, len(chrs) + 1):
                if i == len(chrs) or chrs[i] != chrs[start]:
                    found.setdefault(chrs[start], hashlib.md5()).update(("\n".join(texts[start:i]) + "\n").encode())
                    start = i
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([m.hexdigest() for m in found.values()], pa.string())], ["chr", "checksum"])

    ordered = lines.repartition("chr").sortWithinPartitions("chr", "local_idx")
    return ordered.mapInArrow(digest, "chr string, checksum string")


def shard_offsets(variants: DataFrame) -> DataFrame:
    """(chr, chr_rank, num_snp, start0, stop0), of at most 23 rows."""
    return _placed(variants.groupBy("chr").agg(F.count(F.lit(1)).alias("num_snp")))


def _placed(sizes: DataFrame) -> DataFrame:
    before = Window.orderBy("chr_rank").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sizes.withColumn("chr_rank", chr_rank(F.col("chr"))).withColumn("stop0", F.sum("num_snp").over(before))
    return ranked.select("chr", "chr_rank", "num_snp", (F.col("stop0") - F.col("num_snp")).alias("start0"), "stop0", *(c for c in sizes.columns if c == "checksum"))


@dataclass(frozen=True)
class ReferencePanel:
    """variants: chr, local_idx (from 0 within the shard, in file order), snp, bp, a1, a2.

    known: (label, num_snp, checksum) of each shard, as a cache says it; else they are computed once, when they are first wanted.
    """

    variants: DataFrame
    labels: tuple[str, ...]
    known: tuple[tuple[str, int, str], ...] | None = None

    @cached_property
    def described_shards(self) -> tuple[tuple[str, int, str], ...]:
        """(label, num_snp, checksum) in order, of at most 23 shards."""
        if self.known is not None:
            return self.known
        rows = shard_offsets(self.variants).join(shard_checksums(self.variants), "chr").collect()
        return tuple((r["chr"], r["num_snp"], r["checksum"]) for r in sorted(rows, key=lambda r: r["chr_rank"]))

    def _sizes(self) -> DataFrame:
        return self.variants.sparkSession.createDataFrame(list(self.described_shards), "chr string, num_snp long, checksum string")

    def offsets(self) -> DataFrame:
        return _placed(self._sizes()).drop("checksum") if self.known is not None or "described_shards" in self.__dict__ else shard_offsets(self.variants)

    def shards(self) -> DataFrame:
        """(chr, chr_rank, num_snp, start0, stop0, checksum); checksums are those that are stored, where the panel comes from a cache."""
        return _placed(self._sizes())

    def summary(self) -> str:
        return f"<ReferencePanel: {sum(n for _, n, _ in self.described_shards)} variants across {len(self.labels)} shard(s): {', '.join(self.labels)}>"

    def indexed(self) -> DataFrame:
        """variants with snp_idx on the axis of this panel: it starts at 0 for any selection of shards."""
        return self.variants.join(F.broadcast(self.offsets().select("chr", "start0")), "chr").withColumn("snp_idx", F.col("start0") + F.col("local_idx")).drop("start0")

    def locate(self, keys: DataFrame) -> DataFrame:
        """keys (chr, bp, a1, a2, and other columns) with the local_idx of the variant that each names exactly; raises where there is none."""
        return source_rows(self.variants, keys)

    def described(self) -> DataFrame:
        """indexed, with allele hashes and masks."""
        a1, a2 = F.col("a1"), F.col("a2")
        return self.indexed().withColumns(
            {"a1_hash64": allele_hash64(a1), "a2_hash64": allele_hash64(a2), "is_snv": is_single_nucleotide(a1, a2), "is_strand_ambiguous": is_strand_ambiguous(a1, a2)}
        )

    def select_shards(self, labels: Sequence[str]) -> ReferencePanel:
        wanted = check_request(labels, self.labels, "ReferencePanel.select_shards")
        known = self.known or self.__dict__.get("described_shards")
        return ReferencePanel(self.variants.filter(F.col("chr").isin(wanted)), tuple(wanted), None if known is None else tuple(k for k in known if k[0] in wanted))

    def mismatches(self, other: DataFrame) -> DataFrame:
        """Shards that differ from other (chr, num_snp, checksum) in label, size or, where both have one, checksum."""
        own = self.shards().select("chr", "num_snp", "checksum")
        theirs = other.select("chr", F.col("num_snp").alias("n"), F.col("checksum").alias("c"))
        return own.join(theirs, "chr", "full").filter("num_snp IS NULL OR n IS NULL OR num_snp <> n OR checksum <> c")

    def is_object_compatible(self, shards: DataFrame) -> bool:
        bad = self.mismatches(shards).limit(1).collect()
        if bad:
            _LOG.warning("shard %s differs from the reference", bad[0]["chr"])
        return not bad

    def check_compatible(self, shards: DataFrame, where: str) -> None:
        """As is_object_compatible, but raises, and wants a checksum."""
        bad = self.mismatches(shards).select("chr").union(shards.filter("checksum IS NULL").select("chr")).limit(1).collect()
        if bad:
            raise ValueError(f"{where}: shard {bad[0]['chr']!r} is not that of the reference")

    def save(self, path: str) -> None:
        """Parquet by shard, and the shards' sizes and checksums."""
        self.variants.write.partitionBy("chr").parquet(f"{path}/variants")
        save_shards(self, path)

    def validate_checksums(self) -> None:
        """Computes the checksums anew, from all variants, and raises where they are not those that the panel came with."""
        own = ReferencePanel(self.variants, self.labels)
        own.check_compatible(self._sizes(), "validate_checksums")


def panel_of(variants: DataFrame) -> ReferencePanel:
    """A panel of numbered variants; its labels take one pass."""
    labels = [r["chr"] for r in variants.select("chr").distinct().orderBy(chr_rank(F.col("chr"))).collect()]
    if not labels:
        raise ValueError("a panel has at least one shard")
    return ReferencePanel(variants, tuple(labels))


def save_shards(reference: ReferencePanel, path: str) -> None:
    """What objects that are aligned to a reference keep of it."""
    reference._sizes().coalesce(1).write.parquet(f"{path}/shards")


def stored_shards(spark: SparkSession, path: str) -> tuple[tuple[str, int, str], ...]:
    rows = spark.read.parquet(f"{path}/shards").select("chr", "num_snp", "checksum").collect()
    return tuple(sorted((tuple(r) for r in rows), key=lambda r: CONTIGS.index(r[0])))


def check_stored(spark: SparkSession, path: str, reference: ReferencePanel) -> tuple[str, ...]:
    """Labels of a cache's shards; raises where one isn't that of the reference. No variant is read."""
    own = {c: (n, md5) for c, n, md5 in reference.described_shards}
    found = stored_shards(spark, path)
    if bad := [c for c, n, md5 in found if own.get(c) != (n, md5)]:
        raise ValueError(f"{path}: shard {bad[0]!r} is not that of the reference")
    return tuple(c for c, _, _ in found)


def load_reference_cache(spark: SparkSession, path: str, shards: Sequence[str] | None = None) -> ReferencePanel:
    """Reads only the shards that are asked for (partition pruning). Labels, sizes and checksums are those that are stored; `validate_checksums` computes them."""
    found = spark.read.option("inferSchema", False).schema("local_idx long, snp string, bp long, a1 string, a2 string, chr string").parquet(f"{path}/variants")
    known = stored_shards(spark, path)
    panel = ReferencePanel(found, tuple(c for c, _, _ in known), known)
    return panel.select_shards(shards) if shards is not None else panel


def generated_metadata(source: str, has_header: bool, num_source_intervals: int, **values: object) -> str:
    """Provenance of an annotation as JSON with sorted keys; values that are None are left out."""
    about = {"source_file": source, "source_file_has_header": int(has_header), "num_source_intervals": num_source_intervals}
    return json.dumps(about | {k: v for k, v in values.items() if v is not None}, sort_keys=True, separators=(",", ":"))
