"""PLINK 1 sources: BIM, FAM, a ploidy sidecar, and the packed calls of a BED file."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from helixframe.contigs import CONTIGS, IGNORED, chr_rank, is_styled
from helixframe.functions.variants import is_dna
from helixframe.reference import ReferencePanel, panel_of
from helixframe.sources.files import file_system, write_files
from helixframe.sources.text import fields, numbered_lines
from helixframe.tables import check_rows, check_unique, path_exists

#: First bytes of a BED file in variant-major order.
BED_MAGIC = b"\x6c\x1b\x01"
BLOCK_BYTES = 64 << 20
RANGE_BYTES = 1 << 20  # of a BED file that are read where one row of them is wanted


def _integral(token) -> F.Column:
    x = token.try_cast("double")
    return x.isNotNull() & (F.floor(x) == x)


def read_bim(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, row0, chr, snp, bp, a1, a2: all rows, those of ignored contigs too, as BED rows follow them."""
    rows = fields(numbered_lines(spark, paths), ["chr", "snp", "cm", "bp", "a1", "a2"])
    c = F.col
    rules = [
        ("expected 6 columns", c("n_fields") != 6),
        ("labels such as chr1 are not allowed", is_styled(c("chr"))),
        ("unknown contig", ~c("chr").isin(*CONTIGS, *IGNORED)),
        ("alleles must be of A, C, G and T", ~is_dna(c("a1")) | ~is_dna(c("a2"))),
        ("a1 and a2 must differ", c("a1") == c("a2")),
        ("cm must be a number", c("cm").try_cast("double").isNull()),
        ("bp must be an integer", ~_integral(c("bp"))),
    ]
    check_rows(rows, rules, str(paths))
    return rows.select("path", "row0", "chr", "snp", c("bp").cast("double").cast("long").alias("bp"), "a1", "a2")


def check_order(bim: DataFrame) -> None:
    """Raises where contig rank or position goes down from one row to the next."""
    bad = order_violations(bim.filter(F.col("chr").isin(*CONTIGS))).orderBy("path", "row0").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['path']}: row {bad[0]['row0'] + 1}: rows must be sorted by contig and position")


def order_violations(bim: DataFrame) -> DataFrame:
    """Rows whose (contig rank, bp) is lower than that of the row before. Rows are dealt in blocks of numbers, not by contig."""
    rank = F.struct(chr_rank(F.col("chr")).alias("rank"), "bp")
    numbered = bim.withColumn("here", rank).withColumn("block", F.floor(F.col("row0") / 65536))
    ends = numbered.groupBy("path", "block").agg(F.max_by("here", "row0").alias("last"))
    above = ends.select("path", "block", F.lag("last").over(Window.partitionBy("path").orderBy("block")).alias("above"))  # the last row of the block before
    w = Window.partitionBy("path", "block").orderBy("row0")
    seen = numbered.withColumn("within", F.lag("here").over(w)).join(above, ["path", "block"])
    return seen.filter(F.col("here") < F.coalesce("within", "above")).drop("here", "within", "above", "block")


def read_fam(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, sample_idx, fid, iid, father_id, mother_id, sex."""
    rows = fields(numbered_lines(spark, paths), ["fid", "iid", "father_id", "mother_id", "sex", "pheno"])
    check_rows(rows, [("expected 6 columns", F.col("n_fields") != 6), ("sex must be 0, 1 or 2", ~F.col("sex").isin("0", "1", "2"))], str(paths))
    check_unique(rows, ["path", "fid", "iid"], str(paths))
    return rows.select("path", F.col("row0").alias("sample_idx"), "fid", "iid", "father_id", "mother_id", F.col("sex").cast("tinyint").alias("sex"))


def read_ploidy(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, row0, ploidy_male, ploidy_female: a row for each BIM row."""
    rows = fields(numbered_lines(spark, path), ["ploidy_male", "ploidy_female"], "\t")
    allowed = lambda c: F.col(c).isin("0", "1", "2")
    check_rows(rows, [("expected 2 columns", F.col("n_fields") != 2), ("ploidy must be 0, 1 or 2", ~allowed("ploidy_male") | ~allowed("ploidy_female"))], str(path))
    return rows.select("path", "row0", F.col("ploidy_male").cast("double").alias("ploidy_male"), F.col("ploidy_female").cast("double").alias("ploidy_female"))


def default_ploidy(bim: DataFrame) -> DataFrame:
    """bim with ploidies (2, 2), or (1, 2) on X."""
    return bim.withColumns({"ploidy_male": F.when(F.col("chr") == "X", 1.0).otherwise(2.0), "ploidy_female": F.lit(2.0)})


def load_reference(spark: SparkSession, path: str | list[str], shards: list[str] | None = None, exists=None) -> ReferencePanel:
    """A panel from one BIM file, from one for each shard, or from a template in which @ stands for each label.

    exists: says whether a path of the template is there; by default Hadoop's file systems are asked.
    """
    exists = exists or (lambda p: path_exists(spark, p))
    paths = list(path) if not isinstance(path, str) else [path] if "@" not in path else [p for label in CONTIGS if (shards is None or label in shards) and exists(p := path.replace("@", label))]
    if not paths:
        raise ValueError(f"{path}: no such file for any label")
    bim = read_bim(spark, paths)
    check_order(bim)
    if not isinstance(path, str) or "@" in path:
        mixed = bim.groupBy("path").agg(F.min("chr").alias("lo"), F.max("chr").alias("hi")).filter("lo <> hi").limit(1).collect()
        if mixed:
            raise ValueError(f"{mixed[0]['path']}: a shard's file holds one contig")
    kept = bim.filter(F.col("chr").isin(*CONTIGS))
    first = kept.groupBy("path", "chr").agg(F.min("row0").alias("first"))  # rows of a contig are together, as order was checked
    numbered = kept.join(F.broadcast(first), ["path", "chr"]).withColumn("raw", F.col("row0") - F.col("first"))
    panel = panel_of(numbered.select("chr", F.col("raw").alias("local_idx"), "snp", "bp", "a1", "a2"))
    return panel.select_shards(shards) if shards is not None else panel


def read_hash_table(spark: SparkSession, path: str) -> DataFrame:
    """A whitespace-delimited table with a header that starts with #, as strings; every row must have as many columns."""
    lines = numbered_lines(spark, path)
    head = lines.orderBy("row0").limit(1).collect()
    if not head or not head[0]["value"].startswith("#"):
        raise ValueError(f"{path}: expected a header that starts with #")
    names = head[0]["value"][1:].split()
    rows = fields(lines.filter("row0 > 0 AND trim(value) <> ''"), names)
    check_rows(rows, [(f"expected {len(names)} columns", F.col("n_fields") != len(names))], path)
    return rows.drop("path", "n_fields")


class _Rows(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class _BedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.n_sample, self.n_snp = options["path"], int(options["n_sample"]), int(options["n_snp"])
        self.ranges = json.loads(options["ranges"]) if "ranges" in options else None
        self.width = -(-self.n_sample // 4)

    def _open(self):
        system, path = file_system(self.path)
        return system.open_input_file(path)

    def partitions(self) -> list[_Rows]:
        with self._open() as f:
            if f.read(3) != BED_MAGIC:
                raise ValueError(f"{self.path}: not a BED file in variant-major order")
            if f.size() != 3 + self.width * self.n_snp:
                raise ValueError(f"{self.path}: expected {3 + self.width * self.n_snp} bytes, found {f.size()}")
        each = max(1, BLOCK_BYTES // max(1, self.width))
        ranges = [(0, self.n_snp)] if self.ranges is None else sorted(map(tuple, self.ranges))
        if any(a < 0 or b > self.n_snp or a >= b for a, b in ranges if self.ranges is not None):
            raise ValueError(f"{self.path}: a row is out of bounds")
        merged: list[list[int]] = []
        for a, b in ranges:  # neighbours are read at once
            if merged and merged[-1][1] >= a:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        return [_Rows(lo, min(lo + each, b)) for a, b in merged for lo in range(a, b, each)] or [_Rows(0, 0)]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        step = max(1, (4 << 20) // max(1, self.width))
        with self._open() as f:
            for start in range(partition.start, partition.stop, step):
                stop = min(start + step, partition.stop)
                f.seek(3 + self.width * start)
                data = f.read(self.width * (stop - start))
                packed = [data[i : i + self.width] for i in range(0, len(data), self.width)]
                yield pa.RecordBatch.from_arrays([pa.array(range(start, stop), pa.int64()), pa.array(packed, pa.binary())], ["source_row0", "packed"])


class PlinkBed(DataSource):
    """Packed rows of a BED file: options path, n_sample, n_snp, and ranges (JSON) of rows to read no others."""

    @classmethod
    def name(cls) -> str:
        return "plink_bed"

    def schema(self) -> str:
        return "source_row0 long, packed binary"

    def reader(self, schema) -> _BedReader:
        return _BedReader(self.options)


def rows_of_range(n_sample: int) -> int:
    """How many rows of a BED file RANGE_BYTES are."""
    return max(1, RANGE_BYTES // max(1, -(-n_sample // 4)))


def read_bed(spark: SparkSession, path: str, n_sample: int, n_snp: int, ranges: list[tuple[int, int]] | None = None) -> DataFrame:
    """(source_row0, packed); with ranges (start and end of rows), only those."""
    spark.dataSource.register(PlinkBed)
    reader = spark.read.format("plink_bed").option("path", path).option("n_sample", n_sample).option("n_snp", n_snp)
    return (reader if ranges is None else reader.option("ranges", json.dumps(ranges))).load()


#: Calls of the four places of each byte: 00 is 2, 01 missing (-1), 10 is 1, 11 is 0; and the bits of a call, by call + 1.
CALLS = np.array([[(2, -1, 1, 0)[b >> 2 * k & 3] for k in range(4)] for b in range(256)], np.int8)
CODES = np.array([1, 3, 2, 0], np.uint8)


def unpacked(packed: list[bytes], n_sample: int) -> np.ndarray:
    """Calls of packed rows: a row for each variant, a column for each sample."""
    data = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -(-n_sample // 4))
    return CALLS[data].reshape(len(packed), 4 * data.shape[1])[:, :n_sample]


def unpack_calls(packed: DataFrame, n_sample: int) -> DataFrame:
    """packed with `calls`: an array of a call for each sample, decoded batch by batch."""
    rest = [c for c in packed.columns if c != "packed"]
    schema = T.StructType([*(packed.schema[c] for c in rest), T.StructField("calls", T.ArrayType(T.ByteType(), False))])
    step = max(1, (16 << 20) // max(1, n_sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), step):
                batch = whole.slice(lo, step)
                calls = unpacked(batch.column("packed").to_pylist(), n_sample)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * n_sample), pa.array(np.ascontiguousarray(calls).ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), lists], [*rest, "calls"])

    return packed.mapInArrow(run, schema)


def pack_calls(calls: np.ndarray) -> np.ndarray:
    """Bytes of calls, a row for each variant; the last byte is filled with zero bits."""
    codes = np.pad(CODES[calls.astype(np.int64) + 1], [(0, 0), (0, -calls.shape[1] % 4)])
    codes = np.where(np.arange(codes.shape[1]) < calls.shape[1], codes, 0).astype(np.uint8)
    return codes[:, ::4] | codes[:, 1::4] << 2 | codes[:, 2::4] << 4 | codes[:, 3::4] << 6


def write_bed(calls: DataFrame, path: str) -> None:
    """calls: shard, row0, calls. A BED file for each shard (@ in path stands for it), streamed in order by one task, as it is one file; see `files.write_files`."""
    root = path.split("@", 1)[0].rsplit("/", 1)[0]
    name = F.replace(F.lit(path[len(root) + 1 :]), F.lit("@"), F.col("shard"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("calls").value_lengths().to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1), len(sizes)]
            data = [row.tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True) for row in pack_calls(batch.column("calls").slice(a, b - a).flatten().to_numpy().reshape(b - a, int(sizes[a])))] if len(sizes) else []
            yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("part"), pa.array(data, pa.binary())], ["name", "part", "content"])

    rows = calls.select(name.alias("name"), F.col("row0").cast("long").alias("part"), F.col("calls").cast("array<tinyint>").alias("calls")).mapInArrow(pack, "name string, part long, content binary")
    heads = calls.select(name.alias("name")).distinct().select("name", F.lit(-1).cast("long").alias("part"), F.lit(bytearray(BED_MAGIC)).alias("content"))
    write_files(heads.unionByName(rows), root)
