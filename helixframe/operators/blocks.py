"""Linkage disequilibrium as sparse blocks: correlations of SIZE by SIZE neighbouring variants are one row.

A block row has (chr, bi, bj) and, for each entry, its places i and j within blocks bi and bj and its correlation r. Only pairs i before j
are kept: the matrix is symmetric and its diagonal is 1. Blocks are built, multiplied and pruned in Arrow; single correlations become
rows only where a user asks for them.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.sources.plink import CALLS, pack_calls
from helixframe.tables import stored

SIZE = 512
SCHEMA = "chr string, bi int, bj int, i array<smallint>, j array<smallint>, r array<float>"
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
#: Blocks of a stripe at most, and bytes of packed calls that a task holds of it; bytes of a row's calls that are multiplied at once; columns of a matrix that are multiplied together.
STRIPE_BLOCKS, STRIPE_BYTES, STEP, COLUMNS = 8, 256 << 20, 2048, 64
ROUNDING = 1e-12  # squared correlations that are so near the least one, relative to it, are compared in whole numbers


def blocks_of(pairs: DataFrame) -> DataFrame:
    """Blocks from rows (chr, i, j, r) with i before j, each pair once. A block's entries come together in one row, SIZE * SIZE at most."""
    entry = F.struct((F.col("i") % SIZE).cast("smallint").alias("i"), (F.col("j") % SIZE).cast("smallint").alias("j"), F.col("r").cast("float").alias("r"))
    place = lambda c: F.floor(F.col(c) / SIZE).cast("int")
    own = pairs.select("chr", place("i").alias("bi"), place("j").alias("bj"), entry.alias("entry"))
    return own.groupBy("chr", "bi", "bj").agg(F.sort_array(F.collect_list("entry")).alias("e")).select("chr", "bi", "bj", *(F.col(f"e.{c}").alias(c) for c in "ijr"))


def pairs_of(blocks: DataFrame) -> DataFrame:
    """(…, i, j, r) with i before j, from blocks; other columns than a block's own stay."""
    more = [c for c in blocks.columns if c not in NAMES]
    entries = blocks.select("chr", *more, "bi", "bj", F.inline(F.arrays_zip("i", "j", "r")))
    wide = lambda b, c: (F.col(b).cast("long") * SIZE + F.col(c)).alias(c)
    return entries.select("chr", *more, wide("bi", "i"), wide("bj", "j"), "r")


def rows_of(blocks: DataFrame, axis: DataFrame) -> DataFrame:
    """Rows (chr, i, j, r) of both triangles and the unit diagonal; axis: chr, local_idx."""
    one = pairs_of(blocks).select("chr", "i", "j", "r")
    two = one.select("chr", F.col("j").alias("i"), F.col("i").alias("j"), "r")
    return one.unionByName(two).unionByName(axis.select("chr", F.col("local_idx").alias("i"), F.col("local_idx").alias("j"), F.lit(1.0).cast("float").alias("r")))


def block_faults(blocks: DataFrame) -> DataFrame:
    """(chr, nnz, misplaced, beyond): entries of each shard's triangle, those that are not i before j or not within a block, and those that are no correlation."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.zeros((3, len(batch)), np.int64)
            for k in range(len(batch)):
                i, j, r = (x.values.to_numpy(zero_copy_only=False) if (x := batch.column(c)[k]).is_valid else np.empty(0) for c in "ijr")
                sizes = len(i), len(j)
                n, low = min(sizes), (batch.column("bj")[k].as_py() - batch.column("bi")[k].as_py()) * SIZE
                i, j = i[:n].astype(np.float64), j[:n].astype(np.float64)  # nulls are NaN
                fine = (np.minimum(i, j) >= 0) & (np.maximum(i, j) < SIZE) & (i < j + low)
                counts[:, k] = len(r), n - fine.sum() + (not sizes[0] == sizes[1] == len(r)), len(r) - (np.abs(r) <= 1 + 1e-6).sum()
            yield pa.RecordBatch.from_arrays([batch.column("chr"), *(pa.array(x) for x in counts)], ["chr", "nnz", "misplaced", "beyond"])

    found = blocks.select(*NAMES).mapInArrow(count, "chr string, nnz long, misplaced long, beyond long")
    return found.groupBy("chr").agg(*(F.sum(c).alias(c) for c in ("nnz", "misplaced", "beyond")))


# Building ----------------------------------------------------------------------------------------------------


def correlations(x: np.ndarray, y: np.ndarray, n: int, least_r2: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Pearson's r of every row of x with every row of y (packed calls of n samples) over the samples that both have, NaN where it isn't defined; and
    whether r * r reaches least_r2.

    Matrix products over some samples at a time. Sums are whole numbers, and those of one product fit single precision, so they are exact.
    """
    sums = [np.zeros((len(x), len(y))) for _ in range(6)]
    for lo in range(0, x.shape[1], STEP):
        there = max(0, min(n - 4 * lo, 4 * STEP))
        a, b = (CALLS[p[:, lo : lo + STEP]].reshape(len(p), -1)[:, :there].astype(np.float32) for p in (x, y))
        has_a, has_b = (a >= 0).astype(np.float32), (b >= 0).astype(np.float32)
        a, b = a * has_a, b * has_b
        for total, left, right in zip(sums, (has_a, a, has_a, a * a, has_a, a), (has_b, has_b, b, has_b, b * b, b), strict=True):
            total += left @ right.T
    seen, sx, sy, sxx, syy, sxy = sums
    both, of_x, of_y = seen * sxy - sx * sy, seen * sxx - sx * sx, seen * syy - sy * sy
    with np.errstate(divide="ignore", invalid="ignore"):
        r = both / np.sqrt(of_x * of_y)
    return r, reaches(r, both, of_x, of_y, least_r2)


def reaches(r: np.ndarray, both: np.ndarray, of_x: np.ndarray, of_y: np.ndarray, least_r2: float) -> np.ndarray:
    """Whether r * r = both ** 2 / (of_x * of_y) is at least least_r2, the decimal fraction that it is written as.

    What rounding might turn is decided in whole numbers: r * r may be that very fraction.
    """
    square, least = r * r, Fraction(repr(float(least_r2)))
    found = square >= least_r2
    for at in zip(*np.nonzero(np.abs(square - least_r2) < least_r2 * ROUNDING), strict=True):
        found[at] = int(both[at]) ** 2 * least.denominator >= least.numerator * int(of_x[at]) * int(of_y[at])
    return found


def _near(own: DataFrame, width: int, stripe_blocks: int) -> DataFrame:
    """(chr, block, stripes): to which stripes a block goes: its own, and earlier ones of which some variant lies within width.

    Stripes and blocks meet in bins of width base pairs, so a contig is no key of its own.
    """
    spans = own.groupBy("chr", "block").agg(F.min("bp").alias("lo"), F.max("bp").alias("hi"))
    spans = stored(spans.withColumn("stripe", F.floor(F.col("block") / stripe_blocks)), "ld-spans")  # a row for each block
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width)))
    stripes = spans.groupBy("chr", F.col("stripe").alias("to")).agg((F.min("lo") - width).alias("from"), (F.max("hi") + width).alias("until"))
    stripes = stripes.withColumn("bin", bins(F.col("from"), F.col("until")))
    after = spans.withColumn("bin", bins(F.col("lo"), F.col("hi"))).join(stripes, ["chr", "bin"]).filter("to < stripe AND lo <= until AND hi >= from")
    every = after.select("chr", "block", "to").unionByName(spans.select("chr", "block", F.col("stripe").alias("to")))
    return every.groupBy("chr", "block").agg(F.collect_set("to").alias("stripes"))


def build_blocks(calls: DataFrame, window_kb: float, least_r2: float, stripe_blocks: int = STRIPE_BLOCKS) -> DataFrame:
    """Blocks of correlations of variants at most window_kb apart with r * r of at least least_r2.

    calls: chr, local_idx, bp, calls (array of 0, 1, 2, -1), each variant once. A task sweeps one stripe of neighbouring blocks: it keeps their packed calls, and
    those of the blocks after it that the window reaches pass by in order. So a variant's calls are sent once for each stripe in
    its window, not for each pair of blocks, and memory is bounded by the stripe and one block more.
    """
    width = max(1, int(window_kb * 1000))
    first = calls.select(F.size("calls").alias("n")).first()
    n = first["n"] if first else 0
    each = max(1, min(stripe_blocks, STRIPE_BYTES // (SIZE * max(1, -(-n // 4)))))
    place = F.floor(F.col("local_idx") / SIZE).cast("int")
    near = stored(_near(calls.select("chr", place.alias("block"), F.col("bp").cast("long").alias("bp")), width, each), "ld-near")
    own = calls.select("chr", place.alias("block"), F.col("local_idx").cast("long").alias("idx"), F.col("bp").cast("long").alias("bp"), "calls")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("calls")
            if len(batch) and (values.null_count or (values.value_lengths().to_numpy() != n).any()):
                raise ValueError(f"every variant must have {n} calls")
            data = pack_calls(values.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), n)) if n else np.empty((len(batch), 0), np.uint8)
            packed = pa.array([row.tobytes() for row in data], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("chr", "block", "idx", "bp")), packed], ["chr", "block", "idx", "bp", "packed"])

    packed = own.mapInArrow(pack, "chr string, block int, idx long, bp long, packed binary")
    dealt = packed.join(near, ["chr", "block"]).select("chr", F.explode("stripes").alias("stripe"), "block", "idx", "bp", "packed")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = block = None
        mine: list[tuple] = []  # blocks of the stripe: number, places, positions, packed calls
        rows: list[tuple] = []

        def done() -> Iterator[pa.RecordBatch]:
            idx, bp = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
            here = (block, idx % SIZE, bp, np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1))
            if block // each == key[1]:
                mine.append(here)
            for bi, i, at, data in mine:
                if at.max() + width < bp.min() or bp.max() + width < at.min():
                    continue
                r, keep = correlations(data, here[3], n, least_r2)
                keep &= np.abs(at[:, None] - bp) <= width
                if bi == block:
                    keep &= i[:, None] < here[1]
                a, b = np.nonzero(keep)
                if len(a):
                    columns = [pa.array([x], t) for x, t in ((key[0], pa.string()), (bi, pa.int32()), (block, pa.int32()))]
                    columns += [pa.array([v], pa.list_(t)) for v, t in ((i[a].astype(np.int16), pa.int16()), (here[1][b].astype(np.int16), pa.int16()), (r[a, b].astype(np.float32), pa.float32()))]
                    yield pa.RecordBatch.from_arrays(columns, NAMES)

        for batch in batches:
            for chr_, stripe, own_block, idx, bp, data in zip(*(batch.column(c).to_pylist() for c in ("chr", "stripe", "block", "idx", "bp", "packed")), strict=True):
                if rows and ((chr_, stripe) != key or own_block != block):
                    yield from done()
                    rows = []
                if (chr_, stripe) != key:
                    key, mine = (chr_, stripe), []
                block = own_block
                rows.append((idx, bp, data))
        if rows:
            yield from done()

    return dealt.repartition("chr", "stripe").sortWithinPartitions("chr", "stripe", "idx").mapInArrow(sweep, SCHEMA)


# Multiplication ----------------------------------------------------------------------------------------------


def multiply_r2(blocks: DataFrame, matrix: DataFrame, axis: DataFrame) -> DataFrame:
    """(chr, local_idx, name, value): sum over j of r * r * value of j, for each column `name` of a long matrix.

    matrix: chr, local_idx, name, value. Every variant of the axis has a row for every name. r * r is taken in float. Columns go in parts of COLUMNS,
    and a block of the matrix meets each correlation block as one dense product; what is sent are blocks and their products.
    """
    names = stored(matrix.select("name").distinct(), "ld-names")
    numbered = names.withColumn("id", F.row_number().over(_ordered("name")) - 1)  # columns of a panel, each once
    numbered = stored(numbered.select("name", (F.col("id") / COLUMNS).cast("int").alias("part"), (F.col("id") % COLUMNS).cast("int").alias("column")), "ld-columns")
    place = F.floor(F.col("local_idx") / SIZE).cast("int")
    entry = F.struct((F.col("local_idx") % SIZE).cast("int").alias("i"), "column", F.col("value").cast("double").alias("v"))
    dense = matrix.join(numbered, "name").select("chr", place.alias("b"), "part", entry.alias("e")).groupBy("chr", "b", "part").agg(F.collect_list("e").alias("x"))
    dense = stored(dense, "ld-matrix")
    there = ["chr", "bi", "bj", "i", "j", "r"]
    ways = F.explode(F.array(F.struct(F.col("bj").alias("b"), F.col("bi").alias("to"), F.lit(False).alias("turned")), F.struct(F.col("bi").alias("b"), F.col("bj").alias("to"), F.lit(True).alias("turned"))))
    met = blocks.select(*there, ways.alias("way")).select("chr", F.col("way.b").alias("b"), F.col("way.to").alias("to"), F.col("way.turned").alias("turned"), "i", "j", "r").join(dense, ["chr", "b"])

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(len(whole)):
                batch = whole.slice(at, 1)
                i, j, r = (batch.column(c).flatten().to_numpy() for c in "ijr")
                e = batch.column("x").flatten()
                at_i, at_column, v = (e.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                x = np.zeros((SIZE, int(at_column.max()) + 1))
                np.add.at(x, (at_i, at_column), v)
                i, j = (j, i) if batch.column("turned")[0].as_py() else (i, j)
                y = np.zeros_like(x)
                if np.isfinite(x).all():
                    tile = np.zeros((SIZE, SIZE))
                    tile[i, j] = r * r
                    y = tile @ x
                else:  # what isn't finite goes only to neighbours
                    np.add.at(y, i, (r * r).astype(np.float64)[:, None] * x[j])
                own_i, own_c = np.nonzero(y)
                lists = [pa.array([z], pa.list_(t)) for z, t in ((own_i.astype(np.int32), pa.int32()), (own_c.astype(np.int32), pa.int32()), (y[own_i, own_c], pa.float64()))]
                yield pa.RecordBatch.from_arrays([batch.column("chr"), batch.column("to"), batch.column("part"), *lists], ["chr", "b", "part", "i", "column", "v"])

    parts = met.mapInArrow(product, "chr string, b int, part int, i array<int>, column array<int>, v array<double>")
    itself = dense.select("chr", "b", "part", F.col("x.i").alias("i"), F.col("x.column").alias("column"), F.col("x.v").alias("v"))  # the unit diagonal

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, y = None, np.zeros((SIZE, COLUMNS))

        def close() -> pa.RecordBatch:
            i, c = np.nonzero(y)
            columns = [pa.array([x] * len(i), t) for x, t in ((key[0], pa.string()), (key[2], pa.int32()))]
            columns += [pa.array(i + key[1] * SIZE, pa.int64()), pa.array(c.astype(np.int32), pa.int32()), pa.array(y[i, c], pa.float64())]
            return pa.RecordBatch.from_arrays(columns, ["chr", "part", "local_idx", "column", "value"])

        for batch in batches:
            for at, own in enumerate(zip(*(batch.column(c).to_pylist() for c in ("chr", "b", "part")), strict=True)):
                if own != key:
                    if key is not None:
                        yield close()
                    key = own
                    y[:] = 0
                np.add.at(y, tuple(batch.column(c)[at].values.to_numpy() for c in ("i", "column")), batch.column("v")[at].values.to_numpy())
        if key is not None:
            yield close()

    sums = parts.unionByName(itself).repartition("chr", "b", "part").sortWithinPartitions("chr", "b", "part").mapInArrow(total, "chr string, part int, local_idx long, column int, value double")
    every = axis.select("chr", F.col("local_idx").cast("long").alias("local_idx")).crossJoin(numbered)
    return every.join(sums, ["chr", "local_idx", "part", "column"], "left").select("chr", "local_idx", "name", F.coalesce("value", F.lit(0.0)).alias("value"))


def _ordered(column: str):
    from pyspark.sql import Window

    return Window.orderBy(column)
