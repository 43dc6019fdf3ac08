"""LD distributions as a manifest, compressed-column npz files and BIM files: validation, import by ranges of columns, export."""

from __future__ import annotations

import hashlib
import json
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib import format as npy
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from helixframe.contigs import CHRX_SEXES, CONTIGS
from helixframe.ld import LDPanel, check_sex, panel_from_blocks, write_bim
from helixframe.operators.blocks import NAMES, SIZE
from helixframe.operators.linkage import TOLERANCE
from helixframe.reference import ReferencePanel
from helixframe.sources.files import file_system, md5_of, read_small, write_file, write_files
from helixframe.sources.plink import load_reference
from helixframe.tables import stored

#: Fixed values of the format: the manifest, fields of its entries, what a shard's metadata has to say, types of a shard's arrays.
MANIFEST = {"object_type": "ld_panel_manifest", "schema_version": "1.0", "runtime_format": "python_npz_csc32"}
ENTRY = ("chr", "sex", "file", "file_md5", "num_snp", "nnz", "reference_checksum", "reference_bim")
AGREEING = ("chr", "sex", "num_snp", "nnz", "reference_checksum", "reference_bim")
SAID = {"object_type": "ld_shard", "schema_version": "1.0", "matrix": "symmetric", "diagonal": "explicit_unit", "value": "r", "sparse_layout": "csc", "index_base": 0}
FORMAT = "ld_npz_csc32"
NPZ_TYPES = {"data": "float32", "indices": "int32", "indptr": "int32", "shape": "int64", "a1freq": "float32", "metadata": "uint8"}

ENTRIES = 16 << 20  # entries of a shard that one task reads, some columns more or less
BATCH = 1 << 20  # entries that are handed on at once
CHUNK = 1 << 20  # bytes of a file that are one row of a sink, more or less


def is_plain_name(name: object) -> bool:
    """Whether a name stays in its folder: no separators, no drive, no dots that lead out."""
    return isinstance(name, str) and name not in ("", ".") and ".." not in name and not any(c in name for c in "/\\:\0")


def _whole(x: object, least: int) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and x >= least


def _is_md5(x: object) -> bool:
    return isinstance(x, str) and len(x) == 32


def _same(found: dict, wanted: dict, where: str) -> None:
    for key, value in wanted.items():
        if found.get(key) != value or isinstance(found.get(key), bool):
            raise ValueError(f"{where}: {key} must be {value!r}")


def check_entry(e: dict, where: str) -> None:
    if missing := [k for k in ENTRY if k not in e]:
        raise ValueError(f"{where}: an entry has no {', '.join(missing)}")
    if e["chr"] not in CONTIGS:
        raise ValueError(f"{where}: unknown contig {e['chr']!r}")
    check_sex(e["chr"], e["sex"])
    if not isinstance(e["file"], str) or not e["file"].endswith(".npz") or e["file"].startswith("/") or ".." in e["file"].split("/"):
        raise ValueError(f"{where}: {e['file']!r} must be an npz file within the distribution")
    if not is_plain_name(e["reference_bim"]):
        raise ValueError(f"{where}: reference_bim must be the name of a file beside the manifest")
    if not _whole(e["num_snp"], 1) or not _whole(e["nnz"], 0):
        raise ValueError(f"{where}: sizes of {e['file']!r} must be whole numbers")
    if not _is_md5(e["file_md5"]):
        raise ValueError(f"{where}: file_md5 of {e['file']!r} must be an MD5")
    if not isinstance(e["reference_checksum"], str) or not e["reference_checksum"]:
        raise ValueError(f"{where}: {e['file']!r} has no reference_checksum")


def in_order(entries: list[dict]) -> list[dict]:
    """Entries in canonical order."""
    return sorted(entries, key=lambda e: (CONTIGS.index(e["chr"]), CHRX_SEXES.index(e["sex"]) if e["sex"] else -1))


def check_manifest(manifest: dict, where: str) -> list[dict]:
    """Entries of a manifest, checked, in canonical order."""
    _same(manifest, MANIFEST, where)
    if not is_plain_name(manifest.get("reference_cache")):
        raise ValueError(f"{where}: reference_cache must be the name of a file beside the manifest")
    if not _is_md5(manifest.get("reference_cache_md5")):
        raise ValueError(f"{where}: reference_cache_md5 must be an MD5")
    entries = manifest.get("shards")
    if not isinstance(entries, list) or not entries:
        raise ValueError(f"{where}: the manifest has no shards")
    for e in entries:
        check_entry(e, where)
    places = [(e["chr"], e["sex"]) for e in entries]
    if len(set(places)) != len(places):
        raise ValueError(f"{where}: a shard is listed twice")
    bims = {(e["chr"], e["reference_bim"]) for e in entries}
    if len({c for c, _ in bims}) < len(bims):
        raise ValueError(f"{where}: entries of one contig must share reference_bim")
    return in_order(entries)


def read_manifest(spark: SparkSession, root: str) -> list[dict]:
    """Entries of the manifest in its folder, checked and in canonical order."""
    return check_manifest(json.loads(read_small(spark, f"{root}/ld_manifest.json")), root)


def check_metadata(meta: dict, where: str) -> None:
    """Raises unless a shard's metadata describes a symmetric matrix of correlations with sizes that make sense."""
    if missing := [k for k in (*AGREEING, *SAID, "format", "num_monomorphic_snps") if k not in meta]:
        raise ValueError(f"{where}: metadata has no {', '.join(missing)}")
    _same(meta, SAID, where)
    if not isinstance(meta["format"], str) or not meta["format"].endswith(FORMAT):
        raise ValueError(f"{where}: format must be one of {FORMAT}")
    if meta["chr"] not in CONTIGS:
        raise ValueError(f"{where}: unknown contig {meta['chr']!r}")
    check_sex(meta["chr"], meta["sex"])
    if not _whole(meta["num_snp"], 1) or not _whole(meta["nnz"], 0) or meta["nnz"] >= 1 << 31:
        raise ValueError(f"{where}: num_snp or nnz is out of bounds")
    if not _whole(meta["num_monomorphic_snps"], 0) or meta["num_monomorphic_snps"] > meta["num_snp"]:
        raise ValueError(f"{where}: more monomorphic variants than variants")
    if not isinstance(meta["reference_checksum"], str) or not meta["reference_checksum"]:
        raise ValueError(f"{where}: no reference_checksum")
    if not is_plain_name(meta["reference_bim"]):
        raise ValueError(f"{where}: reference_bim must be the name of a file")


def check_agreement(entry: dict, meta: dict, where: str) -> None:
    if bad := [k for k in AGREEING if entry[k] != meta[k]]:
        raise ValueError(f"{where}: manifest and shard differ in {', '.join(bad)}")


# Reading -----------------------------------------------------------------------------------------------------


class _Shard:
    """An open npz file: its small arrays, and streams over its large ones."""

    def __init__(self, path: str):
        self.path = path
        system, own = file_system(path)
        self.zip = zipfile.ZipFile(system.open_input_file(own))
        names = set(self.zip.namelist())
        if missing := [k for k in NPZ_TYPES if f"{k}.npy" not in names]:
            raise ValueError(f"{path}: no array {missing[0]!r}")
        self.sizes = {}
        for k, kind in NPZ_TYPES.items():
            with self.zip.open(f"{k}.npy") as f:
                shape, _, dtype = self._header(f)
            if dtype != kind or len(shape) != 1:
                raise ValueError(f"{path}: {k} must be a list of {kind}")
            self.sizes[k] = shape[0]
        self.indptr, self.a1freq, shape, said = (next(self.stream(k, 0, self.sizes[k], self.sizes[k] or 1), np.empty(0, NPZ_TYPES[k])) for k in ("indptr", "a1freq", "shape", "metadata"))
        n = len(self.a1freq)
        if shape.tolist() != [n, n] or len(self.indptr) != n + 1 or self.indptr[0] != 0 or (np.diff(self.indptr) < 0).any() or not self.sizes["indices"] == self.sizes["data"] == self.indptr[-1]:
            raise ValueError(f"{path}: not a square shard of {n} variants")
        self.meta = json.loads(bytes(said).decode())
        if self.meta.get("matrix") != "symmetric":
            raise ValueError(f"{path}: not a symmetric shard")

    @staticmethod
    def _header(f) -> tuple:
        version = npy.read_magic(f)
        return npy.read_array_header_1_0(f) if version == (1, 0) else npy.read_array_header_2_0(f)

    def stream(self, name: str, start: int, stop: int, each: int) -> Iterator[np.ndarray]:
        """Entries start to stop of an array, some at a time."""
        return self.pieces(name, [*range(start, stop, each), stop])

    def pieces(self, name: str, cuts: list[int]) -> Iterator[np.ndarray]:
        """Entries of an array from each cut to the next. What lies before is passed over, not kept."""
        width = np.dtype(NPZ_TYPES[name]).itemsize
        with self.zip.open(f"{name}.npy") as f:
            self._header(f)
            skip = cuts[0] * width
            while skip:
                got = len(f.read(min(skip, CHUNK)))
                if not got:
                    raise ValueError(f"{self.path}: {name} ends too soon")
                skip -= got
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                data = f.read(width * (hi - lo))
                if len(data) != width * (hi - lo):
                    raise ValueError(f"{self.path}: {name} ends too soon")
                yield np.frombuffer(data, NPZ_TYPES[name])


_BLOCKS = "chr string, sex string, bi int, bj int, i array<smallint>, j array<smallint>, r array<float>"


class _Columns(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class _NpzReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths, self.entries, self.as_blocks = json.loads(options["paths"]), int(options.get("entries", ENTRIES)), options.get("blocks") == "true"

    def partitions(self) -> list[_Columns]:
        """Ranges of columns of about as many entries each; the driver reads a shard's column starts only."""
        out = []
        for path in self.paths:
            starts = _Shard(path).indptr.astype(np.int64)
            cuts = np.searchsorted(starts, np.arange(0, starts[-1], self.entries), "left")
            cuts = np.unique(np.append(cuts // SIZE * SIZE if self.as_blocks else cuts, [0, len(starts) - 1]))
            out += [_Columns(path, int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return out or [_Columns("", 0, 0)]

    def read(self, partition: _Columns) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        z = _Shard(partition.path)
        if self.as_blocks:
            yield from self._blocks(z, partition.start, partition.stop)
            return
        n, lo, hi = len(z.a1freq), int(z.indptr[partition.start]), int(z.indptr[partition.stop])
        at = lo
        for i, r in zip(z.stream("indices", lo, hi, BATCH), z.stream("data", lo, hi, BATCH), strict=True):
            if i.min() < 0 or i.max() >= n:
                raise ValueError(f"{z.path}: a row is out of bounds")
            j = np.searchsorted(z.indptr, np.arange(at, at + len(i)), "right") - 1
            said = [pa.array([x] * len(i), pa.string()) for x in (z.path, z.meta["chr"], z.meta["sex"])]
            freq = pa.array(z.a1freq[i].astype(np.float64), pa.float64(), mask=i != j)
            yield pa.RecordBatch.from_arrays([*said, pa.array(i.astype(np.int64)), pa.array(j.astype(np.int64)), pa.array(r), freq], ["path", "chr", "sex", "i", "j", "r", "a1freq"])
            at += len(i)

    def _blocks(self, z: _Shard, start: int, stop: int) -> Iterator[pa.RecordBatch]:
        """SIZE columns at a time, a row for each SIZE of their rows."""
        firsts = range(start, stop, SIZE)
        cuts = [int(z.indptr[k]) for k in (*firsts, stop)]
        for first, i, r in zip(firsts, z.pieces("indices", cuts), z.pieces("data", cuts), strict=True):
            if not len(i):
                continue
            if i.min() < 0 or i.max() >= len(z.a1freq):
                raise ValueError(f"{z.path}: a row is out of bounds")
            each = np.diff(z.indptr[first : min(first + SIZE, stop) + 1])
            j = np.repeat(np.arange(len(each), dtype=np.int16), each)
            block = i // SIZE
            order = np.argsort(block, kind="stable")
            starts = np.flatnonzero(np.diff(block[order], prepend=-1))
            offsets = pa.array(np.append(starts, len(i)).astype(np.int32))
            said = [pa.array([x] * len(starts), pa.string()) for x in (z.meta["chr"], z.meta["sex"])]
            places = [pa.array(x, pa.int32()) for x in (block[order][starts], np.full(len(starts), first // SIZE))]
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order])) for x in ((i % SIZE).astype(np.int16), j, r)]
            yield pa.RecordBatch.from_arrays([*said, *places, *lists], ["chr", "sex", *NAMES[1:]])


class NpzShards(DataSource):
    """Entries of compressed-column shards: options paths (JSON), entries, how many a task reads, and blocks (true: a row has those of SIZE by SIZE)."""

    @classmethod
    def name(cls) -> str:
        return "ld_npz"

    def schema(self) -> str:
        return _BLOCKS if self.options.get("blocks") == "true" else "path string, chr string, sex string, i long, j long, r float, a1freq double"

    def reader(self, schema) -> _NpzReader:
        return _NpzReader(self.options)


def read_npz_shards(spark: SparkSession, paths: str | list[str], entries: int = ENTRIES) -> DataFrame:
    """(path, chr, sex, i, j, r, a1freq of i on the diagonal): a shard of any size is read by many tasks, each a range of its columns."""
    spark.dataSource.register(NpzShards)
    return spark.read.format("ld_npz").option("paths", json.dumps([paths] if isinstance(paths, str) else list(paths))).option("entries", entries).load()


def read_npz_blocks(spark: SparkSession, paths: list[str], entries: int = ENTRIES) -> DataFrame:
    """(chr, sex, bi, bj, i, j, r): all entries of shards, diagonal and both triangles, by blocks of SIZE rows and SIZE columns."""
    spark.dataSource.register(NpzShards)
    return spark.read.format("ld_npz").option("paths", json.dumps(paths)).option("entries", entries).option("blocks", "true").load()


def read_npz_frequencies(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(chr, sex, local_idx, a1freq) of shards, one task for each."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                z = _Shard(path)
                n = len(z.a1freq)
                said = [pa.array([x] * n, pa.string()) for x in (z.meta["chr"], z.meta["sex"])]
                yield pa.RecordBatch.from_arrays([*said, pa.array(np.arange(n)), pa.array(z.a1freq)], ["chr", "sex", "local_idx", "a1freq"])

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)), "path").mapInArrow(read, "chr string, sex string, local_idx long, a1freq float")


#: Counts of what a whole matrix must not have, and of its diagonal.
_COUNTS = ("asymmetric", "bad_diagonal", "beyond", "twice", "diagonal")


def fold_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of the upper triangle from those of both and the diagonal, with counts for each: entries without an equal one across the diagonal, diagonal ones
    that are not 1, values beyond 1 (those kept: without tolerance), entries that are given more than once, and diagonal ones.

    A block meets the one across the diagonal, so a task has two at once.
    """
    own = blocks.select("chr", "sex", F.least("bi", "bj").alias("bi"), F.greatest("bi", "bj").alias("bj"), (F.col("bi") > F.col("bj")).alias("turned"), "i", "j", "r")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = None, []

        def close() -> pa.RecordBatch:
            i, j, r = (np.concatenate([x[k] for x in sides]) for k in range(3))
            lower = np.concatenate([np.full(len(x[0]), x[3]) if key[2] < key[3] else x[0] > x[1] for x in sides])
            i, j = np.where(lower, j, i).astype(np.int64), np.where(lower, i, j).astype(np.int64)
            own = (i == j) if key[2] == key[3] else np.zeros(len(i), bool)
            (diagonal, d), (one, x), (two, y) = ((np.unique((i * SIZE + j)[at], return_index=True)) for at in (own, ~own & ~lower, lower))
            d, x, y = r[own][d], r[~own & ~lower][x], r[lower][y]
            _, a, b = np.intersect1d(one, two, assume_unique=True, return_indices=True)
            found = [
                len(one) + len(two) - 2 * len(a) + 2 * (~(np.abs(x[a].astype(np.float64) - y[b]) <= TOLERANCE)).sum(), (~(np.abs(d - 1) <= TOLERANCE)).sum(),
                (~(np.abs(r) <= 1 + TOLERANCE)).sum() + (~(np.abs(x) <= 1)).sum(), len(r) - len(diagonal) - len(one) - len(two), len(diagonal),
            ]
            columns = [pa.array([v], t) for v, t in zip(key, (pa.string(), pa.string(), pa.int32(), pa.int32()), strict=True)]
            columns += [pa.array([v], pa.list_(t)) for v, t in (((one // SIZE).astype(np.int16), pa.int16()), ((one % SIZE).astype(np.int16), pa.int16()), (x, pa.float32()))]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array([int(v)], pa.int64()) for v in found)], ["chr", "sex", *NAMES[1:], *_COUNTS])

        for batch in batches:
            for k, (*now, turned) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("chr", "sex", "bi", "bj", "turned")), strict=True)):
                if now != key:
                    if key is not None:
                        yield close()
                    key, sides = now, []
                sides.append((*(batch.column(c)[k].values.to_numpy() for c in "ijr"), turned))
        if key is not None:
            yield close()

    keys = ["chr", "sex", "bi", "bj"]
    return own.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(fold, ", ".join([_BLOCKS, *(f"{c} long" for c in _COUNTS)]))


def read_npz_metadata(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, md5, metadata as JSON) of shards. Files are read a piece at a time, one task for each."""
    own = [paths] if isinstance(paths, str) else list(paths)

    def said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("path").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([md5_of(p) for p in names], pa.string()), pa.array([json.dumps(_Shard(p).meta) for p in names], pa.string())], ["path", "md5", "metadata"])

    return spark.createDataFrame([(p,) for p in own], "path string").repartition(max(1, len(own)), "path").mapInArrow(said, "path string, md5 string, metadata string")


def check_bundled_bim(spark: SparkSession, root: str, entries: list[dict]) -> None:
    """Raises unless the BIM file beside each shard has its variants. The files are read together."""
    wanted = {e["chr"]: (e["num_snp"], e["reference_checksum"]) for e in entries}
    found = load_reference(spark, sorted({f"{root}/{e['reference_bim']}" for e in entries}))
    own = {r["chr"]: (r["num_snp"], r["checksum"]) for r in found.shards().collect()}
    if bad := [k for k, v in wanted.items() if own.get(k) != v]:
        raise ValueError(f"{root}: the BIM file of shard {bad[0]!r} has other variants")


def validate_distribution(spark: SparkSession, root: str, with_bim: bool = True) -> list[dict]:
    """Entries of the manifest, whose files have the checksums that it says and whose metadata make sense and agree with it.

    with_bim: the BIM files beside the shards are held against them, too.
    """
    entries = read_manifest(spark, root)
    manifest = json.loads(read_small(spark, f"{root}/ld_manifest.json"))
    cache = f"{root}/{manifest['reference_cache']}"
    sums = {r["path"]: r["md5"] for r in _sums(spark, [cache, *(f"{root}/{e['file']}" for e in entries)]).collect()}
    if sums[cache] != manifest["reference_cache_md5"]:
        raise ValueError(f"{root}: {manifest['reference_cache']!r} isn't the file of the manifest")
    for e in entries:
        if sums[f"{root}/{e['file']}"] != e["file_md5"]:
            raise ValueError(f"{root}: {e['file']!r} isn't the file of the manifest")
    said = {r["path"]: json.loads(r["metadata"]) for r in read_npz_metadata(spark, [f"{root}/{e['file']}" for e in entries]).collect()}
    for e in entries:
        meta = said[f"{root}/{e['file']}"]
        check_metadata(meta, e["file"])
        check_agreement(e, meta, e["file"])
    if with_bim:
        check_bundled_bim(spark, root, entries)
    return entries


def _sums(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, md5); a file that isn't there has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                try:
                    found.append(md5_of(path))
                except FileNotFoundError:
                    found.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(found, pa.string())], ["path", "md5"])

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths), "path").mapInArrow(run, "path string, md5 string")


def import_distribution(spark: SparkSession, root: str, reference: ReferencePanel, with_bim: bool = True) -> LDPanel:
    """The shards that the reference has, as a panel; each must have been made for the same variants, be symmetric and have its unit diagonal."""
    entries = [e for e in validate_distribution(spark, root, with_bim) if e["chr"] in reference.labels]
    own = {r["chr"]: r for r in reference.shards().collect()}
    for e in entries:
        if (own[e["chr"]]["num_snp"], own[e["chr"]]["checksum"]) != (e["num_snp"], e["reference_checksum"]):
            raise ValueError(f"{root}: shard {e['chr']!r} is not that of the reference")
    paths = [f"{root}/{e['file']}" for e in entries]
    blocks = stored(fold_blocks(read_npz_blocks(spark, paths)), "npz-blocks")
    found = {(r["chr"], r["sex"]): r for r in blocks.groupBy("chr", "sex").agg(*(F.sum(c).alias(c) for c in _COUNTS)).collect()}
    for e in entries:
        r = found.get((e["chr"], e["sex"]))
        if r and (r["asymmetric"] or r["bad_diagonal"] or r["beyond"]):
            raise ValueError(f"{root}: shard {e['chr']!r} isn't symmetric with a unit diagonal and values within 1")
        if not r or r["diagonal"] != e["num_snp"]:
            raise ValueError(f"{root}: the diagonal of shard {e['chr']!r} has gaps")
        if r["twice"]:
            raise ValueError(f"{root}: a pair of shard {e['chr']!r} is given more than once")
    return panel_from_blocks(reference, blocks.filter(F.size("r") > 0).select(*NAMES, "sex"), read_npz_frequencies(spark, paths), [e["sex"] for e in entries if e["sex"]])


# Writing -----------------------------------------------------------------------------------------------------


class _Taken:
    """A stream whose bytes are taken away as they come."""

    def __init__(self):
        self.parts: list[bytes] = []

    def write(self, data) -> int:
        self.parts.append(bytes(data))
        return len(data)

    def flush(self) -> None:
        pass


class _Archive:
    """An npz file as it is written: what is done of it are chunks, of which none is kept."""

    def __init__(self, name: str):
        self.name, self.out, self.md5, self.part, self.entry = name, _Taken(), hashlib.md5(), 0, None
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_DEFLATED)

    def begin(self, array: str, n: int) -> None:
        if self.entry is not None:
            self.entry.close()
        self.entry = self.zip.open(f"{array}.npy", "w", force_zip64=True)
        npy.write_array_header_1_0(self.entry, {"descr": np.dtype(NPZ_TYPES[array]).str, "fortran_order": False, "shape": (n,)})

    def whole(self, array: str, values: np.ndarray) -> None:
        self.begin(array, len(values))
        self.entry.write(values.astype(NPZ_TYPES[array]).tobytes())

    def chunk(self, least: int = CHUNK) -> Iterator[pa.RecordBatch]:
        if sum(map(len, self.out.parts)) >= least:
            content, self.out.parts = b"".join(self.out.parts), []
            self.md5.update(content)
            yield _made(self.name, self.part, content, None)
            self.part += 1

    def end(self, entry: dict) -> Iterator[pa.RecordBatch]:
        self.entry.close()
        self.zip.close()
        yield from self.chunk(1)
        yield _made(self.name, -1, None, json.dumps(entry | {"file": self.name, "file_md5": self.md5.hexdigest()}))


def _made(name: str, part: int, content: bytes | None, entry: str | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int64()), pa.array([content], pa.binary()), pa.array([entry], pa.string())], ["name", "part", "content", "entry"])


#: Kinds of pieces of a shard, in the order in which they are met: entries of each column, frequencies, values, rows.
_COUNT, _FREQ, _DATA, _ROW = range(4)
_PIECES = "chr string, sex string, kind int, b int, at int, content binary"


def cut_columns(batches: Iterator[pa.RecordBatch], sizes: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """Pieces of shards of these numbers of variants, from blocks in order of (chr, sex, b): those whose columns are block b (other: the block of their rows), and
    frequencies."""
    key: tuple | None = None
    parts: list[tuple] = []
    freqs: list[tuple] = []

    def close() -> Iterator[pa.RecordBatch]:
        n = min(SIZE, sizes[key[0]] - key[2] * SIZE)
        at, f = (np.concatenate([x[k] for x in freqs] or [np.empty(0)]) for k in range(2))
        if len(at) != n or not np.array_equal(np.sort(at), np.arange(n)):
            raise ValueError(f"shard {key[0]!r}: {len(at)} frequencies of {n} variants")
        every = np.arange(n, dtype=np.int32)
        row = np.concatenate([*(p[0] for p in parts), every + key[2] * SIZE])
        column = np.concatenate([*(p[1] for p in parts), every.astype(np.int16)])
        value = np.concatenate([*(p[2] for p in parts), np.ones(n, np.float32)])
        order = np.lexsort((row, column))
        for kind, x in ((_COUNT, np.bincount(column, minlength=n)), (_FREQ, f[np.argsort(at)].astype(np.float32)), (_DATA, value[order]), (_ROW, row[order])):
            content = x.tobytes()
            pieces = [content[lo : lo + CHUNK] for lo in range(0, len(content), CHUNK)]
            same = [pa.array([v] * len(pieces), t) for v, t in zip((*key[:2], kind, key[2]), (pa.string(), pa.string(), pa.int32(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary())], ["chr", "sex", "kind", "b", "at", "content"])

    for batch in batches:
        for k, (*own, other) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("chr", "sex", "b", "other")), strict=True)):
            if own != key:
                if key is not None:
                    yield from close()
                key, parts, freqs = own, [], []
            if other is None:
                e = batch.column("freq")[k].values
                freqs.append((e.field("at").to_numpy(zero_copy_only=False), e.field("f").to_numpy(zero_copy_only=False)))
            else:
                row, column, r = (batch.column(c)[k].values.to_numpy() for c in ("row", "column", "r"))
                parts.append((row.astype(np.int32) + other * SIZE, column, r))
    if key is not None:
        yield from close()


def write_shards(batches: Iterator[pa.RecordBatch], shards: dict[str, tuple[int, str]], name_of_format: str) -> Iterator[pa.RecordBatch]:
    """(name, part, content, entry) of npz files from pieces in order of (chr, sex, kind, b, at), and for each file a last row of part -1 with its entry of the manifest.

    Of a shard only the counts and the frequencies of its columns are kept.
    """
    key: tuple | None = None
    small: list[list[bytes]] = [[], []]
    file: _Archive | None = None
    kind = _COUNT

    def begin() -> None:
        nonlocal file
        if file is None:
            file = _Archive(f"ld_chr{key[0]}{'_' + key[1] if key[1] else ''}.npz")

    def starts() -> tuple[np.ndarray, np.ndarray]:
        return np.append(0, np.cumsum(np.frombuffer(b"".join(small[_COUNT]), np.int64))), np.frombuffer(b"".join(small[_FREQ]), np.float32)

    def close() -> Iterator[pa.RecordBatch]:
        (n, checksum), (indptr, a1freq) = shards[key[0]], starts()
        meta = SAID | {
            "format": name_of_format, "chr": key[0], "sex": key[1], "num_snp": n, "nnz": int(indptr[-1]), "num_monomorphic_snps": int(((a1freq == 0) | (a1freq == 1)).sum()),
            "reference_checksum": checksum, "reference_bim": f"reference_chr{key[0]}.bim",
        }
        for array, values in (("indptr", indptr), ("shape", np.array([n, n])), ("a1freq", a1freq), ("metadata", np.frombuffer(json.dumps(meta).encode(), np.uint8))):
            file.whole(array, values)
        yield from file.end({k: meta[k] for k in AGREEING})

    for batch in batches:
        for *own, now, content in zip(*(batch.column(c).to_pylist() for c in ("chr", "sex", "kind")), batch.column("content"), strict=True):
            if own != key:
                if key is not None:
                    yield from close()
                key, small, file, kind = own, [[], []], None, _COUNT
            if now in (_COUNT, _FREQ):
                small[now].append(content.as_py())
                continue
            begin()
            if now != kind:
                kind, (indptr, a1freq) = now, starts()
                if len(indptr) != shards[key[0]][0] + 1 or len(a1freq) != shards[key[0]][0] or indptr[-1] >= 1 << 31:
                    raise ValueError(f"shard {key[0]!r}: {indptr[-1]} values and {len(a1freq)} frequencies of {shards[key[0]][0]} variants")
                file.begin("data" if kind == _DATA else "indices", int(indptr[-1]))
            file.entry.write(content.as_buffer())
            yield from file.chunk()
    if key is not None:
        yield from close()


def export_distribution(panel: LDPanel, root: str, name_of_format: str = FORMAT) -> None:
    """A compressed-column npz file for each shard and sex, BIM files, the reference and, when all these are there, the manifest.

    Columns are put in order by blocks, many tasks for each shard; its file of at most 2 ** 31 entries is one stream that one task compresses.
    """
    spark = panel.blocks.sparkSession
    shards = {r["chr"]: (r["num_snp"], r["checksum"]) for r in panel.reference.shards().collect()}
    sizes = {k: n for k, (n, _) in shards.items()}
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    way = lambda b, other, row, column: F.struct(F.col(b).alias("b"), F.col(other).alias("other"), F.col(row).alias("row"), F.col(column).alias("column"))
    sent = panel.blocks.select("chr", "sex", F.explode(F.array(way("bj", "bi", "i", "j"), way("bi", "bj", "j", "i"))).alias("way"), "r").select("chr", "sex", "way.*", "r", none("freq", "array<struct<at:int,f:float>>"))
    freq = panel.freq.select("chr", "sex", F.floor(F.col("local_idx") / SIZE).cast("int").alias("b"), F.struct((F.col("local_idx") % SIZE).cast("int").alias("at"), F.col("a1freq").cast("float").alias("f")).alias("e"))
    lists = {"row": "array<smallint>", "column": "array<smallint>", "r": "array<float>"}
    freq = freq.groupBy("chr", "sex", "b").agg(F.collect_list("e").alias("freq")).select("chr", "sex", "b", none("other", "int"), *(none(c, t) for c, t in lists.items()), "freq")
    by = ["chr", "sex", "b"]
    pieces = sent.unionByName(freq).repartition(*by).sortWithinPartitions(*by).mapInArrow(lambda batches: cut_columns(batches, sizes), _PIECES)
    ordered = pieces.repartition("chr", "sex").sortWithinPartitions("chr", "sex", "kind", "b", "at")
    made = ordered.mapInArrow(lambda batches: write_shards(batches, shards, name_of_format), "name string, part long, content binary, entry string")
    made = stored(made, "npz-files")  # so that checksums are those of what is written
    entries = [json.loads(r["entry"]) for r in made.filter("part < 0").select("entry").collect()]
    write_files(made.filter("part >= 0"), root)
    for label in panel.reference.labels:
        write_bim(panel.reference.variants.filter(F.col("chr") == label), f"{root}/reference_chr{label}.bim")
    cache = "reference.tsv"  # the axis as one file, a chunk for each block of variants
    line = F.concat_ws("\t", "chr", "local_idx", "snp", "bp", "a1", "a2")
    place = F.array_position(F.array(*(F.lit(c) for c in CONTIGS)), F.col("chr")) * F.lit(1 << 40) + F.floor(F.col("local_idx") / 65536)
    text = panel.reference.variants.groupBy(place.alias("part")).agg(F.sort_array(F.collect_list(F.struct("local_idx", line.alias("line")))).alias("lines"))
    write_files(text.select(F.lit(cache).alias("name"), "part", F.concat(F.array_join("lines.line", "\n"), F.lit("\n")).cast("binary").alias("content")), root)
    manifest = MANIFEST | {"reference_cache": cache, "reference_cache_md5": md5_of(f"{root}/{cache}"), "shards": in_order(entries)}
    write_file(f"{root}/ld_manifest.json", json.dumps(manifest, indent=1).encode())
