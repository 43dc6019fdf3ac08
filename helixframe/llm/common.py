"""Helpers that the training-data operators share: tables, shared folders, size-checked joins, Arrow slices."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most so many bytes of keys are broadcast by `keep_ids`/`drop_ids`; beyond it both sides are shuffled.
BROADCAST_BYTES = 16 << 20
#: What a key takes in a broadcast table, by type.
KEY_BYTES = {"bigint": 40, "int": 40, "binary": 96}
#: The largest groups that `join_groups` broadcasts: any other key has at most one in so many of all rows.
HOT_GROUPS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a temporary one on a single machine (tests); a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="helixframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: the rows as a table in the shared folder. An executor that is lost takes nothing with it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a `stored` table that no later step reads."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def is_small(ids: DataFrame, row_bytes: int | None = None) -> bool:
    """Whether the rows may be broadcast: of one key column, or of row_bytes each."""
    rows = BROADCAST_BYTES // (row_bytes or KEY_BYTES.get(ids.dtypes[0][1], 256))
    return ids.limit(rows + 1).count() <= rows


def keep_ids(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of docs whose key is in ids (one column of unique keys, stored): without a shuffle of docs while ids are few."""
    return docs.join(F.broadcast(ids) if is_small(ids) else ids, key, "left_semi")


def drop_ids(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of docs whose key isn't in ids; a null key stays."""
    return docs.join(F.broadcast(ids) if is_small(ids) else ids, key, "left_anti")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """rows with the columns of their group. groups (stored) has one row for each key, with its number of rows in `size`.

    The largest groups are broadcast, so that no key with many rows is dealt to one task; the others are shuffled.
    """
    largest = groups.orderBy(F.desc(size), key).limit(HOT_GROUPS)
    hot = stored(largest.filter(F.col(size) > HOT_GROUPS), "hot-groups")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups, key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows with whole texts are large: fewer of them go to a Python worker at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def sliced(batch: pa.RecordBatch, column: str = "text", max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have at most max_bytes (a longer text comes alone)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for row, size in enumerate(sizes):
        if total + size > max_bytes and row > start:
            yield batch.slice(start, row - start)
            start, total = row, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what Arrow has freed goes back to the system between them, as workers share an executor's memory."""
    for batch in batches:
        yield batch
        pa.default_memory_pool().release_unused()


_CACHES: dict[str, list | dict] = {}


def own_cache(owner: str, cache: list | dict) -> list | dict:
    """A cache that tasks of one worker share; `only` clears it when the worker turns to another operator."""
    _CACHES[owner] = cache
    return cache


def only(*owners: str) -> None:
    """A worker keeps the caches of these owners and lets go of others, as workers share an executor's memory."""
    for owner, cache in _CACHES.items():
        if owner not in owners:
            cache.clear()


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts as Python strings; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and where each starts (one more than texts); null counts as empty."""
    texts = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]
