"""Exact deduplication as a stateful stream (native: DataFrame functions only).

A row counts as its text without the characters of ``[\\x20\\x09-\\x0D]``. Rows are appended to a content table, and
their digests are streamed through one keyed aggregation whose state is kept on disk (RocksDB) and never expires; for
each digest it retains the row that stays, its content locator (file and row of the content table) and the number of
rows. More rows may be added at any time. Where a digest was met more than once, the full normalised texts are read
from the files that the locators name and compared, so that two texts which only share a digest stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import drop_ids, fresh_path, join_groups, keep_ids, stored, table

WHITE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How state is kept: on disk; a batch adds a log of changes instead of whole tables, and logs take no disk before they are written.
#: All stores of an executor share a bounded memory, and those of a query that has ended are soon closed.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKS,
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
}


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _digest(norm: Column, digest_hex: int) -> Column:
    return F.unhex(F.rpad(F.substring(F.sha2(norm, 256), 1, digest_hex), digest_hex + digest_hex % 2, "0"))


_ID, _TEXT = "doc.doc_id", "doc.text"
_PLACE = "struct(_metadata.file_path AS file, _metadata.row_index AS row) AS place"


class DedupState:
    """State of all rows that were ever added, in one folder that driver and executors share.

    add() appends rows to the content table and streams them into the state; another object of the same folder goes
    on where the last one ended. result() says of every row so far which row stays.
    """

    def __init__(self, spark: SparkSession, path: str, digest_hex: int = 64, micro_batches: int = 2):
        self.spark, self.path, self.digest_hex, self.micro_batches = spark, path, digest_hex, micro_batches

    def add(self, docs: DataFrame) -> None:
        """docs: doc_id, text and more columns, the same at each call."""
        text = F.coalesce("doc.text", F.lit(""))
        content = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")).select(
            "doc", _digest(normalised(F.col(_TEXT)), self.digest_hex).alias("digest"), F.char_length(text).alias("n"), F.bitwise_not(_ID).alias("inv")
        )
        content.write.mode("append").parquet(f"{self.path}/content")
        self._stream(len(content.sparkSession.read.parquet(f"{self.path}/content").inputFiles()))

    def _stream(self, files: int) -> None:
        """Every micro-batch updates the state of the digests it holds and appends their new value to a table; the value of the last batch counts."""
        spark = self.spark
        source = spark.readStream.schema("digest binary, n int, inv bigint").option("maxFilesPerTrigger", max(1, -(-files // self.micro_batches)))
        grouped = (
            source.parquet(f"{self.path}/content").selectExpr("digest", "n", "inv", _PLACE)
            .groupBy("digest")
            .agg(F.max(F.struct("n", "inv", "place")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        )

        def append(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{self.path}/state")

        before = {k: spark.conf.get(k, None) for k in STATE}
        for k, v in STATE.items():
            spark.conf.set(k, v)
        try:
            query = grouped.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
        finally:
            for k, v in before.items():
                spark.conf.set(k, v) if v else spark.conf.unset(k)

    def content(self) -> DataFrame:
        """doc, digest, n, inv, place of all rows."""
        return self.spark.read.parquet(f"{self.path}/content").selectExpr("*", _PLACE)

    def groups(self) -> DataFrame:
        """digest, keep, group_size."""
        changes = self.spark.read.parquet(f"{self.path}/state").groupBy("digest")
        return changes.agg(F.max_by(F.struct("keep", "group_size"), "batch").alias("last")).select("digest", "last.keep", "last.group_size")

    def _clashes(self, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Groups (digest, norm, keep, group_size) of the rows whose digest was met more than once, and the digests of unequal texts.

        Only files that have such a row are read: their names reach the driver, as in Spark's own listing.
        """
        names = keep_ids(self.content().select("digest", "place.file"), hits, "digest").select("file").distinct()
        files = [r["file"] for r in names.collect()]
        met = self.spark.read.parquet(*files) if files else self.content().limit(0)
        met = keep_ids(met.selectExpr("*", _PLACE) if files else met, hits, "digest")
        same = met.groupBy("digest", normalised(F.col(_TEXT)).alias("norm")).agg(F.max(F.struct("n", "inv", "place")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        several = same.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
        return same, stored(several.select("digest"), "dedup-clash")

    def result(self) -> DataFrame:
        """doc, digest, keep_id, group_size, kept, row_kept: one row per row.

        kept holds for all rows that repeat the id and text of the row that stays, row_kept only for that one row.
        """
        groups = stored(self.groups(), "dedup-groups")
        same, clash = self._clashes(stored(groups.filter("group_size > 1").select("digest"), "dedup-hits"))
        rows = self.content()
        clashes = not clash.isEmpty()
        out = join_groups(drop_ids(rows, clash, "digest") if clashes else rows, groups, "digest", "group_size")
        if clashes:  # texts that only share a digest: groups of full texts
            apart = keep_ids(rows, clash, "digest").withColumn("norm", normalised(F.col(_TEXT)))
            out = out.unionByName(apart.join(keep_ids(same, clash, "digest"), ["digest", "norm"]).drop("norm"))
        keep_id = F.bitwise_not("keep.inv")
        return out.select("doc", "digest", keep_id.alias("keep_id"), "group_size", F.col(_ID).eqNullSafe(keep_id).alias("kept"), (F.col("place") == F.col("keep.place")).alias("row_kept"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_hex: int = 64, micro_batches: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, digest.

    Of equal texts the one with the most code points stays, then the smallest id. Null texts count as empty
    and are equal to each other and to blank texts. An id that is null never wins over another; rows that
    repeat an id and a text are one document, so `kept` holds for each of them. An empty table gives no rows. Very long
    texts are rows like others. Only id_col (an integer) and text_col are read, so other columns of any name do no harm.
    digest_hex (hex digits kept of SHA-256) is for tests: with short digests, unequal texts collide and the comparison of
    full texts has to part them.
    """
    spark = docs.sparkSession
    state = DedupState(spark, fresh_path(spark, "dedup"), digest_hex, micro_batches)
    state.add(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    digest = F.substring(F.lower(F.hex("digest")), 1, digest_hex)
    return state.result().select(F.col(_ID).alias("doc_id"), "keep_id", "group_size", "kept", digest.alias("digest"))


def keep_one_each(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and more) without copies: of equal texts one row stays, as exact_dedup says, even where ids are null or repeat."""
    spark = docs.sparkSession
    state = DedupState(spark, fresh_path(spark, "dedup"))
    state.add(docs)
    return state.result().filter("row_kept").select("doc.*")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("digest", "text_sha256")


OP3_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY k ORDER BY len DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY k) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY k ORDER BY len DESC, doc_id) AS kept,
       sha256(k) AS text_sha256
FROM n
"""
