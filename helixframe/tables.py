"""Tables that cut lineage, and checks that find the first bad row."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Row groups are small, as rows may hold long arrays: readers take up to 4,096 rows of one group at once, arrays and all.
SMALL_GROUPS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "10"}


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
    """The rows as a table in the shared folder; it survives the loss of executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.options(**SMALL_GROUPS).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a `stored` table."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """df with `name`: numbers from 0 in this order. Rows are dealt by ranges of the order, and what ranges before have gives a range's first number."""
    own = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    own = stored(own.withColumn("_range", F.shiftright("_place", 33)), "numbered")
    sizes = own.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")  # a row for each range
    starts = sizes.select("_range", "_first", before.alias("_before"))
    return own.join(F.broadcast(starts), "_range").withColumn(name, F.col("_before") + F.col("_place") - F.col("_first")).drop("_range", "_place", "_first", "_before")


def check_rows(df: DataFrame, rules: Sequence[tuple[str, Column]], where: str, row: str = "row0") -> None:
    """Raises for the first rule, in order, that a row breaks, naming its first bad row. One pass for all rules."""
    if not rules:
        return
    found = df.agg(*(F.min(F.when(bad, F.col(row))).alias(f"r{i}") for i, (_, bad) in enumerate(rules))).first()
    for i, (what, _) in enumerate(rules):
        if found[i] is not None:
            raise ValueError(f"{where}: row {found[i] + 1}: {what}")


def check_unique(df: DataFrame, keys: Sequence[str], where: str) -> None:
    twice = df.groupBy(*keys).count().filter("count > 1").orderBy(*keys).limit(1).collect()
    if twice:
        raise ValueError(f"{where}: more than one row for " + ", ".join(f"{k}={twice[0][k]}" for k in keys))
