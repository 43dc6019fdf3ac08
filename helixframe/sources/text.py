"""Text sources whose rows keep their place in the file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, row0, value): every line with its number from 0 within its file.

    A folder of part files, as Spark writes it, is one file: its parts follow each other by name. Lines are counted by
    block of the file, and the blocks before a block give its first number, so no file has to pass through one task.
    """
    lines = spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place")
    )
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")).withColumn("path", F.regexp_replace("file", "/part-[^/]*$", ""))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    starts = blocks.select("path", "file", "block", "first", before.alias("before"))
    return lines.join(starts, ["file", "block"]).select("path", (F.col("before") + F.col("place") - F.col("first")).alias("row0"), "value")


def first_line(spark: SparkSession, path: str) -> str | None:
    """The first line of a file or folder of part files; None without any."""
    for file in sorted(spark.read.text(path).inputFiles()):
        if found := spark.read.text(file).head(1):
            return found[0][0]
    return None


def write_lines(lines: DataFrame, order: list, path: str, header: str | None = None) -> None:
    """One column of strings as a folder of part files whose names follow the order; a header is the first part."""
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = lines.repartitionByRange(n, *order).sortWithinPartitions(*order).select("value")
    if header is not None:
        own = lines.sparkSession.createDataFrame([(header,)], "value string").coalesce(1).union(own)
    own.write.text(path)


def fields(lines: DataFrame, names: list[str], pattern: str = r"\s+") -> DataFrame:
    """path, row0, n_fields and the first fields as strings (null where there are fewer)."""
    parts = F.split(F.trim("value") if pattern == r"\s+" else F.col("value"), pattern)
    return lines.select("path", "row0", F.size(parts).alias("n_fields"), *(F.get(parts, i).alias(n) for i, n in enumerate(names)))
