"""Interval tables: tab-separated, from 0, half-open."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.contigs import CONTIGS, IGNORED, is_styled
from helixframe.sources.text import fields, numbered_lines
from helixframe.tables import check_rows, stored


def read_intervals(spark: SparkSession, path: str, has_header: bool = False) -> tuple[DataFrame, list[str] | None, int]:
    """(row0, c0, c1, …; header names or None; number of columns). Lines that are blank or start with # are skipped."""
    lines = _rows_of(numbered_lines(spark, path))
    head = lines.orderBy("row0").limit(1).collect()
    if not head:
        raise ValueError(f"{path}: no rows")
    names = head[0]["value"].split("\t")
    if has_header:
        if len(set(names)) != len(names) or "" in names:
            raise ValueError(f"{path}: column names must be unique and not empty")
        lines = lines.filter(F.col("row0") > head[0]["row0"])
    rows = fields(lines, [f"c{i}" for i in range(len(names))], "\t")
    check_rows(rows, [(f"expected {len(names)} columns", F.col("n_fields") != len(names))], path)
    if len(names) < 3:
        raise ValueError(f"{path}: expected at least 3 columns")
    return rows.drop("path", "n_fields"), names if has_header else None, len(names)


def _rows_of(lines: DataFrame) -> DataFrame:
    return lines.filter((F.trim("value") != "") & ~F.startswith(F.col("value"), F.lit("#")))


def read_interval_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(anno_id, row0, c0, c1, c2): the first three columns of many files, read together; anno_id is a file's place in paths.

    Every row of a file has as many columns as its first one, three at least. The driver sees one row for each file.
    """
    qualified = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    full = [qualified(p).getFileSystem(conf).makeQualified(qualified(p)).toString() for p in paths]
    lines = fields(_rows_of(numbered_lines(spark, full)), ["c0", "c1", "c2"], "\t")
    lines = stored(lines, "intervals")
    found = lines.groupBy("path").agg(F.min_by("n_fields", "row0").alias("columns")).collect()
    place = {_plain(p): i for i, p in enumerate(full)}
    heads = {place[_plain(r["path"])]: (r["path"], r["columns"]) for r in found}
    for i, path in enumerate(paths):
        if i not in heads:
            raise ValueError(f"{path}: no rows")
        if heads[i][1] < 3:
            raise ValueError(f"{path}: expected at least 3 columns")
    numbers = spark.createDataFrame([(p, i, n) for i, (p, n) in heads.items()], "path string, anno_id int, columns int")
    rows = lines.join(F.broadcast(numbers), "path")
    for bad in rows.filter("n_fields <> columns").orderBy("anno_id", "row0").limit(1).collect():
        raise ValueError(f"{paths[bad['anno_id']]}: row {bad['row0'] + 1}: expected {bad['columns']} columns")
    return rows.select("anno_id", "row0", "c0", "c1", "c2")


def _plain(path: str) -> str:
    """A path as it is compared: without escapes, and with one way to write a local one."""
    return re.sub("^file:/+", "file:/", unquote(path)).rstrip("/")


def typed_intervals(rows: DataFrame, where: str, files: list[str] | None = None) -> DataFrame:
    """rows with chr, start0 and end0 from their first three columns; rows of ignored contigs are checked, then dropped.

    files: names for messages, where rows are of several files (anno_id).
    """
    c, start, end = F.col("c0"), F.col("c1").try_cast("double"), F.col("c2").try_cast("double")
    whole = lambda x: x.isNull() | (F.floor(x) != x) | (x < 0)
    rules = [
        ("contig must not be empty", c == ""), ("labels such as chr1 are not allowed", is_styled(c)), ("unknown contig", ~c.isin(*CONTIGS, *IGNORED)),
        ("start must be a non-negative integer", whole(start)), ("end must be a non-negative integer", whole(end)), ("end must not be before start", end < start),
    ]
    if files is None:
        check_rows(rows, rules, where)
    else:
        broken = F.coalesce(*(F.when(bad, what) for what, bad in rules))
        for r in rows.withColumn("what", broken).filter("what IS NOT NULL").orderBy("anno_id", "row0").limit(1).collect():
            raise ValueError(f"{files[r['anno_id']]}row {r['row0'] + 1}: {r['what']}")
    return rows.filter(~c.isin(*IGNORED)).withColumns({"chr": c, "start0": start.cast("long"), "end0": end.cast("long")}).drop("c0", "c1", "c2")


def read_sidecar(spark: SparkSession, path: str) -> str:
    """A whole file as one string."""
    return spark.read.text(path, wholetext=True).first()[0]


def read_column_sidecar(spark: SparkSession, path: str, columns: int) -> list[str]:
    """A non-empty line for each physical column."""
    lines = read_sidecar(spark, path).splitlines()
    if len(lines) != columns or "" in lines:
        raise ValueError(f"{path}: expected {columns} lines that are not empty")
    return lines
