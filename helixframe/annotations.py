"""Annotation panels: sparse columns over the variant axis, kept as long rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.contigs import check_request
from helixframe.operators.intervals import overlapping, paint_groups, paint_values
from helixframe.reference import ReferencePanel, check_stored, generated_metadata, save_shards
from helixframe.sources.annotations import read_column_sidecar, read_interval_files, read_intervals, read_sidecar, typed_intervals
from helixframe.tables import numbered, path_exists, stored


@dataclass(frozen=True)
class Column:
    name: str
    is_binary: bool
    metadata: str = ""


@dataclass(frozen=True)
class AnnotationPanel:
    """values: chr, local_idx, anno_id, value (never 0). table: anno_id (from 0), name, is_binary, metadata: a row for each column, as many as there may be."""

    reference: ReferencePanel
    values: DataFrame
    table: DataFrame

    @property
    def columns(self) -> tuple[Column, ...]:
        """The columns in order, brought to the driver."""
        return tuple(Column(r["name"], r["is_binary"], r["metadata"]) for r in self.table.orderBy("anno_id").collect())

    @property
    def names(self) -> list[str]:
        return [r["name"] for r in self.table.orderBy("anno_id").select("name").collect()]

    def summary(self) -> str:
        size = sum(n for _, n, _ in self.reference.described_shards)
        return f"<AnnotationPanel: {size} variants x {self.table.count()} annotations across {len(self.reference.labels)} shard(s): {', '.join(self.reference.labels)}>"

    def select_shards(self, labels: Sequence[str]) -> AnnotationPanel:
        wanted = check_request(labels, self.reference.labels, "AnnotationPanel.select_shards")
        return AnnotationPanel(self.reference.select_shards(wanted), self.values.filter(F.col("chr").isin(wanted)), self.table)

    def select_annotations(self, names: Sequence[str]) -> AnnotationPanel:
        """Columns by name, in the order given."""
        wanted = [names] if isinstance(names, str) else list(names)
        if not wanted or len(set(wanted)) != len(wanted):
            raise ValueError("annotation names must be given, each once")
        asked = self.table.sparkSession.createDataFrame([(n, i) for i, n in enumerate(wanted)], "name string, place int")
        found = asked.join(self.table, "name", "left")
        if unknown := [r["name"] for r in found.filter("anno_id IS NULL").orderBy("place").collect()]:
            raise ValueError(f"unknown annotations: {', '.join(unknown)}")
        table = found.select(F.col("place").alias("anno_id"), "name", "is_binary", "metadata")
        return AnnotationPanel(self.reference, renumbered(self.values, found.select("anno_id", "place")), table)

    def union_annotations(self, other: AnnotationPanel) -> AnnotationPanel:
        """The columns of both; shards must be the same, with checksums, and names must differ."""
        if both := sorted(r["name"] for r in self.table.join(other.table, "name", "left_semi").orderBy("name").limit(10).collect()):
            raise ValueError(f"annotations in both panels: {', '.join(both)}")
        self.reference.check_compatible(other.reference.shards(), "union_annotations")
        shift = self.table.count()
        return AnnotationPanel(self.reference, append_columns(self.values, other.values, shift), append_columns(self.table, other.table, shift))

    def named(self) -> DataFrame:
        """values with names, as a matrix for LD-weighted sums."""
        return self.values.join(self.table.select("anno_id", "name"), "anno_id").select("chr", "local_idx", "name", "value")

    def save(self, path: str) -> None:
        self.values.write.partitionBy("chr").parquet(f"{path}/values")
        self.table.write.parquet(f"{path}/columns")
        save_shards(self.reference, path)


def renumbered(values: DataFrame, places: DataFrame) -> DataFrame:
    """values of the columns that places (anno_id, place) has, with these places. Spark broadcasts places where they are few."""
    return values.join(places, "anno_id").withColumn("anno_id", F.col("place").cast("int")).drop("place").select(*values.columns)


def select_columns(values: DataFrame, ids: Sequence[int]) -> DataFrame:
    """values of these columns, which get the numbers from 0 in this order."""
    places = values.sparkSession.createDataFrame([(int(old), new) for new, old in enumerate(ids)], "anno_id int, place int")
    return renumbered(values, places)


def append_columns(one: DataFrame, two: DataFrame, shift: int) -> DataFrame:
    return one.unionByName(two.withColumn("anno_id", (F.col("anno_id") + shift).cast("int")))


def infer_binary(values: DataFrame) -> DataFrame:
    """(anno_id, is_binary): whether all stored values are 1. A column without values has no row, and is binary."""
    return values.groupBy("anno_id").agg(F.bool_and(F.col("value") == 1).alias("is_binary"))


def create_annotations(reference: ReferencePanel, values: DataFrame, names: Sequence[str], is_binary: Sequence[bool] | None = None, metadata: Sequence[str] | None = None) -> AnnotationPanel:
    """values: chr, local_idx, anno_id, value; explicit zeros go. Without is_binary it is inferred, else held against the values."""
    if not names or "" in names or len(set(names)) != len(names):
        raise ValueError("annotation names must be unique and not empty")
    if any(x is not None and len(x) != len(names) for x in (is_binary, metadata)):
        raise ValueError("is_binary and metadata must be as long as names")
    own = values.select("chr", "local_idx", F.col("anno_id").cast("int").alias("anno_id"), F.col("value").cast("double").alias("value"))
    bad = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    off = ~F.col("anno_id").between(0, len(names) - 1)
    found = own.agg(F.count_if(bad).alias("v"), F.count_if(off).alias("o")).first()
    if found["v"] or found["o"]:
        raise ValueError(f"{found['v']} values are not finite; {found['o']} rows are of no column")
    own = own.filter("value <> 0")
    binary = [True] * len(names)
    for r in infer_binary(own).collect():  # a row for each column
        binary[r["anno_id"]] = r["is_binary"]
    if is_binary is not None and any(declared and not seen for declared, seen in zip(is_binary, binary, strict=True)):
        raise ValueError("a column that is declared binary has other values than 1")
    kinds = binary if is_binary is None else [bool(b) for b in is_binary]
    rows = [(i, n, b, m) for i, (n, b, m) in enumerate(zip(names, kinds, metadata or [""] * len(names), strict=True))]
    return AnnotationPanel(reference, own, values.sparkSession.createDataFrame(rows, COLUMNS))


#: Columns of a panel's table.
COLUMNS = "anno_id int, name string, is_binary boolean, metadata string"


def create_annotation(reference: ReferencePanel, values: DataFrame, name: str, is_binary: bool | None = None, metadata: str = "") -> AnnotationPanel:
    """One column from values: snp_idx, value; variants without a row are 0. Each row is of a variant of the axis, each once."""
    own = values.join(reference.indexed().select("snp_idx", "chr", "local_idx"), "snp_idx", "left")
    found = own.agg(F.count_if(F.col("chr").isNull()).alias("rows off the axis"), (F.count(F.lit(1)) - F.count_distinct("snp_idx") - F.count_if(F.col("snp_idx").isNull())).alias("repeated rows")).first()
    for what, n in found.asDict().items():
        if n:
            raise ValueError(f"create_annotation: {n} {what}")
    return create_annotations(reference, own.withColumn("anno_id", F.lit(0)), [name], None if is_binary is None else [is_binary], [metadata])


def _stem(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[0] if "." in name else name


def _painted(reference: ReferencePanel, typed: DataFrame) -> DataFrame:
    """Values of binary columns from intervals with anno_id: intervals of one column are united, then all are painted together."""
    found = paint_groups(reference.variants, typed, "anno_id")
    return stored(found.select("chr", "local_idx", F.col("anno_id").cast("int").alias("anno_id"), F.lit(1.0).alias("value")), "annotations")


def load_annotations(spark: SparkSession, paths: Sequence[str], reference: ReferencePanel, metadata: Sequence[str] | None = None, metadata_paths: Sequence[str] | None = None) -> AnnotationPanel:
    """A binary column for each BED file, named after it; columns beyond the third are ignored. All files are read and painted together."""
    names = [_stem(p) for p in paths]
    if not names or "" in names:
        raise ValueError("annotation files must be given, and have names")
    if len(set(names)) != len(names):
        raise ValueError("two files have the same name")
    if metadata is not None and metadata_paths is not None:
        raise ValueError("metadata is given twice")
    if any(x is not None and len(x) != len(names) for x in (metadata, metadata_paths)):
        raise ValueError("metadata must be as many as files")
    rows = read_interval_files(spark, list(paths))
    typed = typed_intervals(rows, "annotations", [f"{p}: " for p in paths])
    texts = list(metadata) if metadata is not None else [read_sidecar(spark, p) for p in metadata_paths] if metadata_paths is not None else None
    if texts is None:
        sizes = {r["anno_id"]: r["count"] for r in rows.groupBy("anno_id").count().collect()}  # a row for each file
        texts = [generated_metadata(p, False, sizes[i]) for i, p in enumerate(paths)]
    table = spark.createDataFrame([(i, n, True, t) for i, (n, t) in enumerate(zip(names, texts, strict=True))], COLUMNS)
    return AnnotationPanel(reference, _painted(reference, typed), table)


def group_columns(rows: DataFrame, group: str) -> DataFrame:
    """(group, anno_id, n): a column for each group, numbered by its first row (row0), with how many rows it has."""
    sizes = rows.groupBy(F.col(group).alias("group")).agg(F.min("row0").alias("first"), F.count(F.lit(1)).alias("n"))
    return numbered(sizes, ["first"], "anno_id").select("group", F.col("anno_id").cast("int").alias("anno_id"), "n")


def _selected(selector, header: list[str] | None, columns: int, path: str, what: str) -> int:
    if isinstance(selector, str):
        if header is None:
            raise ValueError(f"{what} by name wants a header")
        if selector not in header:
            raise ValueError(f"{path}: no column {selector!r}")
        at = header.index(selector)
    elif isinstance(selector, int) and not isinstance(selector, bool):
        at = selector
    else:
        raise ValueError(f"{what} must be names or numbers")
    if not 3 <= at < columns:
        raise ValueError(f"{path}: {what} {selector!r} must be the fourth column or a later one")
    return at


def load_annotation(
    spark: SparkSession, path: str, reference: ReferencePanel, has_header: bool = False, value_columns=None, group_column=None,
    annotation_names: Sequence[str] | None = None, metadata: Sequence[str] | None = None, metadata_path: str | None = None,
) -> AnnotationPanel:
    """One table: binary (three columns), binary by group (group_column), or numeric (the fourth column or value_columns)."""
    if metadata is not None and metadata_path is not None:
        raise ValueError("metadata is given twice")
    if group_column is not None and any(x is not None for x in (value_columns, annotation_names, metadata, metadata_path)):
        raise ValueError("group_column goes with neither value_columns, names nor metadata")
    rows, header, n = read_intervals(spark, path, has_header)
    rows = stored(rows, "intervals")
    about = {"has_header": has_header, "num_source_intervals": rows.count()}
    if group_column is not None:
        at = _selected(group_column, header, n, path, "group_column")
        groups = stored(group_columns(rows, f"c{at}"), "groups")
        if not groups.filter(F.col("group") == "").isEmpty():
            raise ValueError(f"{path}: groups must not be empty")
        typed = typed_intervals(rows, path).join(groups.select(F.col("group").alias(f"c{at}"), "anno_id"), f"c{at}")

        @F.pandas_udf("string")
        def about_group(name: pd.Series, size: pd.Series) -> pd.Series:
            return pd.Series([generated_metadata(path, has_header, int(k), group_column=group_column, group_value=g) for g, k in zip(name, size, strict=True)], dtype=object)

        table = stored(groups.select("anno_id", F.col("group").alias("name"), F.lit(True).alias("is_binary"), about_group("group", "n").alias("metadata")), "columns")
        return AnnotationPanel(reference, _painted(reference, typed), table)
    typed = typed_intervals(rows, path)
    if value_columns is None and n == 3:
        names = list(annotation_names or [_stem(path)])
        text = read_sidecar(spark, metadata_path) if metadata_path else metadata[0] if metadata else generated_metadata(path, **about)
        if len(names) != 1:
            raise ValueError("annotation_names must be as many as columns")
        return AnnotationPanel(reference, _painted(reference, typed.withColumn("anno_id", F.lit(0))), spark.createDataFrame([(0, names[0], True, text)], COLUMNS))
    if value_columns is None and n > 4:
        raise ValueError(f"{path}: with five or more columns, value_columns or group_column must be given")
    chosen = [3] if value_columns is None else [value_columns] if isinstance(value_columns, (str, int)) else list(value_columns)
    at = [_selected(c, header, n, path, "value_columns") for c in chosen]
    if not at or len(set(at)) != len(at):
        raise ValueError("value_columns must be given, each once")
    if annotation_names is None and header is None and n >= 5:
        raise ValueError(f"{path}: without a header, five or more columns want annotation_names")
    names = list(annotation_names) if annotation_names is not None else [header[a] for a in at] if header else [_stem(path)]
    if len(names) != len(at):
        raise ValueError("annotation_names must be as many as value columns")
    if bad := overlapping(typed).orderBy("row0").limit(1).collect():
        raise ValueError(f"{path}: row {bad[0]['row0'] + 1}: intervals overlap on contig {bad[0]['chr']}")
    numbers = typed.select("chr", "start0", "end0", *(F.col(f"c{a}").try_cast("double").alias(str(i)) for i, a in enumerate(at)))
    if numbers.filter(F.greatest(*(F.col(str(i)).isNull() | (~(F.abs(F.col(str(i))) < float("inf"))) for i in range(len(at))), F.lit(False))).limit(1).collect():
        raise ValueError(f"{path}: values must be finite numbers")
    painted = paint_values(reference.variants.select("chr", "local_idx", "bp"), numbers, [str(i) for i in range(len(at))])
    values = painted.select("chr", "local_idx", F.col("name").cast("int").alias("anno_id"), "value")
    sidecar = read_column_sidecar(spark, metadata_path, n) if metadata_path else None
    texts = [sidecar[a] for a in at] if sidecar else list(metadata) if metadata else [generated_metadata(path, value_column=c, **about) for c in (chosen if header or value_columns is not None else at)]
    return create_annotations(reference, values, names, [False] * len(at), texts)


def load_annotations_cache(spark: SparkSession, path: str, reference: ReferencePanel, shards: Sequence[str] | None = None) -> AnnotationPanel:
    """reference: the panel of all shards that were saved; its shards must be those that the cache says.

    A cache without is_binary and metadata (an older layout) is read as binary with empty metadata, one without shards is not held against the reference.
    """
    if path_exists(spark, f"{path}/shards"):
        check_stored(spark, path, reference)
    values = spark.read.parquet(f"{path}/values").select(F.col("chr").cast("string").alias("chr"), "local_idx", "anno_id", "value")
    table = spark.read.parquet(f"{path}/columns")
    for name, kind, default in (("is_binary", "boolean", True), ("metadata", "string", "")):
        if name not in table.columns:
            table = table.withColumn(name, F.lit(default).cast(kind))
    found = AnnotationPanel(reference, values, table.select("anno_id", "name", "is_binary", "metadata"))
    return found if shards is None else found.select_shards(shards)
