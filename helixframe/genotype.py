"""Genotype panels: where the calls of each variant lie, and fetching of calls on request."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.contigs import check_request
from helixframe.operators.align import align, check_keys, swapped_counts
from helixframe.reference import ReferencePanel, check_stored, save_shards
from helixframe.sources.plink import default_ploidy, read_bed, read_bim, read_fam, read_ploidy, rows_of_range, unpacked
from helixframe.tables import path_exists, stored

CALLS_AT_ONCE = 4 << 20  # that are gathered together
_PERSON = ("fid", "iid", "father_id", "mother_id", "sex")


@dataclass(frozen=True)
class Source:
    """One BED file and its size."""

    path: str
    n_snp: int
    n_sample: int


@dataclass(frozen=True)
class GenotypePanel:
    """mapped: chr, local_idx, snp_idx, source_row0, ploidy_male, ploidy_female (null where a variant isn't in the source).

    samples: sample_idx, fid, iid, father_id, mother_id, sex. subjects: chr, place (row of the shard's FAM), sample_idx.
    """

    reference: ReferencePanel
    mapped: DataFrame
    samples: DataFrame
    subjects: DataFrame
    sources: dict[str, Source]
    sharded: bool

    def summary(self) -> str:
        size = sum(n for _, n, _ in self.reference.described_shards)
        return f"<GenotypePanel: {size} variants x {self.samples.count()} samples across {len(self.reference.labels)} shard(s): {', '.join(self.reference.labels)}>"

    def is_male(self) -> DataFrame:
        return self.samples.select("sample_idx", (F.col("sex") == 1).alias("is_male"))

    def is_female(self) -> DataFrame:
        return self.samples.select("sample_idx", (F.col("sex") == 2).alias("is_female"))

    def is_subject_present(self, label: str) -> DataFrame:
        """(sample_idx, is_present): whether a sample is in the source of a shard."""
        check_request([label], self.reference.labels, "GenotypePanel.is_subject_present")
        own = self.subjects.filter(F.col("chr") == label).select("sample_idx", F.lit(True).alias("there"))
        return self.samples.select("sample_idx").join(own, "sample_idx", "left").select("sample_idx", F.col("there").isNotNull().alias("is_present"))

    def is_present(self) -> DataFrame:
        return self.mapped.select("chr", "local_idx", "snp_idx", F.col("source_row0").isNotNull().alias("is_present"))

    def select_shards(self, labels: Sequence[str]) -> GenotypePanel:
        wanted = check_request(labels, self.reference.labels, "GenotypePanel.select_shards")
        own = self.reference.select_shards(wanted)
        mapped = self.mapped.drop("snp_idx").join(own.indexed().select("chr", "local_idx", "snp_idx"), ["chr", "local_idx"])
        return GenotypePanel(own, mapped, self.samples, self.subjects.filter(F.col("chr").isin(wanted)), {k: self.sources[k] for k in wanted}, self.sharded)

    def bed_paths(self, labels: Sequence[str], override: str | None) -> dict[str, str]:
        if override is None:
            return {k: self.sources[k].path for k in labels}
        if "@" in override:
            if not self.sharded:
                raise ValueError("a template goes only with a panel of one file for each shard")
            return {k: override.replace("@", k) for k in labels}
        if self.sharded and len({(self.sources[k].n_snp, self.sources[k].n_sample) for k in labels}) > 1:
            raise ValueError("one file can stand only for shards of equal size")
        return dict.fromkeys(labels, override)

    def requested(self, snp_indices: DataFrame | int | Sequence[int]) -> DataFrame:
        """(ord, snp_idx, chr, local_idx, source_row0, ploidies) of a request: a table (ord, snp_idx), or numbers in order. Raises for numbers that aren't there."""
        spark = self.mapped.sparkSession
        request = snp_indices
        if not isinstance(request, DataFrame):
            numbers = [request] if isinstance(request, (int, np.integer)) else list(request)
            if any(isinstance(i, bool) or not isinstance(i, (int, np.integer)) for i in numbers):
                raise ValueError("indices must be integers")
            request = spark.createDataFrame([(k, int(i)) for k, i in enumerate(numbers)], "ord long, snp_idx long")
        located = stored(request.select("ord", "snp_idx").join(self.mapped, "snp_idx", "left"), "fetch-request")
        for r in located.filter("source_row0 IS NULL").orderBy("ord").limit(1).collect():
            if r["chr"] is None:
                raise ValueError(f"index {r['snp_idx']} is out of bounds")
            raise ValueError(f"variant {r['snp_idx']} in shard {r['chr']!r} is not in the genotype source")
        return located

    def _places(self, labels: Sequence[str]) -> dict[str, np.ndarray | None]:
        """For each shard where each sample of the panel stands in its source, -1 where it doesn't; None where both are alike. As large as rows of calls."""
        n = self.samples.count()
        own = self.subjects.filter(F.col("chr").isin(list(labels)))
        alike = own.groupBy("chr").agg((F.count_if(F.col("place") != F.col("sample_idx")) == 0).alias("same"), F.count(F.lit(1)).alias("n")).collect()
        out: dict[str, np.ndarray | None] = {r["chr"]: None for r in alike if r["same"] and r["n"] == n == self.sources[r["chr"]].n_sample}
        for label in labels:
            if label not in out:
                rows = own.filter(F.col("chr") == label).select("sample_idx", "place").toPandas()
                out[label] = np.full(n, -1, np.int64)
                out[label][rows["sample_idx"].to_numpy()] = rows["place"].to_numpy()
        return out

    def fetch_arrays(self, snp_indices: DataFrame | int | Sequence[int], bed_path: str | None = None, haploid_mode: str = "raw") -> DataFrame:
        """(ord, snp_idx, calls, values): arrays over the panel's samples for each requested variant, with repeats.

        A call is -1 and its value null where it is missing or the sample isn't in the shard's source. snp_indices: numbers in order, or a table (ord, snp_idx) of any size.
        What is read are the ranges of BED rows that the request lies in; a row of calls stays one array.
        """
        if haploid_mode not in ("raw", "ploidy_scaled"):
            raise ValueError("haploid_mode must be raw or ploidy_scaled")
        spark = self.mapped.sparkSession
        located = self.requested(snp_indices)
        labels = [r["chr"] for r in located.select("chr").distinct().collect()]
        sexes = np.array([r["sex"] for r in self.samples.select("sample_idx", "sex").orderBy("sample_idx").collect()], np.int8)  # as long as a row of calls
        scaled = haploid_mode == "ploidy_scaled"
        by_sex = F.col("ploidy_male") != F.col("ploidy_female")
        unsexed = scaled and (sexes == 0).any() and not located.filter(by_sex).isEmpty()
        shared = spark.sparkContext.broadcast((sexes, self._places(labels)))
        found = None
        for label, path in self.bed_paths(labels, bed_path).items():
            source = self.sources[label]
            mine = located.filter(F.col("chr") == label)
            each = rows_of_range(source.n_sample)
            ranges = [r["at"] for r in mine.select(F.floor(F.col("source_row0") / each).alias("at")).distinct().orderBy("at").collect()]  # of RANGE_BYTES each
            packed = read_bed(spark, path, source.n_sample, source.n_snp, [(a * each, min((a + 1) * each, source.n_snp)) for a in ranges])
            # few rows are requested, or many: Spark broadcasts them by their size
            one = packed.join(mine.select("ord", "snp_idx", "source_row0", "ploidy_male", "ploidy_female"), "source_row0").withColumn("chr", F.lit(label)).withColumn("n", F.lit(source.n_sample))
            found = one if found is None else found.unionByName(one)
        out = "ord long, snp_idx long, calls array<tinyint>, values array<double>"
        if found is None:
            return spark.createDataFrame([], out)

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sex, places = shared.value
            for whole in batches:
                for batch in _runs(whole):
                    n, place = batch.column("n")[0].as_py(), places[batch.column("chr")[0].as_py()]
                    own = unpacked(batch.column("packed").to_pylist(), n)
                    calls = own if place is None else np.where(place >= 0, own[:, place], np.int8(-1)) if n else np.full((len(batch), len(place)), -1, np.int8)
                    values, off = np.where(calls >= 0, calls, np.nan).astype(np.float64), np.zeros(len(batch), bool)
                    if scaled:
                        male, female = (batch.column(c).to_numpy(zero_copy_only=False)[:, None] for c in ("ploidy_male", "ploidy_female"))
                        off = ((male != female) & (sex == 0) & (calls >= 0)).any(axis=1)
                        values *= np.where(sex == 2, female, male) / 2
                    bounds = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * calls.shape[1])
                    flat = pa.array(values.ravel(), pa.float64(), from_pandas=True)
                    lists = [pa.ListArray.from_arrays(bounds, x) for x in (pa.array(np.ascontiguousarray(calls).ravel()), flat)]
                    yield pa.RecordBatch.from_arrays([batch.column("ord"), batch.column("snp_idx"), *lists, pa.array(off)], ["ord", "snp_idx", "calls", "values", "off"])

        arrays = found.select("ord", "snp_idx", "packed", "ploidy_male", "ploidy_female", "chr", "n").mapInArrow(gather, f"{out}, off boolean")
        if unsexed:  # found before any row is handed on
            arrays = stored(arrays, "fetch-arrays")
            if not arrays.filter("off").isEmpty():
                raise ValueError("ploidy_scaled wants the sex of samples where male and female ploidy differ")
        return arrays.drop("off")

    def fetch(self, snp_indices: DataFrame | int | Sequence[int], bed_path: str | None = None, haploid_mode: str = "raw") -> DataFrame:
        """(ord, snp_idx, sample_idx, call, value): fetch_arrays as a row for each requested variant and each sample."""
        arrays = self.fetch_arrays(snp_indices, bed_path, haploid_mode)
        long = arrays.select("ord", "snp_idx", F.posexplode(F.arrays_zip("calls", "values")).alias("at", "x"))
        return long.select("ord", "snp_idx", F.col("at").cast("long").alias("sample_idx"), F.col("x.calls").alias("call"), F.col("x.values").alias("value"))

    def save(self, path: str) -> None:
        """Where calls lie, not the calls; and what shards of the reference these are."""
        spark = self.mapped.sparkSession
        save_shards(self.reference, path)
        self.mapped.write.partitionBy("chr").parquet(f"{path}/mapped")
        self.samples.write.parquet(f"{path}/samples")
        self.subjects.write.parquet(f"{path}/subjects")
        rows = [(k, s.path, s.n_snp, s.n_sample, self.sharded) for k, s in self.sources.items()]
        spark.createDataFrame(rows, "chr string, path string, n_snp long, n_sample long, sharded boolean").coalesce(1).write.parquet(f"{path}/sources")


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of one shard, of a bounded number of calls."""
    labels = batch.column("chr").to_pylist()
    start = 0
    for i in range(1, len(labels) + 1):
        if i == len(labels) or labels[i] != labels[start] or (i - start) * max(1, batch.column("n")[start].as_py()) >= CALLS_AT_ONCE:
            yield batch.slice(start, i - start)
            start = i


def map_subjects(source: DataFrame, panel: DataFrame) -> DataFrame:
    """source with panel_idx: a subject is the same by fid and iid; the other columns must agree. status says what is wrong, if anything."""
    own = panel.select("fid", "iid", F.col("sample_idx").alias("panel_idx"), *(F.col(c).alias(f"panel_{c}") for c in ("father_id", "mother_id", "sex")))
    joined = source.join(own, ["fid", "iid"], "left")
    differs = F.greatest(*(~F.col(c).eqNullSafe(F.col(f"panel_{c}")) for c in ("father_id", "mother_id", "sex")))
    return joined.withColumn("status", F.when(F.col("panel_idx").isNull(), "absent").when(differs, "differs").otherwise("ok")).select(*source.columns, "panel_idx", "status")


def _checked_samples(fams: DataFrame, first: str, autosomes: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """fams: chr and the columns of FAM files, a file for each shard. The samples of the first, and subjects (chr, place, sample_idx) of all."""
    samples = fams.filter(F.col("chr") == first).drop("chr")
    theirs = samples.select("sample_idx", F.struct(*_PERSON).alias("theirs"))
    same = fams.filter(F.col("chr").isin(list(autosomes))).join(theirs, "sample_idx", "left").withColumn("off", ~F.struct(*_PERSON).eqNullSafe(F.col("theirs")))
    n = samples.count()
    for r in same.groupBy("chr").agg(F.count(F.lit(1)).alias("n"), F.count_if("off").alias("off")).collect():
        if r["off"] or r["n"] != n:
            raise ValueError(f"the samples of shard {r['chr']!r} differ")
    on_x = map_subjects(fams.filter(~F.col("chr").isin(first, *autosomes)), samples)
    for r in on_x.filter("status <> 'ok'").limit(1).collect():
        raise ValueError(f"shard {r['chr']!r}: subject ({r['fid']!r}, {r['iid']!r}) {'is not among the samples' if r['status'] == 'absent' else 'differs from the samples'}")
    same_axis = fams.filter(F.col("chr").isin(first, *autosomes)).select("chr", F.col("sample_idx").alias("place"), "sample_idx")
    return samples, same_axis.unionByName(on_x.select("chr", F.col("sample_idx").alias("place"), F.col("panel_idx").alias("sample_idx")))


def load_genotype(spark: SparkSession, prefix: str, reference: ReferencePanel) -> GenotypePanel:
    """prefix: of .bim, .fam, .bed and maybe .ploidy files, for all shards or, with @, for each. All shards are read together."""
    sharded = "@" in prefix
    at = {k: prefix.replace("@", k) for k in reference.labels}
    every = sorted(set(at.values()))
    for p in every:
        if missing := [e for e in (".bim", ".fam", ".bed") if not path_exists(spark, p + e)]:
            raise ValueError(f"{p}: no {', '.join(missing)} file")
    name = re.escape(prefix.rsplit("/", 1)[-1]).replace("@", "([0-9X]+)")
    shard = lambda ext: F.regexp_extract("path", rf"(?:^|/){name}\.{ext}$", 1) if sharded else F.lit("")  # noqa: E731  # of a file; empty if one file has all

    bim = read_bim(spark, [f"{p}.bim" for p in every]).withColumn("shard", shard("bim"))
    with_ploidy = [p for p in every if path_exists(spark, f"{p}.ploidy")]
    given = read_ploidy(spark, [f"{p}.ploidy" for p in with_ploidy]).withColumn("shard", shard("ploidy")).drop("path") if with_ploidy else None
    sizes = {r["shard"]: r["count"] for r in bim.groupBy("shard").count().collect()}
    rows = default_ploidy(bim)
    if given is not None:
        for r in given.groupBy("shard").count().collect():
            if r["count"] != sizes.get(r["shard"], 0):
                raise ValueError(f"{prefix.replace('@', r['shard'])}.ploidy: expected a row for each variant")
        own = given.select("shard", "row0", F.col("ploidy_male").alias("m"), F.col("ploidy_female").alias("f"))
        rows = rows.join(own, ["shard", "row0"], "left").withColumns({"ploidy_male": F.coalesce("m", "ploidy_male"), "ploidy_female": F.coalesce("f", "ploidy_female")})
    elif not sharded and "X" in reference.labels and not bim.filter("chr = 'X'").isEmpty():
        warnings.warn(f"{prefix}: no .ploidy file; X has ploidy 1 and 2", RuntimeWarning, stacklevel=2)
    rows = rows.filter(F.col("chr").isin(*reference.labels) & ((F.col("shard") == "") | (F.col("shard") == F.col("chr"))))
    check_keys(rows, prefix)
    there = {r["chr"] for r in rows.select("chr").distinct().collect()}
    for label in reference.labels if not sharded else ():
        if label not in there:
            warnings.warn(f"{prefix}: no rows for shard {label!r}; it stays missing", RuntimeWarning, stacklevel=2)
    for r in swapped_counts(reference.variants, rows).collect():
        warnings.warn(f"{prefix}: shard {r['chr']}: {r['n']} unmatched variant(s) would match with alleles exchanged; they stay unmatched", RuntimeWarning, stacklevel=2)
    found = align(reference.variants, rows.withColumnRenamed("row0", "source_row0"), ["source_row0", "ploidy_male", "ploidy_female"])
    mapped = found.select("chr", "local_idx", "source_row0", "ploidy_male", "ploidy_female").join(reference.indexed().select("chr", "local_idx", "snp_idx"), ["chr", "local_idx"])

    fams = read_fam(spark, [f"{p}.fam" for p in every]).withColumn("chr", shard("fam")).drop("path")
    autosomes = [k for k in reference.labels if k != "X"]
    if sharded:
        samples, subjects = _checked_samples(fams, autosomes[0] if autosomes else reference.labels[0], autosomes)
    else:
        samples = fams.drop("chr")
        label = F.explode(F.array(*(F.lit(k) for k in reference.labels)))
        subjects = samples.select(label.alias("chr"), F.col("sample_idx").alias("place"), "sample_idx")
    n_samples = {r["chr"]: r["count"] for r in fams.groupBy("chr").count().collect()}
    key = {k: k if sharded else "" for k in reference.labels}
    sources = {k: Source(f"{at[k]}.bed", sizes.get(key[k], 0), n_samples.get(key[k], 0)) for k in reference.labels}
    return GenotypePanel(reference, mapped, samples, subjects, sources, sharded)


def check_panel(panel: GenotypePanel, where: str) -> None:
    """Raises unless every shard has a source, each variant of the axis has one row, and subjects are samples, each of a shard's places once."""
    if missing := [k for k in panel.reference.labels if k not in panel.sources]:
        raise ValueError(f"{where}: no source for shard {missing[0]!r}")
    if bad := [k for k, s in panel.sources.items() if s.n_snp < 0 or s.n_sample < 0 or not s.path]:
        raise ValueError(f"{where}: the source of shard {bad[0]!r} makes no sense")
    axis = panel.reference.variants.select("chr", "local_idx", F.lit(1).alias("own"))
    rows = panel.mapped.groupBy("chr", "local_idx").agg(F.count(F.lit(1)).alias("n"), F.max("source_row0").alias("row0"))
    size = F.create_map(*(F.lit(x) for k, s in panel.sources.items() for x in (k, s.n_snp)))
    if off := axis.join(rows, ["chr", "local_idx"], "full").filter("own IS NULL OR n IS NULL OR n <> 1").limit(1).collect():
        raise ValueError(f"{where}: variant {off[0]['local_idx']} of shard {off[0]['chr']!r} isn't there once")
    if off := rows.filter((F.col("row0") < 0) | (F.col("row0") >= size[F.col("chr")])).limit(1).collect():
        raise ValueError(f"{where}: shard {off[0]['chr']!r} has a row beyond its source")
    if not panel.samples.filter("sex IS NULL OR sex NOT IN (0, 1, 2)").isEmpty():
        raise ValueError(f"{where}: sex must be 0, 1 or 2")
    known = panel.subjects.join(panel.samples.select("sample_idx", F.lit(1).alias("own")), "sample_idx", "left")
    for r in known.groupBy("chr").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("place").alias("places"), F.count_distinct("sample_idx").alias("samples"), F.count("own").alias("known"), F.max("place").alias("last")).collect():
        if not r["n"] == r["places"] == r["samples"] == r["known"] == panel.sources[r["chr"]].n_sample or r["last"] >= r["n"]:
            raise ValueError(f"{where}: subjects of shard {r['chr']!r} are not its samples")


def load_genotype_cache(spark: SparkSession, path: str, reference: ReferencePanel, shards: Sequence[str] | None = None) -> GenotypePanel:
    """reference: the panel of all shards that were saved; its shards must be those that the cache says."""
    check_stored(spark, path, reference)
    mapped = spark.read.parquet(f"{path}/mapped").withColumn("chr", F.col("chr").cast("string"))
    rows = spark.read.parquet(f"{path}/sources").collect()
    sources = {r["chr"]: Source(r["path"], r["n_snp"], r["n_sample"]) for r in rows}
    found = GenotypePanel(reference, mapped, spark.read.parquet(f"{path}/samples"), spark.read.parquet(f"{path}/subjects"), sources, bool(rows) and rows[0]["sharded"])
    check_panel(found, path)
    return found if shards is None else found.select_shards(shards)
