"""Queries that write the views as files of the formats that users have, and load these again.

Files go to fresh folders of the shared folder; text is written as part files, which the sources read as one file.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.annotations import create_annotation, load_annotation, load_annotations, load_annotations_cache
from helixframe.contigs import CONTIGS, chr_rank
from helixframe.genotype import GenotypePanel, load_genotype, load_genotype_cache
from helixframe.ld import LDPanel, build_ld_from_genotype, ld_manifest, load_ld, save_ld, validate_ld
from helixframe.operators.linkage import allele_frequency
from helixframe.plans import views
from helixframe.plans.catalog import _PAIRS, _calls, _v, query
from helixframe.reference import ReferencePanel, load_reference_cache
from helixframe.sources.ld_npz import export_distribution, import_distribution
from helixframe.sources.plink import load_reference, read_bed, read_bim, read_fam, read_hash_table, read_ploidy, unpack_calls, write_bed
from helixframe.sources.text import write_lines
from helixframe.sumstats import Sumstats, create_sumstats, load_sumstats, load_sumstats_cache
from helixframe.tables import fresh_path

#: Numbers of the axis as a loader gives them: from 0 within the shard, in order of the file.
_AXIS = "ax AS (SELECT *, row_number() OVER (PARTITION BY chr ORDER BY bp, local_idx) - 1 AS idx FROM variants),\n"


def _text(*columns) -> F.Column:
    return F.concat_ws("\t", *(c if not isinstance(c, str) else F.col(c).cast("string") for c in columns)).alias("value")


def _rank():
    return chr_rank(F.col("chr"))


def _bim(spark: SparkSession, sf_dir: str, ignored: bool = False) -> str:
    """The variants as one BIM file; ignored: with rows of contigs that are dropped after them."""
    v = _v(spark, sf_dir, "VARIANTS").select("chr", "snp", "bp", "a1", "a2", "local_idx")
    if ignored:
        v = v.unionByName(v.filter("chr = '1'").withColumn("chr", F.lit("Y")))
    path = fresh_path(spark, "variants.bim")
    lines = v.select(_text("chr", "snp", F.lit("0"), "bp", "a1", "a2"), F.coalesce(_rank(), F.lit(99)).alias("rank"), "bp", "local_idx")
    write_lines(lines, ["rank", "bp", "local_idx"], path)
    return path


def _reference(spark: SparkSession, sf_dir: str) -> ReferencePanel:
    return load_reference(spark, _bim(spark, sf_dir))


@query(
    _AXIS
    + """o AS (SELECT chr, (sum(n) OVER (ORDER BY CASE chr WHEN 'X' THEN 23 ELSE chr::INTEGER END))::BIGINT - n AS start0 FROM (SELECT chr, count(*) AS n FROM ax GROUP BY chr))
SELECT ax.chr, ax.idx AS local_idx, o.start0 + ax.idx AS snp_idx, snp, bp, a1, a2, len(a1) = 1 AND len(a2) = 1 AS is_snv FROM ax JOIN o ON ax.chr = o.chr"""
)
def load_bim(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = load_reference(spark, _bim(spark, sf_dir, ignored=True))
    return panel.described().select("chr", "local_idx", "snp_idx", "snp", "bp", "a1", "a2", "is_snv")


@query("r AS (SELECT *, 0 AS y FROM variants UNION ALL  SELECT *, 1 FROM variants WHERE chr = '1') SELECT CASE y WHEN 1 THEN 'Y' ELSE chr END AS chr, snp, row_number() OVER (ORDER BY y, CASE chr WHEN 'X' THEN 23 ELSE chr::INTEGER END, bp, local_idx) - 1 AS row0 FROM r")
def bim_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of a file in parts has its number in the whole file."""
    return read_bim(spark, _bim(spark, sf_dir, ignored=True)).select("chr", "snp", "row0")


@query(_AXIS + "SELECT chr, idx AS local_idx, snp FROM ax WHERE chr IN ('3', '20', 'X')")
def reference_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "reference")
    _reference(spark, sf_dir).save(path)
    again = load_reference_cache(spark, path)
    again.validate_checksums()
    return load_reference_cache(spark, path, ["3", "20", "X"]).variants.select("chr", "local_idx", "snp")


def _fam(spark: SparkSession, sf_dir: str) -> str:
    path = fresh_path(spark, "samples.fam")
    write_lines(_v(spark, sf_dir, "SAMPLES").select(_text("fid", "iid", "father_id", "mother_id", "sex", F.lit("-9")), "sample_idx"), ["sample_idx"], path)
    return path


@query("SELECT row_number() OVER (ORDER BY sample_idx) - 1 AS sample_idx, fid, iid, father_id, mother_id, sex::TINYINT AS sex FROM samples")
def load_fam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_fam(spark, _fam(spark, sf_dir)).drop("path")


@query(_AXIS + "SELECT row_number() OVER (ORDER BY CASE chr WHEN 'X' THEN 23 ELSE chr::INTEGER END, bp, local_idx) - 1 AS row0, (k % 3)::DOUBLE AS ploidy_male, (k % 2 + 1)::DOUBLE AS ploidy_female FROM ax")
def load_ploidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "variants.ploidy")
    write_lines(_v(spark, sf_dir, "VARIANTS").select(_text(F.col("k") % 3, F.col("k") % 2 + 1), _rank().alias("rank"), "bp", "local_idx"), ["rank", "bp", "local_idx"], path)
    return read_ploidy(spark, path).drop("path")


@query("SELECT snp, printf('%.3f', bp / 7.0::DOUBLE) AS freq FROM variants")
def hash_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "variants.afreq")
    freq = F.format_string("%.3f", F.col("bp") / 7.0)
    write_lines(_v(spark, sf_dir, "VARIANTS").select(_text("chr", "snp", freq), "snp"), ["snp"], path, "#CHROM\tID\tFREQ")
    found = read_hash_table(spark, path)
    return found.select(F.col("ID").alias("snp"), F.col("FREQ").alias("freq"))


# Summary statistics ------------------------------------------------------------------------------------------


def _sumstats(spark: SparkSession, sf_dir: str) -> Sumstats:
    s = _v(spark, sf_dir, "SUMSTATS")
    y = s.withColumn("chr", F.lit("MT")).limit(5)
    number = lambda c, none: F.coalesce(F.col(c).cast("string"), F.lit(none))
    path = fresh_path(spark, "trait.tsv")
    lines = s.unionByName(y).select(_text("a1", "chr", "bp", number("z", "NA"), F.lit("note"), "a2", number("n", ""), "p"), "k")
    write_lines(lines, ["k"], path, "EffectAllele\tCHR\tpos\tZ\tcomment\tOtherAllele\tN\tP")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # of alleles that are exchanged, and gaps
        return load_sumstats(spark, path, _reference(spark, sf_dir))


_LOADED = (
    _AXIS
    + """a AS (
  SELECT v.chr, v.idx AS local_idx, CASE WHEN s.p = 0 THEN 'inf'::DOUBLE WHEN s.p > 0 AND s.p <= 1 THEN -log10(s.p) + 0.0 END AS logp, s.z, s.n
  FROM ax v LEFT JOIN sumstats s ON v.chr = s.chr AND v.bp = s.bp AND v.a1 = s.a1 AND v.a2 = s.a2
)
"""
)


@query(_LOADED + "SELECT chr, local_idx, round(logp, 6) AS logp, round(z, 6) AS z, n FROM a")
def load_sumstats_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sumstats(spark, sf_dir).values.select("chr", "local_idx", F.round("logp", 6).alias("logp"), F.round("z", 6).alias("z"), "n")


@query(_LOADED + "SELECT chr, local_idx, logp IS NOT NULL AS is_present FROM a WHERE chr IN ('2', 'X')")
def sumstats_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, found = fresh_path(spark, "sumstats"), _sumstats(spark, sf_dir)
    found.save(path)
    return load_sumstats_cache(spark, path, found.reference, ["2", "X"]).is_present()


@query(_AXIS + "SELECT chr, idx AS local_idx, round(-log10((k % 100 + 1) / 101.0::DOUBLE), 6) AS logp, (k % 7)::DOUBLE AS z FROM ax")
def make_sumstats(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = _reference(spark, sf_dir)
    k = F.substring("snp", 3, 20).cast("long")
    rows = panel.indexed().select("snp_idx", ((k % 100 + 1) / F.lit(101.0)).alias("p"), (k % 7).cast("double").alias("z"))
    return create_sumstats(panel, rows).values.select("chr", "local_idx", F.round("logp", 6).alias("logp"), "z")


# Annotations -------------------------------------------------------------------------------------------------


def _interval_file(spark: SparkSession, rows: DataFrame, name: str, columns: list[str], header: str | None = None) -> str:
    path = fresh_path(spark, name)
    write_lines(rows.select(_text("chr", "start0", "end0", *columns), "row0"), ["row0"], path, header)
    return path


_IN = "JOIN intervals i ON i.chr = ax.chr AND ax.bp - 1 >= i.start0 AND ax.bp - 1 < i.end0"


@query(_AXIS + f"SELECT DISTINCT ax.chr, ax.idx AS local_idx, substr(i.grp, 2, 1)::INTEGER AS anno_id, 1.0::DOUBLE AS value FROM ax {_IN}")
def load_annotation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _v(spark, sf_dir, "INTERVALS")
    paths = [_interval_file(spark, own.filter(F.col("grp") == g), f"{g}.bed", []) for g in ("g0", "g1", "g2")]
    return load_annotations(spark, paths, _reference(spark, sf_dir)).values.select("chr", "local_idx", "anno_id", "value")


@query(_AXIS + f"SELECT DISTINCT ax.chr, ax.idx AS local_idx, i.grp AS name, 1.0::DOUBLE AS value FROM ax {_IN}")
def annotation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _interval_file(spark, _v(spark, sf_dir, "INTERVALS"), "groups.annot", ["grp"], "chrom\tstart\tend\tgroup")
    return load_annotation(spark, path, _reference(spark, sf_dir), has_header=True, group_column="group").named()


@query("SELECT grp AS name, (row_number() OVER (ORDER BY min(row0)))::INTEGER - 1 AS anno_id, count(*) AS n, true AS is_binary FROM intervals GROUP BY grp")
def annotation_group_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns in the order in which groups come first in the file, with how many intervals their metadata say."""
    path = _interval_file(spark, _v(spark, sf_dir, "INTERVALS"), "groups.annot", ["grp"])
    return load_annotation(spark, path, _reference(spark, sf_dir), group_column=3).table.select("name", "anno_id", F.get_json_object("metadata", "$.num_source_intervals").cast("long").alias("n"), "is_binary")


_NUMERIC = _AXIS + "p AS (SELECT ax.chr, ax.idx AS local_idx, n.score, n.weight FROM ax JOIN numerics n ON n.chr = ax.chr AND ax.bp - 1 >= n.start0 AND ax.bp - 1 < n.end0)\n"


def _numeric(spark: SparkSession, sf_dir: str):
    path = _interval_file(spark, _v(spark, sf_dir, "NUMERIC"), "values.annot", ["score", "weight"], "chrom\tstart\tend\tscore\tweight")
    return load_annotation(spark, path, _reference(spark, sf_dir), has_header=True, value_columns=["weight", 3])


@query(_NUMERIC + "SELECT chr, local_idx, 'weight' AS name, weight AS value FROM p WHERE weight <> 0 UNION ALL  SELECT chr, local_idx, 'score', score FROM p WHERE score <> 0")
def load_annotation_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numeric(spark, sf_dir).named()


@query(_NUMERIC + "SELECT chr, local_idx, score AS value FROM p WHERE score <> 0 AND chr IN ('4', '9')")
def annotation_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, panel = fresh_path(spark, "annotations"), _numeric(spark, sf_dir)
    panel.save(path)
    again = load_annotations_cache(spark, path, panel.reference, ["4", "9"])
    return again.select_annotations(["score"]).values.select("chr", "local_idx", "value")


@query(_AXIS + "SELECT chr, idx AS local_idx, (k % 4)::DOUBLE AS value FROM ax WHERE k % 4 <> 0")
def make_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = _reference(spark, sf_dir)
    rows = panel.indexed().select("snp_idx", (F.substring("snp", 3, 20).cast("long") % 4).cast("double").alias("value"))
    return create_annotation(panel, rows, "mod").values.select("chr", "local_idx", "value")


# Genotypes ---------------------------------------------------------------------------------------------------

N_SAMPLES = 64
#: Calls as they stand in BED files, and the axis that their variants have.
_OWN_CALLS = """
x AS (SELECT chr, bp, k, dense_rank() OVER (PARTITION BY chr ORDER BY local_idx) - 1 AS idx, sample_idx, g FROM calls),
"""


def _genotype(spark: SparkSession, sf_dir: str, sharded: bool = True) -> tuple[GenotypePanel, str]:
    """The calls as BED, BIM and FAM files, for each shard or in one, and the panel of these.

    With a source for each shard the samples of X are turned round, and some are not in it.
    """
    calls = _calls(spark, sf_dir)
    root = fresh_path(spark, "bfile")
    prefix = f"{root}/c=@" if sharded else f"{root}/c"
    numbered = calls.withColumn("row0", F.row_number().over(Window.partitionBy("chr").orderBy("local_idx")) - 1)
    bim = numbered.select("chr", _text("chr", F.concat(F.lit("v"), "k"), F.lit("0"), "bp", F.lit("A"), F.lit("G")), _rank().alias("rank"), "row0")
    people = spark.range(N_SAMPLES).select(F.col("id"), _text(F.concat(F.lit("F"), F.col("id") % 5), F.concat(F.lit("I"), "id"), F.lit("0"), F.lit("0"), F.col("id") % 2 + 1, F.lit("-9")))
    if sharded:  # a folder of part files for each shard and kind
        on_x = F.reverse(F.filter("calls", lambda _, i: i % 16 != 5))
        bed = numbered.withColumn("calls", F.when(F.col("chr") == "X", on_x).otherwise(F.col("calls"))).withColumn("shard", F.col("chr"))
        at = F.when(F.col("chr") == "X", -F.col("id")).otherwise(F.col("id"))
        fams = people.crossJoin(calls.select("chr").distinct()).filter("chr <> 'X' OR id % 16 <> 5").select(F.concat("chr", F.lit(".fam")).alias("c"), "value", at.alias("row0"))
        lines = bim.select(F.concat("chr", F.lit(".bim")).alias("c"), "value", "row0").unionByName(fams)
        lines.repartitionByRange("c", "row0").sortWithinPartitions("c", "row0").select("c", "value").write.partitionBy("c").text(root)
    else:
        rank = F.row_number().over(Window.orderBy("rank", "row0")) - 1  # as wide as the fixture
        bed = numbered.withColumn("rank", _rank()).withColumn("row0", rank).withColumn("shard", F.lit(""))
        write_lines(bim, ["rank", "row0"], f"{root}/c.bim")
        write_lines(people, ["id"], f"{root}/c.fam")
    write_bed(bed, prefix + ".bed")
    reference = load_reference(spark, prefix + ".bim")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # of the missing ploidy file
        return load_genotype(spark, prefix, reference), prefix


@query(_OWN_CALLS + "y AS (SELECT 1) SELECT chr, idx AS local_idx, sample_idx, g::TINYINT AS call FROM x")
def bed_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of a BED file in one, by the numbers that the panel gives them."""
    panel, prefix = _genotype(spark, sf_dir, sharded=False)
    source = panel.sources[panel.reference.labels[0]]
    rows = unpack_calls(read_bed(spark, prefix + ".bed", source.n_sample, source.n_snp), source.n_sample)
    found = panel.mapped.select("chr", "local_idx", "source_row0").join(rows, "source_row0")
    return found.select("chr", "local_idx", F.posexplode("calls").alias("at", "call")).select("chr", "local_idx", F.col("at").cast("long").alias("sample_idx"), "call")


_ALL = "o AS (SELECT *, dense_rank() OVER (ORDER BY CASE chr WHEN 'X' THEN 23 ELSE chr::INTEGER END, idx) - 1 AS snp_idx FROM x)\n"


#: Of the calls of X, those of samples that its own source lacks.
_ABSENT = "chr = 'X' AND sample_idx % 16 = 5"


def _every(panel: GenotypePanel) -> DataFrame:
    """A request for all variants, as a table."""
    return panel.mapped.select(F.col("snp_idx").alias("ord"), "snp_idx")


@query(
    _OWN_CALLS
    + _ALL.rstrip()
    + f""", p AS (SELECT *, CASE WHEN {_ABSENT} THEN -1 ELSE g END AS c FROM o)
SELECT snp_idx, sample_idx, c::TINYINT AS call, CASE WHEN c >= 0 THEN c::DOUBLE * CASE WHEN chr = 'X' AND sample_idx % 2 = 0 THEN 1 ELSE 2 END / 2 END AS value FROM p"""
)
def fetch_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of all variants by a table of their numbers, scaled by ploidy: X counts once in males, and is missing in samples that its source lacks."""
    panel, _ = _genotype(spark, sf_dir)
    return panel.fetch(_every(panel), haploid_mode="ploidy_scaled").select("snp_idx", "sample_idx", "call", "value")


@query(_OWN_CALLS + "y AS (SELECT 1) SELECT DISTINCT chr, idx AS local_idx, true AS is_present FROM x WHERE chr IN ('1', 'X')")
def genotype_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel, _ = _genotype(spark, sf_dir, sharded=False)
    path = fresh_path(spark, "genotype")
    panel.save(path)
    return load_genotype_cache(spark, path, panel.reference, ["1", "X"]).is_present().select("chr", "local_idx", "is_present")


@query(f"SELECT i AS sample_idx, i % 2 = 0 AS is_male, i % 2 = 1 AS is_female, i % 16 <> 5 AS is_present FROM range({N_SAMPLES}) t(i) WHERE EXISTS (SELECT 1 FROM calls)")
def sample_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel, _ = _genotype(spark, sf_dir)
    return panel.is_male().join(panel.is_female(), "sample_idx").join(panel.is_subject_present("X"), "sample_idx")


# Linkage disequilibrium --------------------------------------------------------------------------------------

_FREQUENCY = _OWN_CALLS + "f AS (SELECT chr, idx AS local_idx, sum(g) / (2.0::DOUBLE * count(*)) AS f FROM x WHERE g >= 0 AND (chr <> 'X' OR sample_idx % 2 = 1) GROUP BY chr, idx)\n"


def _built(spark: SparkSession, sf_dir: str) -> tuple[LDPanel, GenotypePanel]:
    panel, _ = _genotype(spark, sf_dir, sharded=False)
    return build_ld_from_genotype(panel, allow_monomorphic=True), panel


@query(_FREQUENCY + "SELECT chr, local_idx, round(f, 5) AS built, round(f, 5) AS fetched FROM f")
def frequency_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies of a panel that was built from BED files, saved and loaded, beside those of the calls that the genotype panel fetches."""
    ld, panel = _built(spark, sf_dir)
    path = fresh_path(spark, "ld")
    save_ld(ld, path, {"window_kb": 10_000})
    again = load_ld(spark, path)
    validate_ld(again)
    axis = panel.mapped.select("chr", "local_idx", "snp_idx")
    fetched = panel.fetch_arrays(_every(panel)).join(axis, "snp_idx")
    females = F.when(F.col("chr") == "X", F.filter("calls", lambda _, i: i % 2 == 1)).otherwise(F.col("calls"))
    own = allele_frequency(fetched.withColumn("calls", females)).select("chr", "local_idx", F.col("a1freq").alias("f"))
    kept = again.a1freq().join(axis, "snp_idx").select("chr", "local_idx", F.round(F.col("a1freq").cast("double"), 5).alias("built"))
    return kept.join(own, ["chr", "local_idx"]).select("chr", "local_idx", "built", F.round("f", 5).alias("fetched"))


_BUILT = (
    _OWN_CALLS
    + """
y AS (SELECT *, CASE WHEN chr <> 'X' THEN '' WHEN sample_idx % 2 = 1 THEN 'female' ELSE 'male' END AS sex FROM x),
pr AS (SELECT a.chr, a.sex, a.idx AS i, b.idx AS j, corr(a.g, b.g) AS r FROM y a JOIN y b ON a.chr = b.chr AND a.sample_idx = b.sample_idx AND b.idx > a.idx AND b.bp - a.bp <= 10000000
  WHERE a.g >= 0 AND b.g >= 0 GROUP BY a.chr, a.sex, a.idx, b.idx),
q AS (SELECT * FROM pr WHERE r * r >= 0.05)
"""
)


@query(_BUILT + "SELECT chr, sex, i, j, round(r::FLOAT::DOUBLE, 5) AS r FROM q")
def ld_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel built from BED files, as compressed-column files with a manifest, validated and imported again."""
    ld, panel = _built(spark, sf_dir)
    root = fresh_path(spark, "distribution")
    export_distribution(ld, root)
    again = import_distribution(spark, root, panel.reference, with_bim=True)
    return again.r.filter("i < j").select("chr", F.coalesce("sex", F.lit("")).alias("sex"), "i", "j", F.round(F.col("r").cast("double"), 5).alias("r"))


@query(_BUILT.rstrip() + ",\nn AS (SELECT chr, sex, count(DISTINCT idx) AS num_snp FROM y GROUP BY chr, sex) SELECT n.chr, n.sex, n.num_snp, n.num_snp + 2 * (SELECT count(*) FROM q WHERE q.chr = n.chr AND q.sex = n.sex) AS nnz FROM n")
def ld_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    ld, _ = _built(spark, sf_dir)
    path = fresh_path(spark, "ld")
    save_ld(ld, path)
    return ld_manifest(load_ld(spark, path)).select("chr", F.coalesce("sex", F.lit("")).alias("sex"), "num_snp", "nnz")
