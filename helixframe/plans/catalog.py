"""Named queries over the driver's tables, one for each operator, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.annotations import append_columns, group_columns, infer_binary, select_columns
from helixframe.contigs import CONTIGS
from helixframe.functions.variants import allele_hash64, is_single_nucleotide, is_strand_ambiguous, ploidy_scaled
from helixframe.genotype import map_subjects
from helixframe.operators.align import swapped_counts, with_match_key
from helixframe.operators.intervals import overlapping, paint, paint_groups, paint_values, union_intervals
from helixframe.operators.blocks import build_blocks, multiply_r2, pairs_of, rows_of
from helixframe.operators.linkage import allele_frequency, fast_prune, haploid_frequency, is_monomorphic, prune_frequency, select_samples, validation
from helixframe.plans import views
from helixframe.plans.views import duck
from helixframe.reference import ReferencePanel, shard_checksums, shard_offsets
from helixframe.sources.plink import order_violations
from helixframe.sumstats import aligned_sumstats, completeness
from helixframe.tables import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "sumstats_align"
WINDOW_KB = 10_000.0  # of the LD queries: the default of a build
LEAST_R2 = 0.05
ITERATIONS = 100  # of random pruning


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        QUERIES[f.__name__] = f
        SQL[f.__name__] = duck(sql)
        return f

    return add


def _v(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return views.spark_view(spark, sf_dir, getattr(views, name))


def _panel(spark: SparkSession, sf_dir: str) -> ReferencePanel:
    return ReferencePanel(_v(spark, sf_dir, "VARIANTS"), CONTIGS)


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chr, local_idx, bp, k, calls (array by sample): the vectors' own arrays, so no explode and no shuffle."""
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    g = F.transform("embedding", lambda x, i: F.when((F.col("vec_id") + i) % 17 == 0, -1).when(x < -0.05, 0).when(x < 0.05, 1).otherwise(2).cast("tinyint"))
    k = F.col("vec_id")
    place = F.floor(k / 23).cast("long")
    label = F.when(k % 23 == 22, "X").otherwise((k % 23 + 1).cast("string"))
    return t.select(label.alias("chr"), place.alias("local_idx"), (1000 + place * 1000).alias("bp"), k.alias("k"), g.alias("calls"))


# Reference ---------------------------------------------------------------------------------------------------


@query("""SELECT snp, len(a1) = 1 AND len(a2) = 1 AS is_snv, concat(a1, a2) IN ('AT', 'TA', 'CG', 'GC') AS is_strand_ambiguous FROM variants""")
def variant_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    a1, a2 = F.col("a1"), F.col("a2")
    return _v(spark, sf_dir, "VARIANTS").select("snp", is_single_nucleotide(a1, a2).alias("is_snv"), is_strand_ambiguous(a1, a2).alias("is_strand_ambiguous"))


def _sql_hash(allele: str) -> str:
    lane = lambda base: f"list_reduce(list_transform(range(1, len({allele}) + 1), lambda i: ord(substr({allele}, i, 1))::BIGINT), lambda h, x: (h * {base} + x + 1) % 2147483647, 1::BIGINT)"
    return f"{lane(257)} * 4294967296 + {lane(263)}"


@query(f"SELECT snp, {_sql_hash('a1')} AS a1_hash64, {_sql_hash('a2')} AS a2_hash64 FROM variants")
def allele_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _v(spark, sf_dir, "VARIANTS").select("snp", allele_hash64(F.col("a1")).alias("a1_hash64"), allele_hash64(F.col("a2")).alias("a2_hash64"))


_OFFSETS = """
n AS (SELECT chr, CASE chr WHEN 'X' THEN 23 ELSE chr::INTEGER END AS chr_rank, count(*) AS num_snp FROM variants GROUP BY chr),
o AS (SELECT chr, chr_rank, num_snp, (sum(num_snp) OVER (ORDER BY chr_rank))::BIGINT AS stop0 FROM n)
"""


@query(_OFFSETS + "SELECT chr, chr_rank, num_snp, stop0 - num_snp AS start0, stop0 FROM o")
def shard_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_offsets(_v(spark, sf_dir, "VARIANTS"))


@query("""SELECT chr, md5(concat(string_agg(concat_ws(':', chr, bp, a1, a2), chr(10) ORDER BY local_idx), chr(10))) AS checksum FROM variants GROUP BY chr""".replace("chr(10)", "'\n'"))
def shard_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_checksums(_v(spark, sf_dir, "VARIANTS"))


@query(
    """
n AS (SELECT chr, CASE chr WHEN 'X' THEN 23 ELSE chr::INTEGER END AS chr_rank, count(*) AS num_snp FROM variants WHERE chr IN ('2', '5', 'X') GROUP BY chr),
o AS (SELECT chr, (sum(num_snp) OVER (ORDER BY chr_rank))::BIGINT - num_snp AS start0 FROM n)
SELECT v.snp, v.chr, o.start0 + v.local_idx AS snp_idx FROM variants v JOIN o ON v.chr = o.chr"""
)
def select_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panel(spark, sf_dir).select_shards(["2", "5", "X"]).indexed().select("snp", "chr", "snp_idx")


@query(
    """
s AS (SELECT chr, count(*) AS num_snp, md5(string_agg(concat_ws(':', chr, bp, a1, a2), '|' ORDER BY local_idx)) AS checksum FROM variants GROUP BY chr),
t AS (SELECT chr, count(*) AS num_snp, md5(string_agg(concat_ws(':', chr, bp, a1, a2), '|' ORDER BY local_idx)) AS checksum FROM variants WHERE k % 1000 <> 7 GROUP BY chr)
SELECT coalesce(s.chr, t.chr) AS chr, s.num_snp, t.num_snp AS n FROM s FULL JOIN t ON s.chr = t.chr
WHERE s.chr IS NULL OR t.chr IS NULL OR s.num_snp <> t.num_snp OR s.checksum <> t.checksum"""
)
def object_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = _panel(spark, sf_dir)
    other = ReferencePanel(panel.variants.filter("k % 1000 <> 7"), panel.labels)  # another object: a damaged copy
    return panel.mismatches(other.shards()).select("chr", "num_snp", "n")


@query(
    """
b AS (SELECT p_partkey::BIGINT * 2654435761 % 4294967296 AS row0, CAST(floor(p_retailprice) AS BIGINT) AS bp FROM part),
m AS (SELECT row0, bp, lag(bp) OVER (ORDER BY row0) AS before FROM b)
SELECT row0, bp FROM m WHERE bp < before""".replace("b AS", "v AS (SELECT * FROM variants LIMIT 0),\nb AS", 1)
)
def row_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one contig in disorder: an odd factor modulo 2^32 gives parts other places, all different."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    row0 = F.col("p_partkey").cast("long") * F.lit(2654435761) % F.lit(1 << 32)
    rows = part.select(F.lit("part").alias("path"), row0.alias("row0"), F.lit("1").alias("chr"), F.floor("p_retailprice").alias("bp"))
    return order_violations(rows).select("row0", "bp")


@query(
    """
b AS (SELECT o_orderkey AS row0, o_orderkey % 7 // 3 AS rank, o_custkey AS bp FROM orders),
m AS (SELECT *, lag(rank) OVER (ORDER BY row0) AS rank0, lag(bp) OVER (ORDER BY row0) AS bp0 FROM b)
SELECT row0, bp FROM m WHERE rank < rank0 OR (rank = rank0 AND bp < bp0)""".replace("b AS", "v AS (SELECT * FROM variants LIMIT 0),\nb AS", 1)
)
def row_order_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of three contigs in disorder."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    label = F.element_at(F.array(*(F.lit(c) for c in ("1", "2", "X"))), (F.floor(F.col("o_orderkey") % 7 / 3) + 1).cast("int"))
    rows = orders.select(F.lit("orders").alias("path"), F.col("o_orderkey").alias("row0"), label.alias("chr"), F.col("o_custkey").alias("bp"))
    return order_violations(rows).select("row0", "bp")


# Summary statistics ------------------------------------------------------------------------------------------

_ALIGNED = """
a AS (
  SELECT v.chr, v.local_idx, CASE WHEN s.p = 0 THEN 'inf'::DOUBLE WHEN s.p > 0 AND s.p <= 1 THEN -log10(s.p) + 0.0 END AS logp, s.z, s.n
  FROM variants v LEFT JOIN sumstats s ON v.chr = s.chr AND v.bp = s.bp AND substr(v.a1, 1, 150) = substr(s.a1, 1, 150) AND substr(v.a2, 1, 150) = substr(s.a2, 1, 150)
)
"""


@query(_ALIGNED + "SELECT chr, local_idx, round(logp, 6) AS logp, logp IS NOT NULL AS is_present, round(z, 6) AS z, n FROM a")
def sumstats_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aligned_sumstats(_panel(spark, sf_dir), _v(spark, sf_dir, "SUMSTATS"))
    return found.select("chr", "local_idx", F.round("logp", 6).alias("logp"), F.col("logp").isNotNull().alias("is_present"), F.round("z", 6).alias("z"), "n")


@query(_ALIGNED + "SELECT chr, count(*) AS num_snp, count(logp) AS present, round(avg(CASE WHEN isfinite(logp) THEN logp END), 6) AS mean_logp FROM a GROUP BY chr")
def sumstats_by_chr(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aligned_sumstats(_panel(spark, sf_dir), _v(spark, sf_dir, "SUMSTATS"))
    mean = F.round(F.avg(F.when(F.col("logp") < float("inf"), F.col("logp"))), 6)
    return found.groupBy("chr").agg(F.count(F.lit(1)).alias("num_snp"), F.count("logp").alias("present"), mean.alias("mean_logp"))


@query(
    """
SELECT s.chr, count(*) AS n FROM sumstats s
WHERE NOT EXISTS (SELECT 1 FROM variants v WHERE v.chr = s.chr AND v.bp = s.bp AND v.a1 = s.a1 AND v.a2 = s.a2)
  AND EXISTS (SELECT 1 FROM variants v WHERE v.chr = s.chr AND v.bp = s.bp AND v.a1 = s.a2 AND v.a2 = s.a1)
GROUP BY s.chr"""
)
def swap_diagnostic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return swapped_counts(_v(spark, sf_dir, "VARIANTS"), _v(spark, sf_dir, "SUMSTATS"))


@query(
    """
d AS (SELECT chr, bp, a1, a2 FROM variants UNION ALL SELECT chr, bp, a1, a2 FROM sumstats)
SELECT chr, bp, a1, a2, count(*) AS n FROM d GROUP BY chr, bp, a1, a2 HAVING count(*) > 1""".replace("UNION ALL SELECT", "UNION ALL  SELECT")
)
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["chr", "bp", "a1", "a2"]
    both = _v(spark, sf_dir, "VARIANTS").select(cols).unionAll(_v(spark, sf_dir, "SUMSTATS").select(cols))
    return with_match_key(both).groupBy("chr", "bp", F.col("m1").alias("a1"), F.col("m2").alias("a2")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query(_ALIGNED + "SELECT count(logp) AS present, count(*) FILTER (logp IS NOT NULL AND z IS NULL) AS no_z, count(*) FILTER (logp IS NOT NULL AND n IS NULL) AS no_n FROM a")
def zn_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completeness(aligned_sumstats(_panel(spark, sf_dir), _v(spark, sf_dir, "SUMSTATS")))


@query(
    """
t AS (SELECT chr, bp, a1, a2, (z * 0.5 + n / 100) AS z2 FROM sumstats)
SELECT v.chr, count(*) AS n, round(sum(s.z * t.z2), 6) AS sum_zz
FROM variants v JOIN sumstats s ON v.chr = s.chr AND v.bp = s.bp AND v.a1 = s.a1 AND v.a2 = s.a2
JOIN t ON v.chr = t.chr AND v.bp = t.bp AND v.a1 = t.a1 AND v.a2 = t.a2
WHERE s.z IS NOT NULL AND t.z2 IS NOT NULL GROUP BY v.chr"""
)
def bivariate_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel, source = _panel(spark, sf_dir), _v(spark, sf_dir, "SUMSTATS")
    one = aligned_sumstats(panel, source).select("chr", "local_idx", "z")
    two = aligned_sumstats(panel, source.withColumn("z", F.col("z") * 0.5 + F.col("n") / 100)).select("chr", "local_idx", F.col("z").alias("z2"))
    both = one.join(two, ["chr", "local_idx"]).filter("z IS NOT NULL AND z2 IS NOT NULL")
    return both.groupBy("chr").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("z") * F.col("z2")), 6).alias("sum_zz"))


# Annotations -------------------------------------------------------------------------------------------------


def _sql_union(keys: str, source: str = "intervals") -> str:
    return f"""
r AS (SELECT {keys}, start0, end0, max(end0) OVER (PARTITION BY {keys} ORDER BY start0, end0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}),
q AS (SELECT *, sum(CASE WHEN reach IS NULL OR start0 > reach THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY start0, end0 ROWS UNBOUNDED PRECEDING) AS g FROM r),
u AS (SELECT {keys}, min(start0) AS start0, max(end0) AS end0 FROM q GROUP BY {keys}, g)
"""


@query(_sql_union("chr") + "SELECT chr, start0, end0 FROM u")
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_intervals(_v(spark, sf_dir, "INTERVALS"))


@query(
    """
o AS (SELECT chr, start0, end0, row0, max(end0) OVER (PARTITION BY chr ORDER BY start0, end0, row0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM intervals)
SELECT chr, start0, end0, row0 FROM o WHERE start0 < reach"""
)
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlapping(_v(spark, sf_dir, "INTERVALS")).select("chr", "start0", "end0", "row0")


@query("SELECT snp FROM variants v WHERE EXISTS (SELECT 1 FROM intervals i WHERE i.chr = v.chr AND v.bp - 1 >= i.start0 AND v.bp - 1 < i.end0)")
def paint_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paint(_v(spark, sf_dir, "VARIANTS"), union_intervals(_v(spark, sf_dir, "INTERVALS"))).select("snp")


@query("SELECT DISTINCT v.snp, i.grp FROM variants v JOIN intervals i ON i.chr = v.chr AND v.bp - 1 >= i.start0 AND v.bp - 1 < i.end0")
def paint_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paint_groups(_v(spark, sf_dir, "VARIANTS"), _v(spark, sf_dir, "INTERVALS"), "grp").select("snp", "grp")


_PAINTED = """
p AS (SELECT v.chr, v.local_idx, v.snp, n.score, n.weight FROM variants v JOIN numerics n ON n.chr = v.chr AND v.bp - 1 >= n.start0 AND v.bp - 1 < n.end0),
l AS (SELECT chr, local_idx, snp, 'score' AS name, score AS value FROM p UNION ALL  SELECT chr, local_idx, snp, 'weight', weight FROM p)
"""


@query(_PAINTED + "SELECT snp, name, value FROM l WHERE value <> 0")
def paint_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paint_values(_v(spark, sf_dir, "VARIANTS").select("snp", "chr", "bp"), _v(spark, sf_dir, "NUMERIC"), ["score", "weight"]).select("snp", "name", "value")


def _two_panels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    variants = _v(spark, sf_dir, "VARIANTS").select("chr", "local_idx", "bp")
    number = F.substring("grp", 2, 1).cast("int")
    binary = paint_groups(variants, _v(spark, sf_dir, "INTERVALS"), "grp").select("chr", "local_idx", number.alias("anno_id"), F.lit(1.0).alias("value"))
    numeric = paint_values(variants, _v(spark, sf_dir, "NUMERIC"), ["score", "weight"])
    return binary, numeric.select("chr", "local_idx", F.when(F.col("name") == "score", 0).otherwise(1).alias("anno_id"), "value")


_PANEL = (
    _PAINTED.rstrip()
    + """,
b AS (SELECT DISTINCT v.chr, v.local_idx, substr(i.grp, 2, 1)::INTEGER AS anno_id FROM variants v JOIN intervals i ON i.chr = v.chr AND v.bp - 1 >= i.start0 AND v.bp - 1 < i.end0),
u AS (SELECT chr, local_idx, anno_id, 1.0::DOUBLE AS value FROM b UNION ALL  SELECT chr, local_idx, CASE name WHEN 'score' THEN 3 ELSE 4 END, value FROM l WHERE value <> 0)
"""
)


@query(_PANEL + "SELECT chr, local_idx, anno_id, value FROM u")
def annotation_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return append_columns(*_two_panels(spark, sf_dir), 3).select("chr", "local_idx", "anno_id", "value")


@query(_PANEL + "SELECT chr, local_idx, CASE anno_id WHEN 4 THEN 0 ELSE 1 END AS anno_id, value FROM u WHERE anno_id IN (4, 1)")
def annotation_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_columns(append_columns(*_two_panels(spark, sf_dir), 3), [4, 1]).select("chr", "local_idx", "anno_id", "value")


@query(_PANEL + "SELECT anno_id, bool_and(value = 1) AS is_binary FROM u GROUP BY anno_id")
def annotation_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer_binary(append_columns(*_two_panels(spark, sf_dir), 3))


@query("SELECT grp, count(*) AS n, min(row0) AS first, (row_number() OVER (ORDER BY min(row0)))::INTEGER - 1 AS anno_id FROM intervals GROUP BY grp")
def interval_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that groups become, in the order of their first rows."""
    rows = _v(spark, sf_dir, "INTERVALS")
    first = rows.groupBy("grp").agg(F.min("row0").alias("first"))
    return group_columns(rows, "grp").withColumnRenamed("group", "grp").join(first, "grp").select("grp", "n", "first", "anno_id")


# Genotypes ---------------------------------------------------------------------------------------------------


@query("SELECT chr, local_idx, count(*) FILTER (g >= 0) AS n_obs, round(sum(g) FILTER (g >= 0) / (2.0 * count(*) FILTER (g >= 0)), 9) AS a1freq FROM calls GROUP BY chr, local_idx")
def allele_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allele_frequency(_calls(spark, sf_dir)).select("chr", "local_idx", "n_obs", F.round("a1freq", 9).alias("a1freq"))


@query(
    """
w AS (SELECT chr, local_idx, g, sample_idx % 2 = 0 AS male FROM calls WHERE g >= 0 AND chr = 'X' AND NOT (sample_idx % 2 = 0 AND g = 1))
SELECT local_idx, count(*) AS n_obs, round(sum(CASE WHEN male THEN g / 2.0 ELSE g END) / sum(CASE WHEN male THEN 1 ELSE 2 END), 9) AS a1freq FROM w GROUP BY local_idx"""
)
def allele_freq_haploid(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _calls(spark, sf_dir).filter("chr = 'X'")
    return haploid_frequency(own, [1 if i % 2 == 0 else 2 for i in range(64)]).filter("n_obs > 0").select("local_idx", "n_obs", F.round("a1freq", 9).alias("a1freq"))


@query(
    """
f AS (SELECT chr, local_idx, avg(CASE WHEN g >= 1 THEN CASE WHEN k % 10 = 0 THEN 1.0 ELSE 0.0 END ELSE CASE WHEN k % 10 = 0 THEN 1.0 ELSE 0.5 END END) FILTER (g >= 0) AS a1freq FROM calls GROUP BY chr, local_idx)
SELECT chr, count(*) AS n FROM f WHERE a1freq IN (0.0, 1.0) GROUP BY chr"""
)
def monomorphic(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = F.transform("calls", lambda c: F.when(c < 0, c).when(F.col("k") % 10 == 0, 2).when(c >= 1, 0).otherwise(1).cast("tinyint"))
    f = allele_frequency(_calls(spark, sf_dir).withColumn("calls", fixed))
    return f.filter(is_monomorphic(F.col("a1freq"))).groupBy("chr").agg(F.count(F.lit(1)).alias("n"))


@query(
    """
SELECT chr, local_idx, sample_idx, CASE WHEN g < 0 THEN NULL ELSE g * CASE WHEN sample_idx % 3 = 2 THEN 2.0 ELSE CASE WHEN chr = 'X' THEN 1.0 ELSE 2.0 END END / 2 END AS value
FROM calls"""
)
def ploidy_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _calls(spark, sf_dir).select("chr", "local_idx", F.posexplode("calls").alias("at", "call")).withColumn("sample_idx", F.col("at").cast("long"))
    sex, male = (F.col("sample_idx") % 3).cast("int"), F.when(F.col("chr") == "X", 1.0).otherwise(2.0)
    return long.select("chr", "local_idx", "sample_idx", ploidy_scaled(F.col("call"), sex, male, F.lit(2.0)).alias("value"))


@query(
    """
x AS (SELECT sample_idx, fid, iid, father_id, mother_id, CASE WHEN sample_idx % 50 = 0 THEN 1 ELSE sex END AS sex FROM samples),
p AS (SELECT * FROM samples WHERE sample_idx % 40 <> 1)
SELECT x.sample_idx, coalesce(p.sample_idx, -1) AS panel_idx, CASE WHEN p.iid IS NULL THEN 'absent' WHEN x.sex <> p.sex THEN 'differs' ELSE 'ok' END AS status
FROM x LEFT JOIN p ON x.fid = p.fid AND x.iid = p.iid"""
)
def chrx_subject_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _v(spark, sf_dir, "SAMPLES")
    own = samples.withColumn("sex", F.when(F.col("sample_idx") % 50 == 0, 1).otherwise(F.col("sex")))
    return map_subjects(own, samples.filter("sample_idx % 40 <> 1")).select("sample_idx", F.coalesce("panel_idx", F.lit(-1).cast("long")).alias("panel_idx"), "status")


@query("SELECT v.snp, 63 - c.sample_idx AS sample_idx, c.g::TINYINT AS call FROM variants v JOIN calls c ON c.chr = v.chr AND c.local_idx = v.local_idx WHERE v.local_idx >= 0")
def calls_by_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of the variants that have some, on an axis of samples that is turned round."""
    variants = _v(spark, sf_dir, "VARIANTS").select("chr", "local_idx", "snp")
    found = variants.join(select_samples(_calls(spark, sf_dir).select("chr", "local_idx", "calls"), list(range(63, -1, -1))), ["chr", "local_idx"])
    return found.select("snp", F.posexplode("calls").alias("at", "call")).select("snp", F.col("at").cast("long").alias("sample_idx"), "call")


# Linkage disequilibrium --------------------------------------------------------------------------------------

_PAIRS = f"""
pr AS (
  SELECT a.chr, a.local_idx AS i, b.local_idx AS j, corr(a.g, b.g) AS r
  FROM calls a JOIN calls b ON a.chr = b.chr AND a.sample_idx = b.sample_idx AND b.local_idx > a.local_idx AND b.bp - a.bp <= {int(WINDOW_KB * 1000)}
  WHERE a.g >= 0 AND b.g >= 0 GROUP BY a.chr, a.local_idx, b.local_idx
),
pairs AS (SELECT chr, i, j, r FROM pr WHERE r * r >= {LEAST_R2}),
axis AS (SELECT DISTINCT chr, local_idx, bp, k FROM calls),
ld AS (
  SELECT chr, i, j, r::FLOAT AS r FROM pairs UNION ALL  SELECT chr, j, i, r::FLOAT FROM pairs UNION ALL  SELECT chr, local_idx, local_idx, 1::FLOAT FROM axis
)
"""


def _ld(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Blocks of correlations of the calls, and the calls as the axis."""
    axis = _calls(spark, sf_dir)
    return stored(build_blocks(axis, WINDOW_KB, LEAST_R2), "ld"), axis


@query(_PAIRS + "SELECT chr, i, j, round(r::FLOAT::DOUBLE, 6) AS r FROM pairs")
def ld_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_of(_ld(spark, sf_dir)[0]).select("chr", "i", "j", F.round(F.col("r").cast("double"), 6).alias("r"))


@query(_PAIRS + "SELECT chr, count(*) AS nnz, count(*) FILTER (i = j) AS diagonal, count(*) FILTER (i < j) AS upper FROM ld GROUP BY chr")
def ld_symmetrize(spark: SparkSession, sf_dir: str) -> DataFrame:
    ld = rows_of(*_ld(spark, sf_dir))
    return ld.groupBy("chr").agg(F.count(F.lit(1)).alias("nnz"), F.count_if(F.col("i") == F.col("j")).alias("diagonal"), F.count_if(F.col("i") < F.col("j")).alias("upper"))


@query(
    _PAIRS.rstrip()
    + """,
w AS (SELECT chr, i, j, r FROM ld WHERE (i * 7 + j) % 31 <> 5)
SELECT w.chr, count(*) AS nnz, count(*) FILTER (o.r IS NULL) AS asymmetric, count(*) FILTER (w.i = w.j AND abs(w.r - 1) > 1e-6) AS bad_diagonal, count(*) FILTER (abs(w.r) > 1 + 1e-6) AS beyond
FROM w LEFT JOIN w o ON w.chr = o.chr AND w.i = o.j AND w.j = o.i GROUP BY w.chr"""
)
def ld_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ld = rows_of(*_ld(spark, sf_dir))
    return validation(ld.filter("(i * 7 + j) % 31 <> 5"))  # some rows are gone, so that there is something to find


@query(_PAIRS + "SELECT l.chr, l.i AS local_idx, round(sum((l.r * l.r) * (a.k % 10)::DOUBLE), 4) AS value FROM ld l JOIN axis a ON l.chr = a.chr AND l.j = a.local_idx GROUP BY l.chr, l.i")
def ld_multiply(spark: SparkSession, sf_dir: str) -> DataFrame:
    ld, axis = _ld(spark, sf_dir)
    matrix = axis.select("chr", "local_idx", F.lit("v").alias("name"), (F.col("k") % 10).cast("double").alias("value"))
    return multiply_r2(ld, matrix, axis).select("chr", "local_idx", F.round("value", 4).alias("value"))


@query(
    _PAIRS.rstrip()
    + """,
f AS (SELECT chr, local_idx, sum(g) / (2.0 * count(*)) AS f FROM calls WHERE g >= 0 GROUP BY chr, local_idx),
m AS (
  SELECT DISTINCT a.chr, a.local_idx, i.grp AS name, 2 * f.f * (1 - f.f) AS value FROM axis a JOIN f ON a.chr = f.chr AND a.local_idx = f.local_idx
  JOIN intervals i ON i.chr = a.chr AND a.bp - 1 >= i.start0 AND a.bp - 1 < i.end0
),
s AS (SELECT l.chr, l.i AS local_idx, m.name, sum((l.r * l.r) * m.value) AS value FROM ld l JOIN m ON l.chr = m.chr AND l.j = m.local_idx GROUP BY l.chr, l.i, m.name)
SELECT a.chr, a.local_idx, n.name, round(coalesce(s.value, 0) / 3, 5) AS value FROM axis a CROSS JOIN (SELECT DISTINCT name FROM m) n
LEFT JOIN s ON s.chr = a.chr AND s.local_idx = a.local_idx AND s.name = n.name"""
)
def ld_weighted_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    ld, axis = _ld(spark, sf_dir)
    painted = paint_groups(allele_frequency(axis).drop("calls"), _v(spark, sf_dir, "INTERVALS"), "grp")
    matrix = painted.select("chr", "local_idx", F.col("grp").alias("name"), (2 * F.col("a1freq") * (1 - F.col("a1freq"))).alias("value"))
    return multiply_r2(ld, matrix, axis).select("chr", "local_idx", "name", F.round(F.col("value") / 3, 5).alias("value"))


def _sql_prune(score: str, by: str = "chr") -> str:
    """One by one in the order of scores, in each shard at once: place n of every shard in the n-th step."""
    return (
        _PAIRS.rstrip()
        + f""",
sc AS (SELECT chr, local_idx, k, {score} AS score FROM axis),
nb AS (SELECT chr, i, list(j) AS nbrs FROM ld WHERE i <> j AND (r * r) >= 0.05::FLOAT GROUP BY chr, i),
rk AS (
  SELECT sc.chr, sc.local_idx, coalesce(nb.nbrs, []) AS nbrs, row_number() OVER (PARTITION BY sc.chr ORDER BY abs(score) DESC, sc.local_idx) AS n
  FROM sc LEFT JOIN nb ON nb.chr = sc.chr AND nb.i = sc.local_idx WHERE isfinite(score)
),
steps AS (
  SELECT DISTINCT chr, 0::BIGINT AS n, []::BIGINT[] AS kept FROM rk
  UNION ALL
  SELECT s.chr, s.n + 1, CASE WHEN list_has_any(s.kept, rk.nbrs) THEN s.kept ELSE list_append(s.kept, rk.local_idx) END
  FROM steps s JOIN rk ON rk.chr = s.chr AND rk.n = s.n + 1
),
ended AS (SELECT chr, arg_max(kept, n) AS kept FROM steps GROUP BY chr),
pruned AS (
  SELECT sc.chr, sc.local_idx, CASE WHEN list_contains(e.kept, sc.local_idx) THEN score WHEN list_has_any(e.kept, coalesce(nb.nbrs, [])) THEN NULL ELSE score END AS score
  FROM sc LEFT JOIN ended e ON e.chr = sc.chr LEFT JOIN nb ON nb.chr = sc.chr AND nb.i = sc.local_idx
)
"""
    )


_SCORE_SQL = "CASE WHEN k % 41 = 0 THEN 'inf'::DOUBLE ELSE (k * 7919 % 1000)::DOUBLE / 10 END"


def _scores(axis: DataFrame) -> DataFrame:
    score = F.when(F.col("k") % 41 == 0, float("inf")).otherwise((F.col("k") * 7919 % 1000).cast("double") / 10)
    return axis.select("chr", "local_idx", score.alias("score"))


@query(_sql_prune(_SCORE_SQL) + "SELECT chr, local_idx, score FROM pruned")
def ld_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    ld, axis = _ld(spark, sf_dir)
    return fast_prune(_scores(axis), ld, 0.05)


@query(
    _sql_prune("(k * 104729 % 997)::DOUBLE").rstrip()
    + """,
mask AS (SELECT chr, local_idx, CASE WHEN score IS NULL THEN 0.0 ELSE 1.0 END AS value FROM pruned),
sums AS (SELECT l.chr, l.i AS local_idx, sum((l.r * l.r) * m.value) AS value FROM ld l JOIN mask m ON l.chr = m.chr AND l.j = m.local_idx GROUP BY l.chr, l.i)
SELECT m.chr, m.local_idx, round(1 / s.value, 5) AS weight FROM mask m JOIN sums s ON m.chr = s.chr AND m.local_idx = s.local_idx WHERE m.value = 1"""
)
def prune_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    ld, axis = _ld(spark, sf_dir)
    kept = fast_prune(axis.select("chr", "local_idx", (F.col("k") * 104729 % 997).cast("double").alias("score")), ld, 0.05)
    mask = kept.select("chr", "local_idx", F.lit("mask").alias("name"), F.when(F.col("score").isNull(), 0.0).otherwise(1.0).alias("value"))
    sums = multiply_r2(ld, mask, axis).select("chr", "local_idx", F.col("value").alias("total"))
    return mask.filter("value = 1").join(sums, ["chr", "local_idx"]).select("chr", "local_idx", F.round(1 / F.col("total"), 5).alias("weight"))


@query(
    _sql_prune(_SCORE_SQL).rstrip()
    + """
SELECT p.chr, p.local_idx, c.sample_idx, c.g::TINYINT AS call FROM pruned p JOIN variants v ON v.chr = p.chr AND v.local_idx = p.local_idx
JOIN calls c ON c.chr = p.chr AND c.local_idx = p.local_idx WHERE p.score IS NOT NULL"""
)
def prune_and_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    ld, axis = _ld(spark, sf_dir)
    kept = fast_prune(_scores(axis), ld, 0.05).filter("score IS NOT NULL")
    present = kept.join(_v(spark, sf_dir, "VARIANTS").select("chr", "local_idx"), ["chr", "local_idx"], "left_semi")
    found = present.join(axis.select("chr", "local_idx", "calls"), ["chr", "local_idx"])
    return found.select("chr", "local_idx", F.posexplode("calls").alias("at", "call")).select("chr", "local_idx", F.col("at").cast("long").alias("sample_idx"), "call")



def _sql_iterations(sql: str, n_iter: int) -> str:
    """The pruning of every iteration, each as shards of its own."""
    copies = f"""
its AS (SELECT unnest(range(1, {n_iter + 1})) AS it),
axis2 AS (SELECT concat(it, '/', chr) AS chr, local_idx, k, it FROM axis CROSS JOIN its),
ld2 AS (SELECT concat(it, '/', chr) AS chr, i, j, r FROM ld CROSS JOIN its),
sc AS ("""
    return sql.replace("\nsc AS (", copies, 1).replace("AS score FROM axis)", "AS score FROM axis2)").replace("FROM ld WHERE i <> j", "FROM ld2 WHERE i <> j")


@query(
    _sql_iterations(_sql_prune("((k * 104729 + it * 7919) % 10007)::DOUBLE"), ITERATIONS)
    + f"SELECT split_part(chr, '/', 2) AS chr, local_idx, count(score) / {ITERATIONS}.0::DOUBLE AS frequency FROM pruned GROUP BY split_part(chr, '/', 2), local_idx"
)
def random_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    ld, axis = _ld(spark, sf_dir)
    return prune_frequency(axis, ld, lambda n: (F.col("k") * 104729 + n * 7919) % 10007, ITERATIONS, 0.05)
