"""Linkage-disequilibrium panels: correlations of each shard, by sex on X, with allele frequencies and a manifest."""

from __future__ import annotations

import json
import logging
import warnings
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.contigs import CHRX_SEXES, CONTIGS, check_request
from helixframe.genotype import GenotypePanel
from helixframe.operators.blocks import NAMES, SIZE, block_faults, blocks_of, build_blocks, multiply_r2, rows_of
from helixframe.operators.linkage import TOLERANCE, allele_frequency, check_pairs, fast_prune, is_monomorphic, select_samples
from helixframe.reference import ReferencePanel, load_reference_cache
from helixframe.sources.plink import read_bed, unpack_calls
from helixframe.sources.text import write_lines
from helixframe.tables import SMALL_GROUPS, stored

_LOG = logging.getLogger("helixframe")
_verbosity = "info"


def set_verbosity(level: str) -> None:
    """quiet silences the progress of load_ld."""
    global _verbosity
    if level not in ("quiet", "info"):
        raise ValueError("verbosity must be quiet or info")
    _verbosity = level


def get_verbosity() -> str:
    return _verbosity


def check_sex(label: str, sex: str | None) -> None:
    if (label == "X") != (sex is not None) or (sex is not None and sex not in CHRX_SEXES):
        raise ValueError(f"shard {label!r}: sex must be one of {', '.join(CHRX_SEXES)} on X and none elsewhere")


@dataclass(frozen=True)
class LDPanel:
    """blocks: sex and the columns of `operators.blocks`. freq: chr, sex, local_idx, a1freq."""

    reference: ReferencePanel
    blocks: DataFrame
    freq: DataFrame
    default_chrx_sex: str = "female"
    sexes: tuple[str, ...] = ("female",)

    def summary(self) -> str:
        size = sum(n for _, n, _ in self.reference.described_shards)
        return f"<LDPanel: {size} variants across {len(self.reference.labels)} shard group(s): {', '.join(self.reference.labels)}>"

    @property
    def r(self) -> DataFrame:
        """(chr, sex, i, j, r) of both triangles and the unit diagonal, as rows."""
        found = None
        for sex in (None, *self.sexes):
            mine = F.col("sex").eqNullSafe(F.lit(sex).cast("string"))
            axis = self.reference.variants.filter(F.col("chr") != "X" if sex is None else F.col("chr") == "X")
            one = rows_of(self.blocks.filter(mine), axis).select("chr", F.lit(sex).cast("string").alias("sex"), "i", "j", "r")
            found = one if found is None else found.unionByName(one)
        return found

    def _of_sex(self, df: DataFrame, sex: str | None) -> DataFrame:
        sex = self.default_chrx_sex if sex is None else sex
        if "X" in self.reference.labels and sex not in self.sexes:
            raise ValueError(f"no shard X of sex {sex!r}; there are {', '.join(self.sexes)}")
        return df.filter((F.col("chr") != "X") | (F.col("sex") == sex)).drop("sex")

    def a1freq(self, chrx_sex: str | None = None) -> DataFrame:
        """(snp_idx, a1freq) on the panel's axis."""
        own = self._of_sex(self.freq, chrx_sex)
        return self.reference.indexed().select("chr", "local_idx", "snp_idx").join(own, ["chr", "local_idx"]).select("snp_idx", "a1freq")

    def multiply_r2(self, matrix: DataFrame, chrx_sex: str | None = None) -> DataFrame:
        return multiply_r2(self._of_sex(self.blocks, chrx_sex), matrix, self.reference.variants)

    def fast_prune(self, scores: DataFrame, threshold: float = 0.2, chrx_sex: str | None = None) -> DataFrame:
        return fast_prune(scores, self._of_sex(self.blocks, chrx_sex), threshold)

    def select_shards(self, labels: Sequence[str]) -> LDPanel:
        wanted = check_request(labels, self.reference.labels, "LDPanel.select_shards")
        keep = F.col("chr").isin(wanted)
        return LDPanel(self.reference.select_shards(wanted), self.blocks.filter(keep), self.freq.filter(keep), self.default_chrx_sex, self.sexes)


def ld_manifest(panel: LDPanel) -> DataFrame:
    """(chr, sex, num_snp, nnz, num_monomorphic_snps, reference_checksum) by shard."""
    size = panel.blocks.groupBy("chr", "sex").agg((2 * F.sum(F.size("r"))).alias("nnz"), F.lit(0).cast("long").alias("mono"))
    mono = panel.freq.groupBy("chr", "sex").agg(F.lit(0).cast("long").alias("nnz"), F.count_if(is_monomorphic(F.col("a1freq"))).alias("mono"))
    both = size.unionByName(mono).groupBy("chr", "sex").agg(F.sum("nnz").alias("nnz"), F.sum("mono").alias("num_monomorphic_snps"))
    shards = panel.reference.shards().select("chr", "num_snp", F.col("checksum").alias("reference_checksum"))
    joined = both.join(F.broadcast(shards), "chr")
    return joined.select("chr", "sex", "num_snp", (F.col("nnz") + F.col("num_snp")).alias("nnz"), "num_monomorphic_snps", "reference_checksum")


def save_ld(panel: LDPanel, path: str, build: dict | None = None) -> None:
    """Parquet by shard and sex, the reference, and a manifest; nothing that is there is overwritten."""
    panel.blocks.write.mode("errorifexists").options(**SMALL_GROUPS).partitionBy("chr", "sex").parquet(f"{path}/blocks")
    panel.freq.write.mode("errorifexists").partitionBy("chr", "sex").parquet(f"{path}/freq")
    panel.reference.save(f"{path}/reference")
    order = F.array_position(F.array(*(F.lit(c) for c in CONTIGS)), F.col("chr"))
    ranked = ld_manifest(panel).withColumn("build", F.lit(json.dumps(build or {}, sort_keys=True))).orderBy(order, F.array_position(F.array(*(F.lit(s) for s in CHRX_SEXES)), F.coalesce("sex", F.lit(""))))
    ranked.coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")


#: Stored columns; a panel without a single correlation has no file that would tell them.
_BLOCKS = "bi int, bj int, i array<smallint>, j array<smallint>, r array<float>, chr string, sex string"
_FREQ = "local_idx long, a1freq float, chr string, sex string"


def _read(spark: SparkSession, path: str, shards: Sequence[str] | None, schema: str) -> DataFrame:
    df = spark.read.schema(schema).parquet(path).withColumns({"chr": F.col("chr").cast("string"), "sex": F.col("sex").cast("string")})
    return df if shards is None else df.filter(F.col("chr").isin(list(shards)))


def load_ld_reference(spark: SparkSession, path: str, shards: Sequence[str] | None = None) -> ReferencePanel:
    return load_reference_cache(spark, f"{path}/reference", shards)


def load_ld(spark: SparkSession, path: str, shards: Sequence[str] | None = None, default_chrx_sex: str = "female") -> LDPanel:
    """Checks the manifest against the reference; correlations of other shards are not read."""
    if default_chrx_sex not in CHRX_SEXES:
        raise ValueError(f"default_chrx_sex must be one of {', '.join(CHRX_SEXES)}")
    reference = load_ld_reference(spark, path, shards)
    rows = [r for r in spark.read.json(f"{path}/manifest").collect() if r["chr"] in reference.labels]
    own = {r["chr"]: r for r in reference.shards().collect()}
    sexes = []
    for r in rows:
        sex = r.asDict().get("sex")
        check_sex(r["chr"], sex)
        if (r["num_snp"], r["reference_checksum"]) != (own[r["chr"]]["num_snp"], own[r["chr"]]["checksum"]):
            raise ValueError(f"{path}: shard {r['chr']!r} is not that of the reference")
        if r["num_monomorphic_snps"]:
            warnings.warn(f"{path}: shard {r['chr']!r} has {r['num_monomorphic_snps']} monomorphic variants", RuntimeWarning, stacklevel=2)
        sexes += [sex] if sex else []
        if _verbosity == "info":
            _LOG.info("%s: shard %s %s, %d correlations", path, r["chr"], sex or "", r["nnz"])
    if missing := [k for k in reference.labels if k not in {r["chr"] for r in rows}]:
        raise ValueError(f"{path}: no shard {missing[0]!r}")
    if "X" in reference.labels and default_chrx_sex not in sexes:
        raise ValueError(f"no shard X of sex {default_chrx_sex!r}; there are {', '.join(sexes)}")
    return LDPanel(reference, _read(spark, f"{path}/blocks", shards, _BLOCKS), _read(spark, f"{path}/freq", shards, _FREQ), default_chrx_sex, tuple(sexes))


def validate_ld(panel: LDPanel) -> None:
    """Raises for values beyond 1 or of no pair of variants, or frequencies out of [0, 1]. Blocks are symmetric with a unit diagonal as they are laid out."""
    by = panel.blocks.withColumn("chr", F.concat_ws("/", "chr", "sex"))
    for r in block_faults(by).collect():
        if r["misplaced"] or r["beyond"]:
            raise ValueError(f"shard {r['chr']}: {r['misplaced']} entries out of place and {r['beyond']} values beyond 1 (tolerance {TOLERANCE})")
    last = panel.reference.variants.groupBy("chr").agg(F.max("local_idx").alias("last"))
    ends = panel.blocks.groupBy("chr").agg(F.max(F.struct("bj", F.array_max("j").alias("j"))).alias("end")).join(last, "chr", "left")
    if bad := ends.filter(F.col("last").isNull() | (F.col("end.bj").cast("long") * SIZE + F.col("end.j") > F.col("last"))).limit(1).collect():
        raise ValueError(f"shard {bad[0]['chr']}: correlations of variants that the reference doesn't have")
    if bad := panel.freq.filter("a1freq IS NULL OR isnan(a1freq) OR a1freq < 0 OR a1freq > 1").limit(1).collect():
        raise ValueError(f"shard {bad[0]['chr']}: a frequency is out of [0, 1]")


def build_ld(reference: ReferencePanel, calls: DataFrame, window_kb: float = 10_000, least_r2: float = 0.05, allow_monomorphic: bool = False, sexes: dict[str, list[int]] | None = None) -> LDPanel:
    """calls: chr, local_idx, calls (array by sample). sexes: for each sex of X, the places of its samples.

    Frequencies come first, so that monomorphic variants stop the build before the pairs.
    """
    if least_r2 < 0:
        raise ValueError("least_r2 must not be negative")
    placed = reference.variants.select("chr", "local_idx", "bp").join(calls, ["chr", "local_idx"])
    parts = [(None, placed.filter("chr <> 'X'"))]
    if "X" in reference.labels:
        if not sexes or any(not places for places in sexes.values()):
            raise ValueError("X wants samples of each sex")
        for sex, places in sexes.items():
            check_sex("X", sex)
            parts.append((sex, select_samples(placed.filter("chr = 'X'"), places)))
    freq = blocks = None
    for sex, own in parts:
        f = allele_frequency(own).select("chr", F.lit(sex).cast("string").alias("sex"), "local_idx", F.col("a1freq").cast("float").alias("a1freq"))
        freq = f if freq is None else freq.unionByName(f)
    if not allow_monomorphic and (n := freq.filter(is_monomorphic(F.col("a1freq"))).count()):
        raise ValueError(f"{n} variants are monomorphic")
    for sex, own in parts:
        one = build_blocks(own, window_kb, least_r2).withColumn("sex", F.lit(sex).cast("string"))
        blocks = one if blocks is None else blocks.unionByName(one)
    found = tuple(sexes or ())
    return LDPanel(reference, stored(blocks.select(*NAMES, "sex"), "ld-blocks"), freq, "female" if "female" in found or not found else found[0], found)


def build_ld_from_genotype(panel: GenotypePanel, window_kb: float = 10_000, least_r2: float = 0.05, allow_monomorphic: bool = False, chrx_sexes: Sequence[str] = ("female", "male")) -> LDPanel:
    """From the BED files of a panel: its variants that are there, on the panel's own axis.

    X is built for females and males apart, which wants the sex of every sample, or for the sexes that are asked for; combined is all samples as one.
    """
    spark = panel.mapped.sparkSession
    present = panel.mapped.filter("source_row0 IS NOT NULL").select("chr", "local_idx", "source_row0")
    if missing := panel.mapped.filter("source_row0 IS NULL").limit(1).collect():
        raise ValueError(f"variant {missing[0]['snp_idx']} is not in the genotype source")
    calls = None
    for source in {panel.sources[k] for k in panel.reference.labels}:
        labels = [k for k in panel.reference.labels if panel.sources[k] == source]
        rows = unpack_calls(read_bed(spark, source.path, source.n_sample, source.n_snp), source.n_sample)
        own = present.filter(F.col("chr").isin(labels)).join(rows, "source_row0").select("chr", "local_idx", "calls")
        calls = own if calls is None else calls.unionByName(own)
    calls = stored(calls, "ld-calls")  # read from the BED files once
    sexes = None
    if "X" in panel.reference.labels:
        on_x = panel.subjects.filter("chr = 'X'").join(panel.samples.select("sample_idx", "sex"), "sample_idx")
        if set(chrx_sexes) - {"combined"}:
            for r in on_x.filter("sex = 0").orderBy("place").limit(1).collect():
                raise ValueError(f"sample {r['sample_idx']} on X has no sex; only a combined shard can be built")
        code = {"male": [1], "female": [2], "combined": [0, 1, 2]}
        places = {s: [r["place"] for r in on_x.filter(F.col("sex").isin(code[s])).select("place").orderBy("place").collect()] for s in chrx_sexes}
        sexes = places  # numbers of samples: no larger than one row of calls
    return build_ld(panel.reference, calls, window_kb, least_r2, allow_monomorphic, sexes)


def panel_from_pairs(reference: ReferencePanel, pairs: DataFrame, freq: DataFrame, sexes: Sequence[str] = ()) -> LDPanel:
    """pairs: chr, sex, i, j, r of one triangle; freq: chr, sex, local_idx, a1freq."""
    blocks = None
    for sex in (None, *sexes):
        mine = F.col("sex").isNull() if sex is None else F.col("sex") == sex
        axis = reference.variants.filter("chr <> 'X'" if sex is None else "chr = 'X'")
        own = pairs.filter(mine).drop("sex")
        check_pairs(own, axis)
        upper = own.select("chr", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "r")
        one = blocks_of(upper).withColumn("sex", F.lit(sex).cast("string"))
        blocks = one if blocks is None else blocks.unionByName(one)
    return panel_from_blocks(reference, stored(blocks.select(*NAMES, "sex"), "ld-blocks"), freq, sexes)


def panel_from_blocks(reference: ReferencePanel, blocks: DataFrame, freq: DataFrame, sexes: Sequence[str] = ()) -> LDPanel:
    """blocks: as the panel has them; freq: chr, sex, local_idx, a1freq."""
    if bad := freq.filter("a1freq IS NULL OR isnan(a1freq) OR a1freq < 0 OR a1freq > 1").limit(1).collect():
        raise ValueError(f"shard {bad[0]['chr']}: frequency {bad[0]['a1freq']} of variant {bad[0]['local_idx']} is out of [0, 1]")
    freq = freq.withColumn("a1freq", F.col("a1freq").cast("float"))
    return LDPanel(reference, blocks, freq, "female" if "female" in sexes or not sexes else sexes[0], tuple(sexes))


def write_bim(variants: DataFrame, path: str) -> None:
    """Variants of one shard as BIM text, in order."""
    lines = variants.select("local_idx", F.concat_ws("\t", "chr", "snp", F.lit("0"), "bp", "a1", "a2").alias("value"))
    write_lines(lines, ["local_idx"], path)


def write_monomorphic(panel: LDPanel, path: str) -> bool:
    """A table of monomorphic variants, if there are any."""
    found = panel.freq.filter(is_monomorphic(F.col("a1freq"))).join(panel.reference.variants, ["chr", "local_idx"])
    if found.isEmpty():
        return False
    found.select("chr", "sex", "snp", "bp", "a1", "a2", "a1freq").orderBy("chr", "sex", "bp").coalesce(1).write.csv(path, sep="\t", header=True)
    return True
