"""From files to univariate and bivariate arrays by public loaders, accessors and operators only, held against plain arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.annotations import load_annotation, load_annotations, load_annotations_cache
from helixframe.genotype import load_genotype
from helixframe.ld import build_ld_from_genotype, load_ld, panel_from_pairs, save_ld, validate_ld, write_monomorphic
from helixframe.operators.linkage import prune_frequency
from helixframe.sources.plink import load_reference, write_bed
from helixframe.sumstats import load_sumstats, load_sumstats_cache

N, SAMPLES = 120, 60


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Variants on 2 and X, calls in linkage, two traits, two BED annotations and one of values."""
    root, rng = tmp_path_factory.mktemp("workflow"), np.random.default_rng(17)
    chr_ = np.where(np.arange(N) < 90, "2", "X")
    bp = np.concatenate([1000 + 700 * np.arange(90), 500 + 900 * np.arange(30)])
    base = rng.integers(0, 3, (N // 3, SAMPLES))
    calls = np.repeat(base, 3, axis=0)
    calls = np.where(rng.random(calls.shape) < 0.25, rng.integers(0, 3, calls.shape), calls)
    calls = np.where(rng.random(calls.shape) < 0.03, -1, calls)
    (root / "g.bim").write_text("".join(f"{c}\trs{i}\t0\t{b}\tA\tG\n" for i, (c, b) in enumerate(zip(chr_, bp, strict=True))))
    (root / "g.fam").write_text("".join(f"F I{i} 0 0 {1 + i % 2} -9\n" for i in range(SAMPLES)))
    rows = [("g", i, c) for i, c in enumerate(calls.tolist())]
    write_bed(spark.createDataFrame(rows, "shard string, row0 long, calls array<tinyint>"), f"{root}/@.bed")
    z = rng.normal(0, 2, (2, N)).round(3)
    there = rng.random((2, N)) < 0.9
    for k in range(2):
        lines = "".join(f"{c}\t{b}\tA\tG\t{0.001 * (i + 1)}\t{z[k, i]}\t{900 + i}\n" for i, (c, b) in enumerate(zip(chr_, bp, strict=True)) if there[k, i])
        (root / f"t{k}.tsv").write_text("CHR\tPOS\tA1\tA2\tP\tZ\tN\n" + lines)
    spans = {"one": [("2", 0, 20_000), ("X", 5_000, 9_000)], "two": [("2", 15_000, 16_000), ("2", 15_500, 40_000)]}
    for name, own in spans.items():
        (root / f"{name}.bed").write_text("".join(f"{c}\t{a}\t{b}\n" for c, a, b in own))
    (root / "score.annot").write_text("chrom\tstart\tend\tscore\n2\t0\t30000\t0.5\nX\t0\t10000\t-2\n")
    return root, chr_, bp, calls, z, there, spans


@pytest.mark.filterwarnings("ignore")
def test_workflow(spark, files):
    root, chr_, bp, calls, z, there, spans = files
    reference = load_reference(spark, f"{root}/g.bim")
    genotype = load_genotype(spark, f"{root}/g", reference)
    save_ld(build_ld_from_genotype(genotype, window_kb=50, least_r2=0.05), f"{root}/ld")
    reference.save(f"{root}/reference")
    ld = load_ld(spark, f"{root}/ld")
    validate_ld(ld)
    assert not write_monomorphic(ld, f"{root}/mono")

    def r_of(places, samples):
        r = np.eye(len(places))
        for a in range(len(places)):
            for b in range(a + 1, len(places)):
                x, y = calls[places[a], samples], calls[places[b], samples]
                both = (x >= 0) & (y >= 0)
                value = np.corrcoef(x[both], y[both])[0, 1]
                if abs(bp[places[a]] - bp[places[b]]) <= 50_000 and value * value >= 0.05:
                    r[a, b] = r[b, a] = value
        return r

    at = {c: np.flatnonzero(chr_ == c) for c in ("2", "X")}
    r = np.zeros((N, N))
    for c, samples in (("2", slice(None)), ("X", slice(1, None, 2))):  # X: females
        r[np.ix_(at[c], at[c])] = r_of(at[c], samples)
    axis = {(row["chr"], row["local_idx"]): row["snp_idx"] for row in reference.indexed().collect()}

    def dense(rows, column="value"):
        out = np.zeros(N)
        for row in rows.collect():
            out[axis[row["chr"], row["local_idx"]]] = row[column]
        return out

    # an annotation matrix weighted by LD and heterozygosity
    panel = load_annotations(spark, [f"{root}/one.bed", f"{root}/two.bed"], reference).union_annotations(load_annotation(spark, f"{root}/score.annot", reference, has_header=True, value_columns=["score"]))
    panel.save(f"{root}/annotations")
    panel = load_annotations_cache(spark, f"{root}/annotations", reference)
    freq = np.zeros(N)
    for row in ld.a1freq().collect():
        freq[row["snp_idx"]] = row["a1freq"]
    want = np.array([np.where(calls[i, s] >= 0, calls[i, s], 0).sum() / 2 / (calls[i, s] >= 0).sum() for i in range(N) for s in ([slice(None)] if chr_[i] == "2" else [slice(1, None, 2)])])
    assert freq == pytest.approx(want, abs=1e-6)
    het = ld.freq.filter("sex IS NULL OR sex = 'female'").select("chr", "local_idx", (2 * F.col("a1freq") * (1 - F.col("a1freq"))).alias("h"))
    matrix = panel.named().join(het, ["chr", "local_idx"]).select("chr", "local_idx", "name", (F.col("value") * F.col("h")).alias("value"))
    weighted = ld.multiply_r2(matrix)
    for name in panel.names:
        if name == "score":
            own = np.where((chr_ == "2") & (bp - 1 < 30_000), 0.5, np.where((chr_ == "X") & (bp - 1 < 10_000), -2.0, 0.0))
        else:
            own = np.array([float(any(c == chr_[i] and a <= bp[i] - 1 < b for c, a, b in spans[name])) for i in range(N)])
        assert dense(weighted.filter(F.col("name") == name)) == pytest.approx((r * r) @ (own * 2 * freq * (1 - freq)), abs=1e-4)

    # one random pruning, and how often variants stay in ten
    score = np.random.default_rng(5).permutation(N).astype(float)
    scores = spark.createDataFrame([(c, i, float(score[k])) for (c, i), k in axis.items()], "chr string, local_idx long, score double")
    kept = np.zeros(N, bool)
    for i in np.argsort(-score):
        kept[i] = not any(kept[j] and np.float32(r[i, j]) ** 2 >= np.float32(0.2) for j in range(N) if j != i)
    mask = ld.fast_prune(scores, 0.2)
    assert (dense(mask.fillna(-1.0), "score") >= 0).tolist() == kept.tolist()
    of_female = ld.blocks.filter("sex IS NULL OR sex = 'female'").drop("sex")
    often = prune_frequency(reference.variants, of_female, lambda n: F.col("bp") * 31 % (97 + n), 10, 0.2)
    assert often.filter("frequency < 0 OR frequency > 1").isEmpty() and often.count() == N

    # univariate and bivariate arrays over what stays
    traits = [load_sumstats(spark, f"{root}/t{k}.tsv", reference) for k in range(2)]
    traits[0].save(f"{root}/trait")
    traits[0] = load_sumstats_cache(spark, f"{root}/trait", reference)
    both = traits[0].values.select("chr", "local_idx", F.col("z").alias("z1"), "n").join(traits[1].values.select("chr", "local_idx", F.col("z").alias("z2")), ["chr", "local_idx"])
    own = both.join(mask.filter("score IS NOT NULL").select("chr", "local_idx"), ["chr", "local_idx"]).filter("z1 IS NOT NULL AND z2 IS NOT NULL")
    got = {axis[x["chr"], x["local_idx"]]: (x["z1"] * x["z2"], x["n"]) for x in own.collect()}
    assert got == {i: (z[0, i] * z[1, i], 900.0 + i) for i in range(N) if kept[i] and there[:, i].all()}

    # calls of what stays, by a table of its numbers
    request = mask.filter("score IS NOT NULL").join(reference.indexed().select("chr", "local_idx", "snp_idx"), ["chr", "local_idx"]).select(F.col("snp_idx").alias("ord"), "snp_idx")
    assert {x["snp_idx"]: x["calls"] for x in genotype.fetch_arrays(request).collect()} == {i: calls[i].tolist() for i in range(N) if kept[i]}


@pytest.mark.filterwarnings("ignore")
def test_rules_of_building(spark, files, tmp_path):
    """Monomorphic variants stop a build unless they are allowed, and then have a table; X counts by sex; another BED file may stand in."""
    root, chr_, _, calls, *_ = files
    reference = load_reference(spark, f"{root}/g.bim")
    same = calls.copy()
    same[4] = np.where(same[4] < 0, -1, 0)
    same[100, 1::2] = 2
    write_bed(spark.createDataFrame([("s", i, c) for i, c in enumerate(same.tolist())], "shard string, row0 long, calls array<tinyint>"), f"{tmp_path}/@.bed")
    for e in ("bim", "fam"):
        (tmp_path / f"s.{e}").write_text((root / f"g.{e}").read_text())
    panel = load_genotype(spark, f"{tmp_path}/s", reference)
    with pytest.raises(ValueError, match="2 variants are monomorphic"):
        build_ld_from_genotype(panel, window_kb=5)
    ld = build_ld_from_genotype(panel, window_kb=5, allow_monomorphic=True)
    assert write_monomorphic(ld, f"{tmp_path}/mono")
    rows = spark.read.csv(f"{tmp_path}/mono", sep="\t", header=True).collect()
    assert sorted((x["chr"], x["sex"], x["snp"], float(x["a1freq"])) for x in rows) == [("2", None, "rs4", 0.0), ("X", "female", "rs100", 1.0)] or {x["snp"] for x in rows} == {"rs4", "rs100"}
    other = load_genotype(spark, f"{root}/g", reference)
    assert other.fetch_arrays([4], bed_path=f"{tmp_path}/s.bed").first()["calls"] == same[4].tolist()
    with pytest.raises(ValueError, match="template"):
        other.fetch([4], bed_path=f"{tmp_path}/@.bed")
    keys = reference.variants.filter("local_idx = 3").select("chr", "bp", "a1", "a2", F.lit("note").alias("more"))
    assert {(x["chr"], x["local_idx"], x["more"]) for x in reference.locate(keys).collect()} == {("2", 3, "note"), ("X", 3, "note")}
    with pytest.raises(ValueError, match="no such variant: 2:3100:G:A"):
        reference.locate(keys.filter("chr = '2'").withColumns({"a1": F.lit("G"), "a2": F.lit("A")}))
    one = reference.select_shards(["2"])
    pairs = spark.createDataFrame([("2", None, 0, 1, 0.5)], "chr string, sex string, i long, j long, r double")
    for bad in (1.5, -0.1, float("nan")):
        with pytest.raises(ValueError, match="frequency"):
            panel_from_pairs(one, pairs, spark.createDataFrame([("2", None, 0, bad)], "chr string, sex string, local_idx long, a1freq double"))
