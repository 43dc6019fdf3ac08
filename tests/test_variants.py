import math

import pytest
from pyspark.sql import functions as F

from helixframe.contigs import CONTIGS, check_request, chr_rank
from helixframe.functions.variants import allele_hash64, is_no_number, is_single_nucleotide, is_strand_ambiguous, neg_log10, number
from helixframe.operators.align import align, check_keys, swapped_counts
from helixframe.operators.intervals import overlapping, paint, paint_groups, paint_values, union_intervals
from helixframe.reference import ReferencePanel, panel_of, shard_checksums
from helixframe.sumstats import aligned_sumstats, completeness, create_sumstats, load_sumstats, load_sumstats_cache

VARIANTS = [
    ("1", 0, "rs1001", 100, "A", "G"), ("1", 1, "rs1002", 200, "C", "T"), ("1", 2, "rs1003", 300, "A", "C"), ("1", 3, "rs1004", 400, "G", "A"),
    ("1", 4, "rs1005", 500, "T", "C"), ("X", 0, "rsX001", 100, "A", "G"), ("X", 1, "rsX002", 200, "C", "T"), ("X", 2, "rsX003", 300, "A", "C"),
]
SCHEMA = "chr string, local_idx long, snp string, bp long, a1 string, a2 string"
SUMSTATS = [
    ("1", 100, "A", "G", 0.01, 2.5, 1000.0), ("1", 200, "C", "T", 0.5, 1.0, 950.0), ("1", 300, "A", "C", 0.0, 1.8, 1000.0), ("1", 400, "G", "A", 0.2, -1.2, 1000.0),
    ("X", 100, "A", "G", 0.003, 3.0, 500.0), ("X", 200, "C", "T", 0.6, 0.5, 500.0), ("9", 999, "A", "G", 0.3, 1.0, 1000.0),
]


@pytest.fixture(scope="module")
def panel(spark):
    return panel_of(spark.createDataFrame(VARIANTS, SCHEMA))


def by_axis(df, column):
    order = {(c, i): k for k, (c, i, *_) in enumerate(VARIANTS)}
    out = [None] * len(VARIANTS)
    for r in df.collect():
        out[order[r["chr"], r["local_idx"]]] = r[column]
    return out


def test_labels(spark):
    assert check_request(["1", "X"], ["1", "2", "X"], "t") == ["1", "X"]
    for bad in ([], ["X", "1"], ["1", "1"], ["3"], ["chr1"]):
        with pytest.raises(ValueError):
            check_request(bad, ["1", "2", "X"], "t")
    ranks = spark.createDataFrame([(c,) for c in (*CONTIGS, "Y", "chr1")], "c string").select(chr_rank(F.col("c"))).collect()
    assert [r[0] for r in ranks] == [*range(1, 24), None, None]


def test_hashes_and_masks(spark):
    known = {"A": 0x0000014300000149, "C": 0x000001450000014B, "G": 0x000001490000014F, "T": 0x000001560000015C, "ACGT": 0x47119B266503B322, "ATCGGCTA": 0x1A8AE73A00B4D922}
    df = spark.createDataFrame([(a,) for a in known], "a string").select("a", allele_hash64(F.col("a")).alias("h"))
    assert {r["a"]: r["h"] for r in df.collect()} == known
    pairs = [("A", "T"), ("C", "G"), ("A", "G"), ("AT", "A"), ("T", "A")]
    got = spark.createDataFrame(pairs, "x string, y string").select(is_single_nucleotide(F.col("x"), F.col("y")), is_strand_ambiguous(F.col("x"), F.col("y"))).collect()
    assert [tuple(r) for r in got] == [(True, True), (True, True), (True, False), (False, False), (True, True)]


def test_numbers(spark):
    df = spark.createDataFrame([("1e3",), ("NA",), ("",), ("abc",), (None,)], "t string").select(number(F.col("t")), is_no_number(F.col("t")))
    assert [tuple(r) for r in df.collect()] == [(1000.0, False), (None, False), (None, False), (None, True), (None, False)]
    logs = spark.createDataFrame([(0.0,), (1.0,), (0.01,), (-1.0,), (None,)], "p double").select(neg_log10(F.col("p"))).collect()
    assert [r[0] for r in logs] == [math.inf, 0.0, 2.0, None, None]



def test_shards(panel, spark, tmp_path):
    own = {r["chr"]: r for r in panel.shards().collect()}
    assert own["1"]["checksum"] == "65836be1a96bd52932672255c8c95d73" and own["X"]["checksum"] == "f7ce56a624f7994ed297cb0cd10ae39b"
    assert (own["X"]["start0"], own["X"]["stop0"]) == (5, 8)
    assert [r["snp_idx"] for r in panel.select_shards(["X"]).indexed().orderBy("snp_idx").collect()] == [0, 1, 2]
    shards = panel.shards()
    assert panel.is_object_compatible(shards) and panel.is_object_compatible(shards.withColumn("checksum", F.lit(None).cast("string")))
    assert not panel.is_object_compatible(shards.filter("chr = '1'")) and not panel.is_object_compatible(shards.withColumn("checksum", F.lit("0")))
    with pytest.raises(ValueError):
        panel.check_compatible(shards.withColumn("checksum", F.lit(None).cast("string")), "t")
    panel.save(str(tmp_path / "cache"))
    from helixframe.reference import load_reference_cache

    again = load_reference_cache(spark, str(tmp_path / "cache"))
    again.validate_checksums()
    assert again.described_shards == panel.described_shards and again.summary() == "<ReferencePanel: 8 variants across 2 shard(s): 1, X>"
    changed = ReferencePanel(again.variants.withColumn("a1", F.lit("T")), again.labels, again.known)
    assert changed.shards().filter("chr = '1'").first()["checksum"] == own["1"]["checksum"]  # what is stored is trusted
    with pytest.raises(ValueError, match="validate_checksums"):
        changed.validate_checksums()
    assert load_reference_cache(spark, str(tmp_path / "cache"), ["X"]).labels == ("X",)
    assert shard_checksums(again.variants).count() == 2


def test_alignment(spark, panel):
    source = spark.createDataFrame(SUMSTATS, "chr string, bp long, a1 string, a2 string, p double, z double, n double")
    values = aligned_sumstats(panel, source)
    logp = by_axis(values, "logp")
    assert [None if x is None else round(x, 5) for x in logp] == [2.0, 0.30103, math.inf, 0.69897, None, 2.52288, 0.22185, None]
    assert tuple(completeness(values).first()) == (6, 0, 0)
    swapped = source.withColumns({"a1": F.when(F.col("bp") == 200, F.col("a2")).otherwise(F.col("a1")), "a2": F.when(F.col("bp") == 200, F.col("a1")).otherwise(F.col("a2"))})
    assert {tuple(r) for r in swapped_counts(panel.variants, swapped).collect()} == {("1", 1), ("X", 1)}
    assert by_axis(align(panel.variants, swapped, ["p"]), "p")[1] is None
    with pytest.raises(ValueError):
        check_keys(source.union(source.limit(1)), "t")
    # beyond 150 characters alleles count as equal
    long = spark.createDataFrame([("1", 0, "r", 5, "A" * 160, "C")], SCHEMA)
    assert align(long, spark.createDataFrame([("1", 5, "A" * 150, "C", 0.5)], "chr string, bp long, a1 string, a2 string, p double"), ["p"]).first()["p"] == 0.5


HEADER = "CHR\tPOS\tEffectAllele\tOtherAllele\tP\tZ\tother\n"


@pytest.mark.parametrize("suffix", [".tsv", ".tsv.gz"])
def test_load_sumstats(spark, panel, tmp_path, suffix):
    import gzip

    rows = "".join(f"{c}\t{bp}\t{a}\t{b}\t{p}\t{'NA' if bp == 200 else z}\tx\n" for c, bp, a, b, p, z, _ in SUMSTATS) + "Y\t1\tA\tG\tjunk\t1\tx\n"
    path = tmp_path / f"s{suffix}"
    (gzip.open if suffix.endswith("gz") else open)(path, "wt").write(HEADER + rows)
    with pytest.warns(RuntimeWarning):
        got = load_sumstats(spark, str(path), panel)
    assert got.fields == ("z",) and by_axis(got.values, "z")[:4] == [2.5, None, 1.8, -1.2]
    assert by_axis(got.is_present(), "is_present") == [True, True, True, True, False, True, True, False]
    got.save(str(tmp_path / f"cache{suffix}"))
    again = load_sumstats_cache(spark, str(tmp_path / f"cache{suffix}"), panel, ["X"])
    assert got.summary() == "<Sumstats: 8 variants across 2 shard(s): 1, X>"
    with pytest.raises(ValueError, match="not that of the reference"):
        load_sumstats_cache(spark, str(tmp_path / f"cache{suffix}"), panel_of(panel.variants.filter("snp <> 'rs1003'")))
    assert again.labels == ("X",) and again.fields == ("z",) and again.values.count() == 3


@pytest.mark.parametrize("row", ["1\t100\tA\tG\t-0.1\t1\tx", "1\t100\tA\tG\t1.1\t1\tx", "1\t100\tA\tG\t\t1\tx", "1\t100\tA\tG\tNaN\t1\tx", "1\t100\tA\tG\tInf\t1\tx", "chr1\t100\tA\tG\t0.1\t1\tx", "1\t100\tA\tA\t0.1\t1\tx", "1\t1.5\tA\tG\t0.1\t1\tx", "1\t100\tA\tN\t0.1\t1\tx", "1\t100\tA\tG\t0.1\tabc\tx", "30\t100\tA\tG\t0.1\t1\tx"])
def test_bad_sumstats(spark, panel, tmp_path, row):
    path = tmp_path / "s.tsv"
    path.write_text(HEADER + row + "\n")
    with pytest.raises(ValueError):
        load_sumstats(spark, str(path), panel)


def test_create_sumstats(spark, panel):
    rows = [(i, p, z) for i, (p, z) in enumerate([(0.1, 1.0), (0.0, float("nan")), (1.0, 2.0), (0.5, 0.0), (0.2, 1.0), (0.3, 1.0), (0.4, 1.0), (0.9, 1.0)])]
    df = spark.createDataFrame(rows, "snp_idx long, p double, z double")
    got = create_sumstats(panel, df)
    assert by_axis(got.values, "z")[1] is None and by_axis(got.values, "logp")[:3] == [1.0, math.inf, 0.0]
    for bad in (df.limit(7), df.union(df.limit(1)), df.withColumn("p", F.lit(2.0)), df.withColumn("z", F.lit(math.inf))):
        with pytest.raises(ValueError):
            create_sumstats(panel, bad)


def test_intervals(spark, panel):
    rows = [("1", 99, 150), ("1", 120, 200), ("1", 299, 350), ("1", 350, 400), ("1", 499, 500)]
    df = spark.createDataFrame(rows, "chr string, start0 long, end0 long")
    for width in (10, 1 << 16):
        assert sorted((r["start0"], r["end0"]) for r in union_intervals(df, width=width).collect()) == [(99, 200), (299, 400), (499, 500)]
        assert sorted(r["snp"] for r in paint(panel.variants, df, width).collect()) == ["rs1001", "rs1002", "rs1003", "rs1004", "rs1005"]
    assert [(r["start0"], r["end0"]) for r in overlapping(df).collect()] == [(120, 200)]
    edge = spark.createDataFrame([("1", 99, 100), ("1", 199, 199), ("1", 399, 400), ("1", 500, 501)], "chr string, start0 long, end0 long")
    assert sorted(r["snp"] for r in paint(panel.variants, edge, 64).collect()) == ["rs1001", "rs1004"]
    grouped = spark.createDataFrame([("1", 99, 200, "coding"), ("1", 150, 350, "regulatory"), ("1", 299, 400, "coding"), ("X", 99, 301, "regulatory")], "chr string, start0 long, end0 long, g string")
    got = {(r["snp"], r["g"]) for r in paint_groups(panel.variants, grouped, "g", 32).collect()}
    assert {s for s, g in got if g == "coding"} == {"rs1001", "rs1002", "rs1003", "rs1004"}
    assert {s for s, g in got if g == "regulatory"} == {"rs1002", "rs1003", "rsX001", "rsX002", "rsX003"}
    numeric = spark.createDataFrame([("1", 99, 200, 0.5, 0.0), ("1", 299, 400, -1.25, 0.75), ("X", 99, 301, 2.0, 3.5)], "chr string, start0 long, end0 long, score double, weight double")
    values = {(r["snp"], r["name"]): r["value"] for r in paint_values(panel.variants.select("snp", "chr", "bp"), numeric, ["score", "weight"]).collect()}
    assert values["rs1001", "score"] == 0.5 and ("rs1001", "weight") not in values and values["rs1004", "weight"] == 0.75 and ("rs1005", "score") not in values


def test_random_paint_is_that_of_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    variants = [("1" if k % 3 else "X", k, f"s{k}", int(bp), "A", "C") for k, bp in enumerate(rng.integers(1, 3000, 400))]
    starts = rng.integers(0, 3000, 120)
    rows = [("1" if k % 2 else "X", int(s), int(s + w)) for k, (s, w) in enumerate(zip(starts, rng.integers(0, 60, 120), strict=True))]
    df = spark.createDataFrame(rows, "chr string, start0 long, end0 long")
    v = spark.createDataFrame(variants, SCHEMA)
    want = {s for c, _, s, bp, *_ in variants if any(c == k and a <= bp - 1 < b for k, a, b in rows)}
    assert {r["snp"] for r in paint(v, df, 17).collect()} == want == {r["snp"] for r in paint(v, union_intervals(df, width=13), 50).collect()}


def test_random_unions_and_overlaps_are_those_of_brute_force(spark):
    """Intervals that span many bins, empty ones, repeated ones and a null key."""
    import numpy as np

    rng = np.random.default_rng(6)
    starts, widths = rng.integers(0, 4000, 150), rng.choice([0, 1, 5, 30, 400], 150)
    rows = [((None, "1", "X")[k % 3], int(s), int(s + w)) for k, (s, w) in enumerate(zip(starts, widths, strict=True))]
    rows = [(c, s, e, k) for k, (c, s, e) in enumerate(rows * 3)]
    df = spark.createDataFrame(rows, "chr string, start0 long, end0 long, row0 long")
    unions, overlaps = set(), set()
    for label in (None, "1", "X"):
        reach = None
        for c, s, e, k in sorted((r for r in rows if r[0] == label), key=lambda r: (r[1], r[2], r[3])):
            if reach is not None and s < reach:
                overlaps.add(k)
            if reach is None or s > reach:
                first = s
            reach = e if reach is None else max(reach, e)
            unions = {u for u in unions if u[:2] != (c, first)} | {(c, first, reach)}
    for width in (7, 1 << 16):
        assert {tuple(r) for r in union_intervals(df, width=width).collect()} == unions
        found = overlapping(df, width=width)
        assert found.columns == df.columns and sorted(r["row0"] for r in found.collect()) == sorted(overlaps)
