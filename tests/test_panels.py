import json
import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.annotations import create_annotations, load_annotation, load_annotations, load_annotations_cache
from helixframe.genotype import load_genotype, load_genotype_cache
from helixframe.ld import build_ld, build_ld_from_genotype, get_verbosity, ld_manifest, load_ld, load_ld_reference, panel_from_pairs, save_ld, set_verbosity, validate_ld, write_bim, write_monomorphic
from helixframe.operators import blocks, prune
from helixframe.operators.blocks import blocks_of, build_blocks, multiply_r2, pairs_of, rows_of
from helixframe.operators.linkage import fast_prune, prune_frequency
from helixframe.reference import panel_of
from helixframe.sources.ld_npz import MANIFEST, SAID, read_npz_shards
from helixframe.sources.plink import load_reference
from helixframe.sources.text import numbered_lines
from tests.test_variants import SCHEMA, VARIANTS, by_axis


@pytest.fixture(scope="module")
def panel(spark):
    return panel_of(spark.createDataFrame(VARIANTS, SCHEMA))


# Sources -----------------------------------------------------------------------------------------------------

CALLS = [[2, -1, 1, 0], [0, 1, 2, -1], [1, 1, 0, 2], [2, 0, -1, 1], [-1, 2, 0, 1]]
FAM = [("FAM1", "IND1", 1), ("FAM1", "IND2", 2), ("FAM2", "IND3", 1), ("FAM2", "IND4", 2)]


def bed_bytes(calls):
    out = bytearray(b"\x6c\x1b\x01")
    for row in calls:
        for at in range(0, len(row), 4):
            out.append(sum({2: 0, -1: 1, 1: 2, 0: 3}[c] << 2 * k for k, c in enumerate(row[at : at + 4])))
    return bytes(out)


def write_bfile(prefix, variants, fam, calls):
    with open(f"{prefix}.bim", "w") as f:
        f.writelines(f"{c}\t{s}\t0\t{bp}\t{a}\t{b}\n" for c, _, s, bp, a, b in variants)
    with open(f"{prefix}.fam", "w") as f:
        f.writelines(f"{x} {y} 0 0 {sex} -9\n" for x, y, sex in fam)
    with open(f"{prefix}.bed", "wb") as f:
        f.write(bed_bytes(calls))


def test_numbered_lines_over_splits(spark, tmp_path):
    path = tmp_path / "lines.txt"
    path.write_text("".join(f"line {i}\n" for i in range(20000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        lines = numbered_lines(spark, str(path))
        assert lines.filter(F.concat(F.lit("line "), F.col("row0")) != F.col("value")).count() == 0 and lines.count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_load_reference(spark, tmp_path):
    rows = [*VARIANTS[:5], ("Y", 0, "rsY", 50, "A", "G"), *VARIANTS[5:]]
    one = tmp_path / "all.bim"
    one.write_text("".join(f"{c} {s} 0 {bp} {a} {b}\n" for c, _, s, bp, a, b in sorted(rows, key=lambda r: r[0] == "Y")))
    got = load_reference(spark, str(one))
    assert got.labels == ("1", "X") and by_axis(got.variants, "snp") == [v[2] for v in VARIANTS]
    for label in ("1", "X"):
        (tmp_path / f"chr{label}.bim").write_text("".join(f"{c} {s} 0 {bp} {a} {b}\n" for c, _, s, bp, a, b in VARIANTS if c == label))
    assert by_axis(load_reference(spark, str(tmp_path / "chr@.bim")).variants, "snp") == [v[2] for v in VARIANTS]
    assert load_reference(spark, str(tmp_path / "chr@.bim"), ["X"]).labels == ("X",)


@pytest.mark.parametrize("text", ["1 a 0 5 A G\n1 b 0 4 A G\n", "1 a 0 5 A\n", "chr1 a 0 5 A G\n", "1 a 0 5 A A\n", "1 a x 5 A G\n", "1 a 0 5.5 A G\n", "1 a 0 5 a G\n", "25 a 0 5 A G\n"])
def test_bad_bim(spark, tmp_path, text):
    path = tmp_path / "bad.bim"
    path.write_text(text)
    with pytest.raises(ValueError):
        load_reference(spark, str(path))


@pytest.mark.filterwarnings("ignore")
def test_genotypes(spark, panel, tmp_path):
    prefix = str(tmp_path / "g")
    calls = [*CALLS, [2, 2, 2, 2], [0, 1, 1, 2]]
    write_bfile(prefix, VARIANTS[:7], FAM, calls)
    got = load_genotype(spark, prefix, panel)
    assert [r["is_present"] for r in got.is_present().orderBy("snp_idx").collect()] == [True] * 7 + [False]
    rows = got.fetch([5, 0, 5]).collect()
    assert sorted((r["ord"], r["sample_idx"], r["call"]) for r in rows) == sorted((k, s, calls[v][s]) for k, v in enumerate((5, 0, 5)) for s in range(4))
    assert {r["value"] for r in rows if r["call"] == -1} == {None}
    scaled = got.fetch([5], haploid_mode="ploidy_scaled").orderBy("sample_idx").collect()
    assert [r["value"] for r in scaled] == [1.0, 2.0, 1.0, 2.0]
    for bad in ([7], [8], [True]):
        with pytest.raises(ValueError):
            got.fetch(bad)
    with pytest.raises(ValueError):
        got.fetch([0], haploid_mode="x")
    assert got.fetch([]).count() == 0
    assert got.summary() == "<GenotypePanel: 8 variants x 4 samples across 2 shard(s): 1, X>"
    arrays = got.fetch_arrays(spark.createDataFrame([(9, 2), (4, 6), (1, 2)], "ord long, snp_idx long")).collect()
    assert sorted((r["ord"], r["snp_idx"], r["calls"]) for r in arrays) == [(1, 2, calls[2]), (4, 6, calls[6]), (9, 2, calls[2])]
    got.save(str(tmp_path / "cache"))
    with pytest.raises(ValueError, match="not that of the reference"):
        load_genotype_cache(spark, str(tmp_path / "cache"), panel_of(panel.variants.filter("snp <> 'rs1003'")))
    again = load_genotype_cache(spark, str(tmp_path / "cache"), panel, ["X"])
    assert [r["call"] for r in again.fetch([1]).orderBy("sample_idx").collect()] == calls[6]


@pytest.mark.filterwarnings("ignore")
@pytest.mark.parametrize("n", [5, 6, 7, 8])
def test_partial_last_byte(spark, panel, tmp_path, n):
    rng = np.random.default_rng(n)
    calls = rng.integers(-1, 3, (5, n)).tolist()
    write_bfile(str(tmp_path / "g"), VARIANTS[:5], [("F", f"I{i}", 1) for i in range(n)], calls)
    got = load_genotype(spark, str(tmp_path / "g"), panel).fetch([4, 1]).collect()
    assert sorted((r["ord"], r["sample_idx"], r["call"]) for r in got) == sorted((k, s, calls[v][s]) for k, v in enumerate((4, 1)) for s in range(n))


@pytest.mark.filterwarnings("ignore")
def test_sexes_of_x(spark, panel, tmp_path):
    """X is built for females and males apart, which no sample may lack a sex for."""
    rng = np.random.default_rng(4)
    calls = rng.integers(0, 3, (8, 40))
    calls[:, :6] = [0, 1, 2, 0, 1, 2]
    people = [("F", f"I{i}", 1 + (i // 3) % 2) for i in range(40)]
    write_bfile(str(tmp_path / "g"), VARIANTS, people, calls.tolist())
    got = build_ld_from_genotype(load_genotype(spark, str(tmp_path / "g"), panel), least_r2=0)
    assert got.sexes == ("female", "male") and got.default_chrx_sex == "female"
    for sex, code in (("female", 2), ("male", 1)):
        at = [i for i, p in enumerate(people) if p[2] == code]
        want = {(i, j): np.corrcoef(calls[5 + i, at], calls[5 + j, at])[0, 1] for i in range(3) for j in range(i + 1, 3)}
        assert {(r["i"], r["j"]): r["r"] for r in got.r.filter(F.col("sex") == sex).filter("i < j").collect()} == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}
    people[7] = ("F", "I7", 0)
    write_bfile(str(tmp_path / "u"), VARIANTS, people, calls.tolist())
    unsexed = load_genotype(spark, str(tmp_path / "u"), panel)
    with pytest.raises(ValueError, match="sample 7 on X has no sex"):
        build_ld_from_genotype(unsexed)
    with pytest.raises(ValueError, match="wants the sex"):
        unsexed.fetch([6], haploid_mode="ploidy_scaled").collect()
    assert unsexed.fetch([0], haploid_mode="ploidy_scaled").count() == 40
    whole = build_ld_from_genotype(unsexed, least_r2=0, chrx_sexes=["combined"])
    r = whole.r.filter("chr = 'X' AND i = 0 AND j = 1").first()["r"]
    assert whole.default_chrx_sex == "combined" and r == pytest.approx(np.corrcoef(calls[5], calls[6])[0, 1], abs=1e-6)


@pytest.mark.filterwarnings("ignore")
def test_samples_of_x(spark, panel, tmp_path):
    write_bfile(str(tmp_path / "c1"), VARIANTS[:5], FAM, CALLS)
    write_bfile(str(tmp_path / "cX"), VARIANTS[5:], [FAM[2], FAM[0]], [[0, 1], [1, 2], [2, -1]])
    got = load_genotype(spark, str(tmp_path / "c@"), panel)
    one = got.fetch_arrays([5, 0], haploid_mode="ploidy_scaled").orderBy("ord").collect()
    assert [r["calls"] for r in one] == [[1, -1, 0, -1], CALLS[0]] and one[0]["values"] == [0.5, None, 0.0, None]
    assert {r["sample_idx"]: r["is_present"] for r in got.is_subject_present("X").collect()} == {0: True, 1: False, 2: True, 3: False}
    assert [r["call"] for r in got.fetch([5]).orderBy("sample_idx").collect()] == [1, -1, 0, -1]
    write_bfile(str(tmp_path / "cX"), VARIANTS[5:], [FAM[2], ("FAM9", "IND9", 1)], [[0, 1], [1, 2], [2, -1]])
    with pytest.raises(ValueError):
        load_genotype(spark, str(tmp_path / "c@"), panel)
    (tmp_path / "c1.bed").write_bytes(b"\x6c\x1b\x00")
    with pytest.raises(Exception):  # noqa: B017
        load_genotype(spark, str(tmp_path / "c1"), panel.select_shards(["1"])).fetch([0]).collect()


# Annotations -------------------------------------------------------------------------------------------------


def matrix(p):
    order = {(c, i): k for k, (c, i, *_) in enumerate(VARIANTS)}
    out = np.zeros((len(VARIANTS), len(p.columns)))
    for r in p.values.collect():
        out[order[r["chr"], r["local_idx"]], r["anno_id"]] = r["value"]
    return out.T.tolist()


def test_annotations(spark, panel, tmp_path):
    (tmp_path / "anno1.bed").write_text("1\t99\t150\n1\t120\t200\textra\n".replace("\textra", "") + "# note\n\n1\t299\t350\n1\t350\t400\n1\t499\t500\nY\t1\t2\n")
    (tmp_path / "anno2.bed").write_text("X\t99\t100\nX\t195\t205\nX\t198\t302\n")
    both = load_annotations(spark, [str(tmp_path / "anno1.bed"), str(tmp_path / "anno2.bed")], panel)
    assert both.names == ["anno1", "anno2"] and matrix(both) == [[1, 1, 1, 1, 1, 0, 0, 0], [0, 0, 0, 0, 0, 1, 1, 1]]
    (tmp_path / "grouped.annot").write_text("1\t99\t200\tcoding\n1\t150\t350\tregulatory\n1\t299\t400\tcoding\nX\t99\t301\tregulatory\n")
    grouped = load_annotation(spark, str(tmp_path / "grouped.annot"), panel, group_column=3)
    assert grouped.names == ["coding", "regulatory"] and matrix(grouped) == [[1, 1, 1, 1, 0, 0, 0, 0], [0, 1, 1, 0, 0, 1, 1, 1]]
    (tmp_path / "continuous.annot").write_text("chrom\tstart\tend\tscore\tweight\n1\t99\t200\t.5\t1.25\n1\t299\t400\t-1.25\t.75\nX\t99\t301\t2\t3.5\n")
    numeric = load_annotation(spark, str(tmp_path / "continuous.annot"), panel, has_header=True, value_columns=["score", "weight"])
    assert matrix(numeric) == [[0.5, 0.5, -1.25, -1.25, 0, 2, 2, 2], [1.25, 1.25, 0.75, 0.75, 0, 3.5, 3.5, 3.5]]
    every = both.union_annotations(grouped).union_annotations(numeric)
    assert len(every.columns) == 6 and matrix(every.select_annotations(["weight", "anno2"])) == [matrix(numeric)[1], matrix(both)[1]]
    assert matrix(every)[2:4] == matrix(grouped) and [c.is_binary for c in every.columns] == [True] * 4 + [False] * 2
    with pytest.raises(ValueError):
        both.union_annotations(both)
    with pytest.raises(ValueError):
        every.select_annotations(["nothing"])
    every.save(str(tmp_path / "cache"))
    assert matrix(load_annotations_cache(spark, str(tmp_path / "cache"), panel)) == matrix(every)
    assert '"group_value":"coding"' in grouped.columns[0].metadata


def test_metadata_of_annotations(spark, panel, tmp_path):
    """Sidecars: a whole file for each binary column, a line for each physical column of a table of values; else provenance is generated."""
    for name in ("a", "b"):
        (tmp_path / f"{name}.bed").write_text("1\t99\t150\n1\t300\t310\n")
        (tmp_path / f"{name}.txt").write_text(f"about {name}\nin two lines\n")
    paths, sidecars = ([str(tmp_path / f"{n}.{e}") for n in ("b", "a")] for e in ("bed", "txt"))
    assert [c.metadata for c in load_annotations(spark, paths, panel, metadata_paths=sidecars).columns] == ["about b\nin two lines\n", "about a\nin two lines\n"]
    assert [c.metadata for c in load_annotations(spark, paths, panel, metadata=["x", ""]).columns] == ["x", ""]
    assert load_annotations(spark, paths, panel).columns[0].metadata == f'{{"num_source_intervals":2,"source_file":"{paths[0]}","source_file_has_header":0}}'
    for bad in ({"metadata": ["x"]}, {"metadata_paths": sidecars[:1]}, {"metadata": ["x", "y"], "metadata_paths": sidecars}):
        with pytest.raises(ValueError):
            load_annotations(spark, paths, panel, **bad)
    (tmp_path / "v.annot").write_text("1\t99\t150\t1.5\t2\n")
    (tmp_path / "v.txt").write_text("chr\nstart\nend\nthe score\nthe weight\n")
    values = load_annotation(spark, str(tmp_path / "v.annot"), panel, value_columns=[4, 3], annotation_names=["w", "s"], metadata_path=str(tmp_path / "v.txt"))
    assert [(c.name, c.metadata, c.is_binary) for c in values.columns] == [("w", "the weight", False), ("s", "the score", False)]
    for text in ("a\nb\n", "a\nb\n\nd\ne\n"):
        (tmp_path / "v.txt").write_text(text)
        with pytest.raises(ValueError, match="lines"):
            load_annotation(spark, str(tmp_path / "v.annot"), panel, value_columns=[3], annotation_names=["s"], metadata_path=str(tmp_path / "v.txt"))
    grouped = tmp_path / "g é.annot"
    grouped.write_text("1\t99\t150\tcödé\n1\t99\t150\tcödé\n")
    one = load_annotation(spark, str(grouped), panel, group_column=3).columns[0]
    assert one.metadata == json.dumps({"group_column": 3, "group_value": "cödé", "num_source_intervals": 2, "source_file": str(grouped), "source_file_has_header": 0}, separators=(",", ":"))


def jobs_of(spark, work):
    spark.sparkContext.setJobGroup(name := f"jobs-{uuid.uuid4()}", "")
    work()
    spark.sparkContext.setJobGroup("", "")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_many_files_are_one_plan(spark, panel, tmp_path):
    paths = []
    for k in range(60):
        paths.append(str(tmp_path / f"f+{k} %.bed"))
        with open(paths[-1], "w") as f:
            f.write(f"# {k}\n1\t{k * 5}\t{k * 5 + 120}\n1\t{k * 5 + 100}\t{k * 5 + 130}\nMT\t1\t2\n")
    two, sixty = (jobs_of(spark, lambda n=n: load_annotations(spark, paths[:n], panel)) for n in (2, 60))
    assert sixty <= two + 2
    got = matrix(load_annotations(spark, paths[::-1], panel))
    assert got[::-1] == [[float(c == "1" and any(a <= bp - 1 < b for a, b in ((5 * k, 5 * k + 120), (5 * k + 100, 5 * k + 130)))) for c, _, _, bp, *_ in VARIANTS] for k in range(60)]
    with open(paths[7], "a") as f:
        f.write("1\t5\n")
    with pytest.raises(ValueError, match=r"f\+7 %.bed: row 5: expected 3 columns"):
        load_annotations(spark, paths[:9], panel)
    with open(paths[7], "w") as f:
        f.write("1\t9\t5\n")
    with pytest.raises(ValueError, match=r"f\+7 %.bed: row 1: end must not be before start"):
        load_annotations(spark, paths[:9], panel)


def test_many_groups(spark, panel, tmp_path):
    """As many columns as a table says, without any of them on the driver."""
    n = 100_000
    with open(tmp_path / "groups.annot", "w") as f:
        f.writelines(f"1\t{k % 300}\t{k % 300 + 100}\tg{n - k}\n" for k in range(n))
    got = load_annotation(spark, str(tmp_path / "groups.annot"), panel, group_column=3)
    assert got.table.count() == n and got.table.filter(F.concat(F.lit("g"), n - F.col("anno_id")) != F.col("name")).isEmpty()
    assert got.values.count() == sum(a <= bp - 1 < a + 100 for k in range(n) for a in (k % 300,) for c, _, _, bp, *_ in VARIANTS if c == "1")
    assert got.select_annotations(["g5", "g70000"]).values.filter("anno_id > 1").isEmpty()
    assert got.summary() == f"<AnnotationPanel: 8 variants x {n} annotations across 2 shard(s): 1, X>"


@pytest.mark.parametrize("text, options", [
    ("1\t5\t3\n", {}), ("1\t-1\t3\n", {}), ("1\t1.5\t3\n", {}), ("chr1\t1\t3\n", {}), ("99\t1\t3\n", {}), ("1\t1\t3\n1\t1\n", {}), ("", {}), ("1\t1\t9\tx\n", {}),
    ("1\t1\t9\t1\n1\t5\t12\t2\n", {}), ("1\t1\t9\t1\t2\n", {}), ("1\t1\t9\t1\n", {"group_column": 3, "value_columns": [3]}), ("1\t1\t9\t1\n", {"value_columns": [2]}), ("a\ta\tb\n1\t2\t3\n", {"has_header": True}),
])
def test_bad_annotations(spark, panel, tmp_path, text, options):
    path = tmp_path / "a.annot"
    path.write_text(text)
    with pytest.raises(ValueError):
        load_annotation(spark, str(path), panel, **options)


def test_create_annotations(spark, panel):
    rows = spark.createDataFrame([("1", 0, 0, 1.0), ("1", 1, 0, 0.0), ("1", 2, 1, 2.5)], "chr string, local_idx long, anno_id int, value double")
    got = create_annotations(panel, rows, ["a", "b", "c"])
    assert [c.is_binary for c in got.columns] == [True, False, True] and got.values.count() == 2
    for names, binary in ((["a", "a", "c"], None), (["a", ""], None), (["a"], None), (["a", "b", "c"], [True, True, True])):
        with pytest.raises(ValueError):
            create_annotations(panel, rows, names, binary)


# LD ----------------------------------------------------------------------------------------------------------

PAIRS = [("1", None, 0, 1, 0.9), ("1", None, 0, 2, 0.3), ("1", None, 1, 3, -0.5), ("1", None, 3, 4, 0.7)]
PAIRS += [("X", s, i, j, r) for s, rs in (("female", (0.65, -0.35)), ("male", (0.55, -0.45))) for (i, j), r in zip(((0, 1), (1, 2)), rs, strict=True)]
FREQ = [("1", None, i, f) for i, f in enumerate((0.3, 0.4, 0.2, 0.35, 0.15))]
FREQ += [("X", s, i, f) for s, fs in (("female", (0.28, 0.32, 0.22)), ("male", (0.22, 0.28, 0.18))) for i, f in enumerate(fs)]


@pytest.fixture(scope="module")
def ld(spark, panel):
    return panel_from_pairs(
        panel, spark.createDataFrame(PAIRS, "chr string, sex string, i long, j long, r double"), spark.createDataFrame(FREQ, "chr string, sex string, local_idx long, a1freq double"), ("female", "male")
    )


def axis(spark, values, name="value"):
    return spark.createDataFrame([(c, i, float(v)) for (c, i, *_), v in zip(VARIANTS, values, strict=True)], f"chr string, local_idx long, {name} double")


def test_multiply_r2(spark, ld):
    m = axis(spark, range(1, 9)).withColumn("name", F.lit("m"))
    female = [2.89, 3.81, 3.09, 6.95, 6.96, 8.9575, 10.515, 8.8575]
    assert ld.summary() == "<LDPanel: 8 variants across 2 shard group(s): 1, X>"
    assert by_axis(ld.multiply_r2(m), "value") == pytest.approx(female, abs=1e-5)
    assert by_axis(ld.multiply_r2(m, "male"), "value")[5:] == pytest.approx([8.1175, 10.435, 9.4175], abs=1e-5)
    assert by_axis(ld.multiply_r2(m.filter("value = 1")), "value") == pytest.approx([1, 0.81, 0.09, 0, 0, 0, 0, 0], abs=1e-6)
    with pytest.raises(ValueError):
        ld.multiply_r2(m, "combined")


def test_fast_prune(spark, ld):
    scores = axis(spark, [9, 9, 7, 1, 2, 6, 5, 4], "score")
    assert by_axis(ld.fast_prune(scores, 0.35), "score") == [9, None, 7, None, 2, 6, None, 4]
    assert by_axis(ld.fast_prune(scores, 0.35, "male"), "score") == [9, None, 7, None, 2, 6, 5, 4]
    infinite = axis(spark, [math.inf, 9, 7, 1, 2, 6, 5, 4], "score")
    assert by_axis(ld.fast_prune(infinite, 0.35), "score")[:2] == [None, 9]
    for bad in (-1, math.nan):
        with pytest.raises(ValueError):
            ld.fast_prune(scores, bad)


def test_prune_is_that_of_one_by_one(spark):
    rng = np.random.default_rng(8)
    n = 120
    r = np.triu(np.where(rng.random((n, n)) < 0.06, rng.uniform(-1, 1, (n, n)), 0), 1).astype(np.float32)
    r = r + r.T + np.eye(n, dtype=np.float32)
    score = rng.integers(-6, 7, n).astype(float)
    score[rng.random(n) < 0.1] = math.nan
    score[rng.random(n) < 0.1] = math.inf
    out, kept = score.copy(), np.zeros(n, bool)
    for i in sorted(np.flatnonzero(np.isfinite(score)), key=lambda k: (-abs(score[k]), k)):
        if not np.isnan(out[i]):
            kept[i] = True
            out[(r[i] * r[i] >= np.float32(0.2)) & ~kept] = math.nan
    i, j = np.nonzero(r)
    ld = spark.createDataFrame([("1", int(a), int(b), float(r[a, b])) for a, b in zip(i, j, strict=True)], "chr string, i long, j long, r float")
    scores = spark.createDataFrame([("1", k, None if math.isnan(s) else float(s)) for k, s in enumerate(score)], "chr string, local_idx long, score double")
    got = {x["local_idx"]: x["score"] for x in fast_prune(scores, blocks_of(ld.filter("i < j")), 0.2).collect()}
    assert [got[k] for k in range(n)] == [None if math.isnan(x) else x for x in out]


def test_store(spark, panel, ld, tmp_path):
    path = str(tmp_path / "ld")
    save_ld(ld, path, {"window_kb": 10_000})
    with pytest.raises(Exception):  # noqa: B017
        save_ld(ld, path)
    set_verbosity("quiet")
    assert get_verbosity() == "quiet"
    again = load_ld(spark, path)
    validate_ld(again)
    assert {(r["chr"], r["sex"], r["nnz"]) for r in ld_manifest(again).collect()} == {("1", None, 13), ("X", "female", 7), ("X", "male", 7)}
    freq = [r["a1freq"] for r in again.a1freq().orderBy("snp_idx").collect()]
    assert freq == pytest.approx([0.3, 0.4, 0.2, 0.35, 0.15, 0.28, 0.32, 0.22])
    assert load_ld(spark, path, ["1"]).reference.labels == ("1",) and load_ld_reference(spark, path).labels == ("1", "X")
    assert again.select_shards(["X"]).r.count() == 14
    with pytest.raises(ValueError):
        load_ld(spark, path, default_chrx_sex="combined")
    write_bim(panel.variants.filter("chr = '1'"), str(tmp_path / "bim"))
    again = load_reference(spark, str(tmp_path / "bim")).variants.orderBy("local_idx")
    assert [r["snp"] for r in again.collect()] == [v[2] for v in VARIANTS[:5]]  # its part files are one file
    assert not write_monomorphic(ld, str(tmp_path / "mono"))


@pytest.mark.parametrize("pair", [("1", None, 0, 9, 0.5), ("1", None, 1, 1, 0.5), ("1", None, 0, 1, 1.5), ("1", None, 0, 1, float("nan")), ("1", None, 1, 0, 0.9)])
def test_bad_pairs(spark, panel, pair):
    rows = [p for p in PAIRS if p[0] == "1"] + [pair]
    with pytest.raises(ValueError):
        panel_from_pairs(panel, spark.createDataFrame(rows, "chr string, sex string, i long, j long, r double"), spark.createDataFrame(FREQ, "chr string, sex string, local_idx long, a1freq double"))


def test_build(spark, panel):
    rng = np.random.default_rng(3)
    calls = {(c, i): rng.integers(-1, 3, 30) for c, i, *_ in VARIANTS}
    df = spark.createDataFrame([(c, i, v.tolist()) for (c, i), v in calls.items()], "chr string, local_idx long, calls array<int>")
    sexes = {"female": list(range(0, 30, 2)), "male": list(range(1, 30, 2))}
    got = build_ld(panel, df, window_kb=0.25, least_r2=0.0, sexes=sexes)
    validate_ld(got)
    for r in got.r.filter("i < j").collect():
        assert abs(VARIANTS[r["i"]][3] - VARIANTS[r["j"]][3]) <= 250
        at = sexes[r["sex"]] if r["sex"] else list(range(30))
        x, y = (calls[r["chr"], r[k]][at].astype(float) for k in "ij")
        both = (x >= 0) & (y >= 0)
        assert r["r"] == pytest.approx(np.corrcoef(x[both], y[both])[0, 1], abs=1e-5)
    for r in got.freq.collect():
        v = calls[r["chr"], r["local_idx"]][sexes[r["sex"]] if r["sex"] else list(range(30))]
        assert r["a1freq"] == pytest.approx(v[v >= 0].mean() / 2, abs=1e-6)
    with pytest.raises(ValueError):
        build_ld(panel, df.withColumn("calls", F.transform("calls", lambda c: F.lit(2))), sexes=sexes)


def test_npz_import(spark, tmp_path):
    r = np.array([[1, 0.5, 0], [0.5, 1, 0.25], [0, 0.25, 1]], np.float32)
    j, i = np.nonzero(r.T)
    meta = np.frombuffer(json.dumps({"chr": "1", "sex": None, "matrix": "symmetric"}).encode(), np.uint8)
    np.savez(tmp_path / "s.npz", data=r[i, j], indices=i.astype(np.int32), indptr=np.searchsorted(j, range(4)).astype(np.int32), shape=np.array([3, 3]), a1freq=np.array([0.1, 0.2, 0.3], np.float32), metadata=meta)
    got = read_npz_shards(spark, str(tmp_path / "s.npz")).collect()
    assert {(x["i"], x["j"]): x["r"] for x in got} == {(int(a), int(b)): float(r[a, b]) for a, b in zip(i, j, strict=True)}


def npz_shard(path, r, freq, chr_, sex, checksum):
    r = np.asarray(r, np.float32)
    j, i = np.nonzero(r.T)
    meta = SAID | {"format": "ld_npz_csc32", "chr": chr_, "sex": sex, "num_snp": len(r), "nnz": len(i), "num_monomorphic_snps": 0}
    meta |= {"reference_checksum": checksum, "reference_bim": f"{chr_}.bim"}
    np.savez(path, data=r[i, j], indices=i.astype(np.int32), indptr=np.searchsorted(j, range(len(r) + 1)).astype(np.int32), shape=np.array(r.shape), a1freq=np.array(freq, np.float32), metadata=np.frombuffer(json.dumps(meta).encode(), np.uint8))
    return meta


def test_import_distribution(spark, panel, tmp_path):
    import hashlib
    from helixframe.sources.ld_npz import check_agreement, check_metadata, import_distribution, is_plain_name, read_manifest

    sums = {r["chr"]: r["checksum"] for r in panel.shards().collect()}
    r1, rx = np.eye(5), np.eye(3)
    r1[0, 1] = r1[1, 0] = 0.9
    rx[1, 2] = rx[2, 1] = -0.35
    entries = []
    for chr_, sex, r in (("X", "female", rx), ("1", None, r1)):
        name = f"{chr_}.npz"
        meta = npz_shard(tmp_path / name, r, [0.25] * len(r), chr_, sex, sums[chr_])
        check_metadata(meta, name)
        entries.append({k: meta[k] for k in ("chr", "sex", "num_snp", "nnz", "reference_checksum", "reference_bim")} | {"file": name, "file_md5": hashlib.md5((tmp_path / name).read_bytes()).hexdigest()})
        check_agreement(entries[-1], meta, name)
    (tmp_path / "reference.tsv").write_text("axis")
    (tmp_path / "1.bim").write_text("".join(f"{c} {s} 0 {bp} {a} {b}\n" for c, _, s, bp, a, b in VARIANTS if c == "1"))
    (tmp_path / "X.bim").write_text("".join(f"{c} {s} 0 {bp} {a} {b}\n" for c, _, s, bp, a, b in VARIANTS if c == "X"))
    head = MANIFEST | {"reference_cache": "reference.tsv", "reference_cache_md5": hashlib.md5(b"axis").hexdigest()}
    manifest = tmp_path / "ld_manifest.json"
    manifest.write_text(json.dumps(head | {"shards": entries}))
    got = import_distribution(spark, str(tmp_path), panel)
    validate_ld(got)
    assert {(r["chr"], r["i"], r["j"]): round(r["r"], 2) for r in got.r.filter("i < j").collect()} == {("1", 0, 1): 0.9, ("X", 1, 2): -0.35}
    assert [e["chr"] for e in read_manifest(spark, str(tmp_path))] == ["1", "X"]
    for change in ({"file_md5": "0" * 32}, {"reference_bim": "X.bim"}, {"nnz": 6}):  # held against the files
        manifest.write_text(json.dumps(head | {"shards": [entries[1] | change]}))
        with pytest.raises(ValueError):
            import_distribution(spark, str(tmp_path), panel)
    (tmp_path / "reference.tsv").write_text("other")
    manifest.write_text(json.dumps(head | {"shards": entries}))
    with pytest.raises(ValueError, match="reference.tsv"):
        import_distribution(spark, str(tmp_path), panel)
    assert [is_plain_name(n) for n in ("a.bim", "a/b", "..", "", "c:x", 5)] == [True, False, False, False, False, False]


ENTRY = {"chr": "1", "sex": None, "file": "a.npz", "file_md5": "0" * 32, "num_snp": 5, "nnz": 7, "reference_checksum": "x", "reference_bim": "1.bim"}
HEAD = MANIFEST | {"reference_cache": "r.tsv", "reference_cache_md5": "1" * 32}


@pytest.mark.parametrize("change", [
    {"object_type": "x"}, {"schema_version": "2.0"}, {"runtime_format": "other"}, {"reference_cache": "a/b"}, {"reference_cache": None}, {"reference_cache_md5": "12"}, {"shards": []}, {"shards": None},
    {"shards": [ENTRY, ENTRY]}, {"shards": [ENTRY | {"chr": "X", "sex": s, "reference_bim": f"{s}.bim"} for s in ("male", "female")]},
    *({"shards": [ENTRY | e]} for e in (
        {"chr": "Y"}, {"sex": "female"}, {"chr": "X"}, {"file": "../a.npz"}, {"file": "/a.npz"}, {"file": "a.mat"}, {"file": ""}, {"file_md5": None}, {"num_snp": True}, {"num_snp": 0}, {"nnz": -1},
        {"nnz": 1.5}, {"reference_checksum": ""}, {"reference_bim": "a/b"}, {"reference_bim": ".."},
    )), *({"shards": [{k: v for k, v in ENTRY.items() if k != gone}]} for gone in ENTRY),
])
def test_manifest_rules(change):
    from helixframe.sources.ld_npz import check_manifest

    assert check_manifest(HEAD | {"shards": [ENTRY | {"chr": "X", "sex": "male"}, ENTRY]}, "t")[0] == ENTRY
    with pytest.raises(ValueError):
        check_manifest(HEAD | {"shards": [ENTRY]} | change, "t")


META = SAID | {"format": "ld_npz_csc32", "num_monomorphic_snps": 0} | {k: ENTRY[k] for k in ("chr", "sex", "num_snp", "nnz", "reference_checksum", "reference_bim")}


@pytest.mark.parametrize("change", [
    *({k: "x"} for k in SAID), {"index_base": False}, {"format": "mat"}, {"chr": "Y"}, {"sex": "male"}, {"num_snp": 0}, {"nnz": 1 << 31}, {"num_monomorphic_snps": 6}, {"num_monomorphic_snps": -1},
    {"reference_checksum": ""}, {"reference_bim": "a/b"}, *({k: None for k in (gone,)} for gone in SAID),
])
def test_metadata_rules(change):
    from helixframe.sources.ld_npz import check_agreement, check_metadata

    check_metadata(META, "t")
    with pytest.raises(ValueError):
        check_metadata(META | change, "t")
    for gone in META:
        with pytest.raises(ValueError, match="metadata has no"):
            check_metadata({k: v for k, v in META.items() if k != gone}, "t")
    with pytest.raises(ValueError, match="differ in nnz"):
        check_agreement(ENTRY | {"nnz": 8}, META, "t")


def test_npz_in_ranges(spark, tmp_path):
    """A shard is read by many tasks, each some columns of it, whether its arrays are compressed or not."""
    rng = np.random.default_rng(5)
    n = 300
    r = np.where(rng.random((n, n)) < 0.2, rng.random((n, n)), 0).astype(np.float32)
    r[:, 40:80] = 0  # columns without entries
    j, i = np.nonzero(r.T)
    arrays = dict(data=r[i, j], indices=i.astype(np.int32), indptr=np.searchsorted(j, range(n + 1)).astype(np.int32), shape=np.array([n, n]), a1freq=rng.random(n).astype(np.float32))
    arrays["metadata"] = np.frombuffer(json.dumps({"chr": "X", "sex": "male", "matrix": "symmetric"}).encode(), np.uint8)
    np.savez(tmp_path / "a.npz", **arrays)
    np.savez_compressed(tmp_path / "b.npz", **arrays)
    got = read_npz_shards(spark, [str(tmp_path / "a.npz"), f"file://{tmp_path}/b.npz"], entries=1000)
    assert got.rdd.getNumPartitions() > 20 and got.count() == 2 * len(i)
    rows = got.filter("path LIKE '%b.npz'").collect()
    assert {(x["i"], x["j"]): (x["r"], x["a1freq"]) for x in rows} == {(int(a), int(b)): (float(r[a, b]), float(arrays["a1freq"][a]) if a == b else None) for a, b in zip(i, j, strict=True)}
    for name, change in (("indices", arrays["indices"] + n), ("indptr", arrays["indptr"][:-1]), ("data", arrays["data"].astype(np.float64))):
        np.savez(tmp_path / "bad.npz", **(arrays | {name: change}))
        with pytest.raises(Exception):  # noqa: B017
            read_npz_shards(spark, str(tmp_path / "bad.npz")).count()


def test_files_are_committed(spark, tmp_path):
    """A task that fails leaves no file, its second attempt writes another one, and names come with the commit."""
    import pyarrow as pa

    from helixframe.sources.files import FilesWriter, write_files

    root = str(tmp_path / "out")
    writer = FilesWriter(root)
    batch = pa.record_batch({"name": ["a/x.bin"] * 2 + ["y.bin"], "part": [0, 1, 0], "content": [b"12", b"34", b"5"]})

    def lost():
        yield batch
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        writer.write(lost())
    assert [p for p in (tmp_path / "out").iterdir() if not p.name.startswith("_unfinished")] == []
    done = writer.write(iter([batch]))
    twice = writer.write(iter([batch]))  # a second attempt that Spark doesn't take
    assert {t for _, t in done.files}.isdisjoint(t for _, t in twice.files)
    writer.commit([done, None])
    assert sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file()) == ["a/x.bin", "y.bin"]
    assert (tmp_path / "out/a/x.bin").read_bytes() == b"1234"
    rows = spark.createDataFrame([("big.bin", k, bytes([k % 256]) * 3) for k in range(2000)] + [("other.bin", 0, b"o")], "name string, part long, content binary").repartition(7)
    write_files(rows, root)
    assert (tmp_path / "out/big.bin").read_bytes() == b"".join(bytes([k % 256]) * 3 for k in range(2000))
    with pytest.raises(Exception, match="already"):
        write_files(rows.filter("name = 'other.bin'").withColumn("content", F.lit(bytearray(b"z"))), root)
    failing = rows.withColumn("content", F.when(F.col("part") == 1999, F.raise_error(F.lit("broken")).cast("binary")).otherwise(F.col("content"))).withColumn("name", F.concat(F.lit("f-"), "name"))
    with pytest.raises(Exception, match="broken"):
        write_files(failing, root)
    assert (tmp_path / "out/other.bin").read_bytes() == b"o" and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a", "big.bin", "other.bin", "y.bin"]


def test_hash_table(spark, tmp_path):
    from helixframe.sources.plink import read_hash_table

    path = tmp_path / "t.afreq"
    path.write_text("#CHROM ID\tALT_FREQS\n1 rs1 0.5\n1\trs2   0.25\n")
    assert [(r["CHROM"], r["ID"], r["ALT_FREQS"]) for r in read_hash_table(spark, str(path)).orderBy("row0").collect()] == [("1", "rs1", "0.5"), ("1", "rs2", "0.25")]
    path.write_text("#CHROM ID\n1 rs1 0.5\n")
    with pytest.raises(ValueError):
        read_hash_table(spark, str(path))


def test_stream(spark, panel, tmp_path):
    from helixframe.streaming.align import align_stream

    schema = "chr string, bp long, a1 string, a2 string, p double, z double"
    spark.createDataFrame([("1", 100, "A", "G", 0.01, 1.0), ("1", 100, "G", "A", 0.01, 1.0), ("X", 300, "A", "C", 0.0, 2.0)], schema).write.parquet(str(tmp_path / "in"))
    q = align_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), panel).writeStream.format("memory").queryName("aligned").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["snp"], r["logp"], r["z"]) for r in spark.table("aligned").collect()} == {("rs1001", 2.0, 1.0), ("rsX003", math.inf, 2.0)}
