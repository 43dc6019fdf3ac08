import hashlib
import json
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import blocks, prune
from helixframe.operators.blocks import SIZE, block_faults, blocks_of, build_blocks, multiply_r2, pairs_of, rows_of
from helixframe.operators.linkage import fast_prune, prune_frequency

PAIR = "chr string, i long, j long, r float"


def banded(rng, n, width, share=0.3):
    """Pairs within width of n variants: a symmetric matrix with unit diagonal."""
    r = np.zeros((n, n), np.float32)
    for k in range(1, width + 1):
        values = np.where(rng.random(n - k) < share, rng.uniform(-1, 1, n - k), 0).astype(np.float32)
        r += np.diag(values, k)
    return r + r.T + np.eye(n, dtype=np.float32)


def pairs_frame(spark, r, chr_="1"):
    i, j = np.nonzero(np.triu(r, 1))
    return [(chr_, int(a), int(b), float(r[a, b])) for a, b in zip(i, j, strict=True)]


def one_by_one(r, score, least):
    out, kept = score.copy(), np.zeros(len(score), bool)
    for i in sorted(np.flatnonzero(np.isfinite(score)), key=lambda k: (-abs(score[k]), k)):
        if not np.isnan(out[i]):
            kept[i] = True
            out[(r[i] * r[i] >= np.float32(least)) & ~kept] = np.nan
    return out


def test_blocks_and_rows(spark):
    rng = np.random.default_rng(1)
    r = banded(rng, SIZE + 90, 40)
    rows = pairs_frame(spark, r) + [("X", 0, 1, 0.5)]
    made = blocks_of(spark.createDataFrame(rows, PAIR))
    assert sorted((x["chr"], x["bi"], x["bj"]) for x in made.collect()) == [("1", 0, 0), ("1", 0, 1), ("1", 1, 1), ("X", 0, 0)]
    assert sorted(tuple(x) for x in pairs_of(made).collect()) == sorted((c, i, j, np.float32(v).item()) for c, i, j, v in rows)
    axis = spark.createDataFrame([("1", k) for k in range(len(r))] + [("X", 0), ("X", 1)], "chr string, local_idx long")
    assert rows_of(made, axis).count() == 2 * len(rows) + len(r) + 2
    assert {x["chr"]: (x["nnz"], x["misplaced"], x["beyond"]) for x in block_faults(made).collect()} == {"1": (len(rows) - 1, 0, 0), "X": (1, 0, 0)}
    bad = made.withColumn("i", F.col("j")).withColumn("r", F.transform("r", lambda v: v + 2))
    assert all(x["beyond"] for x in block_faults(bad).collect()) and block_faults(bad.filter("bi = bj")).filter("misplaced = 0").count() == 0


@pytest.mark.parametrize("size, stripe, window", [(512, 8, 10_000), (8, 2, 0.9), (8, 1, 3.5), (4, 3, 0.001)])
def test_build(spark, monkeypatch, size, stripe, window):
    for module in (blocks, prune):
        monkeypatch.setattr(module, "SIZE", size)
    rng = np.random.default_rng(size)
    n, m = 70, 37
    calls, bp = rng.integers(-1, 3, (2, n, m)), np.sort(rng.integers(0, 20_000, (2, n)), axis=1)
    calls[0, 5] = 2  # monomorphic: correlates with nothing
    rows = [(c, k, int(bp[s, k]), calls[s, k].tolist()) for s, c in enumerate(("1", "X")) for k in range(n) if (s, k) != (0, 30)]
    got = build_blocks(spark.createDataFrame(rows, "chr string, local_idx long, bp long, calls array<tinyint>"), window, 0.01, stripe)
    got = {(x["chr"], x["i"], x["j"]): x["r"] for x in pairs_of(got).collect()}
    want = {}
    for s, c in enumerate(("1", "X")):
        for i in range(n):
            for j in range(i + 1, n):
                both = (calls[s, i] >= 0) & (calls[s, j] >= 0)
                x, y = calls[s, i][both], calls[s, j][both]
                if 30 in (i, j) and not s or bp[s, j] - bp[s, i] > window * 1000 or len(set(x)) < 2 or len(set(y)) < 2:
                    continue
                if (r := np.corrcoef(x, y)[0, 1]) ** 2 >= 0.01:
                    want[c, i, j] = pytest.approx(r, abs=1e-6)
    assert got == want


def test_squares_that_are_the_least_one_stay(spark):
    """Of 18 samples many pairs have r * r of 1/20 or 1/5 itself, which rounding may put on either side."""
    rng = np.random.default_rng(5)
    calls = rng.integers(-1, 3, (150, 18))
    frame = spark.createDataFrame([("1", k, k, c.tolist()) for k, c in enumerate(calls)], "chr string, local_idx long, bp long, calls array<tinyint>")
    for least in ("0.05", "0.2"):
        want, ties = set(), 0
        for i in range(len(calls)):
            for j in range(i + 1, len(calls)):
                there = (calls[i] >= 0) & (calls[j] >= 0)
                x, y, n = calls[i][there].tolist(), calls[j][there].tolist(), int(there.sum())
                s = [n * sum(p * q for p, q in zip(u, v, strict=True)) - sum(u) * sum(v) for u, v in ((x, y), (x, x), (y, y))]
                if s[1] * s[2]:
                    square = Fraction(s[0] ** 2, s[1] * s[2])
                    ties += square == Fraction(least)
                    if square >= Fraction(least):
                        want.add((i, j))
        assert ties > 5 and {(x["i"], x["j"]) for x in pairs_of(build_blocks(frame, 10, float(least))).collect()} == want


def test_build_of_nothing(spark):
    none = spark.createDataFrame([], "chr string, local_idx long, bp long, calls array<tinyint>")
    assert build_blocks(none, 10, 0.1).count() == 0
    with pytest.raises(Exception, match="must have 2 calls"):
        build_blocks(spark.createDataFrame([("1", 0, 5, [0, 1]), ("1", 1, 6, [0])], none.schema).coalesce(1), 10, 0.1).count()


def test_multiply(spark, monkeypatch):
    monkeypatch.setattr(blocks, "COLUMNS", 2)
    rng = np.random.default_rng(2)
    r = banded(rng, 2 * SIZE + 5, 30)
    values = {name: np.where(rng.random(len(r)) < 0.2, rng.normal(size=len(r)), 0) for name in ("a", "b", "c")}
    values["c"][SIZE] = np.inf
    matrix = spark.createDataFrame([("1", k, name, float(v)) for name, own in values.items() for k, v in enumerate(own) if v], "chr string, local_idx long, name string, value double")
    axis = spark.createDataFrame([("1", k) for k in range(len(r))] + [("2", 0)], "chr string, local_idx long")
    product = multiply_r2(blocks_of(spark.createDataFrame(pairs_frame(spark, r), PAIR)), matrix, axis)
    got = {(x["chr"], x["local_idx"], x["name"]): x["value"] for x in product.collect()}
    assert len(got) == 3 * (len(r) + 1) and {got["2", 0, n] for n in values} == {0.0}
    squares = (r * r).astype(float)
    for name, own in values.items():
        if name == "c":
            near = squares[:, SIZE] > 0
            assert [np.isinf(got["1", k, "c"]) for k in range(len(r))] == near.tolist()
        else:
            assert [got["1", k, name] for k in range(len(r))] == pytest.approx((squares @ own).tolist())


@pytest.mark.parametrize("width, sweeps", [(SIZE, 12), (SIZE, 0), (4 * SIZE, 1)])
def test_prune_over_groups(spark, monkeypatch, width, sweeps):
    """Groups of one block, and links between them: the outcome is that of one by one."""
    monkeypatch.setattr(prune.decide, "__defaults__", (sweeps,))
    rng = np.random.default_rng(width + sweeps)
    n = 3 * SIZE + 100
    r = banded(rng, n, 25, 0.5)
    score = rng.integers(-40, 40, n).astype(float)
    score[rng.random(n) < 0.05] = np.nan
    score[rng.random(n) < 0.05] = np.inf
    rows = [("1", k, None if np.isnan(s) else float(s), [float(s), float(-k)]) for k, s in enumerate(score) if k % 50 != 49]
    frame = spark.createDataFrame(rows, "chr string, local_idx long, score double, scores array<double>")
    made = blocks_of(spark.createDataFrame(pairs_frame(spark, r), PAIR))
    got = {x["local_idx"]: x["gone"] for x in prune.prune_blocks(frame.select("chr", "local_idx", "scores"), made, 0.2, width).collect()}
    there = np.array([k % 50 != 49 for k in range(n)])
    own = np.where(there[:, None] & there, r, 0)
    for place, scores in enumerate((score, -np.arange(n, dtype=float))):
        want = one_by_one(own, np.where(there, scores, np.nan), 0.2)
        assert [got[k][place] for k in np.flatnonzero(there)] == [bool(np.isnan(want[k]) and not np.isnan(scores[k])) or (np.isnan(scores[k]) and got[k][place]) for k in np.flatnonzero(there)]


def test_prune_of_a_chain_takes_few_rounds(spark, monkeypatch):
    """Scores fall along the contig, and each variant is linked to the next: the longest chain there is."""
    n, rounds = 40 * SIZE, []
    plain = prune._round
    monkeypatch.setattr(prune, "_round", lambda *a: rounds.append(a[2]) or plain(*a))
    monkeypatch.setattr(prune, "WIDTH", SIZE)
    axis = spark.range(n).select(F.lit("1").alias("chr"), F.col("id").alias("local_idx"))
    made = blocks_of(axis.filter(f"local_idx < {n - 1}").select("chr", F.col("local_idx").alias("i"), (F.col("local_idx") + 1).alias("j"), F.lit(0.9).alias("r")))
    scores = axis.select("chr", "local_idx", F.array(n - F.col("local_idx").cast("double")).alias("scores"))
    gone = prune.prune_blocks(scores, made, 0.2, SIZE, 6)
    assert gone.filter(F.col("gone")[0] != (F.col("local_idx") % 2 == 1)).count() == 0 and gone.count() == n
    assert len(rounds) <= 7


def test_prune_frequency(spark):
    rng = np.random.default_rng(11)
    n, times = 200, 19
    r = banded(rng, n, 12, 0.4)
    axis = spark.createDataFrame([("1", k) for k in range(n)], "chr string, local_idx long")
    made = blocks_of(spark.createDataFrame(pairs_frame(spark, r), PAIR))
    got = {x["local_idx"]: x["frequency"] for x in prune_frequency(axis, made, lambda m: (F.col("local_idx") * 7919 + m * 104729) % 211, times, 0.3).collect()}
    stays = sum(~np.isnan(one_by_one(r, (np.arange(n) * 7919 + m * 104729) % 211 * 1.0, 0.3)) for m in range(1, times + 1))
    assert [got[k] for k in range(n)] == pytest.approx((stays / times).tolist())
    with pytest.raises(ValueError):
        prune_frequency(axis, made, lambda m: m, 0)
    assert fast_prune(axis.withColumn("score", F.lit(1.0)), made.limit(0), 0.5).filter("score IS NULL").count() == 0
    assert fast_prune(axis.withColumn("score", F.lit(1.0)).limit(0), made, 0.5).count() == 0


def test_prune_keeps_no_more_links_than_fit(monkeypatch):
    """A group takes its links block by block, and hands on what it may not keep; rounds end as one by one."""
    monkeypatch.setattr(prune, "KEPT", 9 * 4000)  # of 4,000 links with a byte of bits
    most, plain = [], prune.decide

    def decide(keys, kept, gone, u, v):
        most.append(len(u))
        found = plain(keys, kept, gone, u, v)
        return found

    monkeypatch.setattr(prune, "decide", decide)
    rng = np.random.default_rng(8)
    n, width = 6 * 64, 64
    r = banded(rng, n, 150, 0.5)
    score = rng.permutation(n).astype(float)
    u, v = np.nonzero((r * r >= np.float32(0.2)) & ~np.eye(n, dtype=bool))
    of_block = max(((v // width) == p).sum() for p in range(6))
    assert len(u) > 3 * of_block and len(u) > 20_000
    have = [(p, -score[p * width : (p + 1) * width, None], np.zeros((width, 1), np.uint8) | 0x7F, np.zeros((width, 1), np.uint8) | 0x7F) for p in range(6)]
    links, rounds = [(p, u[v // width == p], v[v // width == p]) for p in range(6)], 0
    while links:
        group = prune._Group(have, list(range(6)), width)
        out = [row for link in links for row in group.add(*link)] + group.end()
        have = [(p, *(np.frombuffer(b, t).reshape(size, -1) for b, t in zip(three, (np.float64, np.uint8, np.uint8), strict=True))) for p, size, *three, a, _, _ in out if a is None]
        parts = [(row[0], row[5], row[6]) for row in out if row[5] is not None]
        links = [(p, *(np.concatenate([x[k] for x in parts if x[0] == p]) for k in (1, 2))) for p in sorted({x[0] for x in parts})]
        rounds += 1
        assert rounds < 20
    gone = np.concatenate([h[3] for h in sorted(have, key=lambda h: h[0])])[:, 0] & 0x80 != 0
    assert gone.tolist() == np.isnan(one_by_one(r, score, 0.2)).tolist() and max(most) <= 4000 + of_block


def test_tables_of_long_arrays_have_small_row_groups(spark):
    """Spark's reader takes as many as 4,096 rows of a row group at once: 300 rows of 40,000 numbers are several groups."""
    import pyarrow.parquet as pq

    from helixframe.tables import stored

    table = stored(spark.range(300).coalesce(1).select(F.transform(F.sequence(F.lit(1), F.lit(40_000)), lambda k: F.xxhash64(k, "id")).alias("x")), "long-arrays")
    assert max(pq.ParquetFile(f.removeprefix("file://")).metadata.num_row_groups for f in table.inputFiles()) >= 8


def test_places_that_are_null_are_faults(spark):
    rows = [("1", 0, 0, [0, None], [1, 2], [0.5, 0.5]), ("2", 0, 1, [5, 3], [1, 2], [0.5, None]), ("3", 0, 0, [0], [1, 2], [0.5, 0.5])]
    made = spark.createDataFrame(rows, "chr string, bi int, bj int, i array<smallint>, j array<smallint>, r array<float>")
    assert {x["chr"]: (x["nnz"], x["misplaced"], x["beyond"]) for x in block_faults(made).collect()} == {"1": (2, 1, 0), "2": (2, 0, 1), "3": (2, 1, 0)}


def test_npz_shards_are_streamed(tmp_path):
    """A shard's file is written from pieces in less memory than its entries take, and np.load gives the matrix."""
    import tracemalloc

    import pyarrow as pa

    from helixframe.sources import ld_npz

    n, size = 2_500, ld_npz.SIZE
    rng = np.random.default_rng(4)
    r = np.triu(np.where(rng.random((n, n)) < 0.4, rng.random((n, n)), 0).astype(np.float32), 1)
    freq = rng.random(n).astype(np.float32)

    def blocks():
        for b in range(-(-n // size)):
            at = np.arange(b * size, min(n, (b + 1) * size))
            rows = [{"chr": "X", "sex": "male", "b": b, "other": None, "row": None, "column": None, "r": None, "freq": [{"at": int(k % size), "f": float(freq[k])} for k in at]}]
            for o in range(-(-n // size)):
                part = (r + r.T)[o * size : (o + 1) * size, at]
                i, j = np.nonzero(part)
                rows.append({"chr": "X", "sex": "male", "b": b, "other": o, "row": i, "column": j, "r": part[i, j], "freq": None})
            for row in rows:
                kinds = [("chr", pa.string()), ("sex", pa.string()), ("b", pa.int32()), ("other", pa.int32()), ("row", pa.list_(pa.int16())), ("column", pa.list_(pa.int16())), ("r", pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_pylist([row], pa.schema([*kinds, ("freq", pa.list_(pa.struct([("at", pa.int32()), ("f", pa.float32())])))]))

    pieces = pa.Table.from_batches(ld_npz.cut_columns(blocks(), {"X": n})).sort_by([(c, "ascending") for c in ("kind", "b", "at")])
    del blocks
    entry, names, most = None, set(), 0
    tracemalloc.start()
    with open(tmp_path / "x.npz", "wb") as f:
        for row in ld_npz.write_shards(iter(pieces.to_batches(max_chunksize=1)), {"X": (n, "sum")}, ld_npz.FORMAT):
            row = row.to_pylist()[0]
            names.add(row["name"])
            if row["part"] < 0:
                entry = row["entry"]
            else:
                most = max(most, len(row["content"]))
                f.write(row["content"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    whole = r + r.T + np.eye(n, dtype=np.float32)
    nnz = np.count_nonzero(whole)
    assert peak < 8 * nnz // 2 and most < 4 * ld_npz.CHUNK  # values and rows take 8 bytes an entry
    with np.load(tmp_path / "x.npz") as z:
        assert z["data"].dtype == np.float32 and z["indices"].dtype == z["indptr"].dtype == np.int32
        j, i = np.nonzero(whole.T)
        assert (z["indices"] == i).all() and (z["data"] == whole[i, j]).all() and (z["indptr"] == np.searchsorted(j, np.arange(n + 1))).all()
        assert (z["a1freq"] == freq).all() and z["shape"].tolist() == [n, n]
        meta = json.loads(bytes(z["metadata"]))
    ld_npz.check_metadata(meta, "x")
    said = json.loads(entry)
    ld_npz.check_entry(said, "x")
    ld_npz.check_agreement(said, meta, "x")
    assert names == {"ld_chrX_male.npz"} and said["file_md5"] == hashlib.md5((tmp_path / "x.npz").read_bytes()).hexdigest()
    with pytest.raises(ValueError, match="frequencies"):  # a piece that is missing
        list(ld_npz.write_shards(iter(pieces.filter(pa.compute.not_equal(pieces["b"], 1)).to_batches()), {"X": (n, "sum")}, ld_npz.FORMAT))


def test_fold_blocks(spark, tmp_path):
    """Each fault of a matrix is counted in the block where it is, and blocks of one triangle come back."""
    from helixframe.sources.ld_npz import fold_blocks, read_npz_blocks, read_npz_frequencies

    n, rng = 1_100, np.random.default_rng(6)
    r = np.triu(np.where(rng.random((n, n)) < 0.05, 2 * rng.random((n, n)) - 1, 0).astype(np.float32), 1)
    whole = r + r.T + np.eye(n, dtype=np.float32)
    meta = np.frombuffer(json.dumps({"chr": "X", "sex": "male", "matrix": "symmetric"}).encode(), np.uint8)
    freq = rng.random(n).astype(np.float32)

    def counts(whole, more=()):
        j, i = np.nonzero(whole.T)
        i, j, data = (np.append(a, [e[k] for e in more]) for k, a in enumerate((i, j, whole[i, j])))
        order = np.argsort(j, kind="stable")
        path = str(tmp_path / f"{len(list(tmp_path.iterdir()))}.npz")
        np.savez_compressed(path, data=data[order].astype(np.float32), indices=i[order].astype(np.int32), indptr=np.searchsorted(j[order], np.arange(n + 1)).astype(np.int32), shape=np.array([n, n]), a1freq=freq, metadata=meta)
        found = fold_blocks(read_npz_blocks(spark, [path], 20_000)).toPandas()
        return path, found, {c: int(found[c].sum()) for c in ("asymmetric", "bad_diagonal", "beyond", "twice", "diagonal")}

    path, found, fine = counts(whole)
    assert fine == {"asymmetric": 0, "bad_diagonal": 0, "beyond": 0, "twice": 0, "diagonal": n}
    got = np.zeros((n, n), np.float32)
    for b in found.itertuples():
        got[np.array(b.i, int) + b.bi * SIZE, np.array(b.j, int) + b.bj * SIZE] = b.r
    assert (got == r).all() and set(found["chr"]) == {"X"} and set(found["sex"]) == {"male"}
    assert [x["a1freq"] for x in read_npz_frequencies(spark, [path]).orderBy("local_idx").collect()] == freq.tolist()
    at = tuple(np.argwhere(r)[-1])
    odd = whole.copy()
    odd[at], odd[700, 700], odd[3, 3] = 0, 0.5, 0
    i, j = np.argwhere(r)[0]
    odd[i, j] = odd[j, i] = 1.5
    assert counts(odd, [(*np.argwhere(r)[9], 0.25)])[2] == {"asymmetric": 1, "bad_diagonal": 1, "beyond": 3, "twice": 1, "diagonal": n - 1}


def test_links_that_are_settled_are_not_compared(monkeypatch):
    """Scores are compared as small ranks, and only on links whose two variants are both open in one pruning."""
    rng = np.random.default_rng(8)
    n, m = 600, 21
    keys = np.where(rng.random((n, m)) < 0.1, np.inf, -rng.integers(0, 40, (n, m)).astype(np.float64))
    u, v = rng.integers(0, n, 5000), np.sort(rng.integers(0, n, 5000))
    u, v = u[u != v], v[u != v]
    own = prune.ranks(keys)
    assert own.dtype == np.uint16 and (prune.better(own, u, v) == prune.better(keys, u, v)).all()
    state = np.tile(~np.packbits(np.ones(m, bool)), (n, 1))
    kept, gone = state.copy(), state.copy()
    first = np.arange(n) < 10
    kept[first] = 0xFF  # ten that stay in all prunings, and that some go before by score
    gone[~first & (np.arange(n) < 300)] = 0xFF
    kept[~first & (np.arange(n) < 300)] = ~np.packbits(np.ones(m, bool))
    v = np.repeat(np.arange(300, n), 300).astype(np.int32)
    u = np.tile(np.arange(300), n - 300).astype(np.int32)
    seen, plain = [], prune.better
    monkeypatch.setattr(prune, "better", lambda k, a, b: (seen.append(len(a)), plain(k, a, b))[1])
    left, _ = prune.decide(own, kept, gone, u, v)
    assert not len(left) and sum(seen) == 0
    goes = np.isfinite(keys[:10]).any(axis=0)  # an infinite one removes nothing
    bits = np.unpackbits(gone[300:], axis=1)[:, :m].astype(bool)
    assert (bits == goes).all() and (np.unpackbits(kept[300:], axis=1)[:, :m] == ~goes).all()
