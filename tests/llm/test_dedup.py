import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from helixframe.llm import exact_dedup as exact
from helixframe.llm import minhash
from helixframe.llm.exact_dedup import DedupState, exact_dedup
from helixframe.llm.minhash import connected_components, estimate, keep_one_each, link_block, minima, near_duplicates, pack_bits, shingle_sets, text_bytes

BLANK = re.compile(r"[\x20\x09-\x0D]")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[BLANK.sub("", text or "")].append((-len(text or ""), doc_id is None, doc_id))
    best = {k: min(v)[2] for k, v in groups.items()}
    return sorted(
        ((str(d), str(best[k := BLANK.sub("", t or "")]), len(groups[k]), d == best[k], hashlib.sha256(k.encode()).hexdigest()) for d, t in rows)
    )


@pytest.mark.parametrize("digest_hex", [64, 1])
def test_exact_dedup(docs, digest_hex):
    """With one hex digit nearly all digests collide, and only the full texts tell."""
    rows = exact_dedup(docs, digest_hex=digest_hex).collect()
    want = brute_exact([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["digest"]) for r in rows)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert [g[4] for g in got] == [w[4][:digest_hex] for w in want]


def test_exact_dedup_in_micro_batches(spark):
    rows = [(i, f"text {i % 7}" + " " * (i % 3)) for i in range(400)]
    found = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), micro_batches=4).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in found) == [w[:4] for w in brute_exact(rows)]


def test_rows_added_to_state_that_is_there(spark, tmp_path):
    """A second batch, through another object of the same folder, gives what all rows at once give."""
    rows = [(i, f"text {i % 11}" + " " * (i * 7 % 5)) for i in range(300)]
    kind, path = "doc_id long, text string", f"file://{tmp_path}/state"
    for own in (rows[:120], [], rows[120:]):
        DedupState(spark, path).add(spark.createDataFrame(own, kind).repartition(3))
    found = DedupState(spark, path).result().select("doc.doc_id", "keep_id", "group_size", "kept", "row_kept").collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in found) == [w[:4] for w in brute_exact(rows)]
    assert sum(r["row_kept"] for r in found) == 11


def test_one_row_of_each_group_stays(spark):
    rows = [(None, "a b", 1), (None, "ab", 2), (5, "ab", 3), (5, "ab", 3), (5, "cd", 4), (None, "x", 5), (None, "x", 5), (7, None, 6), (8, " ", 7)]
    found = exact.keep_one_each(spark.createDataFrame(rows, "doc_id long, text string, digest int").repartition(4)).collect()
    assert sorted(tuple(map(str, r)) for r in found) == sorted([("None", "a b", "1"), ("5", "cd", "4"), ("None", "x", "5"), ("8", " ", "7")])


def test_large_groups_are_not_dealt_by_key(spark, monkeypatch):
    from helixframe.llm import common

    monkeypatch.setattr(common, "HOT_GROUPS", 3)
    rows = [(i, f"t{i % 5 if i < 60 else i}") for i in range(80)]
    found = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in found) == [w[:4] for w in brute_exact(rows)]


def test_empty(empty):
    assert exact_dedup(empty).count() == 0
    assert near_duplicates(empty).count() == 0


def shingles(text, n):
    words = WORDS.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def brute_near(rows, n, percent):
    ids = sorted({d for d, _ in rows if d is not None})
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [(d, shingles(t, n)) for d, t in rows if d is not None]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return {(d, len(shingles(t, n)), d if d is None else root(d), d is None or root(d) == d) for d, t in rows}


def family(rng, size, words=120, edits=14):
    base = [f"w{rng.integers(500)}" for _ in range(words)]
    out = []
    for _ in range(size):
        own = list(base)
        for at in rng.integers(0, words, rng.integers(0, edits)):
            own[at] = f"e{rng.integers(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(spark, docs, n):
    rng = np.random.default_rng(n)
    texts = family(rng, 60, edits=10 if n == 2 else 5) + family(rng, 12) + [" ".join(f"w{rng.integers(500)}" for _ in range(80)) for _ in range(30)]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(100 + i, t) for i, t in enumerate(texts)]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n).collect()
    assert len(found) == len(rows)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found} == brute_near(rows, n, 80)


def test_blocks_of_a_bucket_in_a_grid(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    rng = np.random.default_rng(9)
    rows = list(enumerate(family(rng, 80, edits=16)))
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found} == brute_near(rows, 2, 80)


def test_shingle_sets():
    texts = ["A b\tC", "", None, "one", " a b a b ", "É é", "x" * 9000 + " y", "a b c"]
    sets, at = shingle_sets(*text_bytes(pa.array(texts)))
    own = [set(sets[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert [len(s) for s in own] == [len(shingles(t, 2)) for t in texts]
    again, at2 = shingle_sets(*text_bytes(pa.array(["a B c"])))
    assert set(again.tolist()) == own[0]


def test_estimate_is_unbiased():
    rng = np.random.default_rng(4)
    for j in (0.2, 0.5, 0.8, 0.95):
        got = []
        for _ in range(20):
            n = 600
            common = rng.integers(0, 1 << 63, int(2 * n * j / (1 + j)), np.uint64)
            sets = [np.sort(np.concatenate([common, rng.integers(0, 1 << 63, n - len(common), np.uint64)])) for _ in range(2)]
            m = minima(np.concatenate(sets), np.array([0, n, 2 * n]))
            bits = pack_bits(m)
            got.append(estimate(bits[0], bits[1]))
        assert abs(np.mean(got) - j) < 0.03


def test_components(spark):
    rng = np.random.default_rng(6)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2)) if a != b] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        lo, hi = sorted((root(a), root(b)))
        parent[hi] = lo
    found = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {(r["node"], r["component"]) for r in found} == {(x, root(x)) for x in parent} and len(found) == len(parent)


def test_keep_one_each_keeps_columns(docs):
    kept = keep_one_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "7", "8", "9", "10", "11", "12", "None"])  # rows that repeat an id are told apart, so one of 10 stays
    assert link_block is minhash.link_block


@pytest.mark.parametrize("block", [6, 1024])
def test_frequent_keys_are_dealt_in_parts(spark, monkeypatch, block):
    """A bucket of 150 near copies in parts with leaders of their own, beside small families."""
    monkeypatch.setattr(minhash, "PART", 10)
    monkeypatch.setattr(minhash, "SPOKES", 3)
    monkeypatch.setattr(minhash, "BLOCK", block)
    if block == 6:  # more frequent keys than a broadcast takes
        monkeypatch.setattr(minhash, "is_small", lambda *a: False)
        monkeypatch.setattr(minhash, "HOT_GROUPS", 2)
    rng = np.random.default_rng(12)
    rows = list(enumerate(family(rng, 150, words=200, edits=8) + family(rng, 30, edits=16) + family(rng, 9)))
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 2).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found} == brute_near(rows, 2, 80)


def test_ids_must_be_integers(spark):
    with pytest.raises(TypeError):
        near_duplicates(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
