import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import secrets, topk
from helixframe.llm.secrets import MASK, Scanner, mask_secrets, scan_secrets
from helixframe.llm.topk import exact_topk, quantised, search_block


def brute_topk(q_ids, q, c_ids, c, k):
    out = []
    for i, x in zip(q_ids, q, strict=True):
        scored = sorted((-int(x @ y), int(j)) for j, y in zip(c_ids, c, strict=True) if j != i)[:k]
        out += [(int(i), j, -s) for s, j in scored]
    return out


@pytest.mark.parametrize("chunk", [7, 1024])
@pytest.mark.parametrize("dims", [1, 5, 64, 100])
def test_search_block(dims, chunk, monkeypatch):
    monkeypatch.setattr(topk, "CHUNK", chunk)
    rng = np.random.default_rng(dims)
    c = rng.integers(-3 if dims < 10 else -256, 4 if dims < 10 else 256, (3000, dims)).astype(float)
    c[100:200] = c[0]  # ties
    ids = rng.permutation(3000)
    assert sorted(search_block(ids[:40], c[:40], ids, c, 5)) == sorted(brute_topk(ids[:40], c[:40], ids, c, 5))


def test_exact_topk(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.1, 32)]) for i in range(400)]
    rows += [(400, None), (401, [float("nan")] * 32), (402, [float("inf")] + [0.0] * 31), (450, [None] + [0.1] * 31), (None, [0.1] * 32)]
    vectors = quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    found = exact_topk(vectors.filter("vec_id % 50 = 0"), vectors, 5, block_rows=50, block_queries=3).collect()
    good = rows[:400]
    v = np.floor(256 * np.array([r[1] for r in good], np.float32).astype(float))
    want = brute_topk(range(0, 400, 50), v[::50], range(400), v, 5)
    assert sorted((r["query_id"], r["vec_id"], r["score"]) for r in found) == sorted(want)
    for q in range(0, 400, 50):
        own = sorted((r["rank"], -r["score"], r["vec_id"]) for r in found if r["query_id"] == q)
        assert [r[0] for r in own] == [1, 2, 3, 4, 5] and own == sorted(own, key=lambda r: r[1:])


def test_repeated_ids_and_large_components(spark):
    rows = [(0, [2.0, 1.0]), (0, [1.0, 1.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [1e18, 0.0]), (5, [3e18, 0.0]), (6, [-3e18, 1.0]), (7, [0.5, 1e9])]
    vectors = quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = sorted(tuple(r) for r in exact_topk(vectors.filter("vec_id = 0"), vectors, 9).collect())
    one = {3: (256, 0), 4: (int(256e18), 0), 5: (int(768e18), 0), 6: (-int(768e18), 256), 7: (128, 256 * 10**9)}
    score = {i: max(min(256 * (a + b), (1 << 63) - 1), -(1 << 63)) for i, (a, b) in one.items()}
    want = sorted((-s, i) for i, s in score.items())
    assert [(r[1], r[2], r[3]) for r in found] == [(n, i, -s) for n, (s, i) in enumerate(want, 1)]


def test_few_or_no_candidates(spark):
    few = quantised(spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5]), (50, [1.0, 2.0])], "vec_id long, embedding array<float>"))
    got = sorted(tuple(r) for r in exact_topk(few.filter("vec_id % 50 = 0"), few).collect())
    assert [r[:3] for r in got] == [(0, 1, 50), (0, 2, 1), (50, 1, 0), (50, 2, 1)]
    assert exact_topk(few.limit(0), few.limit(0)).count() == 0


def test_vectors_without_dimensions(spark):
    rows = quantised(spark.createDataFrame([(0, []), (50, []), (3, []), (7, [1.0]), (100, [0.5])], "vec_id long, embedding array<float>"))
    got = sorted(tuple(r) for r in exact_topk(rows.filter("vec_id % 50 = 0"), rows).collect())
    assert got == [(0, 1, 3, 0), (0, 2, 50, 0), (50, 1, 0, 0), (50, 2, 3, 0), (100, 1, 7, 128 * 256)]
    assert search_block(np.array([1]), np.empty((1, 0)), np.array([1, 2]), np.empty((2, 0)), 5) == [(1, 2, 0)]


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_spans(t):
    found = [("assign", *m.span()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], secrets.BASE.index(s[0])))


PARTS = ["password", "passwd", "secret", "TOKEN", "api_key", "ApiKey", "=", ":", " ", "'", '"', "abcdef", "a", "b1", "AKIA", "AK", "0123456789abcdef", "é", "日", "XYZ0", "-", "ghp_", "\n"]
SCANNER = Scanner()


@given(texts=st.lists(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), min_size=1, max_size=8), block=st.sampled_from([2, 5, 16, 512]))
@settings(max_examples=300, deadline=None)
def test_spans_are_those_of_the_rules(texts, block):
    before, secrets.BLOCK = secrets.BLOCK, block
    try:
        data = [t.encode() for t in texts]
        found = SCANNER.scan(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0] + [len(d) for d in data]))
    finally:
        secrets.BLOCK = before
    for i, t in enumerate(texts):
        assert [s for s in found.get(i, []) if s[0] in secrets.BASE] == brute_spans(t)


def test_more_kinds():
    t = "ghp_" + "a1B2" * 9 + " xoxb-123456789012 -----BEGIN RSA PRIVATE KEY-----"
    found = SCANNER.scan(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0]
    assert [s[0] for s in found] == ["github", "slack", "pem"]


def test_scan_and_mask(spark, docs, empty):
    assert {len(r["spans"]) for r in scan_secrets(docs).collect()} == {0}
    assert scan_secrets(empty).count() == 0 and mask_secrets(empty).count() == 0
    assert mask_secrets(docs).exceptAll(docs).count() == 0 and mask_secrets(docs).count() == docs.count()
    t = "é token = 'abcdefgh' and " + "0" * 30
    one = spark.createDataFrame([(1, t, len(t), "keep")], "doc_id long, text string, n_chars long, spans string")
    assert [tuple(s) for s in scan_secrets(one).first()["spans"]] == [("assign", 2, 19), ("hex", 25, 55)]
    masked = mask_secrets(one).first()
    assert masked["text"] == f"é {MASK}' and {MASK}" and masked["n_chars"] == len(masked["text"]) and masked["spans"] == "keep"
