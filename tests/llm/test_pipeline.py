"""The whole pipeline against a brute-force chain, on rows with null, repeated and clashing ids."""

from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from helixframe.llm.secrets import MASK
from helixframe.llm.toxicity import features, fit_ftrl
from helixframe.llm.words import WordTable
from tests.llm.test_dedup import BLANK, shingles
from tests.llm.test_models import fold
from tests.llm.test_search_scan import brute_spans

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def documents():
    rng = np.random.default_rng(17)
    say = lambda n: " ".join(f"w{rng.integers(400)}" for _ in range(n))
    rows = [(i, say(30) + (" vile filth" if i % 5 == 0 else "")) for i in range(200)]
    base, other = say(120).split(), say(90)
    rows += [(300 + i, " ".join(base[:k] + [f"new{k}"] + base[k + 1 :])) for i, k in enumerate((3, 60, 119))]  # near copies
    rows += [(1000, None), (1001, ""), (1002, " \n "), (1003, "alone"), (1004, "one two three four"), (1005, "say token = 'abcdefgh1' to nobody at all")]
    rows += [(400, other), (400, other), (400, "  " + other + "  "), (401, other), (None, other)]  # exact copies
    rows += [(500, "same id first text of some words here"), (500, "same id quite another text that must stay"), (None, "no id but a text of its own"), (None, "no id but a text of its own"), (None, "no id and something else again")]
    rows += [(None, " ".join(base[:20] + ["gap"] + base[21:]))]  # a near copy without an id
    return rows + [(600, "long text " + say(6000))]


def not_toxic(rows, labels):
    trained = sorted(i for i in labels if fold(i, 4) != 2)
    texts = {i: min(t or "" for j, t in rows if j == i) for i in trained}
    some, w, bias = fit_ftrl([texts[i] for i in trained], np.array([float(labels[i]) for i in trained]))
    weight, words = dict(zip(some.tolist(), w.tolist(), strict=True)), WordTable()
    score = lambda t: 1 / (1 + np.exp(-(bias + sum(weight.get(f, 0) * n for f, n in zip(*map(np.ndarray.tolist, features(t or "", words)), strict=True)))))
    return [r for r in rows if score(r[1]) < corpus_pipeline.TOXIC]


def without_copies(rows):
    best = {}
    for r in rows:
        key, rank = BLANK.sub("", r[1] or ""), (-len(r[1] or ""), r[0] is None, r[0])
        if key not in best or rank < best[key][0]:
            best[key] = rank, r
    return [r for _, r in best.values()]


def without_near_copies(rows):
    sets, groups = [shingles(t, 5) for _, t in rows], list(range(len(rows)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                groups = [groups[j] if g == groups[i] else g for g in groups]
    members = defaultdict(list)
    for g, r in zip(groups, rows, strict=True):
        members[g].append(r)
    return [min(m, key=lambda r: (r[0] is None, r[0])) for m in members.values()]


def masked(text):
    for _, start, end in sorted(brute_spans(text or ""), key=lambda s: -s[1]):
        text = text[:start] + MASK + text[end:]
    return text


def test_pipeline(spark, tmp_path):
    rows = documents()
    labels = {i: int(i % 5 == 0) for i in range(200)}
    docs = spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, y) for i, y in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want, now = rows, spark.read.parquet(f"{tmp_path}/documents.parquet")
    brute = [lambda r: not_toxic(r, labels), without_copies, without_near_copies, lambda r: [(i, masked(t)) for i, t in r]]
    for (name, stage), own in zip(corpus_pipeline.STAGES[:-1], brute, strict=True):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now, before, want = spark.read.parquet(f"{tmp_path}/{name}"), len(want), own(want)
        assert now.columns == docs.columns and (name == "secrets") == (len(want) == before), name
        assert Counter(tuple(r) for r in now.select("doc_id", "text").collect()) == Counter(want), name
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sizes = Counter((i, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in want)
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in pieces if r["start"] == 0) == sizes
    assert sum(r["length"] for r in pieces) == sum(n * k for (_, n), k in sizes.items())
    held = defaultdict(list)
    for r in pieces:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 1024


def test_pipeline_on_empty_tables(spark, tables):
    assert corpus_pipeline.run(spark, tables).count() == 0
