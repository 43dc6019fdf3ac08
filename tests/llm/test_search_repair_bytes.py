import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import byte_bpe, conversations, lexical
from helixframe.llm.byte_bpe import PieceEncoder, decode_bytes, encode_bytes, op13_byte_bpe, read_ranks, sentencepiece_model
from helixframe.llm.conversations import damaged, op12_conversation_repair, parse, repair_conversations
from helixframe.llm.lexical import Best, Items, op11_lexical_search, rank_documents, terms_of

SMALL, RANKS = "/root/testdata/sf0.001", public_tokenizers.path("byte_bpe_50k.tiktoken")

# byte-level BPE


@pytest.fixture(scope="module")
def known():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("known", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def pieces():
    with open(RANKS, "rb") as f:
        tokens = read_ranks(f)
    return PieceEncoder(sentencepiece_model(tokens), tokens, public_tokenizers.PATTERN, cached=50)


BITS = ["the", " cat", "'ll", "'S", "'s", "  ", "\t\t ", "\n\n", " ", " \t\t x", "\x85", "\x1c", "  ", "᠎", "　", "日本語", "😀", "é", "123", "½", "--", "<|endoftext|>", "x" * 40, "\x00", "﻿", "Ⅷ"]


@given(st.lists(st.lists(st.sampled_from(BITS) | st.text(max_size=4), max_size=20).map("".join), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_ids_are_those_of_the_library(known, pieces, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, bounds = pieces.encode(texts)
    for t, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        assert ids[a:b].tolist() == known.encode_ordinary(t)
        assert pieces.decode(ids[a:b].tolist()) == t.encode()


def test_every_code_point(known, pieces):
    for lo in range(0, 0x110000, 0x4000):
        texts = ["".join(f"a{chr(c)}1{chr(c)} {chr(c)}{chr(c)} b\n" for c in range(at, at + 0x100) if not 0xD800 <= c < 0xE000) for at in range(lo, lo + 0x4000, 0x1000)]
        ids, bounds = pieces.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == known.encode_ordinary_batch(texts)


def test_vocabularies():
    single = [bytes([b]) for b in range(256)]
    tokens = [*single, b"ab", b"bc", b"abcd"]  # abcd is no merge of two tokens, but a token
    lines = [base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)]
    assert read_ranks([*lines, b"\n"]) == tokens
    own = PieceEncoder(sentencepiece_model(tokens), tokens, r"\S+")
    want = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    for t in ("abcd", "abc", "xabcd", "abab bcbc", "", "é"):
        assert own.encode([t])[0].tolist() == want.encode_ordinary(t)
    with pytest.raises(ValueError, match="byte 0"):
        read_ranks(lines[1:][::-1] and [base64.b64encode(t) + b" %d" % i for i, t in enumerate(single[1:])])
    with pytest.raises(ValueError, match="count from 0"):
        read_ranks(lines[1:])


def test_encode_bytes(spark, docs, empty, known):
    got = encode_bytes(docs, RANKS, public_tokenizers.PATTERN)
    assert got.count() == docs.count()
    key = lambda r: (r[0] is None, r[0], r[1])
    want = sorted(((r["doc_id"], len(ids := known.encode_ordinary(r["text"] or "")), np.array(ids, "<u4").tobytes(), (r["text"] or "").encode()) for r in docs.collect()), key=key)
    assert sorted(((r["doc_id"], r["n_tokens"], bytes(r["ids"]), bytes(r["decoded"])) for r in got.collect()), key=key) == want
    back = decode_bytes(got.withColumnRenamed("decoded", "before"), RANKS)
    assert back.filter("decoded <> before OR decoded IS NULL").count() == 0
    assert decode_bytes(spark.createDataFrame([(None,)], "ids binary"), RANKS).first()["decoded"] is None
    assert encode_bytes(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    long = "ab" * 300_000
    one = encode_bytes(spark.createDataFrame([("x", long)], "doc_id string, text string"), RANKS, public_tokenizers.PATTERN).first()
    assert bytes(one["decoded"]) == long.encode() and one["doc_id"] == "x"


def test_op13(spark, known):
    got = {r["doc_id"]: r for r in op13_byte_bpe(spark, SMALL).collect()}
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    assert len(got) == len(docs)
    for doc_id, text in zip(docs["doc_id"], docs["text"], strict=True):
        ids, r = known.encode_ordinary(text or ""), got[doc_id]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


# ranked lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_ranking(docs, items, k=20):
    """docs and items: (id, text). As the score is stated."""
    found = [(i, Counter(t), len(t)) for i, text in docs if (t := plain_terms(text))]
    n_docs, n_terms = len(found), sum(n for _, _, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in items:
        rows = []
        for doc_id, c, n in found:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = sum(int(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in plain_terms(text) if t in c)
            if score > 0:
                rows.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, rank, r[3], -r[0]) for rank, r in enumerate(sorted(rows)[:k], 1)]
    return out


def order(rows):
    return sorted(rows, key=lambda r: (str(r[0]), r[1], r[3], str(r[2])))


WORDS = ["alpha", "Beta", "gamma", "DELTA", "x9", "Éclair", "éclair", "日本", "a-b", "don't", "zeta", "eta", "theta", "İota", " "]


@given(st.lists(st.lists(st.sampled_from(WORDS), max_size=12).map(" ".join), max_size=40), st.lists(st.lists(st.sampled_from(WORDS), max_size=10).map(" ".join), max_size=5), st.integers(1, 4), st.sampled_from([1, 3, 100]))
@settings(max_examples=150, deadline=None)
def test_search_is_exact(texts, asked, k, least):
    docs, items = list(enumerate(texts)), list(enumerate(asked))
    own = Items([i for i, _ in items], asked)
    counted = [terms_of(t) for t in texts]
    n_docs, n_terms = sum(map(bool, counted)), sum(map(len, counted))
    codes = [Counter(own.vocabulary[t] for t in c if t in own.vocabulary) for c in counted]
    df = Counter(t for c in codes for t in c)
    weights = np.array([lexical.weight(n_docs, df[t]) for t in range(len(own.vocabulary))], np.int64)
    bounds = np.cumsum([0] + [len(c) for c in codes])
    terms, counts = (np.array([x for c in codes for x in side(c)], np.int64) for side in (dict.keys, dict.values))
    n = np.repeat([len(c) for c in counted], np.diff(bounds)).astype(np.int64) if texts else np.empty(0, np.int64)
    best = Best(len(own.keys), k)
    if len(terms):
        lexical.search(own, best, np.arange(len(texts)), bounds, terms, lexical.impacts(counts, n, weights[terms], n_docs, n_terms), weights, focus=2, least=least)
    got = [(key, rank, int(i), int(s)) for n, key in enumerate(own.keys) for rank, (i, s) in enumerate(zip(best.ids[n], best.scores[n], strict=True), 1)]
    assert got == plain_ranking(docs, items, k)


def test_buckets_are_left_out(monkeypatch):
    own = Items([0], ["a b c d e f g h"])
    terms = np.tile(np.arange(8), 3000)
    values = np.repeat(np.arange(3000, 0, -1), 8) * 100
    whole = lexical.search(own, best := Best(1, 20), np.arange(3000), np.arange(0, 24001, 8), terms, values, np.ones(8, np.int64))
    assert best.ids[0].tolist() == list(range(20)) and whole <= 600  # one bucket of 3000 rows


def test_terms():
    assert [t.decode() for t in terms_of("Ab-C9 É_İ\x7fz y")] == plain_terms("Ab-C9 É_İ\x7fz y") == ["ab", "c9", "É", "İ", "z y"]


def test_rank_documents(spark, docs, empty):
    more = [(20 + i, " ".join(WORDS[i % 7 : i % 7 + 5])) for i in range(40)] + [(20, "alpha"), (None, "alpha beta gamma")]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + more
    all_docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    asked = [("p", "the cat beta BETA"), ("q", None), ("q2", ""), ("r", "—- ."), ("s", "alpha gamma x9 lorem"), ("p", "the cat beta BETA"), (None, "ipsum one"), ("t", "unheard of"), ("u", "zeta")]
    items = spark.createDataFrame([(*a, 1) for a in asked], "item_id string, text string, score int")
    want = plain_ranking(rows, list(dict.fromkeys(asked)), 5)
    assert order(map(tuple, rank_documents(all_docs, items, 5).collect())) == order(want)
    assert order(map(tuple, rank_documents(all_docs, items, 5, block_bytes=20).collect())) == order(want)
    for d, i in ((empty, items), (docs, items.limit(0)), (empty, items.limit(0))):
        got = rank_documents(d, i)
        assert got.count() == 0 and got.columns == ["item_id", "rank", "doc_id", "score"]


def test_op11(spark):
    docs, items = (list(pd.read_parquet(f"{SMALL}/{t}.parquet")[[i, "text"]].itertuples(index=False, name=None)) for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert order(map(tuple, op11_lexical_search(spark, SMALL).collect())) == order(plain_ranking(docs, items))


# repair of conversations

LANGUAGE = re.compile(r"(s?(ua)+)?")


def plain_repairs(rows, most):
    """Every repair of rows (letters of `terminal`) that costs at most so much: (cost, audit)."""
    out = []

    def go(at, cost, audit, said):
        if cost > most or not re.fullmatch(r"s?(ua)*u?", said):
            return
        if at == len(rows) and LANGUAGE.fullmatch(said):
            out.append((cost, audit))
        for c in "ua":
            go(at, cost + 3, audit + "I", said + c)
        if at == len(rows):
            return
        row = rows[at]
        go(at + 1, cost + 4, audit + "D", said)
        if row != "d":
            more = 3 if row.isupper() else 0
            go(at + 1, cost + more, audit + "K", said + row.lower())
            for c in "ua":
                go(at + 1, cost + 3 + more, audit + "R", said + c)

    go(0, 0, "", "")
    return min(out) if out else None


@given(st.text("suaxSUAXd", max_size=5))
@settings(max_examples=120, deadline=None)
def test_parse_is_the_cheapest_repair(rows):
    cost, audit = parse(rows)
    assert plain_repairs(rows, cost) == (cost, audit)


@given(st.text("suaxSUAXd", min_size=2, max_size=24), st.data())
@settings(max_examples=100, deadline=None)
def test_every_split_gives_the_same_cell(rows, data):
    at = data.draw(st.integers(1, len(rows) - 1))
    assert conversations.combine(conversations.block(rows[:at]), conversations.block(rows[at:])) == conversations.block(rows)


def step_by_step(letters):
    """Least (cost, audit) for each state, row by row: shortest paths, for conversations of any length."""
    steps = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    best = {0: (0, "")}

    def insert(best):
        for _ in range(4):
            for c in "ua":
                for p, q in steps[c].items():
                    if p in best:
                        best[q] = min(best.get(q, (math.inf, "")), (best[p][0] + 3, best[p][1] + "I"))
        return best

    best = insert(best)
    for row in letters:
        more, after = 3 if row.isupper() else 0, {}
        for p, (cost, audit) in best.items():
            moves = [(p, 4, "D")]
            if row != "d":
                moves += [(steps[c][p], 3 + more, "R") for c in "ua" if p in steps[c]]
                moves += [(steps[row.lower()][p], more, "K")] if p in steps.get(row.lower(), {}) else []
            for q, price, edit in moves:
                after[q] = min(after.get(q, (math.inf, "")), (cost + price, audit + edit))
        best = insert(after)
    return min(best[q] for q in (0, 3) if q in best)


def plain_repair(table, crc=zlib.crc32):
    """table: (conv_id, turn, role, text). As the contract states it; rows of one turn are in any order if they are equal."""
    convs = defaultdict(list)
    for conv, turn, role, text in table:
        rows = convs[conv]
        said = lambda x: " " if x is None else str(x)
        kind = crc(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0]))
        seen, letters, faults = set(), "", Counter()
        for _, role, text in rows:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            c = role[:1] if role[:1] in ("s", "u", "a") else "x"
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            letters += "d" if fault in ("blank", "duplicate") else c.upper() if fault else c
        initials = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit = step_by_step(letters)
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        total, lines, left = len(audit) - audit.count("D"), [], iter(rows)
        for edit in audit:
            row = (None, None, "") if edit == "I" else next(left)
            if edit != "D":
                role = row[1] if edit == "K" else ("user", "assistant")[(len(lines) - total % 2) % 2]
                lines.append(f"{role}:{row[2]}")
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, sha))
    return sorted(out, key=str)


RESULT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
TURNS = "conv_id long, turn long, role string, text string"


def repaired(frame):
    return sorted(map(tuple, repair_conversations(frame, damaged(frame)).select(RESULT).collect()), key=str)


def test_longer_parse():
    rng = np.random.default_rng(7)
    for n in (0, 1, 7, 8, 9, 64, 300):
        letters = "".join(rng.choice(list("suaxSUAXd"), n))
        assert parse(letters) == step_by_step(letters)


def test_op12(spark):
    for sf in (SMALL, "/root/testdata/sf0.01"):
        table = pd.read_parquet(f"{sf}/conversations.parquet")[["conv_id", "turn", "role", "text"]]
        got = sorted(map(tuple, op12_conversation_repair(spark, sf).select(RESULT).collect()), key=str)
        assert got == plain_repair(table.itertuples(index=False, name=None))


def test_difficult_conversations(spark, monkeypatch):
    rows = [(1, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(900)]  # over several tasks and chunks
    rows += [(2, None, None, None), (2, 3, "user", None), (2, 7, "", "x"), (None, 1, "user", "Hi."), (None, None, "assistant", "No")]
    rows += [(3, 5, "user", "Same.")] * 40 + [(3, 6, "assistant", "Yes!")] * 3 + [(3, t, "user", "Same.") for t in range(20, 60)]
    rows += [(4, 1, "system", "S."), (4, 2, "Sys", "é 日本語?"), (4, 9, "user", "y" * 3_000_000 + "."), (4, 10, "tool", " \t. \n")]
    rows += [(5, t, "user", "") for t in range(4)] + [(6, -5, "user", "a"), (6, 2**40, "assistant", "b.")]
    rows += [(7, t, "system", "Only.") for t in (1, 2, 3)]
    rng = np.random.default_rng(3)
    for c in range(10, 60):
        for t in range(int(rng.integers(1, 12))):
            rows.append((c, t if rng.random() < 0.9 else None if t == 0 else t + 100, str(rng.choice(["system", "user", "assistant", "bot"])), str(rng.choice(["A.", "B?", "c", " ", "D!  ", f"{t}."]))))
    frame = spark.createDataFrame(rows, TURNS).withColumn("cost", __import__("pyspark").sql.functions.lit("clash"))
    want = plain_repair(rows)
    assert repaired(frame) == want
    monkeypatch.setattr(conversations, "CHUNK_ROWS", 3)
    monkeypatch.setattr(conversations, "BLOCK", 2)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert repaired(frame) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_no_conversations(spark):
    assert repaired(spark.createDataFrame([], TURNS)) == []
    gone = next(t for t in range(1000) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    assert repaired(spark.createDataFrame([(9, gone, "user", "Hi.")], TURNS)) == [(9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
