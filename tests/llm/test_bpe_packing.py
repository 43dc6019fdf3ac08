import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import bpe, packing
from helixframe.llm.bpe import encode_documents, join_all, load_tokenizer, tree_encode
from helixframe.llm.packing import best_fill, pack_documents

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
SPEC = {p: open(p, encoding="utf-8").read() for p in (WORD, BYTE)}
TOKENIZERS = {p: load_tokenizer(s) for p, s in SPEC.items()}
PARTS = ["hello", "World", " ", "  ", "\n", "\t", "'s", "'ll", "don't", "123", "!!", "é", "é", "日本", "<|endoftext|>", "<|startoftext|>", " ", "\x1c", "İ", "ﬁ", "😀", "aaaaaaaaaaaaaaaaaaaa", "…"]
text = st.lists(st.sampled_from(PARTS), max_size=60).map("".join)


def ids(path, t):
    return TOKENIZERS[path].encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
@given(t=text)
@settings(max_examples=150, deadline=None)
def test_tree_joins_are_exact(path, t):
    assert tree_encode(TOKENIZERS[path], t, leaf=60, window=40, margin=16).tolist() == ids(path, t)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_tree_joins_of_unsplit_text(path):
    rng = np.random.default_rng(3)
    for alphabet in ("ab", "abcdefghij", "!?", "日本語x", "the an in "):
        t = "".join(rng.choice(list(alphabet), 4000))
        assert tree_encode(TOKENIZERS[path], t, leaf=300, window=64, margin=16).tolist() == ids(path, t)


@pytest.mark.parametrize("path", [WORD, BYTE])
@given(texts=st.lists(text, max_size=6))
@settings(max_examples=100, deadline=None)
def test_segments_are_exact(path, texts):
    enc = bpe.SegmentEncoder(SPEC[path], path == WORD, cached=20)
    for _ in range(2):  # the second time from a cache that has been cut
        found, bounds = enc.encode(texts)
        assert [found[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [ids(path, t) for t in texts]


def test_join_all_of_an_odd_number_of_leaves():
    t = "some words to be cut " * 40
    pieces = [t[i : i + 120] for i in range(0, len(t), 120)]
    leaves = [bpe.encode_leaf(TOKENIZERS[BYTE], p, i * 120) for i, p in enumerate(pieces)]
    assert len(pieces) % 2 and join_all(TOKENIZERS[BYTE], pieces, leaves)[0].tolist() == ids(BYTE, t)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encode_documents(docs, path):
    rows = encode_documents(docs, path, path == WORD, leaf=200).collect()  # long texts go the distributed way
    want = sorted((str(r["doc_id"]), ids(path, r["text"] or "")) for r in docs.collect())
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in rows) == want
    for r in rows:
        assert r["decoded"] == TOKENIZERS[path].decode(list(r["ids"]), skip_special_tokens=False)


@pytest.mark.parametrize("kind", ["smallint", "decimal(20,0)", "string", "binary", "date"])
def test_ids_of_any_type(spark, kind):
    shown = {"date": "DATE'2024-02-29'", "binary": "X'0A00'"}.get(kind, f"CAST(7 AS {kind})")
    rows = spark.sql(f"SELECT {shown} AS doc_id, t AS text FROM VALUES ('a b'), (repeat('long words ', 90)) v(t) UNION ALL SELECT NULL, repeat('none ', 200)")
    want = sorted((str(r["doc_id"]), ids(BYTE, r["text"])) for r in rows.collect())
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in encode_documents(rows, BYTE, False, leaf=200).collect()) == want
    packed = pack_documents(rows, BYTE)
    assert packed.schema["doc_id"].dataType == rows.schema["doc_id"].dataType
    assert {str(r["doc_id"]) for r in packed.collect()} == {i for i, _ in want}


def test_empty_tables(empty):
    assert encode_documents(empty, WORD, True).count() == 0
    assert pack_documents(empty, BYTE).count() == 0


def test_decode_documents(docs):
    found = bpe.decode_documents(encode_documents(docs, BYTE, False).select("doc_id", "ids", "decoded").withColumnRenamed("decoded", "want"), BYTE)
    assert found.filter("decoded <> want").count() == 0


@given(counts=st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=5), capacity=st.integers(0, 30))
@settings(max_examples=200, deadline=None)
def test_best_fill_is_optimal(counts, capacity):
    chosen = best_fill(counts, capacity)
    assert all(0 < k <= counts[length] for length, k in chosen.items())
    total = sum(length * k for length, k in chosen.items())
    sums = [sum(length * k for length, k in zip(counts, ks, strict=True)) for ks in product(*(range(c + 1) for c in counts.values()))]
    assert total == max(s for s in sums if s <= capacity)


def check_packing(rows, want, capacity=1024):
    """want: ids of each document (list of lists by id, repeats allowed)."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for doc_id, texts in want.items():
        own = sorted(pieces[doc_id], key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == sum(len(t) for t in texts)
        if len(texts) == 1:
            at = 0
            for r in own:
                assert (r["start"], r["doc_tokens"]) == (at, len(texts[0]))
                assert r["ids"] == np.array(texts[0][at : at + r["length"]], "<u4").tobytes()
                at += r["length"]
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_pack_documents(docs):
    rows = pack_documents(docs, BYTE).collect()
    want = defaultdict(list)
    for r in docs.collect():
        want[r["doc_id"]].append([*ids(BYTE, r["text"] or ""), 0])
    assert check_packing(rows, want) == 0


def test_packer_of_many_remainders():
    rng = np.random.default_rng(1)
    packer = packing.Packer(64, 0)
    want = {i: [rng.integers(0, 9, rng.integers(1, 200)).tolist()] for i in range(300)}
    for i, (x,) in want.items():
        packer.add(i, np.array(x, np.int32))
        if i % 50 == 0:
            packer.pack(20)
    packer.pack()
    rows = [dict(zip(("doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"), r, strict=True)) for r in packer.rows]
    for r in rows:
        r |= {"length": len(r["ids"]), "ids": r["ids"].astype("<u4").tobytes()}
    assert check_packing(rows, want, 64) == 0


def test_crc_of_binary(docs):
    from pyspark.sql import functions as F

    for r in pack_documents(docs, BYTE).select("ids", F.crc32("ids").alias("c")).collect():
        assert r["c"] == zlib.crc32(r["ids"])
