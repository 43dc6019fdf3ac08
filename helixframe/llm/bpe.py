"""BPE encoding and decoding with a public tokenizer.

Tree concatenation: a long text is cut in halves until leaves are small, leaves are encoded in parallel
(one Spark row each), and each join re-encodes a window around the cut, which grows until its first tokens agree
with those of the left side and its last tokens with those of the right side, ids and places both. Adjacent
tokens of a valid BPE encoding stay valid wherever they meet, so what agrees at both ends is exact.

Other texts are the trivial case: every run of ASCII white space is a boundary that no merge crosses, so
a text's encoding is the concatenation of those of its segments, which are cached within a bound.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helixframe.llm.common import only, own_cache, released, sliced, small_batches, table, texts_of

os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism

LEAF = 16_384  # code points
WINDOW = 256  # code points on each side of a cut, at first
MARGIN = 64  # code points between the cut and the tokens that have to agree
AGREE = 3  # tokens on each side
CACHED = 60_000  # segments that an encoder keeps

_WORD = re.compile(r"[^ \t-\r]+")
_SPACED = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
_SEPARATORS = re.compile(r"[\x1c-\x1f]")
_OTHER_SPACE = re.compile("[\u001c-\u001f\u0085\u00a0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

Tokens = tuple[np.ndarray, np.ndarray]  # ids, place of each token's first code point


def load_tokenizer(spec: str) -> Tokenizer:
    tok = Tokenizer.from_str(spec)
    tok.no_padding()
    tok.no_truncation()
    return tok


def encode_leaf(tok: Tokenizer, text: str, at: int = 0) -> Tokens:
    found = tok.encode(text, add_special_tokens=False)
    return np.array(found.ids, np.int32), np.array([s for s, _ in found.offsets], np.int64) + at


def join(tok: Tokenizer, text: str, at: int, cut: int, left: Tokens, right: Tokens, window: int = WINDOW, margin: int = MARGIN) -> Tokens:
    """Encoding of text from the encodings of text[:cut - at] and the rest; at: place of text's start."""
    end = at + len(text)
    before = after = window
    while True:
        a = b = None
        if cut - before > at:  # the last token at cut - before or earlier that starts with a code point
            a = int(np.searchsorted(left[1], cut - before, "right")) - 1
            while a > 0 and left[1][a] == left[1][a - 1]:
                a -= 1
        if cut + after < end:  # one past the window's last token
            b = int(np.searchsorted(right[1], cut + after, "left"))
            while b < len(right[0]) and b > 0 and right[1][b] == right[1][b - 1]:
                b += 1
        lo = left[1][a] if a is not None and a > 0 else at
        hi = right[1][b] if b is not None and b < len(right[0]) else end
        a, b = (a if lo > at else 0), (b if hi < end else len(right[0]))
        mid = encode_leaf(tok, text[lo - at : hi - at], int(lo))
        head = slice(a, a + AGREE)
        tail = slice(max(0, b - AGREE), b)
        left_ok = lo == at or (
            a + AGREE < len(left[0]) and left[1][a + AGREE] <= cut - margin and len(mid[0]) >= AGREE
            and all(np.array_equal(left[i][head], mid[i][:AGREE]) for i in (0, 1))
        )
        right_ok = hi == end or (
            b >= AGREE and right[1][b - AGREE] >= cut + margin and len(mid[0]) >= AGREE
            and all(np.array_equal(right[i][tail], mid[i][-AGREE:]) for i in (0, 1))
        )
        if left_ok and right_ok:
            return tuple(np.concatenate([left[i][:a], mid[i], right[i][b:]]) for i in (0, 1))
        before *= 1 if left_ok else 2
        after *= 1 if right_ok else 2


def join_all(tok: Tokenizer, pieces: list[str], leaves: list[Tokens], window: int = WINDOW, margin: int = MARGIN) -> Tokens:
    """Joins neighbours pairwise, level by level. leaves: places count from the start of the whole text."""
    at = list(np.cumsum([0] + [len(p) for p in pieces[:-1]]))
    while len(leaves) > 1:
        for i in range(0, len(leaves) - 1, 2):
            text = pieces[i] + pieces[i + 1]
            leaves[i], pieces[i] = join(tok, text, at[i], at[i + 1], leaves[i], leaves[i + 1], window, margin), text
        leaves, pieces, at = leaves[::2], pieces[::2], at[::2]
    return leaves[0]


def tree_encode(tok: Tokenizer, text: str, leaf: int = LEAF, window: int = WINDOW, margin: int = MARGIN) -> np.ndarray:
    if len(text) <= leaf:
        return encode_leaf(tok, text)[0]
    pieces = [text[i : i + leaf] for i in range(0, len(text), leaf)]
    return join_all(tok, pieces, [encode_leaf(tok, p, i * leaf) for i, p in enumerate(pieces)], window, margin)[0]


#: Fixed value: how byte-level BPE cuts a text before merges.
_BYTE_LEVEL = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def rank_encoder(spec: str) -> tiktoken.Encoding | None:
    """For a plain byte-level BPE whose ids follow its merges, the same encoding by ranks of byte strings, which is cheaper for
    short segments; None for other tokenizers."""
    j = json.loads(spec)
    pre, model = j["pre_tokenizer"] or {}, j["model"]
    if j["normalizer"] or pre.get("type") != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model["type"] != "BPE" or model["end_of_word_suffix"] or model["ignore_merges"]:
        return None
    vocabulary, special = model["vocab"], {t["content"] for t in j["added_tokens"]}
    merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != list(range(256, 256 + len(merged))):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; others follow from 256 on
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token not in special}
    return tiktoken.Encoding("ranks", pat_str=_BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})


class _Codes(dict):
    """Codes of segments; a segment that has none yet gets the next one and waits in `new`."""

    def __init__(self, known: dict[str, int] | None = None):
        super().__init__(known or {})
        self.new: list[str] = []

    def __missing__(self, segment: str) -> int:
        code = self[segment] = len(self)
        self.new.append(segment)
        return code


class SegmentEncoder:
    """Encodes many texts by their segments; keeps the ids of at most twice `cached` of them.

    drop_space: the tokenizer drops white space (segments are words); else a segment is a word with the
    white space before it.
    """

    def __init__(self, spec: str, drop_space: bool, cached: int = CACHED, leaf: int = LEAF):
        self.tok, self.drop_space, self.cached, self.leaf = load_tokenizer(spec), drop_space, cached, leaf
        self.ranked = rank_encoder(spec)
        if self.ranked:
            self.token_bytes = np.array([len(self.ranked.decode_single_token_bytes(i)) for i in range(self.ranked.max_token_value + 1)], np.int64)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.index = _Codes()
        self.ids, self.used = np.empty(1 << 16, np.int32), 0
        self.at, self.size = np.empty(0, np.int64), np.empty(0, np.int64)  # by code: where its ids start, how many

    def segments(self, text: str) -> list[str]:
        if self.drop_space:
            return text.split() if text.isascii() and not _SEPARATORS.search(text) else _WORD.findall(text)
        return [text] if text and _OTHER_SPACE.search(text) else _SPACED.findall(text)

    def _put(self, codes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(max(len(self.ids), len(ids)), np.int32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.at[codes], self.size[codes] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(ids)

    def _ranked_run(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words with white space before them, as one text: no token reaches across. And how many each has."""
        run = "".join(segments)
        ids = self.ranked.encode_to_numpy(run, disallowed_special=())
        sizes = list(map(len, segments)) if run.isascii() else [len(s.encode("utf-8")) for s in segments]
        ends = np.searchsorted(np.cumsum(self.token_bytes[ids]), np.cumsum(sizes), "left") + 1
        return ids.astype(np.int32), np.diff(ends, prepend=0)

    def _add(self, segments: list[str]) -> None:
        first = len(self.at)
        self.at, self.size = (np.concatenate([x, np.zeros(len(segments), np.int64)]) for x in (self.at, self.size))
        run: list[int] = []
        if self.ranked:
            white = frozenset(" \t\n\x0b\x0c\r")
            run = [i for i, s in enumerate(segments) if s[0] in white and s[-1] not in white and len(s) <= self.leaf]
            whole = "".join(segments)
            if _OTHER_SPACE.search(whole) or any(x in whole for x in self.special):
                run = [i for i in run if not _OTHER_SPACE.search(segments[i]) and not any(x in segments[i] for x in self.special)]
            if run:
                self._put(np.array(run) + first, *self._ranked_run([segments[i] for i in run]))
        rest = sorted(set(range(len(segments))).difference(run)) if run else range(len(segments))
        short, long = [i for i in rest if len(segments[i]) <= self.leaf], [i for i in rest if len(segments[i]) > self.leaf]
        found = [e.ids for e in self.tok.encode_batch_fast([segments[i] for i in short], add_special_tokens=False)] + [tree_encode(self.tok, segments[i], self.leaf) for i in long]
        if found:
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self._put(np.array(short + long) + first, np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())), sizes)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and where each text's ids start (one more than texts)."""
        parts = [self.segments(t) for t in texts]
        n = sum(map(len, parts))
        codes = np.fromiter(map(self.index.__getitem__, chain.from_iterable(parts)), np.int64, n)
        if self.index.new:
            self._add(self.index.new)
            self.index.new = []
        sizes = self.size[codes]
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.at[codes] - (ends - sizes), sizes) + np.arange(ends[-1] if n else 0)]
        bounds = np.concatenate([[0], ends])[np.cumsum([0] + [len(p) for p in parts])]
        if len(self.index) > 2 * self.cached:  # the first half stays
            self.index = _Codes({s: i for s, i in self.index.items() if i < self.cached})
            self.at, self.size = self.at[: self.cached], self.size[: self.cached]
            self.used = int((self.at + self.size).max(initial=0))
            self.ids = self.ids[: self.used].copy()
        return ids, bounds


_ENCODERS: dict[tuple[int, bool], SegmentEncoder] = own_cache("encoders", {})


def encoder(spec: str, drop_space: bool) -> SegmentEncoder:
    """The worker's own encoder: its cache serves all tasks of the worker."""
    only("encoders", "vocabulary")
    key = (hash(spec), drop_space)
    if key not in _ENCODERS:
        _ENCODERS[key] = SegmentEncoder(spec, drop_space)
    return _ENCODERS[key]


_VOCABULARY: dict[int, tuple[Tokenizer, list[str] | None]] = own_cache("vocabulary", {})


def decode(spec: str, ids: list[int]) -> str:
    """As the library's decode(ids, skip_special_tokens=False); without a decoder tokens are joined by a space."""
    if hash(spec) not in _VOCABULARY:
        tok = load_tokenizer(spec)
        _VOCABULARY[hash(spec)] = tok, None if tok.decoder else [tok.id_to_token(i) for i in range(tok.get_vocab_size())]
    tok, words = _VOCABULARY[hash(spec)]
    return tok.decode(ids, skip_special_tokens=False) if words is None else " ".join(map(words.__getitem__, ids))


def _lists(ids: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))


def encode_documents(docs: DataFrame, tokenizer_path: str, drop_space: bool, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """One row per row of docs: id, ids (array<int>), decoded (the library's decode of them).

    Null texts count as empty and have no ids. Repeated rows are encoded once each; an empty table gives no
    rows. Only id_col (of any type) and text_col are read. Texts of more than two leaves are dealt out by leaf, so that one
    long text is encoded by many tasks; only the joins meet in the task that owns the text.
    """
    with open(tokenizer_path, encoding="utf-8") as f:  # on the driver: of fixed size, sent to the tasks
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    long = F.coalesce(F.char_length("text"), F.lit(0)) > 2 * leaf

    def short_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec = shared.value
        enc = encoder(spec, drop_space)
        for batch in released(batches):
            for part in sliced(batch):
                ids, bounds = enc.encode(texts_of(part))
                listed = ids.tolist()
                text = [decode(spec, listed[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(ids, bounds), pa.array(text, pa.string())], ["doc_id", "ids", "decoded"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), texts_of(batch), strict=True):
                pieces = [text[i : i + leaf] for i in range(0, len(text), leaf)]
                n, key = len(pieces), key + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * n, pa.int64()), pa.array([doc_id.as_py()] * n, batch.column("doc_id").type), pa.array(range(n), pa.int32()), pa.array(pieces, pa.string())], ["key", "doc_id", "leaf", "text"]
                )

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(shared.value, drop_space).tok
        for batch in batches:
            found = [encode_leaf(tok, t) for t in batch.column("text").to_pylist()]
            bounds = np.cumsum([0] + [len(i) for i, _ in found])
            ids, places = (np.concatenate([f[i] for f in found] or [np.empty(0)]).astype(np.int32) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(ids, bounds), _lists(places, bounds)], [*batch.schema.names, "ids", "places"])

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        spec = shared.value
        pdf = pdf.sort_values("leaf")
        pieces = pdf["text"].to_list()
        found = [(np.asarray(i, np.int32), np.asarray(p, np.int64) + n * leaf) for n, (i, p) in enumerate(zip(pdf["ids"], pdf["places"], strict=True))]
        ids = join_all(encoder(spec, drop_space).tok, pieces, found)[0].tolist()
        return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[:1], "ids": [ids], "decoded": [decode(spec, ids)]})

    out = f"doc_id {kind}, ids array<int>, decoded string"
    short = rows.filter(~long).mapInArrow(short_texts, out)
    dealt = rows.filter(long).mapInArrow(cut, f"key long, doc_id {kind}, leaf int, text string").repartition("key", "leaf")
    tokens = dealt.mapInArrow(leaves, f"key long, doc_id {kind}, leaf int, text string, ids array<int>, places array<int>")
    return short.unionByName(tokens.groupBy("key").applyInPandas(joined, out))


def decode_documents(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids") -> DataFrame:
    """encoded with a column `decoded`; null ids give null."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def text_of(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: None if x is None else decode(shared.value, list(x)))

    return encoded.withColumn("decoded", text_of(ids_col))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), drop_space=True)
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
