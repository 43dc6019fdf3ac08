"""Byte-level BPE from a file of ranks, by a sentencepiece model that is written out directly.

Each byte stands as a code point of its own, so every token of the vocabulary is a sentencepiece of these; its score is its
negative rank, and text is not normalised. Both libraries then merge the adjacent pair of the least rank, the leftmost
first. Nothing is trained. Decoding is the inverse mapping, from ids to byte strings.

A run of white space and the run of other characters after it are a segment that no match of the pattern crosses, so a text's ids are
those of its segments, which are cached within a bound.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.bpe import SegmentEncoder, _Codes
from helixframe.llm.common import only, own_cache, released, sliced, small_batches, table, texts_of

#: Numbers of fields and kinds of sentencepiece's public model format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
TEXT, SCORE, KIND, NORMAL, UNKNOWN = 1, 2, 3, 1, 2
MODEL_TYPE, VOCAB_SIZE, UNK_ID, BPE = 3, 4, 40, 2
NAME, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE_SPACES = 1, 3, 4, 5

#: White space of the pattern's \s, as a character class.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SEGMENT = re.compile(f"[{SPACE}]*+[^{SPACE}]++|[{SPACE}]++")
_WHITE = frozenset(chr(c) for c in range(0x3001) if re.match(f"[{SPACE}]", chr(c)))
CACHE = 200_000  # segments that an encoder keeps
RUN = 256  # pre-tokens that are encoded as one string
SEPARATOR = chr(0x200)  # stands for no byte


def read_ranks(lines: Iterable[bytes]) -> list[bytes]:
    """Tokens by rank, from lines of a base64 token and its rank. Ranks count from 0, and every single byte is a token."""
    ranks = {int(rank): base64.b64decode(token) for token, rank in (x.split() for x in lines if x.strip())}
    if sorted(ranks) != list(range(len(ranks))) or len(set(ranks.values())) != len(ranks):
        raise ValueError("ranks must count from 0, each for one token")
    tokens = [ranks[i] for i in range(len(ranks))]
    if missing := {bytes([b]) for b in range(256)}.difference(tokens):
        raise ValueError(f"no token for byte {min(missing)[0]}")
    return tokens


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | float | int) -> bytes:
    """One field of a protocol buffer: bytes, a float or a whole number."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def as_pieces(data: bytes) -> str:
    return (np.frombuffer(data, np.uint8) + np.uint16(0x100)).astype("<u2").tobytes().decode("utf-16-le")


def _split(data: list[bytes]) -> list[str]:
    """as_pieces of each."""
    whole, ends = as_pieces(b"".join(data)), list(accumulate(map(len, data)))
    return [whole[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model: ids are ranks, and one id more is the unknown piece that the format wants; no text reaches it."""
    if len(tokens) >= 1 << 24:
        raise ValueError("ranks must be exact in single precision")
    pieces = [_field(TEXT, as_pieces(t).encode()) + _field(SCORE, -float(rank)) + _field(KIND, NORMAL) for rank, t in enumerate(tokens)]
    pieces.append(_field(TEXT, b"<unk>") + _field(SCORE, 0.0) + _field(KIND, UNKNOWN))
    trainer = _field(MODEL_TYPE, BPE) + _field(VOCAB_SIZE, len(pieces)) + _field(UNK_ID, len(tokens))
    normalizer = _field(NAME, b"identity") + _field(DUMMY_PREFIX, 0) + _field(EXTRA_SPACES, 0) + _field(ESCAPE_SPACES, 0)
    return b"".join(_field(PIECES, p) for p in pieces) + _field(TRAINER, trainer) + _field(NORMALIZER, normalizer)


class PieceEncoder(SegmentEncoder):
    """Encodes texts by segments of pre-tokens; keeps the ids of at most twice `cached` segments."""

    def __init__(self, model: bytes, tokens: list[bytes], pattern: str, cached: int = CACHE):
        self.cached, self.tokens, self.pattern = cached, tokens, regex.compile(pattern)
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.index = _Codes()
        self.ids, self.used = np.empty(1 << 16, np.int32), 0
        self.at, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.unknown = self.pieces.unk_id()
        # a pre-token that is a token is that token, whether or not merges lead to it
        alone = self.pieces.encode(_split(tokens), num_threads=1)
        self.whole = {t: i for i, (t, found) in enumerate(zip(tokens, alone, strict=True)) if found != [i]}

    def segments(self, text: str) -> list[str]:
        return _SEGMENT.findall(text)

    def pre_tokens(self, segments: list[str]) -> tuple[list[str], np.ndarray]:
        """Pre-tokens of all segments, and how many each has. Segments from white space to other characters are matched as one run."""
        inner = [i for i, s in enumerate(segments) if s[0] in _WHITE and s[-1] not in _WHITE]
        others = sorted(set(range(len(segments))).difference(inner)) if len(inner) < len(segments) else []
        found = self.pattern.findall("".join([segments[i] for i in inner]))
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        if inner and (not len(ends) or ends[-1] < sum(len(segments[i]) for i in inner)):  # a pattern that leaves something out
            inner, others, found, ends = [], list(range(len(segments))), [], ends[:0]
        counts = np.zeros(len(segments), np.int64)
        counts[inner] = np.diff(np.searchsorted(ends, np.cumsum([len(segments[i]) for i in inner]), "left") + 1, prepend=0)
        if not others:
            return found, counts
        at = np.cumsum(counts) - counts
        own = {i: self.pattern.findall(segments[i]) for i in others}
        counts[others] = [len(own[i]) for i in others]
        merged: list[str] = []
        last = 0
        for i in others:
            merged += found[last : at[i]] + own[i]
            last = at[i]
        return merged + found[last:], counts

    def encode_pre_tokens(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens, and how many each has. Many are encoded as one string, with a code point between them that no piece has."""
        data = [p.encode() for p in parts]
        runs = self.pieces.encode([SEPARATOR.join(_split(data[lo : lo + RUN])) for lo in range(0, len(data), RUN)], num_threads=1)
        ids = np.fromiter(chain.from_iterable(x + [self.unknown] for x in runs), np.int64)
        ends = np.flatnonzero(ids == self.unknown)
        ids, sizes = ids[ids != self.unknown].astype(np.int32), np.diff(ends, prepend=-1) - 1
        if self.whole and (hit := [i for i, d in enumerate(data) if d in self.whole]):
            each = np.split(ids, np.cumsum(sizes)[:-1])
            for i in hit:
                each[i] = np.array([self.whole[data[i]]], np.int32)
            ids, sizes = np.concatenate(each), np.array([len(e) for e in each], np.int64)
        return ids, sizes

    def _add(self, segments: list[str]) -> None:
        first = len(self.at)
        self.at, self.size = (np.concatenate([x, np.zeros(len(segments), np.int64)]) for x in (self.at, self.size))
        parts, counts = self.pre_tokens(segments)
        ids, sizes = self.encode_pre_tokens(parts) if parts else (np.empty(0, np.int32), np.empty(0, np.int64))
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        self._put(np.arange(len(segments)) + first, ids, np.diff(ends))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_PIECES: dict[int, PieceEncoder] = own_cache("pieces", {})


def _encoder(model: bytes, tokens: list[bytes], pattern: str) -> PieceEncoder:
    """The worker's own encoder: its cache serves all tasks of the worker."""
    only("pieces")
    key = hash((model, pattern))
    if key not in _PIECES:
        _PIECES[key] = PieceEncoder(model, tokens, pattern)
    return _PIECES[key]


def _vocabulary(path: str) -> tuple[bytes, list[bytes]]:
    with open(path, "rb") as f:  # on the driver: of fixed size, sent to the tasks
        tokens = read_ranks(f)
    return sentencepiece_model(tokens), tokens


def _binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def encode_bytes(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded (binary, the bytes of these ids).

    Null texts count as empty and have no ids. Special tokens are ordinary text. What the pattern matches nowhere is left out; it must not
    match across the end of a word (white space after other characters).
    Repeated rows are encoded once each; an empty table gives no rows; ids are of any type, also null. Only id_col and text_col are read, so other
    columns may have any name. A very long text is encoded as others are, by one task, in time n log n.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_vocabulary(ranks_path))
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(*shared.value, pattern)
        for batch in released(batches):
            for part in sliced(batch):
                ids, bounds = enc.encode(texts_of(part))
                data, listed = ids.astype("<u4"), ids.tolist()
                places = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
                columns = [part.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), _binary([data[a:b].tobytes() for a, b in places]), _binary([enc.decode(listed[a:b]) for a, b in places])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"])

    return rows.mapInArrow(encode, f"doc_id {kind}, n_tokens long, ids binary, decoded binary")


def decode_bytes(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """encoded with a column `decoded` (binary) in place of any of that name: the bytes of the ids (binary, as encode_bytes gives them).

    Null ids give null, empty ones an empty string; an id that the vocabulary lacks, or bytes that are no whole ids, are an error.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(_vocabulary(ranks_path)[1])

    @F.pandas_udf("binary")
    def bytes_of(ids: pd.Series) -> pd.Series:
        tokens = shared.value
        return ids.map(lambda x: None if x is None else b"".join(map(tokens.__getitem__, np.frombuffer(x, "<u4").tolist())))

    return encoded.withColumn("decoded", bytes_of(ids_col))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = encode_bytes(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
