"""Packing of token sequences by minimum bin slack.

Each task packs its own documents, so nothing is shuffled: full windows of a document go out at once, and
remainders wait in a pool of bounded size. A window takes the largest remainder and the multiset of the others
that fills it closest to capacity: a bitset holds the sums that can be reached, one shift for each power
of two of a length's count, and the counts are found by going back through the bitsets. Where even the best
multiset leaves slack, a remainder is cut. What a task has left at its end is cut at powers of two.
"""

from __future__ import annotations

from collections import Counter, defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.bpe import encoder
from helixframe.llm.common import released, sliced, small_batches, table, texts_of

CAPACITY = 1024
POOL = 4096  # remainders that are packed together
REST = 1024  # remainders that wait for more while there may be more


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length (at most counts) sum closest to capacity from below."""
    bits, mask, steps = 1, (1 << (capacity + 1)) - 1, []
    for length in sorted((x for x in counts if 0 < x <= capacity), reverse=True):
        left, k = min(counts[length], capacity // length), 1
        while left:
            take = min(k, left)
            steps.append((length, take, bits))
            bits |= (bits << (length * take)) & mask
            left, k = left - take, 2 * k
        if bits >> capacity & 1:
            break
    total, chosen = bits.bit_length() - 1, Counter()
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] += take
            total -= length * take
    return dict(chosen)


class Packer:
    """Packs remainders (document, start, ids, doc_tokens); hands out rows of (…, sequence, offset)."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.sequence = capacity, first_sequence
        self.pool: dict[int, deque] = defaultdict(deque)
        self.counts: Counter = Counter()
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        full = len(ids) - len(ids) % self.capacity
        for start in range(0, full, self.capacity):
            self.emit([(doc_id, start, ids[start : start + self.capacity], len(ids))])
        if full < len(ids):
            self.wait((doc_id, full, ids[full:], len(ids)))

    def wait(self, piece: tuple) -> None:
        self.pool[len(piece[2])].append(piece)
        self.counts[len(piece[2])] += 1

    def take(self, length: int) -> tuple:
        self.counts[length] -= 1
        if not self.counts[length]:
            del self.counts[length]
        return self.pool[length].popleft()

    def emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, ids, doc_tokens in pieces:
            self.rows.append((doc_id, start, ids, doc_tokens, self.sequence, at))
            at += len(ids)
        self.sequence += 1

    def pack(self, leave: int = 0) -> None:
        """Packs until at most `leave` remainders wait; with 0, all of them."""
        while (n := sum(self.counts.values())) > leave:
            largest = max(self.counts)
            first = self.take(largest)
            chosen = best_fill(self.counts, self.capacity - largest)
            size = largest + sum(length * k for length, k in chosen.items())
            if size < self.capacity and n == 1 + sum(chosen.values()):
                return self.last([first] + [self.take(length) for length, k in chosen.items() for _ in range(k)])
            pieces = [first] + [self.take(length) for length, k in chosen.items() for _ in range(k)]
            if size < self.capacity:  # a cut fills the slack
                doc_id, start, ids, doc_tokens = self.take(max(self.counts))
                slack = self.capacity - size
                pieces.append((doc_id, start, ids[:slack], doc_tokens))
                self.wait((doc_id, start + slack, ids[slack:], doc_tokens))
            self.emit(pieces)

    def last(self, pieces: list[tuple]) -> None:
        """Cuts what is left at powers of two, which need no padding."""
        size = sum(len(p[2]) for p in pieces)
        for room in (1 << b for b in range(size.bit_length() - 1, -1, -1) if size >> b & 1):
            own = []
            while room:
                doc_id, start, ids, doc_tokens = pieces.pop(0)
                own.append((doc_id, start, ids[:room], doc_tokens))
                if len(ids) > room:
                    pieces.insert(0, (doc_id, start + room, ids[room:], doc_tokens))
                room -= len(own[-1][2])
            self.emit(own)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is its ids and end_id, so a null or empty text is end_id alone. Repeated rows are packed once
    each; an empty table gives no rows. Only id_col (of any type) and text_col are read. Sequence ids are unique, not gapless. Very long texts are cut as others are.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value, False)
        packer = Packer(capacity, TaskContext.get().partitionId() << 40)

        def out(arrow_id: pa.DataType) -> pa.RecordBatch:
            doc_id, start, ids, doc_tokens, sequence, offset = zip(*packer.rows, strict=True)
            bounds = np.cumsum([0] + [4 * len(x) for x in ids]).astype(np.int32)
            data = np.concatenate(ids).astype("<u4")
            binary = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
            columns = [pa.array(doc_id, arrow_id), pa.array(start, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), binary]
            columns += [pa.array(x, pa.int64()) for x in (doc_tokens, sequence, offset)]
            packer.rows = []
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        arrow_id = None
        for batch in released(batches):
            arrow_id = batch.column("doc_id").type
            for part in sliced(batch):
                ids, bounds = enc.encode(texts_of(part))
                for i, doc in enumerate(part.column("doc_id").to_pylist()):
                    packer.add(doc, np.append(ids[bounds[i] : bounds[i + 1]], np.int32(end_id)))
                if sum(packer.counts.values()) > POOL:
                    packer.pack(REST)
                if packer.rows:
                    yield out(arrow_id)
        packer.pack()
        if packer.rows:
            yield out(arrow_id)

    return rows.mapInArrow(pack, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
