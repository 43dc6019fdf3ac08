"""Ranked lexical search over whole texts, by buckets of impact vectors of similar length.

A document's impact vector holds, for each term that some item asks for, what one occurrence of the term in an item adds to the
score; an item's vector holds how often it has each term. The score is their inner product. Impact vectors are put in order of
length and cut in buckets; a bucket whose longest vector cannot reach an item's k-th best score by the Cauchy-Schwarz
inequality ends that item's search, as those after it are shorter still. Inside a bucket the item's weightiest coordinates are added up
first, and what they and the lengths of both remainders cannot bring to that score is dropped. The survivors get
their whole score in 64-bit integers.

One pass over the texts keeps counts of asked terms only; statistics are sums over that table. No document is shuffled: each
task has buckets of its own, and hands on at most k rows an item.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.llm.common import forget, released, sliced, small_batches, stored, table

K = 20
BLOCK_BYTES = 4 << 20  # of items whose terms are looked for in one pass over the texts
RATIO = 0.9  # lengths in a bucket: its shortest to its longest
LEAST = 256  # vectors in a bucket, unless none are left
FOCUS = 6  # coordinates of an item that are looked at first
SEEDS = 1024  # longest vectors, whose k-th best score is a bound for all tasks
VECTOR_BYTES = 16 << 20  # of vectors that are put in order together

#: Characters that end a term are these ASCII ones; A-Z are lower-cased.
_ENDS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_FOLD = bytes.maketrans(_ENDS + bytes(range(0x41, 0x5B)), b" " * len(_ENDS) + bytes(range(0x61, 0x7B)))


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all characters beyond ASCII, as UTF-8; only A-Z are lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))))


def impacts(tf: np.ndarray, n: np.ndarray, w: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What an occurrence in an item adds to the score of a document with n terms, tf of them this one, of weight w. All int64, below 2**63."""
    m = 100 - 25 + 25 * n * n_docs // n_terms
    return w * (1_000_000_000 * tf // (1000 * tf + 12 * m))


class Items:
    """Items as sparse vectors over the terms that any of them has."""

    def __init__(self, keys: list[int], texts: list[str | None]):
        self.vocabulary: dict[bytes, int] = {}
        self.keys, self.terms, self.counts = [], [], []
        for key, text in zip(keys, texts, strict=True):
            found = Counter(terms_of(text))
            if found:
                self.keys.append(key)
                self.terms.append(np.array([self.vocabulary.setdefault(t, len(self.vocabulary)) for t in found], np.int64))
                self.counts.append(np.array(list(found.values()), np.int64))


class Best:
    """The k best rows of each item so far: highest score, then smallest id (null last)."""

    def __init__(self, items: int, k: int, floor: np.ndarray | None = None):
        self.k, self.scores = k, [np.empty(0, np.int64)] * items
        self.ids = [np.empty(0, np.int64)] * items
        self.floor = np.ones(items, np.int64) if floor is None else np.maximum(floor, 1)  # scores have to be above 0

    def add(self, item: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids[item], ids]), np.concatenate([self.scores[item], scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids[item], self.scores[item] = ids[order], scores[order]
        if len(order) == self.k:
            self.floor[item] = max(self.floor[item], self.scores[item][-1])


def buckets(lengths: np.ndarray, ratio: float = RATIO, least: int = LEAST) -> Iterator[tuple[int, int]]:
    """Runs of lengths (in falling order) that lie within ratio of the first, of at least so many."""
    start = 0
    while start < len(lengths):
        end = int(np.searchsorted(-lengths, -ratio * lengths[start], "right"))
        end = min(len(lengths), max(end, start + least))
        yield start, end
        start = end


def search(items: Items, best: Best, ids: np.ndarray, bounds: np.ndarray, terms: np.ndarray, values: np.ndarray, weights: np.ndarray, focus: int = FOCUS, ratio: float = RATIO, least: int = LEAST) -> int:
    """Puts rows (ids; terms and values of row i are those from bounds[i] to bounds[i + 1]) into best. Returns how many scores were computed whole."""
    row = np.repeat(np.arange(len(ids)), np.diff(bounds))
    square = np.bincount(row, values.astype(np.float64) ** 2, len(ids))
    order = np.argsort(-square, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    ids, square = ids[order], square[order]
    length = np.sqrt(square)
    at = place[row]  # place of each entry's row by length
    by = np.lexsort((at, terms))
    terms, at, values = terms[by], at[by], values[by]
    first = np.searchsorted(terms, np.arange(len(items.vocabulary) + 1))
    runs = list(buckets(length, ratio, least))
    whole = 0
    for i, (own, counts) in enumerate(zip(items.terms, items.counts, strict=True)):
        ranked = np.argsort(-(counts * weights[own]), kind="stable")
        own, counts = own[ranked], counts[ranked]
        size, rest = float(np.sqrt((counts**2).sum())), float(np.sqrt((counts[focus:] ** 2).sum()))
        postings = [(at[first[t] : first[t + 1]], values[first[t] : first[t + 1]] * c) for t, c in zip(own.tolist(), counts.tolist(), strict=True)]
        for lo, hi in runs:
            # lengths are rounded: a relative 1e-9 and one unit keep bounds safe, scores are exact
            if size * length[lo] * (1 + 1e-9) + 1 < best.floor[i]:
                break
            score, seen = np.zeros(hi - lo, np.int64), np.zeros(hi - lo)
            cuts = [(np.searchsorted(a, lo), np.searchsorted(a, hi)) for a, _ in postings]
            for (a, v), (x, y), c in zip(postings[:focus], cuts, counts.tolist(), strict=False):
                score[a[x:y] - lo] += v[x:y]
                seen[a[x:y] - lo] += (v[x:y] / c) ** 2
            bound = score + rest * np.sqrt(np.maximum(square[lo:hi] - seen, 0) + 1e-9 * square[lo:hi]) * (1 + 1e-9) + 1
            alive = bound >= best.floor[i]
            if not alive.any():
                continue
            for (a, v), (x, y) in zip(postings[focus:], cuts[focus:], strict=True):
                inside = alive[a[x:y] - lo]
                score[a[x:y][inside] - lo] += v[x:y][inside]
            alive &= score >= best.floor[i]
            whole += int(alive.sum())
            if alive.any():
                best.add(i, ids[lo:hi][alive], score[alive])
    return whole


def _counted(docs: DataFrame, items: Items) -> DataFrame:
    """(row, n, terms, counts) of docs (row, text): how many terms a text has, and how often it has each term of the items. Texts without terms have n = 0."""
    shared = docs.sparkSession.sparkContext.broadcast(items.vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = shared.value.get
        for batch in released(batches):
            for part in sliced(batch):
                sizes, terms, counts, bounds = [], [], [], [0]
                for text in part.column("text").to_pylist():
                    found = terms_of(text)
                    own = Counter(map(code, found))
                    own.pop(None, None)
                    sizes.append(len(found))
                    terms += own.keys()
                    counts += own.values()
                    bounds.append(len(terms))
                lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, kind)) for x, kind in ((terms, pa.int32()), (counts, pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(sizes, pa.int64()), *lists], ["row", "n", "terms", "counts"])

    return docs.mapInArrow(count, "row long, n long, terms array<int>, counts array<bigint>")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have VECTOR_BYTES."""
    wait: list[pa.RecordBatch] = []
    for batch in batches:
        wait.append(batch)
        if sum(b.nbytes for b in wait) >= VECTOR_BYTES:
            yield pa.Table.from_batches(wait).combine_chunks().to_batches()[0]
            wait = []
    if sum(len(b) for b in wait):
        yield pa.Table.from_batches(wait).combine_chunks().to_batches()[0]


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Ids (null is the largest), terms of the text, bounds, terms, counts."""
    ids = batch.column("row").fill_null(np.iinfo(np.int64).max).to_numpy()
    terms, counts = batch.column("terms"), batch.column("counts")
    bounds = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy())]).astype(np.int64)
    return ids, batch.column("n").to_numpy(), bounds, terms.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy()


def _searched(counted: DataFrame, items: Items, weights: np.ndarray, n_docs: int, n_terms: int, k: int, floor: np.ndarray | None) -> DataFrame:
    """(item, row, score): at most k rows of each item for each task."""
    shared = counted.sparkSession.sparkContext.broadcast((items, weights, floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, w, least = shared.value
        best = Best(len(own.keys), k, least)
        for batch in _gathered(batches):
            ids, n, bounds, terms, counts = _entries(batch)
            values = impacts(counts, np.repeat(n, np.diff(bounds)), w[terms], n_docs, n_terms)
            search(own, best, ids, bounds, terms, values, w)
        for i, key in enumerate(own.keys):
            if size := len(best.ids[i]):
                rows = pa.array(best.ids[i], pa.int64(), mask=best.ids[i] == np.iinfo(np.int64).max)
                yield pa.RecordBatch.from_arrays([pa.array([key] * size, pa.int64()), rows, pa.array(best.scores[i], pa.int64())], ["item", "row", "score"])

    return counted.filter("n > 0").mapInArrow(run, "item long, row long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items the k rows of docs of the highest score above 0; rank from 1, ties by smaller id (null last).

    Ids of docs are integers, those of items of any type. Each row counts as a document, also one that repeats an id or has none; rows of items that
    repeat id and text count once, and others that share an id (or have none) are ranked each by itself. Null, empty and other texts without a term are
    never found, ask for nothing and don't count as documents. Very long texts are counted whole. An empty table on either side gives no rows.
    Only the named columns are read. Items are searched in blocks of about block_bytes of text, a pass over docs for each.
    """
    spark = docs.sparkSession
    small_batches(spark)
    id_kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("long").alias("row"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).filter(F.coalesce(F.length("text"), F.lit(0)) > 0).distinct()
    asked = stored(asked.withColumn("key", F.monotonically_increasing_id()), "lexical-items")
    total = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    found = None
    for block in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block).select("key", "text").orderBy("key").collect()  # of bounded size
        own = Items([r["key"] for r in mine], [r["text"] for r in mine])
        if not own.keys:
            continue
        counted = stored(_counted(rows, own), "lexical-counts")
        n_docs, n_terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            break
        df = {r["term"]: r["count"] for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}  # terms of the block's items at most
        weights = np.array([weight(n_docs, df.get(t, 0)) for t in range(len(own.vocabulary))], np.int64)
        args = (own, weights, n_docs, n_terms, k)
        seeds = counted.orderBy(F.desc(F.size("terms"))).limit(SEEDS)
        tops = _searched(seeds, *args, None).groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k).collect()
        least = {r["item"]: r["least"] for r in tops}
        floor = np.array([least.get(key, 1) for key in own.keys], np.int64)
        part = stored(_searched(counted, *args, floor), "lexical-found")
        forget(counted)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {id_kind}, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("row"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    named = ranked.join(asked.select(F.col("key").alias("item"), "item_id"), "item")
    return named.select("item_id", "rank", F.col("row").cast(id_kind).alias("doc_id"), "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH d AS (
  SELECT rowid_ AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM (SELECT row_number() OVER () AS rowid_, doc_id, text FROM documents)
), q AS (
  SELECT item_id, term, count(*) AS c FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
  ) GROUP BY ALL
), s AS (SELECT count_if(len(t) > 0) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d), tf AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s), scored AS (
  SELECT item_id, r, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term), s GROUP BY item_id, r, doc_id
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
) WHERE rank <= 20
"""
