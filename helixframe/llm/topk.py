"""Exact top-k by inner product: columnar branch-and-bound.

Queries and candidates are dealt into blocks by a hash of their id, and each pair of blocks is one group of
bounded size. Inside a group candidates lie in vertical layout (one row per dimension); scores are added up
a block of dimensions at a time. What the dimensions to come can add is at most the product of the remaining
norms, so candidates whose bound is below the query's k-th best score so far are dropped and the survivors
compacted before the next block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.llm.common import stored, table

BLOCK_ROWS = 16384  # candidates in a block
BLOCK_QUERIES = 4096
LEAST_BLOCKS = 12  # candidate blocks even for a small table, so that all cores work
CHUNK = 1024  # candidates that are scored at once
STEP = 16  # dimensions in a block
EXACT = 2.0**26  # scores of vectors of smaller norms are exact in doubles
LEAST, MOST = -(1 << 63), (1 << 63) - 1  # of a long


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and floor(256 * x) of each component as a double; rows with a null vector, or a component that is null or whose 256-fold is not finite, go."""
    x = F.transform(F.col(vector_col), lambda c: F.lit(256.0) * c.cast("double"))
    usable = F.col(vector_col).isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = lambda c: F.when(F.abs(c) < 2.0**52, F.floor(c).cast("double")).otherwise(c)  # noqa: E731  # larger doubles are whole, and may be beyond a long
    return vectors.filter(usable).select(F.col(id_col).alias("vec_id"), F.transform(x, whole).alias("v"))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def search_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score) with the k best candidates of each query at least: exact, ties to the smaller id; vectors without dimensions score 0."""
    big_q, big_c = (np.sqrt((x * x).sum(axis=1)) >= EXACT for x in (q, c))
    out = _search_exact(q_ids[big_q], q[big_q], c_ids, c, k) + _search_exact(q_ids[~big_q], q[~big_q], c_ids[big_c], c[big_c], k)
    return out + _search(q_ids[~big_q], q[~big_q], c_ids[~big_c], c[~big_c], k)


def _search_exact(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """In whole numbers of any size, for the few vectors that want it; scores beyond a long count as its ends."""
    if not len(q_ids) or not len(c_ids):
        return []
    whole = lambda x: np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)
    q, c = whole(q), whole(c)
    out = []
    for i, own in zip(q_ids.tolist(), q, strict=True):
        best = sorted((-min(max(s, LEAST), MOST), j) for s, j in zip((c * own).sum(axis=1), c_ids.tolist(), strict=True) if j != i)[:k]
        out += [(i, j, -s) for s, j in best]
    return out


def _search(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    if not len(q_ids) or not len(c_ids):
        return []
    dims = c.shape[1]
    order = np.argsort(-(c * c).sum(axis=0), kind="stable")  # heavy dimensions first: bounds close sooner
    q, columns = q[:, order], np.ascontiguousarray(c[:, order].T)
    cuts = [*range(0, max(dims, 1), STEP), dims]  # [0, 0] without dimensions
    rest_q = [np.sqrt((q[:, b:] ** 2).sum(axis=1)) for b in cuts[1:]]
    rest_c = [np.sqrt((columns[b:] ** 2).sum(axis=0)) for b in cuts[1:]]
    out = []
    best = [(np.empty(0, np.int64), np.empty(0)) for _ in q_ids]
    for lo in range(0, len(c_ids), CHUNK):
        part, part_ids = columns[:, lo : lo + CHUNK], c_ids[lo : lo + CHUNK]
        first = q[:, : cuts[1]] @ part[: cuts[1]]
        for i, (ids, scores) in enumerate(best):
            floor = scores[k - 1] if len(scores) >= k else -np.inf
            got, alive = first[i], np.flatnonzero(part_ids != q_ids[i])
            got = got[alive]
            for j in range(len(cuts) - 1):
                if j:
                    got = got + q[i, cuts[j] : cuts[j + 1]] @ part[cuts[j] : cuts[j + 1]][:, alive]
                # norms are rounded: half a unit keeps the bound safe, scores themselves are exact integers
                stay = got + rest_q[j][i] * rest_c[j][lo + alive] + 0.5 >= floor
                if not stay.all():
                    alive, got = alive[stay], got[stay]
                if not len(alive):
                    break
            if len(alive):
                best[i] = _best(np.concatenate([ids, part_ids[alive]]), np.concatenate([scores, got]), k)
    for i, (ids, scores) in enumerate(best):
        out += [(int(q_ids[i]), int(x), int(s)) for x, s in zip(ids, scores, strict=True)]
    return out


def one_each(ids: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A vector for each id: the least, component by component."""
    if len(np.unique(ids)) == len(ids):
        return ids, v
    order = np.lexsort((*v.T[::-1], ids))
    first = np.concatenate([[True], ids[order][1:] != ids[order][:-1]])
    return ids[order][first], v[order][first]


def exact_topk(queries: DataFrame, candidates: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """queries and candidates: (vec_id, v array<double> of integers). Returns query_id, rank, vec_id, score.

    A candidate with the query's own id is left out. Ties go to the smaller id; with fewer than k candidates
    all are returned; without candidates or queries no rows. Vectors are compared only with those of the
    same number of dimensions; empty ones score 0 with each other. Null ids take no part. Of rows that repeat an id
    with as many dimensions one counts: the least vector, component by component. ids are integers. Scores beyond a long count as its ends.
    """
    keyed = [x.filter("vec_id IS NOT NULL").withColumn("dims", F.size("v")) for x in (queries, candidates)]
    n_q, n_c = keyed[0].count(), keyed[1].count()
    q_blocks, c_blocks = max(1, -(-n_q // block_queries)), max(LEAST_BLOCKS, -(-n_c // block_rows))
    deal = lambda blocks: F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    q = keyed[0].withColumn("qb", deal(q_blocks)).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))))
    c = keyed[1].withColumn("cb", deal(c_blocks)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            own, others = (one_each(x["vec_id"].to_numpy(np.int64), np.stack(x["v"].to_list())) for x in (left, right))
            rows = search_block(*own, *others, k)
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = q.groupBy("qb", "cb", "dims").cogroup(c.groupBy("qb", "cb", "dims")).applyInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = stored(quantised(table(spark, sf_dir, "embeddings")), "topk-vectors")
    return exact_topk(vectors.filter("vec_id % 50 = 0"), vectors, 5)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
) WHERE rank <= 5
"""
