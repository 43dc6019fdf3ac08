"""LD queries over pairs whose r * r is 1/20 itself, held against whole numbers. The SQL's corr() puts them on either side by the order of its rows."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from helixframe.plans.catalog import QUERIES, SQL
from tests.test_queries import duck

PAIRS = 20  # of each contig


@pytest.fixture(scope="module")
def ties(tmp_path_factory):
    """A folder with vectors on 1 and X, numbers of the vectors of each contig, and for each shard the pairs that stay with their r, and those of them that are ties.

    Each two variants have 28 calls of females and 28 of males in common. In either sex one has 10, 8, 10 calls of 0, 1, 2 and the other 8, 12, 8, of which those beside 1
    are the same in 10 and opposite in 6: (28 * 4)^2 * 20 = (28 * 20) * (28 * 16).
    """
    rng, root = np.random.default_rng(3), tmp_path_factory.mktemp("ties")
    one, two = np.repeat([2, 0, 1], (10, 10, 8)), np.repeat([2, 0, 1, 0, 2, 1], (5, 3, 2, 5, 3, 10))
    numbers, calls, shards, odd = {}, {}, {}, np.arange(64) % 2
    for label, first in (("1", 0), ("X", 22)):
        k = numbers[label] = first + np.add.outer(391 * np.arange(PAIRS), (0, 23)).ravel()
        seen = np.add.outer(k, np.arange(64)) % 17 != 0
        g = calls[label] = rng.integers(0, 3, (2 * PAIRS, 64))
        for p in range(0, 2 * PAIRS, 2):
            for sex in (0, 1):
                at = rng.permutation(np.flatnonzero(seen[p] & seen[p + 1] & (odd == sex)))
                g[p, at], g[p + 1, at] = one, two
        for sex, of in (("", (0, 1)), ("female", (1,)), ("male", (0,))):
            has = (seen & np.isin(odd, of)).astype(object)  # whole numbers of any size
            x = g * has
            n, c = has @ has.T, [(x @ has.T), (has @ x.T)]
            both, of_x, of_y = n * (x @ x.T) - c[0] * c[1], n * ((x * x) @ has.T) - c[0] ** 2, n * (has @ (x * x).T) - c[1] ** 2
            near = {(i, j): both[i, j] / (of_x[i, j] * of_y[i, j]) ** 0.5 for i in range(len(k)) for j in range(i + 1, len(k)) if 20 * both[i, j] ** 2 >= of_x[i, j] * of_y[i, j]}
            equal = {(i, j) for i, j in near if 20 * both[i, j] ** 2 == of_x[i, j] * of_y[i, j]}
            assert PAIRS <= len(equal) < len(near)
            shards[label, sex] = near, equal
    table = {"vec_id": pa.array(np.concatenate(list(numbers.values())), pa.int64()), "embedding": pa.array((np.concatenate(list(calls.values())) - 1.0).tolist(), pa.list_(pa.float32()))}
    pq.write_table(pa.table(table), root / "embeddings.parquet")
    return str(root), numbers, shards


def test_ld_distribution(spark, ties):
    """The SQL's pairs are among these, and ties are all that it lacks."""
    root, _, shards = ties
    got = {(r["chr"], r["sex"], r["i"], r["j"]): r["r"] for r in QUERIES["ld_distribution"](spark, root).collect()}
    own = [("1", ""), ("X", "female"), ("X", "male")]
    assert got == pytest.approx({(*k, *at): r for k in own for at, r in shards[k][0].items()}, abs=1e-5)
    of_sql = {r[:4] for r in duck(root).execute(f"SELECT chr, sex, i, j FROM ({SQL['ld_distribution']})").fetchall()}
    assert of_sql <= set(got) and set(got) - of_sql <= {(*k, *at) for k in own for at in shards[k][1]}


def test_ld_multiply(spark, ties):
    root, numbers, shards = ties
    want = {}
    for label, k in numbers.items():
        r2 = np.eye(len(k))
        for (i, j), r in shards[label, ""][0].items():
            r2[i, j] = r2[j, i] = r * r
        want |= {(label, n // 23): v for n, v in zip(k.tolist(), r2 @ (k % 10), strict=True)}
    assert {(r["chr"], r["local_idx"]): r["value"] for r in QUERIES["ld_multiply"](spark, root).collect()} == pytest.approx(want, abs=1e-4)


def test_ld_store(spark, ties):
    root, _, shards = ties
    want = {(*k, 2 * PAIRS, 2 * PAIRS + 2 * len(shards[k][0])) for k in (("1", ""), ("X", "female"), ("X", "male"))}
    assert {(r["chr"], r["sex"], r["num_snp"], r["nnz"]) for r in QUERIES["ld_store"](spark, root).collect()} == want


def test_ld_symmetrize(spark, ties):
    root, _, shards = ties
    want = {(c, 2 * PAIRS + 2 * len(shards[c, ""][0]), 2 * PAIRS, len(shards[c, ""][0])) for c in ("1", "X")}
    assert {(r["chr"], r["nnz"], r["diagonal"], r["upper"]) for r in QUERIES["ld_symmetrize"](spark, root).collect()} == want
