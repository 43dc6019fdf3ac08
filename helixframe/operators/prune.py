"""Greedy pruning over blocks of the variant axis.

By falling score each variant that is still there removes its correlated neighbours. A task has the neighbouring
variants of one group of blocks: it decides what depends on its own group, and on what is known of others, and hands on
only links between variants that are still open. Then neighbouring groups exchange what they have decided, a
bit for each pruning and variant, and groups grow. So long chains of falling scores along a contig take few rounds.
Many prunings with other scores go together over one copy of the links. Links pass by block by block: a task has those of one
block at once, and of its group no more open ones than fit KEPT bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators.blocks import SIZE
from helixframe.tables import forget, stored

#: Variants of a group at first, how often groups double, and sweeps over links before they are decided one by one.
WIDTH, DOUBLINGS, SWEEPS = 16_384, 4, 12
CHUNK = 1 << 20  # comparisons of scores at once
KEPT = 32 << 20  # bytes of open links that a task keeps of its group

_SCHEMA = "chr string, p int, size int, keys binary, kept binary, gone binary, u array<int>, v array<int>, q array<int>"
_NAMES = [f.split()[0] for f in _SCHEMA.split(", ")]


def ranks(keys: np.ndarray) -> np.ndarray:
    """For each pruning the place of each node by least key, then number: whole numbers of few bytes, the largest one for infinite keys."""
    kind = np.uint16 if len(keys) < 1 << 16 else np.uint32
    out = np.empty(keys.shape, kind)
    for n in range(keys.shape[1]):
        out[np.argsort(keys[:, n], kind="stable"), n] = np.arange(len(keys), dtype=kind)
    out[~np.isfinite(keys)] = np.iinfo(kind).max
    return out


def goes_before(keys: np.ndarray) -> np.ndarray:
    """For each node a bit for each pruning: whether its key is finite."""
    return np.packbits(np.isfinite(keys) if keys.dtype.kind == "f" else keys != np.iinfo(keys.dtype).max, axis=1)


def better(keys: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each link a bit for each pruning: whether u goes before v, by least key, then number; infinite keys go before nothing. keys may be `ranks`."""
    out = np.empty((len(u), -(-keys.shape[1] // 8)), np.uint8)
    step = max(1, CHUNK // max(1, keys.shape[1]))
    for lo in range(0, len(u), step):
        a, b = u[lo : lo + step], v[lo : lo + step]
        x, y = keys[a], keys[b]
        out[lo : lo + step] = np.packbits(x < y if keys.dtype.kind == "u" else np.isfinite(x) & ((x < y) | ((x == y) & (a < b)[:, None])), axis=1)
    return out


def _words(bits: np.ndarray, beyond: int = 0) -> list[np.ndarray]:
    """Rows of bytes as lists of 64 bits each; beyond: what bytes that are added hold."""
    wide = np.full((len(bits), -(-bits.shape[1] // 8) * 8), beyond, np.uint8)
    wide[:, : bits.shape[1]] = bits
    return [np.ascontiguousarray(w) for w in wide.view(np.uint64).T]


def _bytes(words: list[np.ndarray], n: int) -> np.ndarray:
    return np.stack(words, axis=1).view(np.uint8)[:, :n]


def _any(words: list[np.ndarray]) -> np.ndarray:
    return np.bitwise_or.reduce(words) != 0


def decide(keys: np.ndarray, kept: np.ndarray, gone: np.ndarray, u: np.ndarray, v: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Sets bits of kept and gone for each v that they follow for; nodes that are no v stay as they are. Returns the links that are still open.

    Bits of a node that takes no part are set in both. The links' v has to be in order, and all links of a v have to be there whose u may go before it and isn't
    gone.
    """
    if not len(u):
        return u, v
    k, g, f = _words(kept, 0xFF), _words(gone, 0xFF), _words(goes_before(keys))
    starts = np.flatnonzero(np.diff(v, prepend=-1))
    at = v[starts]
    sizes = np.diff(starts, append=len(v))
    wait = []  # whose u is open where v is; what is kept removes its neighbours, whichever goes first
    for w in range(len(k)):
        one, two = k[w][u], g[w][u]
        free = ~(k[w][at] | g[w][at])
        goes = np.bitwise_or.reduceat(one & ~two & f[w][u], starts) & free
        g[w][at] |= goes
        wait.append(np.repeat(free & ~goes, sizes) & ~one & ~two)
    wait = _any(wait)
    # those without an open neighbour stay
    alone = np.bitwise_or.reduceat(wait, starts)
    for w in range(len(k)):
        k[w][at[~alone]] |= ~g[w][at[~alone]]
    u, v = u[wait], v[wait]
    b = _words(better(keys, u, v))
    for _ in range(sweeps):
        if not len(u):
            break
        starts = np.flatnonzero(np.diff(v, prepend=-1))
        at = v[starts]
        moved, alive = False, np.zeros(len(at), bool)
        for w in range(len(k)):
            there = ~g[w][u] & b[w]
            free = ~(k[w][at] | g[w][at])
            goes = np.bitwise_or.reduceat(k[w][u] & there, starts) & free
            stays = free & ~np.bitwise_or.reduceat(there, starts)
            moved = moved or bool(goes.any() or stays.any())
            g[w][at] |= goes
            k[w][at] |= stays
            alive |= (free & ~goes & ~stays) != 0
        if not moved:
            break
        alive = np.repeat(alive, np.diff(starts, append=len(v)))
        u, v, b = u[alive], v[alive], [x[alive] for x in b]
    else:
        if len(u):
            now = [_bytes(x, kept.shape[1]).copy() for x in (k, g)]
            _one_by_one(keys, *now, u, v, _bytes(b, kept.shape[1]))
            k, g = (_words(x, 0xFF) for x in now)
    kept[:], gone[:] = _bytes(k, kept.shape[1]), _bytes(g, kept.shape[1])
    if len(u):
        still = _any([~(k[w][v] | g[w][v]) & ~(k[w][u] | g[w][u]) & b[w] for w in range(len(k))])
        u, v = u[still], v[still]
    return u, v


def _one_by_one(keys: np.ndarray, kept: np.ndarray, gone: np.ndarray, u: np.ndarray, v: np.ndarray, before: np.ndarray) -> None:
    """As a sweep, but each pruning in the order of its keys, so that one pass follows chains of any length."""
    starts = np.flatnonzero(np.diff(v, prepend=-1))
    ends, at = np.append(starts[1:], len(v)), v[starts]
    for n in range(keys.shape[1]):
        byte, bit = n // 8, 0x80 >> n % 8
        state = np.where(gone[:, byte] & bit, 0, np.where(kept[:, byte] & bit, 2, 1)).astype(np.int8)
        mine = (before[:, byte] & bit) != 0
        todo = np.flatnonzero(state[at] == 1)
        for k in todo[np.lexsort((at[todo], keys[at[todo], n]))].tolist():
            own = u[starts[k] : ends[k]][mine[starts[k] : ends[k]]]
            most = state[own].max() if len(own) else 0
            if most != 1:
                state[at[k]] = 2 if most == 0 else 0
        gone[at[state[at] == 0], byte] |= bit
        now = at[state[at] == 2]
        kept[now, byte] |= np.where(gone[now, byte] & bit, 0, bit).astype(np.uint8)


def _nodes(scores: DataFrame, width: int) -> DataFrame:
    """(chr, p, size, keys, kept, gone): blocks of variants from (chr, local_idx, scores); all arrays of scores are of one length."""
    own = scores.select("chr", F.floor(F.col("local_idx") / width).cast("int").alias("p"), (F.col("local_idx") % width).cast("int").alias("at"), "scores")
    lists = own.groupBy("chr", "p").agg(F.collect_list("at").alias("at"), F.flatten(F.collect_list("scores")).alias("scores"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                at, values = batch.column("at")[k].values.to_numpy(), batch.column("scores")[k].values.to_numpy(zero_copy_only=False).astype(np.float64)
                values = values.reshape(len(at), -1)
                n = values.shape[1]
                keys = np.full((int(at.max()) + 1, n), np.inf)
                keys[at] = np.where(np.isfinite(values), -np.abs(values), np.inf)
                state = np.full((len(keys), -(-n // 8)), 0xFF, np.uint8)  # absent: in both
                state[at] = ~np.packbits(np.ones(n, bool))  # bits beyond the prunings, too
                columns = [pa.array([x], t) for x, t in ((batch.column("chr")[k].as_py(), pa.string()), (batch.column("p")[k].as_py(), pa.int32()), (len(keys), pa.int32()))]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array([x.tobytes()], pa.binary()) for x in (keys, state, state))], _NAMES[:6])

    return lists.mapInArrow(pack, ", ".join(_SCHEMA.split(", ")[:6]))


def _links(blocks: DataFrame, threshold: float, width: int) -> DataFrame:
    """(chr, p, u, v, q): links of at least threshold as pairs of variants u to v, for v in block p; q: the blocks that have some u."""
    least = np.float32(threshold)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), *[pa.list_(pa.int32())] * 3]
        for batch in batches:
            for k in range(len(batch)):
                i, j, r = (batch.column(c)[k].values.to_numpy() for c in "ijr")
                near = r * r >= least
                if near.any():
                    chr_, a, b = batch.column("chr")[k].as_py(), batch.column("bi")[k].as_py(), batch.column("bj")[k].as_py()
                    i, j = i[near].astype(np.int32) + a * SIZE, j[near].astype(np.int32) + b * SIZE
                    at, to = a * SIZE // width, b * SIZE // width
                    out = [(chr_, to, i, j, [at]), (chr_, at, j, i, [to])]
                    yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], kind) for c, kind in enumerate(kinds)], ["chr", "p", "u", "v", "q"])

    return blocks.select("chr", "bi", "bj", "i", "j", "r").mapInArrow(cut, "chr string, p int, u array<int>, v array<int>, q array<int>")


class _Group:
    """Nodes of a group and those it has links to, by places in order of their numbers, and links that are still open.

    Methods return rows without the contig: of nodes (p, size, keys, kept, gone, then nulls) and links (p, nulls, u, v, q).
    """

    def __init__(self, have: list[tuple], own: list[int], width: int):
        self.keys, self.kept, self.gone = (np.concatenate([h[k] for h in have]) for k in (1, 2, 3))
        self.ranks = ranks(self.keys)
        sizes = np.array([len(h[1]) for h in have])
        self.p, self.starts, self.own, self.width = np.array([h[0] for h in have]), np.append(0, np.cumsum(sizes)), own, width
        self.number = np.concatenate([np.arange(n) + p * width for p, n in zip(self.p.tolist(), sizes.tolist(), strict=True)]).astype(np.int32)
        self.most = max(1, KEPT // (8 + self.kept.shape[1]))
        self.open: list[tuple[np.ndarray, np.ndarray]] = []
        self.linked: set[int] = set()

    def _within(self, p: int) -> slice:
        at = int(np.searchsorted(self.p, p))
        return slice(int(self.starts[at]), int(self.starts[at + 1])) if at < len(self.p) and self.p[at] == p else slice(0, 0)

    def _alone(self, s: slice, v: np.ndarray) -> None:
        """Without links to it, what is open stays."""
        alone = np.ones(s.stop - s.start, bool)
        alone[v - s.start] = False
        self.kept[s][alone] |= ~self.gone[s][alone]

    def add(self, p: int, u: np.ndarray, v: np.ndarray) -> list[tuple]:
        """All links of block p; returns rows of links that are no longer kept here, though open."""
        s = self._within(p)
        at = [np.minimum(np.searchsorted(self.number, x), len(self.number) - 1).astype(np.int32) for x in (u, v)]
        there = (self.number[at[0]] == u) & (self.number[at[1]] == v)  # variants without a score take no part
        u, v = (x[there] for x in at)
        order = np.argsort(v, kind="stable")
        u, v = u[order], v[order]
        self.linked.add(p)
        self._alone(s, v)
        u, v = decide(self.ranks, self.kept, self.gone, u, v)
        if len(u):
            self.open.append((u, v))
        if sum(len(x) for x, _ in self.open) > self.most:
            u, v = self._again()
            if len(u) > self.most // 2:
                self.open = []
                return self._rows(u, v)
        return []

    def _again(self) -> tuple[np.ndarray, np.ndarray]:
        """What is open once more, by all that is known; blocks are in order, so the links' v are."""
        u, v = (np.concatenate([x[k] for x in self.open] or [np.empty(0, np.int32)]) for k in (0, 1))
        self.open = [decide(self.ranks, self.kept, self.gone, u, v)]
        return self.open[0]

    def _rows(self, u: np.ndarray, v: np.ndarray) -> list[tuple]:
        out = []
        for p in self.own:
            s = self._within(p)
            lo, hi = np.searchsorted(v, [s.start, s.stop])
            if lo < hi:
                a, b = self.number[u[lo:hi]], self.number[v[lo:hi]]
                out.append((p, None, None, None, None, a, b, np.unique(a // self.width)))
        return out

    def end(self) -> list[tuple]:
        for p in self.own:
            if p not in self.linked:
                self._alone(self._within(p), np.empty(0, np.int32))
        out = self._rows(*self._again())
        for p in self.own:
            s = self._within(p)
            out.append((p, s.stop - s.start, self.keys[s].tobytes(), self.kept[s].tobytes(), self.gone[s].tobytes(), None, None, None))
        return out


def _round(nodes: DataFrame, links: DataFrame, level: int, width: int) -> DataFrame:
    """Nodes (u is null) and links that are still open (keys is null) after what groups of 2 ** level blocks of width variants can decide."""
    group = F.shiftright("p", level).alias("g")
    wanted = links.select("chr", group, F.explode("q").alias("p")).unionByName(nodes.select("chr", group, "p")).distinct()
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    sent = nodes.join(wanted, ["chr", "p"]).select("chr", "g", F.lit(0).alias("kind"), "p", "size", "keys", "kept", "gone", none("u", "array<int>"), none("v", "array<int>"))
    rest = links.select("chr", group, F.lit(1).alias("kind"), "p", none("size", "int"), *(none(c, "binary") for c in ("keys", "kept", "gone")), "u", "v")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        group: _Group | None = None
        have: list[tuple] = []
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        block = None  # whose links are in pairs

        def rows(out: list[tuple]) -> Iterator[pa.RecordBatch]:
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 3, *[pa.list_(pa.int32())] * 3]
            for o in out:
                yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), *(pa.array([x], kind) for x, kind in zip(o, kinds, strict=True))], _NAMES)

        def passed() -> Iterator[pa.RecordBatch]:
            """The block's links are all there."""
            nonlocal group, pairs
            if have and group is None:
                group = _Group(have, [h[0] for h in have if h[0] >> level == key[1]], width)
                have.clear()
            if group is not None and pairs:
                yield from rows(group.add(block, *(np.concatenate([p[k] for p in pairs]) for k in (0, 1))))
            pairs = []

        def close() -> Iterator[pa.RecordBatch]:
            yield from passed()
            if group is not None:
                yield from rows(group.end())

        for batch in batches:
            for k, (chr_, g, kind, p, size) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("chr", "g", "kind", "p", "size")), strict=True)):
                if (chr_, g) != key:
                    if key is not None:
                        yield from close()
                    key, group, have, pairs, block = (chr_, g), None, [], [], None
                if kind == 0:
                    have.append((p, *(np.frombuffer(batch.column(c)[k].as_py(), t).reshape(size, -1) for c, t in (("keys", np.float64), ("kept", np.uint8), ("gone", np.uint8)))))
                else:
                    if p != block:
                        yield from passed()
                        block = p
                    pairs.append((batch.column("u")[k].values.to_numpy(), batch.column("v")[k].values.to_numpy()))
        if key is not None:
            yield from close()

    dealt = sent.unionByName(rest).repartition("chr", "g").sortWithinPartitions("chr", "g", "kind", "p")
    return dealt.mapInArrow(solve, _SCHEMA)


def prune_blocks(scores: DataFrame, blocks: DataFrame, threshold: float, width: int = WIDTH, doublings: int = DOUBLINGS) -> DataFrame:
    """(chr, local_idx, gone): for each pruning whether a variant is removed.

    scores: chr, local_idx, scores (an array with a value for each pruning). By falling absolute score, then index, a finite score that is still there
    removes its neighbours with r * r of at least threshold (compared as float); others remove nothing but can be removed. Variants
    without a row take no part. width is a multiple of SIZE. Rounds are tables in the shared folder.
    """
    if width % SIZE:
        raise ValueError(f"width must be a multiple of {SIZE}")
    level = 0
    while width % (2 * SIZE) == 0:  # a group is of blocks, which are small, as a task has all links of one
        width, level = width // 2, level + 1
    last = level + doublings
    nodes, links = stored(_nodes(scores, width), "prune-nodes"), stored(_links(blocks, threshold, width), "prune-links")
    there = nodes.select("chr", "p").limit(1).collect()
    olds = [nodes, links]
    while there:
        found = stored(_round(nodes, links, level, width), "prune-round")
        nodes, links = found.filter("keys IS NOT NULL").select(*_NAMES[:6]), found.filter("keys IS NULL").select("chr", "p", "u", "v", "q")
        for old in olds:
            forget(old)
        olds = [found]
        if links.isEmpty():
            break
        level = min(level + 1, last)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                size = batch.column("size")[k].as_py()
                kept, gone = (np.unpackbits(np.frombuffer(batch.column(c)[k].as_py(), np.uint8).reshape(size, -1), axis=1) for c in ("kept", "gone"))
                n = len(batch.column("keys")[k].as_py()) // 8 // size
                at = np.flatnonzero(~(kept[:, 0] & gone[:, 0]).astype(bool))
                bits = gone[at, :n].astype(bool)
                flags = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * n), pa.array(bits.ravel()))
                numbers = pa.array(at + batch.column("p")[k].as_py() * width, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("chr")[k].as_py()] * len(at), pa.string()), numbers, flags], ["chr", "local_idx", "gone"])

    return nodes.mapInArrow(spread, "chr string, local_idx long, gone array<boolean>")
