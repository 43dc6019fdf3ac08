"""Near-duplicates by b-bit MinHash over word shingles.

Each text is sketched once: its distinct shingles (hashed to 64 bits), a digest of that set, the minima of K
hash functions as band keys, and their low B bits packed. Equal sets are one node. A band's bucket is dealt out in
parts where its key is frequent, and all of a part are compared with its leader. Only in buckets that this leaves in
different components the members outside of the largest component are held against all, block by block: first by their
bits alone, and those that may have a link by their texts. Candidates have to pass the collision-corrected estimate
from the packed bits, and what passes is confirmed on the full sets of the texts. Components come from
large-star/small-star rounds over the links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.llm.common import HOT_GROUPS, drop_ids, forget, is_small, join_groups, keep_ids, only, released, sliced, small_batches, stored, table, text_bytes

BANDS, ROWS = 40, 5
K = BANDS * ROWS
B = 4  # low bits that are kept of each minimum
SIGMAS = 5.0  # standard errors that an estimate may lie below the threshold
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000  # members of a bucket (and shingles of them) that are compared with as many others at once
SLICE = 1 << 20  # bytes of text that are cut into shingles at once
SPOKES = 64  # pairs of a hub that are confirmed in one part
PLACED_BYTES = 64  # what a place of a text takes in a broadcast table
STEP = 64  # pairs that are confirmed at once, the likeliest first
PERMUTATIONS = 4  # leaders differ between bands
PART = 512  # members of a frequent key's bucket that get a leader of their own
SEEN = 16  # frequent keys are looked for in one node in so many

_R = np.random.default_rng(20240229)
_BYTE = _R.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_BYTE[_WHITE] = 0
for _b in range(65, 91):  # A-Z count as a-z
    _BYTE[_b] = _BYTE[_b + 32]
_POWERS = np.cumprod(np.full(1 << 12, np.uint64(0xD1342543DE82EF95)))
_A, _X = _R.integers(1, 1 << 32, K, np.uint64).astype(np.uint32) | np.uint32(1), _R.integers(0, 1 << 32, K, np.uint64).astype(np.uint32)
_FOLD = np.uint64(0x9E3779B97F4A7C15)
_LOWEST = np.uint64(0x1111111111111111)  # the lowest bit of each B bits


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_sets(data: np.ndarray, bounds: np.ndarray, words: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and where each starts."""
    n = len(bounds) - 1
    white = _WHITE[data]
    first = np.zeros(len(data) + 1, bool)
    first[bounds[:-1]] = True
    starts = np.flatnonzero(~white & (np.concatenate([[True], white[:-1]]) | first[:-1])) if len(data) else np.empty(0, np.int64)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    place = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    high, place = place // len(_POWERS), place % len(_POWERS)
    value = _BYTE[data[starts[0] :]] * _POWERS[place]
    if high.any():  # words beyond the table of powers
        value *= _mix(high.astype(np.uint64)) | np.uint64(1)
    word = _mix(np.add.reduceat(value, starts - starts[0]))
    doc = np.searchsorted(bounds, starts, "right") - 1
    count = np.bincount(doc, minlength=n)
    word_start = np.concatenate([[0], np.cumsum(count)])
    sizes = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    out_start = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(n), sizes)
    at = word_start[owner] + np.arange(len(owner)) - out_start[owner]
    h = np.zeros(len(owner), np.uint64)
    for i in range(words):
        there = i < count[owner]
        h = np.where(there, h * _FOLD + word[np.minimum(at + i, len(word) - 1)], h)
    h = _mix(h + np.minimum(count[owner], words).astype(np.uint64))
    for a, b in zip(out_start[:-1], out_start[1:], strict=True):
        if b - a > 1:
            h[a:b].sort()
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[fresh], np.concatenate([[0], np.cumsum(np.bincount(owner[fresh], minlength=n))])


def minima(sets: np.ndarray, start: np.ndarray) -> np.ndarray:
    """K minima of each set; sets must not be empty."""
    x = (sets >> np.uint64(32)).astype(np.uint32) ^ sets.astype(np.uint32)
    out = np.empty((len(start) - 1, K), np.uint32)
    for i in range(K):
        y = (x ^ _X[i]) * _A[i]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        out[:, i] = np.minimum.reduceat(y, start[:-1])
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * _FOLD, (len(m), 1))
    for r in range(ROWS):
        keys = _mix((keys ^ m[:, r::ROWS].astype(np.uint64)) * _FOLD)
    return keys.view(np.int64)


def pack_bits(m: np.ndarray) -> np.ndarray:
    low = (m & np.uint32(15)).astype(np.uint8)
    return low[:, ::2] << 4 | low[:, 1::2]


def as_words(bits: np.ndarray) -> np.ndarray:
    """Packed bits, a row for each set, as 64-bit words; what fills the last word is equal in all rows."""
    return np.pad(bits, [(0, 0)] * (bits.ndim - 1) + [(0, -bits.shape[-1] % 8)]).view(np.uint64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed bits (bytes or words), by counting bits; two unequal minima agree in their low bits once in 2 ** B."""
    x = a ^ b if a.dtype == np.uint64 else as_words(a ^ b)
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    same = 1 - np.bitwise_count(x & _LOWEST).sum(axis=-1, dtype=np.int64) / K
    chance = 2.0**-B
    return (same - chance) / (1 - chance)


def shared(one: np.ndarray, sets: np.ndarray, at: np.ndarray, which: np.ndarray) -> np.ndarray:
    """How many elements each of the sets `which` (sets[at[k]:at[k + 1]], sorted and not empty) has in common with one."""
    sizes = at[which + 1] - at[which]
    starts = np.cumsum(sizes) - sizes
    every = sets[np.repeat(at[which] - starts, sizes) + np.arange(sizes.sum())]
    place = np.minimum(np.searchsorted(one, every), len(one) - 1)
    return np.add.reduceat(one[place] == every, starts, dtype=np.int64)


def least_estimate(threshold: float) -> float:
    p = threshold + (1 - threshold) * 2.0**-B
    return threshold - SIGMAS * float(np.sqrt(p * (1 - p) / K)) / (1 - 2.0**-B)


def sketch(docs: DataFrame, words: int = 2) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_shingles, digest, bits, bands; without words the last three are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for batch in released(batches):
            for part in sliced(batch, max_bytes=SLICE):
                sets, start = shingle_sets(*text_bytes(part.column("text")), words)
                sizes = np.diff(start)
                some = np.flatnonzero(sizes)
                digest, bits, bands = ([None] * len(sizes) for _ in range(3))
                if len(some):
                    m = minima(sets, np.concatenate([start[some], start[-1:]]))
                    packed, keys = pack_bits(m), band_keys(m)
                    for j, i in enumerate(some):
                        digest[i] = hashlib.blake2b(sets[start[i] : start[i + 1]], digest_size=16).digest()
                        bits[i], bands[i] = packed[j].tobytes(), keys[j]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digest, pa.binary()), pa.array(bits, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "digest", "bits", "bands"],
                )

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, digest binary, bits binary, bands array<long>")


def _likely(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sizes and packed bits allow the threshold, with their estimate."""
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))
    least = least_estimate(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = estimate(*(np.frombuffer(b"".join(batch.column(f"bits_{s}").to_pylist()), np.uint8).reshape(len(batch), K * B // 8) for s in "ab"))
            keep = np.flatnonzero(near >= least)
            yield batch.select(["a", "b", "n"]).take(pa.array(keep)).append_column("near", pa.array(near[keep]))

    return near.select("a", "b", F.greatest("n_a", "n_b").alias("n"), "bits_a", "bits_b").mapInArrow(run, "a long, b long, n long, near double")


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of document ids whose full shingle sets are that similar. pairs: a, b and n, the shingles of the larger set.

    A pair is dealt to the end that is in more pairs, its hub, and a hub's pairs to parts of a bounded size. A hub's
    text goes to each of its parts once, ahead of those it is held against, so that no text is copied for each pair.
    """
    degrees = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("pairs"))
    of = lambda s: degrees.select(F.col("node").alias(s), F.col("pairs").alias(f"of_{s}"))
    a_is_hub = F.col("of_a") >= F.col("of_b")
    parts = F.ceil(F.greatest(F.lit(1.0), F.greatest("of_a", "of_b") / SPOKES, F.greatest("of_a", "of_b") * F.col("n") / BLOCK_SHINGLES))
    ends = F.when(a_is_hub, F.struct(F.col("a").alias("hub"), F.col("b").alias("node"))).otherwise(F.struct(F.col("b").alias("hub"), F.col("a").alias("node")))
    spokes = pairs.join(of("a"), "a").join(of("b"), "b").select(ends.alias("end"), parts.alias("parts"))
    spokes = stored(spokes.select("end.hub", F.pmod(F.xxhash64("end.node"), F.col("parts")).alias("part"), "end.node"), "minhash-spokes")
    hubs = spokes.select("hub", "part").distinct().select("hub", "part", F.col("hub").alias("node"))
    placed = stored(hubs.withColumn("spoke", F.lit(False)).unionByName(spokes.withColumn("spoke", F.lit(True))), "minhash-placed")
    ids = stored(placed.select(F.col("node").alias("doc_id")).distinct(), "minhash-ids")
    texts = keep_ids(docs, ids, "doc_id").select(F.col("doc_id").alias("node"), "text")
    rows = texts.join(F.broadcast(placed) if is_small(placed, PLACED_BYTES) else placed, "node").select("hub", "part", "spoke", "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        at, own = None, []
        for batch in released(batches):
            for some in sliced(batch, max_bytes=SLICE):
                sets, start = shingle_sets(*text_bytes(some.column("text")), words)
                sizes = np.diff(start)
                hub, part, node = (some.column(c).to_numpy() for c in ("hub", "part", "node"))
                spoke = some.column("spoke").to_numpy(zero_copy_only=False)
                edges = np.flatnonzero((np.diff(hub) != 0) | (np.diff(part) != 0)) + 1
                found = [np.empty((0, 2), np.int64)]
                for lo, hi in zip([0, *edges], [*edges, len(some)], strict=True):
                    if at != (hub[lo], part[lo]):
                        at, own = (hub[lo], part[lo]), []
                    here = lo + np.flatnonzero(sizes[lo:hi])
                    own += [sets[start[i] : start[i + 1]].copy() for i in here[~spoke[here]]]  # more than one where rows share an id
                    which = here[spoke[here]]
                    for one in own if len(which) else []:
                        both = shared(one, sets, start, which)
                        near = which[(both > 0) & (100 * both >= percent * (len(one) + sizes[which] - both))]
                        found.append(np.column_stack([np.minimum(hub[near], node[near]), np.maximum(hub[near], node[near])]))
                pairs = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "spoke").mapInArrow(run, "a long, b long").distinct()


def _sets_by_slices(texts: pd.Series, words: int) -> tuple[np.ndarray, np.ndarray]:
    """As shingle_sets of all texts, in slices: what a slice takes for its work is many times its bytes."""
    found = [shingle_sets(*text_bytes(part.column("text")), words) for part in sliced(pa.record_batch({"text": pa.array(texts, pa.string())}), max_bytes=SLICE)]
    return np.concatenate([s for s, _ in found]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(at) for _, at in found]))])


class _Group:
    """Members of one or two blocks of a bucket, those of small components first, as they have the fewest pairs after them."""

    def __init__(self, pdf: pd.DataFrame, percent: int):
        node, part = (pdf[c].to_numpy(np.int64) for c in ("node", "component"))
        _, which, sizes = np.unique(part, return_inverse=True, return_counts=True)
        self.order = order = np.lexsort((node, part, sizes[which]))  # pandas takes longer for the many small groups
        self.node, self.part, self.n, self.own = (pdf[c].to_numpy(np.int64)[order] for c in ("node", "component", "n", "own"))
        self.bits = as_words(np.frombuffer(b"".join(pdf["bits"].to_numpy()[order]), np.uint8).reshape(len(pdf), -1))
        self.bands = np.stack(pdf["bands"].to_numpy()[order])
        self.band = int((self.bands[0] == pdf["key"].iloc[0]).argmax())
        self.across = bool(pdf["i"].iloc[0] != pdf["j"].iloc[0])  # of two blocks: only pairs across them count
        self.threshold, self.least = percent / 100, least_estimate(percent / 100)

    def pairs(self) -> Iterator[tuple[int, np.ndarray]]:
        """For one member after the other: those after it in other components that may be linked with it, the likeliest first.

        Components may change meanwhile. A pair that shares an earlier band is left to that.
        """
        for x in range(len(self.node) - 1):
            y = x + 1 + np.flatnonzero(self.part[x + 1 :] != self.part[x])
            y = y[(np.minimum(self.n[y], self.n[x]) >= self.threshold * np.maximum(self.n[y], self.n[x])) & ((self.own[y] != self.own[x]) | (not self.across))]
            if not len(y):
                continue
            near = estimate(self.bits[y], self.bits[x])
            y, near = y[near >= self.least], near[near >= self.least]
            mine = (self.bands[y] == self.bands[x]).argmax(axis=1) == self.band
            if mine.any():
                yield x, y[mine][np.argsort(-near[mine], kind="stable")]


def likely_members(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The members of a group that by sizes and bits may be linked with one of another component."""
    group = _Group(pdf, percent)
    found = np.zeros(len(pdf), bool)
    for x, y in group.pairs():
        found[x] = found[y] = True
    return pdf[["key", "i", "j", "node", "component", "own"]].iloc[group.order[found]].reset_index(drop=True)


def link_block(pdf: pd.DataFrame, words: int, percent: int) -> pd.DataFrame:
    """Links (a, b) that join the components of a group, whose members have their texts.

    A member is held against others until their components are one: what is emitted is at most a link for each
    component, though every pair of components is either joined or compared in full.
    """
    only()
    pdf = pdf.drop_duplicates(["node", "text"])
    group, out = _Group(pdf, percent), []
    sets, at = _sets_by_slices(pdf["text"].iloc[group.order], words)
    node, part = group.node, group.part
    for x, y in group.pairs():
        one = sets[at[x] : at[x + 1]]
        while len(y):
            now, y = y[:STEP], y[STEP:]
            both = shared(one, sets, at, now)
            for k in now[100 * both >= percent * (len(one) + at[now + 1] - at[now] - both)]:
                if part[k] != part[x]:
                    out.append((min(node[x], node[k]), max(node[x], node[k])))
                    part[part == part[k]] = part[x]
            y = y[part[y] != part[x]]
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def connected_components(links: DataFrame) -> DataFrame:
    """links: (a, b) longs, a <> b. Returns (node, component): the smallest node that can be reached.

    Rounds of large-star and small-star until nothing changes; each is a table in the shared folder, and the ones before are deleted.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "components")
    mark = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "components")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = stored(moved.union(lowest.select("u", F.col("m").alias("v"))).distinct(), "components")
        forget(edges), forget(large)
        edges = small
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def _frequent(sets: DataFrame) -> DataFrame:
    """(key, parts) of the band keys that more than PART nodes have, estimated from one node in SEEN; any number of them.

    A key of twice PART nodes is missed with a probability below 1e-5; its bucket is right then too, in one part.
    """
    seen = sets.filter(F.pmod(F.xxhash64(F.lit("seen"), "node"), F.lit(SEEN)) == 0)
    counts = seen.select(F.explode("bands").alias("key")).groupBy("key").agg((F.count(F.lit(1)) * SEEN).alias("nodes"))
    return stored(counts.filter(F.col("nodes") > PART).select("key", F.ceil(F.col("nodes") / PART).alias("parts")), "minhash-frequent")


def _with_parts(placed: DataFrame, frequent: DataFrame) -> DataFrame:
    """placed with the parts of its key, null unless frequent: by broadcasts of the frequent keys while they are few, and of the most frequent ones beyond."""
    if is_small(frequent.select("key")):
        return placed.join(F.broadcast(frequent), "key", "left")
    most = stored(frequent.orderBy(F.desc("parts"), "key").limit(HOT_GROUPS), "minhash-most")
    known = placed.join(F.broadcast(most), "key", "left")
    rest = known.filter("parts IS NULL").drop("parts").join(frequent, "key", "left")
    return known.filter("parts IS NOT NULL").unionByName(rest)


def _buckets(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, part, node, lead, hot) of the buckets with two members or more, dealt once; and the frequent keys with their number of parts."""
    frequent = _frequent(sets)
    placed = _with_parts(sets.select("node", F.explode("bands").alias("key")), frequent)
    part = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1).cast("long")))
    placed = placed.select("node", "key", part.alias("part"), F.col("parts").isNotNull().alias("hot"))
    rank = F.xxhash64("node", F.pmod("key", F.lit(PERMUTATIONS)))
    w = Window.partitionBy("key", "part").orderBy(rank, "node")
    lead = F.first("node").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    led = placed.withColumn("lead", lead).withColumn("next", F.lead("node").over(w))
    return stored(led.filter("hot OR node <> lead OR next IS NOT NULL").select("key", "part", "node", "lead", "hot"), "minhash-buckets"), frequent


def _led_pairs(buckets: DataFrame) -> DataFrame:
    """Pairs of each member with its part's leader, and of a frequent key's leaders with the first of them."""
    pairs = buckets.filter("node <> lead").select("node", "lead")
    tops = buckets.filter("hot AND node = lead").select("key", "node")
    first = tops.groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("r"), "node")).alias("first")).select("key", F.col("first.node").alias("lead"))
    pairs = pairs.unionByName(tops.join(first, "key").filter("node <> lead").select("node", "lead"))
    return pairs.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()


def _star_links(likely: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Confirmed links among the likely pairs: first the likeliest pair of each node, then of the rest what isn't joined by these."""
    ends = likely.select(F.explode(F.array("a", "b")).alias("node"), F.struct("near", "a", "b", "n").alias("pair"))
    best = stored(ends.groupBy("node").agg(F.max("pair").alias("pair")).select("pair.a", "pair.b", "pair.n").distinct(), "minhash-best")
    links = stored(_confirmed(best, rows, words, percent), "minhash-links")
    found = stored(connected_components(links), "minhash-components")
    of = lambda s: found.select(F.col("node").alias(s), F.col("component").alias(f"of_{s}"))
    open_ = likely.join(best, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
    rest = stored(open_.filter("of_a IS NULL OR of_b IS NULL OR of_a <> of_b").select("a", "b", "n"), "minhash-open")
    forget(found)
    return links.unionByName(stored(_confirmed(rest, rows, words, percent), "minhash-links"))


def _rest_links(buckets: DataFrame, frequent: DataFrame, sets: DataFrame, found: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between members of a bucket that are in different components so far."""
    own = sets.select("node", "n").join(found, "node", "left").select("node", "n", F.coalesce("component", "node").alias("component"))
    labelled = stored(buckets.select("key", "part", "node").join(own, "node"), "minhash-labelled")
    of = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("all"))
    largest = F.max(F.struct("m", "component", "all"))
    mixed = of.groupBy("key").agg(F.count(F.lit(1)).alias("parties"), F.sum("m").alias("m"), F.sum("all").alias("all"), largest.alias("major")).filter("parties > 1 AND m > 2")
    blocks = lambda m, n: F.ceil(F.greatest(m / BLOCK, n / BLOCK_SHINGLES, F.lit(1.0))).cast("int")
    mixed = mixed.select(
        "key", F.col("major.component").alias("major"), blocks(F.col("major.m"), F.col("major.all")).alias("mb"), blocks(F.col("m") - F.col("major.m"), F.col("all") - F.col("major.all")).alias("nb")
    )
    # a row for each part of a frequent key
    mixed = mixed.join(frequent, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1))).drop("parts")
    members = labelled.join(stored(mixed, "minhash-mixed"), ["key", "part"]).drop("part")
    # blocks of the largest component come first; no two of them meet
    is_major, mb, nb, at = F.col("component") == F.col("major"), F.col("mb"), F.col("nb"), F.xxhash64("node")
    own = F.when(is_major, F.pmod(at, mb)).otherwise(mb + F.pmod(at, nb)).cast("int")
    others = F.sequence(F.when(is_major, mb).otherwise(F.lit(0)), mb + nb - 1)
    placed = members.withColumn("own", own).withColumn("other", F.explode(others)).select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "component", "n", "own")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # comparing takes long for few bytes, so tasks are not joined
    by_bits = placed.join(sets.select("node", "bits", "bands"), "node").repartition(tasks, "key", "i", "j")
    likely = stored(by_bits.groupBy("key", "i", "j").applyInPandas(lambda pdf: likely_members(pdf, percent), "key long, i int, j int, node long, component long, own int"), "minhash-likely")
    ids = stored(likely.select(F.col("node").alias("doc_id")).distinct(), "minhash-ids")
    texts = keep_ids(rows, ids, "doc_id").select(F.col("doc_id").alias("node"), "text")
    full = likely.join(keep_ids(sets.select(F.col("node").alias("doc_id"), "n", "bits", "bands"), ids, "doc_id").withColumnRenamed("doc_id", "node"), "node").join(texts, "node").repartition(tasks, "key", "i", "j")
    found = stored(full.groupBy("key", "i", "j").applyInPandas(lambda pdf: link_block(pdf, words, percent), "a long, b long").distinct(), "minhash-rest")
    forget(labelled), forget(likely)
    return found


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest id that links reach), kept.

    Texts are linked if percent / 100 of the union of their sets of word shingles is in both. A text with fewer
    words is one shingle; without words (or null) it is linked with nothing. A row without an id is linked with
    nothing and kept. Rows of one id are one document, linked by any of its texts. An empty table gives no
    rows. Very long texts are cut into shingles alone, one by one. Only id_col (an integer; other types are an error) and
    text_col are read, so other columns of any name do no harm.
    """
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} must be an integer")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketched = stored(sketch(rows, words), "minhash-sketch")
    usable = sketched.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
    of_digest = usable.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "bits", "bands")).alias("s"), F.count(F.lit(1)).alias("docs"))
    sets = stored(of_digest.select("digest", "docs", F.col("s.doc_id").alias("node"), F.col("s.n_shingles").alias("n"), "s.bits", "s.bands"), "minhash-sets")
    buckets, frequent = _buckets(sets)
    likely = stored(_likely(_led_pairs(buckets), sets, percent / 100), "minhash-led")
    links = _star_links(likely, rows, words, percent)
    found = stored(connected_components(links), "minhash-components")
    rest = _rest_links(buckets, frequent, sets, found, rows, words, percent)
    if not rest.isEmpty():
        found = stored(connected_components(links.unionByName(rest)), "minhash-components")
    forget(buckets), forget(likely)

    of_set = stored(sets.select("digest", "docs", "node").join(found, "node", "left").select("digest", "docs", F.coalesce("component", "node").alias("component_id")), "minhash-of-set")
    some = join_groups(sketched.select("doc_id", "n_shingles", "digest").filter("digest IS NOT NULL AND doc_id IS NOT NULL"), of_set, "digest", "docs")
    none = sketched.filter("digest IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = some.select("doc_id", "n_shingles", "component_id").unionByName(none)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def keep_one_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the smallest doc_id (null last).

    Rows count one by one, so that rows that share an id, or have none, are told apart. Texts without words all stay.
    """
    row = "helixframe_row"
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "minhash-rows")
    found = stored(near_duplicates(numbered, words, percent, id_col=row), "minhash-found")
    linked = found.filter("NOT kept").select("component_id").distinct()
    members = found.select(F.col("doc_id").alias(row), "component_id").join(linked, "component_id")
    ranked = members.join(numbered.select(row, "doc_id"), row).select("component_id", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row).alias("rank"))
    stays = ranked.groupBy("component_id").agg(F.min("rank").alias("rank")).select(F.col(f"rank.{row}").alias(row))
    gone = members.select(row).join(stays, row, "left_anti")
    return drop_ids(numbered, stored(gone, "minhash-gone"), row).drop(row)
