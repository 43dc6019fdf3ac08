"""Secret scan by one deterministic automaton for all rules.

Rules are built from bytes into one automaton by subset construction and minimised; a table of transitions by
byte class is all that scanning needs. Texts are cut into blocks that advance together, one byte of each a step, all from
the start state; a block that the one before leaves in another state is run again until its states agree with those of
the first run, mostly a few bytes. Each place where a rule accepts then leads to its span: the rule's reversed automaton
goes back to the leftmost start and the rule's own goes on to the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import released, sliced, small_batches, table
from helixframe.llm.minhash import text_bytes

BLOCK = 512
MASK = "[SECRET]"

# A rule is a tree: bytes sets (frozenset), ("cat", …), ("alt", …), ("many", x) for one or more, ("maybe", x).
Rule = object


def chars(*parts: str) -> frozenset[int]:
    """Single characters and ranges such as a-z."""
    out: set[int] = set()
    for p in parts:
        out |= set(range(ord(p[0]), ord(p[2]) + 1)) if len(p) == 3 and p[1] == "-" else {ord(p)}
    return frozenset(out)


def word(text: str, any_case: bool = False) -> Rule:
    return ("cat", *(frozenset({ord(c.lower()), ord(c.upper())} if any_case else {ord(c)}) for c in text))


def cat(*parts: Rule) -> Rule:
    return ("cat", *parts)


def alt(*parts: Rule) -> Rule:
    return ("alt", *parts)


def many(x: Rule) -> Rule:
    return ("many", x)


def maybe(x: Rule) -> Rule:
    return ("maybe", x)


def at_least(x: Rule, n: int) -> Rule:
    return ("cat", *[x] * (n - 1), ("many", x))


def backwards(rule: Rule) -> Rule:
    if isinstance(rule, frozenset):
        return rule
    parts = [backwards(p) for p in rule[1:]]
    return (rule[0], *(reversed(parts) if rule[0] == "cat" else parts))


_ALNUM = ("A-Z", "a-z", "0-9")
_QUOTE, _BLANK = maybe(chars('"', "'")), maybe(many(chars(" ")))
_KEY = alt(*(word(w, True) for w in ("password", "passwd", "secret", "token", "apikey", "api_key")))
_HEAD = cat(_KEY, _QUOTE, _BLANK, chars(":", "="), _BLANK, _QUOTE)
_VALUE = chars(*_ALNUM, "+", "/", "_", ".", "=", "-")
#: kind -> rule, in the order of listing. Where a rare prefix leads, the least length is held afterwards (LEAST): counting
#: in the automaton would multiply its states.
RULES: dict[str, Rule] = {
    "assign": cat(_HEAD, many(_VALUE)),
    "access": cat(word("AKIA"), many(chars("A-Z", "0-9"))),
    "hex": at_least(chars("0-9", "a-f"), 24),
    "github": cat(word("gh"), chars("p", "o", "u", "s", "r"), word("_"), many(chars(*_ALNUM))),
    "slack": cat(word("xox"), chars("a", "b", "p", "r", "s"), word("-"), many(chars(*_ALNUM, "-"))),
    "pem": cat(word("-----BEGIN "), maybe(many(chars("A-Z", " "))), word("PRIVATE KEY-----")),
}
BASE = ("assign", "access", "hex")
LEAST = {"access": 20, "github": 40, "slack": 15}  # bytes of a match
LEAST_VALUE = 6  # bytes of an assigned value


class Automaton:
    """Minimal deterministic automaton. searching: matches may start anywhere.

    moves[state][byte class]; accepts[state]: bits of rules; states that accept come last, 0 is the start.
    """

    def __init__(self, rules: list[Rule], searching: bool):
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []
        ends = {}
        roots = []
        for k, rule in enumerate(rules):
            start, end = self._build(rule)
            roots.append(start)
            ends[end] = 1 << k
        self.classes = self._byte_classes()
        some = [int(np.flatnonzero(self.classes == c)[0]) for c in range(self.classes.max() + 1)]
        start = self._closure(roots)
        number, todo, moves, accepts = {start: 0}, [start], [], []
        for own in todo:
            accepts.append(sum(ends.get(s, 0) for s in own))
            row = []
            for byte in some:
                into = self._closure([t for s in own for on, t in self.edges[s] if byte in on] + (roots if searching else []))
                if into not in number:
                    number[into] = len(todo)
                    todo.append(into)
                row.append(number[into])
            moves.append(row)
        self._minimise(np.array(moves), np.array(accepts))

    def _node(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def _build(self, rule: Rule) -> tuple[int, int]:
        start, end = self._node(), self._node()
        if isinstance(rule, frozenset):
            self.edges[start].append((rule, end))
        elif rule[0] == "cat":
            at = start
            for part in rule[1:]:
                a, b = self._build(part)
                self.free[at].append(a)
                at = b
            self.free[at].append(end)
        else:
            for part in rule[1:]:
                a, b = self._build(part)
                self.free[start].append(a)
                self.free[b].append(end)
                if rule[0] == "many":
                    self.free[b].append(a)
            if rule[0] == "maybe":
                self.free[start].append(end)
        return start, end

    def _closure(self, nodes: list[int]) -> frozenset[int]:
        seen, todo = set(nodes), list(nodes)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def _byte_classes(self) -> np.ndarray:
        sets = list({on for row in self.edges for on, _ in row})
        marks = [tuple(b in s for s in sets) for b in range(256)]
        number = {m: i for i, m in enumerate(dict.fromkeys(marks))}
        return np.array([number[m] for m in marks])

    def _minimise(self, moves: np.ndarray, accepts: np.ndarray) -> None:
        part = np.unique(accepts, return_inverse=True)[1]
        while True:  # split blocks until all states of a block go to the same blocks
            refined = np.unique(np.column_stack([part, part[moves]]), axis=0, return_inverse=True)[1].ravel()
            if refined.max() == part.max():
                break
            part = refined
        blocks = part.max() + 1
        one = np.array([np.flatnonzero(part == b)[0] for b in range(blocks)])
        order = sorted(range(blocks), key=lambda b: (accepts[one[b]] > 0, b != part[0]))
        place = np.empty(blocks, np.int64)
        place[order] = np.arange(blocks)
        self.moves = place[part[moves[one[order]]]].astype(np.uint16)
        self.accepts = accepts[one[order]]
        self.first_accepting = int((self.accepts == 0).sum())
        stuck = np.flatnonzero((self.moves == np.arange(blocks)[:, None]).all(axis=1) & (self.accepts == 0))
        self.dead = int(stuck[0]) if len(stuck) else -1
        self.move_lists, self.class_list = self.moves.tolist(), self.classes.tolist()

    def longest(self, data: bytes, at: int, stop: int, step: int) -> int:
        """Where the longest match from `at` ends, going by `step` and not past `stop`; at itself if none."""
        state, found, moves, classes = 0, at, self.move_lists, self.class_list
        while at != stop:
            state = moves[state][classes[data[at if step > 0 else at - 1]]]
            at += step
            if state == self.dead:
                break
            if state >= self.first_accepting:
                found = at
        return found


class Scanner:
    def __init__(self, rules: dict[str, Rule] = RULES):
        self.kinds = list(rules)
        self.all = Automaton(list(rules.values()), True)
        self.forth = [Automaton([r], False) for r in rules.values()]
        self.back = [Automaton([backwards(r)], False) for r in rules.values()]
        self.head = Automaton([_HEAD], False)

    def states(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The combined automaton's state after each byte; every text starts anew."""
        moves, classes = self.all.moves, self.all.classes.astype(np.uint8)[data]
        width = np.uint32(moves.shape[1])
        flat = moves.ravel()
        sizes = np.diff(bounds)
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(sizes)), blocks)
        rank = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = bounds[:-1][owner] + rank * BLOCK
        length = np.minimum(BLOCK, bounds[1:][owner] - start)
        out = np.zeros(len(data), np.uint16)
        lanes = np.argsort(-length, kind="stable")
        begin, size, state = start[lanes], length[lanes], np.zeros(len(lanes), np.uint16)
        alive = np.searchsorted(-size, -np.arange(BLOCK), "left")  # lanes that have a byte at each step
        for t in range(int(size[0]) if len(size) else 0):
            n = int(alive[t])
            at = begin[:n] + t
            state[:n] = flat[state[:n] * width + classes[at]]
            out[at] = state[:n]
        entry = np.zeros(len(owner), np.uint16)
        again = np.arange(len(owner))
        while len(again):  # blocks whose entry isn't what they were run from
            before = np.where(rank[again] > 0, out[start[again] - 1], 0)
            again = again[before != entry[again]]
            entry[again] = out[start[again] - 1]
            lane, state, t = again, entry[again].copy(), 0
            whole = []
            while len(lane):
                at = start[lane] + t
                state = flat[state * width + classes[at]]
                go = state != out[at]
                out[at] = state
                t += 1
                ended = go & (length[lane] == t)
                whole.append(lane[ended])
                lane, state = lane[go & ~ended], state[go & ~ended]
            ended = np.concatenate(whole) if whole else np.empty(0, np.int64)
            again = ended[ended + 1 < len(owner)] + 1
            again = np.unique(again[rank[again] > 0])
        return out

    def scan(self, data: np.ndarray, bounds: np.ndarray) -> dict[int, list[tuple[str, int, int]]]:
        """Spans (kind, start, end) in code points of the texts that have any, by start, then by kind as listed."""
        states = self.states(data, bounds)
        hits = np.flatnonzero(states >= self.all.first_accepting)
        if not len(hits):
            return {}
        rules = self.all.accepts[states[hits]]
        doc = np.searchsorted(bounds, hits, "right") - 1
        found = {}
        for d in np.unique(doc):
            own = doc == d
            lo, hi = int(bounds[d]), int(bounds[d + 1])
            text = data[lo:hi].tobytes()
            spans = []
            for k, kind in enumerate(self.kinds):
                resume = 0
                for p in (hits[own][rules[own] >> k & 1 > 0] - lo).tolist():
                    if p < resume:
                        continue
                    start = self.back[k].longest(text, p + 1, resume, -1)
                    if start > p:
                        continue
                    end = resume = self.forth[k].longest(text, start, len(text), 1)
                    if kind == "assign" and end - self.head.longest(text, start, end, 1) < LEAST_VALUE:
                        continue
                    if end - start < LEAST.get(kind, 1):
                        continue
                    spans.append((start, k, end))
            if spans:
                point = np.cumsum(np.append((data[lo:hi] & 0xC0) != 0x80, True)) - 1  # code points before each byte
                found[int(d)] = [(self.kinds[k], int(point[s]), int(point[e])) for s, k, e in sorted(spans)]
        return found


_SCANNER: list[Scanner] = []


def scanner() -> Scanner:
    if not _SCANNER:
        _SCANNER.append(Scanner())
    return _SCANNER[0]


_SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, spans: one row per row of docs, spans in code points (end exclusive), empty where there are none.

    Null texts count as empty; repeated rows are scanned once each; an empty table gives no rows. Only id_col and
    text_col are read. Spans of one kind do not overlap; those of different kinds may.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner()
        for batch in released(batches):
            for part in sliced(batch):
                found = own.scan(*text_bytes(part.column("text")))
                spans = [[{"kind": k, "start": s, "end": e} for k, s, e in found.get(i, ())] for i in range(len(part))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans {_SPANS}")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for _, start, end in spans:  # by start; overlapping spans are masked once
        if end > at:
            out += [text[at:start], MASK] if start >= at else []
            at = end
    return "".join(out) + text[at:]


def mask_secrets(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """docs with each secret replaced by a mark; size_col, if docs has it, follows the new length. Other rows stay as they are."""
    small_batches(docs.sparkSession)
    schema: T.StructType = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner()
        for batch in released(batches):
            for part in sliced(batch, text_col):
                found = own.scan(*text_bytes(part.column(text_col)))
                if found:
                    texts = part.column(text_col).to_pylist()
                    for i, spans in found.items():
                        texts[i] = masked(texts[i], spans)
                    columns = {n: part.column(n) for n in part.schema.names}
                    columns[text_col] = pa.array(texts, part.column(text_col).type)
                    if size_col in columns:
                        sizes = columns[size_col].to_pylist()
                        for i in found:
                            sizes[i] = len(texts[i])
                        columns[size_col] = pa.array(sizes, columns[size_col].type)
                    part = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
                yield part

    return docs.mapInArrow(run, schema)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
