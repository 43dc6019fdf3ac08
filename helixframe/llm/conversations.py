"""Repair of conversations by weighted CYK interval parsing.

The initials of a conversation's roles have to be `(s?(ua)+)?`. The grammar that generates this language by rows and edits is in
Chomsky normal form: its nonterminals are (p, q), what leads the language's automaton from state p to q; binary rules are
(p, q) -> (p, r) (r, q), and terminal rules are the edits of one row. Inserted turns are closed over in each terminal cell, before and
after the row. A cell of a span is the least (cost, audit) of each nonterminal, and spans are combined bottom-up by length.
As (p, q) is split at each state r, every place to split a span at gives the same cell, so one is taken, the middle; a span of n rows
takes n - 1 combinations. Audits of equal cost are compared as text: none begins with another of the same span, as each insertion
costs, so the least of a whole is made of the least of its parts.

No conversation has to fit in one task. Rows go without their texts first, as digests: equal rows are counted together, first occurrences are
found by key, and rows are dealt by ranges of (conversation, turn). Each task parses its runs of rows; the cells of a
conversation that lies in several tasks are combined after that. Edits then meet the texts by row, in chunks of bounded size, and
only the digest of a whole conversation, which is a sequence, is taken over its chunks in order by one task, a chunk at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import stored, table

STATES = 4  # nothing yet, after s, after u, after a
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
FINAL = (0, 3)
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
CHUNK_ROWS, CHUNK_BYTES = 256, 1 << 20  # rows and bytes of text whose repaired lines are put together
BLOCK = 8  # rows whose cells are kept for other conversations
WHITE = " \t\n\x0b\x0c\r"

#: Least (cost, audit) of each nonterminal, p * STATES + q; None where there is none.
Cell = tuple[tuple[int, str] | None, ...]


def combine(left: Cell, right: Cell) -> Cell:
    out: list[tuple[int, str] | None] = [None] * (STATES * STATES)
    for p in range(STATES):
        for r in range(STATES):
            if (x := left[p * STATES + r]) is None:
                continue
            for q in range(STATES):
                if (y := right[r * STATES + q]) is None:
                    continue
                cost, own = x[0] + y[0], out[p * STATES + q]
                if own is None or cost < own[0] or (cost == own[0] and x[1] + y[1] < own[1]):
                    out[p * STATES + q] = (cost, x[1] + y[1])
    return tuple(out)


def _cell(found: dict[tuple[int, int], tuple[int, str]]) -> Cell:
    return tuple(found.get((p, q)) for p in range(STATES) for q in range(STATES))


EMPTY = _cell({(p, p): (0, "") for p in range(STATES)})


def _closure() -> Cell:
    """What insertions alone lead to."""
    one = _cell({(p, p): (0, "") for p in range(STATES)} | {(p, q): (INSERT, "I") for c in "ua" for p, q in STEPS[c].items()})
    closed = EMPTY
    while (more := combine(closed, one)) != closed:
        closed = more
    return closed


INSERTED = _closure()


@lru_cache(maxsize=4096)
def deleted(rows: int) -> Cell:
    """The cell of rows that have to go."""
    return combine(combine(INSERTED, _cell({(p, p): (DELETE * rows, "D" * rows) for p in range(STATES)})), INSERTED)


@lru_cache(maxsize=4096)
def terminal(row: str) -> Cell:
    """The cell of a row: s, u or a by its role's initial or x for any other, in capitals if it is truncated; d if it has to go."""
    if row == "d":
        return deleted(1)
    more = TRUNCATED if row.isupper() else 0
    found = {(p, p): (DELETE, "D") for p in range(STATES)}
    edits = [(REROLE + more, "R", c) for c in "ua"] + ([(more, "K", row.lower())] if row != "x" and row != "X" else [])
    for cost, edit, c in edits:
        for p, q in STEPS[c].items():
            found[p, q] = min(found.get((p, q), (cost, edit)), (cost, edit))
    return combine(combine(INSERTED, _cell(found)), INSERTED)


@lru_cache(maxsize=100_000)
def block(rows: str) -> Cell:
    return terminal(rows) if len(rows) == 1 else combine(block(rows[: len(rows) // 2]), block(rows[len(rows) // 2 :]))


class Spans:
    """Cells of neighbouring spans, combined as soon as two are of equal length: each row takes part in log n combinations."""

    def __init__(self) -> None:
        self.stack: list[tuple[int, Cell]] = []
        self.wait = ""

    def push(self, cell: Cell, size: int = 1) -> None:
        while self.stack and self.stack[-1][0] <= size:
            n, left = self.stack.pop()
            cell, size = combine(left, cell), size + n
        self.stack.append((size, cell))

    def add(self, row: str, copies: int = 0) -> None:
        """A row, and so many copies of it that have to go."""
        self.wait += row
        if copies or len(self.wait) == BLOCK:
            self.flush()
        if copies:
            self.push(deleted(copies))

    def flush(self) -> None:
        if self.wait:
            self.push(block(self.wait))
            self.wait = ""

    def whole(self) -> Cell:
        self.flush()
        cell = EMPTY
        for _, own in reversed(self.stack):
            cell = combine(own, cell)
        return cell


def cheapest(cell: Cell) -> tuple[int, str]:
    return min(x for q in FINAL if (x := cell[q]) is not None)


def parse(rows: str) -> tuple[int, str]:
    """Least (cost, audit) for the rows of a conversation, as letters of `terminal`."""
    spans = Spans()
    for row in rows:
        spans.add(row)
    return cheapest(spans.whole())


def role_at(place: int, total: int) -> str:
    """The role that an edited or inserted turn gets; an odd total begins with a kept s."""
    return "user" if (place - total % 2) % 2 == 0 else "assistant"


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copies): rows after damage by crc32 of `conv_id:turn` modulo 20; nulls count as one space, but stay null in conv_id and turn.

    0 drops a row, 1 empties its text, 2 takes its `.`, `!` and `?` away, 3 repeats it (copies = 2), 4 makes its role user.
    """
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit(" ")).alias("role"), F.coalesce(text_col, F.lit(" ")).alias("text"))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(key) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    return rows.filter(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).cast("long").alias("copies"))


def _digest(*columns: Column) -> Column:
    """SHA-256 of columns, told apart by their lengths; null is no text."""
    parts = [F.coalesce(c.cast("string"), F.lit("\0")) for c in columns]
    return F.unhex(F.sha2(F.concat_ws(":", *(F.length(p).cast("string") for p in parts), *parts), 256))


def _skeleton(rows: DataFrame) -> DataFrame:
    """A row for each distinct row of rows: its key, letter of `terminal`, copies that have to go, faults and size of text; no text."""
    body = F.rtrim(F.col("text"), F.lit(WHITE))
    blank = body == ""
    truncated = ~F.right(body, F.lit(1)).isin(".", "!", "?")
    initial = F.left("role", F.lit(1))
    lean = rows.select(
        "conv_id", "turn", initial.alias("initial"), blank.alias("blank"), truncated.alias("truncated"), F.octet_length("text").cast("long").alias("bytes"), "copies",
        _digest(F.col("conv_id"), F.col("role"), F.col("text")).alias("said"), _digest(F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text")).alias("key"),
    )
    own = ["key", "said", "conv_id", "turn", "initial", "blank", "truncated", "bytes"]
    lean = lean.groupBy(*own).agg(F.sum("copies").alias("copies"))
    first = lean.groupBy("said").agg(F.min(F.struct("turn", "key")).alias("first")).select(F.col("first.key").alias("key"), F.lit(True).alias("is_first"))
    lean = lean.join(first, "key", "left").withColumn("first", F.coalesce("is_first", F.lit(False)) & ~F.col("blank"))
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    letter = F.when(~F.col("first"), "d").when(F.col("truncated"), F.upper(letter)).otherwise(letter)
    return lean.select("conv_id", "turn", "key", "initial", letter.alias("letter"), (F.col("copies") - 1).alias("more"), "blank", "bytes")


def _runs(skeleton: DataFrame) -> DataFrame:
    """Rows of two kinds, from rows in order: chunks (keys, letters, copies) and, for each conversation of a task, its faults and cell."""
    kind = skeleton.schema["conv_id"].dataType.simpleString()
    turn_kind = skeleton.schema["turn"].dataType.simpleString()
    schema = (
        f"conv_id {kind}, chunk long, keys array<binary>, letters string, more array<bigint>, chunks array<bigint>, sizes array<bigint>, least {turn_kind}, most {turn_kind}, turns long, "
        "blank long, duplicate long, truncated long, illegal long, head string, tail string, costs array<bigint>, audits array<string>"
    )
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        types: list[pa.DataType] = []
        out: list[dict] = []
        now: dict | None = None  # the conversation that is being read
        chunk: dict | None = None

        def close_chunk() -> None:
            nonlocal chunk
            if chunk:
                out.append({"conv_id": now["conv_id"], "chunk": chunk["chunk"], "keys": chunk["keys"], "letters": "".join(chunk["letters"]), "more": chunk["more"]})
                now["chunks"].append(chunk["chunk"])
                now["sizes"].append(len(chunk["keys"]) + sum(chunk["more"]))
                chunk = None

        def close() -> None:
            nonlocal now
            if now:
                close_chunk()
                cell = now.pop("spans").whole()
                now.pop("last")
                out.append(now | {"chunk": now["chunks"][0], "costs": [None if c is None else c[0] for c in cell], "audits": [None if c is None else c[1] for c in cell]})
                now = None

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            kinds = dict(conv_id=types[0], least=types[1], most=types[1], letters=pa.string(), head=pa.string(), tail=pa.string(), keys=pa.list_(pa.binary()), audits=pa.list_(pa.string()))
            kinds |= {c: pa.list_(pa.int64()) for c in ("more", "chunks", "sizes", "costs")}
            return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kinds.get(c, pa.int64())) for c in names], names)

        for batch in batches:
            types = [batch.schema.field("conv_id").type, batch.schema.field("turn").type]
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "key", "initial", "letter", "more", "blank", "bytes"))
            for conv, turn, key, initial, letter, more, blank, size in zip(*columns, strict=True):
                if now is None or now["conv_id"] != conv:
                    close()
                    now = dict(conv_id=conv, chunks=[], sizes=[], least=None, most=None, turns=0, blank=0, duplicate=0, truncated=0, illegal=0, head=initial, tail=None, spans=Spans(), last=None)
                    now["illegal"] = 0
                elif now["tail"] + initial not in ("su", "ua", "au"):
                    now["illegal"] += 1
                now["illegal"] += more  # copies of a row have its role
                now["tail"] = initial
                if turn is not None and turn != now["last"]:
                    now["least"], now["most"] = turn if now["least"] is None else now["least"], turn
                    now["turns"] += 1
                    now["last"] = turn
                if blank:
                    now["blank"] += 1 + more
                else:
                    now["duplicate"] += more + (letter == "d")
                    now["truncated"] += letter.isupper()
                now["spans"].add(letter, more)
                if chunk and (len(chunk["keys"]) >= CHUNK_ROWS or chunk["bytes"] + size > CHUNK_BYTES):
                    close_chunk()
                if chunk is None:
                    chunk, number = dict(chunk=number, keys=[], letters=[], more=[], bytes=0), number + 1
                chunk["keys"].append(key)
                chunk["letters"].append(letter)
                chunk["more"].append(more)
                chunk["bytes"] += size
            if len(out) >= 256:
                yield batch_of(out)
                out = []
        close()
        if out:
            yield batch_of(out)

    ordered = skeleton.repartitionByRange("conv_id", F.asc_nulls_first("turn"), "key").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "key")
    return ordered.mapInArrow(run, schema)


def _united(rows: list[dict]) -> dict:
    """The faults, cell and chunks of a conversation from those of its parts, in order."""
    out = dict(rows[0])
    cells = Spans()
    for n, r in enumerate(rows):
        cells.push(tuple(None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"], strict=True)))
        if not n:
            continue
        out["turns"] += r["turns"] - (r["least"] is not None and r["least"] == out["most"])
        out["illegal"] += r["illegal"] + (out["tail"] + r["head"] not in ("su", "ua", "au"))
        for c in ("blank", "duplicate", "truncated"):
            out[c] += r[c]
        for c in ("chunks", "sizes"):
            out[c] = out[c] + r[c]
        out["least"] = r["least"] if out["least"] is None else out["least"]
        out["most"] = r["most"] if r["most"] is not None else out["most"]
        out["tail"] = r["tail"]
    out["cost"], out["audit"] = cheapest(cells.whole())
    return out


def _pieces(sizes: list[int], audit: str) -> Iterator[tuple[str, int]]:
    """For each chunk of so many rows its part of the audit, and how many turns are put out before it. Insertions go with the row after them."""
    at = place = 0
    for n, size in enumerate(sizes):
        start = at
        while size:
            end = at + size  # at least so many edits are still to come
            size = audit.count("I", at, end)
            at = end
        if n == len(sizes) - 1:
            at = len(audit)
        part = audit[start:at]
        yield part, place
        place += len(part) - part.count("D")


def _repairs(runs: DataFrame) -> DataFrame:
    """For each conversation its faults, cost and audit; for each of its chunks (chunk is set) its piece of the audit."""
    kind = runs.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, chunk long, piece string, place long, total long, chunks long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[dict] = []
        conv_type: pa.DataType = pa.int64()

        def close() -> pa.RecordBatch:
            found, done = [], []
            for r in wait:
                if done and done[-1][0]["conv_id"] == r["conv_id"]:
                    done[-1].append(r)
                else:
                    done.append([r])
            for rows in done:
                own = _united(rows)
                audit = own["audit"]
                total = len(audit) - audit.count("D")
                gaps = int(own["most"]) - int(own["least"]) + 1 - own["turns"] if own["least"] is not None else 0
                found.append({c: own[c] for c in ("conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit")} | {"gaps": gaps})
                for chunk, (piece, place) in zip(own["chunks"], _pieces(own["sizes"], audit), strict=True):
                    found.append(dict(conv_id=own["conv_id"], chunk=chunk, piece=piece, place=place, total=total, chunks=len(own["chunks"])))
            kinds = dict(conv_id=conv_type, piece=pa.string(), audit=pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in found], kinds.get(c, pa.int64())) for c in names], names)

        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            rows = batch.to_pylist()
            if len(wait) + len(rows) > 512 and wait and rows[0]["conv_id"] != wait[-1]["conv_id"]:
                yield close()
                wait = []
            for r in rows:
                if len(wait) > 512 and r["conv_id"] != wait[-1]["conv_id"]:
                    yield close()
                    wait = []
                wait.append(r)
        if wait:
            yield close()

    parts = runs.filter(F.col("costs").isNotNull()).drop("keys", "letters", "more")
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(run, schema)


def _edits(chunks: DataFrame) -> DataFrame:
    """(conv_id, chunk, chunks, place, key, role): what each piece of an audit puts out: rows that stay (role is null if kept) and inserted ones (key is null)."""
    kind = chunks.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, chunk long, chunks long, place long, key binary, role string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            convs: list = []
            columns: list[list] = [[], [], [], [], []]
            for r in batch.to_pylist():
                row, skip, place = 0, r["more"], r["place"]
                left = 0  # copies of the row before that have to go
                for edit in r["piece"]:
                    key = None
                    if edit != "I":
                        if left:
                            left -= 1
                            continue
                        key, left, row = r["keys"][row], skip[row], row + 1
                    if edit == "D":
                        continue
                    convs.append(r["conv_id"])
                    role = None if edit == "K" else role_at(place, r["total"])
                    for c, v in zip(columns, (r["chunk"], r["chunks"], place, key, role), strict=True):
                        c.append(v)
                    place += 1
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(convs, batch.schema.field("conv_id").type), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["conv_id", "chunk", "chunks", "place", "key", "role"])

    return chunks.mapInArrow(run, schema)


def _digests(parts: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) from (conv_id, chunk, digest, part): the digest where a conversation is one chunk, else that of its parts in order, one at a time."""
    kind = parts.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None  # of the conversation whose parts are being read
        for batch in batches:
            convs, found = [], []
            for own, digest, part in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "digest", "part")), strict=True):
                if state is not None and own != conv:
                    convs.append(conv)
                    found.append(state.hexdigest())
                    state = None
                if digest is not None:
                    convs.append(own)
                    found.append(digest)
                elif state is None:
                    conv, state = own, hashlib.sha256(part.encode())
                else:
                    state.update(b"\n" + part.encode())
            yield pa.RecordBatch.from_arrays([pa.array(convs, batch.schema.field("conv_id").type), pa.array(found, pa.string())], ["conv_id", "repaired_sha256"])
            kind_ = batch.schema.field("conv_id").type
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind_), pa.array([state.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])

    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repaired_lines(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From rows after damage: the faults, cost and audit of each conversation, and its repaired turns.

    rows: conv_id, turn, role, text (neither null) and copies. Turns: (conv_id, chunk, chunks, place, line): place counts within the conversation, a chunk has
    consecutive places, line is `role:text`.
    """
    runs = stored(_runs(_skeleton(rows)), "conversation-runs")
    found = stored(_repairs(runs), "conversation-repairs")
    pieces = found.filter(F.col("chunk").isNotNull()).select("chunk", "piece", "place", "total", "chunks")
    chunks = runs.filter(F.col("costs").isNull()).select("conv_id", "chunk", "keys", "more").join(pieces, "chunk")
    edits = stored(_edits(chunks), "conversation-edits")
    key = _digest(F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text"))
    texts = rows.select(key.alias("key"), F.col("role").alias("own_role"), "text").dropDuplicates(["key"])
    kept = edits.filter(F.col("key").isNotNull()).join(texts, "key")
    line = lambda role, text: F.concat_ws(":", role, text).alias("line")
    lines = kept.select("conv_id", "chunk", "chunks", "place", line(F.coalesce("role", "own_role"), F.col("text")))
    inserted = edits.filter(F.col("key").isNull()).select("conv_id", "chunk", "chunks", "place", line(F.col("role"), F.lit("")))
    return found.filter(F.col("chunk").isNull()), lines.unionByName(inserted)


def repair_conversations(conversations: DataFrame, rows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """For each conv_id of conversations (null is one, too) the faults of its rows, the cheapest repair and the digest of what is repaired.

    rows: as `damaged` gives them. Rows go by turn (null first); rows of the same turn by a digest of turn, role and text, so that equal ones are
    adjacent: the first counts, the others are duplicates. Empty tables give no rows; a conversation without rows has zeros, an empty audit and the
    digest of an empty text. Very long texts and conversations are repaired whole; an audit is one string, which a conversation of over some 10^8
    rows would not fit.
    """
    found, lines = repaired_lines(rows)
    group = lines.groupBy("chunk").agg(F.first("conv_id").alias("conv_id"), F.first("chunks").alias("chunks"), F.sort_array(F.collect_list(F.struct("place", "line"))).alias("lines"))
    part = F.array_join("lines.line", "\n")
    parts = group.select("conv_id", "chunk", F.when(F.col("chunks") == 1, F.sha2(part, 256)).alias("digest"), F.when(F.col("chunks") > 1, part).alias("part"))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    texts = ["audit", "repaired_sha256"]
    none = lambda c: F.lit(None).cast("long" if c in numbers else "string").alias(c)
    every = conversations.select(F.col(conv_col).alias("conv_id"), *map(none, numbers + texts))
    found = found.select("conv_id", *numbers, "audit", none("repaired_sha256"))
    digests = _digests(parts).select("conv_id", *map(none, [*numbers, "audit"]), "repaired_sha256")
    whole = every.unionByName(found).unionByName(digests).groupBy("conv_id").agg(*(F.max(c).alias(c) for c in numbers + texts))
    return whole.fillna(0, numbers).fillna({"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()})


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair_conversations(conversations, damaged(conversations))
