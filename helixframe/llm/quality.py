"""Quality: attention-based multiple-instance learning.

A document is a bag of passages of WORDS words. Each passage is encoded from its words, hashed to HASHED embeddings that
are learned, and from measures of its bytes and words; gated attention weighs the passages, and the document's score is that of the weighted sum of their encodings.
Encoder, gates and classifier are fitted together to document labels; which passages matter is learned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import released, sliced, small_batches, stored, table, text_bytes
from helixframe.llm.toxicity import labelled_sample

WORDS = 64
HIDDEN, GATE = 16, 8
HASHED = 256
#: The bounded sample of labelled rows: so many at most, those with the smallest hash of their id.
MAX_LABELLED = 8_000
EPOCHS, BATCH, RATE, DECAY = 40, 64, 0.01, 1e-4

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOLS = b"!?.,;:|*&$%#@<>{}[]()/\\_-=+~^\"'"
#: kinds of bytes: upper, lower, digit, line end, non-ASCII, control and symbols one by one
_KINDS = np.full(256, 5, np.int64)
for _i, _run in enumerate((range(65, 91), range(97, 123), range(48, 58), (10, 13), range(128, 256))):
    _KINDS[list(_run)] = _i
for _i, _b in enumerate(_SYMBOLS):
    _KINDS[_b] = 6 + _i
_KINDS[[9, 11, 12, 32]] = -1
N_KINDS = 6 + len(_SYMBOLS)
MEASURES = N_KINDS + 8
FEATURES = MEASURES + HASHED
_POWER = np.uint64(0x9E3779B97F4A7C15)


def passages(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Measures of each passage, and where each text's passages start (one more than texts). A text has one at least."""
    n = len(bounds) - 1
    white = _WHITE[data]
    first = np.zeros(len(data) + 1, bool)  # first bytes of texts also start words
    first[bounds[:-1]] = True
    starts = np.flatnonzero(~white & (np.concatenate([[True], white[:-1]]) | first[:-1])) if len(data) else np.empty(0, np.int64)
    doc = np.searchsorted(bounds, starts, "right") - 1
    words = np.bincount(doc, minlength=n)
    bags = np.maximum(1, -(-words // WORDS))
    bag_start = np.concatenate([[0], np.cumsum(bags)])
    rank = np.arange(len(starts)) - np.repeat(np.concatenate([[0], np.cumsum(words)])[:-1], words)
    passage = bag_start[doc] + rank // WORDS
    total = int(bag_start[-1])
    out = np.zeros((total, FEATURES), np.float32)
    if len(starts):
        size = np.diff(np.append(starts, len(data)))
        cum = np.concatenate([[0], np.cumsum(~white)])
        end = np.minimum(starts + size, bounds[doc + 1])
        length = (cum[end] - cum[starts]).astype(np.float64)
        owner = np.repeat(passage, size)
        kinds = _KINDS[data[starts[0] :]]
        solid = kinds >= 0
        counts = np.bincount(owner[solid] * N_KINDS + kinds[solid], minlength=total * N_KINDS).reshape(total, N_KINDS)
        n_bytes = np.maximum(counts.sum(axis=1), 1)
        out[:, :N_KINDS] = counts / n_bytes[:, None]
        n_words = np.bincount(passage, minlength=total)
        safe = np.maximum(n_words, 1)
        mixed = np.where(white[starts[0] :], 0, data[starts[0] :].astype(np.uint64) + np.uint64(1))
        place = (np.arange(len(mixed)) - np.repeat(starts - starts[0], size)).astype(np.uint64)
        spread = mixed * ((place * _POWER) ^ ((place + np.uint64(7)) << np.uint64(17)) | np.uint64(1))
        hashes = np.add.reduceat(spread, starts - starts[0]) * _POWER
        order = np.lexsort((hashes, passage))
        fresh = np.concatenate([[True], (hashes[order][1:] != hashes[order][:-1]) | (passage[order][1:] != passage[order][:-1])])
        kinds_of_words = np.bincount(passage[order][fresh], minlength=total)
        again = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])])
        mean = np.bincount(passage, length, total) / safe
        extra = (
            kinds_of_words / safe, np.bincount(passage, again, total) / safe, mean, np.sqrt(np.maximum(np.bincount(passage, length**2, total) / safe - mean**2, 0)),
            np.bincount(passage, length <= 1, total) / safe, np.log1p(n_words), np.bincount(passage, length > 20, total) / safe, np.log1p(np.repeat(words, bags)),
        )
        out[:, N_KINDS:MEASURES] = np.column_stack(extra)
        bucket = (hashes >> np.uint64(64 - HASHED.bit_length() + 1)).astype(np.int64)
        out[:, MEASURES:] = np.sqrt(np.bincount(passage * HASHED + bucket, minlength=total * HASHED).reshape(total, HASHED) / safe[:, None])
    return out, bag_start


def _segment_softmax(logits: np.ndarray, start: np.ndarray) -> np.ndarray:
    sizes = np.diff(start)
    e = np.exp(logits - np.repeat(np.maximum.reduceat(logits, start[:-1]), sizes))
    return e / np.repeat(np.add.reduceat(e, start[:-1]), sizes)


class AttentionModel:
    """score = sigmoid(c . sum_k a_k h_k + b), h = tanh(W x), a = softmax(w . (tanh(V h) * sigmoid(U h)))."""

    def __init__(self, features: int = FEATURES, seed: int = 11):
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(features), np.ones(features)
        self.p = {
            "W": r.normal(0, features**-0.5, (features, HIDDEN)), "e": np.zeros(HIDDEN), "V": r.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
            "U": r.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "w": r.normal(0, GATE**-0.5, GATE), "c": r.normal(0, HIDDEN**-0.5, HIDDEN), "b": np.zeros(1),
        }

    def forward(self, x: np.ndarray, start: np.ndarray) -> dict[str, np.ndarray]:
        p, x = self.p, np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["W"] + p["e"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = _segment_softmax((t * s) @ p["w"], start)
        z = np.add.reduceat(a[:, None] * h, start[:-1], axis=0)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "score": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"][0], -35, 35)))}

    def gradient(self, f: dict[str, np.ndarray], start: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, sizes = self.p, np.diff(start)
        d = (f["score"] - y) / len(y)
        dz = np.repeat(d[:, None] * p["c"], sizes, axis=0)
        da = (dz * f["h"]).sum(axis=1)
        dl = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, start[:-1]), sizes))
        dt, ds = dl[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2), dl[:, None] * p["w"] * f["t"] * f["s"] * (1 - f["s"])
        dh = (f["a"][:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": f["x"].T @ dh, "e": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ dl, "c": f["z"].T @ d, "b": d.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS) -> AttentionModel:
        """Adam on the log loss. Without bags the score is 0.5 everywhere."""
        if not bags:
            self.p["c"] *= 0
            return self
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(axis=0, dtype=np.float64), np.maximum(every.std(axis=0, dtype=np.float64), 1e-2)
        base = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.p["b"][:] = np.log(base / (1 - base))
        r, step = np.random.default_rng(5), 0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            order = r.permutation(len(bags))
            for lo in range(0, len(order), BATCH):
                own = order[lo : lo + BATCH]
                start = np.cumsum([0] + [len(bags[i]) for i in own])
                g, step = self.gradient(self.forward(np.concatenate([bags[i] for i in own]), start), start, y[own]), step + 1
                rate = RATE * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, x in self.p.items():
                    gk = g[k] + DECAY * x
                    m[k] = 0.9 * m[k] + 0.1 * gk
                    v[k] = 0.999 * v[k] + 0.001 * gk * gk
                    x -= rate * m[k] / (np.sqrt(v[k]) + 1e-8)
        return self


def fit_quality(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> AttentionModel:
    """Passages of the bounded sample are measured by many tasks and fitted by one, which gets at most `bound` documents.

    A sampled document keeps all its passages: each is a few numbers for 64 words. Without labelled rows the
    score is 0.5 everywhere.
    """
    sample = stored(labelled_sample(docs, labels, "quality", 5, 0, bound), "quality-sample")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                x, start = passages(*text_bytes(part.column("text")))
                packed = [x[a:b].tobytes() for a, b in zip(start[:-1], start[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(packed, pa.binary())], ["doc_id", "label", "passages"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    measured = sample.mapInArrow(measure, f"doc_id {kind}, label double, passages binary").groupBy()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:  # one task: of at most `bound` rows
        pdf = pdf.sort_values(["doc_id", "label"])
        bags = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in pdf["passages"]]
        model = AttentionModel().fit(bags, pdf["label"].to_numpy(float))
        parts = model.p | {"mean": model.mean, "scale": model.scale}
        return pd.DataFrame({"name": list(parts), "value": [x.ravel().tolist() for x in parts.values()]})

    model = AttentionModel()
    rows = {r["name"]: np.array(r["value"]) for r in measured.applyInPandas(fit, "name string, value array<double>").collect()}
    if not rows:
        return model.fit([], np.empty(0))
    model.mean, model.scale = rows.pop("mean"), rows.pop("scale")
    model.p = {k: x.reshape(model.p[k].shape) for k, x in rows.items()}
    return model


def score_quality(docs: DataFrame, model: AttentionModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score from 0 to 1; one row per row, all columns kept (score_col replaces one of its name).

    Null and empty texts are one empty passage, equal texts get equal scores; a very long text is scored with all its
    passages. An empty table gives no rows. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)
    docs = docs.drop(score_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for part in sliced(batch, text_col):
                x, start = passages(*text_bytes(part.column(text_col)))
                yield part.append_column(score_col, pa.array(shared.value.forward(x, start)["score"], pa.float64()))

    return docs.mapInArrow(score, schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
