"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document has one feature for each distinct word, for each beginning of such a word (inflected forms share
it), and for each distinct pair of words that stand one, two or three places apart, hashed to a table of
fixed size. Per-coordinate rates and L1 keep few weights other than zero; these are all that is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import only, own_cache, released, sliced, small_batches, stored, table, texts_of
from helixframe.llm.words import WordTable, beginnings, split_words

BITS = 21
GAPS = (1, 2, 3)
BEGINNINGS = range(3, 9)
#: The bounded sample of labelled rows: so many at most, those with the smallest hash of their id.
MAX_LABELLED = 16_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.6, 1.0, 6.0, 0.5
MET = 3  # documents of the sample that have a feature, at least; L1 leaves others at zero
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def word_features(words: list[str], hashes: np.ndarray) -> np.ndarray:
    """A row of features for each word; -1: none."""
    whole = ((hashes * _MIX[3]) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.column_stack([whole, beginnings(words, BEGINNINGS, BITS)])


def pair_features(hashes: np.ndarray, docs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, feature) of the pairs of words, for one gap after the other."""
    for gap in GAPS:
        same = docs[gap:] == docs[:-gap]
        mixed = (hashes[:-gap][same] * _MIX[0] + hashes[gap:][same]) * _MIX[gap]
        yield docs[gap:][same], (mixed >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: str, words: WordTable) -> tuple[np.ndarray, np.ndarray]:
    """Features of one document and how often each was hit."""
    found, docs = split_words([text])
    codes = words.codes(found)
    pairs = [np.unique(f) for _, f in pair_features(words.hashes[codes], docs)] if found else []
    distinct = list(dict.fromkeys(found))
    single = word_features(distinct, words.hashes[words.codes(distinct)]).ravel() if found else np.empty(0, np.int64)
    return np.unique(np.concatenate([single[single >= 0], *pairs]), return_counts=True)


def fit_ftrl(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights) other than zero, and the bias."""
    words = WordTable()
    met, rows = np.zeros(1 << BITS, np.int32), []
    for t in texts:
        i, x = features(t or "", words)
        met[i] += 1
        rows.append((i.astype(np.int32), np.minimum(x, 255).astype(np.uint8)))
    for r, (i, x) in enumerate(rows):  # one after the other, as whole and cut rows together take twice the memory
        rows[r] = (i[met[i] >= MET], x[met[i] >= MET])
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    order = np.random.default_rng(7)
    base = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 0.5
    prior = np.log(base / (1 - base))

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(z[i]) > L1, w, 0.0)

    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            i, x = np.append(rows[r][0], 1 << BITS), np.append(rows[r][1], 1.0)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(prior + w @ x, -35, 35)))
            g = (p - labels[r]) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    some = np.flatnonzero(np.abs(z[:-1]) > L1)  # all others are zero
    return some, weights(some), float(prior + weights(np.array([1 << BITS]))[0])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, bound: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, label, text) of at most `bound` labelled documents outside the held-out fold, a row for each id.

    Of rows that repeat an id the greatest label and the least text count.
    """
    own = labels.select("doc_id", F.col(label).cast("double").alias("label")).dropna()
    own = own.filter(F.crc32(F.col("doc_id").cast("string")) % modulus != held_out).groupBy("doc_id").agg(F.max("label").alias("label"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    texts = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id")  # of at most `bound` rows
    return texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """The sample is bounded, so it is one fit in one task at every size of input. Its texts are sent there, which are smaller than their features.

    Without labelled rows, or with one class only, the weights are empty and the bias is that class's rate.
    """
    sample = stored(labelled_sample(docs, labels, "toxic", 4, 2), "toxicity-sample")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "label"])
        some, w, bias = fit_ftrl(pdf["text"].to_list(), pdf["label"].to_numpy(float))
        return pd.DataFrame({"feature": np.append(some, -1), "weight": np.append(w, bias)})

    fitted = sample.groupBy().applyInPandas(fit, "feature long, weight double")
    # at most the size of the table of features, whatever the corpus
    model = fitted.orderBy("feature").toPandas()
    bias = model.loc[model["feature"] < 0, "weight"]
    model = model[model["feature"] >= 0]
    return model["feature"].to_numpy(np.int64), model["weight"].to_numpy(np.float32), float(bias.iloc[0]) if len(bias) else 0.0


class Scorer:
    def __init__(self, model: tuple[np.ndarray, np.ndarray, float]):
        self.table = np.zeros((1 << BITS) + 1, np.float32)  # the last stands for no feature
        self.table[model[0]] = model[1]
        self.bias = model[2]
        self.words = WordTable(lambda words, hashes: self.table[word_features(words, hashes)].sum(axis=1))

    def score(self, texts: list[str]) -> np.ndarray:
        found, docs = split_words(texts)
        total = np.full(len(texts), self.bias)
        if found:
            codes = self.words.codes(found)
            hits = [(docs, codes, self.words.values[codes])]
            hits += [(d, f, self.table[f]) for d, f in pair_features(self.words.hashes[codes], docs)]
            for d, f, w in hits:
                some = np.flatnonzero(w)
                _, first = np.unique(d[some] * (1 << 40) + f[some], return_index=True)
                np.add.at(total, d[some][first], w[some][first])
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


_LAST: list = own_cache("toxicity", [])


def scorer_of(model: tuple[np.ndarray, np.ndarray, float]) -> Scorer:
    """The worker's scorer: tasks that got the same broadcast share it and its cache."""
    only("toxicity")
    if not _LAST or _LAST[0] is not model:
        _LAST[:] = [model, Scorer(model)]
    return _LAST[1]


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score from 0 to 1; one row per row, all columns kept (score_col replaces one of its name).

    Null and empty texts get the score of a document without features, equal texts equal scores; a very long text is
    scored whole and alone. An empty table gives no rows. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)
    docs = docs.drop(score_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(shared.value)
        for batch in released(batches):
            for part in sliced(batch, text_col):
                yield part.append_column(score_col, pa.array(scorer.score(texts_of(part, text_col)), pa.float64()))

    return docs.mapInArrow(score, schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
