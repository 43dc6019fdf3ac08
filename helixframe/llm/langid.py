"""Language identification by interpolated Kneser-Ney character language models.

A text is its runs of letters in lower case, each between two blanks. For each language one model gives the
probability of every character after up to ORDER - 1 others of its word: absolute discounts of its own, and
continuation counts below the highest order. The n-grams of all languages are one sorted array of hashes for each
order, with the log probabilities and back-off weights of those languages that have them; a text gets the language of
the lowest cross-entropy per character. Every CALIBRATE-th sampled text of a language, and MEASURED more that are not sampled,
are not counted but measured: posteriors are tempered so that they fit these texts, and a cross-entropy that hardly any of the
chosen language has marks the row as rejected. How far is decided over all languages together, as standard deviations, since a
small language has too few texts for a quantile.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.llm.common import forget, is_small, only, own_cache, released, sliced, small_batches, stored, table, texts_of

LETTERS = regex.compile(r"\p{L}+")
ORDER = 4
#: The bounded sample: so many texts of each language at most, those with the smallest hash of their id.
MAX_TEXTS = 1_500
CALIBRATE = 5
#: Texts of each language that are measured at most, beside those of the sample; those with the next hashes.
MEASURED = 4_000
UNSEEN = 1e-6  # probability of a character that no training text has
REJECT = 0.99  # quantile of calibrating texts' cross-entropy, in standard deviations of their language, beyond which a row is rejected
CACHED = 100_000  # words
CACHED_SCORES = 1_600_000  # of words by languages
LONG = 64  # code points; longer words are scored but not cached

_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def padded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of ' word ' for all words, and where each starts (one more than words)."""
    text = " " + "  ".join(words) + " " if words else ""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.cumsum([0] + [len(w) + 2 for w in words])


def gram_hashes(points: np.ndarray, bounds: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the `order` code points that end at each place, and whether they lie in one word."""
    x = points.astype(np.uint64) + np.uint64(1)
    h = np.full(len(x), order, np.uint64)
    for back in range(order - 1, -1, -1):
        h[back:] = (h[back:] ^ x[: len(x) - back]) * _P
        h[back:] ^= h[back:] >> np.uint64(31)
    inside = np.arange(len(x)) - np.repeat(bounds[:-1], np.diff(bounds)) >= order - 1
    return h * _Q, inside


#: sorted hashes; where the entries of each start (one more than hashes); languages and values of the entries
Table = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _table(entries: dict[tuple[int, str], float], n: int) -> Table:
    """entries: for (language number, n-gram) a value."""
    names = sorted({gram for _, gram in entries})
    row = {gram: i for i, gram in enumerate(names)}
    points = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32)
    hashes = gram_hashes(points, np.arange(0, len(points) + 1, n), n)[0][n - 1 :: n]
    rank = np.empty(len(names), np.int64)
    rank[np.argsort(hashes)] = np.arange(len(names))
    rows = rank[np.fromiter((row[gram] for _, gram in entries), np.int64, len(entries))]
    langs, values = np.fromiter((lang for lang, _ in entries), np.int32, len(entries)), np.fromiter(entries.values(), np.float32, len(entries))
    order = np.lexsort((langs, rows))
    return np.sort(hashes), np.searchsorted(rows[order], np.arange(len(names) + 1)), langs[order], values[order]


def _entries(table: Table, hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, language, value) of all entries of those hashes that the table has."""
    keys, start, langs, values = table
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.float32)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    there = keys[at] == hashes
    at, places = at[there], places[there]
    sizes = start[at + 1] - start[at]
    every = np.repeat(start[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return np.repeat(places, sizes), langs[every], values[every]


class Model:
    """languages; for each order a table of log probabilities, and one of log back-off weights of the contexts."""

    def __init__(self, languages: list[str], grams: dict[int, dict[tuple[int, str], float]]):
        """grams: for each order and (language number, n-gram) the count."""
        self.languages = languages
        self.logp: list[Table] = []
        self.back: list[Table] = []
        counts: dict[int, dict[tuple[int, str], float]] = {}  # below the highest order, numbers of distinct characters before
        for n in range(ORDER, 0, -1):
            own = dict(grams.get(n, {})) if n == ORDER else {}
            if n < ORDER:
                for lang, gram in counts[n + 1]:
                    own[lang, gram[1:]] = own.get((lang, gram[1:]), 0) + 1
                for (lang, gram), k in grams.get(n, {}).items():  # n-grams at a word's start have nothing before them
                    own.setdefault((lang, gram), k)
            counts[n] = own
        lower: dict[tuple[int, str], float] = {}
        for n in range(1, ORDER + 1):
            total, kinds = {}, {}
            ones, twos = np.zeros(len(languages)), np.zeros(len(languages))
            for (lang, gram), k in counts[n].items():
                total[lang, gram[:-1]] = total.get((lang, gram[:-1]), 0) + k
                kinds[lang, gram[:-1]] = kinds.get((lang, gram[:-1]), 0) + 1
                ones[lang] += k == 1
                twos[lang] += k == 2
            discount = np.where((ones > 0) & (twos > 0), ones / np.maximum(ones + 2 * twos, 1), 0.5)
            prob = {}
            for (lang, gram), k in counts[n].items():
                context = lang, gram[:-1]
                weight = discount[lang] * kinds[context] / total[context]
                prob[lang, gram] = max(k - discount[lang], 0) / total[context] + weight * (lower.get((lang, gram[1:]), UNSEEN) if n > 1 else UNSEEN)
            self.logp.append(_table({g: np.log(p) for g, p in prob.items()}, n))
            self.back.append(_table({c: np.log(discount[c[0]] * kinds[c] / total[c]) for c in total}, n - 1) if n > 1 else _table({}, 1))
            lower = prob
        self.temperature, self.limits = 1.0, np.full(len(languages), np.inf)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Sum of log probabilities of each word's characters and the blank after it, a column for each language."""
        points, bounds = padded(words)
        hashes = [gram_hashes(points, bounds, n) for n in range(1, ORDER + 1)]
        score = np.full((len(points), len(self.languages)), np.log(UNSEEN), np.float32)
        for n in range(1, ORDER + 1):
            places = np.flatnonzero(hashes[n - 1][1])
            if n > 1 and len(places):  # score of the order below, backed off, unless this order has the n-gram
                place, lang, value = _entries(self.back[n - 1], hashes[n - 2][0][places - 1], places)
                score[place, lang] += value
            place, lang, value = _entries(self.logp[n - 1], hashes[n - 1][0][places], places)
            score[place, lang] = value
        score[bounds[:-1]] = 0  # the blank before a word is given
        return np.add.reduceat(score, bounds[:-1], axis=0) if words else score


class Classifier:
    def __init__(self, model: Model):
        self.model, self.index = model, {}
        self.cached = max(1, min(CACHED, CACHED_SCORES // max(1, len(model.languages))))
        self.scores = np.empty((0, len(model.languages)), np.float32)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text for each language, and each text's number of letters."""
        found = [LETTERS.findall(t.lower()) for t in texts]
        words = list(chain.from_iterable(found))
        new = [w for w in dict.fromkeys(words) if w not in self.index]
        for lo in range(0, len(new), self.cached):
            some = new[lo : lo + self.cached]
            self.index.update(zip(some, range(len(self.scores), len(self.scores) + len(some)), strict=True))
            self.scores = np.concatenate([self.scores, self.model.word_scores(some)])
        codes = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        counts = np.array([len(f) for f in found], np.int64)
        total, letters = np.zeros((len(texts), self.scores.shape[1])), np.zeros(len(texts), np.int64)
        some = np.flatnonzero(counts)
        if len(some):
            starts = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
            total[some] = np.add.reduceat(self.scores[codes].astype(np.float64), starts, axis=0)
            letters[some] = np.add.reduceat(sizes, starts)
        if len(self.index) > 2 * self.cached:
            self.index = {w: i for w, i in self.index.items() if i < self.cached and len(w) <= LONG}
            self.scores = self.scores[: self.cached]
        return -total / np.maximum(letters + counts, 1)[:, None], letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, whether rejected."""
        entropy, letters = self.entropies(texts)
        if not self.model.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        best = entropy.argmin(axis=1)
        gap = np.exp(-(entropy - entropy.min(axis=1, keepdims=True)) * np.minimum(letters, 200)[:, None] / self.model.temperature)
        score = np.where(letters > 0, 1 / gap.sum(axis=1), 0.0)
        names = [self.model.languages[b] if n else "und" for b, n in zip(best, letters, strict=True)]
        return names, score, (letters == 0) | (entropy.min(axis=1) > self.model.limits[best])


def fit_languages(docs: DataFrame) -> Model:
    """docs: doc_id, text, lang. Learns from a bounded sample outside the held-out fold (crc32 of the id mod 4 is 2).

    n-grams are counted by Spark; what reaches the driver is bounded by the sample. Rows that repeat an id are sampled together, each as a row of its own.
    """
    own = docs.filter("text IS NOT NULL AND lang IS NOT NULL").filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    sizes = own.groupBy("lang").count().collect()  # a row for each language
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return Model([], {})
    #: ids whose hash is under a language's share of the range: about MAX_TEXTS of each, and about MEASURED up to its next share
    share = lambda texts, rows: int(min(1.0, texts / rows) * (1 << 30))
    shares = docs.sparkSession.createDataFrame([(r["lang"], r["count"], share(MAX_TEXTS, r["count"]), share(MAX_TEXTS + MEASURED, r["count"])) for r in sizes], "lang string, rows long, cut long, far long")
    shares = F.broadcast(shares) if is_small(shares) else shares  # a row for each language; a shuffle would send every text to its language's task
    near = own.select("doc_id", "text", "lang").join(shares, "lang").withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))).filter("at < far")
    sample, beyond = near.filter("at < cut"), near.filter("at >= cut").select("lang", "rows", "text")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")))  # of about MAX_TEXTS rows
    sample = stored(sample.select("lang", "rows", "text", (nth % CALIBRATE == 0).alias("apart")), "langid-sample")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, str], int] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch), strict=True):
                for w in LETTERS.findall(text.lower()):
                    found[lang, w] = found.get((lang, w), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(found.values(), pa.int64())], ["lang", "word", "n"])

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, str], int] = {}
            for lang, word, k in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
                word = f" {word} "
                for n in range(1, ORDER + 1):
                    for i in range(1 if n == 1 else 0, len(word) - n + 1):
                        key = lang, word[i : i + n]
                        found[key] = found.get(key, 0) + k
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(found.values(), pa.int64())], ["lang", "gram", "n"])

    words = sample.filter("NOT apart").mapInArrow(count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = words.mapInArrow(count_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    number = {name: i for i, name in enumerate(languages)}
    grams: dict[int, dict[tuple[int, str], float]] = {}
    for lang, gram, n in zip(counted["lang"], counted["gram"], counted["n"], strict=True):
        grams.setdefault(len(gram), {})[number[lang], gram] = n
    model = Model(languages, grams)
    _calibrate(sample.filter("apart").select("lang", "rows", "text").unionByName(beyond), model)
    forget(sample)
    return model


def _calibrate(sample: DataFrame, model: Model) -> None:
    shared = sample.sparkSession.sparkContext.broadcast(model)

    small_batches(sample.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = classifier_of(shared.value)
        number = {name: i for i, name in enumerate(own.model.languages)}
        for batch in released(batches):
            for part in sliced(batch):
                entropy, letters = own.entropies(texts_of(part))
                true = np.array([number[x] for x in part.column("lang").to_pylist()])
                best = entropy[np.arange(len(true)), true]
                others = np.where(np.arange(entropy.shape[1]) == true[:, None], np.inf, entropy).min(axis=1)
                measured = {"entropy": best, "margin": (others - best) * np.minimum(letters, 200), "letters": letters}
                found = part.select(["lang", "rows"]).to_pydict() | measured
                yield pa.RecordBatch.from_pydict(found).filter(pa.array(letters > 0))

    seen = stored(sample.mapInArrow(measure, "lang string, rows long, entropy double, margin double, letters long"), "langid-seen")
    own = seen.groupBy("lang").agg(F.mean("entropy").alias("mean"), F.stddev_pop("entropy").alias("deviation"), F.count(F.lit(1)).alias("apart"))
    # each text stands for its share of its language, so that REJECT is of all documents
    far = F.percentile(F.try_divide(F.col("entropy") - F.col("mean"), "deviation"), F.lit(REJECT), F.ceil(F.col("rows") / F.col("apart")))
    limit = seen.join(own, "lang").agg(far).first()[0]
    every = seen.agg(F.mean("entropy").alias("mean"), F.stddev_pop("entropy").alias("deviation")).first()
    if limit is not None:
        model.limits[:] = every["mean"] + limit * every["deviation"]  # of languages without a text apart
        for row in own.collect():  # a row for each language
            model.limits[model.languages.index(row["lang"])] = row["mean"] + limit * (row["deviation"] or every["deviation"])
    low = seen.filter("letters >= 40").agg(F.percentile_approx("margin", 0.01)).first()[0]
    if low is not None and np.isfinite(low):  # the weakest of a hundred texts is about ten times as likely as not
        model.temperature = float(np.clip(low / np.log(10), 1.0, 50.0))
    forget(seen)


_LAST: list = own_cache("langid", [])


def classifier_of(model: Model) -> Classifier:
    """The worker's classifier: tasks that got the same broadcast share it and its cache."""
    only("langid")
    if not _LAST or _LAST[0] is not model:
        _LAST[:] = [model, Classifier(model)]
    return _LAST[1]


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score (0 to 1), rejected: one row per row of docs, repeated rows and all.

    Null texts and texts without a letter (Unicode category L) are `und` with score 0. A very long text is scored whole.
    An empty table gives no rows. Only id_col and text_col are read. A model without languages says `und` everywhere.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = classifier_of(shared.value)
        for batch in released(batches):
            for part in sliced(batch):
                names, score, rejected = own.predict(texts_of(part))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(predict, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs, fit_languages(docs))
    return found.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), "lang_pred", "score", "rejected")
