"""Toxicity by class-conditional Kneser-Ney word models.

Each class, toxic and ordinary, has an interpolated Kneser-Ney model learned from
labelled documents. A word's probability after the word before it takes the pair's
continuation count less a discount, and backs off to the word's own continuation
count, from there to that of its stem (the first bytes of the word, so that forms
never seen share what is known of their kin), and from there to counts of all
documents, labelled or not, which both classes share::

    P(w | v) = max(c(v w) - d, 0) / c(v) + left(v) * P(w)
    P(w)     = max(c(w) - d, 0) / c      + left    * P(stem of w) * S(w) / S(stem of w)
    P(s)     = max(c(s) - d, 0) / c      + left'   * S(s)

c(v w) is how many different words precede the pair, c(w) how many precede the
word, c(s) the sum of that over the stem's words; copies of a text raise none of
them. S are the shared probabilities. Each level sums to 1.

A document's evidence is the log-likelihood as toxic less that as ordinary,
length-normalised: of the whole text, of its most toxic expression (two words in
a row) and of its few most toxic ones. A logistic curve, fitted on labelled
documents that the models haven't counted, turns these into a probability. The
constants were chosen by cross-validation among folds 1 to 4 of labels.

Words are 64-bit hashes. Shared counts are a table that grows with the corpus;
the models hold what the labelled documents taught them beyond the discounts, so
what is broadcast is bounded by those. Of a word that no class knows, the shared
count cancels out between the classes.

Defined cases: null and empty texts have no evidence and get the curve's value
for that; labels that are null or of unknown documents are ignored, a document
labelled both ways counts as toxic; rows that share a doc_id are each scored, and
each counted if it is labelled; ties in the choice of labelled documents go to the
smaller doc_id; without both classes every score is 0; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, blocks, buffers, cut, mix, words

#: Most labelled documents of each class that the models count, and most that the curve is fitted on: those of the smallest hash of their id.
MAX_COUNTED, MAX_CURVE = 5_000, 5_000
#: Taken from every count of a level; what it leaves backs off.
DISCOUNT = 4
#: Bytes of a stem.
STEM_BYTES = 7
#: Words of an expression, and how many of the most toxic ones are averaged.
EXPRESSION, TOP = 2, 4
#: One labelled document of so many is kept for the curve.
CURVE_PART = 5
_START = np.uint64(0x5851F42D4C957F2D)
_STEP = np.uint64(257)


def fold_of(doc_id: Column) -> Column:
    """The fold (0 to 4) of a document; 0 is never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


@dataclass
class Tokens:
    """Words of a column of texts, as hashes: each with its stem and the two words before it."""

    word: np.ndarray
    stem: np.ndarray
    before: np.ndarray
    earlier: np.ndarray
    first: np.ndarray  # where each text's words begin


def _shifted(word: np.ndarray, first: np.ndarray) -> np.ndarray:
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[first[:-1][first[:-1] < len(word)]] = _START
    return before


def tokens(column: pa.Array) -> Tokens:
    data, offsets = buffers(column)
    word, start, end, first = words(data, offsets, ALNUM, lower=True)
    stem, length = np.zeros(len(word), np.uint64), np.minimum(end - start, STEM_BYTES)
    for j in range(STEM_BYTES):
        some = np.flatnonzero(length > j)
        stem[some] = stem[some] * _STEP + LOWER[data[start[some] + j]] + np.uint64(1)
    before = _shifted(word, first)
    return Tokens(word, mix(stem), before, _shifted(before, first), first)


def _pair(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(3) + (word ^ (before >> np.uint64(32))))


def shared_counts(docs: DataFrame) -> DataFrame:
    """``(word, stem, n)``: counts of all words of all documents, summed by block first."""

    def run(batches):
        for b in blocks(batches):
            t = tokens(b.column("text"))
            word, at, n = np.unique(t.word, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (word, t.stem[at], n)], ["word", "stem", "n"])

    return docs.select("text").mapInArrow(run, "word bigint, stem bigint, n bigint").groupBy("word", "stem").agg(F.sum("n").alias("n"))


def pair_counts(docs: DataFrame) -> DataFrame:
    """``(toxic, before, word, stem, n)``: for each pair of words in ``docs(text, toxic)`` how many different words precede it."""

    def run(batches):
        for b in blocks(batches):
            t = tokens(b.column("text"))
            toxic = np.repeat(b.column("toxic").to_numpy(), np.diff(t.first)).astype(np.uint64)
            whole = _pair(t.earlier, _pair(t.before, t.word))
            _, at = np.unique(whole ^ mix(toxic + np.uint64(1)), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(toxic[at].astype(np.int32)), *(pa.array(x[at].astype(np.int64)) for x in (whole, t.before, t.word, t.stem))], ["toxic", "whole", "before", "word", "stem"])

    rows = docs.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "toxic int, whole bigint, before bigint, word bigint, stem bigint")
    return rows.distinct().groupBy("toxic", "before", "word", "stem").agg(F.count("*").alias("n"))


@dataclass
class Table:
    """A value of each class by key; ``other`` for keys that aren't listed."""

    key: np.ndarray  # ascending
    value: np.ndarray  # a row for each class
    other: tuple[float, float]

    def at(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of each class, whether the key is listed)."""
        if not len(self.key):
            return np.repeat(np.array(self.other)[:, None], len(key), axis=1), np.zeros(len(key), bool)
        i = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        known = self.key[i] == key
        return np.where(known, self.value[:, i], np.array(self.other)[:, None]), known


@dataclass
class Models:
    """Both classes' models, ordinary first, and the curve."""

    pairs: Table  # discounted share of the word after the one before it
    left: Table  # what the word before leaves to the word's own level
    words: Table  # P(w) of words that a class knows or has in a known pair
    stems: Table  # P(s) as above over S(s), of stems that a class knows
    words_left: tuple[float, float]  # what the level of words leaves to that of stems
    curve: tuple[float, ...] = (0.0,) * 4

    def likelihoods(self, t: Tokens) -> np.ndarray:
        """For both classes log P(w | v); of words that none knows less log S(w), which is the same for both."""
        base, known = self.words.at(t.word)
        new = np.flatnonzero(~known)
        base[:, new] = np.array(self.words_left)[:, None] * self.stems.at(t.stem[new])[0]
        return np.log(self.pairs.at(_pair(t.before, t.word))[0] + self.left.at(t.before)[0] * base)

    def features(self, column: pa.Array) -> np.ndarray:
        """For each text the evidence per word: of all of it, of its highest expression, and of its highest few on average."""
        t = tokens(column)
        both = self.likelihoods(t)
        sums = np.concatenate(([0.0], np.cumsum(both[1] - both[0])))
        n = np.diff(t.first)
        out = np.zeros((len(n), 3))
        out[:, 0] = (sums[t.first[1:]] - sums[t.first[:-1]]) / np.maximum(n, 1)
        size = np.minimum(n, EXPRESSION)
        owner = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(owner))
        begins = at + size[owner] <= t.first[1:][owner]
        at, owner = at[begins], owner[begins]
        value = (sums[at + size[owner]] - sums[at]) / EXPRESSION
        some = np.flatnonzero(n)
        first = np.searchsorted(owner, some)
        total, many = np.zeros(len(n)), np.zeros(len(n))
        for k in range(TOP if len(some) else 0):  # the highest of each text, which then leaves
            high = np.full(len(n), -np.inf)
            high[some] = np.maximum.reduceat(value, first)
            if not k:
                out[some, 1] = high[some]
            there = np.isfinite(high)
            total[there] += high[there]
            many += there
            top = np.flatnonzero(there[owner] & (value == high[owner]))
            _, once = np.unique(owner[top], return_index=True)
            value[top[once]] = -np.inf
        out[:, 2] = total / np.maximum(many, 1)
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        x = self.features(column) @ np.array(self.curve[1:]) + self.curve[0]
        return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def _by_class(toxic: np.ndarray, key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, value of each class) of rows, one for each class and key."""
    keys, at = np.unique(key, return_inverse=True)
    out = np.zeros((2, len(keys)))
    out[toxic, at] = value
    return keys, out


def _known(counts: DataFrame, key: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A level's (keys of counts beyond the discount, discounted share by class, share that is left by class) of ``counts(toxic, key, n)``."""
    name = F.when(F.col("n") > DISCOUNT, F.col(key))
    got = counts.groupBy("toxic", name.alias("key")).agg(F.sum("n").alias("n")).toArrow()
    toxic, n, strong = got["toxic"].to_numpy(), got["n"].to_numpy().astype(float), got["key"].is_valid().to_numpy()
    whole = np.maximum(np.bincount(toxic, weights=n, minlength=2), 1)
    keys, share = _by_class(toxic[strong], got["key"].filter(pa.array(strong)).to_numpy().astype(np.uint64), (n[strong] - DISCOUNT) / whole[toxic[strong]])
    return keys, share, 1 - share.sum(axis=1)


def _shared_mass(shared: DataFrame, word: np.ndarray, stem: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """S of the given words and stems, each distinct and ascending."""
    spark = shared.sparkSession
    frame = lambda name, x: F.broadcast(spark.createDataFrame(pa.table({name: pa.array(x.astype(np.int64)), f"__{name}": pa.array(np.arange(len(x)))})))
    marked = shared.join(frame("word", word), "word", "left").join(frame("stem", stem), "stem", "left")
    got = marked.groupBy("__word", "__stem").agg(F.sum("n").alias("n"), F.count("*").alias("words")).toArrow()
    mass = got["n"].to_numpy() + 0.5 * got["words"].to_numpy()
    mass = mass / max(mass.sum(), 1e-300)
    out = []
    for name, x in (("__word", word), ("__stem", stem)):
        on = got[name].is_valid().to_numpy()
        out.append(np.bincount(got[name].filter(pa.array(on)).to_numpy(), weights=mass[on], minlength=len(x)))
    return out[0], out[1]


def fit_models(shared: DataFrame, pairs: DataFrame) -> Models:
    """Kneser-Ney tables from ``shared_counts`` and ``pair_counts``; what reaches the driver is bounded by the labelled documents."""
    pairs = cut(pairs)
    per_word = pairs.groupBy("toxic", "word", "stem").agg(F.count("*").alias("n"))
    word_key, word_share, word_left = _known(per_word, "word")
    stem_key, stem_share, stem_left = _known(per_word.groupBy("toxic", "stem").agg(F.sum("n").alias("n")), "stem")
    number = lambda rows, name: rows[name].to_numpy().astype(np.uint64)
    strong = pairs.where(F.col("n") > DISCOUNT).toArrow()
    beyond = F.greatest(F.col("n") - DISCOUNT, F.lit(0))
    context = pairs.groupBy("toxic", "before").agg(F.sum("n").alias("n"), F.sum(beyond).alias("kept")).where("kept > 0").toArrow()
    ctx_key, ctx_all = _by_class(context["toxic"].to_numpy(), number(context, "before"), context["n"].to_numpy())
    _, ctx_kept = _by_class(context["toxic"].to_numpy(), number(context, "before"), context["kept"].to_numpy())
    toxic, before, word = strong["toxic"].to_numpy(), number(strong, "before"), number(strong, "word")
    share = (strong["n"].to_numpy() - DISCOUNT) / ctx_all[toxic, np.searchsorted(ctx_key, before)] if len(word) else np.zeros(0)
    pair_key, pair_share = _by_class(toxic, _pair(before, word), share)
    # Words that a class knows or has in a known pair get their whole probability, so their shared counts are looked up.
    words_known = np.union1d(word_key, word)
    owners = pairs.sparkSession.createDataFrame(pa.table({"word": pa.array(words_known.astype(np.int64))}))
    stems_of = per_word.join(F.broadcast(owners), "word").select("word", "stem").distinct().toArrow()
    stem_of = np.zeros(len(words_known), np.uint64)
    stem_of[np.searchsorted(words_known, number(stems_of, "word"))] = number(stems_of, "stem")
    stems_known = np.union1d(stem_key, stem_of)
    word_mass, stem_mass = _shared_mass(shared, words_known, stems_known)
    stem_p = stem_left[:, None] * stem_mass
    stem_p[:, np.searchsorted(stems_known, stem_key)] += stem_share
    at = np.searchsorted(stems_known, stem_of)
    word_p = word_left[:, None] * stem_p[:, at] * (word_mass / stem_mass[at])
    word_p[:, np.searchsorted(words_known, word_key)] += word_share
    both = lambda x: (float(x[0]), float(x[1]))
    return Models(Table(pair_key, pair_share, (0.0, 0.0)), Table(ctx_key, 1 - ctx_kept / np.maximum(ctx_all, 1), (1.0, 1.0)), Table(words_known, word_p, (0.0, 0.0)), Table(stems_known, stem_p / stem_mass, both(stem_left)), both(word_left))


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton's method with a slight penalty."""
    scale = np.maximum(np.abs(x).max(axis=0, initial=1e-9), 1e-9)
    a = np.concatenate([np.ones((len(x), 1)), x / scale], axis=1)
    w = np.zeros(a.shape[1])
    held = 1e-2 * np.append(0.0, np.ones(len(w) - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -60, 60)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(w)), a.T @ (p - y) + held * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return (float(w[0]), *(float(v) for v in w[1:] / scale))


def train(docs: DataFrame, labels: DataFrame, max_counted: int = MAX_COUNTED, max_curve: int = MAX_CURVE) -> Models | None:
    """Fits the models and the curve on labelled documents outside fold 0; None without both classes."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(fold_of(F.col("doc_id")) != 0)
    marked = marked.withColumn("__curve", F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(CURVE_PART)) == 0)
    order = (F.xxhash64("doc_id"), "doc_id")
    part = lambda test, most: marked.where(test).orderBy(*order).limit(most)
    some = part("NOT __curve AND toxic = 1", max_counted).union(part("NOT __curve AND toxic = 0", max_counted)).union(part("__curve", max_curve))
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "text", "toxic", "__curve")
    models = fit_models(shared_counts(docs), pair_counts(rows.where(~F.col("__curve"))))
    held = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for b in blocks(batches):
            x = held.value.features(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("toxic"), *(pa.array(v) for v in x.T)], ["toxic", "x0", "x1", "x2"])

    got = rows.where("__curve").select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(run, "toxic int, x0 double, x1 double, x2 double").orderBy("x0", "x1", "x2", "toxic").toArrow()
    y = got["toxic"].to_numpy()
    if not (0 < y.sum() < len(y)):
        return None
    models.curve = fit_curve(np.stack([got[c].to_numpy() for c in ("x0", "x1", "x2")], axis=1), y.astype(float))
    return models


def score_documents(docs: DataFrame, models: Models | None) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id and score."""
    if models is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    held = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for b in blocks(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(held.value.scores(b.column("text")))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
