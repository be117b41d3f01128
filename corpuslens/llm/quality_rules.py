"""Learned decision lists over document statistics.

``document_stats`` measures whole texts. ``learn_rules`` covers the labelled
bad documents one rule after another: a rule is a conjunction of thresholds,
grown on one part of the labelled rows by information gain, pruned on the
other, and kept only if it is precise there. ``rules_column`` turns the ordered
rules into one conditional Spark expression.

Defined cases: a null or empty text has zero words; it fails the base check.
Labels that are null, of unknown documents or repeated are harmless (a
document with both labels counts as good; of rows that share a doc_id those of the
smallest statistics are learned from); ties of gain go to the statistic and
threshold tried first; an empty table gives no rows; without bad or good examples the
list is empty and only the base check rejects. Extra columns are ignored by
the statistics and kept by ``filter_documents``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, blocks, buffers, count_bytes, lookup, mix, shingles, words

WINDOW = 8
#: Most labelled rows that the list is learned from.
MAX_LABELLED = 12_000
#: Least precision of a rule on the rows held back for pruning.
MIN_PRECISION = 0.9
#: Least bad rows that a rule covers, among those it is grown on and among those held back.
MIN_SUPPORT = 4
#: Most rules, conditions in a rule, and thresholds tried for a statistic.
MAX_RULES, MAX_CONDITIONS, MAX_CUTS = 12, 4, 40

_SYMBOLS = lookup(b"#*$%&|<>")
_SPACES = ~NOT_SPACE
_LEADING = lookup(bytes(range(0x80, 0xC0)), inside=False)
_UPPER = lookup(bytes(range(0x41, 0x5B)))
_LETTERS = lookup(bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0xC0, 0x100)))
_DIGITS = lookup(bytes(range(0x30, 0x3A)))
_MARKS = lookup(b"!?")
_STOPS = lookup(b".,;:")

STATS = {"n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "n_lines": "bigint", "n_upper": "bigint", "n_letters": "bigint", "n_digits": "bigint", "n_marks": "bigint", "n_stops": "bigint", "n_distinct_words": "bigint"}

#: The statistics that rules set thresholds on, by name.
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_word_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "n_letters"),
    "digit_share": ("n_digits", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "stops_per_word": ("n_stops", "n_words"),
    "mean_word_chars": ("word_chars", "n_words"),
    "distinct_word_share": ("n_distinct_words", "n_words"),
}
FEATURES = [*RATIOS, "n_words"]


def _repeats(hashed: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text, its words that lie in windows found twice or more in it."""
    per_text = np.diff(first)
    owner = np.repeat(np.arange(len(per_text)), per_text)
    keys = shingles(hashed, WINDOW)
    whole = np.flatnonzero(owner[: len(keys)] == owner[WINDOW - 1 :]) if len(keys) else np.zeros(0, np.int64)
    keys = keys[whole] ^ mix(owner[whole].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys, kind="stable")
    places = whole[order]
    same = (keys[order][1:] == keys[order][:-1]) & (owner[places[1:]] == owner[places[:-1]]) if len(order) else np.zeros(0, bool)
    at = np.flatnonzero(same)
    for j in range(WINDOW):  # the windows' words must agree, not only the windows' hashes
        at = at[hashed[places[at] + j] == hashed[places[at + 1] + j]]
    twice = np.unique(np.concatenate([places[at], places[at + 1]])) if len(at) else at
    cover = np.zeros(len(hashed) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    sums = np.concatenate(([0], np.cumsum(np.cumsum(cover[:-1]) > 0)))
    return sums[first[1:]] - sums[first[:-1]]


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text, its lines with a word, and those of them equal to an earlier one."""
    n, dup = np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1, np.int64)
    raw = memoryview(data)
    for i in range(len(n)):
        seen, k = set(), 0
        for line in bytes(raw[offsets[i] : offsets[i + 1]]).split(b"\n"):
            if line and not line.isspace():
                k += 1
                seen.add(line)
        n[i], dup[i] = k, k - len(seen)
    return n, dup


def _distinct(hashed: np.ndarray, first: np.ndarray) -> np.ndarray:
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    keys = hashed ^ mix(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    return np.bincount(owner[order][new], minlength=len(first) - 1)


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The statistics of a column of texts."""
    data, offsets = buffers(column)
    hashed, _, _, first = words(data, offsets)
    counted = lambda t: count_bytes(data, offsets, t)
    n_lines, dup = _lines(data, offsets)
    return {
        "n_words": np.diff(first),
        "word_chars": counted(_LEADING & ~_SPACES),
        "n_symbols": counted(_SYMBOLS),
        "n_dup_lines": dup,
        "n_repeat_words": _repeats(hashed, first),
        "n_lines": n_lines,
        "n_upper": counted(_UPPER),
        "n_letters": counted(_LETTERS),
        "n_digits": counted(_DIGITS),
        "n_marks": counted(_MARKS),
        "n_stops": counted(_STOPS),
        "n_distinct_words": _distinct(hashed, first),
    }


def document_stats(docs: DataFrame, keep: list[str] | None = None, text_column: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` (``doc_id`` by default) with the statistics of the whole text.

    Kept columns of the statistics' names are renamed by a leading ``_`` each.
    """
    keep = ["doc_id"] if keep is None else keep
    names = [f"__keep{i}" for i in range(len(keep))]
    rows = docs.select(*[docs[c].alias(n) for c, n in zip(keep, names, strict=True)])
    text = names[keep.index(text_column)] if text_column in keep else "__text"  # a kept text is sent once
    if text_column not in keep:
        rows = docs.select(*[docs[c].alias(n) for c, n in zip(keep, names, strict=True)], docs[text_column].alias("__text"))

    def run(batches):
        for b in blocks(batches, text):
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *(pa.array(v, pa.int64()) for v in measure(b.column(text)).values())], [*names, *STATS])

    schema = ", ".join([*(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names), *(f"{k} {v}" for k, v in STATS.items())])
    out = rows.mapInArrow(run, schema)
    return out.withColumnsRenamed({n: f"_{c}" if c in STATS else c for n, c in zip(names, keep, strict=True)})


def base_failed() -> Column:
    """Fixed rule over the statistics: too few words, or too many inside repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        value = feature_column(self.feature)
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def feature_column(name: str) -> Column:
    if name not in RATIOS:
        return F.col(name).cast("double")
    top, bottom = RATIOS[name]
    return F.col(top) / F.greatest(F.col(bottom), F.lit(1)).cast("double")


def feature_arrays(stats: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out = {k: stats[a] / np.maximum(stats[b], 1).astype(float) for k, (a, b) in RATIOS.items()}
    return out | {"n_words": stats["n_words"].astype(float)}


def _covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(x["n_words"]), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, barred: frozenset = frozenset()) -> Rule:
    """Adds the condition of the most information gain until only bad rows are covered; none of the ``barred`` (feature, above) comes first."""
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS and (inside & ~bad).any():
        p0, all0 = (inside & bad).sum(), inside.sum()
        best, most = None, 1e-9
        for name in FEATURES:
            values = x[name][inside]
            distinct = np.unique(values)
            for t in np.unique(np.quantile(values, np.linspace(0, 1, MAX_CUTS + 2)[1:-1], method="nearest")):
                k = int(np.searchsorted(distinct, t))
                t = (distinct[k] + distinct[min(k + 1, len(distinct) - 1)]) / 2  # half-way to the next value
                for above in (True, False):
                    if not rule and (name, above) in barred:
                        continue
                    c = Condition(name, above, float(t))
                    hit = inside & c.holds(x)
                    p, n = (hit & bad).sum(), hit.sum()
                    if p and n < all0:
                        gain = p * (np.log2(p / n) - np.log2(p0 / all0))
                        if gain > most:
                            best, most = c, gain
        if best is None:
            break
        rule += (best,)
        inside &= best.holds(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The beginning of the rule that is worth most on rows not grown on; the shorter at a tie."""
    worth = []
    for k in range(1, len(rule) + 1):
        hit = _covers(rule[:k], x)
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        worth.append((p - n) / max(p + n, 1))
    return rule[: int(np.argmax(worth)) + 1] if worth else ()


def learn_rules(stats: dict[str, np.ndarray], bad: np.ndarray, part: np.ndarray) -> list[Rule]:
    """Ordered rules that reject. ``part`` (0, 1 or 2 by row) says which rows prune: those of 0.

    A rule that isn't precise enough on either part is given up, and the next one
    begins with another feature or direction, until none is left to begin with.
    """
    x = feature_arrays(stats)
    grows = part != 0
    rules: list[Rule] = []
    barred: frozenset = frozenset()
    left = np.ones(len(bad), bool)
    while len(rules) < MAX_RULES and (left & grows & bad).sum() >= 3:
        on = left & grows
        grown = _grow({k: v[on] for k, v in x.items()}, bad[on], barred)
        on = left & ~grows
        rule = _prune(grown, {k: v[on] for k, v in x.items()}, bad[on])
        if not rule:
            break
        hit = _covers(rule, x) & left
        if any((rows & bad).sum() < max(MIN_SUPPORT, MIN_PRECISION * rows.sum()) for rows in (hit & ~grows, hit & grows)):
            barred |= {(grown[0].feature, grown[0].above)}
            continue
        rules.append(rule)
        left &= ~hit
        barred = frozenset()
    return rules


def rules_column(rules: list[Rule]) -> Column:
    """True where a rule rejects: the rules in their order, as one conditional expression."""
    out = F.lit(False)
    for rule in reversed(rules):
        test = F.lit(True)
        for c in rule:
            test = test & c.column()
        out = F.when(F.coalesce(test, F.lit(False)), F.lit(True)).otherwise(out)
    return out


def learn_from_labels(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Learns rules from at most ``max_labelled`` labelled documents, those of the smallest hash of their id."""
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("__good"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")
    # Of rows that share a doc_id the one of the smallest statistics is learned from, whatever their order.
    got = document_stats(rows, ["doc_id", "__good"]).groupBy("doc_id", "__good").agg(F.min(F.struct(*STATS)).alias("s")).select("doc_id", "__good", "s.*").orderBy("doc_id").toPandas()
    stats = {k: got[k].to_numpy() for k in STATS}
    bad = got["__good"].to_numpy() == 0
    failed = (stats["n_words"] < 20) | (100 * stats["n_repeat_words"] > 30 * stats["n_words"])
    on = ~failed  # the base check has the others
    part = mix(got["doc_id"].to_numpy().astype(np.uint64)) % np.uint64(3)
    return learn_rules({k: v[on] for k, v in stats.items()}, bad[on], part[on].astype(int))


def judge(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The statistics with ``base_failed`` and ``kept`` for every row of ``docs``."""
    rules = learn_from_labels(docs, labels, max_labelled)
    out = document_stats(docs, keep).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & ~rules_column(rules))


def filter_documents(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs``, all columns, that the base check and the learned list keep."""
    keep = docs.columns
    names = [f"_{c}" if c in STATS or c in ("base_failed", "kept") else c for c in keep]
    source = docs.select(*[docs[c].alias(n) for c, n in zip(keep, names, strict=True)])
    rules = learn_from_labels(docs, labels, max_labelled)
    judged = document_stats(source, names, names[keep.index("text")]).where(~base_failed() & ~rules_column(rules))
    return judged.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)])
