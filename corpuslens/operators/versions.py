"""What changed between two versions of documents, line by line.

Equal lines are found by hashes and aligned between anchors: lines that occur once
in both versions, the longest increasing run of them, and the same again between
two anchors, until nothing between anchors is common to both. Where no line is
unique, two, four or more in a row may be; if none are, the k-th copy of a line stands
for the k-th of the other version.

Defined cases: a null text has no lines, as a missing version; a last line feed ends
a line and begins none; an id that only one version has is all added or all removed;
rows that share an id within a version are compared each with each of the other.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import cross


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _longest_rise(places: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence."""
    tails, last, before = [], [], []
    for i, p in enumerate(places):
        k = bisect_left(tails, p)
        tails[k : k + 1] = [p]
        last[k : k + 1] = [i]
        before.append(last[k - 1] if k else -1)
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _anchors(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that stand once in both, in the order of the old: lines, or else as few lines in a row as it takes; without any, the k-th copies of lines."""
    a, b, width = old, new, 1
    while len(a) and len(b):
        once = []
        for x in (a, b):
            values, first, counts = np.unique(x, return_index=True, return_counts=True)
            once.append((values[counts == 1], first[counts == 1]))
        common, i, j = np.intersect1d(once[0][0], once[1][0], assume_unique=True, return_indices=True)
        if len(common):
            at, to = once[0][1][i], once[1][1][j]
            break
        a, b = (x[:-width] * _MIX + (x[width:] ^ (x[width:] >> np.uint64(29))) if len(x) > width else x[:0] for x in (a, b))
        width *= 2
    else:
        copies = []
        for x in (old, new):
            order = np.argsort(x, kind="stable")
            heads = np.flatnonzero(np.diff(x[order], prepend=~x[order[:1]]) != 0)
            copies.append((order, pd.MultiIndex.from_arrays([x[order], np.arange(len(x)) - np.repeat(heads, np.diff(np.append(heads, len(x))))])))
        found = copies[1][1].get_indexer(copies[0][1])
        at, to = copies[0][0][found >= 0], copies[1][0][found[found >= 0]]
    keep = old[at] == new[to]  # two hashes of several lines may be equal by chance
    order = np.argsort(at[keep])
    return at[keep][order], to[keep][order]


def align(old: np.ndarray, new: np.ndarray) -> list[tuple[int, int]]:
    """(place in the old, place in the new) of lines that stay; both rise."""
    old, new = old.astype(np.uint64), new.astype(np.uint64)
    kept, gaps = [], [(0, len(old), 0, len(new))]
    while gaps:
        a, b, c, d = gaps.pop()
        n = min(b - a, d - c)
        differs = np.flatnonzero(old[a : a + n] != new[c : c + n])
        same = int(differs[0]) if len(differs) else n
        kept += [(a + i, c + i) for i in range(same)]
        a, c, n = a + same, c + same, n - same
        differs = np.flatnonzero(old[b - n : b][::-1] != new[d - n : d][::-1])
        same = int(differs[0]) if len(differs) else n
        kept += [(b - 1 - i, d - 1 - i) for i in range(same)]
        b, d = b - same, d - same
        if a < b and c < d:
            at, to = _anchors(old[a:b], new[c:d])
            rise = _longest_rise(to.tolist())
            if rise:
                ends = [(a + int(at[i]), c + int(to[i])) for i in rise]
                kept += ends
                gaps += [(x + 1, y, u + 1, v) for (x, u), (y, v) in zip([(a - 1, c - 1), *ends], [*ends, (b, d)], strict=True)]
    return sorted(kept)


def _file_lines(text: Column) -> Column:
    parts = F.split(T.normalised(text), "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def version_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(doc_id, op, old_line, new_line, line)``: lines "removed" from and "added" to ``old(doc_id, text)`` in ``new(doc_id, text)``, numbered from 1 in their version."""

    @F.pandas_udf("array<struct<o: int, n: int>>")
    def aligned(before: pd.Series, after: pd.Series) -> pd.Series:
        as_pairs = lambda x, y: [{"o": i, "n": j} for i, j in align(np.asarray(x, np.int64), np.asarray(y, np.int64))]
        return pd.Series([as_pairs(x, y) for x, y in zip(before, after, strict=True)])

    both = old.select("doc_id", F.coalesce("text", F.lit("")).alias("__before")).join(new.select("doc_id", F.coalesce("text", F.lit("")).alias("__after")), "doc_id", "full")
    both = both.where(~F.col("__before").eqNullSafe(F.col("__after")))  # texts that stayed aren't split
    rows = both.select("doc_id", _file_lines(F.col("__before")).alias("__old"), _file_lines(F.col("__after")).alias("__new"))
    hashes = lambda c: F.transform(c, lambda x: F.xxhash64(x))
    rows = rows.withColumn("__kept", aligned(hashes("__old"), hashes("__new")))
    places = lambda c: F.when(F.size(c) > 0, F.sequence(F.lit(0), F.size(c) - 1)).otherwise(F.array().cast("array<int>"))
    rest = lambda c, name: F.array_except(places(c), F.transform("__kept", lambda k: k[name]))
    none = F.lit(None).cast("int")
    gone = F.transform(rest("__old", "o"), lambda i: F.struct(F.lit("removed").alias("op"), (i + 1).alias("old_line"), none.alias("new_line"), F.get("__old", i).alias("line")))
    come = F.transform(rest("__new", "n"), lambda i: F.struct(F.lit("added").alias("op"), none.alias("old_line"), (i + 1).alias("new_line"), F.get("__new", i).alias("line")))
    return rows.select("doc_id", F.inline(F.concat(gone, come)))


def version_sync(old: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(doc_set_id, doc_id, finding, kind, key)``: what companions keep of removed, or lack of added, versions and numbers.

    ``old(doc_id, text)`` are earlier versions of some documents of ``docs``, the main
    ones of their sets; the other documents of their sets are checked.
    """
    main = old.select("doc_id").distinct()
    changes = version_diff(old, docs.join(main, "doc_id", "left_semi")).join(sets.select("doc_id", "doc_set_id"), "doc_id")
    others = sets.join(main, "doc_id", "left_anti")
    return cross.check_signals(cross.signals_of(changes.select("doc_set_id", "op", "line")), docs, others)
