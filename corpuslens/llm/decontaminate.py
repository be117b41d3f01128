"""Benchmark passages found through a distributed positional inverted index.

``build_index`` turns each block of documents into one row: its distinct terms,
sorted, with the positions of each (documents stand apart by a gap, so that no
phrase crosses them). The index is partitioned by documents, so building it needs
no shuffle and no term's list lands in one task; stored as a table it serves any
number of benchmarks. ``search`` looks up the terms of all benchmark windows,
drops the windows one of whose terms the block lacks, and takes the places of each
window's rarest term as anchors. Exact phrases are the anchors that remain when
the other terms' lists, moved by their offsets, are intersected in order of
rarity. With ``slop`` it also returns proximity matches: items of which a window
has all its terms, in any order, in a stretch of that many words; such a stretch
holds an anchor near which all other terms occur.

Terms are 64-bit hashes of words. Benchmark items are encoded on executors, in
pieces of bounded length which overlap by a window less one word; the pieces are
broadcast in portions of bounded size, each of which passes over the stored index.

Defined cases: null and empty texts have no words; items without words match
nothing; an item shorter than a window is one window; repeated items and rows
count each; one document of very many words is a block of its own; ties of rarity
go to the earlier word; empty tables give no rows or no hits; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, blocks, buffers, cut, words

WINDOW = 10
#: Words of a stretch in which all terms of a window make a proximity match.
SLOP = 15
#: Places between documents of a block; ``slop`` must be below.
GAP = 64
#: Words of a piece of an item, and words of all pieces that are broadcast at a time.
PIECE, PORTION = 1 << 18, 1 << 21

INDEX = "block string, doc_ids array<bigint>, n_words array<bigint>, terms binary, ends binary, places binary"
HITS = "doc_id bigint, n_words bigint, block string, row int, hits array<struct<item_id: string, start: bigint, end: bigint>>, near array<string>"


def build_index(docs: DataFrame) -> DataFrame:
    """One row per block of ``docs(doc_id, text)``: its positional inverted index."""

    def run(batches):
        part = TaskContext.get().partitionId()
        for k, b in enumerate(blocks(batches)):
            hashed, _, _, first = words(*buffers(b.column("text")), ALNUM, lower=True)
            n = np.diff(first)
            place = np.arange(len(hashed)) + np.repeat(np.arange(len(n)) * GAP, n)
            order = np.argsort(hashed, kind="stable")
            terms = hashed[order]
            start = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1]))) if len(terms) else np.zeros(0, np.int64)
            ends = np.append(start[1:], len(terms)) if len(terms) else start
            whole = lambda x: pa.array([x], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([f"{part}-{k}"]), whole(b.column("doc_id")), whole(n), *(pa.array([x.tobytes()], pa.binary()) for x in (terms[start], ends.astype(np.uint32), place[order].astype(np.uint32)))], ["block", "doc_ids", "n_words", "terms", "ends", "places"])

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, INDEX)


def encode_items(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(item_id, piece, terms)``: the hashed words of each item, long ones in overlapping pieces; every window is in one of them."""
    rows = benchmark.select(benchmark["item_id"].cast("string").alias("item_id"), benchmark["text"].alias("text"))

    def run(batches):
        for b in blocks(batches):
            hashed, _, _, first = words(*buffers(b.column("text")), ALNUM, lower=True)
            for item, a, z in zip(b.column("item_id").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                for k, at in enumerate(range(a, max(z - window + 1, a + 1) if z > a else a, PIECE)):
                    piece = hashed[at : min(z, at + PIECE + window - 1)]
                    yield pa.RecordBatch.from_arrays([pa.array([item], pa.string()), pa.array([k], pa.int32()), pa.array([piece.tobytes()], pa.binary())], ["item_id", "piece", "terms"])

    return rows.mapInArrow(run, "item_id string, piece int, terms binary")


@dataclass
class Queries:
    """Windows of some benchmark items: all pieces one after another as numbers of terms, and where windows of each length begin."""

    items: list[str]
    terms: np.ndarray
    sequence: np.ndarray
    starts: dict[int, tuple[np.ndarray, np.ndarray]]  # length: (places in the sequence, items)


def prepare(pieces: list[tuple[str, bytes]], window: int) -> Queries:
    each = [np.frombuffer(t, np.uint64) for _, t in pieces]
    n = np.array([len(x) for x in each], np.int64)
    terms, sequence = np.unique(np.concatenate([np.zeros(0, np.uint64), *each]), return_inverse=True)
    first = np.cumsum(n) - n
    length = np.minimum(n, window)
    many = np.where(n > 0, n - length + 1, 0)
    starts = {}
    for size in np.unique(length[length > 0]).tolist():
        some = np.flatnonzero(length == size)
        item = np.repeat(some, many[some])
        starts[size] = (np.repeat(first[some] - (np.cumsum(many[some]) - many[some]), many[some]) + np.arange(len(item)), item)
    return Queries([i for i, _ in pieces], terms, sequence.astype(np.int32), starts)


def _covers(places: list[np.ndarray], slop: int) -> bool:
    """Whether some stretch of ``slop`` words holds a place of each list."""
    events = sorted((int(p), k) for k, x in enumerate(places) for p in x)
    last = dict.fromkeys(range(len(places)), -(slop + 1))
    for p, k in events:
        last[k] = p
        if p - min(last.values()) < slop:
            return True
    return False


def _phrases(q: Queries, terms: np.ndarray, ends: np.ndarray, places: np.ndarray, slop: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Exact matches (item, first place, length) and near ones (item, a place in the document)."""
    exact, near = [np.zeros((0, 3), np.int64)], [np.zeros((0, 2), np.int64)]
    if not len(terms) or not len(q.terms):
        return exact[0], near[0]
    at = np.minimum(np.searchsorted(terms, q.terms), len(terms) - 1)
    known = terms[at] == q.terms
    stop = np.where(known, ends[at], 0)
    start = np.where(known & (at > 0), ends[at - 1], 0)
    count = stop - start
    # A term's number in the block and a place make one key; keys ascend like the lists do.
    base = np.int64(1) << 33
    keys = np.repeat(np.arange(len(terms), dtype=np.int64), np.diff(ends, prepend=0)) * base + places
    own = at * base
    for length, (begins, owner) in q.starts.items():
        here = np.ones(len(begins), bool)
        for j in range(length):
            here[here] = count[q.sequence[begins[here] + j]] > 0
        begins, owner = begins[here], owner[here]
        if not len(begins):
            continue
        windows = q.sequence[begins[:, None] + np.arange(length)]
        order = np.argsort(count[windows], axis=1, kind="stable")
        rarest = windows[np.arange(len(windows)), order[:, 0]]
        many = count[rarest]
        w = np.repeat(np.arange(len(windows)), many)
        anchor = places[np.repeat(start[rarest] - (np.cumsum(many) - many), many) + np.arange(len(w))]
        found, begin = w, anchor - order[w, 0]
        for j in range(1, length):  # offset-adjusted lists, the rarest first
            offset = order[found, j]
            key = own[windows[found, offset]] + begin + offset
            same = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key
            found, begin = found[same], begin[same]
        exact.append(np.stack([owner[found], begin, np.full(len(found), length)], axis=1))
        if slop is not None and slop >= length:
            near.append(np.stack([owner[found], begin], axis=1))
            for j in range(1, length):
                low = own[windows[w, order[w, j]]] + np.maximum(anchor - slop + 1, 0)
                next_key = keys[np.minimum(np.searchsorted(keys, low), len(keys) - 1)]
                close = (next_key >= low) & (next_key <= own[windows[w, order[w, j]]] + anchor + slop - 1)
                w, anchor = w[close], anchor[close]
            for i, a in zip(w.tolist(), anchor.tolist(), strict=True):
                lists = []
                for t in np.unique(windows[i]):
                    span = np.searchsorted(keys, [own[t] + max(a - slop + 1, 0), own[t] + a + slop])
                    lists.append(places[span[0] : span[1]])
                if _covers(lists, slop):
                    near.append(np.array([[owner[i], a]]))
    return np.concatenate(exact), np.concatenate(near)


def _search_block(q: Queries, row: dict, slop: int | None) -> pa.RecordBatch:
    terms = np.frombuffer(row["terms"], np.uint64)
    ends, places = (np.frombuffer(row[c], np.uint32).astype(np.int64) for c in ("ends", "places"))
    n = np.array(row["n_words"], np.int64)
    base = np.concatenate(([0], np.cumsum(n)[:-1])) + np.arange(len(n)) * GAP if len(n) else np.zeros(0, np.int64)
    exact, near = _phrases(q, terms, ends, places, slop)
    doc = np.searchsorted(base + n, exact[:, 1], "right")  # the first document that ends beyond
    order = np.lexsort((exact[:, 1], exact[:, 0], doc))
    doc, (item, start, length) = doc[order], exact[order].T
    new = np.ones(len(doc), bool)  # occurrences of one item that touch make one span
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (start[1:] > start[:-1] + length[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc))[: len(first)] - 1
    names = np.array(q.items, object)
    bounds = lambda docs_of: pa.array(np.searchsorted(docs_of, np.arange(len(n) + 1)), pa.int32())
    text, number = pa.string(), pa.int64()
    spans = [pa.array(names[item[first]], text), pa.array(start[first] - base[doc[first]], number), pa.array(start[last] + length[last] - base[doc[first]], number)]
    hits = pa.ListArray.from_arrays(bounds(doc[first]), pa.StructArray.from_arrays(spans, fields=[pa.field("item_id", text), pa.field("start", number), pa.field("end", number)]))
    pairs = np.unique(np.stack([np.searchsorted(base + n, near[:, 1], "right"), near[:, 0]], axis=1), axis=0)
    nears = pa.ListArray.from_arrays(bounds(pairs[:, 0]), pa.array(names[pairs[:, 1]], text))
    return pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], number), pa.array(n), pa.array([row["block"]] * len(n), text), pa.array(np.arange(len(n)), pa.int32()), hits, nears], ["doc_id", "n_words", "block", "row", "hits", "near"])


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """Per document of the stored index: doc_id, n_words, ``hits`` (spans of words in occurrences of an item's windows) and ``near`` (items)."""
    if slop is not None and not window <= slop < GAP:
        raise ValueError(f"slop must be from {window} to {GAP - 1}")
    pieces = cut(encode_items(benchmark, window))
    portions = -(-(pieces.agg(F.sum(F.octet_length("terms"))).first()[0] or 1) // (8 * PORTION))
    found = []
    for p in range(portions):
        some = pieces.where(F.pmod(F.xxhash64("item_id", "piece"), F.lit(portions)) == p) if portions > 1 else pieces
        some = some.select("item_id", "terms").orderBy("item_id", "piece").toArrow()
        q = index.sparkSession.sparkContext.broadcast(prepare(list(zip(some["item_id"].to_pylist(), some["terms"].to_pylist(), strict=True)), window))

        def run(batches, q=q):
            for b in batches:
                for row in b.to_pylist():
                    yield _search_block(q.value, row, slop)

        found.append(index.mapInArrow(run, HITS))
    if len(found) == 1:
        return found[0]
    merged = found[0]
    for x in found[1:]:
        merged = merged.unionByName(x)
    return merged.groupBy("block", "row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("near")).alias("near")).select("doc_id", "n_words", "block", "row", "hits", "near")


def covered(hits: F.Column | str = "hits"):
    """How many words lie in any of the spans."""
    spans = F.array_sort(F.transform(hits, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"))))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("to"))
    step = lambda acc, h: F.struct((acc["n"] + F.greatest(h["end"] - F.greatest(h["start"], acc["to"]), F.lit(0))).alias("n"), F.greatest(acc["to"], h["end"]).alias("to"))
    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, items (ids, sorted as strings), contaminated, and near_items, likewise, found with ``slop``."""
    found = search(cut(build_index(docs)), benchmark, window, slop)
    items = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"])))
    return found.select("doc_id", "n_words", covered("hits").alias("n_hit"), items.alias("items"), (F.size("hits") > 0).alias("contaminated"), F.array_sort(F.array_distinct("near")).alias("near_items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns, whose doc_id no document has that holds a window of an item word for word.

    Rows without a doc_id are judged by their text alone.
    """
    named = docs.where(docs["doc_id"].isNotNull())
    gone = cut(contamination(named, benchmark, window).where("contaminated").select(F.col("doc_id").alias("__gone")).distinct())
    kept = named.join(gone, named["doc_id"] == F.col("__gone"), "left_anti")
    unnamed = docs.where(docs["doc_id"].isNull())
    texts = unnamed.select(F.xxhash64("text").alias("doc_id"), "text")
    gone = contamination(texts, benchmark, window).where("contaminated").select(F.col("doc_id").alias("__gone")).distinct()
    return kept.union(unnamed.join(gone, F.xxhash64(unnamed["text"]) == F.col("__gone"), "left_anti"))
