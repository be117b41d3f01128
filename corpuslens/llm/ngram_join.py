"""Similarity join of documents on their sets of word n-grams.

Documents of equal sets form a class, represented by its smallest doc_id. The
classes' parity sketches (``parity_sketch``) are cut into parts, size band by
size band, and joined on equal parts. A key of few classes gives their pairs,
which a dense sketch sifts by its lower bound. A key of many is left out
wherever the sketches can do without it; classes that can't are put into a
cluster with the others of that key. Clusters of the remaining pairs are
verified block against block, where sizes allow links, each set sent once for
each such block, and linked classes are joined into components.

Defined cases: null or empty texts have empty sets and link with nothing; a
text of fewer words than an n-gram has one n-gram, all its words; rows of one
doc_id count as one document; a null doc_id links with nothing; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import parity_sketch as sketch
from .common import NOT_SPACE, at_most, blocks, buffers, cut, mix, shingles, words
from .components import components

#: A key of more classes is left out or clustered; of fewer, it gives pairs.
FREQUENT = 32
#: About so many members, and so many n-grams, make a block.
BLOCK_MEMBERS, BLOCK_TOKENS = 256, 1 << 20
#: Rows of a table that is small whatever the corpus: buckets of candidate ids.
BUCKETS = 1 << 18
#: One document of so many is looked at first for keys of very many classes; at most so many such keys are dealt out.
SAMPLED, MOST_HOT = 16, 100_000
#: Tasks that the classes of such a key are dealt to.
SALTS = 64

#: No more ids of documents that go, or share an id, than this are broadcast (about 50 bytes each).
FEW_MARKED = 500_000


def token_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct n-gram hashes of all texts one after another, where each text's begin)."""
    data, offsets = buffers(column)
    hashed, _, _, first = words(data, offsets, NOT_SPACE, lower=True)
    per_text = np.diff(first)
    owner = np.repeat(np.arange(len(per_text)), per_text)
    grams = shingles(hashed, k)
    inside = owner[: len(grams)] == owner[k - 1 :] if len(grams) else np.zeros(0, bool)
    grams, owner_of = grams[inside], owner[: len(grams)][inside]
    short = np.flatnonzero((per_text > 0) & (per_text < k))
    whole = np.array([mix(np.uint64(per_text[i]) + shingles(hashed[first[i] : first[i + 1]], int(per_text[i])))[0] for i in short], np.uint64)
    grams, owner_of = np.concatenate([grams, whole]), np.concatenate([owner_of, short])
    order = np.lexsort((grams, owner_of))
    grams, owner_of = grams[order], owner_of[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner_of[1:] != owner_of[:-1])
    grams, owner_of = grams[new], owner_of[new]
    return grams, np.searchsorted(owner_of, np.arange(len(per_text) + 1))


def _sketched(docs: DataFrame, k: int) -> DataFrame:
    """For each document: size and 128-bit identity of its set, and its dense sketch."""

    def run(batches):
        for b in blocks(batches):
            grams, first = token_sets(b.column("text"), k)
            dense = [sketch.bitmap(grams[a:z]) if z > a else b"" for a, z in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(first), pa.int64()), *_names(grams, first), pa.array(dense, pa.binary())], ["doc_id", "n", "f1", "f2", "dense"])

    return docs.mapInArrow(run, "doc_id bigint, n bigint, f1 bigint, f2 bigint, dense binary")


def _names(grams: np.ndarray, first: np.ndarray) -> list[pa.Array]:
    """Two 64-bit sums over each set, together its identity."""
    sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(grams + np.uint64(s)), dtype=np.uint64))) for s in (3, 5)]
    return [pa.array(mix(x[first[1:]] - x[first[:-1]]).astype(np.int64)) for x in sums]


def _keys(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """A row for each join key of each document: (id, key, spare)."""

    def run(batches):
        for b in blocks(batches):
            key, owner, spare = sketch.keys(*token_sets(b.column("text"), k), num, den)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(owner)), pa.array(key.astype(np.int64)), pa.array(spare)], ["id", "key", "spare"])

    return docs.mapInArrow(run, "id bigint, key bigint, spare bigint")


def _without_copies(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not in ``copies(copy)``; only those that share a bucket with one are moved."""
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS))
    some = F.broadcast(copies.select(bucket("copy").alias("__bucket")).distinct())
    rows = docs.where("doc_id IS NOT NULL").withColumn("__bucket", bucket("doc_id"))
    moved = rows.join(some, "__bucket", "left_semi").join(copies, F.col("doc_id") == F.col("copy"), "left_anti")
    return rows.join(some, "__bucket", "left_anti").union(moved).select("doc_id", "text")


def _hot_keys(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``(key)``: keys that are frequent among a part of the documents already, so among all; a table of bounded size."""
    part = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("hot")), F.lit(SAMPLED)) == 0)
    seen = cut(_keys(part, k, num, den).groupBy("key").agg(F.count_distinct("id").alias("n")).where(F.col("n") > FREQUENT))
    bar = FREQUENT
    while not at_most(hot := seen.where(F.col("n") > bar).select("key"), MOST_HOT):
        bar *= 8
    return hot


def _grouped(keys: DataFrame, hot: DataFrame) -> DataFrame:
    """Streams rows sorted by key: (false, a, b, 0) for pairs of a key of few classes, (true, key, id, spare) for each class of others.

    Of a key known to be ``hot`` each class stands for itself, so its classes are dealt to many tasks.
    """
    marked = keys.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "key", "left").select("key", "id", "spare", F.coalesce("hot", F.lit(False)).alias("hot"))
    marked = marked.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(F.lit(0)))

    def run(batches):
        left = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]
        frequent = None  # the key whose first classes are out already

        def out(kind, a, b, c):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind)), pa.array(a), pa.array(b), pa.array(c)], ["frequent", "a", "b", "spare"])

        def settle(key, ident, spare, known, last):
            nonlocal frequent, left
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
            run_of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key))))
            many = np.diff(np.append(start, len(key))) > FREQUENT
            many |= known[start]
            if len(start) and frequent is not None and key[0] == frequent:
                many[0] = True
            keep = 0
            if not last and len(start):
                if many[-1]:
                    frequent = key[-1]
                else:
                    keep = len(key) - start[-1]
            end = len(key) - keep
            left = [x[end:] for x in (key, ident, spare, known)]
            hot = np.flatnonzero(many[run_of[:end]]) if end else np.zeros(0, np.int64)
            if len(hot):
                yield out(True, key[hot], ident[hot], spare[hot])
            cold = ~many[run_of[:end]] if end else np.zeros(0, bool)
            for d in range(1, FREQUENT):
                i = np.flatnonzero(cold[:-d] & (run_of[: end - d] == run_of[d:end])) if end > d else []
                if not len(i):
                    break
                a, b = ident[i], ident[i + d]
                i = a != b
                yield out(False, np.minimum(a, b)[i], np.maximum(a, b)[i], np.zeros(int(i.sum()), np.int64))

        for b in batches:
            yield from settle(*(np.concatenate([x, b.column(c).to_numpy(zero_copy_only=False)]) for x, c in zip(left, ("key", "id", "spare", "hot"), strict=True)), False)
        yield from settle(*left, True)

    return marked.repartition("key", "salt").sortWithinPartitions("key", "id").drop("salt").mapInArrow(run, "frequent boolean, a bigint, b bigint, spare bigint")


def _sifted(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that sizes and dense sketches don't rule out."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("dense").alias(f"dense_{x}"))

    def run(batches):
        for t in batches:
            na, nb = t.column("n_a").to_numpy(), t.column("n_b").to_numpy()
            most = (na + nb) * (den - num) // (den + num)
            some = np.flatnonzero(np.minimum(na, nb) * den >= np.maximum(na, nb) * num)
            da, db = t.column("dense_a"), t.column("dense_b")
            some = [i for i in some if sketch.distance(da[i].as_py(), db[i].as_py()) <= most[i]]
            yield t.select(["a", "b"]).take(pa.array(some, pa.int64()))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "dense_a", "dense_b").mapInArrow(run, "a bigint, b bigint")


def _verify(ids: np.ndarray, sides: np.ndarray, weights: np.ndarray, sets: list[np.ndarray], num: int, den: int, across: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact links among sets: (ids with a link, a smaller id each is joined to, the weight of its partners)."""
    n = np.array([len(s) for s in sets])
    first = np.concatenate(([0], np.cumsum(n)))
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(int(token.max(initial=0)) + 1, np.int64)
    root = np.arange(len(ids))
    partners = np.zeros(len(ids), np.int64)

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(ids) - 1):
        mark[token[first[i] : first[i + 1]]] = 1
        rest = token[first[i + 1] :]
        common = np.add.reduceat(mark[rest], first[i + 1 : -1] - first[i + 1])
        mark[token[first[i] : first[i + 1]]] = 0
        other = n[i + 1 :]
        linked = den * common >= num * (n[i] + other - common)
        if across:  # two blocks meet: each was verified in itself elsewhere
            linked &= sides[i + 1 :] != sides[i]
        for j in np.flatnonzero(linked) + i + 1:
            partners[i] += weights[j]
            partners[j] += weights[i]
            x, y = find(i), find(j)
            if x != y:
                x, y = (x, y) if ids[x] <= ids[y] else (y, x)
                root[y] = x
    some = np.flatnonzero(partners)
    return ids[some], ids[[find(i) for i in some]] if len(some) else ids[some], partners[some]


def _links(members: DataFrame, num: int, den: int) -> DataFrame:
    """Verifies clusters. members: (cluster, id, weight, n, tokens). Returns (a, b, partners).

    A cluster is cut into bands of set sizes, so wide that similar sets are in one
    band or in two that are next to each other, and bands into blocks. Blocks of
    such bands meet; others can't have links.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(np.log(den / num * 1.001) if num < den else 1.0)).cast("int")
    members = members.withColumn("band", band)
    sizes = cut(members.groupBy("cluster", "band").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK_MEMBERS)), F.ceil(F.sum("n") / F.lit(BLOCK_TOKENS))).cast("int").alias("blocks")))
    of_next = lambda d, name: sizes.select("cluster", (F.col("band") - d).alias("band"), F.col("blocks").alias(name))
    known = sizes.join(of_next(1, "above"), ["cluster", "band"], "left").join(of_next(-1, "below"), ["cluster", "band"], "left")
    placed = members.join(known, ["cluster", "band"]).withColumn("block", F.pmod(F.xxhash64("id", "n"), F.col("blocks")).cast("int"))
    number = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    meeting = lambda low_band, low, high, side: F.struct(low_band.alias("low_band"), low.alias("low"), high.alias("high"), side.alias("side"))
    own, zero, one = F.col("block"), F.lit(0), F.lit(1)
    # Blocks of the band above are numbered from 1 << 24 on, so that they differ from those of the band itself.
    up = 1 << 24
    within = F.transform(number("blocks"), lambda o: meeting(F.col("band"), F.least(own, o), F.greatest(own, o), (own > o).cast("int")))
    above = F.transform(number("above"), lambda o: meeting(F.col("band"), own, o + up, zero))
    below = F.transform(number("below"), lambda o: meeting(F.col("band") - 1, o, own + up, one))
    sent = placed.select("cluster", "id", "weight", "tokens", F.inline(F.concat(within, above, below)))

    def run(batches):
        group, now = [], None
        for t in batches:
            for row in zip(*(t.column(c).to_pylist() for c in ("cluster", "low_band", "low", "high", "side", "id", "weight", "tokens")), strict=True):
                if row[:4] != now:
                    if len(group) > 1:
                        yield done(group, now)
                    group, now = [], row[:4]
                group.append(row[4:])
        if len(group) > 1:
            yield done(group, now)

    def done(group, key):
        side, ident, weight = (np.array([r[i] for r in group], np.int64) for i in range(3))
        found = _verify(ident, side, weight, [np.frombuffer(r[3], np.uint64) for r in group], num, den, key[2] != key[3])
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b", "partners"])

    keys = ["cluster", "low_band", "low", "high"]
    return sent.repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(run, "a bigint, b bigint, partners bigint")


def similar_documents(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, n_links.

    Links join documents whose sets of distinct ``k``-word n-grams have
    den * intersection >= num * union. component_id is the smallest doc_id
    reachable by links, n_links the number of other documents linked directly.
    """
    docs = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text"))
    base = cut(_sketched(docs, k))
    named = base.where("n > 0 AND doc_id IS NOT NULL")
    # A class is a set; the row of its smallest doc_id stands for it.
    of_class = named.groupBy("f1", "f2").agg(F.min("doc_id").alias("id"), F.count_distinct("doc_id").alias("weight"))
    standing = named.join(of_class.withColumnRenamed("id", "doc_id"), ["f1", "f2", "doc_id"]).withColumnRenamed("doc_id", "id")
    classes = cut(standing.select("id", "f1", "f2", "weight", "n", "dense").dropDuplicates(["f1", "f2"]))
    copies = cut(named.select(F.col("doc_id").alias("copy")).distinct().join(classes.select(F.col("id").alias("copy")), "copy", "left_anti"))
    # Keys are made from the texts again rather than stored: they are as large as the texts.
    single = _without_copies(docs, copies)
    grouped = cut(_grouped(_keys(single, k, num, den), _hot_keys(single, k, num, den)))
    slim = classes.select("id", "n", "dense")
    pairs = _sifted(grouped.where("NOT frequent").select("a", "b").distinct(), slim, num, den)
    # Frequent keys: classes that can't do without theirs.
    frequent = grouped.where("frequent").select(F.col("a").alias("key"), F.col("b").alias("id"), F.floor(F.col("spare") / sketch.SPARES).alias("context"), (F.col("spare") % sketch.SPARES).alias("spare"))
    needy = frequent.groupBy("id", "context").agg(F.count("*").alias("__n"), F.min("spare").alias("__spare")).where("__n > __spare").select("id", "context")
    needing = frequent.join(needy, ["id", "context"]).select("key", "id")
    hub = needing.groupBy("key").agg(F.min("id").alias("hub"))
    stars = needing.join(hub, "key").where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))
    cluster = cut(components(cut(pairs.union(stars))).select("id", F.col("component").alias("cluster")))
    # Only texts of clustered classes are read again: most others go by a table of fixed size.
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS))
    some = F.broadcast(cluster.select(F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).alias("__bucket")).distinct())
    again = docs.withColumn("__bucket", bucket).join(some, "__bucket", "left_semi").join(cluster.withColumnRenamed("id", "doc_id"), "doc_id")
    members = _sets(again, k).join(classes.select("id", "f1", "f2", "weight"), ["id", "f1", "f2"]).dropDuplicates(["id", "f1", "f2"])
    links = cut(_links(members.select("cluster", "id", "weight", "n", "tokens"), num, den))
    joined = components(links.where("a <> b")).withColumnRenamed("component", "__component")
    degree = links.groupBy(F.col("a").alias("id")).agg(F.sum("partners").alias("__partners"))
    final = of_class.join(joined, "id", "left").join(degree, "id", "left")
    final = final.select("f1", "f2", F.coalesce("__component", "id").alias("component_id"), (F.coalesce("__partners", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = base.select("doc_id", "n", "f1", "f2").join(final, ["f1", "f2"], "left")
    linked = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(linked, F.col("n_links")).otherwise(F.lit(0)).cast("bigint").alias("n_links"))


def _sets(rows: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for b in blocks(batches):
            grams, first = token_sets(b.column("text"), k)
            tokens = pa.array([grams[a:z].tobytes() for a, z in zip(first[:-1], first[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("cluster"), b.column("doc_id"), *_names(grams, first), pa.array(np.diff(first), pa.int64()), tokens], ["cluster", "id", "f1", "f2", "n", "tokens"])

    return rows.select("cluster", "doc_id", "text").mapInArrow(run, "cluster bigint, id bigint, f1 bigint, f2 bigint, n bigint, tokens binary")


def drop_similar(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, all columns, but of each component only its first document.

    Of rows that share the first doc_id, one of the smallest text stays. Rows
    without a doc_id all stay.
    """
    ids = similar_documents(docs, k, num, den).where("doc_id IS NOT NULL")
    marked = ids.groupBy(F.col("doc_id").alias("__id")).agg(F.bool_or(F.col("doc_id") != F.col("component_id")).alias("__gone"), (F.count("*") > 1).alias("__twice"))
    marked = cut(marked.where("__gone OR __twice"))
    if at_most(marked, FEW_MARKED):  # texts stay where they are
        marked = F.broadcast(marked)
    left = docs.join(marked, docs["doc_id"].cast("bigint") == F.col("__id"), "left").where("NOT coalesce(__gone, false)")
    row = F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)])
    left = left.select(F.col("__id"), F.coalesce("__twice", F.lit(False)).alias("__twice"), docs["text"].alias("__text"), row.alias("__row"))
    # Only rows that share an id are brought together.
    first = left.where("__twice").groupBy("__id").agg(F.min_by("__row", F.coalesce("__text", F.lit(""))).alias("__row"))
    every = left.where("NOT __twice").select("__row").unionByName(first.select("__row"))
    return every.select(*[F.col("__row").getField(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
