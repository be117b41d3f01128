"""Phrase collocations per language, by generalised suffix automata of bounded depth.

Texts are cut into shards of at most ``SHARD`` words. Over each shard's pieces an
automaton is built: its states are the sets of phrases (up to four words) that
end at the same places, each with the size of that set, its longest and shortest
phrase and the link to the state of the next shorter suffix. Every phrase with
its count is read off the states, and counts are summed over all shards.

No phrase is more frequent than a word or a pair of words in it, and none is more
frequent than all phrases whose hash is the same, so four passes go over the texts.
The first three count hashes: of words, of pairs, of phrases of three and four words.
The last counts the phrases whose hashes are frequent. Words and pairs of rare hashes
end a run, as the end of a piece does. A hash is a few bytes in a shuffle where a
phrase is many: a shard's counts go out as arrays, one for each range of hashes, and
are summed range by range. Which hashes are frequent is told to the shards as a bitmap
of fixed size (``BITS``); hashes that meet in a bucket or a bit only let more phrases
through to the exact counts.

A phrase is dropped if a longer candidate holds it and is nearly as frequent. A
longer candidate's parts are at least as frequent as it is, so only candidates of
one word more need to be looked at: those whose link (without their first word)
or whose prefix (without their last word) is the phrase.

Defined cases: a null text has no words; a null language is ``und``; repeated rows
count each time; empty texts, an empty table or a language without a frequent
phrase give no rows; a text of any length is cut into shards between words, each
looking back three words; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, at_most, blocks, buffers, lookup, mix, stored, words

PIECE_ENDS = lookup(b".,;:!?\n\x0b\x0c\r")
IN_WORD = lookup(b" \t.,;:!?\n\x0b\x0c\r", inside=False)
LEAST_COUNT, DEPTH, SHOWN = 30, 4, 2000
#: Words of a shard, and bytes of text read at a time.
SHARD, BLOCK = 1 << 18, 2 << 20
#: Hashes that are told apart when counted, and bits of a bitmap of frequent ones; 16 MB whatever the corpus.
BUCKETS, BITS = 1 << 36, 1 << 27
#: Ranges that buckets are summed in, of RANGE buckets each.
RANGES = 1 << 9
RANGE = BUCKETS // RANGES
#: No more counts (about 50 bytes each) than this are broadcast.
FEW_COUNTS = 200_000
#: Parts that phrases of one language are dealt to.
SALTS = 32
#: A count of a phrase (of no word: all words of the language).
COUNTS = "lang string, phrase string, cnt bigint"
#: Counts of one shard's hashes in a range, as arrays of unsigned 32-bit integers.
PACKED = "part int, buckets binary, counts binary"
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def _coded(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each distinct key occurs first, the number of each key among them), by a hash table instead of sorting."""
    coded = pa.array(keys).dictionary_encode()
    inverse = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.empty(len(coded.dictionary), np.int64)
    first[inverse[::-1]] = np.arange(len(keys) - 1, -1, -1)
    return first, inverse


class Automaton:
    """The suffix automaton of runs of words, bounded to phrases of ``depth`` words.

    ``ids`` are words, ``runs`` tells runs apart (never decreasing); phrases count
    at the places from ``begin`` on at which they end. States have ``count`` (how
    many places), ``longest`` and ``shortest`` (phrase lengths), ``end`` (one such
    place) and ``link`` (the state of the longest suffix with more places, or -1).
    """

    def __init__(self, ids: np.ndarray, runs: np.ndarray, begin: int, depth: int):
        n = len(ids)
        width = np.int64(ids.max(initial=0) + 1)
        name, levels = ids, []  # name[e]: the phrase of the current length that ends at e
        for m in range(1, depth + 1):
            ends = np.flatnonzero(runs[m - 1 :] == runs[: n - m + 1]) + (m - 1) if n >= m else np.zeros(0, np.int64)
            key = ids[ends] if m == 1 else name[ends - 1] * width + ids[ends]
            first, inverse = _coded(key)
            count = np.bincount(inverse[ends >= begin], minlength=len(first))
            suffix = name[ends[first]] if m > 1 else np.zeros(len(first), np.int64)
            levels.append((ends[first], count, suffix))
            name = np.full(n, -1, np.int64)
            name[ends] = inverse
        parts, pending, made = [], None, 0
        taken = np.full(len(levels[-1][0]), -1, np.int64)
        for m in range(depth, 0, -1):
            end, count, suffix = levels[m - 1]
            fresh = (taken < 0) & (count > 0)
            state = taken.copy()
            state[fresh] = made + np.arange(fresh.sum())
            made += int(fresh.sum())
            parts.append([np.flatnonzero(fresh), end, count, np.full(len(end), m), state])
            if pending is not None:
                pending[1][:] = state[pending[1]]
                parts[-2].append(pending)
            if m > 1:
                live = state >= 0
                shorter = levels[m - 2][1]
                same = live & (count == shorter[suffix])
                taken = np.full(len(shorter), -1, np.int64)
                taken[suffix[same]] = state[same]
                pending = (state[live & ~same], suffix[live & ~same].copy())
        self.count, self.longest, self.end = (np.concatenate([p[k][p[0]] for p in parts]) if parts else np.zeros(0, np.int64) for k in (2, 3, 1))
        self.shortest, self.link = self.longest.copy(), np.full(made, -1, np.int64)
        for p in parts:  # from the longest phrases down, so that a state's shortest stays
            live = p[4] >= 0
            self.shortest[p[4][live]] = p[3][live]
            if len(p) > 5:
                self.link[p[5][0]] = p[5][1]

    def phrases(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(an end, count) of every phrase of ``length`` words."""
        has = (self.shortest <= length) & (self.longest >= length)
        return self.end[has], self.count[has]


def _languages(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(code of each text, languages, a hash of each)."""
    coded = column.cast(pa.string()).dictionary_encode()
    names = coded.dictionary
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), names, np.array([zlib.crc32(x.encode()) for x in names.to_pylist()], np.uint64)


def _has(bits: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    at = buckets % BITS
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


class _Shard:
    """Words a..b of a block of texts, with up to ``back`` words before them."""

    def __init__(self, low: np.ndarray, found: tuple, text_of: np.ndarray, pieces: np.ndarray, langs: tuple, a: int, b: int, back: int):
        hashed, starts, ends, _ = found
        self.begin = min(a, back)
        a -= self.begin
        part = low[starts[a] : ends[b - 1]]
        body = part[IN_WORD[part]]
        offsets = np.concatenate(([0], np.cumsum(ends[a:b] - starts[a:b]))).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_string(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(body)]).dictionary_encode()
        codes, names, of_lang = langs
        lang = codes[text_of[a:b]]
        key = lang * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False)
        first, self.ids = _coded(key)
        unique = key[first]
        self.words = coded.dictionary.take(pa.array(unique % len(coded.dictionary)))
        self.langs = names.take(pa.array(unique // len(coded.dictionary)))
        self.hashes, self.lang_hash = hashed[a:b][first], of_lang[lang[first]]
        self.pieces, self.first = pieces[a:b], first

    def buckets(self, ends: np.ndarray, length: int) -> np.ndarray:
        """Buckets of the phrases of ``length`` words that end at these places."""
        out = self.hashes[self.ids[ends - (length - 1)]]
        for k in range(length - 2, -1, -1):
            out = mix(out * _PAIR + np.uint64(1)) ^ self.hashes[self.ids[ends - k]]
        return (mix(out + mix(self.lang_hash[self.ids[ends]] + np.uint64(length))) % np.uint64(BUCKETS)).astype(np.int64)

    def runs(self, frequent_words: np.ndarray | None, frequent_pairs: np.ndarray | None) -> np.ndarray:
        """Numbers of the runs that words are in: pieces, cut at words and between pairs of rare hashes."""
        cut = np.diff(self.pieces, prepend=self.pieces[:1] - 1) != 0
        if frequent_words is not None:
            rare = ~_has(frequent_words, self.buckets(self.first, 1))[self.ids]
            cut |= rare
            cut[1:] |= rare[:-1]
        if frequent_pairs is not None and len(cut) > 1:
            cut[1:] |= ~_has(frequent_pairs, self.buckets(np.arange(1, len(cut)), 2))
        return np.cumsum(cut)

    def rows(self, ends: np.ndarray, count: np.ndarray, length: int) -> pa.RecordBatch:
        parts = [self.words.take(pa.array(self.ids[ends - k])) for k in range(length - 1, -1, -1)]
        phrase = parts[0] if length == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))
        return _batch(self.langs.take(pa.array(self.ids[ends])), phrase.cast(pa.string()), count)


def _batch(lang, phrase, count) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, phrase, pa.array(count, pa.int64())], ["lang", "phrase", "cnt"])


def _packed(buckets: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """PACKED rows of the ranges that buckets are in."""
    order = np.argsort(buckets)
    part, low = buckets[order] // RANGE, buckets[order] % RANGE
    ends = np.searchsorted(part, np.arange(RANGES + 1))
    some = np.flatnonzero(np.diff(ends))
    offsets = pa.py_buffer((np.append(ends[some], len(order)) * 4).astype(np.int32))
    arrays = [pa.Array.from_buffers(pa.binary(), len(some), [None, offsets, pa.py_buffer(x.astype(np.uint32))]) for x in (low, count[order])]
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *arrays], ["part", "buckets", "counts"])


def shards(batches: Iterator[pa.RecordBatch], back: int) -> Iterator[_Shard]:
    for block in blocks(batches, most=BLOCK):
        data, offsets = buffers(block.column("text"))
        low = LOWER[data]
        found = words(low, offsets, IN_WORD)
        starts, first = found[1], found[3]
        text_of = np.repeat(np.arange(block.num_rows), np.diff(first))
        pieces = np.searchsorted(np.flatnonzero(PIECE_ENDS[low]), starts) + text_of
        langs = _languages(block.column("lang"))
        for a in range(0, len(starts), SHARD):
            yield _Shard(low, found, text_of, pieces, langs, a, min(len(starts), a + SHARD), back)


def _frequent(docs: DataFrame, lengths: tuple[int, ...], frequent: dict, least: int) -> DataFrame:
    """``(bucket)``: buckets that phrases of these lengths fall in ``least`` times.

    ``frequent`` has broadcast bitmaps by length, of which the shorter ones say where runs end.
    """
    depth = max(lengths)

    def run(batches):
        known = {k: v.value for k, v in frequent.items()}
        for shard in shards(batches, depth - 1):
            automaton = Automaton(shard.ids, shard.runs(known.get(1), known.get(2)), shard.begin, depth)
            found = [(shard.buckets(ends, length), count) for length in lengths for ends, count in [automaton.phrases(length)]]
            yield _packed(np.concatenate([x for x, _ in found]), np.concatenate([n for _, n in found]))

    def sums(rows: pa.Table) -> pa.Table:
        column = lambda name: np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in rows.column(name)])
        low, count = column("buckets"), column("counts")
        order = np.argsort(low, kind="stable")
        low = low[order]
        first = np.flatnonzero(np.diff(low.astype(np.int64), prepend=-1))
        often = np.add.reduceat(count[order].astype(np.int64), first) >= least
        return pa.table({"bucket": low[first][often].astype(np.int64) + RANGE * rows.column("part")[0].as_py()})

    return docs.mapInArrow(run, PACKED).groupBy("part").applyInArrow(sums, "bucket bigint")


def _phrases(docs: DataFrame, frequent: dict, least: int) -> DataFrame:
    """Counts of phrases of one to DEPTH words whose buckets are frequent and that occur ``least`` times, and of all words of each language.

    ``frequent`` has broadcast bitmaps by length (3 is for phrases of three and four words).
    """

    def run(batches):
        known = {k: v.value for k, v in frequent.items()}
        for shard in shards(batches, DEPTH - 1):
            own = shard.langs.take(pa.array(shard.ids[shard.begin :])).value_counts()
            yield _batch(own.field("values"), pa.array([""] * len(own), pa.string()), own.field("counts").to_numpy())
            automaton = Automaton(shard.ids, shard.runs(known[1], known[2]), shard.begin, DEPTH)
            for length in range(1, DEPTH + 1):
                ends, count = automaton.phrases(length)
                if length != 2:  # runs hold no other pairs
                    some = _has(known[min(length, 3)], shard.buckets(ends, length))
                    ends, count = ends[some], count[some]
                yield shard.rows(ends, count, length)

    return docs.mapInArrow(run, COUNTS).groupBy("lang", "phrase").agg(F.sum("cnt").alias("cnt")).where((F.col("cnt") >= least) | (F.col("phrase") == ""))


def _bitmap(found: DataFrame):
    """A broadcast bitmap of the buckets that were ``found``; no more than BITS bits come to the driver."""
    at = F.col("bucket") % BITS + 1
    parts = found.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    bits = np.zeros(BITS // 8, np.uint8)
    for r in parts.toLocalIterator():
        part = np.frombuffer(r.bits, np.uint8)
        bits[(r.part - 1) * 4096 :][: len(part)] = part
    return found.sparkSession.sparkContext.broadcast(bits)


def phrase_counts(docs: DataFrame, least: int = LEAST_COUNT) -> tuple[DataFrame, DataFrame]:
    """((lang, n): words of each language; (lang, phrase, cnt) of all phrases of one to four words that occur ``least`` times).

    Takes ``docs(lang, text)``.
    """
    docs = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), docs["text"].alias("text")).where("text IS NOT NULL")
    frequent = {}
    for level, lengths in ((1, (1,)), (2, (2,)), (3, (3, 4))):
        frequent = frequent | {level: _bitmap(stored(_frequent(docs, lengths, frequent, least)))}
    counted = stored(_phrases(docs, frequent, least))
    return counted.where("phrase = ''").select("lang", F.col("cnt").alias("n")), counted.where("phrase <> ''")


def _words(phrase: Column | str) -> Column:
    return F.split(phrase, " ", -1)


def _scored(candidates: DataFrame, counts: DataFrame, least: int) -> DataFrame:
    """``candidates(lang, phrase, a)`` with ``l``, ``r`` and ``score`` of the cut that scores lowest, the first of such."""
    w = F.col("w")
    sides = lambda k: F.array(F.struct(k.alias("k"), F.lit(0).alias("side"), F.array_join(F.slice(w, F.lit(1), k), " ").alias("part")), F.struct(k.alias("k"), F.lit(1).alias("side"), F.array_join(F.slice(w, k + 1, F.size(w) - k), " ").alias("part")))
    rows = candidates.withColumn("w", _words("phrase"))
    rows = rows.select("lang", "phrase", "a", F.inline(F.flatten(F.transform(F.sequence(F.lit(1), F.size(w) - 1), sides))))
    known = counts.select("lang", F.col("phrase").alias("part"), "cnt")
    # Of a part that occurs so often there may be as many candidates as a thirtieth; the most frequent parts are broadcast.
    bar = max(least, 1)
    while not at_most(often := known.where(F.col("cnt") >= bar), FEW_COUNTS):
        bar *= 2
    rows = rows.join(F.broadcast(often.withColumnRenamed("cnt", "__often")), ["lang", "part"], "left")
    rows = rows.join(known.where(F.col("cnt") < bar), ["lang", "part"], "left").withColumn("cnt", F.coalesce("__often", "cnt")) if bar > least else rows.withColumnRenamed("__often", "cnt")
    cuts = rows.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("cnt"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("cnt"))).alias("r"))
    wide = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    cuts = cuts.withColumn("score", F.expr(f"CAST({wide('2000000')} * {wide('a')} div ({wide('l')} + {wide('r')}) AS BIGINT)"))
    return cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, least: int = LEAST_COUNT, subsumed_percent: int = 80, shown: int = SHOWN) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's first ``shown`` phrases of two to four words by score.

    a is the phrase's count, l and r are those of its two parts, n is the number of
    words of the language. score = floor(2000000 * a / (l + r)).
    """
    totals, counts = phrase_counts(docs, least)
    candidates = counts.where(F.contains("phrase", F.lit(" "))).select("lang", "phrase", F.col("cnt").alias("a"))
    n = F.size("w")
    ends = F.array(F.array_join(F.slice("w", F.lit(2), n - 1), " "), F.array_join(F.slice("w", F.lit(1), n - 1), " "))
    holders = candidates.withColumn("w", _words("phrase")).where(n > 2).select("lang", F.explode(ends).alias("phrase"), "a")
    holders = holders.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    wide = lambda c, times: F.col(c).cast("decimal(19,0)") * times
    left = candidates.join(holders, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (wide("longer", 100) < wide("a", subsumed_percent))).drop("longer")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First within parts of a language, so that the last step sees no more than SALTS times what is shown.
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    first = _scored(left, counts, least).withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= shown)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= shown)
    # Candidates of a language stand in as many rows as are shown, so the few totals join them without skew.
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
