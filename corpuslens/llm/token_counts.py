"""Token counts without a shuffle of pre-tokens.

Texts are cut into pre-tokens as the tokenizer does, but for whole blocks at once:
each code point's class comes from a table, pre-tokens are runs of a class, and
each gets a 64-bit hash. Tier 1 is a broadcast hash table from frequent pre-tokens
to their number of tokens, a few bytes an entry; it is learned in a map-side pass
over a bounded sample (partial lists of the most frequent ones of some partitions,
merged). Tier 2 is a cache in each Python worker: pre-tokens that tier 1 lacks are
encoded by the tokenizer when a worker first meets them, and kept by hash.

Results don't depend on what the sample or the caches hold.

Defined cases: null and empty texts have 0 bytes and 0 tokens; rows that repeat
are counted each; a very long text is handled in slices; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import blocks, buffers, mix, power

#: Fixed value: how byte-level BPE vocabularies split text before merging.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The pattern's endings after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Entries of tier 1, and of the list that a sampled partition hands in.
FREQUENT, LISTED = 1 << 17, 1 << 15
#: The sample: so many partitions, and so many bytes of text of each.
SAMPLE_PARTITIONS, SAMPLE_BYTES = 8, 2 << 20
#: Places of a worker's cache (a power of two; 12 bytes each); a pre-token takes the place of the one before it there.
CACHE = 1 << 20
#: Pre-tokens encoded, and characters of a text handled, at a time.
ENCODED, SLICE = 4096, 1 << 18

_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
_tables: list[np.ndarray] = []


def _code_points() -> tuple[np.ndarray, np.ndarray]:
    """Class and random value of every code point."""
    if not _tables:
        everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        kinds = np.full(0x110000, _OTHER, np.uint8)
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, everything):
                a, z = ord(everything[m.start()]), ord(everything[m.end() - 1])
                kinds[a : z + 1] = kind
        _tables.extend((kinds, mix(np.arange(0x110000, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))))
    return _tables[0], _tables[1]


def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def slices(text: str, most: int) -> Iterator[str]:
    """Cuts a long text before a space that stands between two characters that aren't white space."""
    at = 0
    while len(text) - at > most:
        end = text.find(" ", at + most)
        while 0 < end < len(text) - 1 and (text[end - 1].isspace() or text[end + 1].isspace()):
            end = text.find(" ", end + 1)
        if not 0 < end < len(text) - 1:
            break
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def pre_tokens(parts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """(all parts joined, where each pre-token starts in that, its hash, where each part's begin)."""
    kinds, values = _code_points()
    text = "".join(parts)
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(code)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    if not n:
        return text, np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(parts) + 1, np.int64)
    kind = kinds[code]
    starts = np.ones(n + 1, bool)  # where runs of a class start
    starts[1:n] = kind[1:] != kind[:-1]
    starts[bounds] = True
    first = np.flatnonzero(starts[:-1])  # of each run
    last = np.append(first[1:], n) - 1
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    # White space before something in the same text: its last character stands apart, a space joins what follows.
    white = (kind[first] == _SPACE) & ~edge[last + 1]
    starts[last[white]] = True
    blank = last[white & (code[last] == 32)]
    starts[blank + 1] = False
    # An apostrophe alone before a known ending takes it along.
    mark = first[(first == last) & (code[first] == 39) & starts[first] & ~edge[first + 1]]
    if len(mark):
        ahead = [np.where(mark + j < n, code[np.minimum(mark + j, n - 1)], 0) * ~np.any([edge[np.minimum(mark + i, n)] for i in range(1, j + 1)], axis=0) for j in (1, 2)]
        for ending in ENDINGS:
            fits = np.all([ahead[j] == ord(c) for j, c in enumerate(ending)], axis=0)
            starts[mark[fits] + 1] = False
            starts[mark[fits] + 1 + len(ending)] = True
    begin = np.flatnonzero(starts[:-1])
    end = np.append(begin[1:], n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values[code] * power("up", n), out=sums[1:])
    hashed = mix((sums[end] - sums[begin]) * power("down", n + 1)[begin] + (end - begin).astype(np.uint64))
    return text, begin, hashed, np.searchsorted(begin, bounds)


class Cutter:
    """Texts as parts between special strings, in slices."""

    def __init__(self, tokenizer):
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def parts(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(parts, the text of each, special strings in each text)."""
        found, parts, owner = np.zeros(len(texts), np.int64), [], []
        for i, text in enumerate(texts):
            segments = [text]
            for s in self.special:
                if s in text:
                    found[i] += sum(x.count(s) for x in segments)
                    segments = [y for x in segments for y in x.split(s)]
            for part in (p for x in segments if x for p in slices(x, SLICE)):
                parts.append(part)
                owner.append(i)
        return parts, np.array(owner, np.int64), found


def groups(parts: list[str], owner: np.ndarray) -> Iterator[tuple[list[str], np.ndarray]]:
    """Parts that together have about a slice's characters."""
    at, size = 0, 0
    for i, part in enumerate(parts):
        if size and size + len(part) > SLICE:
            yield parts[at:i], owner[at:i]
            at, size = i, 0
        size += len(part)
    if at < len(parts):
        yield parts[at:], owner[at:]


class Table:
    """Tier 1: hashes of pre-tokens, ascending, and their tokens."""

    def __init__(self, frequent: dict[str, int]):
        hashed = pre_tokens(list(frequent))[2] if frequent else np.zeros(0, np.uint64)
        order = np.argsort(hashed)
        self.hash, self.tokens = hashed[order], np.array(list(frequent.values()), np.uint16)[order]

    def find(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, whether listed)."""
        if not len(self.hash):
            return np.zeros(len(hashed), np.int64), np.zeros(len(hashed), bool)
        at = np.minimum(np.searchsorted(self.hash, hashed), len(self.hash) - 1)
        known = self.hash[at] == hashed
        return np.where(known, self.tokens[at], 0).astype(np.int64), known


class Worker:
    """The tokenizer and tier 2 of one worker."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.cutter = Cutter(self.tokenizer)
        self.cached, self.tokens = np.zeros(CACHE, np.uint64), np.zeros(CACHE, np.int32)

    def rare(self, text: str, begin: np.ndarray, end: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        """Tokens of pre-tokens by way of the cache."""
        some, at, back = np.unique(hashed, return_index=True, return_inverse=True)
        place = (some & np.uint64(len(self.cached) - 1)).astype(np.int64)
        out = np.where(self.cached[place] == some, self.tokens[place], -1)
        new = np.flatnonzero(out < 0)
        for k in range(0, len(new), ENCODED):
            few = new[k : k + ENCODED]
            pieces = [text[a:z] for a, z in zip(begin[at[few]].tolist(), end[at[few]].tolist(), strict=True)]
            out[few] = [len(e) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        self.cached[place[new]], self.tokens[place[new]] = some[new], out[new]
        return out[back].astype(np.int64)

    def count(self, texts: list[str], table: Table) -> np.ndarray:
        """Tokens of each text."""
        parts, owner, totals = self.cutter.parts(texts)
        for some, of in groups(parts, owner):
            text, begin, hashed, first = pre_tokens(some)
            tokens, known = table.find(hashed)
            miss = np.flatnonzero(~known)
            if len(miss):
                tokens[miss] = self.rare(text, begin[miss], np.append(begin[1:], len(text))[miss], hashed[miss])
            sums = np.concatenate(([0], np.cumsum(tokens)))
            np.add.at(totals, of, sums[first[1:]] - sums[first[:-1]])
        return totals


def frequent_pre_tokens(docs: DataFrame, path: str, text_column: str = "text") -> dict[str, int]:
    """The most frequent pre-tokens of a bounded sample of the texts, with their number of tokens."""
    listed, sample = LISTED, SAMPLE_BYTES

    def run(batches):
        seen, left = Counter(), sample
        cutter = worker_of(path).cutter
        for b in blocks(batches, "__text", 1 << 20):
            if left <= 0:  # the rest of the partition isn't needed
                continue
            left -= int(buffers(b.column("__text"))[1][-1])
            parts, owner, _ = cutter.parts(["" if t is None else t for t in b.column("__text").to_pylist()])
            for some, _ in groups(parts, owner):
                text, begin, hashed, _ = pre_tokens(some)
                end = np.append(begin[1:], len(text))
                _, at, n = np.unique(hashed, return_index=True, return_counts=True)
                for a, z, k in zip(begin[at].tolist(), end[at].tolist(), n.tolist(), strict=True):
                    seen[text[a:z]] += k
        top = [(t, n) for t, n in seen.most_common(listed) if len(t) <= 64]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["pre_token", "n"])

    lists = docs.select(docs[text_column].alias("__text")).mapInArrow(run, "pre_token string, n bigint").rdd
    parts = lists.getNumPartitions()
    chosen = sorted({k * parts // SAMPLE_PARTITIONS for k in range(SAMPLE_PARTITIONS)}) if parts else []
    total = Counter()
    for token, n in docs.sparkSession.sparkContext.runJob(lists, lambda rows: [(r[0], r[1]) for r in rows], chosen) if chosen else []:
        total[token] += n
    top = [t for t, _ in total.most_common(FREQUENT)]
    return dict(zip(top, map(len, load_tokenizer(path).encode_batch_fast(top, add_special_tokens=False)), strict=True))


_workers: dict[str, Worker] = {}


def worker_of(path: str) -> Worker:
    """This Python worker's own, for all its tasks.

    A function sent to a task takes along a copy of the data that it names outside
    itself: one that named ``_workers`` would find it empty in every task.
    """
    if path not in _workers:
        _workers[path] = Worker(path)
    return _workers[path]


def count_tokens(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``n_bytes`` (UTF-8) and ``n_tokens`` as the tokenizer at ``path`` gives them."""
    table = docs.sparkSession.sparkContext.broadcast(Table(frequent_pre_tokens(docs, path, text_column)))

    def run(batches):
        worker = worker_of(path)
        for b in blocks(batches, "__text"):
            texts = b.column("__text")
            n = worker.count(["" if t is None else t for t in texts.to_pylist()], table.value)
            yield pa.RecordBatch.from_arrays([b.column("__id"), pa.array(np.diff(buffers(texts)[1]), pa.int64()), pa.array(n, pa.int64())], ["__id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(docs[id_column].alias("__id"), docs[text_column].alias("__text"))
    return rows.mapInArrow(run, f"__id {kind}, n_bytes bigint, n_tokens bigint").withColumnRenamed("__id", id_column)
