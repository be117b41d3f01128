"""Shared building blocks of the corpus operators.

Words are found and hashed straight in Arrow's byte buffers with numpy, a
bounded segment at a time, so no Python object is made per word.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes hashed at a time; bounds the temporary arrays however long a text is.
SEGMENT = 1 << 18

_ROOT = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20240229)
_BYTE_VALUE = _rng.integers(1, 2**64, size=256, dtype=np.uint64)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def lookup(chars: bytes, inside: bool = True) -> np.ndarray:
    """A table over the 256 byte values that is true for ``chars`` (or for all others)."""
    table = np.full(256, not inside)
    table[list(chars)] = inside
    return table


#: Bytes of words `[^\x20\x09-\x0D]+`.
NOT_SPACE = lookup(b" \t\n\x0b\x0c\r", inside=False)
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (after A-Z are lower-cased): digits, a-z, all beyond ASCII.
ALNUM = lookup(bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)))
#: Maps A-Z to a-z and leaves other bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _S30)) * _MIX_A
    x = (x ^ (x >> _S27)) * _MIX_B
    return x ^ (x >> _S31)


_powers: dict[str, np.ndarray] = {}


def power(kind: str, n: int) -> np.ndarray:
    """Powers 0..n-1 of the root ("up") or of its inverse modulo 2**64 ("down")."""
    if len(_powers.get(kind, ())) < n:
        base = _ROOT if kind == "up" else pow(_ROOT, -1, 2**64)
        out = np.full(max(n, SEGMENT + 1), base, dtype=np.uint64)
        out[0] = 1
        _powers[kind] = np.multiply.accumulate(out)
    return _powers[kind][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64, count=len(column) + 1, offset=column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def count_bytes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each text, how many of its bytes ``table`` marks."""
    out = np.zeros(len(offsets) - 1, np.int64)
    at = 0
    while at < len(data):  # the running sum stays within a segment's size
        end = min(len(data), at + 8 * SEGMENT)
        sums = np.concatenate(([0], np.cumsum(table[data[at:end]], dtype=np.int64)))
        bounds = np.clip(offsets, at, end) - at
        out += sums[bounds[1:]] - sums[bounds[:-1]]
        at = end
    return out


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = NOT_SPACE, lower: bool = False, hashes: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes marked by ``table`` in each text.

    Returns 64-bit hashes of the words, where each starts and ends in ``data``,
    and for each text where its words begin (one more entry than texts).
    ``lower`` folds A-Z. Without ``hashes`` the first array is empty.
    """
    empty = np.zeros(0, np.int64)
    all_hash, all_start, all_end = [np.zeros(0, np.uint64)], [empty], [empty]
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + SEGMENT)
        while end < n:  # cut between two words
            ahead = data[end - 1 : end - 1 + SEGMENT]
            gap = np.flatnonzero(~table[LOWER[ahead] if lower else ahead])
            if len(gap):
                end = end - 1 + int(gap[0]) + 1
                break
            end = min(n, end - 1 + len(ahead) + (0 if end - 1 + len(ahead) >= n else 1))
        part = data[at:end]
        if lower:
            part = LOWER[part]
        inside = table[part]
        first = np.zeros(len(part) + 1, bool)
        cuts = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end, "right")] - at
        first[cuts] = True
        before = np.empty(len(part), bool)
        before[0] = False
        before[1:] = inside[:-1]
        start = np.flatnonzero(inside & (~before | first[:-1]))
        after = np.empty(len(part), bool)
        after[-1] = False
        after[:-1] = inside[1:]
        stop = np.flatnonzero(inside & (~after | first[1:])) + 1
        if hashes and len(start):
            sums = np.empty(len(part) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(_BYTE_VALUE[part] * power("up", len(part)), out=sums[1:])
            all_hash.append(mix((sums[stop] - sums[start]) * power("down", len(part) + 1)[start]))
        all_start.append(start + at)
        all_end.append(stop + at)
        at = end
    starts = np.concatenate(all_start)
    return np.concatenate(all_hash), starts, np.concatenate(all_end), np.searchsorted(starts, offsets)


def shingles(hashed: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, at every place where one starts (crossing texts too)."""
    n = len(hashed) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashed[:n] + np.uint64(k)
    for j in range(1, k):
        out = out * _MIX_B + (out >> _S31)
        out = out ^ hashed[j : n + j]
    return mix(out)


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a block holds about ``most`` bytes of text, or one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = buffers(batch.column(column))[1][1:]
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; only where that is unset (tests), a temporary one."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the checkpoint folder, so that what follows survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Writes ``df`` to a table in the shared folder and reads it again, so that its true size is known.

    A checkpoint keeps the estimate of its plan, which joins multiply round by round.
    """
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has no more than ``rows`` rows; reads no more than needed to tell."""
    return df.limit(rows + 1).count() <= rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
