"""Clusters of integer vectors around centroids, with block-norm screening.

Vectors become integers (the floor of ``SCALE`` times each component) and are
kept as the bytes of the narrowest integer type that holds them, beside the norms
of their segments of ``SEGMENT_SIZE`` components, in a table in the shared folder.
For a vector x and a centroid c, the squared distance is the sum of those of their
segments, and by Cauchy and Schwarz a segment's is at least
``(|x_s| - |c_s|) ** 2``. Eight norms stand for 64 components so, and a centroid
gets an exact integer distance only where its bound doesn't exceed the best
distance known.

Each round reads that table once; a task returns one row of sums a centroid. Sums
and quotients are exact (decimals, then Python's integers). Only centroids, whose
number is a parameter, reach the driver.

Defined cases: vectors of another length, null ones and those with a null or
non-finite component are left out; integers beyond 2**27 in size are taken as
that, so that a squared distance fits a long; rows that share an id are vectors
of their own (as seeds ordered by their packed bytes); a null id is hashed as an
empty one; fewer vectors than centroids make fewer centroids; none give no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

DIMENSIONS, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64
SEGMENT_SIZE = 8
#: Distances between such vectors of 64 components are below 2**63.
LARGEST = 1 << 27
#: Vectors screened at a time, and up to which size of components floats count exactly.
BLOCK, EXACT = 8192, 1 << 22
#: Norms are kept as 32-bit floats; a bound is lessened by what that may add.
SLACK = 1e-6


def prepare(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """``(vec_id, packed, norms)`` of the vectors kept from ``vectors(vec_id, embedding)``."""
    x = F.col("x")
    good = (F.size("x") == dimensions) & ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = vectors.select(vectors["vec_id"].cast("bigint").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("x")).where(x.isNotNull() & good)

    def pack(batches):
        for b in batches:
            values = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            with np.errstate(over="ignore"):
                whole = np.clip(np.floor(values * scale), -LARGEST, LARGEST).astype(np.int64)
            norms = _norms(whole).astype(np.float32)
            size = np.abs(whole).max(axis=1, initial=0)
            kinds = [np.int8 if s < 128 else np.int16 if s < 1 << 15 else np.int32 for s in size.tolist()]
            packed = [v.astype(k).tobytes() for v, k in zip(whole, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(packed, pa.binary()), pa.array([v.tobytes() for v in norms], pa.binary())], ["vec_id", "packed", "norms"])

    return kept.mapInArrow(pack, "vec_id bigint, packed binary, norms binary")


def _norms(whole: np.ndarray) -> np.ndarray:
    """Norms of the segments of each row."""
    n = whole.shape[1]
    parts = [whole[:, i : i + SEGMENT_SIZE].astype(np.float64) for i in range(0, n, SEGMENT_SIZE)]
    return np.sqrt(np.stack([(p * p).sum(axis=1) for p in parts], axis=1)) if parts else np.zeros((len(whole), 0))


def unpack(column: pa.Array, dimensions: int) -> np.ndarray:
    """The integers of packed vectors, a row each."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dimensions), np.int64)
    for kind in (np.int8, np.int16, np.int32):
        at = np.flatnonzero(sizes == dimensions * np.dtype(kind).itemsize)
        if len(at):
            out[at] = np.frombuffer(b"".join(column.take(pa.array(at)).to_pylist()), kind).reshape(-1, dimensions)
    return out


def bounds(norms: np.ndarray, centroid_norms: np.ndarray) -> np.ndarray:
    """Lower bounds of the squared distances of each row from each centroid."""
    out = np.zeros((len(norms), len(centroid_norms)))
    for k, c in enumerate(centroid_norms):
        apart = np.abs(norms - c) - SLACK * (norms + c)
        out[:, k] = (np.maximum(apart, 0.0) ** 2).sum(axis=1)
    return out * (1 - SLACK)


def _distances(whole: np.ndarray, c: np.ndarray, small: bool) -> np.ndarray:
    """Exact squared distances of rows from one centroid."""
    apart = whole - c
    if small:  # sums of products stay below 2**53
        apart = apart.astype(np.float64)
        return np.einsum("ij,ij->i", apart, apart).astype(np.int64)
    return (apart * apart).sum(axis=1)


def nearest(whole: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance, how many distances were computed); ties go to the smaller number."""
    small = max(int(np.abs(whole).max(initial=0)), int(np.abs(centroids).max(initial=0))) < EXACT
    low = bounds(norms, _norms(centroids))
    number = low.argmin(axis=1)
    best = np.zeros(len(whole), np.int64)
    computed = len(whole)
    for k, c in enumerate(centroids):
        own = np.flatnonzero(number == k)
        best[own] = _distances(whole[own], c, small)
    likely = number.copy()
    for k, c in enumerate(centroids):
        rows = np.flatnonzero((low[:, k] <= best) & (likely != k))
        if len(rows):
            computed += len(rows)
            d = _distances(whole[rows], c, small)
            better = (d < best[rows]) | ((d == best[rows]) & (k < number[rows]))
            best[rows[better]], number[rows[better]] = d[better], k
    return number, best, computed


def _blocks(batches, dimensions: int):
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            b = batch.slice(at, BLOCK)
            norms = np.frombuffer(b"".join(b.column("norms").to_pylist()), np.float32).reshape(b.num_rows, -1).astype(np.float64)
            yield b, unpack(b.column("packed"), dimensions), norms


def seeds(prepared: DataFrame, count: int = CENTROIDS, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The vectors with the smallest SHA-256 of ``1:`` and their id, in that order."""
    named = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = prepared.select(named.alias("h"), "packed").orderBy("h", "packed").limit(count).collect()
    return unpack(pa.array([bytes(r.packed) for r in first], pa.binary()), dimensions)


def step(prepared: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floors of the means of the vectors nearest to each; empty ones stay."""
    k, dimensions = centroids.shape

    def sums(batches):
        total, count = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64)
        for _, whole, norms in _blocks(batches, dimensions):
            number = nearest(whole, norms, centroids)[0]
            for c in np.unique(number):
                total[c] += whole[number == c].sum(axis=0)
            count += np.bincount(number, minlength=k)
        at = np.flatnonzero(count)
        columns = [pa.array(at, pa.int64()), pa.array(count[at]), *(pa.array(total[at, i]) for i in range(dimensions))]
        yield pa.RecordBatch.from_arrays(columns, ["k", "n", *(f"s{i}" for i in range(dimensions))])

    parts = prepared.select("packed", "norms").mapInArrow(sums, "k bigint, n bigint, " + ", ".join(f"s{i} bigint" for i in range(dimensions)))
    exact = [F.sum(F.col(f"s{i}").cast("decimal(38,0)")).alias(f"s{i}") for i in range(dimensions)]
    out = centroids.copy()
    for r in parts.groupBy("k").agg(F.sum("n").alias("n"), *exact).collect():  # a row a centroid
        out[r.k] = [int(r[f"s{i}"]) // r.n for i in range(dimensions)]
    return out


def cluster(vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid)`` of ``vectors(vec_id, embedding)``."""
    spark = vectors.sparkSession
    prepared = stored(prepare(vectors, dimensions, scale))
    centroids = seeds(prepared, count, dimensions)
    for _ in range(rounds):
        centroids = step(prepared, centroids)
    last = centroids

    def assign(batches):
        for b, whole, norms in _blocks(batches, dimensions):
            number, best, _ = nearest(whole, norms, last)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(number, pa.int32()), pa.array(best, pa.int64())], ["vec_id", "cluster", "distance"])

    assigned = stored(prepared.mapInArrow(assign, "vec_id bigint, cluster int, distance bigint"))
    sums = {r.cluster: int(r.d) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    most = 2**63 - 1
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    facts = [(k, min(d, most), min(sum(sums.values()), most), digest(last[k]), last[k].tolist()) for k, d in sums.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string, centroid array<bigint>")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")
