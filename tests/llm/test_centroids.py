"""Centroid clusters against exact arithmetic in plain Python."""

import hashlib
import math
import random

import numpy as np

from corpuslens.llm import centroids as C


def brute(vectors, k=16, rounds=3, scale=64, dims=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in vectors if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    cs = [v for _, v in sorted(kept, key=lambda t: name(t[0]))[:k]]
    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        got = [near(v)[1] for _, v in kept]
        for j in range(len(cs)):
            own = [v for (_, v), g in zip(kept, got, strict=True) if g == j]
            if own:
                cs[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = [(i, *near(v)[::-1]) for i, v in kept]
    per = {j: sum(d for _, g, d in last if g == j) for _, j, _ in last}
    return sorted((i, j, d, per[j], sum(per.values()), hashlib.sha256(",".join(map(str, cs[j])).encode()).hexdigest()) for i, j, d in last)


def got(spark, vectors):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors], "vec_id bigint, embedding array<double>, cluster int, norms string")
    return sorted(tuple(r) for r in C.cluster(df).drop("centroid").collect())


def test_clusters_equal_exact_arithmetic(spark):
    rnd = random.Random(4)
    middle = [[rnd.uniform(-2, 2) for _ in range(64)] for _ in range(5)]
    vectors = [(i, [x + rnd.gauss(0, 0.3) for x in rnd.choice(middle)]) for i in range(300)]
    vectors += [(1000 + i, list(vectors[i][1])) for i in range(40)]  # copies
    vectors += [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [1.0] * 63 + [None]), (2004, [float("nan")] * 64), (2005, [float("inf")] + [0.0] * 63), (2006, [0.0] * 64), (2007, [1e5] * 64), (2008, [-700.5] * 64)]
    assert got(spark, vectors) == brute(vectors)


def test_ties_few_vectors_and_none(spark):
    few = [(i, [float(i % 2)] * 64) for i in range(5)]
    assert got(spark, few) == brute(few)
    same = [(i, [0.25] * 64) for i in range(40)]
    rows = got(spark, same)
    assert rows == brute(same) and {r[1] for r in rows} == {0}
    assert got(spark, [(1, [1.0])]) == []


def test_repeated_and_null_ids_and_huge_components(spark):
    rows = got(spark, [(7, [1.0] * 64), (7, [2.0] * 64), (7, [1.0] * 64)])
    assert [(r[0], r[2]) for r in rows] == [(7, 0)] * 3
    huge = spark.createDataFrame([(None, [1e300] * 64), (1, [-1e300] * 64), (2, [0.5] * 64)], "vec_id bigint, embedding array<double>")
    assert C.cluster(huge, count=1, rounds=0).agg({"distance": "max"}).first()[0] > 2**60


def test_bounds_are_below_distances_and_spare_some():
    rng = np.random.default_rng(5)
    cs = rng.integers(-64, 64, (16, 64)) * rng.integers(0, 3, (16, 8)).repeat(8, axis=1)
    whole = cs[rng.integers(0, 16, 500)] + rng.integers(-9, 9, (500, 64))
    norms = C._norms(whole).astype(np.float32).astype(np.float64)
    exact = ((whole[:, None, :] - cs[None]) ** 2).sum(axis=2)
    assert (C.bounds(norms, C._norms(cs)) <= exact).all()
    number, best, computed = C.nearest(whole, norms, cs)
    assert (number == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()
    assert computed < exact.size / 2
