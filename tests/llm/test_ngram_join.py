import random
import re

from corpuslens.llm import ngram_join, parity_sketch
from corpuslens.llm.components import components


def brute(rows, k, num, den):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    degree = dict.fromkeys(sets, 0)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            if a and b and den * len(a & b) >= num * len(a | b):
                degree[ids[x]] += 1
                degree[ids[y]] += 1
                i, j = sorted((find(ids[x]), find(ids[y])))
                root[j] = i
    return {(i, len(sets[i]), find(i), degree[i]) for i in sets}


def corpus(seed, n=160):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "Aa", "x"]
    texts = []
    passage = rnd.choices(vocabulary, k=40)
    for _ in range(n):
        kind = rnd.random()
        if texts and kind < 0.6:
            w = (rnd.choice(texts) or "").split(" ")
            for _ in range(rnd.choice([0, 1, 1, 2, 3])):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            texts.append(" ".join(w))
        elif kind < 0.7:
            texts.append(rnd.choice([None, "", " \n", "a", "a b", "A b", "a b c"]))
        else:
            w = rnd.choices(vocabulary, k=rnd.choice([5, 20, 60, 200]))
            texts.append(" ".join(w + passage * (kind > 0.85)))
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


def check(spark, rows, k, num, den):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = ngram_join.similar_documents(docs, k, num, den).collect()
    assert len(got) == len(rows)
    assert {tuple(r) for r in got} == brute(rows, k, num, den)


def test_equals_brute_force(spark):
    check(spark, corpus(1), 4, 85, 100)
    check(spark, corpus(2), 5, 80, 100)


def test_frequent_keys_and_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", 3)
    monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", 5)
    check(spark, corpus(3), 4, 85, 100)


def test_hot_keys_and_hubs_are_dealt_out(spark, monkeypatch):
    from corpuslens.llm import components as stars

    monkeypatch.setattr(ngram_join, "SAMPLED", 2)
    monkeypatch.setattr(stars, "HUB", 3)
    rnd = random.Random(15)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(w if rnd.random() > 0.01 else f"x{i}" for w in passage)) for i in range(1, 260)]
    check(spark, rows, 4, 85, 100)
    edges = spark.createDataFrame([(7, i) for i in range(8, 90)] + [(500, 600)], "a bigint, b bigint")
    assert {r.id: r.component for r in components(edges).collect()} == {i: 7 for i in range(7, 90)} | {500: 500, 600: 500}


def test_long_text_among_short_ones(spark):
    rnd = random.Random(5)
    long = " ".join(f"v{rnd.randrange(9000)}" for _ in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "short one"), (4, long[: len(long) // 2])]
    check(spark, rows, 4, 85, 100)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, keys int")
    assert ngram_join.similar_documents(empty).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f", 7), (2, "a b c d e f", 8), (None, "q", 1), (2, "a b c d e f", 9)], "doc_id bigint, text string, cluster int")
    assert sorted(r.doc_id or 0 for r in ngram_join.drop_similar(docs).collect()) == [0, 1]
    assert ngram_join.drop_similar(docs).columns == docs.columns


def test_distance_is_a_lower_bound():
    import numpy as np

    rnd = np.random.default_rng(0)
    for n, m in ((10, 12), (250, 260), (500, 520), (900, 1100)):
        a = rnd.integers(0, 2**64, n, dtype=np.uint64)
        b = np.concatenate([a[3:], rnd.integers(0, 2**64, m, dtype=np.uint64)])
        assert parity_sketch.distance(parity_sketch.bitmap(a), parity_sketch.bitmap(b)) <= 3 + m


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 300)] + [(900, 901), (5, 5), (None, 4)], "a bigint, b bigint")
    got = {r.id: r.component for r in components(edges).collect()}
    assert got == {i: 1 for i in range(1, 301)} | {900: 900, 901: 900}
