"""Phrases against plain counting, and the automaton's states."""

import collections
import random
import re

import numpy as np
import pytest

from corpuslens.llm import collocations as C


def brute(docs, least, shown=2000, percent=80):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + m]) for m in (1, 2, 3, 4) for i in range(len(w) - m + 1))
    cand = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    dropped = {(k[0], *k[i : i + m]) for k, a in cand.items() for m in range(2, len(k) - 1) for i in range(1, len(k) - m + 1) if 100 * a >= percent * f[(k[0], *k[i : i + m])]}
    rows = collections.defaultdict(list)
    for k, a in cand.items():
        if k not in dropped:
            cuts = [(2000000 * a // (f[k[: i + 1]] + f[(k[0], *k[i + 1 :])]), i, f[k[: i + 1]], f[(k[0], *k[i + 1 :])]) for i in range(1, len(k) - 1)]
            score, _, left, right = min(cuts)
            rows[k[0]].append((-score, -a, " ".join(k[1:]).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, v in rows.items() for i, (s, a, p, left, right) in enumerate(sorted(v)[:shown]))


@pytest.mark.parametrize("few", [10**6, 1])
def test_collocations_equal_plain_counting(spark, monkeypatch, few):
    monkeypatch.setattr(C, "SHARD", 37)
    monkeypatch.setattr(C, "FEW_COUNTS", few)
    rnd = random.Random(6)
    words = ["a", "B", "b", "çà", "x\x1cy", "-", "日本", "d", "e", "f", "g", "the"]
    chunks = ["new york city hall", "on the other hand", "New York"]
    texts = [(rnd.choice(["en", "de", None, "und", ""]), "".join(rnd.choice([*words, *chunks]) + rnd.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r"]) for _ in range(rnd.randrange(60)))) for _ in range(150)]
    texts += [("en", None), ("fr", ""), ("en", "new york city hall " * 300)]
    docs = spark.createDataFrame([(x, t, 1) for x, t in texts], "lang string, text string, cnt int").repartition(7)
    got = sorted(tuple(r) for r in C.collocations(docs, least=6, shown=25).collect())
    want = brute(texts, 6, 25)
    assert got == want and {r[0] for r in want} >= {"en", "und"} and any(len(r[2].split(" ")) == 4 for r in want)


def test_nothing_frequent_and_empty_tables(spark):
    docs = spark.createDataFrame([("en", "a b c d"), (None, None)], "lang string, text string")
    assert C.collocations(docs).count() == 0 and C.collocations(docs.limit(0)).count() == 0


def test_states_of_automata():
    rnd = random.Random(3)
    for _ in range(200):
        n = rnd.randrange(0, 40)
        ids = np.array([rnd.randrange(4) for _ in range(n)], np.int64)
        runs = np.cumsum([rnd.random() < 0.2 for _ in range(n)]).astype(np.int64)
        begin, depth = rnd.randrange(0, 4), rnd.randrange(1, 5)
        made = C.Automaton(ids, runs, begin, depth)
        places = collections.defaultdict(list)
        for length in range(1, depth + 1):
            ends, count = made.phrases(length)
            own = {tuple(ids[e - length + 1 : e + 1].tolist()): int(c) for e, c in zip(ends, count, strict=True)}
            for e in range(max(begin, length - 1), n):
                if runs[e] == runs[e - length + 1]:
                    places[tuple(ids[e - length + 1 : e + 1].tolist())].append(e)
            assert own == {p: len(e) for p, e in places.items() if len(p) == length} and len(own) == len(ends)
        assert len(made.count) == len({tuple(e) for e in places.values()})  # a state is a set of ends
        for state, link in enumerate(made.link):
            assert made.longest[link] == made.shortest[state] - 1 and made.count[link] > made.count[state] if link >= 0 else made.shortest[state] == 1


def test_hashes_go_out_by_range():
    rng = np.random.default_rng(5)
    buckets, count = rng.integers(0, C.BUCKETS, 3000), rng.integers(1, 1 << 18, 3000)
    buckets[:2] = 0, C.BUCKETS - 1
    got = collections.Counter()
    for r in C._packed(buckets, count).to_pylist():
        low, n = (np.frombuffer(r[k], np.uint32).astype(np.int64) for k in ("buckets", "counts"))
        got.update(dict(zip((low + C.RANGE * r["part"]).tolist(), n.tolist(), strict=True)))
    assert got == collections.Counter(dict(zip(buckets.tolist(), count.tolist(), strict=True)))
    assert C._packed(buckets[:0], count[:0]).num_rows == 0
