import collections
import random
import re

import numpy as np
import pyarrow as pa

from corpuslens.llm import toxicity
from corpuslens.llm.common import ALNUM, buffers, words


def hashes(*texts):
    return words(*buffers(pa.array([" ".join(texts)])), ALNUM, lower=True)[0]


def test_a_rare_toxic_word_beside_frequent_words_of_equal_hash_bits(spark):
    names = [f"w{i}" for i in range(20_000)]
    seen, pairs = {}, []
    for name, h in zip(names, hashes(*names), strict=True):
        slot = int(h >> np.uint64(20)) & ((1 << 20) - 1)
        if slot in seen:
            pairs.append((seen[slot], name))
        seen[slot] = name
    bad, common = pairs[0]
    rnd = random.Random(5)
    filler = ["f" + str(i) for i in range(300)]
    rows = []
    for i in range(400):
        w = rnd.choices(filler, k=60)
        w[5::6] = [common] * len(w[5::6])
        if i % 2 == 0:
            w[rnd.choice([1, 7, 13])] = bad
        rows.append((i, " ".join(w), int(i % 2 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    models = toxicity.train(docs, labels)
    both = models.likelihoods(toxicity.tokens(pa.array([bad, common, "neverseen"])))
    got = both[1] - both[0]
    assert got[0] > 1 and abs(got[1]) < 0.3 and abs(got[2]) < 0.3


def test_shared_counts_are_of_whole_hashes(spark):
    texts = ["a b a", None, "", "B c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {np.uint64(r.word & (2**64 - 1)): r.n for r in toxicity.shared_counts(docs).collect()}
    assert got == dict(zip(hashes("a", "b", "c"), (2, 2, 1), strict=True))


def brute_models(texts, toxic, everything):
    """P(w | v) of each class as a function of strings, from the definition."""
    split = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    shared = collections.Counter(w for t in everything for w in split(t))
    total = sum(shared.values()) + 0.5 * len(shared)
    s_word = {w: (n + 0.5) / total for w, n in shared.items()}
    s_stem = collections.Counter()
    for w, x in s_word.items():
        s_stem[w[: toxicity.STEM_BYTES]] += x
    d, out = toxicity.DISCOUNT, []
    for c in (0, 1):
        triples = {(u, v, w) for t, y in zip(texts, toxic, strict=True) if y == c for u, v, w in zip(["^", "^", *split(t)], ["^", *split(t)], split(t), strict=False)}
        pair = collections.Counter((v, w) for _, v, w in triples)
        word = collections.Counter(w for _, w in pair)
        stem = collections.Counter(w[: toxicity.STEM_BYTES] for _, w in pair)
        after = collections.Counter()
        for (v, _), n in pair.items():
            after[v] += n
        less = lambda n: max(n - d, 0)

        def p(w, v, pair=pair, word=word, stem=stem, after=after, less=less):
            s = w[: toxicity.STEM_BYTES]
            n_words, n_stems = sum(word.values()), sum(stem.values())
            p_stem = less(stem[s]) / n_stems + (1 - sum(map(less, stem.values())) / n_stems) * s_stem[s]
            p_word = less(word[w]) / n_words + (1 - sum(map(less, word.values())) / n_words) * p_stem * s_word[w] / s_stem[s]
            if v not in after:
                return p_word
            return less(pair[v, w]) / after[v] + (1 - sum(less(n) for (x, _), n in pair.items() if x == v) / after[v]) * p_word

        out.append(p)
    return out, s_word


def test_probabilities_equal_the_definition_and_sum_to_one(spark):
    rnd = random.Random(12)
    vocabulary = ["longstem" + x for x in "abcdefgh"] + [a + b for a in "abcd" for b in "xyz"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    texts = [" ".join(rnd.choices(vocabulary, weights, k=rnd.randrange(1, 60))) for _ in range(60)]
    toxic = [rnd.randrange(2) for _ in texts]
    everything = [*texts, "rare longstemq " * 3, "unlabelled words", None, ""]
    docs = spark.createDataFrame([(t,) for t in everything], "text string")
    rows = spark.createDataFrame(list(zip(texts, toxic, strict=True)), "text string, toxic int")
    models = toxicity.fit_models(toxicity.shared_counts(docs), toxicity.pair_counts(rows))
    (ordinary, bad), s_word = brute_models(texts, toxic, everything)
    assert len(models.pairs.key) > 10
    for v in ("longstema", "ax", "rare"):
        sums = np.zeros(2)
        for w in s_word:
            t = toxicity.tokens(pa.array([f"{v} {w}"]))
            got = np.exp(models.likelihoods(t)[:, 1]) * (1 if models.words.at(t.word)[1][1] else s_word[w])
            assert np.allclose(got, [ordinary(w, v), bad(w, v)], rtol=1e-9)
            sums += got
        assert np.allclose(sums, 1)


def test_features_equal_a_plain_reading():
    table = toxicity.Table
    none = table(np.zeros(0, np.uint64), np.zeros((2, 0)), (0.0, 0.0))
    one = table(np.zeros(0, np.uint64), np.zeros((2, 0)), (1.0, 1.0))
    rnd = random.Random(3)
    names = [f"w{i}" for i in range(20)]
    key = np.sort(hashes(*names))
    p = np.array([[rnd.random() + 0.01 for _ in names] for _ in range(2)])
    models = toxicity.Models(none, one, table(key, p, (0.0, 0.0)), one, (1.0, 1.0))
    texts = [None, "", "w1", "w1 w2", "w3 w3 w3 w3 w3 w3", *(" ".join(rnd.choices(names, k=rnd.randrange(1, 40))) for _ in range(40))]
    value = {name: np.log(p[1] / p[0])[np.searchsorted(key, hashes(name)[0])] for name in names}
    for text, x in zip(texts, models.features(pa.array(texts)), strict=True):
        e = [value[w] for w in (text or "").split()]
        k = min(len(e), toxicity.EXPRESSION)
        high = sorted((sum(e[i : i + k]) / toxicity.EXPRESSION for i in range(len(e) - k + 1)), reverse=True) if e else []
        want = [sum(e) / len(e), high[0], sum(high[: toxicity.TOP]) / len(high[: toxicity.TOP])] if e else [0, 0, 0]
        assert np.allclose(x, want, atol=1e-9)


def test_odd_tables(spark):
    words_of = lambda i: "awfully vile thing " * (i % 2 * 4) + f"plain words {i % 7} here " * 5
    rows = [(i % 200, words_of(i), i % 2, "x") for i in range(400)] + [(None, "vile", 1, "x"), (900, "long " * 200_000 + "vile", 0, None), (901, None, 0, "x"), (902, "", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int, stem string")
    labels = spark.createDataFrame([(i, i % 2, "y") for i in range(200)] + [(i, 0, "y") for i in range(0, 200, 2)] + [(5000, 1, "y")], "doc_id bigint, toxic int, n string")
    models = toxicity.train(docs, labels)
    got = toxicity.score_documents(docs, models).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 8}) == 1
    empty = docs.limit(0)
    assert toxicity.train(empty, labels) is None and toxicity.score_documents(empty, models).count() == 0
    assert toxicity.train(docs, labels.where("toxic = 1")) is None
