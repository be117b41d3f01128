"""Operators against brute force on small tables, with the edge cases each defines."""

import collections
import hashlib
import pickle
import random
import re
import types
import zlib

import pyarrow as pa
import pytest
from pyspark import cloudpickle

from corpuslens.llm import chat_format, decontaminate, mixing, quality_rules, secret_scan, sharding, token_counts, toxicity
from corpuslens.llm import queries as Q

TEXTS = [None, "", " \n\t", "a", "Zwölf  Boxkämpfer\tjagen Viktor", "x" * 5000, "the the the\nthe the the\n\nthe the the", "tail\x1c\x85end", "<|endoftext|> in <|endoftext|>", "日本語 テキスト\r\nmore", "same", "same"]


def table(spark, texts=TEXTS, **more):
    return spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id bigint, text string, n_words int")


def test_token_counts(spark):
    path = Q.tokenizer_path()
    rnd = random.Random(1)
    texts = TEXTS + ["".join(rnd.choice(list("ab 'sé\n0!.") + [" the", "<|endoftext|>", "  "]) for _ in range(rnd.randrange(80))) for _ in range(200)]
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(table(spark, texts), path).collect()}
    tokenizer = token_counts.load_tokenizer(path)
    assert got == {i: (len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False))) for i, t in enumerate(texts)}


def test_token_counts_do_not_depend_on_caches(monkeypatch):
    path = Q.tokenizer_path()
    monkeypatch.setattr(token_counts, "CACHE", 4)
    monkeypatch.setattr(token_counts, "SLICE", 20)
    texts = ["some words in a longer text, and <|endoftext|> more " * 5, " lead  two\n x", "y" * 300]
    worker = token_counts.Worker(path)
    want = [len(e) for e in worker.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for frequent in ({}, {" words": 1, " longer": 1, "y" * 10: 1}):
        assert worker.count(texts, token_counts.Table(frequent)).tolist() == want


def test_pre_tokens_equal_the_pattern():
    import regex

    pattern = regex.compile(token_counts.PRE_TOKEN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s+(?!\S)", r"\p{White_Space}+(?!\P{White_Space})").replace(r"|\s+", r"|\p{White_Space}+"))
    rnd = random.Random(7)
    alphabet = ["'", "s", "t", "re", "ve", "m", "ll", "d", " ", "  ", "\n", "\t", "\x85", "\x1c", "\u3000", "a", "É", "日", "1", "٣", "½", ".", "-", "😀", "\u0301", "''", " '", "l", "v", "r"]
    for k in range(3000):
        parts = ["".join(rnd.choices(alphabet, k=rnd.randrange(12))) for _ in range(rnd.randrange(1, 4))]
        text, begin, hashed, first = token_counts.pre_tokens(parts)
        got = [text[a:z] for a, z in zip(begin, [*begin[1:], len(text)], strict=True)] if text else []
        assert [got[a:z] for a, z in zip(first[:-1], first[1:], strict=True)] == [pattern.findall(p) for p in parts], parts
        assert len(set(got)) == len(set(hashed.tolist()))


def test_frequent_pre_tokens_cover_the_corpus(spark):
    rnd = random.Random(2)
    vocabulary = ["".join(rnd.choices("abcdefghijkl", k=rnd.randrange(2, 12))) for _ in range(3000)]
    weights = [1 / (i + 1) for i in range(3000)]
    texts = [" ".join(rnd.choices(vocabulary, weights, k=200)) for _ in range(600)]
    docs = table(spark, texts).repartition(20)
    path = Q.tokenizer_path()
    frequent = token_counts.frequent_pre_tokens(docs, path)
    assert max(frequent.values()) > 1 and all(len(e) == n for e, n in zip(token_counts.load_tokenizer(path).encode_batch(list(frequent), add_special_tokens=False), frequent.values(), strict=True))
    hashed = token_counts.pre_tokens(texts)[2]
    assert token_counts.Table(frequent).find(hashed)[1].mean() >= 0.9
    assert token_counts.count_tokens(docs.limit(0), path).count() == 0


def test_token_counts_of_a_very_long_text(spark):
    path = Q.tokenizer_path()
    texts = ["word's 12  x\n" * 200_000, "z" * 70_000]
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(table(spark, texts).withColumn("n_bytes", Q.F.lit("x")), path).collect()}
    tokenizer = token_counts.load_tokenizer(path)
    assert got[1] == len(tokenizer.encode(texts[1], add_special_tokens=False))
    assert got[0] == len(tokenizer.encode(texts[0], add_special_tokens=False))


def test_token_counts_load_one_tokenizer_a_worker(spark, monkeypatch):
    """A worker unpickles the function anew for each task, as here."""
    docs, path, sent, loaded = table(spark), Q.tokenizer_path(), [], []
    through, load = type(docs).mapInArrow, token_counts.load_tokenizer
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: types.SimpleNamespace(value=value))
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: sent.append(cloudpickle.dumps(f)) or through(self, f, schema))
    token_counts.count_tokens(docs, path)
    monkeypatch.setattr(token_counts, "load_tokenizer", lambda p: loaded.append(p) or load(p))
    batch = pa.RecordBatch.from_pydict({"__id": [1, 2], "__text": ["some words", None]})
    for f in sent * 3:
        list(pickle.loads(f)(iter([batch])))
    assert len(sent) == 2 and loaded == [path]


def brute_stats(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_statistics(spark):
    rnd = random.Random(4)
    texts = TEXTS + [" ".join(rnd.choice("ab#") for _ in range(60)) for _ in range(20)] + ["x y z\n" * 9, "# $ é\n# $ é"]
    got = {r.doc_id: tuple(r)[1:6] for r in quality_rules.document_stats(table(spark, texts)).collect()}
    assert got == {i: brute_stats(t) for i, t in enumerate(texts)}


def test_quality_rules_learn_and_keep_clean_documents(spark):
    rnd = random.Random(5)
    good = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9))) for _ in range(60)) + "."
    rows = [(i, good() if i % 4 else " ".join(w + "$$" for w in good().split()), int(bool(i % 4)), "k") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kept int, n_lines string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows[:300]] + [(None, 1), (99999, 0), (3, None)], "doc_id bigint, quality int")
    rules = quality_rules.learn_from_labels(docs, labels)
    assert rules and "CASE WHEN" in str(quality_rules.rules_column(rules))
    left = quality_rules.filter_documents(docs, labels)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i in range(400) if i % 4}
    none = quality_rules.judge(docs, labels.limit(0)).where("kept").count()
    assert none == 400
    assert quality_rules.judge(docs.limit(0), labels).count() == 0


def test_a_list_of_two_rules_of_two_conditions():
    import numpy as np

    rng = np.random.default_rng(4)
    n = 6000
    stats = {k: rng.integers(0, 100, n) for k in quality_rules.STATS}
    stats["n_words"] = np.full(n, 100)
    stats["n_lines"] = stats["n_letters"] = stats["word_chars"] = np.full(n, 100)
    x = quality_rules.feature_arrays(stats)
    # Neither condition alone tells anything; the second rule only concerns what the first leaves.
    first = (x["symbols_per_word"] > 0.6) & (x["digit_share"] > 0.6)
    second = (x["upper_share"] <= 0.3) & (x["marks_per_word"] > 0.7)
    bad = first | second
    rules = quality_rules.learn_rules(stats, bad, rng.integers(0, 3, n))
    assert len(rules) >= 2 and all(len(r) >= 2 for r in rules[:2])
    named = [{c.feature for c in r} for r in rules[:2]]
    assert {"symbols_per_word", "digit_share"} in named and {"upper_share", "marks_per_word"} in named
    found = np.any([quality_rules._covers(r, x) for r in rules], axis=0)
    assert (found == bad).mean() > 0.97
    # What pruning rows don't confirm is cut: noise gives no rule.
    assert quality_rules.learn_rules(stats, rng.random(n) < 0.1, rng.integers(0, 3, n)) == []


def test_rules_do_not_depend_on_the_order_of_repeated_rows(spark):
    rnd = random.Random(31)
    rows = [(i % 300, " ".join(rnd.choice(["ab", "cd#", "efg"]) for _ in range(40)) + " #" * (i % 3 * 20), "x") for i in range(600)] + [(None, None, "y"), (7, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_words string")
    labels = spark.createDataFrame([(i, int(i % 3 != 2), "q") for i in range(300)] * 2 + [(None, 0, "q"), (5, None, "q")], "doc_id bigint, quality int, text string")
    one, two = (quality_rules.learn_from_labels(d, labels) for d in (docs, docs.orderBy("text").repartition(5)))
    assert one == two
    kept = quality_rules.filter_documents(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)
    assert quality_rules.judge(docs.limit(0), labels).count() == 0 and quality_rules.judge(docs, labels.limit(0)).where("kept").count() > 0


def test_mix_meets_targets(spark):
    rnd = random.Random(6)
    rows = [(i, None if i % 50 == 0 else " ".join("w" for _ in range(rnd.randrange(1, 200))), rnd.choice(["hot"] * 6 + ["b", "é", "z", None])) for i in range(1500)] + [(7, "w w", "b"), (7, "w w", "b"), (None, "q", "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.plan_mix(docs).collect()
    assert len(got) == len(rows)
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, free = {}, set(names)
    while True:
        level = (sum(size.values()) - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= 3 * size[s]}
        if not over:
            break
        target |= {s: 3.0 * size[s] for s in over}
        free -= over
    target |= {s: level * weight[s] for s in free}
    taken = collections.Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source]) and r.taken in {k * r.size for k in range(4)}
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= 0.005 * target[s], (s, taken[s], target[s])
    assert sorted(map(str, got)) == sorted(map(str, mixing.plan_mix(docs.repartition(7)).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.plan_mix(docs.limit(0)).count() == 0


def test_mix_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 64)
    monkeypatch.setattr(mixing, "LEAVE", 8)
    rnd = random.Random(61)
    # Sizes of which the largest outweighs hundreds of others; ids that are null or repeated.
    rows = [(rnd.choice([None, 5, i, i]), "w " * int(rnd.paretovariate(0.8)) + f"t{i}", "a" if i % 3 else "b") for i in range(2400)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, source string, size string")
    got = mixing.plan_mix(docs).collect()
    assert len(got) == len(rows)
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.005 * own[0].target
    assert sorted(map(str, got)) == sorted(map(str, mixing.plan_mix(docs.repartition(5)).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert collections.Counter(len(r.text.split()) for r in mixed.collect()) == sum((collections.Counter({r.size: r.copies}) for r in got), collections.Counter())


def test_mix_spreads_rows_without_an_id(spark):
    docs = spark.createDataFrame([(None, f"w{i} " * (i % 9), "s") for i in range(9000)], "doc_id bigint, text string, source string")
    assert mixing._slim(docs).select("same").distinct().count() > 7000
    same = spark.createDataFrame([(None, "a b c", "s")] * 9000 + [(1, "x " * 50, "t")] * 90, "doc_id bigint, text string, source string")
    got = mixing.plan_mix(same).collect()
    for s in "st":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.01 * own[0].target
    assert mixing.mix(same).count() == sum(r.copies for r in got)


def test_mix_of_very_long_texts_and_clashing_columns(spark):
    rows = [(1, "w " * 900_000, "a", 1), (2, None, "a", 2), (3, "", None, 3), (4, "w", "b", 4), (4, "w", "b", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, copies int")
    got = {(r.doc_id, r.size): r.taken for r in mixing.plan_mix(docs).collect()}
    assert got[1, 900_000] in (0, 900_000, 1_800_000, 2_700_000) and got[2, 0] == got[3, 0] == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixing.mix(docs.limit(0)).count() == 0


def test_flight_keeps_totals():
    import numpy as np

    rnd = random.Random(0)
    size = np.array([rnd.randrange(500) for _ in range(300)] + [20_000, 9_000])
    chance = np.full(302, 0.37)
    out = mixing.flight(chance, size, "x", 16)
    left = (out > 0) & (out < 1)
    assert left.sum() <= 16 and size[left].max() < 60
    assert out.sum() == pytest.approx(0.37 * 302) and (out * size).sum() == pytest.approx(0.37 * size.sum())
    landed = mixing.land(out, size)
    assert set(landed) <= {0.0, 1.0} and abs((landed * size).sum() - 0.37 * size.sum()) < 2


def test_large_documents_are_settled_against_all_others():
    import numpy as np

    rest = np.array([random.Random(k).randrange(1, 90) for k in range(2000)], float)
    large = np.array([60_000, 20_000, 500])
    taken = []
    for k in range(300):
        out, a, b = mixing.settle(large, 0.4, len(rest), rest.sum(), (rest**2).sum(), rest.max(), str(k))
        p = a + b * rest
        assert p.min() > -1e-9 and p.max() < 1 + 1e-9
        assert (out * large).sum() + (p * rest).sum() == pytest.approx(0.4 * (large.sum() + rest.sum()), rel=1e-6)
        taken.append(out)
    assert abs(np.mean(taken, axis=0)[1] - 0.4) < 0.1
    alone, a, b = mixing.settle(np.array([7]), 0.3, 0, 0.0, 0.0, 0.0, "x")
    assert alone[0] in (0.0, 1.0)


def test_flight_keeps_each_documents_chance():
    import numpy as np

    size = np.array([900, 100, 90, 80, 50, 40, 30, 20, 10, 5])
    runs = [mixing.land(mixing.flight(np.full(10, 0.4), size, str(k), 2), size) for k in range(1500)]
    assert np.abs(np.mean(runs, axis=0)[:5] - 0.4).max() < 0.08


def test_toxicity_on_held_out_documents(spark):
    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    bad = ["idiotic", "scummy", "trashy"]
    rows = []
    for i in range(900):
        w = rnd.choices(vocabulary, k=rnd.randrange(20, 200))
        if i % 4 == 0:
            for j in rnd.sample(range(len(w)), max(2, len(w) // 30)):
                w[j] = rnd.choice(bad)
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9001, None), (9002, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (7, None)], "doc_id bigint, toxic int")
    score = {r.doc_id: r.score for r in toxicity.score_documents(docs, toxicity.train(docs, labels)).collect()}
    held = [(score[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 100 and sum((s >= 0.5) == bool(y) for s, y in held) >= 0.97 * len(held)
    assert 0 <= score[9001] == score[9002] < 0.5
    nothing = toxicity.score_documents(docs, toxicity.train(docs, labels.limit(0)))
    assert {r.score for r in nothing.collect()} == {0.0}


def brute_secrets(t):
    out = []
    for k, (kind, p, flags, least, group) in enumerate([("assign", Q.secret_scan.BASE_RULES[0].pattern, re.I | re.A, 6, 2), ("access", r"AKIA[A-Z0-9]+", 0, 20, 0), ("hex", r"[0-9a-f]+", 0, 24, 0)]):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(p, t or "", flags) if len(m[group]) >= least]
    return hashlib.sha256(",".join(x for _, _, x in sorted(out)).encode()).hexdigest()


def test_secrets(spark, tmp_path):
    rnd = random.Random(9)
    parts = ["password", "Token", "secret=", ":", " = ", '"', "'", "AKIA", "AB12CD34EF56GH78", "0123456789abcdef01234567", "deadbeef" * 4, "é", "\n", "x", "api_key", "APIKEY=abcdefgh", "KEY"]
    texts = TEXTS + ["".join(rnd.choices(parts, k=rnd.randrange(1, 12))) for _ in range(300)] + ["-----BEGIN RSA PRIVATE KEY-----"] * 2
    docs = table(spark, texts)
    ledger = str(tmp_path / "ledger")
    found = secret_scan.scan_secrets(docs, ledger)
    got = {r.doc_id: r for r in found.select("doc_id", Q.F.sha2(secret_scan.joined(secret_scan.of_kinds("spans", "assign", "access", "hex")), 256).alias("d"), secret_scan.joined("spans").alias("s")).collect()}
    assert {i: r.d for i, r in got.items()} == {i: brute_secrets(t) for i, t in enumerate(texts)}
    assert "private_key:0:31" in got[len(texts) - 1].s
    version = secret_scan.version_of(secret_scan.RULES)
    n = secret_scan.read_ledger(spark, ledger, version).count()
    assert n == len({t or "" for t in texts})
    more = table(spark, [*texts, "token=abcdefgh", "same"])
    assert secret_scan.scan_secrets(more, ledger).count() == len(texts) + 2
    assert secret_scan.read_ledger(spark, ledger, version).count() == n + 1
    assert secret_scan.scan_secrets(docs.limit(0), ledger).count() == 0


def test_ledger_scans_only_unseen_pairs(spark, tmp_path, monkeypatch):
    ledger = str(tmp_path / "ledger")
    versions = spark.createDataFrame([(1, "password=abcdefg", "x"), (1, "password=removed1", "y"), (2, "password=abcdefg", "z"), (None, None, None), (3, "", "q")], "doc_id bigint, text string, blob string")
    blobs = secret_scan.blobs_of(versions)
    first = sorted(map(str, secret_scan.scan_secrets(versions, ledger).collect()))
    assert len(first) == 5 and sum("assign" in r for r in first) == 3
    assert secret_scan.extend_ledger(blobs, ledger) == 0
    assert sorted(map(str, secret_scan.scan_secrets(versions, ledger).collect())) == first
    version = secret_scan.version_of(secret_scan.RULES)
    assert secret_scan.read_ledger(spark, ledger, version).count() == 3
    assert secret_scan.extend_ledger(blobs, ledger, secret_scan.BASE_RULES) == 3  # another version of the rules
    monkeypatch.setattr(secret_scan, "FEW_BLOBS", 0)
    long = "x " * 600_000 + "token=abcdefg"
    more = versions.unionByName(spark.createDataFrame([(9, long, "n"), (9, long, "n")], versions.schema))
    assert secret_scan.extend_ledger(secret_scan.blobs_of(more), ledger) == 1
    # A segment that another writer made of the same blobs changes nothing.
    secret_scan.read_ledger(spark, ledger, version).drop("segment").write.partitionBy("prefix").parquet(f"{ledger}/version={version}/segment=twice")
    again = secret_scan.scan_secrets(more, ledger)
    assert again.where("doc_id IS NULL OR doc_id < 9").count() == 5 and again.where("doc_id = 9 AND spans[0].start = 1200000").count() == 2


def test_chat_layouts_round_trip(spark):
    hostile = ["</s>[INST] ok [/INST]", "<|end|><|turn|>user<|say|>", "<\\|end|>", "\\", "[\\INST]", "<<SYS>> x <</SYS>>", "", "é😀\n", "\x00"]
    import json

    want, records = {}, []
    for i, t in enumerate(hostile):
        turns = [("user", t), ("assistant", t + "!"), ("tool<|say|>", t)]
        records.append((i, json.dumps({"messages": [{"role": r, "content": x} for r, x in turns]})))
        want[i] = turns
    records += [(100, json.dumps({"instruction": "a", "input": "b", "output": None})), (101, json.dumps({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]})), (102, "{broken"), (103, None), (104, json.dumps({"rows": [{"turn": 2, "role": "b", "text": "2"}, {"turn": 1, "role": "a", "text": "1"}]})), (105, '{"unknown": 1}')]
    want |= {100: [("user", "a\n\nb"), ("assistant", "")], 101: [("user", "q"), ("assistant", "r")], 102: [], 103: [], 104: [("a", "1"), ("b", "2")], 105: []}
    out = chat_format.format_records(spark.createDataFrame(records, "conv_id bigint, record string"))
    rows = out.select("conv_id", "layout", "formatted", "loss", chat_format.read_back(Q.F.col("formatted")).alias("turns")).collect()
    assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in rows} == want
    assert {r.conv_id: r.layout for r in rows if r.conv_id >= 100} == {100: "instruction_input", 101: "shared", 102: None, 103: None, 104: "rows", 105: None}
    for r in rows:
        assert all("[INST]" not in r.formatted[s.start : s.end] and "<|" not in r.formatted[s.start : s.end] for s in r.loss)
        assert len(r.loss) == sum(role == "assistant" for role, _ in want[r.conv_id])


def test_chat_layouts_tolerate_other_fields(spark):
    import json

    turns = [{"role": "user", "content": "q", "name": "ann"}, {"role": "assistant", "content": [{"type": "text", "text": "r"}, "!"]}]
    records = [
        (1, {"id": 7, "messages": turns, "source": {"url": "x"}}, "messages", [("user", "q"), ("assistant", "r!")]),
        (1, {"messages": []}, "messages", []),
        (None, {"prompt": "p", "completion": "c", "meta": [1, {"a": 2}]}, "prompt", [("user", "p"), ("assistant", "c")]),
        (4, {"prompt": "p", "response": "r", "system": "s", "id": 1}, "system_prompt", [("system", "s"), ("user", "p"), ("assistant", "r")]),
        (5, {"conversations": [{"from": "gpt", "value": None, "weight": 0}]}, "shared", [("assistant", "")]),
        (6, {"messages": "not a list", "note": 1}, None, []),
        (7, [1, 2], None, []),
        (8, {"rows": [{"turn": 1, "role": "b", "text": "same"}, {"turn": 1, "role": "a", "text": "same"}, {"turn": None, "role": "z", "text": "x" * 2_000_000}]}, "rows", [("z", "x" * 2_000_000), ("a", "same"), ("b", "same")]),
    ]
    d = spark.createDataFrame([(i, json.dumps(r), "x") for i, r, *_ in records], "conv_id bigint, record string, layout string")
    out = chat_format.to_turns(d)
    got = sorted(((r.conv_id or 0, r.layout or "", [(t.role, t.text) for t in r.turns]) for r in out.collect()), key=str)
    assert got == sorted(((i or 0, layout or "", turns) for i, _, layout, turns in records), key=str)
    assert {r.layout: r.n for r in chat_format.layout_counts(out).collect()}[None] == 2
    assert chat_format.format_records(d.limit(0)).count() == 0
    rows = spark.createDataFrame([(None, 1, "user", "a", "z"), (None, 0, None, None, "z"), (3, None, "user", "b", "z")], "conv_id bigint, turn bigint, role string, text string, rows string")
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat_format.to_turns(chat_format.records_from_rows(rows)).collect()}
    assert back == {None: [("", ""), ("user", "a")], 3: [("user", "b")]}


def brute_contamination(docs, items, n=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = cut(t)
        k = min(n, len(w))
        for s in range(len(w) - k + 1) if k else ():
            windows[tuple(w[s : s + k])].add(str(i))
    out = {}
    for d, t in docs:
        w = cut(t)
        hit, found = set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if (x := tuple(w[s : s + k])) in windows:
                    hit |= set(range(s, s + k))
                    found |= windows[x]
        out[d] = (len(w), len(hit), ",".join(sorted(found)))
    return out


@pytest.mark.parametrize("portion", [1 << 21, 40])
def test_contamination(spark, monkeypatch, portion):
    monkeypatch.setattr(decontaminate, "PORTION", portion)
    rnd = random.Random(10)
    vocabulary = ["Aa", "b", "é", "c1", "the", "of", "日本"]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.choice([0, 2, 9, 10, 14])))) for i in range(12)] + [(50, None), (51, "solo, run!")]
    docs = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randrange(40))) + rnd.choice(["", ". ", "-"]) + rnd.choice(items)[1].__str__()) for i in range(120)] + [(500, None), (501, "")]
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id bigint, text string, hits int")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, ",".join(r["items"])) for r in decontaminate.contamination(d, b).collect()}
    assert got == brute_contamination(docs, items)
    kept = {r.doc_id for r in decontaminate.drop_contaminated(d, b).collect()}
    assert kept == {i for i, x in got.items() if not x[1]}


def test_proximity(spark):
    d = spark.createDataFrame([(1, "red x green y blue z z z z z z z z"), (2, "red " + "x " * 40 + "green blue"), (3, "blue green red"), (4, "red blue"), (5, "red " + "x " * 13 + "green blue"), (6, "red " + "x " * 12 + "green blue")], "doc_id bigint, text string")
    b = spark.createDataFrame([(9, "red green blue")], "item_id bigint, text string")
    found = decontaminate.search(decontaminate.build_index(d), b, slop=15)
    assert {r.doc_id: r.near for r in found.collect() if r.near} == {1: ["9"], 3: ["9"], 6: ["9"]}
    assert decontaminate.search(decontaminate.build_index(d.limit(0)), b).count() == 0
    assert decontaminate.search(decontaminate.build_index(d), b.limit(0), slop=15).where("size(near) + size(hits) > 0").count() == 0


def brute_near(docs, items, window, slop):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {}
    for i, t in docs:
        w = split(t)
        out[i] = ",".join(sorted(str(item) for item, x in items if any(set(split(x)[a : a + window]) <= set(w[e : e + slop]) for a in range(max(1, len(split(x)) - window + 1)) for e in range(len(w))) and split(x)))
    return out


@pytest.mark.parametrize("piece, portion", [(1 << 18, 1 << 21), (3, 5)])
def test_proximity_equals_brute_force(spark, monkeypatch, piece, portion):
    monkeypatch.setattr(decontaminate, "PIECE", piece)
    monkeypatch.setattr(decontaminate, "PORTION", portion)
    rnd = random.Random(14)
    vocabulary = [f"w{i}" for i in range(14)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.choice([1, 4, 5, 6, 9])))) for i in range(15)] + [(70, None)]
    docs = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randrange(60)))) for i in range(80)] + [(90, None)] * 2
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contamination(d, b, window=5, slop=8).collect()
    want = brute_near(docs, items, 5, 8)
    assert len(got) == len(docs) and {r.doc_id: ",".join(r.near_items) for r in got} == want
    exact = {r.doc_id: ",".join(r["items"]) for r in got}
    assert exact == {i: ",".join(x for x in want[i].split(",") if x and any(f" {' '.join(y)} " in f" {t} " for n, z in items if str(n) == x for y in [z.split()[k : k + 5] for k in range(max(1, len(z.split()) - 4))])) for i, t in docs}


def test_contamination_of_repeated_and_very_long_documents(spark):
    passage = " ".join(f"item{i}" for i in range(12))
    long = "filler " * 400_000 + passage
    d = spark.createDataFrame([(1, passage, "a"), (1, passage, "b"), (1, "nothing", "c"), (2, long, "d"), (None, passage, "e"), (None, "fine", "f"), (3, "fine", None)], "doc_id bigint, text string, block string")
    b = spark.createDataFrame([(5, passage, "x"), (5, passage, "y")], "item_id bigint, text string, doc_id string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.contamination(d, b).collect())
    assert got == [(0, 1, 0, ()), (0, 12, 12, ("5",)), (1, 1, 0, ()), (1, 12, 12, ("5",)), (1, 12, 12, ("5",)), (2, 400_012, 12, ("5",)), (3, 1, 0, ())]
    assert sorted(r.block for r in decontaminate.drop_contaminated(d, b).select(Q.F.coalesce("block", Q.F.lit("none")).alias("block")).collect()) == ["f", "none"]


def test_a_large_benchmark_stays_small_when_prepared():
    import tracemalloc

    import numpy as np

    pieces = [(str(i), np.random.default_rng(i).integers(0, 1 << 40, 1 << 18, np.uint64).tobytes()) for i in range(8)]
    tracemalloc.start()
    q = decontaminate.prepare(pieces, 10)
    held = sum(x.nbytes for x in (q.terms, q.sequence, *(y for s in q.starts.values() for y in s)))
    assert held < 80 << 20 and tracemalloc.get_traced_memory()[1] < 400 << 20
    tracemalloc.stop()


def brute_capacity(sizes, shards):
    sums = [sum(sizes[:i]) for i in range(len(sizes) + 1)]
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        best = [0] + [min(max(best[i], sums[j] - sums[i]) for i in range(j)) for j in range(1, len(sizes) + 1)]
    return best[-1]


def test_smallest_capacity():
    import numpy as np

    rnd = random.Random(11)
    for _ in range(120):
        sizes = [rnd.choice([1, 5, 9, 30]) for _ in range(rnd.randrange(1, 16))]
        shards = rnd.randrange(1, 7)
        sums = np.concatenate(([0], np.cumsum(sizes)))
        assert sharding.capacity(sums, 0, len(sizes), shards) == brute_capacity(sizes, shards)
        ends = sharding.cuts(sums, 0, len(sizes), shards)
        assert len(ends) == shards and ends == sorted(ends) and ends[-1] == len(sizes)
        assert max(np.diff([sums[i] for i in [0, *ends]])) <= brute_capacity(sizes, shards)


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_A_PART", 20)
    rnd = random.Random(12)
    texts = TEXTS + [f"text {i} " * rnd.randrange(1, 9) for i in range(600)] + ["hot copy"] * 300
    got = sharding.assign_shards(table(spark, texts), 6).collect()
    assert len(got) == len(texts)
    shard_of = {}
    for r in got:
        t = texts[r.doc_id] or ""
        assert (r.size, r.text_crc32) == (len(t.encode()) + 8, zlib.crc32(t.encode()))
        assert shard_of.setdefault(t, r.shard) == r.shard
    for s in range(6):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and slots
    total = collections.Counter()
    for r in got:
        total[r.shard] += r.size
    ranges = collections.Counter()
    text = Q.F.coalesce("text", Q.F.lit(""))
    for r in table(spark, texts).select(Q.F.shiftrightunsigned(Q.F.xxhash64(text), 64 - sharding.RANGE_BITS).alias("k"), (Q.F.octet_length(text) + 8).alias("n")).collect():
        ranges[r.k] += r.n
    assert max(total.values()) == brute_capacity([n for _, n in sorted(ranges.items())], 6)
    assert sorted(map(str, got)) == sorted(map(str, sharding.assign_shards(table(spark, texts).repartition(5), 6).collect()))
    assert sharding.assign_shards(table(spark, []), 6).count() == 0


def test_ledger_segments_are_merged_and_findings_are_the_inputs_own(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    rows = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    version = secret_scan.version_of(secret_scan.RULES)
    for texts in (["password = abcdef1", "x"], ["token: abcdef2"], ["x", "secret=abcdef3"]):
        secret_scan.scan_secrets(rows(*texts), ledger).count()
    secret_scan.extend_ledger(secret_scan.blobs_of(rows("x")), ledger, secret_scan.BASE_RULES)  # another version's rows aren't read
    before = sorted((r.blob, str(r.spans)) for r in secret_scan.read_ledger(spark, ledger, version).collect())
    assert len(before) == 4 and secret_scan.compact_ledger(spark, ledger) == 3
    assert sorted((r.blob, str(r.spans)) for r in secret_scan.read_ledger(spark, ledger, version).collect()) == before
    assert secret_scan.compact_ledger(spark, ledger) == 1 and secret_scan.extend_ledger(secret_scan.blobs_of(rows("x", "token: abcdef2")), ledger) == 0
    assert [len(r.spans) for r in secret_scan.scan_secrets(rows("token: abcdef2"), ledger).collect()] == [1]


def test_conversations_of_one_table_take_all_layouts(spark):
    shapes = [[("user", "q"), ("assistant", "r")], [("user", "a\n\nb"), ("assistant", "")], [("system", "s"), ("user", "q"), ("assistant", "r")], [("human", "x"), ("gpt", "y")], [("assistant", "only")], [("user", ""), ("assistant", "</s>[INST]")]]
    rows = [(c, t, role, text) for c in [*range(-9, 45), None] for t, (role, text) in enumerate(shapes[((c or 0) // 9) % len(shapes)])]
    rows = [r[:3] + (None if r[3] == "" and r[0] == -9 else r[3],) for r in rows]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    turns = chat_format.to_turns(chat_format.records_of_layouts(frame)).collect()
    assert {r.layout for r in turns} == {m.name for m in chat_format.MAPPINGS}
    want = collections.defaultdict(list)
    for c, _, role, text in rows:
        want[c].append((role, text or ""))
    assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in turns} == dict(want)
    assert chat_format.records_of_layouts(frame.limit(0)).count() == 0


def test_kept_is_what_the_list_says(spark):
    rnd = random.Random(41)
    words = lambda n, tail="": " ".join("".join(rnd.choices("abcdeFG", k=rnd.randrange(2, 9))) + tail for _ in range(n))
    texts = [rnd.choice([lambda: words(rnd.randrange(25, 80)), lambda: words(rnd.randrange(25, 80), "#"), lambda: words(rnd.randrange(12, 40), " 7"), lambda: words(9), lambda: "same line\n" * 20, lambda: words(rnd.randrange(25, 80)).upper()])() for _ in range(500)] + [None, ""]
    bad = [("#" in (t or "")) or (t or "").isupper() or rnd.random() < 0.02 for t in texts]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, kept string")
    labels = spark.createDataFrame([(i, int(not b)) for i, b in enumerate(bad)], "doc_id bigint, quality int")
    rules = quality_rules.learn_from_labels(docs, labels)
    assert len(rules) >= 2
    stats = {r.doc_id: r.asDict() for r in quality_rules.document_stats(docs).collect()}

    def value(s, name):
        top, bottom = quality_rules.RATIOS.get(name, (name, None))
        return s[top] / max(s[bottom], 1) if bottom else float(s[name])

    def keeps(i):
        s = stats[i]
        if s["n_words"] < 20 or 100 * s["n_repeat_words"] > 30 * s["n_words"]:
            return False
        return not any(all((value(s, c.feature) > c.threshold) == c.above for c in rule) for rule in rules)

    got = {r.doc_id: r.kept for r in quality_rules.judge(docs, labels).collect()}
    assert got == {i: keeps(i) for i in range(len(texts))} and set(got.values()) == {True, False}
    left = {r.doc_id for r in quality_rules.filter_documents(docs, labels).collect()}
    assert left == {i for i, k in got.items() if k}


def test_covering_goes_on_after_a_rule_that_fails():
    import numpy as np

    rng = np.random.default_rng(8)
    n = 3000
    stats = {k: rng.integers(0, 100, n) for k in quality_rules.STATS}
    stats["n_words"] = stats["n_lines"] = stats["n_letters"] = stats["word_chars"] = np.full(n, 100)
    part = rng.integers(0, 3, n)
    x = quality_rules.feature_arrays(stats)
    real = x["digit_share"] > 0.9
    # What seems best to grow on isn't confirmed by the rows held back.
    bad = real | ((x["symbols_per_word"] > 0.8) & (part != 0))
    rules = quality_rules.learn_rules(stats, bad, part)
    assert any(c.feature == "digit_share" for r in rules for c in r)
    assert all(c.feature != "symbols_per_word" or len(r) > 1 for r in rules for c in r)
