"""License signatures against a plain reading of all rules."""

import random
import re

from pyspark.sql import functions as F

from corpuslens.llm import license_scan as S
from corpuslens.llm.license_rules import PHRASES, ROOTS, RULES, SIGNATURE_LINES, literals, signature

NOT_WORD = re.compile(S.NOT_WORD)


def worded(text):
    w = NOT_WORD.sub("  ", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")).strip(" ")
    return f" {w} " if w else ""


def brute(text, rules):
    w = worded(text)
    found = []
    for r in rules:
        for m in re.finditer(r["pattern"], w):
            first = w[: m.start()].count(" ") // 2
            found.append((first, first + m[0].count(" ") // 2, r))
    inside = lambda a, b: b[0] <= a[0] and b[1] >= a[1] and b[2]["priority"] >= a[2]["priority"] and (b[:2] != a[:2] or b[2]["priority"] > a[2]["priority"] or b[2]["no"] < a[2]["no"])
    kept = [a for a in found if not any(inside(a, b) for b in found)]
    return w.count(" ") // 2, sorted((f[2]["phrase"], f[0]) for f in found if f[2]["phrase"]), sorted((f[0], f[1], f[2]["label"], f[2]["priority"], f[2]["no"]) for f in kept)


def got(df):
    return {r.doc_id: (r.n_words, sorted((p.label, p.first) for p in r.places), sorted((d.first, d.after, d.label, d.priority, d.no) for d in r.detections)) for r in df.collect()}


def expand(regex, rnd):
    """A text that a signature matches."""
    while m := re.search(r"\(([^()]*)\)(\?)?", regex):
        regex = regex[: m.start()] + ("" if m[2] and rnd.random() < 0.5 else rnd.choice(m[1].split("|"))) + regex[m.end() :]
    regex = re.sub(r"\[([^]])[^]]*\]\+?", r"\1", regex)
    return re.sub(r"(.)\?", lambda m: rnd.choice(["", m[1]]), regex)


def test_there_are_hundreds_and_the_prefilter_is_safe():
    assert len(RULES) > 300 and len({r.pattern for r in RULES}) == len(RULES)
    rnd = random.Random(1)
    for line in SIGNATURE_LINES:
        rule, regex = signature(line), line.split(" ", 2)[2]
        held = literals(regex)
        assert rule.keyword in held and any(root in x for x in held for root in ROOTS), line
        for _ in range(5):
            text = worded(expand(regex, rnd))
            assert re.search(rule.pattern, text) and all(x in text for x in held), (line, text)


def test_detections_equal_a_plain_reading(spark):
    rnd = random.Random(2)
    regexes = [x.split(" ", 2)[2] for x in SIGNATURE_LINES]
    texts = [None, "", " \n", "MIT License", "mit/License\x00apache\tlicense GENERAL public-license", "submit license émit license", "The MIT License. mit license mit license", "mit"]
    for _ in range(150):
        parts = [rnd.choice(["zeta", "Version 2.0", "mit license", "apache", "gpl", "é", expand(rnd.choice(regexes), rnd).title(), "general public license, version 3"]) for _ in range(rnd.randrange(1, 14))]
        texts.append(rnd.choice([" ", ", ", "\n", "-"]).join(parts))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, places string")
    rules = S.rule_table()
    want = {i: brute(t, rules) for i, t in enumerate(texts)}
    assert got(S.scan_licenses(docs)) == want and any(len(w[2]) > 3 for w in want.values())


def test_priority_and_containment(spark):
    text = "SPDX-License-Identifier: Apache-2.0. Licensed under the Apache License, Version 2.0; see the Apache License"
    row = S.scan_licenses(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert [(d.first, d.label, d.priority) for d in row.detections] == [(0, "apache-2.0", 5), (6, "apache-2.0", 3), (15, "apache", 1)]
    assert [(p.label, p.first) for p in row.places] == [("apache", 9), ("apache", 16)]


def test_very_many_matches_in_one_text(spark):
    n = 30_000
    docs = spark.createDataFrame([(1, "mit license " * n + "end")], "doc_id int, text string")
    row = S.scan_licenses(docs).select(F.size("places").alias("n"), F.element_at("places", -1)["first"].alias("last"), F.size("detections").alias("d")).first()
    assert (row.n, row.last, row.d) == (n, 2 * n - 2, 2 * n - 1)  # "license mit" is a notice too


def test_own_rules_empty_tables_and_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "b c a b"), (None, "a b")], "doc_id int, text string")
    rules = (signature("x short a b"), signature("y notice b c"), signature("z text a b c"))
    rows = S.scan_licenses(docs, rules, (("p", "b c"),), roots=("a", "b")).collect()
    assert sorted(str([(d.first, d.label) for d in r.detections]) for r in rows) == ["[(0, 'x')]", "[(0, 'y'), (2, 'x')]", "[(0, 'z')]"]
    assert sorted(len(r.places) for r in rows) == [0, 1, 1]
    assert S.scan_licenses(docs.limit(0)).count() == 0 and len(PHRASES) == 3


def test_nothing_is_exchanged_and_no_python_runs(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id int, text string")
    plan = S.scan_licenses(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan and "from_json" not in plan
