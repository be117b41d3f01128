import random

from corpuslens.llm import line_dedup


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def brute(rows, least):
    earlier, out = [], {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        kept, n = [], [0, 0, 0]
        for raw in (text.split("\n") if text is not None else []):
            line = raw.strip(" \t\r")
            n[0] += 1
            if len(line) < least:
                kept.append(raw)
                continue
            if line in earlier:
                n[1] += 1
            elif any(near(line, x) for x in earlier):
                n[2] += 1
            else:
                kept.append(raw)
            earlier.append(line)
        out[doc] = ("\n".join(kept) if text is not None else None, *n)
    return out


def test_equals_brute_force(spark):
    rnd = random.Random(7)
    base = ["".join(rnd.choice("abé ") for _ in range(rnd.choice([11, 12, 15, 16, 31, 32, 63, 64, 100]))).strip() for _ in range(40)]

    def edit(s):
        i = rnd.randrange(len(s))
        return rnd.choice([s[:i] + s[i + 1 :], s[:i] + rnd.choice("abc") + s[i:], s[:i] + "z" + s[i + 1 :], s, " " + s])

    rows = [(d, None if d == 5 else "" if d == 6 else "\n".join(edit(rnd.choice(base)) if rnd.random() < 0.8 else rnd.choice(["", "x", base[0]]) for _ in range(rnd.randrange(1, 9)))) for d in range(60)]
    docs = spark.createDataFrame([(d, t, d) for d, t in rows], "doc_id bigint, text string, n_lines bigint")
    got = {r.doc_id: (r.text, r.n_lines, r.n_exact, r.n_near) for r in line_dedup.dedup_lines(docs).collect()}
    want = brute(rows, line_dedup.MIN_CHARS)
    assert got == want
    assert sum(x[3] for x in got.values()) > 20


def test_very_many_near_lines_and_a_long_one(spark):
    long = "x y " * 30_000
    rows = [(i, f"template line number {i % 10} of a page") for i in range(300)] + [(900, long), (901, long[:-3] + "zy"), (902, long[10:])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_exact, r.n_near) for r in line_dedup.dedup_lines(docs).collect()}
    assert got[0] == (0, 0) and got[3] == (0, 1) and got[13] == (1, 0) and got[900] == (0, 0) and got[901] == (0, 1) and got[902] == (0, 0)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert line_dedup.dedup_lines(docs).count() == 0


def test_a_line_on_every_document(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "OFTEN", 5)
    shared, close = "Licensed under the terms of the owner.", "Licensed under the terms of the owner!"
    rows = [(i, f"{shared}\nown line of document {i * 7919}\n{shared}") for i in range(300)] + [(500, close), (501, close[:-1])]
    got = {r.doc_id: (r.text, r.n_lines, r.n_exact, r.n_near) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute(rows, line_dedup.MIN_CHARS)
    monkeypatch.setattr(line_dedup, "MOST_OFTEN", 0)
    assert got == {r.doc_id: (r.text, r.n_lines, r.n_exact, r.n_near) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}


def test_repeated_and_null_ids(spark):
    a, b, c = "the first line of all", "a second line, longer", "the first line of alk"
    rows = [(1, f"{a}\n{b}", "x"), (1, f"{a}\n{c}", "y"), (None, f"{b}\nonly here, at the end", "z"), (None, None, "w")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, first string")
    out = line_dedup.dedup_lines(docs)
    assert out.columns == ["doc_id", "first", "text", "n_lines", "n_exact", "n_near"]
    got = {r["first"]: (r.text, r.n_lines, r.n_exact, r.n_near) for r in out.collect()}
    # Rows of one doc_id keep the same line numbers; a null doc_id comes last.
    assert got["z"] == ("only here, at the end", 2, 1, 0) and got["w"] == (None, 0, 0, 0)
    assert got["x"][0].startswith(a) and got["x"][1] == got["y"][1] == 2
    exact = {r["first"]: r.n_near for r in line_dedup.dedup_lines(docs, bound=0).collect()}
    assert set(exact.values()) == {0}
