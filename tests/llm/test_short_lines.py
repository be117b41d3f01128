import hashlib
import random

from test_line_dedup import near

from corpuslens.llm import line_dedup
from corpuslens.llm import queries as Q


def brute(rows, exact, least):
    earlier, out = [], {}
    for doc, text in rows:
        kept, n = [], [0, 0, 0]
        for raw in text.split("\n"):
            line = raw.strip(" \t\r")
            n[0] += 1
            if len(line) >= exact and line in earlier:
                n[1] += 1
            elif len(line) >= least and any(near(line, x) for x in earlier if len(x) >= least):
                n[2] += 1
            else:
                kept.append(raw)
            earlier.append(line)
        out[doc] = ("\n".join(kept), *n)
    return out


def test_exact_copies_of_short_lines_are_removed(spark, tmp_path):
    rnd = random.Random(3)
    base = ["", " ", "x", "y", "Les.", "提交订单", "elevenchars", "elevenchar", "twelve chars", "twelve charz", "a longer line of text"]
    rows = [(d, "\n".join(rnd.choice(["", " "]) + rnd.choice(base) for _ in range(rnd.randrange(1, 8)))) for d in range(40)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.text_sha256, r.n_lines, r.n_exact, r.n_near) for r in Q.op2_line_dedup(spark, str(tmp_path)).collect()}
    want = brute(rows, 1, line_dedup.MIN_CHARS)
    assert got == {d: (hashlib.sha256(t.encode()).hexdigest(), *n) for d, (t, *n) in want.items()}
    assert sum(x[3] for x in got.values()) > 0
