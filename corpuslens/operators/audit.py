"""Checks of single documents and their score.

All take ``docs(doc_id, text)`` and give a row for each finding.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import patterns as P
from .relations import language, lines, numbered


def ai_flavor_hits(docs: DataFrame) -> DataFrame:
    """``(doc_id, line_no, start, label, text)`` of formulaic phrasing, code included."""
    found = T.find_all(docs, [(f"{i:02d}", T.FLAGS + p) for i, (p, _) in enumerate(P.AI_PATTERNS)], hints={f"{i:02d}": h for i, h in enumerate(P.AI_HINTS)})
    labels = F.array(*[F.lit(label) for _, label in P.AI_PATTERNS])
    return found.select("doc_id", "line_no", "start", F.get(labels, F.col("rule").cast("int")).alias("label"), F.substring("text", 1, 40).alias("text"))


def filler_hits(docs: DataFrame) -> DataFrame:
    """``(doc_id, line_no, start, text)`` of filler words."""
    return T.find_all(docs, [(w, w) for w in P.FILLERS], hints={w: (w,) for w in P.FILLERS}).select("doc_id", "line_no", "start", "text")


def figure_table_gaps(docs: DataFrame) -> DataFrame:
    """``(doc_id, kind, seq, found, expected)``: numbers beyond the next one due, in order of occurrence; as digits, since numbers have any length."""
    kinds = (P.FIGURE, P.TABLE)
    found = T.find_all(numbered(docs), [(k, T.FLAGS + k + r"\s*(\d+)") for k in kinds], groups=(1,), keep=("doc_id", "__row"), hints={k: (k,) for k in kinds}).withColumn("found", T.digits("g1"))
    before = Window.partitionBy("__row", "rule").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    # The number due follows the greatest seen, and is never below 1.
    due = T.next_digits(F.coalesce(F.max(T.ordered_digits("found")).over(before)["digits"], F.lit("0")))
    found = found.withColumn("expected", due).where(T.ordered_digits("found") > T.ordered_digits("expected"))
    return found.select("doc_id", F.col("rule").alias("kind"), F.col("nth").alias("seq"), "found", "expected")


def quote_issues(docs: DataFrame) -> DataFrame:
    """``(doc_id, language, line_no, text)``: straight quotes in Chinese prose (a row a line), Chinese quotes in English (a row each)."""
    docs = docs.withColumn("language", language("text"))
    keep = ("doc_id", "language")
    zh = lines(docs.where("language = 'zh'"), keep).where("NOT is_fence AND NOT in_code").where(F.contains("raw", F.lit('"')))
    en = T.find_all(docs.where("language = 'en'"), [("quote", "[“”]")], keep=keep)
    return zh.select("doc_id", "language", "line_no", F.substring("stripped", 1, 50).alias("text")).unionByName(en.select("doc_id", "language", "line_no", "text"))


def empty_talk_issues(docs: DataFrame) -> DataFrame:
    """``(doc_id, line_no, kind, rule, text)``: headings and short lines of prose that say nothing."""
    s = F.col("stripped")
    rows = docs.where(T.contains_any("text", P.EMPTY_HINTS)).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw")).where(T.contains_any("raw", P.EMPTY_HINTS))
    rows = rows.select("doc_id", (F.col("line_no") + 1).alias("line_no"), T.trimmed("raw").alias("stripped"))
    heading = F.startswith(s, F.lit("#"))
    prose = ~heading & (F.length(s) > 0) & (F.length(s) < 120) & s.rlike(T.FLAGS + r"^[^#|>`\-\d*!]")
    one = lambda kind, i, p, where: F.when(where & s.rlike(T.FLAGS + p), F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("rule")))
    tests = [one("heading", i, p, heading) for i, p in enumerate(P.EMPTY_HEADINGS)] + [one("line", i, p, prose) for i, p in enumerate(P.EMPTY_LINES)]
    return rows.select("doc_id", "line_no", F.inline(F.array_compact(F.array(*tests))), F.substring(s, 1, 40).alias("text"))


def term_variants(docs: DataFrame) -> DataFrame:
    """``(doc_id, term, variants)``: terms spelt in several ways outside code."""
    body = docs.select("doc_id", T.without_code("text").alias("body"))
    return body.select("doc_id", F.inline(F.array_compact(F.array(*_term_ways("body"))))).select("doc_id", "term", F.array_join("ways", "、").alias("variants"))


def _term_ways(body: str) -> list:
    """For each term its name and the spellings found, null where there is but one; searched for only where two spellings occur at all."""
    out = []
    for (p, name), spellings in zip(P.TERM_VARIANTS, P.SPELLINGS, strict=True):
        several = functools.reduce(lambda x, y: x + y, [F.contains(F.col(body), F.lit(w)).cast("int") for w in spellings]) > 1
        ways = F.when(several, F.array_sort(F.array_distinct(F.regexp_extract_all(body, F.lit(T.FLAGS + p), F.lit(1)))))
        found = F.filter(F.array(ways), lambda w: F.size(w) > 1)
        out.append(F.when(F.size(found) > 0, F.struct(F.lit(name).alias("term"), F.get(found, F.lit(0)).alias("ways"))))
    return out


def code_fence_issues(docs: DataFrame) -> DataFrame:
    """``(doc_id, fences, unclosed, unlabelled, lines)``: an odd number of fences, and opening fences without a language (first five line numbers)."""
    found = lines(numbered(docs), ("doc_id", "__row")).where("is_fence")
    bare = F.when((F.col("fences") % 2 == 0) & (T.trimmed(F.expr("substring(stripped, 4)")) == ""), F.col("line_no"))
    got = found.groupBy("doc_id", "__row").agg(F.count("*").alias("fences"), F.sort_array(F.collect_list(bare)).alias("bare"))
    got = got.select("doc_id", "fences", (F.col("fences") % 2 == 1).alias("unclosed"), F.size("bare").alias("unlabelled"), F.array_join(F.transform(F.slice("bare", 1, 5), lambda x: x.cast("string")), "、").alias("lines"))
    return got.where("unclosed OR unlabelled > 0")


def section_jumps(docs: DataFrame) -> DataFrame:
    """``(doc_id, line_no, number, kind)``: "depth" where a number is more than one part longer than the one before, "level" where the heading is."""
    rows = numbered(docs).select("doc_id", "__row", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw")).withColumn("line_no", F.col("line_no") + 1).where(F.col("raw").rlike(T.FLAGS + P.SECTION))
    rows = rows.withColumn("level", F.length(F.regexp_extract("raw", T.FLAGS + P.SECTION, 1))).withColumn("number", F.regexp_extract("raw", T.FLAGS + P.SECTION, 2)).withColumn("depth", F.size(F.split("number", r"\.")))
    w = Window.partitionBy("__row").orderBy("line_no")
    rows = rows.withColumn("last_level", F.lag("level").over(w)).withColumn("last_depth", F.lag("depth").over(w))
    kinds = F.array_compact(F.array(F.when(F.col("depth") > F.col("last_depth") + 1, F.lit("depth")), F.when(F.col("level") > F.col("last_level") + 1, F.lit("level"))))
    return rows.select("doc_id", "line_no", "number", F.explode(kinds).alias("kind"))


def issue_counts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``n_ai``, ``n_filler``, ... of each document: as many as the checks above find.

    Counting needs no positions, so all checks are expressions over one scan,
    without a shuffle; ordinal rules fold over a document's lines or numbers.
    """
    text, zh = F.col("text"), F.col("__language") == "zh"
    raw = F.split(text, "\n", -1)
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    rows = docs.select(*keep, "text", T.without_code("text").alias("__body"), language("text").alias("__language"))
    total = lambda parts: functools.reduce(lambda x, y: x + y, parts)
    # What a text can't have without certain literals isn't looked for.
    where = lambda literals, c: F.when(T.contains_any(text, literals), c).otherwise(F.lit(0))

    def gaps(kind: str):
        numbers = F.transform(F.regexp_extract_all(text, F.lit(T.FLAGS + kind + r"\s*(\d+)"), F.lit(1)), lambda x: T.ordered_digits(T.digits(x)))
        due = lambda top: T.ordered_digits(T.next_digits(top["digits"]))
        zero = F.struct(T.ordered_digits(F.lit("0")).alias("top"), F.lit(0).alias("n"))
        step = lambda a, x: F.struct(F.greatest(a["top"], x).alias("top"), (a["n"] + (x > due(a["top"])).cast("int")).alias("n"))
        return F.aggregate(numbers, zero, step, lambda a: a["n"])

    fence = lambda x: x.rlike(r"(?U)^[\s\x1c-\x1f]*```")
    state = F.struct(F.lit(False).alias("inside"), F.lit(0).alias("quotes"), F.lit(0).alias("fences"), F.lit(0).alias("bare"))

    def walk(a, x):
        bare = ~a["inside"] & x.rlike(r"(?U)^[\s\x1c-\x1f]*```[\s\x1c-\x1f]*$")
        at_fence = F.struct((~a["inside"]).alias("inside"), a["quotes"].alias("quotes"), (a["fences"] + 1).alias("fences"), (a["bare"] + bare.cast("int")).alias("bare"))
        quoted = ~a["inside"] & F.contains(x, F.lit('"'))
        return F.when(fence(x), at_fence).when(quoted, F.struct(a["inside"].alias("inside"), (a["quotes"] + 1).alias("quotes"), a["fences"].alias("fences"), a["bare"].alias("bare"))).otherwise(a)

    def says_nothing(line):
        s = T.trimmed(line)
        heading = F.startswith(s, F.lit("#"))
        prose = ~heading & (F.length(s) > 0) & (F.length(s) < 120) & s.rlike(T.FLAGS + r"^[^#|>`\-\d*!]")
        hits = [(heading & s.rlike(T.FLAGS + p)).cast("int") for p in P.EMPTY_HEADINGS] + [(prose & s.rlike(T.FLAGS + p)).cast("int") for p in P.EMPTY_LINES]
        return F.when(T.contains_any(line, P.EMPTY_HINTS), total(hits)).otherwise(F.lit(0))

    numbered = F.transform(F.filter(raw, lambda x: x.rlike(T.FLAGS + P.SECTION)), lambda x: F.struct(F.length(F.regexp_extract(x, T.FLAGS + P.SECTION, 1)).alias("level"), F.size(F.split(F.regexp_extract(x, T.FLAGS + P.SECTION, 2), r"\.")).alias("depth")))
    first = F.struct(F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("depth"), F.lit(0).alias("n"))
    jump = lambda a, x: F.struct(x["level"].alias("level"), x["depth"].alias("depth"), (a["n"] + F.coalesce((x["depth"] > a["depth"] + 1).cast("int"), F.lit(0)) + F.coalesce((x["level"] > a["level"] + 1).cast("int"), F.lit(0))).alias("n"))
    walked = T.contains_any(text, ("```",)) | (zh & F.contains(text, F.lit('"')))
    rows = rows.withColumn("__walk", F.when(walked, F.aggregate(raw, state, walk)).otherwise(state))
    counts = {
        "ai": total([where(h, T.count(text, T.FLAGS + p)) for (p, _), h in zip(P.AI_PATTERNS, P.AI_HINTS, strict=True)]),
        "filler": total([where((w,), T.count(text, w)) for w in P.FILLERS]),
        "figure_table": where((P.FIGURE,), gaps(P.FIGURE)) + where((P.TABLE,), gaps(P.TABLE)),
        "quote": F.when(zh, F.col("__walk.quotes")).otherwise(where(("“", "”"), T.count(text, "[“”]"))),
        "empty": where(P.EMPTY_HINTS, F.aggregate(raw, F.lit(0), lambda n, x: n + says_nothing(x))),
        "term": total([x.isNotNull().cast("int") for x in _term_ways("__body")]),
        "code": F.col("__walk.fences") % 2 + (F.col("__walk.bare") > 0).cast("int"),
        "section": where(("##",), F.aggregate(numbered, first, jump, lambda a: a["n"])),
    }
    return rows.select(*keep, F.col("__language").alias("language"), T.line_count("text").cast("bigint").alias("lines"), *[c.cast("bigint").alias(f"n_{k}") for k, c in counts.items()])


def audit_report(docs: DataFrame) -> DataFrame:
    """A row for each document: language, lines, the number of issues of each kind, score and verdict. No shuffle."""
    counted = issue_counts(docs)
    score = functools.reduce(lambda x, k: x - F.least(F.col(f"n_{k[0]}") * k[1], F.lit(k[2])), P.PENALTIES, F.lit(100))
    scored = counted.withColumn("score", F.greatest(score, F.lit(0)).cast("bigint"))
    return scored.select("doc_id", "language", "lines", *[f"n_{k}" for k, _, _ in P.PENALTIES], "score", (F.col("score") >= P.GOOD_SCORE).alias("good"))


def audit_score(docs: DataFrame) -> DataFrame:
    """``(doc_id, score)``: 100 less the capped penalties."""
    return audit_report(docs).select("doc_id", "score")


def audit_sections(docs: DataFrame, shown: int = 8) -> DataFrame:
    """``(doc_id, section, n, items)``: what a printed report holds of each kind of finding: how many there are, and the first ones, a line each."""
    line = lambda df, section, no, text: df.select("doc_id", F.lit(section).alias("section"), no.cast("bigint").alias("no"), text.alias("item"))
    at = lambda *text: F.concat(F.lit("L"), F.col("line_no").cast("string"), F.lit(" "), *text)
    parts = [
        line(ai_flavor_hits(docs), "ai", F.col("start"), at(F.lit("["), F.col("label"), F.lit("] "), F.col("text"))),
        line(filler_hits(docs), "filler", F.col("start"), at(F.col("text"))),
        line(figure_table_gaps(docs), "figure_table", F.col("seq"), F.concat("kind", "found", F.lit(" / "), "kind", "expected")),
        line(quote_issues(docs), "quote", F.col("line_no"), at(F.col("text"))),
        line(empty_talk_issues(docs), "empty", F.col("line_no"), at(F.col("text"))),
        line(term_variants(docs), "term", F.lit(0), F.concat("term", F.lit(": "), "variants")),
        line(section_jumps(docs), "section", F.col("line_no"), at(F.col("number"), F.lit(" "), F.col("kind"))),
    ]
    rows = functools.reduce(lambda x, y: x.unionByName(y), parts)
    order = Window.partitionBy("doc_id", "section")
    rows = rows.withColumn("k", F.row_number().over(order.orderBy("no", "item"))).withColumn("n", F.count("*").over(order)).where(F.col("k") <= shown)
    got = rows.groupBy("doc_id", "section", "n").agg(F.array_sort(F.collect_list(F.struct("k", "item"))).alias("items"))
    return got.select("doc_id", "section", "n", F.array_join(F.transform("items", lambda x: x["item"]), "\n").alias("items"))
