"""Contradictions within a document. All take ``docs(doc_id, text)``."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrays import running, settled
from . import patterns as P
from .relations import split_lines

LEVELS = {"high": 0, "medium": 1, "low": 2}
#: What each of the four rules is called, and its level.
RULES = {"delay": ("时延表述矛盾", "high"), "quantity": ("同一量多值", "medium"), "leak": ("占位值泄露", "medium"), "basis": ("序号基准混用", "low")}
#: By rule, the items of its array of hits.
_HITS = {
    "delay": "array<struct<line_no: int, other_line: int, sample: string, other: string>>",
    "quantity": "array<struct<key: string, values: string, first_line: int, n: bigint, samples: string>>",
    "leak": "array<struct<line_no: int, hexes: string, sample: string>>",
    "basis": "array<struct<line_no: int, sample: string>>",
}
_SAID = "array<struct<line_no: int, sent_no: int, sentence: string>>"


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def _said(pattern: str, hints: tuple[str, ...], flags: str = T.FLAGS) -> Column:
    """Sentences of ``__all``, the lines of a text, that a pattern matches, in order: line_no, sent_no and sentence. Lines without any hint have none."""
    parts = lambda x: F.transform(F.split(x["line"], f"(?<=[{P.SENTENCE_ENDS}])", -1), lambda part, k: F.struct(x["line_no"].alias("line_no"), k.alias("sent_no"), T.trimmed(part).alias("sentence")))
    matching = lambda x: F.filter(parts(x), lambda part: (part["sentence"] != "") & part["sentence"].rlike(flags + pattern))
    return F.flatten(F.transform(F.filter("__all", lambda x: T.contains_any(x["low"], hints)), matching))


def _with_first_near(rows: DataFrame, keep: list[str], name: str, items: str, others: str, reach: int) -> DataFrame:
    """The kept columns of ``rows`` and ``name``: each of ``items`` (as item) with the first of ``others`` that is no more than ``reach`` lines before or after it (as near, or null).

    Both are arrays of sentences. Passing them once from the last to the first, the
    last one passed is the first at or after ``reach`` lines before an item.
    """
    none = F.lit(None).cast("struct<line_no: int, sent_no: int, sentence: string>")
    place = lambda x, back, no, own: F.struct((x["line_no"] - back).alias("line"), no.alias("no"), own.alias("own"), x.alias("x"))
    both = F.concat(F.transform(items, lambda x: place(x, reach, F.lit(-1), F.lit(True))), F.transform(others, lambda x: place(x, 0, x["sent_no"], F.lit(False))))
    rows = rows.withColumn("__both", F.reverse(F.array_sort(both)))
    passed = running("__both", F.struct(none.alias("last")), lambda s, p: F.struct(F.when(p["own"], s["last"]).otherwise(p["x"]).alias("last")))
    rows = rows.withColumn("__passed", passed)
    near = lambda p: F.when(p["before"]["last"]["line_no"] - p["item"]["x"]["line_no"] <= reach, p["before"]["last"])
    return settled(rows, keep, **{name: F.reverse(F.transform(F.filter("__passed", lambda p: p["item"]["own"]), lambda p: F.struct(p["item"]["x"].alias("item"), near(p).alias("near"))))})


def _leaks(likely: Column) -> Column:
    """Of ``__all``: placeholder lines with hexadecimal values from 3 lines before to 6 after."""
    found = F.filter("__all", lambda x: T.contains_any(x["line"], P.PLACEHOLDER_HINTS) & x["line"].rlike(T.FLAGS + P.PLACEHOLDER))
    low = lambda x: F.greatest(x["line_no"] - 3, F.lit(1))
    near = lambda x: F.array_join(F.transform(F.slice("__all", low(x), x["line_no"] + 6 - low(x) + 1), lambda y: y["line"]), "\n")
    hexes = lambda x: F.slice(F.regexp_extract_all(near(x), F.lit(T.FLAGS + P.HEX), F.lit(0)), 1, 3)
    hits = F.transform(found, lambda x: F.struct(x["line_no"].alias("line_no"), F.array_join(hexes(x), ",").alias("hexes"), F.substring(T.trimmed(x["line"]), 1, 90).alias("sample")))
    return F.when(likely, F.filter(hits, lambda x: x["hexes"] != "")).otherwise(_none(_HITS["leak"]))


def _with_quantities(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns of ``rows`` and ``quantity``, the hits in ``__text``: matches are sorted by quantity and place, so that each quantity is a slice."""
    # No quantity begins with another ASCII character than R, which is tried before the names, in either case, of all scripts.
    rows = T.find_arrays(rows, [("quantity", r"(?=[Rr\x{80}-\x{10FFFF}])" + T.ANY_CASE + P.QUANTITY)], "__text", keep=tuple(keep), hints={"quantity": P.QUANTITY_HINTS}, context=(P.CONTEXT, P.CONTEXT))
    part = lambda x, g: F.regexp_extract(x["text"], T.ANY_CASE + P.QUANTITY, g)
    one = lambda x: F.struct(F.concat_ws("|", part(x, 1), part(x, 3)).alias("key"), x["start"].alias("start"), part(x, 2).alias("value"), x["line_no"].alias("line_no"), x["context"].alias("context"))
    rows = settled(rows, keep, __sorted=F.sort_array(F.transform("found", one)))
    begins = F.filter(F.transform("__sorted", lambda x, i: F.when((i == 0) | (x["key"] != F.get("__sorted", i - 1)["key"]), i)), lambda i: i.isNotNull())
    rows = settled(rows, [*keep, "__sorted"], __begins=begins)
    groups = F.transform("__begins", lambda b, k: F.slice("__sorted", b + 1, F.coalesce(F.get("__begins", k + 1), F.size("__sorted")) - b))
    example = lambda x: x["context"].rlike(T.FLAGS + P.PLACEHOLDER)
    several = lambda g: (F.size(F.array_distinct(F.transform(g, lambda x: x["value"]))) > 1) & ~F.exists(g, example)

    def hit(g):
        values = F.array_join(F.array_sort(F.array_distinct(F.transform(g, lambda x: x["value"]))), ", ")
        samples = F.array_join(F.transform(F.slice(g, 1, 3), lambda x: F.substring(F.replace(x["context"], F.lit("\n"), F.lit(" ")), 1, 100)), " | ")
        return F.struct(F.get(g, F.lit(0))["key"].alias("key"), values.alias("values"), F.array_min(F.transform(g, lambda x: x["line_no"])).alias("first_line"), F.size(g).cast("bigint").alias("n"), samples.alias("samples"))

    return settled(rows, keep, quantity=F.transform(F.filter(groups, several), hit))


def _found(docs: DataFrame, *rules: str) -> DataFrame:
    """``(doc_id, *rules)``: for each of the rules an array of its hits.

    All within a document's row, linear in its sentences and matches but for their
    sorting. A text is made once and passed once by all rules; those without the
    words in question aren't split or searched.
    """
    rows = settled(docs, ["doc_id"], __text=F.coalesce("text", F.lit("")))
    rows = rows.select("doc_id", "__text", F.lower("__text").alias("__low"))
    likely = {
        "delay": T.contains_any("__text", P.HALF_HINTS) & T.contains_any("__low", P.DELAY_HINTS),
        "quantity": T.contains_any("__text", P.QUANTITY_HINTS),
        "leak": F.contains("__text", F.lit("0x")) & T.contains_any("__text", P.PLACEHOLDER_HINTS),
        "basis": T.contains_any("__low", P.ABSOLUTE_HINTS) & T.contains_any("__low", P.RELATIVE_HINTS),
    }
    rows = settled(rows, ["doc_id", "__text"], __likely=F.struct(*[likely[r].alias(r) for r in rules]))
    is_ = lambda *names: functools.reduce(lambda x, y: x | y, [F.col("__likely")[r] for r in names])
    rows = rows.where(is_(*rules))
    keep = ["doc_id", "__text"]
    by_lines = [r for r in rules if r != "quantity"]
    if by_lines:
        lines = F.transform(split_lines("__text"), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line"), F.lower(x).alias("low")))
        rows = settled(rows, [*keep, "__likely"], __all=F.when(is_(*by_lines), lines).otherwise(_none("array<struct<line_no: int, line: string, low: string>>")))
        said = lambda rule, sentences: F.when(F.col("__likely")[rule], sentences).otherwise(_none(_SAID))
        columns = {}
        if "delay" in rules:
            halves = F.filter(_said(P.HALF, P.HALF_HINTS), lambda x: ~F.contains(x["sentence"], F.lit(P.ONE_WAY)))
            columns |= {"__delays": said("delay", _said(P.DELAY, P.DELAY_HINTS, T.ANY_CASE)), "__halves": said("delay", halves)}
        if "basis" in rules:
            columns |= {"__relative": said("basis", _said(P.RELATIVE, P.RELATIVE_HINTS, T.ANY_CASE)), "__absolute": said("basis", _said(P.ABSOLUTE, P.ABSOLUTE_HINTS, T.ANY_CASE))}
        if "leak" in rules:
            columns["leak"] = _leaks(F.col("__likely")["leak"])
        rows = settled(rows, keep, **columns)
        keep += ["leak"] * ("leak" in rules)
    if "delay" in rules:
        rows = _with_first_near(rows, [c for c in rows.columns if c not in ("__delays", "__halves")], "__delay_near", "__delays", "__halves", P.DELAY_REACH)
        hit = lambda x: F.struct(x["item"]["line_no"].alias("line_no"), x["near"]["line_no"].alias("other_line"), F.substring(x["item"]["sentence"], 1, 80).alias("sample"), F.substring(x["near"]["sentence"], 1, 80).alias("other"))
        rows = rows.withColumn("delay", F.transform(F.filter("__delay_near", lambda x: x["near"].isNotNull()), hit)).drop("__delay_near")
        keep.append("delay")
    if "basis" in rules:
        rows = _with_first_near(rows, [*keep, "__absolute"], "__basis_near", "__relative", "__absolute", P.BASIS_REACH)
        first = F.get("__absolute", F.lit(0))["sentence"]
        alone = F.slice(F.filter("__basis_near", lambda x: x["near"].isNull()), 1, 1)
        hits = F.transform(alone, lambda x: F.struct(x["item"]["line_no"].alias("line_no"), F.substring(x["item"]["sentence"], 1, 80).alias("sample")))
        rows = rows.select(*keep, F.when(~F.contains(first, F.lit("区分")) & ~F.contains(first, F.lit("相对")), hits).otherwise(_none(_HITS["basis"])).alias("basis"))
        keep.append("basis")
    if "quantity" in rules:
        rows = _with_quantities(rows, [c for c in keep if c != "__text"])
    return settled(rows, ["doc_id"], **{r: F.col(r).cast(_HITS[r]) for r in rules})


def _rows_of(docs: DataFrame, rule: str) -> DataFrame:
    return _found(docs, rule).select("doc_id", F.inline(rule))


def check_delay(docs: DataFrame) -> DataFrame:
    """``(doc_id, line_no, other_line, sample, other)``: each sentence on a round trip with the first within 40 lines that halves it."""
    return _rows_of(docs, "delay")


def check_quantities(docs: DataFrame) -> DataFrame:
    """``(doc_id, key, values, first_line, n, samples)``: a quantity with several values, none of whose contexts speaks of examples; samples are the first three contexts."""
    return _rows_of(docs, "quantity")


def check_placeholder_leak(docs: DataFrame) -> DataFrame:
    """``(doc_id, line_no, hexes, sample)``: a placeholder line with hexadecimal values from 3 lines before to 6 after."""
    return _rows_of(docs, "leak")


def check_sequence_basis(docs: DataFrame) -> DataFrame:
    """``(doc_id, line_no, sample)``: the first sentence on relative numbers without one on absolute numbers within 8 lines, if the document's first such sentence sets neither apart."""
    return _rows_of(docs, "basis")


def consistency_hits(docs: DataFrame) -> DataFrame:
    """``(doc_id, rule, level, line_no, sample)`` of all four rules, which pass each text together; ``level`` sorts by LEVELS."""

    def shown(rule):
        line, sample = ("first_line", lambda x: F.concat_ws(": ", x["key"], x["values"])) if rule == "quantity" else ("line_no", lambda x: x["sample"])
        return F.transform(rule, lambda x: F.struct(*[F.lit(v).alias(c) for c, v in zip(("rule", "level"), RULES[rule], strict=True)], x[line].alias("line_no"), sample(x).alias("sample")))

    rows = settled(_found(docs, *RULES), ["doc_id"], __hits=F.concat(*[shown(r) for r in RULES]))
    return rows.select("doc_id", F.inline("__hits"))


def consistency_report(docs: DataFrame) -> DataFrame:
    """``(doc_id, place, level, rule, line_no, sample)``: the hits of each document, the most severe first."""
    rank = F.element_at(F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair]), F.col("level"))
    order = Window.partitionBy("doc_id").orderBy(rank, "rule", "line_no", "sample")
    return consistency_hits(docs).select("doc_id", F.row_number().over(order).alias("place"), "level", "rule", "line_no", "sample")


def gate(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """``(doc_id, passes)``: no hit of the high level."""
    high = hits.where("level = 'high'").select("doc_id").distinct().withColumn("high", F.lit(True))
    return docs.select("doc_id").join(high, "doc_id", "left").select("doc_id", F.col("high").isNull().alias("passes"))
