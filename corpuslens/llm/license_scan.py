"""Licenses in texts, by ordered signature rules, in DataFrame functions only.

A text becomes its words (A-Z in lower case), each between two blanks, so that
signatures are regexes over words whatever stands between them. Texts that hold
none of a few roots are done with. In the others only signatures whose keyword
occurs are searched for. A match is an interval of words with the signature's
priority. It is dropped if an interval of a signature of no lower priority contains
it (of equal ones the first signature's stays); intervals that overlap otherwise
stay. All happens in the document's row, without an exchange: intervals in order
of their begins are folded once, with the greatest end seen of each priority.

Phrases are searched for like signatures; their places count before any is dropped.

Defined cases: a null text is an empty one, without words, places and labels, of
score 0; repeated rows and ids each give their row; in a very long text the work
grows with its length and its matches; matches of one signature don't overlap; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import running, settled
from .license_rules import KINDS, PHRASES, ROOTS, RULES, Signature

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The least score of a text with one of the phrases.
PHRASE_SCORE = 0.7
_RULE = "array<struct<no: int, label: string, priority: int, score: double, pattern: string, keyword: string, phrase: string>>"


def rule_table(rules: tuple[Signature, ...] = RULES, phrases: tuple[tuple[str, str], ...] = PHRASES) -> list[dict]:
    """All rules in their order; a phrase is one of the lowest priority."""
    rows = [{"label": r.label, "priority": r.priority, "score": r.score, "pattern": r.pattern, "keyword": r.keyword, "phrase": None} for r in rules]
    rows += [{"label": label, "priority": 1, "score": PHRASE_SCORE, "pattern": f" {p.replace(' ', '  ')} ", "keyword": p.replace(" ", "  "), "phrase": label} for label, p in phrases]
    return [{"no": i} | r for i, r in enumerate(rows)]


def worded(text: Column) -> Column:
    """The words of a text, each between two blanks."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.length(text)  # lower() changes nothing but A-Z there, and is faster
    between = F.regexp_replace(F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), NOT_WORD, "  ")
    inner = F.trim(between)
    return F.when(inner == "", F.lit("")).otherwise(F.concat(F.lit(" "), inner, F.lit(" ")))


def _blanks(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def scan_licenses(docs: DataFrame, rules: tuple[Signature, ...] = RULES, phrases: tuple[tuple[str, str], ...] = PHRASES, roots: tuple[str, ...] = ROOTS) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_words, ``places`` and ``detections``.

    places (label, first): words at which phrases begin, in order. detections (first,
    after, label, priority, score, no): intervals of words that stay, in order.
    ``roots``: each rule's matches must hold one of them.
    """
    rows = docs.select(docs["doc_id"].alias("doc_id"), worded(docs["text"]).alias("__words"))
    text = F.col("__words")
    known = F.from_json(F.lit(json.dumps(rule_table(rules, phrases))), _RULE)
    likely = functools.reduce(lambda x, y: x | y, [F.contains(text, F.lit(r)) for r in roots + tuple(p.replace(" ", "  ") for _, p in phrases)])

    def pieces(r):
        one = lambda m, gap: F.struct(r["no"].alias("no"), r["label"].alias("label"), r["priority"].alias("priority"), r["score"].alias("score"), r["phrase"].alias("phrase"), (_blanks(gap) / 2).cast("int").alias("gap"), (_blanks(m) / 2).cast("int").alias("size"))
        return F.zip_with(F.regexp_extract_all(text, r["pattern"], F.lit(0)), F.split(text, r["pattern"], -1), one)

    found = F.flatten(F.transform(F.filter(known, lambda r: F.contains(text, r["keyword"])), pieces))
    none = F.filter(F.flatten(F.transform(F.slice(known, 1, 0), pieces)), lambda x: F.lit(False))
    # A text is replaced by what is found in it, once, so that nothing is searched for again below.
    rows = rows.select("doc_id", (_blanks(text) / 2).cast("bigint").alias("n_words"), F.when(likely, found).otherwise(none).alias("__pieces"))
    here = F.struct(F.lit(-1).alias("no"), F.lit(0).alias("at"))
    own = lambda state, x: F.when(state["no"] == x["no"], state["at"]).otherwise(F.lit(0))
    rows = rows.withColumn("__placed", running("__pieces", here, lambda s, x: F.struct(x["no"].alias("no"), (own(s, x) + x["gap"] + F.coalesce(x["size"], F.lit(0))).alias("at"))))
    begin = lambda p: own(p["before"], p["item"]) + p["item"]["gap"]
    whole = F.filter("__placed", lambda p: p["item"]["size"].isNotNull())
    ordered = lambda p: F.struct(begin(p).alias("first"), (-begin(p) - p["item"]["size"]).alias("back"), (-p["item"]["priority"]).alias("rank"), p["item"]["no"].alias("no"), p["item"]["label"].alias("label"), p["item"]["score"].alias("score"), p["item"]["phrase"].alias("phrase"))
    rows = rows.withColumn("__found", F.array_sort(F.transform(whole, ordered)))
    # The greatest end so far of intervals of each priority or a higher one.
    levels = range(1, max(p for p, _ in KINDS.values()) + 1)
    zero = F.struct(*[F.lit(-1).alias(f"p{k}") for k in levels])
    ends = lambda s, x: F.struct(*[F.when(-x["rank"] >= k, F.greatest(s[f"p{k}"], -x["back"])).otherwise(s[f"p{k}"]).alias(f"p{k}") for k in levels])
    rows = rows.withColumn("__seen", running("__found", zero, ends))
    reach = lambda p: functools.reduce(lambda c, k: c.when(-p["item"]["rank"] == k, p["before"][f"p{k}"]), levels, F.when(F.lit(False), F.lit(0)))
    kept = F.filter("__seen", lambda p: -p["item"]["back"] > reach(p))
    shown = F.transform(kept, lambda p: F.struct(p["item"]["first"].alias("first"), (-p["item"]["back"]).alias("after"), p["item"]["label"].alias("label"), (-p["item"]["rank"]).alias("priority"), p["item"]["score"].alias("score"), p["item"]["no"].alias("no")))
    places = F.transform(F.filter("__found", lambda x: x["phrase"].isNotNull()), lambda x: F.struct(x["phrase"].alias("label"), x["first"].cast("bigint").alias("first")))
    return settled(rows, ["doc_id", "n_words"], places=places, detections=shown)
