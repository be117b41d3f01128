"""Facts of documents, compared across sets of companion documents.

A set of companions is a column, ``doc_set_id``; documents within it are told apart by ``doc_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import patterns as P
from .markdown import table_rows


def doc_versions(docs: DataFrame) -> DataFrame:
    """``(doc_id, key, cnt)`` of version numbers: no years, no single-digit decimals, no part of more than four characters."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(T.FLAGS + P.VERSION), F.lit(0))).alias("key"))
    year, small = F.col("key").rlike(r"^\d{4}\.\d"), F.col("key").rlike(r"^\d\.\d$")
    short = F.forall(F.split("key", r"\."), lambda part: F.length(part) <= 4)
    return found.where(~year & ~small & short).groupBy("doc_id", "key").agg(F.count("*").alias("cnt"))


def doc_numbers(docs: DataFrame) -> DataFrame:
    """``(doc_id, key, cnt)`` of numbers with units."""
    pairs = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(T.FLAGS + P.NUMBER), F.lit(g)).alias(f"g{g}") for g in (1, 2)])
    found = docs.select("doc_id", F.explode(pairs).alias("p")).select("doc_id", F.concat_ws(" ", "p.g1", "p.g2").alias("key"))
    return found.groupBy("doc_id", "key").agg(F.count("*").alias("cnt"))


def doc_terms(docs: DataFrame, least: int = 2) -> DataFrame:
    """``(doc_id, key, cnt)`` of capitalised terms outside code that occur at least twice."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all(T.without_code("text"), F.lit(T.FLAGS + P.TERM), F.lit(0))).alias("key"))
    return found.groupBy("doc_id", "key").agg(F.count("*").alias("cnt")).where(F.col("cnt") >= least)


def doc_modules(docs: DataFrame) -> DataFrame:
    """``(doc_id, module)``: first cells of the body of the document's first table."""
    rows = table_rows(docs, fences=False).where("start_line = first_start AND offset >= 2")
    return rows.select("doc_id", F.element_at("cells", 1).alias("module")).distinct()


def _with_set(facts: DataFrame, sets: DataFrame) -> DataFrame:
    return facts.join(sets.select("doc_id", "doc_set_id"), "doc_id")


def _partial(facts: DataFrame, sets: DataFrame) -> DataFrame:
    """Keys that not all documents of a set have, with those that do."""
    size = sets.groupBy("doc_set_id").agg(F.count_distinct("doc_id").alias("of"))
    got = _with_set(facts, sets).groupBy("doc_set_id", "key").agg(F.array_sort(F.collect_set("doc_id")).alias("present"))
    return got.join(size, "doc_set_id").where((F.size("present") < F.col("of")) & (F.col("of") > 1))


def _ids(ids):
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")


def cross_versions(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(doc_set_id, key, n_present, of, present, absent)`` of versions that only some documents of a set name."""
    everyone = sets.groupBy("doc_set_id").agg(F.array_sort(F.collect_set("doc_id")).alias("all"))
    got = _partial(doc_versions(docs), sets).join(everyone, "doc_set_id")
    return got.select("doc_set_id", "key", F.size("present").alias("n_present"), "of", _ids("present").alias("present"), _ids(F.array_except("all", "present")).alias("absent"))


def cross_numbers(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(doc_set_id, key, n_present, of, present)`` of numbers that only some documents of a set name."""
    return _partial(doc_numbers(docs), sets).select("doc_set_id", "key", F.size("present").alias("n_present"), "of", _ids("present").alias("present"))


def cross_terms(docs: DataFrame, sets: DataFrame, least: int = 3) -> DataFrame:
    """``(doc_set_id, doc_id, key, cnt, missing)``: terms used at least three times, with the companions that don't use them twice."""
    terms = _with_set(doc_terms(docs), sets)
    users = terms.groupBy("doc_set_id", "key").agg(F.collect_set("doc_id").alias("users"))
    everyone = sets.groupBy("doc_set_id").agg(F.array_sort(F.collect_set("doc_id")).alias("all"))
    got = terms.where(F.col("cnt") >= least).join(users, ["doc_set_id", "key"]).join(everyone, "doc_set_id")
    got = got.withColumn("missing", F.array_except("all", "users")).where(F.size("missing") > 0)
    return got.select("doc_set_id", "doc_id", "key", "cnt", _ids("missing").alias("missing"))


def cross_term_ranks(docs: DataFrame, sets: DataFrame, least: int = 3) -> DataFrame:
    """``cross_terms`` with ``place``: a document's terms by descending count."""
    order = Window.partitionBy("doc_set_id", "doc_id").orderBy(F.desc("cnt"), "key")
    return cross_terms(docs, sets, least).withColumn("place", F.row_number().over(order))


def cross_modules(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(doc_set_id, doc_id, missing, extra)``: modules against those of the set's first document that has a table."""
    own = _with_set(doc_modules(docs), sets).groupBy("doc_set_id", "doc_id").agg(F.array_sort(F.collect_set("module")).alias("modules"))
    first = own.groupBy("doc_set_id").agg(F.min_by("modules", "doc_id").alias("first"))
    got = own.join(first, "doc_set_id").withColumn("missing", F.array_except("first", "modules")).withColumn("extra", F.array_except("modules", "first"))
    return got.where((F.size("missing") > 0) | (F.size("extra") > 0)).select("doc_set_id", "doc_id", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"))


def sync_signals(diffs: DataFrame) -> DataFrame:
    """``(doc_set_id, op, kind, key)``: versions and numbers on added and removed lines of unified diffs (``diff_text``)."""
    rows = diffs.select("doc_set_id", F.explode(F.split("diff_text", "\n", -1)).alias("line"))
    first = F.substring("line", 1, 1)
    changed = (first == "+") & ~F.startswith("line", F.lit("+++")) | (first == "-") & ~F.startswith("line", F.lit("---"))
    return signals_of(rows.where(changed).select("doc_set_id", F.when(first == "+", "added").otherwise("removed").alias("op"), F.expr("substring(line, 2)").alias("line")))


def signals_of(changes: DataFrame) -> DataFrame:
    """``(doc_set_id, op, kind, key)``: versions and numbers on changed lines ``(doc_set_id, op, line)``."""
    versions = F.transform(F.regexp_extract_all("line", F.lit(T.FLAGS + P.VERSION), F.lit(0)), lambda v: F.struct(F.lit("version").alias("kind"), v.alias("key")))
    parts = F.arrays_zip(*[F.regexp_extract_all("line", F.lit(T.FLAGS + P.NUMBER), F.lit(g)).alias(f"g{g}") for g in (1, 2)])
    numbers = F.transform(parts, lambda p: F.struct(F.lit("number").alias("kind"), F.concat_ws(" ", p["g1"], p["g2"]).alias("key")))
    return changes.select("doc_set_id", "op", F.inline(F.concat(versions, numbers))).distinct()


def sync_check(diffs: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(doc_set_id, doc_id, finding, kind, key)``: "stale" where a document still has a removed key, "missing" where it lacks an added one."""
    return check_signals(sync_signals(diffs), docs, sets)


def check_signals(signals: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """``sync_check`` for signals ``(doc_set_id, op, kind, key)``."""
    signals = signals.groupBy("doc_set_id").agg(F.collect_list(F.struct("op", "kind", "key")).alias("signals"))
    of_doc = sets.select("doc_id", "doc_set_id").join(signals, "doc_set_id")
    rows = docs.select("doc_id", "text").join(of_doc, "doc_id")
    has = lambda x: F.contains("text", x["key"])
    finding = lambda x: F.when((x["op"] == "removed") & has(x), "stale").when((x["op"] == "added") & ~has(x), "missing")
    found = F.filter(F.transform("signals", lambda x: F.struct(finding(x).alias("finding"), x["kind"].alias("kind"), x["key"].alias("key"))), lambda x: x["finding"].isNotNull())
    return rows.select("doc_set_id", "doc_id", F.inline(found))
