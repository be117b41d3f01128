"""Relations that the checks share: documents, lines, sentences, language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import patterns as P


def documents(source: DataFrame) -> DataFrame:
    """``(doc_id, text)`` with line ends normalised; other columns are pruned from the scan."""
    return source.select("doc_id", T.normalised("text").alias("text"))


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__row``, which tells rows apart that share an id."""
    return docs.withColumn("__row", F.monotonically_increasing_id())


def lines(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each line: line_no (from 1), raw, stripped, is_fence, fences (how many stand before), in_code (an odd number do) and next_raw, the line after one that begins with a pipe.

    A document's lines are cut into stretches that end with a fence, within its
    row, so no line passes through an exchange. A null text is an empty one, of one line.
    """
    rows = docs.select(*keep, F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("__raw"))
    fence = lambda x: x.rlike(r"(?U)^[\s\x1c-\x1f]*```")
    at = F.when(F.exists("__raw", lambda x: F.contains(x, F.lit("```"))), F.filter(F.transform("__raw", lambda x, i: F.when(fence(x), i + 1)), lambda i: i.isNotNull())).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("__ends", F.concat(at, F.array(F.size("__raw"))))
    begin = lambda k: F.when(k == 0, F.lit(1)).otherwise(F.get("__ends", k - 1) + 1)
    stretches = F.transform("__ends", lambda end, k: F.struct(k.alias("fences"), (k < F.size("__ends") - 1).alias("closes"), begin(k).alias("__from"), F.slice("__raw", begin(k), F.greatest(end - begin(k) + 1, F.lit(0))).alias("part"), F.get("__raw", end).alias("after")))
    rows = rows.select(*keep, F.inline(stretches))
    rows = rows.select(*keep, "fences", "closes", "__from", "after", F.size("part").alias("__size"), "part", F.posexplode("part").alias("at", "raw"))
    next_raw = F.when(F.col("at") + 1 < F.col("__size"), F.get("part", F.col("at") + 1)).otherwise(F.col("after"))
    out = rows.select(*keep, (F.col("__from") + F.col("at")).alias("line_no"), "raw", T.trimmed("raw").alias("stripped"), (F.col("closes") & (F.col("at") == F.col("__size") - 1)).alias("is_fence"), "fences", (F.col("fences") % 2 == 1).alias("in_code"), next_raw.alias("__next"))
    return out.withColumn("next_raw", F.when(F.startswith("stripped", F.lit("|")), F.col("__next"))).drop("__next")


def split_lines(text: Column | str) -> Column:
    """Lines by any Unicode line end, without an empty last one."""
    parts = F.split(T.column(text), r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def sentences(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each sentence: line_no, sent_no (from 0 in its line) and sentence, trimmed and not empty."""
    by_line = docs.select(*keep, F.posexplode(split_lines("text")).alias("line_no", "line"))
    parts = by_line.select(*keep, (F.col("line_no") + 1).alias("line_no"), F.posexplode(F.split("line", f"(?<=[{P.SENTENCE_ENDS}])", -1)).alias("sent_no", "part"))
    return parts.withColumn("sentence", T.trimmed("part")).where("sentence <> ''").drop("part")


def language(text: Column | str) -> Column:
    """"zh" if there are no fewer Chinese characters than Latin letters, so in an empty or null text, else "en"."""
    text = F.coalesce(T.column(text), F.lit(""))
    counted = F.when(T.count(text, "[一-鿿]") >= T.count(text, "[A-Za-z]"), "zh").otherwise("en")
    return F.when(~text.rlike("[A-Za-z]"), "zh").when(~text.rlike("[一-鿿]"), "en").otherwise(counted)
