"""Exact and near-duplicate lines, by deletion neighbourhoods, in DataFrame operations only.

Lines at edit distance 1 are equal but for one character, so both have equal
texts once it is deleted. Emitting every deletion of every line would be the
square of its length; the neighbourhood is emitted in two steps. First whole
stretches are deleted: a line of n characters has about a dozen keys, each of
the text before and after a stretch on a grid whose step grows with n. Lines
that share such a key with another line, which are few, then delete single
characters within that stretch, as hashed keys. Lines of equal length that
agree on a deletion at one place form a clique, and a line that is itself the
deletion is near all who have it, so aggregates find every line's earliest near
line without forming pairs in a group. That pair is verified by its edit distance.

A line is kept if no earlier line (by doc_id, then line number) is equal to it or
at edit distance 1. Lines are compared without blanks, tabs and carriage returns
at their ends. Those of fewer than ``min_chars`` characters take no part in the
near step; those of fewer than ``exact_chars`` are always kept.

Defined cases: a null text has no lines; a doc_id that repeats names one
document, of which a line number that any row keeps stays in all rows; a null
doc_id comes last, all of them as one;
an empty table gives no rows; other columns are kept by ``dedup_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import at_most, cut

MIN_CHARS = 12
#: A line of more occurrences gives keys at its first one only, unless so many lines are that frequent; then the bar rises.
OFTEN, MOST_OFTEN = 64, 500_000
#: Rows of a table that is small whatever the corpus: buckets of candidate documents.
BUCKETS = 1 << 18
_LINES = 2_147_483_648  # more than a text can have


def _stretches(lines: DataFrame) -> DataFrame:
    """Every stretch of the grid of each line: g, p, s, n and ``key``, a hash of the first p and the last s characters; n-p-s < 2g."""
    rows = lines.withColumn("n", F.length("line"))
    # The step is a quarter of the power of two below n. A line of one character less than a power of two also uses that one's.
    rows = rows.withColumn("bits", F.length(F.bin("n")) - 1)
    both = F.when(F.bit_count("n") == F.col("bits") + 1, F.array(F.col("bits"), F.col("bits") + 1)).otherwise(F.array("bits"))
    rows = rows.withColumn("bit", F.explode(both)).withColumn("g", F.expr("shiftleft(1, greatest(0, bit - 2))")).drop("bits", "bit")
    rows = rows.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("n"), F.col("g"))))
    least = F.col("n") - F.col("p") - (F.col("n") - F.col("p")) % F.col("g")
    rows = rows.withColumn("s", F.explode(F.array(least, least - F.col("g")))).where("s >= 0")
    return rows.withColumn("key", F.xxhash64("g", "p", "s", F.expr("substring(line, 1, p)"), F.expr("substring(line, n - s + 1, s)")))


def _position(doc: Column, line: Column) -> Column:
    return F.coalesce(doc, F.lit(2**63 - 1)).cast("decimal(19,0)") * F.lit(_LINES).cast("decimal(10,0)") + line.cast("decimal(10,0)")


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """``(h1, h2, pos, line)`` of all lines compared: 128-bit identity, position and trimmed text."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select("doc_id", "line_no", _trimmed(F.col("line")).alias("line")).where(F.length("line") >= min_chars)
    return lines.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), _position(F.col("doc_id"), F.col("line_no")).alias("pos"), "line")


def _frequent(distinct: DataFrame) -> DataFrame:
    """``(h1, __first)`` of the lines that occur often; a table of bounded size."""
    bar = OFTEN
    while not at_most(often := distinct.where(F.col("n") > bar), MOST_OFTEN):
        bar *= 8
    return often.groupBy("h1").agg(F.min("first").alias("__first"))


def near_lines(docs: DataFrame, distinct: DataFrame, min_chars: int) -> DataFrame:
    """``(first, near)``: for distinct lines with an earlier line at edit distance 1, the earliest position of either.

    A key's window holds hashes of lines that agree but for one stretch, each a few
    times at most. Lines that share a single character's deletion at one place are
    no more than there are characters.
    """
    rows = _lines(docs, min_chars).join(F.broadcast(_frequent(distinct)), "h1", "left").where("__first IS NULL OR pos = __first")
    keyed = _stretches(rows.select("h1", "line")).select("key", "h1")
    # A key is shared if two lines have it: then some row of each stands beside another line's.
    in_key = Window.partitionBy("key").orderBy("h1")
    beside = keyed.withColumn("a", F.lag("h1").over(in_key)).withColumn("z", F.lead("h1").over(in_key))
    some = cut(beside.where("a <> h1 OR z <> h1").select("key", "h1").distinct())
    place = distinct.join(some.select("h1").distinct(), "h1", "left_semi")
    place = cut(place.select("h1", "first", F.floor(F.col("first") / F.lit(_LINES)).cast("decimal(19,0)").cast("bigint").alias("doc"), (F.col("first") % F.lit(_LINES)).cast("int").alias("line_no")))
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS))
    few = F.broadcast(place.select(bucket("doc").alias("__bucket")).distinct())
    texts = docs.select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("__doc"), "text").withColumn("__bucket", bucket("__doc")).join(few, "__bucket", "left_semi")
    live = texts.join(place, F.col("__doc") == F.col("doc")).select("h1", "first", _trimmed(F.get(F.split("text", "\n"), F.col("line_no"))).alias("line"))
    live = cut(live.where("line IS NOT NULL").groupBy("h1", "first").agg(F.any_value("line").alias("line")))
    # Deletions of single characters within the stretches that are shared.
    stretches = _stretches(live).join(some, ["key", "h1"], "left_semi").withColumn("gap", F.expr("substring(line, p + 1, n - p - s)"))
    low, high = F.expr("greatest(1, n - s - g + 1 - p)"), F.expr("least(g, n - p - s)")
    places = F.when(low <= high, F.concat(F.array(F.lit(0)), F.sequence(low, F.greatest(low, high)))).otherwise(F.array(F.lit(0)))
    variants = stretches.select("first", "key", "gap", F.explode(places).alias("at"))
    variants = variants.select("first", "at", F.xxhash64("key", F.expr("CASE WHEN at = 0 THEN gap ELSE concat(substring(gap, 1, at - 1), substring(gap, at + 1)) END")).alias("v"))
    by_v, by_place = Window.partitionBy("v"), Window.partitionBy("v", "at")
    own = F.when(F.col("at") == 0, F.col("first"))
    other = F.when(F.col("at") > 0, F.col("first"))
    seen = variants.withColumn("self", F.min(own).over(by_v)).withColumn("others", F.min(other).over(by_v)).withColumn("peers", F.min("first").over(by_place))
    earliest = F.when(F.col("at") == 0, F.col("others")).otherwise(F.least("self", "peers"))
    best = seen.groupBy("first").agg(F.min(earliest).alias("near")).where("near < first")
    line_of = lambda name, text: live.select(F.col("first").alias(name), F.col("line").alias(text))
    return best.join(line_of("first", "line"), "first").join(line_of("near", "other"), "near").where(F.levenshtein("line", "other", 1) >= 0).select("first", "near")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, exact_chars: int | None = None, bound: int = 1) -> DataFrame:
    """The rows and columns of ``docs`` with the lines kept as ``text``, and ``n_lines``, ``n_exact`` and ``n_near``.

    n_lines counts the lines before, n_exact those removed as equal to an earlier
    line, n_near those removed for an earlier line at edit distance 1. Without
    ``exact_chars`` the exact step leaves out the lines that the near step leaves out.
    ``bound`` is the edit distance within which lines are near: 0 (exact copies
    only) or 1. Beyond, a line's neighbourhood grows with a power of its length.
    """
    if bound not in (0, 1):
        raise ValueError("bound must be 0 or 1")
    exact_chars = min_chars if exact_chars is None else exact_chars
    slim = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text"))
    distinct = cut(_lines(slim, exact_chars).groupBy("h1", "h2").agg(F.min("pos").alias("first"), F.count("*").alias("n")))
    near = near_lines(slim, distinct, min_chars) if bound else distinct.select("first", F.col("first").alias("near")).limit(0)
    firsts = distinct.select("first").join(near, "first", "left")
    kept = firsts.select(F.floor(F.col("first") / F.lit(_LINES)).cast("decimal(19,0)").cast("bigint").alias("__doc"), (F.col("first") % F.lit(_LINES)).cast("int").alias("__line"), F.col("near").isNull().alias("__kept"))
    kept = kept.groupBy("__doc").agg(F.collect_set(F.when(F.col("__kept"), F.col("__line"))).alias("__k"), F.collect_set(F.when(~F.col("__kept"), F.col("__line"))).alias("__n"))
    state = lambda c, why: F.transform(c, lambda x: F.struct(x.alias("line"), F.lit(why).alias("why")))
    kept = kept.select("__doc", F.array_sort(F.concat(state("__k", 0), state(F.array_except("__n", "__k"), 2))).alias("__listed"))
    # A reason for every line up to the last one listed; those between are copies.
    ahead = lambda x, k: x["line"] - F.when(k == 0, F.lit(-1)).otherwise(F.get("__listed", k - 1)["line"]) - 1
    kept = kept.select("__doc", F.flatten(F.transform("__listed", lambda x, k: F.concat(F.array_repeat(F.lit(1), ahead(x, k)), F.array(x["why"])))).alias("__why"))
    rows = docs.join(kept, F.coalesce(docs["doc_id"].cast("bigint"), F.lit(2**63 - 1)) == F.col("__doc"), "left")
    lines = F.transform(F.split(docs["text"], "\n"), lambda x, i: F.struct(x.alias("line"), F.when(F.length(_trimmed(x)) < exact_chars, F.lit(0)).otherwise(F.coalesce(F.get("__why", i), F.lit(1))).alias("why")))
    rows = rows.withColumn("__lines", lines)
    many = lambda k: F.coalesce(F.size(F.filter("__lines", lambda x: x["why"] == k)), F.lit(0)).cast("bigint")
    text = F.array_join(F.transform(F.filter("__lines", lambda x: x["why"] == 0), lambda x: x["line"]), "\n")
    counts = [F.when(docs["text"].isNull(), 0).otherwise(F.size("__lines")).cast("bigint").alias("n_lines"), *(F.when(docs["text"].isNull(), 0).otherwise(many(k)).cast("bigint").alias(c) for c, k in (("n_exact", 1), ("n_near", 2)))]
    own = [docs[c] for c in docs.columns if c not in ("text", "n_lines", "n_exact", "n_near")]
    return rows.select(*own, text.alias("text"), *counts)
