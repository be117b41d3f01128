"""Which template a document is written by, and which archived ones are kept.

Templates stand in three tiers: those confirmed in a workspace (by topic), the
consensus of a category's archived ones, and built-in ones (by category).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How many archived templates a category keeps, and from how many on there is a consensus.
KEPT, CONSENSUS_FROM = 10, 3
WORKSPACE, CONSENSUS, BUILT_IN = 1, 2, 3
NAME = r"^(\d{4}-\d{2}-\d{2})-(\d{2,})-(.+)\.md$"


def _dated(name: Column | str) -> list[Column]:
    part = lambda g: F.nullif(F.regexp_extract(name, NAME, g), F.lit(""))
    # A date that the calendar doesn't have is none.
    return [F.try_to_timestamp(part(1), F.lit("yyyy-MM-dd")).cast("date").alias("stored_on"), part(2).try_cast("bigint").alias("number")]


def template_retention(archived: DataFrame, kept: int = KEPT) -> DataFrame:
    """``(category, name, stored_on, number, place, kept, consensus)`` of ``archived(category, name)``.

    Names are ``<date>-<number>-<what>.md``. The newest ``kept`` by date, then number,
    then name stay; names without a date of the calendar are no archived templates: they
    have no place and stay. consensus: the category keeps enough for one. Categories
    with very many templates are ranked in parts first.
    """
    rows = archived.select("category", "name", *_dated("name"))
    dated = F.col("stored_on").isNotNull()
    newest = [F.desc("stored_on"), F.desc("number"), F.desc("name")]
    every = rows.where(dated).withColumn("part", F.pmod(F.xxhash64("name"), F.lit(64)))
    # In parts, then among the first of all parts; what a part drops is dropped by the whole.
    every = every.withColumn("own", F.row_number().over(Window.partitionBy("category", "part").orderBy(*newest)))
    first = every.where(F.col("own") <= kept).withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy(*newest)))
    late = every.where(F.col("own") > kept).withColumn("place", F.lit(None).cast("int"))
    counts = every.groupBy("category").agg((F.least(F.count("*"), F.lit(kept)) >= CONSENSUS_FROM).alias("consensus"))
    undated = rows.where(~dated).withColumn("place", F.lit(None).cast("int"))
    shown = ["category", "name", "stored_on", "number"]
    out = first.select(*shown, F.when(F.col("place") <= kept, F.col("place")).alias("place"), (F.col("place") <= kept).alias("kept")).unionByName(late.select(*shown, "place", F.lit(False).alias("kept"))).unionByName(undated.select(*shown, "place", F.lit(True).alias("kept")))
    return out.join(counts, "category", "left").select(*shown, "place", "kept", F.coalesce("consensus", F.lit(False)).alias("consensus"))


def template_choice(requests: DataFrame, confirmed: DataFrame, archived: DataFrame, built_in: DataFrame) -> DataFrame:
    """``(request_id, category, topic, tier, template)`` of ``requests(request_id, category, topic)``: the first tier that has a template; tier 0 for none.

    ``confirmed(topic, name)`` are the workspace's, ``built_in(category, name)`` come
    with the library, ``archived(category, name)`` make a consensus from three on. Of
    several in a tier the first by name is taken.
    """
    own = confirmed.groupBy("topic").agg(F.min("name").alias("own"))
    agreed = template_retention(archived).where("consensus").select("category", F.lit("consensus").alias("agreed")).distinct()
    given = built_in.groupBy("category").agg(F.min("name").alias("given"))
    rows = requests.join(own, "topic", "left").join(agreed, "category", "left").join(given, "category", "left")
    tier = F.when(F.col("own").isNotNull(), WORKSPACE).when(F.col("agreed").isNotNull(), CONSENSUS).when(F.col("given").isNotNull(), BUILT_IN).otherwise(0)
    return rows.select("request_id", "category", "topic", tier.alias("tier"), F.coalesce("own", "agreed", "given").alias("template"))
