"""Connected components of a graph of any size, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import at_most, stored

#: A node of more neighbours is a hub, whose edges are dealt to many tasks, unless there are so many hubs; then the bar rises.
HUB, MOST_HUBS = 256, 100_000


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every id in ``edges(a, b)``: the smallest id reachable.

    Each round sends a row to the smallest neighbour for each edge, by aggregation
    and joins over slim rows, where a hub's rows are dealt out; rounds are tables
    in the shared folder. Edges with a null end and loops give no link.
    """
    edges = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    star = stored(_canonical(edges))
    seen = None
    while True:  # the rounds are about the logarithm of the number of nodes
        large = stored(_star(star, large=True))
        star = stored(_star(large, large=False))
        state = star.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return nodes.join(star.select(F.col("b").alias("id"), F.col("a").alias("__root")), "id", "left").select("id", F.coalesce("__root", "id").alias("component"))


def _canonical(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links the larger (or smaller) neighbours of each node to its smallest one, itself included."""
    if large:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        around = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = stored(around.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("u_"), F.least("u", "m").alias("m"), "n"))
    bar = HUB
    while not at_most(hubs := least.where(F.col("n") > bar), MOST_HUBS):
        bar *= 8
    parts = F.when(F.col("n") > bar, F.ceil(F.col("n") / F.lit(bar))).otherwise(F.lit(1)).cast("int")
    least = least.withColumn("part_", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = around.join(F.broadcast(hubs.select(F.col("u_").alias("hub_"), parts.alias("parts_"))), F.col("u") == F.col("hub_"), "left")
    dealt = dealt.withColumn("part", F.when(F.col("hub_").isNotNull(), F.pmod(F.xxhash64("v"), F.col("parts_"))).otherwise(F.lit(0)).cast("int"))
    joined = dealt.join(least, (F.col("u") == F.col("u_")) & (F.col("part") == F.col("part_")))
    if large:
        return _canonical(joined.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")))
    return _canonical(joined.select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.where("part_ = 0").select(F.col("m").alias("a"), F.col("u_").alias("b"))))
