"""Tables that outlive lost executors, and running sums over tables of any length."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; only where that is unset (tests), a temporary one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return folder.rstrip("/") if folder else tempfile.mkdtemp(prefix="shared-")


def stored(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it from there: its rows and their partitions no longer change."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_sums(df: DataFrame, order: list[str], sums: dict[str, Column], parts: int | None = None) -> DataFrame:
    """``df`` with columns ``sums``: totals of what stands before a row in ``order``.

    Rows are dealt to ranges and summed within each; only a row a range, its totals,
    comes together in one task, and is joined back. No task sees all rows.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = {f"__v_{name}": c for name, c in sums.items()}
    ranged = stored(df.withColumns(values).repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    before = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__part").agg(*[F.sum(f"__v_{name}").alias(f"__t_{name}") for name in sums])
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__part", *[F.coalesce(F.sum(f"__t_{name}").over(earlier), F.lit(0)).alias(f"__o_{name}") for name in sums])
    joined = ranged.join(F.broadcast(offsets), "__part")
    return joined.select(*df.columns, *[(F.col(f"__o_{name}") + F.coalesce(F.sum(f"__v_{name}").over(before), F.lit(0))).alias(name) for name in sums])
