"""Positions of rows in an order within groups, without a task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import stored

#: monotonically_increasing_id: position in the partition in the lower bits
_LOCAL = (1 << 33) - 1


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``idx``, the position in its ``tree`` by ``order``, and ``n``, the tree's number of rows."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["tree", *order]  # ascending, nulls first
    ranged = stored(
        rows.repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33))
        .withColumn("_at", F.col("_at").bitwiseAND(_LOCAL)),
        "positions",
    )
    # a row for each tree in each partition; a partition has a stretch of trees, a hot tree a stretch of partitions
    spans = ranged.groupBy("_part", "tree").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    w = Window.partitionBy("tree")
    before = w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("_part", "tree", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(w).alias("n"))
    return ranged.join(spans, ["_part", "tree"]).withColumn("idx", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")
