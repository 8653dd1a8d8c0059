"""Data checks the reports rely on.

Dimension joins assume unique keys: a duplicated FX rate or agent row would
multiply the joined fact rows, exactly as the original SQL joins would, and
silently inflate sums. ``check_star`` reports every duplicated key as rows of
one DataFrame (empty when the star is sound); each check is an aggregate over
a dimension, so nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.sources.star import Star

DIMENSION_KEYS = {
    # table: key columns (fixed by the data model)
    "agents": ["AGENT_ID"],
    "customers": ["CUSTOMER_ID"],
    "kpi_targets": ["PRODUCT", "SUBSIDIARY_NAME", "TARGET_MONTH"],
    "forex_rates": ["SUBSIDIARY_NAME", "RATE_MONTH"],
}


def duplicate_keys(df: DataFrame, keys: list[str], table: str = "") -> DataFrame:
    """``(table, key, rows)`` for every key value held by more than one row."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("rows"))
        .filter(F.col("rows") > 1)
        .select(
            F.lit(table).alias("table"),
            F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("<null>")) for k in keys]).alias("key"),
            "rows",
        )
    )


def check_star(star: Star) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        [duplicate_keys(getattr(star, t), k, t) for t, k in DIMENSION_KEYS.items()],
    )
