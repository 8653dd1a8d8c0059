"""Mergeable distinct counts: who was active, as bitmaps per month and group.

A count of distinct customers does not add up over months or groups, but a set does. So the customers of each month and
group are kept as bitmaps of 32,768 ids, beside the rollups. Customers of any span of months, and of any coarser grouping,
are the bits of the merged bitmaps: year to date, rolling months or a period come without the transactions, exactly.

A bitmap has 4 KB before compression, for the 32,768 ids of its bucket, and a bucket without a customer has no row; ids far
apart compress to little more than the ids themselves. ``sketches`` keeps HyperLogLog sketches instead, one row per month
and group whatever the ids, for estimates; they are never used unless asked for. A customer NULL (blank) is one member.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import kpi
from ledgerlens.sources.rollup import kept
from ledgerlens.sources.star import Star

D = "TRANSACTION_DATE"
MONTH = "month"
MEMBER = "CUSTOMER_ID"


def bitmaps(txns: DataFrame, by: list[str], member: str = MEMBER) -> DataFrame:
    """(month, ``by``, bucket, bits, blank): the members of each month and group."""
    rows = txns.select(kpi.month_date(D).alias(MONTH), *by, F.col(member).cast("long").alias("_m"))
    return rows.groupBy(MONTH, *by, F.bitmap_bucket_number("_m").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_m")).alias("bits"), F.max(F.col("_m").isNull()).alias("blank")
    )


def sketches(txns: DataFrame, by: list[str], member: str = MEMBER) -> DataFrame:
    """(month, ``by``, sketch, blank): estimates instead of bitmaps."""
    rows = txns.select(kpi.month_date(D).alias(MONTH), *by, F.col(member).cast("long").alias("_m"))
    return rows.groupBy(MONTH, *by).agg(F.hll_sketch_agg("_m").alias("sketch"), F.max(F.col("_m").isNull()).alias("blank"))


def kept_bitmaps(star: Star, by: list[str]) -> DataFrame:
    """The bitmaps beside a materialised star (built on first use)."""
    return kept(star, "members-" + ("_".join(by).lower() or "all"), lambda txns: bitmaps(txns, by), MONTH)


def _merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, unique_customers, known_customers) of the united sets."""
    if "sketch" in rows.columns:
        out = rows.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("known_customers"), F.max("blank").alias("_blank"))
    else:
        sets = rows.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"), F.max("blank").alias("blank"))
        out = sets.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).cast("bigint").alias("known_customers"), F.max("blank").alias("_blank"))
    return out.select(*keys, (F.col("known_customers") + F.col("_blank").cast("bigint")).alias("unique_customers"), "known_customers")


def _dealt(rows: DataFrame, until: Column) -> DataFrame:
    """Each month's rows for every later month up to ``until`` (and the last month there is) whose span holds it."""
    last = rows.select(F.max(MONTH)).scalar()
    months = F.sequence(F.col(MONTH), F.least(until, last), F.expr("INTERVAL 1 MONTH"))
    return rows.withColumn(MONTH, F.explode(months))


def over_year_to_date(rows: DataFrame, by: list[str]) -> DataFrame:
    """Distinct customers from January to each month, for every group seen in the year so far."""
    return _merged(_dealt(rows, F.add_months(F.trunc(MONTH, "year"), 11)), [MONTH, *by])


def over_months(rows: DataFrame, by: list[str], months: int = 3) -> DataFrame:
    """Distinct customers of each month and the ``months - 1`` calendar months before it."""
    return _merged(_dealt(rows, F.add_months(MONTH, months - 1)), [MONTH, *by])


def over_period(rows: DataFrame, by: list[str], first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
    """Distinct customers from month ``first`` to month ``last`` (None: from the beginning, to the end)."""
    if first is not None:
        rows = rows.filter(F.col(MONTH) >= F.lit(first))
    if last is not None:
        rows = rows.filter(F.col(MONTH) <= F.lit(last))
    return _merged(rows, by)
