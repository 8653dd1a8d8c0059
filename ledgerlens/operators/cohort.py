"""Cohort retention (R09a, R09b) and the wide cohort grid (P5).

Plan: one aggregation per customer collects the set of months in which the
customer succeeded (map-side partial sets, so a customer with millions of rows
ships at most one value per month, and there is a single shuffle by
customer); the smallest month is the cohort, and exploding the set gives one
row per (customer, active month). Customers are then counted per (cohort,
offset). The cohort size is the offset-0 count, since every customer is
active in their own cohort month; no second join is needed.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import kpi
from ledgerlens.params import add_months, month_start


def _retention_counts(txns: DataFrame | None, kept: DataFrame | None = None) -> DataFrame:
    """(cohort_month, month_offset, retained, cohort_n), from the transactions or from ``kept`` (cohort_month, month, retained)."""
    if kept is not None:
        offset = (kpi.month_index("month") - kpi.month_index("cohort_month")).cast("bigint")
        return _with_size(kept.select("cohort_month", offset.alias("month_offset"), "retained"))
    months = (
        txns.filter(kpi.status_is(kpi.SUCCESS) & F.col("CUSTOMER_ID").isNotNull())
        .groupBy("CUSTOMER_ID")
        .agg(F.collect_set(kpi.month_date("TRANSACTION_DATE")).alias("_months"))
    )
    act = months.select(
        F.array_min("_months").alias("cohort_month"), F.explode("_months").alias("activity_month")
    ).withColumn(
        "month_offset",
        (kpi.month_index("activity_month") - kpi.month_index("cohort_month")).cast("bigint"),
    )
    return _with_size(act.groupBy("cohort_month", "month_offset").agg(F.count(F.lit(1)).alias("retained")))


def _with_size(r: DataFrame) -> DataFrame:
    size = F.max(F.when(F.col("month_offset") == 0, F.col("retained"))).over(Window.partitionBy("cohort_month"))
    return r.withColumn("cohort_n", size)


def cohort_retention(
    txns: DataFrame | None,
    as_of: dt.date | None = None,
    cohort_months: int | None = 8,
    max_offset: int = 6,
    kept: DataFrame | None = None,
) -> DataFrame:
    """Retention % of each first-success-month cohort at offsets 0..``max_offset``.

    ``cohort_months`` bounds cohorts to those starting at or after the month
    ``cohort_months`` before ``as_of`` (R09a); ``None`` keeps all cohorts (R09b).
    ``kept``: the counts of a customer history (``sources.history``), so that no transaction is read.
    """
    r = _retention_counts(txns, kept).filter(F.col("month_offset").between(0, max_offset))
    if cohort_months is not None:
        r = r.filter(F.col("cohort_month") >= F.lit(month_start(add_months(as_of, -cohort_months))))
    return r.select(
        "cohort_month",
        "cohort_n",
        "month_offset",
        "retained",
        kpi.rnd(kpi.pct("retained", "cohort_n"), 1).alias("retention_rate_pct"),
    ).orderBy("cohort_month", "month_offset")


def cohort_grid(txns: DataFrame | None, offsets: int = 7, kept: DataFrame | None = None) -> DataFrame:
    """Cohort x offset retention pivoted wide: ``cohort_month`` (text), size, ``m0``..``m{offsets-1}``.

    Offsets are an explicit list, so the pivot needs no extra job to find its
    columns; absent cells stay NULL.
    """
    r = _retention_counts(txns, kept).withColumn("pct", kpi.rnd(kpi.pct("retained", "cohort_n"), 1))
    wide = (
        r.groupBy("cohort_month", "cohort_n")
        .pivot("month_offset", list(range(offsets)))
        .agg(F.first("pct"))
    )
    return wide.select(
        F.date_format("cohort_month", "yyyy-MM").alias("cohort_month"),
        F.col("cohort_n").alias("cohort_size"),
        *[F.col(str(i)).alias(f"m{i}") for i in range(offsets)],
    ).orderBy("cohort_month")
