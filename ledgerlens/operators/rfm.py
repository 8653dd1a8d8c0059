"""RFM segmentation (P3a-P3d).

Per-customer features are one aggregate of the window, checkpointed (one row
per customer): the snapshot date, the scores and the quintile boundaries read
that table, not the transactions again. Boundaries are exact linear-interpolated
quantiles over distinct values with counts, so the commonest frequency is one
row, whoever many customers share it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import kpi
from ledgerlens.plans.ordered import quantile_key, quantile_map
from ledgerlens.session import ensure_checkpoint_dir

D = "TRANSACTION_DATE"
QUINTILES = [0.2, 0.4, 0.6, 0.8]

AT_RISK_SEGMENTS = ("At Risk", "Lost")


def rfm_features(txns: DataFrame, customers: DataFrame, as_of: dt.date, days: int = 180) -> DataFrame:
    """Recency (whole days before the window's last transaction), frequency, monetary, breadth, CRM segment.

    Recency floors elapsed seconds / 86400, as a timedelta's ``.days`` does.
    Transactions are aggregated per customer before the join with the customer
    dimension (whose keys are unique), so the join sees one row per customer;
    the snapshot is the latest transaction among the joined customers, read from
    the checkpointed per-customer table.
    """
    start = as_of - dt.timedelta(days=days)
    f = kpi.date_window(txns, start).filter(kpi.status_is(kpi.SUCCESS)).withColumn("_ts", F.col(D).cast("timestamp_ntz"))
    per = f.groupBy("CUSTOMER_ID").agg(
        F.max("_ts").alias("_last"),
        F.count(F.lit(1)).alias("frequency"),
        F.sum("TXN_AMOUNT_USD").alias("monetary"),
        F.countDistinct("PRODUCT").alias("products_used"),
    ).join(customers.select("CUSTOMER_ID", F.col("SEGMENT").alias("crm_segment")), "CUSTOMER_ID")
    ensure_checkpoint_dir(txns.sparkSession)
    per = per.checkpoint(eager=True)
    snap = per.select(F.max("_last")).scalar()
    secs = F.timestamp_diff("SECOND", F.col("_last"), snap)
    return per.select(
        "CUSTOMER_ID",
        F.floor(secs / F.lit(86400)).cast("bigint").alias("recency"),
        "frequency",
        "monetary",
        "products_used",
        "crm_segment",
    )


def quintile_score(value: Column, bounds: list[Column], reverse: bool = False) -> Column:
    """1..5 by the 20/40/60/80 % boundaries with ``<=`` tests; reversed gives 5..1."""
    v = value.cast("double")
    scores = [5, 4, 3, 2, 1] if reverse else [1, 2, 3, 4, 5]
    e = F.when(v <= bounds[0], scores[0])
    for b, s in zip(bounds[1:], scores[1:4]):
        e = e.when(v <= b, s)
    return e.otherwise(scores[4])


def rfm_segment(r: Column, rfm: Column) -> Column:
    """Segment rules (fixed values of the report), tested in this order."""
    return (
        F.when(rfm >= 13, "Champions")
        .when(r >= 4, "Loyal")
        .when(r >= 3, "Potential Loyalists")
        .when(r == 2, "At Risk")
        .otherwise("Lost")
    )


def rfm_scores(features: DataFrame, exact: bool = True, accuracy: int = 100_000) -> DataFrame:
    """Add R, F, M quintile scores, their sum and the RFM segment.

    ``exact`` uses linear-interpolated quantiles (the original's pandas
    ``quantile``) from a distributed global index; ``exact=False`` uses one
    ``percentile_approx`` pass (bounded-memory sketches, boundaries are data
    values within ``1/accuracy`` rank error) for very large customer bases.
    """
    cols = ["recency", "frequency", "monetary"]
    if exact:
        f = features.withColumn("_q", quantile_map(features, cols, QUINTILES))
        rb, fb, mb = ([F.element_at(F.col("_q"), quantile_key(c, p)) for p in QUINTILES] for c in cols)
    else:
        sketch = features.agg(
            F.struct(*[F.percentile_approx(F.col(c).cast("double"), QUINTILES, accuracy).alias(c) for c in cols])
        ).scalar()
        f = features.withColumn("_q", sketch)
        rb, fb, mb = ([F.col("_q")[c][i] for i in range(len(QUINTILES))] for c in cols)
    s = f.select(
        "*",
        quintile_score(F.col("recency"), rb, reverse=True).alias("R"),
        quintile_score(F.col("frequency"), fb).alias("F"),
        quintile_score(F.col("monetary"), mb).alias("M"),
    ).drop("_q").withColumn("RFM", F.col("R") + F.col("F") + F.col("M"))
    return s.withColumn("RFM_SEGMENT", rfm_segment(F.col("R"), F.col("RFM")))


def rfm_summary(scored: DataFrame) -> DataFrame:
    """Per segment: customers, mean recency/frequency/monetary/breadth and total revenue (1 dp)."""
    return scored.groupBy("RFM_SEGMENT").agg(
        F.count(F.lit(1)).alias("customers"),
        kpi.rnd(kpi.avg_exact("recency"), 1).alias("avg_recency"),
        kpi.rnd(kpi.avg_exact("frequency"), 1).alias("avg_frequency"),
        kpi.rnd(kpi.avg_exact("monetary"), 1).alias("avg_monetary"),
        kpi.rnd(F.sum("monetary"), 1).alias("total_revenue"),
        kpi.rnd(kpi.avg_exact("products_used"), 1).alias("avg_products"),
    ).orderBy(F.col("total_revenue").desc())


def revenue_at_risk(scored: DataFrame, segments: tuple[str, ...] = AT_RISK_SEGMENTS) -> DataFrame:
    """Total monetary value of customers in the at-risk segments (one row)."""
    return scored.agg(
        kpi.rnd(F.coalesce(F.sum(F.when(F.col("RFM_SEGMENT").isin(*segments), F.col("monetary"))), F.lit(0)), 2)
        .alias("revenue_at_risk"),
        kpi.count_when(F.col("RFM_SEGMENT").isin(*segments)).alias("customers_at_risk"),
    )
