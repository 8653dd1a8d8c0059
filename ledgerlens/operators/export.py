"""The analytics export pack (P6): five datasets written one folder each.

The original writes worksheets of one workbook from a single process; here
each dataset is a DataFrame written by the executors (Parquet or CSV), so the
pack scales with the data and no rows pass through the driver.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import kpi
from ledgerlens.params import prior_month_bounds

D = "TRANSACTION_DATE"


def monthly_kpis(txns: DataFrame, monthly: DataFrame | None = None) -> DataFrame:
    """Month x product x subsidiary volume, success rate (1 dp), value (0 dp), customers.

    ``monthly`` is the kept rollup of the base measures (with ``known_customers``) by product and subsidiary.
    """
    if monthly is not None:
        return monthly.select(
            F.date_format("month", "yyyy-MM").alias("Month"), "PRODUCT", "SUBSIDIARY",
            F.col("total_transactions").alias("TotalTxns"),
            F.col("successful_transactions").alias("Successful"),
            kpi.rnd(kpi.pct("successful_transactions", "total_transactions"), 1).alias("SuccessRate"),
            kpi.rnd("total_value_usd", 0).alias("ValueUSD"),
            F.col("known_customers").alias("UniqueCustomers"),
        ).orderBy(F.col("Month").desc(), F.col("TotalTxns").desc())
    return txns.groupBy(kpi.month_key(D).alias("Month"), "PRODUCT", "SUBSIDIARY").agg(
        F.count(F.lit(1)).alias("TotalTxns"),
        kpi.successes().alias("Successful"),
        kpi.rnd(kpi.pct(kpi.successes(), F.count(F.lit(1))), 1).alias("SuccessRate"),
        kpi.rnd(F.sum("TXN_AMOUNT_USD"), 0).alias("ValueUSD"),
        F.countDistinct("CUSTOMER_ID").alias("UniqueCustomers"),
    ).orderBy(F.col("Month").desc(), F.col("TotalTxns").desc())


def failure_summary(txns: DataFrame) -> DataFrame:
    """Failures with a non-empty description by product/channel/description/category.

    The original orders by its 4th column (the category), kept here.
    """
    return (
        txns.filter(kpi.status_is(kpi.FAILED) & (F.col("FAILURE_DESCRIPTION") != ""))
        .groupBy("PRODUCT", "CHANNEL", "FAILURE_DESCRIPTION", "FAILURE_CATEGORY")
        .agg(F.count(F.lit(1)).alias("FailureCount"), kpi.rnd(F.sum("TXN_AMOUNT_USD"), 2).alias("FailedValueUSD"))
        .orderBy(F.col("FAILURE_CATEGORY").desc())
    )


def agent_summary(txns: DataFrame, agents: DataFrame, as_of: dt.date, product: str) -> DataFrame:
    """Last-month agent sheet (lighter R04); ordered by region as in the original."""
    start, end = prior_month_bounds(as_of)
    per = (
        kpi.date_window(txns, start, end).filter(
            (F.col("PRODUCT") == F.lit(product)) & F.col("AGENT_ID").isNotNull() & (F.col("AGENT_ID") != "")
        )
        .groupBy("AGENT_ID")
        .agg(
            F.count(F.lit(1)).alias("TotalTxns"),
            kpi.successes().alias("_s"),
            F.sum("TXN_AMOUNT_LOCAL").alias("_v"),
            F.countDistinct("CUSTOMER_ID").alias("Customers"),
            kpi.count_when(F.col("FAILURE_CODE") == "INSUFF_FLOAT").alias("FloatFails"),
        )
    )
    return agent_sheet(per, agents)


def agent_sheet(per: DataFrame, agents: DataFrame) -> DataFrame:
    """The sheet from one row per agent (TotalTxns, _s successes, _v local value, Customers, FloatFails)."""
    return (
        per.join(agents.select("AGENT_ID", "AGENT_TIER", "REGION", "COUNTY"), "AGENT_ID")
        .select(
            "AGENT_ID",
            "AGENT_TIER",
            "REGION",
            "COUNTY",
            "TotalTxns",
            kpi.rnd(kpi.pct("_s", "TotalTxns"), 1).alias("SR"),
            kpi.rnd("_v", 0).alias("ValueKES"),
            "Customers",
            "FloatFails",
        )
        .orderBy(F.col("REGION").desc())
    )


def corridor_performance(txns: DataFrame, product: str) -> DataFrame:
    """P6d: corridor x month for the remittance product, all history (``!=``: NULL ends excluded)."""
    return (
        txns.filter((F.col("PRODUCT") == F.lit(product)) & (F.col("SOURCE_COUNTRY") != F.col("DEST_COUNTRY")))
        .groupBy(F.concat("SOURCE_COUNTRY", F.lit("->"), "DEST_COUNTRY").alias("Corridor"), kpi.month_key(D).alias("Month"))
        .agg(
            F.count(F.lit(1)).alias("Txns"),
            kpi.rnd(F.sum("TXN_AMOUNT_USD"), 2).alias("ValueUSD"),
            kpi.rnd(kpi.pct(kpi.successes(), F.count(F.lit(1))), 1).alias("SR"),
        )
        .orderBy(F.col("Month").desc(), F.col("ValueUSD").desc())
    )


def customer_segments(txns: DataFrame, customers: DataFrame) -> DataFrame:
    """P6e: success-only segment revenue over all history (lighter R07), pre-aggregated per customer."""
    per = txns.filter(kpi.status_is(kpi.SUCCESS)).groupBy("CUSTOMER_ID").agg(
        F.count(F.lit(1)).alias("_n"), kpi.successes().alias("_s"), F.sum("TXN_AMOUNT_USD").alias("_v")
    )
    return segment_sheet(per, customers)


def segment_sheet(per: DataFrame, customers: DataFrame) -> DataFrame:
    """The sheet from one row per customer (_n successes, _s the same, _v USD value)."""
    g = per.join(customers.select("CUSTOMER_ID", "SEGMENT"), "CUSTOMER_ID").groupBy("SEGMENT").agg(
        F.countDistinct("CUSTOMER_ID").alias("Customers"),
        F.sum("_v").alias("_v"),
        F.sum("_n").alias("_n"),
        F.sum("_s").alias("_s"),
    )
    return g.select(
        "SEGMENT",
        "Customers",
        kpi.rnd(kpi.ratio("_v", "Customers"), 2).alias("RevPerCust"),
        kpi.rnd(kpi.pct("_s", "_n"), 1).alias("SR"),
    ).orderBy(F.col("Customers").desc())


def report_pack(txns: DataFrame, agents: DataFrame, customers: DataFrame, as_of: dt.date,
                agency_product: str, remit_product: str) -> dict[str, DataFrame]:
    return {
        "Monthly_KPIs": monthly_kpis(txns),
        "Failure_Summary": failure_summary(txns),
        "Agent_Scorecard": agent_summary(txns, agents, as_of, agency_product),
        "Corridor_Performance": corridor_performance(txns, remit_product),
        "Customer_Segments": customer_segments(txns, customers),
    }


def write_pack(datasets: dict[str, DataFrame], out_dir: str, fmt: str = "parquet") -> dict[str, str]:
    """Write each dataset to ``out_dir/<name>`` (CSV gets a header); returns the paths."""
    paths = {}
    for name, df in datasets.items():
        path = f"{out_dir}/{name}"
        w = df.write.mode("overwrite").format(fmt)
        if fmt == "csv":
            w = w.option("header", True)
        w.save(path)
        paths[name] = path
    return paths
