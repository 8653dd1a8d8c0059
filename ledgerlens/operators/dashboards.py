"""Dashboard datasets (D1-D5): the tables behind each report page's visuals.

The drawing is not built; each visual's data is a small aggregate derived
from the measure layer, so a page is a handful of grouped scans of the fact.
Windows without a partition appear only over such aggregates (one row per
channel, product or partition), never over transactions.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import kpi
from ledgerlens.operators import measures
from ledgerlens.operators.worksheet import BLANK, listed_only
from ledgerlens.params import add_months, prior_month_bounds

D = "TRANSACTION_DATE"
M = measures.MONTH


# ---------------------------------------------------------------- D1 executive
def kpi_cards(txns: DataFrame, as_of: dt.date) -> DataFrame:
    """One row for the last full month: volume, success rate, value, customers, MoM arrow, YoY growth."""
    start, end = prior_month_bounds(as_of)
    # the month, the one before and the one a year before
    return cards_of(measures.monthly_measures(kpi.date_window(txns, add_months(start, -12), end), []), start)


def cards_of(monthly: DataFrame, start: dt.date) -> DataFrame:
    """The cards of month ``start`` from the base measures of it, the month before and the one a year before."""
    p = measures.prior_period_measures(monthly, [])
    return p.filter(F.col(M) == F.lit(start)).select(
        M,
        "total_transactions",
        kpi.rnd("success_rate_pct", 2).alias("success_rate_pct"),
        kpi.rnd("total_value_usd", 2).alias("total_value_usd"),
        "unique_customers",
        "mom_arrow",
        kpi.rnd("yoy_volume_growth_pct", 1).alias("yoy_volume_growth_pct"),
    )


def product_table(txns: DataFrame, targets: DataFrame, as_of: dt.date) -> DataFrame:
    """Per product, last full month: volume, success rate, MoM arrow and volume RAG vs the summed targets.

    Products with transactions now, a month or a year ago, or with a target for
    the month; one without sales has blank volume, rate 0 and RED.
    """
    start, end = prior_month_bounds(as_of)
    return products_of(measures.monthly_measures(kpi.date_window(txns, add_months(start, -12), end), ["PRODUCT"]), targets, start)


def products_of(monthly: DataFrame, targets: DataFrame, start: dt.date) -> DataFrame:
    """The product table of month ``start`` from the base measures per month and product."""
    p = measures.prior_period_measures(monthly, ["PRODUCT"]).filter(F.col(M) == F.lit(start))
    t = targets.filter(F.to_date("TARGET_MONTH") == F.lit(start)).groupBy(F.col("PRODUCT").alias("_p")).agg(F.sum("TARGET_VOLUME").alias("_tv"))
    j = p.join(t, F.col("PRODUCT") == F.col("_p"), "full")
    att = F.coalesce(kpi.ratio("total_transactions", "_tv"), F.lit(0.0)) * F.lit(100.0)
    return j.select(
        F.coalesce("PRODUCT", "_p").alias("PRODUCT"),
        "total_transactions",
        kpi.rnd(F.coalesce("success_rate_pct", F.lit(0.0)), 2).alias("success_rate_pct"),
        F.coalesce("mom_arrow", F.lit(measures.EM_DASH)).alias("mom_arrow"),
        F.when(att >= 95, "GREEN").when(att >= 80, "AMBER").otherwise("RED").alias("volume_rag"),
    )


def subsidiary_value(txns: DataFrame) -> DataFrame:
    """Subsidiary x total value over all history, with its dense rank (bar coloured by rank)."""
    b = txns.groupBy("SUBSIDIARY").agg(F.sum("TXN_AMOUNT_USD").alias("total_value_usd"))
    return measures.dense_rank_desc(b, "total_value_usd", "subsidiary_rank_by_value")


# ---------------------------------------------------------------- D2 product & channel
def month_product(txns: DataFrame) -> DataFrame:
    """Product x month: volume and success rate (the matrix and the combo chart), every product of the data."""
    return txns.groupBy(kpi.month_key(D).alias("month"), "PRODUCT").agg(
        F.count(F.lit(1)).alias("total_transactions"),
        kpi.rnd(kpi.pct(kpi.successes(), F.count(F.lit(1))), 2).alias("success_rate_pct"),
    )


def month_product_matrix(txns: DataFrame, products: list[str | None]) -> DataFrame:
    """Month rows x product columns of transaction counts (explicit product list, an unlisted product fails; empty -> 0)."""
    cells = [kpi.count_when(F.col("PRODUCT").eqNullSafe(F.lit(p))) for p in products]
    cells = [(listed_only(products, c) if i == 0 else c).alias(BLANK if p is None else p) for i, (p, c) in enumerate(zip(products, cells))]
    return txns.groupBy(kpi.month_key(D).alias("month")).agg(*cells)


def product_scatter(txns: DataFrame) -> DataFrame:
    """Per product over all history: volume, success rate and value (scatter)."""
    return txns.groupBy("PRODUCT").agg(
        F.count(F.lit(1)).alias("total_transactions"),
        kpi.rnd(kpi.pct(kpi.successes(), F.count(F.lit(1))), 2).alias("success_rate_pct"),
        kpi.rnd(F.sum("TXN_AMOUNT_USD"), 2).alias("total_value_usd"),
    )


def channel_share(txns: DataFrame) -> DataFrame:
    """Channel mix: transactions per channel and the share of all transactions (%)."""
    c = txns.groupBy("CHANNEL").agg(F.count(F.lit(1)).alias("total_transactions"))
    total = F.sum("total_transactions").over(Window.partitionBy())  # over one row per channel
    return c.withColumn("share_pct", kpi.rnd(kpi.pct("total_transactions", total), 2))


def product_status(txns: DataFrame) -> DataFrame:
    """Product x status split (stacked bar)."""
    return txns.groupBy("PRODUCT", "STATUS").agg(F.count(F.lit(1)).alias("total_transactions"))


# ---------------------------------------------------------------- D3 failures
def failure_overview(txns: DataFrame) -> DataFrame:
    """Cards: failure rate % and total failed value (USD)."""
    return txns.agg(
        kpi.rnd(F.coalesce(kpi.pct(kpi.failures(), F.count(F.lit(1))), F.lit(0.0)), 2).alias("failure_rate_pct"),
        kpi.rnd(F.coalesce(F.sum(F.when(kpi.status_is(kpi.FAILED), F.col("TXN_AMOUNT_USD"))), F.lit(0)), 2)
        .alias("total_failed_value_usd"),
    )


def failures_by_description(txns: DataFrame) -> DataFrame:
    return (
        txns.filter(kpi.status_is(kpi.FAILED))
        .groupBy("FAILURE_DESCRIPTION")
        .agg(F.count(F.lit(1)).alias("failed_transactions"))
    )


def failed_value_by_category(txns: DataFrame) -> DataFrame:
    return (
        txns.filter(kpi.status_is(kpi.FAILED))
        .groupBy("FAILURE_CATEGORY")
        .agg(kpi.rnd(F.sum("TXN_AMOUNT_USD"), 2).alias("failed_value_usd"))
    )


def failure_rate_by_month_channel(txns: DataFrame) -> DataFrame:
    return txns.groupBy(kpi.month_key(D).alias("month"), "CHANNEL").agg(
        F.count(F.lit(1)).alias("total_transactions"),
        kpi.rnd(F.coalesce(kpi.pct(kpi.failures(), F.count(F.lit(1))), F.lit(0.0)), 2).alias("failure_rate_pct"),
    )


# ---------------------------------------------------------------- D4 corridors
def _cross_border(txns: DataFrame, remit_product: str) -> DataFrame:
    return txns.filter((F.col("PRODUCT") == F.lit(remit_product)) & (F.col("SOURCE_COUNTRY") != F.col("DEST_COUNTRY")))


def destination_volume(txns: DataFrame, remit_product: str) -> DataFrame:
    """Map: cross-border value by destination country."""
    return _cross_border(txns, remit_product).groupBy("DEST_COUNTRY").agg(
        kpi.rnd(F.sum("TXN_AMOUNT_USD"), 2).alias("cross_border_volume_usd")
    )


def corridor_cards(txns: DataFrame, remit_product: str) -> DataFrame:
    """Cards: total cross-border volume and unique senders of the remittance product."""
    return _cross_border(txns, remit_product).agg(
        kpi.rnd(F.coalesce(F.sum("TXN_AMOUNT_USD"), F.lit(0)), 2).alias("cross_border_volume_usd"),
        F.countDistinct("CUSTOMER_ID").alias("unique_senders"),
    )


def corridor_table(txns: DataFrame, remit_product: str) -> DataFrame:
    """Corridor | txns | SR % | value | avg fee rate % | avg minutes | unique senders, all history."""
    local = F.col("TXN_AMOUNT_LOCAL")
    return _cross_border(txns, remit_product).groupBy(measures.corridor_column().alias("corridor")).agg(
        F.count(F.lit(1)).alias("total_transactions"),
        kpi.rnd(kpi.pct(kpi.successes(), F.count(F.lit(1))), 1).alias("success_rate_pct"),
        kpi.rnd(F.sum("TXN_AMOUNT_USD"), 2).alias("value_usd"),
        kpi.rnd(F.avg(kpi.as_double(F.coalesce("FEE_AMOUNT_LOCAL", F.lit(0))) / F.nullif(kpi.as_double(local), F.lit(0.0)))
                * F.lit(100.0), 3).alias("avg_fee_rate_pct"),
        kpi.rnd(kpi.avg_exact("PROCESSING_TIME_SECS") / F.lit(60.0), 1).alias("avg_proc_mins"),
        F.countDistinct("CUSTOMER_ID").alias("unique_senders"),
    )


# ---------------------------------------------------------------- D5 agents
def agent_cards(txns: DataFrame, agency_product: str) -> DataFrame:
    """Cards: active agents, successful transactions per active agent, total commission (agency fees)."""
    fees = F.sum(F.when(F.col("PRODUCT") == F.lit(agency_product), F.col("FEE_AMOUNT_LOCAL")))
    a = measures.agent_activity_measures(txns, [], agency_product, [fees.alias("_fees")])
    return a.select(
        "active_agents",
        kpi.rnd("txns_per_active_agent", 2).alias("txns_per_active_agent"),
        kpi.rnd(F.coalesce("_fees", F.lit(0)), 2).alias("total_commission_local"),
    )


def _agency_per_agent(txns: DataFrame, agency_product: str) -> DataFrame:
    return (
        txns.filter((F.col("PRODUCT") == F.lit(agency_product)) & kpi.non_blank("AGENT_ID"))
        .groupBy("AGENT_ID")
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("TXN_AMOUNT_LOCAL").alias("_v"))
    )


def region_totals(txns: DataFrame, agents: DataFrame, agency_product: str) -> DataFrame:
    """Agency transactions per agent region (aggregated per agent before the join)."""
    return regions_of(_agency_per_agent(txns, agency_product), agents)


def regions_of(per_agent: DataFrame, agents: DataFrame) -> DataFrame:
    j = per_agent.join(agents.select("AGENT_ID", "REGION"), "AGENT_ID")
    return j.groupBy("REGION").agg(F.sum("_n").alias("total_transactions"), F.countDistinct("AGENT_ID").alias("agents"))


def county_value(txns: DataFrame, agents: DataFrame, agency_product: str) -> DataFrame:
    """Agency local value per agent county (map)."""
    return counties_of(_agency_per_agent(txns, agency_product), agents)


def counties_of(per_agent: DataFrame, agents: DataFrame) -> DataFrame:
    j = per_agent.join(agents.select("AGENT_ID", "COUNTY"), "AGENT_ID")
    return j.groupBy("COUNTY").agg(kpi.rnd(F.sum("_v"), 2).alias("total_value_local"))
