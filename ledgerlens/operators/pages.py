"""Dashboard pages and the export pack, each from one pass over the fact (``operators.shared``).

The tables are those of ``dashboards`` and ``export``; here a page's tables are parts of one shared aggregation, and what is
left to do for each (ratios, joins to small dimensions, prior periods) happens on its groups.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import kpi
from ledgerlens.operators import dashboards, export, measures
from ledgerlens.operators.shared import ROWS, Part, count_if, gather
from ledgerlens.params import add_months, prior_month_bounds
from ledgerlens.sources.star import Star

D = "TRANSACTION_DATE"
MONTH = measures.MONTH


def _usd() -> tuple[str, Column]:
    return "sum", F.col("TXN_AMOUNT_USD")


def _ok() -> tuple[str, Column]:
    return count_if(kpi.status_is(kpi.SUCCESS))


def _failed() -> tuple[str, Column]:
    return count_if(kpi.status_is(kpi.FAILED))


def _pct(part: str, whole: str, digits: int) -> Column:
    return kpi.rnd(kpi.pct(part, whole), digits)


def _month_text() -> Column:
    return kpi.month_key(D)


def _cross_border(remit_product: str) -> Column:
    return (F.col("PRODUCT") == F.lit(remit_product)) & (F.col("SOURCE_COUNTRY") != F.col("DEST_COUNTRY"))


# ---------------------------------------------------------------- base measures as a part
def base_part(keys: dict[str, Column], where: Column | None = None, finish=lambda df: df) -> Part:
    """M01-M09 per ``keys``; ``finish`` gets the table ``measures.base_measures`` gives."""
    aggs = {
        "total_transactions": ROWS, "successful_transactions": _ok(), "failed_transactions": _failed(), "total_value_usd": _usd(),
        "total_fee_revenue_local": ("sum", F.col("FEE_AMOUNT_LOCAL")), "_secs": ("sum", F.col("PROCESSING_TIME_SECS")),
        "_timed": ("count", F.col("PROCESSING_TIME_SECS")), "_blank": ("max", F.when(F.col("CUSTOMER_ID").isNull(), 1).otherwise(0)),
    }

    def whole(df: DataFrame) -> DataFrame:
        rate = {f"{n}_rate_pct": F.coalesce(kpi.ratio(f"{c}_transactions", "total_transactions"), F.lit(0.0)) * F.lit(100.0) for n, c in (("success", "successful"), ("failure", "failed"))}
        return finish(df.select(
            *keys, "total_transactions", "successful_transactions", "failed_transactions", "total_value_usd", "total_fee_revenue_local",
            (kpi.ratio("_secs", "_timed") / F.lit(60.0)).alias("avg_processing_time_mins"), (F.col("_known") + F.col("_blank")).alias("unique_customers"),
            *[c.alias(n) for n, c in rate.items()],
        ))

    return Part(keys, aggs, where, {"_known": F.col("CUSTOMER_ID")}, whole)


# ---------------------------------------------------------------- P6
def pack_parts(star: Star, as_of: dt.date, agency_product: str, remit_product: str) -> dict[str, Part]:
    start, end = prior_month_bounds(as_of)
    agency = kpi.in_range(D, start, end) & (F.col("PRODUCT") == F.lit(agency_product)) & F.col("AGENT_ID").isNotNull() & (F.col("AGENT_ID") != "")
    return {
        "Monthly_KPIs": Part(
            {MONTH: kpi.month_date(D), "PRODUCT": F.col("PRODUCT"), "SUBSIDIARY": F.col("SUBSIDIARY")},
            {"total_transactions": ROWS, "successful_transactions": _ok(), "total_value_usd": _usd()}, None, {"known_customers": F.col("CUSTOMER_ID")},
            lambda df: export.monthly_kpis(star.transactions, df),
        ),
        "Failure_Summary": Part(
            {c: F.col(c) for c in ("PRODUCT", "CHANNEL", "FAILURE_DESCRIPTION", "FAILURE_CATEGORY")}, {"FailureCount": ROWS, "_v": _usd()},
            kpi.status_is(kpi.FAILED) & (F.col("FAILURE_DESCRIPTION") != ""), {},
            lambda df: df.select("PRODUCT", "CHANNEL", "FAILURE_DESCRIPTION", "FAILURE_CATEGORY", "FailureCount", kpi.rnd("_v", 2).alias("FailedValueUSD")).orderBy(F.col("FAILURE_CATEGORY").desc()),
        ),
        "Agent_Scorecard": Part(
            {"AGENT_ID": F.col("AGENT_ID")},
            {"TotalTxns": ROWS, "_s": _ok(), "_v": ("sum", F.col("TXN_AMOUNT_LOCAL")), "FloatFails": count_if(F.col("FAILURE_CODE") == "INSUFF_FLOAT")},
            agency, {"Customers": F.col("CUSTOMER_ID")}, lambda df: export.agent_sheet(df, star.agents),
        ),
        "Corridor_Performance": Part(
            {"Corridor": F.concat("SOURCE_COUNTRY", F.lit("->"), "DEST_COUNTRY"), "Month": _month_text()}, {"Txns": ROWS, "_v": _usd(), "_s": _ok()},
            _cross_border(remit_product), {},
            lambda df: df.select("Corridor", "Month", "Txns", kpi.rnd("_v", 2).alias("ValueUSD"), _pct("_s", "Txns", 1).alias("SR")).orderBy(F.col("Month").desc(), F.col("ValueUSD").desc()),
        ),
        "Customer_Segments": Part(
            {"CUSTOMER_ID": F.col("CUSTOMER_ID")}, {"_n": ROWS, "_s": _ok(), "_v": _usd()}, kpi.status_is(kpi.SUCCESS), {},
            lambda df: export.segment_sheet(df, star.customers),
        ),
    }


def report_pack(star: Star, as_of: dt.date, agency_product: str, remit_product: str, folder: str | None = None) -> dict[str, DataFrame]:
    """The five datasets of ``export.report_pack`` from one pass (``gather``)."""
    return gather(star.transactions, pack_parts(star, as_of, agency_product, remit_product), folder)


# ---------------------------------------------------------------- D1-D5
def executive_parts(star: Star, as_of: dt.date) -> dict[str, Part]:
    start, end = prior_month_bounds(as_of)
    months = kpi.in_range(D, add_months(start, -12), end)  # the month, the one before and the one a year before
    return {
        "kpi_cards": base_part({MONTH: kpi.month_date(D)}, months, lambda df: dashboards.cards_of(df, start)),
        "product_table": base_part({MONTH: kpi.month_date(D), "PRODUCT": F.col("PRODUCT")}, months, lambda df: dashboards.products_of(df, star.kpi_targets, start)),
        "subsidiary_value": Part(
            {"SUBSIDIARY": F.col("SUBSIDIARY")}, {"total_value_usd": _usd()}, None, {}, lambda df: measures.dense_rank_desc(df, "total_value_usd", "subsidiary_rank_by_value")
        ),
    }


def product_channel_parts() -> dict[str, Part]:
    def share(df: DataFrame) -> DataFrame:
        whole = F.sum("total_transactions").over(Window.partitionBy())  # over one row per channel
        return df.withColumn("share_pct", kpi.rnd(kpi.pct("total_transactions", whole), 2))

    rate = _pct("_s", "total_transactions", 2).alias("success_rate_pct")
    return {
        "month_product": Part({"month": _month_text(), "PRODUCT": F.col("PRODUCT")}, {"total_transactions": ROWS, "_s": _ok()}, None, {},
                              lambda df: df.select("month", "PRODUCT", "total_transactions", rate)),
        "product_scatter": Part({"PRODUCT": F.col("PRODUCT")}, {"total_transactions": ROWS, "_s": _ok(), "_v": _usd()}, None, {},
                                lambda df: df.select("PRODUCT", "total_transactions", rate, kpi.rnd("_v", 2).alias("total_value_usd"))),
        "channel_share": Part({"CHANNEL": F.col("CHANNEL")}, {"total_transactions": ROWS}, None, {}, share),
        "product_status": Part({"PRODUCT": F.col("PRODUCT"), "STATUS": F.col("STATUS")}, {"total_transactions": ROWS}),
    }


def failure_parts() -> dict[str, Part]:
    failed = kpi.status_is(kpi.FAILED)
    rate = kpi.rnd(F.coalesce(kpi.pct("_f", "total_transactions"), F.lit(0.0)), 2).alias("failure_rate_pct")
    return {
        "failure_overview": Part({}, {"total_transactions": ROWS, "_f": _failed(), "_v": ("sum", F.when(failed, F.col("TXN_AMOUNT_USD")))}, None, {},
                                 lambda df: df.select(rate, kpi.rnd(F.coalesce("_v", F.lit(0)), 2).alias("total_failed_value_usd"))),
        "failures_by_description": Part({"FAILURE_DESCRIPTION": F.col("FAILURE_DESCRIPTION")}, {"failed_transactions": ROWS}, failed),
        "failed_value_by_category": Part({"FAILURE_CATEGORY": F.col("FAILURE_CATEGORY")}, {"_v": _usd()}, failed, {},
                                         lambda df: df.select("FAILURE_CATEGORY", kpi.rnd("_v", 2).alias("failed_value_usd"))),
        "failure_rate_by_month_channel": Part({"month": _month_text(), "CHANNEL": F.col("CHANNEL")}, {"total_transactions": ROWS, "_f": _failed()}, None, {},
                                              lambda df: df.select("month", "CHANNEL", "total_transactions", rate)),
    }


def corridor_parts(remit_product: str) -> dict[str, Part]:
    mine, senders = _cross_border(remit_product), {"unique_senders": F.col("CUSTOMER_ID")}
    fee = kpi.as_double(F.coalesce("FEE_AMOUNT_LOCAL", F.lit(0))) / F.nullif(kpi.as_double("TXN_AMOUNT_LOCAL"), F.lit(0.0))
    return {
        "destination_volume": Part({"DEST_COUNTRY": F.col("DEST_COUNTRY")}, {"_v": _usd()}, mine, {}, lambda df: df.select("DEST_COUNTRY", kpi.rnd("_v", 2).alias("cross_border_volume_usd"))),
        "corridor_cards": Part({}, {"_v": _usd()}, mine, senders, lambda df: df.select(kpi.rnd(F.coalesce("_v", F.lit(0)), 2).alias("cross_border_volume_usd"), "unique_senders")),
        "corridor_table": Part(
            {"corridor": measures.corridor_column()},
            {"total_transactions": ROWS, "_s": _ok(), "_v": _usd(), "_fee": ("sum", fee), "_fees": ("count", fee), "_secs": ("sum", F.col("PROCESSING_TIME_SECS")), "_timed": ("count", F.col("PROCESSING_TIME_SECS"))},
            mine, senders,
            lambda df: df.select(
                "corridor", "total_transactions", _pct("_s", "total_transactions", 1).alias("success_rate_pct"), kpi.rnd("_v", 2).alias("value_usd"),
                kpi.rnd(kpi.ratio("_fee", "_fees") * F.lit(100.0), 3).alias("avg_fee_rate_pct"),
                kpi.rnd(kpi.ratio("_secs", "_timed") / F.lit(60.0), 1).alias("avg_proc_mins"), "unique_senders",
            ),
        ),
    }


def agent_parts(agency_product: str) -> dict[str, Part]:
    mine = F.col("PRODUCT") == F.lit(agency_product)
    active = kpi.status_is(kpi.SUCCESS) & F.col("AGENT_ID").isNotNull() & (F.col("AGENT_ID") != "") & mine
    return {
        "agent_cards": Part(
            {}, {"_s": _ok(), "_fees": ("sum", F.when(mine, F.col("FEE_AMOUNT_LOCAL")))}, None, {"active_agents": F.when(active, F.col("AGENT_ID"))},
            lambda df: df.select("active_agents", kpi.rnd(F.coalesce(kpi.ratio("_s", "active_agents"), F.lit(0.0)), 2).alias("txns_per_active_agent"), kpi.rnd(F.coalesce("_fees", F.lit(0)), 2).alias("total_commission_local")),
        ),
        "per_agent": Part({"AGENT_ID": F.col("AGENT_ID")}, {"_n": ROWS, "_v": ("sum", F.col("TXN_AMOUNT_LOCAL"))}, mine & kpi.non_blank("AGENT_ID")),
    }


def executive_page(star: Star, as_of: dt.date, folder: str | None = None) -> dict[str, DataFrame]:
    """KPI cards, product table, subsidiaries by value."""
    return gather(star.transactions, executive_parts(star, as_of), folder)


def product_channel_page(star: Star, folder: str | None = None) -> dict[str, DataFrame]:
    """Month x product, scatter, channel mix, product x status."""
    return gather(star.transactions, product_channel_parts(), folder)


def failure_page(star: Star, folder: str | None = None) -> dict[str, DataFrame]:
    """D3: cards, failures by description, value by category, rate by month and channel."""
    return gather(star.transactions, failure_parts(), folder)


def corridor_page(star: Star, remit_product: str, folder: str | None = None) -> dict[str, DataFrame]:
    """Destinations, cards, corridor table."""
    return gather(star.transactions, corridor_parts(remit_product), folder)


def agent_page(star: Star, agency_product: str, folder: str | None = None) -> dict[str, DataFrame]:
    """Cards, region totals, county values."""
    out = gather(star.transactions, agent_parts(agency_product), folder)
    per = out.pop("per_agent")
    out["region_totals"] = dashboards.regions_of(per, star.agents)
    out["county_value"] = dashboards.counties_of(per, star.agents)
    return out
