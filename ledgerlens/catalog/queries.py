"""Query registry: ``name -> (spark, sf_dir) -> DataFrame`` over the synthetic star.

Every entry reads the given tables in full (no row caps or id subsets); only
top-k reports keep their limit, because the limit is the feature.
Output columns are canonicalised for the comparison with the DuckDB oracle:
counts as BIGINT (as DOUBLE where they may be blank), amounts and rates as DOUBLE, dates as ISO text (the two engines
hand DECIMAL and DATE to pandas as different types), booleans and strings
unchanged -- identical whether results are compared as Python values or as
pandas columns. The operators themselves
return natural types (BIGINT counts, DATE months, DECIMAL amounts).
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.catalog.oracle import BLANKABLE
from ledgerlens.functions import kpi
from ledgerlens.operators import cohort, context, dashboards, export, measures, modelled, pages, reports, rfm, stats, worksheet
from ledgerlens.params import ReportParams
from ledgerlens.session import application_id, configure, shared_root
from ledgerlens.sources import members, schemas, topk
from ledgerlens.sources.history import CustomerHistory
from ledgerlens.sources.labels import labels, labels_of, values
from ledgerlens.sources.rollup import GRAINS, rollup
from ledgerlens.sources.star import Star, conform, events_as_transactions, materialized_star, star_from_files, star_from_tpch
from ledgerlens.sources.tracked import TrackedStar

P = ReportParams()
EVENTS_AS_OF = dt.date(2024, 1, 31)
# The 28-day failure window holds only a handful of rows in the synthetic data
# (its last month is partial), so the registered R03 uses a wider window.
R03_WINDOW_DAYS = 256  # four periods of 64 days: one recent, three prior
R03_RECENT_DAYS = 64
R09A_AS_OF = dt.date(1996, 1, 15)
# One flagship product on two channels over 90 days is a few rows in the test
# data; the registered A/B test reads a year.
P2_DAYS = 365

PAIR = ["PRODUCT", "SUBSIDIARY"]

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}


def normalise(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.LongType)):
            c = c.cast("double" if f.name in BLANKABLE else "bigint")
        elif isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _star(spark: SparkSession, sf_dir: str) -> Star:
    """The star for ``sf_dir``: derived from the TPC-H-like tables, materialised once.

    With ``ledgerlens.star.materialize`` on (the default) the derived fact is
    written month-partitioned under the session's shared checkpoint folder and
    reused by every report, as a production fact table would be; off, every
    report re-derives it from the source tables.
    """
    configure(spark)
    if spark.conf.get("ledgerlens.star.materialize", "true").lower() != "true":
        return star_from_tpch(spark, sf_dir)
    return materialized_star(spark, sf_dir)


def register(name: str):
    def deco(fn: Callable[[Star, SparkSession, str], DataFrame]) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return normalise(fn(_star(spark, sf_dir), spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        REGISTRY[name] = run
        return run

    return deco


# ------------------------------------------------------------------ R series
@register("r01_monthly_product_performance")
def _r01(s: Star, spark, sf_dir):
    return reports.monthly_product_performance(s.transactions, P.as_of, P.home_subsidiary, months=3, monthly=rollup(s, "product_category"))


@register("r01_monthly_product_performance_all_subsidiaries")
def _r01_all(s: Star, spark, sf_dir):
    return reports.monthly_product_performance(s.transactions, P.as_of, None, months=12, monthly=rollup(s, "product_category"))


@register("r02_kpi_rag_missing_target")
def _r02_red(s: Star, spark, sf_dir):
    """R02 where a pair without a target is RED, over targets that leave out one pair."""
    targets = s.kpi_targets.filter(~((F.col("PRODUCT") == P.remit_product) & (F.col("SUBSIDIARY_NAME") == P.home_subsidiary)))
    return reports.kpi_rag(s.transactions, targets, P.as_of, missing_target="red")


@register("r02_kpi_rag")
def _r02(s: Star, spark, sf_dir):
    return reports.kpi_rag(s.transactions, s.kpi_targets, P.as_of)


@register("r03_failure_spikes")
def _r03(s: Star, spark, sf_dir):
    return reports.failure_spikes(
        s.transactions, P.as_of, window_days=R03_WINDOW_DAYS, recent_days=R03_RECENT_DAYS
    )


@register("r04_agent_scorecard")
def _r04(s: Star, spark, sf_dir):
    return reports.agent_scorecard(s.transactions, s.agents, P.as_of, P.agency_product)


@register("r05_corridor_analysis")
def _r05(s: Star, spark, sf_dir):
    return reports.corridor_analysis(s.transactions, P.as_of, P.remit_product)


@register("r06_rolling_success_rate")
def _r06(s: Star, spark, sf_dir):
    return reports.rolling_success_rate(s.transactions, P.as_of, monthly=rollup(s, "product_subsidiary"))


@register("r07_segment_revenue")
def _r07(s: Star, spark, sf_dir):
    return reports.segment_revenue(s.transactions, s.customers, P.as_of)


@register("r08_channel_product_matrix")
def _r08(s: Star, spark, sf_dir):
    return reports.channel_product_matrix(s.transactions, P.as_of)


@register("r09a_cohort_retention")
def _r09a(s: Star, spark, sf_dir):
    # Synthetic customers are all acquired in the first months of history, so the
    # report is anchored where its 8-month cohort bound actually selects cohorts.
    return cohort.cohort_retention(s.transactions, R09A_AS_OF, cohort_months=8)


@register("r09b_cohort_retention_all")
def _r09b(s: Star, spark, sf_dir):
    return cohort.cohort_retention(s.transactions, cohort_months=None)


@register("r10_subsidiary_benchmark")
def _r10(s: Star, spark, sf_dir):
    return reports.subsidiary_benchmark(s.transactions, P.as_of, P.remit_product)


@register("r11_fee_profitability")
def _r11(s: Star, spark, sf_dir):
    return reports.fee_profitability(s.transactions, s.forex_rates, P.as_of)


@register("r12_activity_heatmap")
def _r12(s: Star, spark, sf_dir):
    return reports.activity_heatmap(events_as_transactions(spark, sf_dir), EVENTS_AS_OF)


@register("p5_cohort_grid")
def _p5(s: Star, spark, sf_dir):
    return cohort.cohort_grid(s.transactions)


# ------------------------------------------------------------------ P series
@register("p1_zscore_anomalies")
def _p1(s: Star, spark, sf_dir):
    return stats.zscore_anomalies(s.transactions, monthly=rollup(s, "product_subsidiary"))


@register("p1b_complete_months")
def _p1b(s: Star, spark, sf_dir):
    return stats.complete_months(s.transactions)


@register("p2_ab_test_success_rate")
def _p2(s: Star, spark, sf_dir):
    return stats.ab_test_success_rate(
        s.transactions, P.control_channel, P.treatment_channel, P.flagship_product, P.as_of, days=P2_DAYS
    )


@register("p3a_rfm_features")
def _p3a(s: Star, spark, sf_dir):
    return rfm.rfm_features(s.transactions, s.customers, P.as_of)


@register("p3bc_rfm_scores")
def _p3bc(s: Star, spark, sf_dir):
    return rfm.rfm_scores(rfm.rfm_features(s.transactions, s.customers, P.as_of))


@register("p3d_rfm_summary")
def _p3d(s: Star, spark, sf_dir):
    return rfm.rfm_summary(rfm.rfm_scores(rfm.rfm_features(s.transactions, s.customers, P.as_of)))


@register("p3d_revenue_at_risk")
def _p3d_risk(s: Star, spark, sf_dir):
    return rfm.revenue_at_risk(rfm.rfm_scores(rfm.rfm_features(s.transactions, s.customers, P.as_of)))


@register("p4_linear_forecast")
def _p4(s: Star, spark, sf_dir):
    return stats.linear_forecast(s.transactions, P.as_of, monthly=rollup(s, "product_subsidiary"))


@register("p6a_monthly_kpis")
def _p6a(s: Star, spark, sf_dir):
    return export.monthly_kpis(s.transactions, rollup(s, "product_subsidiary"))


@register("p6b_failure_summary")
def _p6b(s: Star, spark, sf_dir):
    return export.failure_summary(s.transactions)


@register("p6c_agent_summary")
def _p6c(s: Star, spark, sf_dir):
    return export.agent_summary(s.transactions, s.agents, P.as_of, P.agency_product)


@register("p6d_corridor_performance")
def _p6d(s: Star, spark, sf_dir):
    return export.corridor_performance(s.transactions, P.remit_product)


@register("p6e_customer_segments")
def _p6e(s: Star, spark, sf_dir):
    return export.customer_segments(s.transactions, s.customers)


# ------------------------------------------------------------------ X series
@register("x1_last_month_volume")
def _x1(s: Star, spark, sf_dir):
    return worksheet.last_month_volume(s.transactions, P.as_of, P.home_subsidiary, labels=labels(s, ["PRODUCT"]))


@register("x2_last_month_success_rate")
def _x2(s: Star, spark, sf_dir):
    return worksheet.last_month_success_rate(s.transactions, P.as_of, labels=labels(s, PAIR))


@register("x3_volume_rag")
def _x3(s: Star, spark, sf_dir):
    return worksheet.volume_rag(s.transactions, s.kpi_targets, P.as_of, labels=labels(s, PAIR))


@register("x4_top_failures")
def _x4(s: Star, spark, sf_dir):
    return worksheet.top_failures(s.transactions, P.as_of, n=5)


@register("x5_channel_product_sr_matrix")
def _x5(s: Star, spark, sf_dir):
    return worksheet.channel_product_sr_matrix(s.transactions, list(P.products))


@register("x5_channel_product_sr_matrix_of_labels")
def _x5_labels(s: Star, spark, sf_dir):
    """X5 wide, its columns from the label dictionary."""
    return worksheet.channel_product_sr_matrix(s.transactions, values(s, "PRODUCT"))


@register("x5_channel_product_sr")
def _x5_long(s: Star, spark, sf_dir):
    """X5 in long form: every channel and product of the data."""
    return worksheet.channel_product_sr(s.transactions)


@register("x6_mom_arrow")
def _x6(s: Star, spark, sf_dir):
    return worksheet.mom_arrow(s.transactions, P.as_of, labels=labels(s, ["PRODUCT"]))


@register("x7_float_utilisation")
def _x7(s: Star, spark, sf_dir):
    return worksheet.float_utilisation(s.transactions, s.agents, P.as_of)


@register("x8_corridor_month_matrix")
def _x8(s: Star, spark, sf_dir):
    return worksheet.corridor_month_matrix(s.transactions, P.remit_product)


@register("x8_corridor_month_grid")
def _x8_grid(s: Star, spark, sf_dir):
    """X8 with the zeros of the spilled matrix."""
    return worksheet.corridor_month_grid(worksheet.corridor_month_matrix(s.transactions, P.remit_product))


@register("x9_ytd_running_total")
def _x9(s: Star, spark, sf_dir):
    return worksheet.ytd_running_total(s.transactions, P.as_of, P.home_subsidiary)


@register("x10_rolling_3m_success_rate")
def _x10(s: Star, spark, sf_dir):
    k = export.monthly_kpis(s.transactions, rollup(s, "product_subsidiary")).select("Month", "PRODUCT", "SUBSIDIARY", "SuccessRate")
    r = worksheet.rolling_mean(k, "SuccessRate", "Month", ["PRODUCT", "SUBSIDIARY"], rows=3, out="_r")
    return r.withColumn("Rolling3M_SR", kpi.rnd("_r", 2)).drop("_r")


# ------------------------------------------------------------------ M series
def _monthly(s: Star, by: list[str]):
    """The base measures per month, from the kept rollup."""
    return rollup(s, "_".join(by).lower() or "all").drop("known_customers")


@register("m01_m09_base_measures")
def _m01(s: Star, spark, sf_dir):
    return _monthly(s, ["PRODUCT"])


@register("m10_m21_prior_period_growth")
def _m10(s: Star, spark, sf_dir):
    return measures.prior_period_measures(_monthly(s, ["PRODUCT", "SUBSIDIARY"]), ["PRODUCT", "SUBSIDIARY"])


FINE = ["PRODUCT", "SUBSIDIARY", "COUNTRY", "CHANNEL"]


@register("m10_m21_prior_period_growth_fine")
def _m10_fine(s: Star, spark, sf_dir):
    """A grain with gaps: groups that have no transactions in some months."""
    return measures.prior_period_measures(_monthly(s, FINE), FINE)


@register("m22_m26_attainment_rag")
def _m22(s: Star, spark, sf_dir):
    return measures.attainment_measures(_monthly(s, ["PRODUCT", "SUBSIDIARY"]), s.kpi_targets)


@register("m22_m26_attainment_without_sales")
def _m22_gap(s: Star, spark, sf_dir):
    """Targets of the home subsidiary only sold by others: every target of it is missed."""
    sold = _monthly(s, ["PRODUCT", "SUBSIDIARY"]).filter(F.col("SUBSIDIARY") != P.home_subsidiary)
    return measures.attainment_measures(sold, s.kpi_targets)


@register("m27_m29_rolling_3m")
def _m27(s: Star, spark, sf_dir):
    r = measures.rolling_measures(_monthly(s, ["PRODUCT", "SUBSIDIARY"]), ["PRODUCT", "SUBSIDIARY"])
    # windowed means of doubles depend on summation order in the last bits: compare at 6 dp
    for c in ("rolling_3m_avg_success_rate", "rolling_3m_avg_transactions", "sr_vs_rolling_3m"):
        r = r.withColumn(c, kpi.rnd(c, 6))
    return r


@register("m30_m32_ytd")
def _m30(s: Star, spark, sf_dir):
    return measures.ytd_measures(_monthly(s, ["PRODUCT"]), ["PRODUCT"])


@register("m33_m34_active_agents")
def _m33(s: Star, spark, sf_dir):
    return measures.agent_activity_measures(measures.with_month(s.transactions), [measures.MONTH], P.agency_product)


@register("m35_float_utilisation_ratio")
def _m35(s: Star, spark, sf_dir):
    return measures.float_utilisation_ratio(s.transactions, s.agents)


@register("m36_cross_border_volume")
def _m36(s: Star, spark, sf_dir):
    return measures.cross_border_volume(measures.with_month(s.transactions), [measures.MONTH], P.remit_product)


@register("m37_corridor_column")
def _m37(s: Star, spark, sf_dir):
    return s.transactions.groupBy(measures.corridor_column().alias("corridor")).agg(
        F.count(F.lit(1)).alias("total_transactions"), F.sum("TXN_AMOUNT_USD").alias("total_value_usd")
    )


@register("m38_new_customers")
def _m38(s: Star, spark, sf_dir):
    return measures.new_customers(s.transactions)


@register("m39_m40_product_revenue_rank")
def _m39(s: Star, spark, sf_dir):
    b = measures.revenue_per_customer(measures.base_measures(s.transactions, ["PRODUCT"]))
    return measures.dense_rank_desc(b, "total_transactions", "product_rank_by_volume").select(
        "PRODUCT", "total_transactions", "total_value_usd", "unique_customers", "revenue_per_customer_usd",
        "product_rank_by_volume",
    )


@register("m41_subsidiary_rank_by_value")
def _m41(s: Star, spark, sf_dir):
    b = measures.base_measures(measures.with_month(s.transactions), [measures.MONTH, "SUBSIDIARY"])
    return measures.dense_rank_desc(b, "total_value_usd", "subsidiary_rank_by_value", within=[measures.MONTH]).select(
        measures.MONTH, "SUBSIDIARY", "total_value_usd", "subsidiary_rank_by_value"
    )


@register("m41_subsidiary_rank_all")
def _m41_all(s: Star, spark, sf_dir):
    """The rank over all history (also the bar of dashboard page 1)."""
    return dashboards.subsidiary_value(s.transactions)


@register("calendar")
def _calendar(s: Star, spark, sf_dir):
    return measures.date_table(s.transactions)


@register("m42_report_title")
def _m42(s: Star, spark, sf_dir):
    return measures.report_title_for(s.transactions)


# ------------------------------------------------------------------ D series
@register("d1_kpi_cards")
def _d1a(s: Star, spark, sf_dir):
    return dashboards.kpi_cards(s.transactions, P.as_of)


@register("d1_product_table")
def _d1b(s: Star, spark, sf_dir):
    return dashboards.product_table(s.transactions, s.kpi_targets, P.as_of)


@register("d2_month_product_matrix")
def _d2a(s: Star, spark, sf_dir):
    return dashboards.month_product_matrix(s.transactions, list(P.products))


@register("d2_month_product_matrix_of_labels")
def _d2_labels(s: Star, spark, sf_dir):
    """The wide matrix, its columns from the label dictionary."""
    return dashboards.month_product_matrix(s.transactions, values(s, "PRODUCT"))


@register("labels_product_subsidiary")
def _labels(s: Star, spark, sf_dir):
    """The dictionary itself: every product and subsidiary with its first and last month."""
    return labels(s, PAIR) if s.folder else labels_of(s.transactions, PAIR)


@register("d2_month_product")
def _d2_long(s: Star, spark, sf_dir):
    return dashboards.month_product(s.transactions)


@register("d2_product_scatter")
def _d2_scatter(s: Star, spark, sf_dir):
    return dashboards.product_scatter(s.transactions)


@register("d2_channel_share")
def _d2b(s: Star, spark, sf_dir):
    return dashboards.channel_share(s.transactions)


@register("d2_product_status")
def _d2c(s: Star, spark, sf_dir):
    return dashboards.product_status(s.transactions)


@register("d3_failure_overview")
def _d3a(s: Star, spark, sf_dir):
    return dashboards.failure_overview(s.transactions)


@register("d3_failures_by_description")
def _d3b(s: Star, spark, sf_dir):
    return dashboards.failures_by_description(s.transactions)


@register("d3_failed_value_by_category")
def _d3c(s: Star, spark, sf_dir):
    return dashboards.failed_value_by_category(s.transactions)


@register("d3_failure_rate_by_month_channel")
def _d3d(s: Star, spark, sf_dir):
    return dashboards.failure_rate_by_month_channel(s.transactions)


@register("d4_destination_volume")
def _d4a(s: Star, spark, sf_dir):
    return dashboards.destination_volume(s.transactions, P.remit_product)


@register("d4_corridor_cards")
def _d4c(s: Star, spark, sf_dir):
    return dashboards.corridor_cards(s.transactions, P.remit_product)


@register("d4_corridor_table")
def _d4b(s: Star, spark, sf_dir):
    return dashboards.corridor_table(s.transactions, P.remit_product)


@register("d5_agent_cards")
def _d5a(s: Star, spark, sf_dir):
    return dashboards.agent_cards(s.transactions, P.agency_product)


@register("d5_region_totals")
def _d5b(s: Star, spark, sf_dir):
    return dashboards.region_totals(s.transactions, s.agents, P.agency_product)


@register("d5_county_value")
def _d5c(s: Star, spark, sf_dir):
    return dashboards.county_value(s.transactions, s.agents, P.agency_product)


# ------------------------------------------------------------------ pages and pack from one pass
#: page -> the tables it gathers in one pass
PAGES: dict[str, Callable[[Star], dict[str, DataFrame]]] = {
    "pack": lambda s: pages.report_pack(s, P.as_of, P.agency_product, P.remit_product),
    "d1": lambda s: pages.executive_page(s, P.as_of),
    "d2": pages.product_channel_page,
    "d3": pages.failure_page,
    "d4": lambda s: pages.corridor_page(s, P.remit_product),
    "d5": lambda s: pages.agent_page(s, P.agency_product),
}
#: registered table of a page -> (page, table, the report it equals)
PAGE_TABLES = {
    "pack_monthly_kpis": ("pack", "Monthly_KPIs", "p6a_monthly_kpis"),
    "pack_failure_summary": ("pack", "Failure_Summary", "p6b_failure_summary"),
    "pack_agent_summary": ("pack", "Agent_Scorecard", "p6c_agent_summary"),
    "pack_corridor_performance": ("pack", "Corridor_Performance", "p6d_corridor_performance"),
    "pack_customer_segments": ("pack", "Customer_Segments", "p6e_customer_segments"),
    "page_d1_kpi_cards": ("d1", "kpi_cards", "d1_kpi_cards"),
    "page_d1_product_table": ("d1", "product_table", "d1_product_table"),
    "page_d1_subsidiary_value": ("d1", "subsidiary_value", "m41_subsidiary_rank_all"),
    "page_d2_month_product": ("d2", "month_product", "d2_month_product"),
    "page_d2_product_scatter": ("d2", "product_scatter", "d2_product_scatter"),
    "page_d2_channel_share": ("d2", "channel_share", "d2_channel_share"),
    "page_d2_product_status": ("d2", "product_status", "d2_product_status"),
    "page_d3_failure_overview": ("d3", "failure_overview", "d3_failure_overview"),
    "page_d3_failures_by_description": ("d3", "failures_by_description", "d3_failures_by_description"),
    "page_d3_failed_value_by_category": ("d3", "failed_value_by_category", "d3_failed_value_by_category"),
    "page_d3_failure_rate_by_month_channel": ("d3", "failure_rate_by_month_channel", "d3_failure_rate_by_month_channel"),
    "page_d4_destination_volume": ("d4", "destination_volume", "d4_destination_volume"),
    "page_d4_corridor_cards": ("d4", "corridor_cards", "d4_corridor_cards"),
    "page_d4_corridor_table": ("d4", "corridor_table", "d4_corridor_table"),
    "page_d5_agent_cards": ("d5", "agent_cards", "d5_agent_cards"),
    "page_d5_region_totals": ("d5", "region_totals", "d5_region_totals"),
    "page_d5_county_value": ("d5", "county_value", "d5_county_value"),
}
_GATHERED: dict[tuple, dict[str, DataFrame]] = {}


def _page(s: Star, spark: SparkSession, page: str) -> dict[str, DataFrame]:
    """A page's tables: gathered once per session and star, then each is read from the written cells."""
    if s.folder is None:
        return PAGES[page](s)
    key = (application_id(spark), id(spark), s.folder, page)
    found = _GATHERED.get(key)
    if found is None or next(iter(found.values())).sparkSession is not spark:
        found = _GATHERED[key] = PAGES[page](s)
    return found


def _page_table(page: str, table: str):
    def run(s: Star, spark, sf_dir: str) -> DataFrame:
        return _page(s, spark, page)[table]

    return run


for _name, (_of, _table, _same) in PAGE_TABLES.items():
    register(_name)(_page_table(_of, _table))


# ------------------------------------------------------------------ customer history as state
def _history(s: Star, spark: SparkSession) -> CustomerHistory:
    """The star's customer history, brought up to date: at first all months but the last, then those that are missing."""
    if s.folder is None:
        history = CustomerHistory(spark, _own_folder(spark, "history"))
        history.refresh(s.transactions)
        return history
    history = CustomerHistory(spark, f"{s.folder}/customer-history")
    if not history.state().months:
        last = s.transactions.agg(F.max("TXN_MONTH")).first()[0]
        history.refresh(s.transactions.filter(F.col("TXN_MONTH") < last))
    history.refresh(s.transactions)
    return history


@register("r09a_cohort_retention_state")
def _r09a_state(s: Star, spark, sf_dir):
    """R09a from the customer history: no transaction is read for the report."""
    return cohort.cohort_retention(None, R09A_AS_OF, cohort_months=8, kept=_history(s, spark).retention())


@register("r09b_cohort_retention_all_state")
def _r09b_state(s: Star, spark, sf_dir):
    return cohort.cohort_retention(None, cohort_months=None, kept=_history(s, spark).retention())


@register("p5_cohort_grid_state")
def _p5_state(s: Star, spark, sf_dir):
    return cohort.cohort_grid(None, kept=_history(s, spark).retention())


@register("m38_new_customers_state")
def _m38_state(s: Star, spark, sf_dir):
    return _history(s, spark).arrivals()


# ------------------------------------------------------------------ day totals
X9_DAYS = (dt.date(2001, 6, 5), dt.date(2001, 6, 20))


@register("p1b_complete_months_of_days")
def _p1b_days(s: Star, spark, sf_dir):
    """P1b from the kept day totals."""
    return stats.complete_months(s.transactions, days=rollup(s, "day_subsidiary"))


@register("x9_ytd_running_total_of_days")
def _x9_days(s: Star, spark, sf_dir):
    """X9 for some days: their rows and the totals of the days before."""
    return worksheet.ytd_running_total(s.transactions, P.as_of, P.home_subsidiary, days=X9_DAYS, totals=rollup(s, "day_subsidiary"))


@register("m30_m32_ytd_as_of")
def _m30_day(s: Star, spark, sf_dir):
    """M30-M32 through a day."""
    return measures.ytd_as_of(rollup(s, "day_subsidiary"), dt.date(2000, 8, 17))


# ------------------------------------------------------------------ mergeable top-k
FAILURES = topk.Counted("failure", "FAILURE_DESCRIPTION", "STATUS = 'FAILED' AND FAILURE_DESCRIPTION <> ''")
CORRIDORS = topk.Counted("corridor", "SOURCE_COUNTRY || '->' || DEST_COUNTRY", "SOURCE_COUNTRY <> DEST_COUNTRY", ("SUBSIDIARY",))


@register("x4_top_failures_of_period")
def _x4_period(s: Star, spark, sf_dir):
    """X4 over a period of months, from monthly lists."""
    return topk.top(s, FAILURES, 5, dt.date(1997, 1, 1), dt.date(2000, 6, 1)).rows


@register("top_corridors_of_period")
def _top_corridors(s: Star, spark, sf_dir):
    """The ten busiest corridors of each subsidiary over a period."""
    return topk.top(s, CORRIDORS, 10, dt.date(1997, 1, 1), dt.date(2000, 6, 1)).rows


# ------------------------------------------------------------------ change tracking of the sources
@register("tracked_monthly_kpis")
def _tracked(s: Star, spark, sf_dir):
    """P6a from a rollup of a star over files whose changes are tracked (the files of the materialised star)."""
    if s.folder is None:
        return export.monthly_kpis(s.transactions)
    tracked = TrackedStar(spark, s.folder, f"{s.folder}/tracked")
    tracked.refresh()
    define, month = GRAINS["product_subsidiary"]
    return export.monthly_kpis(s.transactions, tracked.table("rollup-product_subsidiary", define, month))


# ------------------------------------------------------------------ mergeable distinct counts

@register("m09_customers_year_to_date")
def _m09_ytd(s: Star, spark, sf_dir):
    """Distinct customers of the year so far, from bitmaps kept per month."""
    return members.over_year_to_date(members.kept_bitmaps(s, PAIR), PAIR)


@register("m09_customers_rolling_3m")
def _m09_rolling(s: Star, spark, sf_dir):
    """Distinct customers of three calendar months, at a coarser grain than the bitmaps'."""
    return members.over_months(members.kept_bitmaps(s, PAIR), ["SUBSIDIARY"], 3)


@register("m09_customers_of_period")
def _m09_period(s: Star, spark, sf_dir):
    return members.over_period(members.kept_bitmaps(s, PAIR), ["PRODUCT"], dt.date(1997, 3, 1), dt.date(1999, 8, 1))


@register("m09_customers_ever")
def _m09_ever(s: Star, spark, sf_dir):
    """M09 over all history by product and subsidiary, without the fact."""
    return members.over_period(members.kept_bitmaps(s, PAIR), PAIR)


# ------------------------------------------------------------------ filter context
#: slicers of the registered pages
SELECTED = {
    "SUBSIDIARY": ["AFRICA", "ASIA", "EUROPE"],
    "PRODUCT": ["PROMO", "STANDARD", "ECONOMY"],
    "month": context.between("month", dt.date(1996, 3, 1), dt.date(2000, 12, 1)),
}


@register("ctx_base_measures")
def _ctx_base(s: Star, spark, sf_dir):
    """M01-M09 as expressions."""
    return context.evaluate(context.model_of(s), modelled.BASE, [measures.MONTH, "PRODUCT"])


@register("ctx_attainment_rag")
def _ctx_attainment(s: Star, spark, sf_dir):
    """M22-M26 as expressions over two tables: all-but targets, the best rate of all months."""
    return context.evaluate(context.model_of(s), modelled.ATTAINMENT, [measures.MONTH, "PRODUCT", "SUBSIDIARY"])


@register("ctx_new_customers")
def _ctx_new(s: Star, spark, sf_dir):
    """M38 as an expression."""
    return context.evaluate(context.model_of(s), {"new_customers": modelled.NEW_CUSTOMERS}, [measures.MONTH], drop_blank=True)


@register("ctx_product_rank")
def _ctx_rank(s: Star, spark, sf_dir):
    """M39 and M40 as expressions."""
    wanted = {k: modelled.BASE[k] for k in ("total_transactions", "total_value_usd", "unique_customers")}
    wanted |= {"revenue_per_customer_usd": modelled.REVENUE_PER_CUSTOMER, "product_rank_by_volume": modelled.PRODUCT_RANK}
    return context.evaluate(context.model_of(s), wanted, ["PRODUCT"])


@register("ctx_active_agents")
def _ctx_agents(s: Star, spark, sf_dir):
    """M33, M34 and M36 as expressions, side by side."""
    wanted = {
        "active_agents": modelled.active_agents(P.agency_product), "successful_transactions": modelled.SUCCESSFUL,
        "txns_per_active_agent": modelled.txns_per_active_agent(P.agency_product), "cross_border_volume_usd": modelled.cross_border(P.remit_product),
    }
    return context.evaluate(context.model_of(s), wanted, [measures.MONTH])


@register("ctx_selected_products")
def _ctx_selected(s: Star, spark, sf_dir):
    """A page under three slicers: every kind of change of context, distinct counts at three grains, one scan."""
    m, c = modelled, context
    wanted = {
        "total_transactions": m.TOTAL,
        "total_value_usd": m.VALUE,
        "success_rate_pct": m.SUCCESS_RATE,
        "unique_customers": m.CUSTOMERS,
        "share_of_selected_pct": m.share(m.TOTAL, "PRODUCT"),
        "share_of_all_products_pct": m.share(m.TOTAL, "PRODUCT", of_all=True),
        "share_of_page_pct": c.divide(m.TOTAL, m.TOTAL.calculate(c.visible())) * 100.0,
        "customers_of_subsidiary": m.CUSTOMERS.calculate(c.visible("PRODUCT")),
        "customers_ever": m.CUSTOMERS.calculate(c.clear_but("SUBSIDIARY")),
        "customers_of_page": m.CUSTOMERS.calculate(c.visible()),
        "promo_value_usd": m.VALUE.calculate(c.only("PRODUCT", "PROMO")),
        "own_promo_value_usd": m.VALUE.calculate(c.keep(c.among("PRODUCT", "PROMO"))),
        "largest_ever_usd": c.greatest("TXN_AMOUNT_USD").calculate(c.clear_all()),
        "sr_vs_history_pp": m.SUCCESS_RATE - m.SUCCESS_RATE.calculate(c.clear("month")),
        "product_rank": c.rank(m.TOTAL, "PRODUCT"),
        "page_rank": c.rank(m.TOTAL, "PRODUCT", "SUBSIDIARY"),
    }
    return context.evaluate(context.model_of(s), wanted, ["SUBSIDIARY", "PRODUCT"], SELECTED)


@register("ctx_selected_new_customers")
def _ctx_selected_new(s: Star, spark, sf_dir):
    """M38 beside other measures under slicers: the months slicer hides rows, it does not make old customers new."""
    wanted = {
        "new_customers": context.new_members("CUSTOMER_ID", "month"), "unique_customers": modelled.CUSTOMERS,
        "total_transactions": modelled.TOTAL, "successful_transactions": modelled.SUCCESSFUL, "total_value_usd": modelled.VALUE,
    }
    return context.evaluate(context.model_of(s), wanted, ["month", "CHANNEL"], SELECTED)


@register("ctx_selected_growth")
def _ctx_selected_growth(s: Star, spark, sf_dir):
    """M10-M21 under slicers on subsidiary and product."""
    return modelled.growth(context.model_of(s), ["PRODUCT", "SUBSIDIARY"], {k: SELECTED[k] for k in ("SUBSIDIARY", "PRODUCT")})


def _selected(s: Star) -> Star:
    return context.sliced(s, SELECTED | {"month": context.between("month", dt.date(2001, 1, 1))})


@register("sliced_d1_product_table")
def _sliced_d1(s: Star, spark, sf_dir):
    """A dashboard table of a star under slicers."""
    t = _selected(s)
    return dashboards.product_table(t.transactions, t.kpi_targets, P.as_of)


@register("sliced_r02_kpi_rag")
def _sliced_r02(s: Star, spark, sf_dir):
    t = _selected(s)
    return reports.kpi_rag(t.transactions, t.kpi_targets, P.as_of)


@register("sliced_r11_fee_profitability")
def _sliced_r11(s: Star, spark, sf_dir):
    t = _selected(s)
    return reports.fee_profitability(t.transactions, t.forex_rates, P.as_of)


# ------------------------------------------------------------------ sources and sinks
def _own_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared root."""
    return f"{shared_root(spark)}/ledgerlens-{name}-{uuid.uuid4().hex}"


@register("csv_star_subsidiary_benchmark")
def _csv_star(s: Star, spark, sf_dir):
    """R10 over the whole star written as CSV (columns in reverse order) and read back by header."""
    base = _own_folder(spark, "csv")
    for name, schema in schemas.TABLES.items():
        columns = schema.fieldNames()[::-1]
        getattr(s, name).select(*columns).write.option("header", True).csv(f"{base}/{name}.csv")
    return reports.subsidiary_benchmark(star_from_files(spark, base, "csv").transactions, P.as_of, P.remit_product)


@register("p6_pack_csv_monthly_kpis")
def _pack_csv(s: Star, spark, sf_dir):
    """The export pack written as CSV; its monthly sheet read back."""
    pack = export.report_pack(s.transactions, s.agents, s.customers, P.as_of, P.agency_product, P.remit_product)
    paths = export.write_pack(pack, _own_folder(spark, "pack"), fmt="csv")
    return conform(spark.read.option("header", True).csv(paths["Monthly_KPIs"]), pack["Monthly_KPIs"].schema, "Monthly_KPIs")


# ------------------------------------------------------------------ original default windows
@register("r03_failure_spikes_default_window")
def _r03_default(s: Star, spark, sf_dir):
    """R03 with the report's own 28-day window and 7-day recent period."""
    return reports.failure_spikes(s.transactions, P.as_of)


@register("r04_agent_scorecard_12m")
def _r04_12m(s: Star, spark, sf_dir):
    """R04 over the twelve months before as_of instead of one."""
    return reports.agent_scorecard(s.transactions, s.agents, P.as_of, P.agency_product, months=12)


@register("p2_ab_test_default_window")
def _p2_default(s: Star, spark, sf_dir):
    """P2 with the script's own 90-day window."""
    return stats.ab_test_success_rate(s.transactions, P.control_channel, P.treatment_channel, P.flagship_product, P.as_of)
