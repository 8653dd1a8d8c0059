"""The monthly/hourly business reports.

Each report is one lazily built DataFrame: aggregate the fact once (partial
aggregation on the map side), then apply windows, joins and flags to the
small aggregate. Date windows are literal ranges computed from ``as_of`` so
they reach the Parquet scan as pushed filters.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import kpi
from ledgerlens.operators import measures
from ledgerlens.plans.joins import broadcast_if_small
from ledgerlens.plans.ordered import ntile
from ledgerlens.params import add_months, month_start, prior_month_bounds

D = "TRANSACTION_DATE"


# ---------------------------------------------------------------- R01
def product_months(txns: DataFrame) -> DataFrame:
    """The monthly aggregate R01 runs on (a month never needs another month's rows)."""
    return txns.groupBy(
        kpi.month_key(D).alias("txn_month"), "PRODUCT", "SUBSIDIARY", "PRODUCT_CATEGORY"
    ).agg(
        F.count(F.lit(1)).alias("total_txns"),
        kpi.successes().alias("successful_txns"),
        kpi.failures().alias("failed_txns"),
        F.sum("TXN_AMOUNT_USD").alias("value_usd"),
        kpi.avg_exact("TXN_AMOUNT_LOCAL").alias("avg_txn_local"),
        kpi.avg_exact("PROCESSING_TIME_SECS").alias("avg_proc_secs"),
        F.sum("FEE_AMOUNT_LOCAL").alias("total_fees_local"),
        F.countDistinct("CUSTOMER_ID").alias("unique_customers"),
    )


def monthly_product_performance(
    txns: DataFrame,
    as_of: dt.date,
    subsidiary: str | None,
    months: int = 3,
    sla_pct: float = 95.0,
    monthly: DataFrame | None = None,
) -> DataFrame:
    """Month x product x subsidiary x category P&L with MoM/YoY growth and SLA flag.

    LAG runs over the full monthly history (row-based: the previous *present*
    month); the month and subsidiary filters apply afterwards. Catalyst pushes
    the subsidiary predicate below the window because it is a partition key.
    ``monthly`` is the kept rollup of ``product_months``; without it the
    history is aggregated here.
    """
    monthly = product_months(txns) if monthly is None else monthly
    w = Window.partitionBy("PRODUCT", "SUBSIDIARY").orderBy("txn_month")
    sr = kpi.pct("successful_txns", "total_txns")
    g = (
        monthly.withColumn("sr", sr)
        .withColumn("prev_mo_txns", F.lag("total_txns", 1).over(w))
        .withColumn("prev_yr_txns", F.lag("total_txns", 12).over(w))
        .withColumn("prev_mo_val", F.lag("value_usd", 1).over(w))
        .withColumn("prev_customers", F.lag("unique_customers", 1).over(w))
        .withColumn("prev_mo_sr", F.lag("sr", 1).over(w))
    )
    first_month = add_months(month_start(as_of), -months).strftime("%Y-%m")
    cond = F.col("txn_month") >= F.lit(first_month)
    if subsidiary is not None:
        cond = cond & (F.col("SUBSIDIARY") == F.lit(subsidiary))
    return (
        g.filter(cond)
        .select(
            "txn_month",
            "PRODUCT",
            "SUBSIDIARY",
            "PRODUCT_CATEGORY",
            "total_txns",
            "successful_txns",
            "failed_txns",
            kpi.rnd("sr", 1).alias("success_rate_pct"),
            kpi.rnd(kpi.pct("failed_txns", "total_txns"), 1).alias("failure_rate_pct"),
            kpi.rnd("value_usd", 2).alias("value_usd"),
            kpi.rnd("avg_txn_local", 2).alias("avg_txn_local"),
            kpi.rnd("avg_proc_secs", 2).alias("avg_proc_secs"),
            "unique_customers",
            kpi.rnd(kpi.pct_change("total_txns", "prev_mo_txns"), 1).alias("mom_vol_pct"),
            kpi.rnd(kpi.pct_change("total_txns", "prev_yr_txns"), 1).alias("yoy_vol_pct"),
            kpi.rnd(kpi.pct_change("value_usd", "prev_mo_val"), 1).alias("mom_val_pct"),
            kpi.rnd(kpi.pct_change("unique_customers", "prev_customers"), 1).alias("mom_customer_growth"),
            kpi.rnd(F.col("sr") - F.col("prev_mo_sr"), 2).alias("sr_change_pp"),
            kpi.rnd(kpi.ratio("total_fees_local", "value_usd"), 4).alias("fee_to_value_ratio"),
            F.when(F.col("sr") < F.lit(float(sla_pct)), "BREACH").otherwise("OK").alias("sla_status"),
        )
        .orderBy(F.col("txn_month").desc(), F.col("total_txns").desc())
    )


def category_conflicts(txns: DataFrame) -> DataFrame:
    """Products seen with more than one category.

    R01 groups by category but runs LAG per (product, subsidiary); the growth
    columns are only meaningful when the category is a function of the
    product, which this check verifies (an empty result means it holds).
    """
    return (
        txns.groupBy("PRODUCT")
        .agg(F.countDistinct("PRODUCT_CATEGORY").alias("categories"), F.collect_set("PRODUCT_CATEGORY").alias("seen"))
        .filter(F.col("categories") > 1)
    )


# ---------------------------------------------------------------- R02
def kpi_rag(
    txns: DataFrame,
    targets: DataFrame,
    as_of: dt.date,
    missing_target: str = "drop",
) -> DataFrame:
    """Prior-month actuals vs targets with volume/value/success-rate RAG.

    Keys are normalised with ``UPPER(TRIM())`` on both sides. ``missing_target``
    is ``drop`` (inner join, the SQL report) or ``red`` (left join; the
    worksheet form, where a missing target counts as RED).
    Targets are product x subsidiary x month; they are broadcast when a
    bounded row count confirms they are small, else joined by shuffle.
    """
    start, end = prior_month_bounds(as_of)
    norm = lambda c: F.upper(F.trim(F.col(c)))
    actuals = (
        kpi.date_window(txns, start, end)
        .groupBy(
            norm("PRODUCT").alias("PRODUCT"),
            norm("SUBSIDIARY").alias("SUBSIDIARY"),
            kpi.month_date(D).alias("report_month"),
        )
        .agg(
            F.count(F.lit(1)).alias("actual_vol"),
            kpi.round_dec(F.sum(F.coalesce("TXN_AMOUNT_USD", F.lit(0))), 2).alias("actual_val_usd"),
            kpi.round_dec(kpi.pct(kpi.count_when(norm("STATUS") == kpi.SUCCESS), F.count(F.lit(1))), 2)
            .alias("actual_sr"),
            F.countDistinct("CUSTOMER_ID").alias("actual_custs"),
            F.countDistinct(F.when(kpi.non_blank("AGENT_ID"), norm("AGENT_ID"))).alias("active_agents"),
        )
    )
    k = broadcast_if_small(
        targets.select(
            norm("PRODUCT").alias("k_product"),
            norm("SUBSIDIARY_NAME").alias("k_subsidiary"),
            F.to_date("TARGET_MONTH").alias("k_month"),
            "TARGET_VOLUME",
            "TARGET_VALUE_USD",
            "TARGET_SUCCESS_RATE",
            "TARGET_ACTIVE_CUSTOMERS",
        )
    )
    how = {"drop": "inner", "red": "left"}[missing_target]
    j = actuals.join(
        k,
        (F.col("PRODUCT") == F.col("k_product"))
        & (F.col("SUBSIDIARY") == F.col("k_subsidiary"))
        & (F.col("report_month") == F.col("k_month")),
        how,
    )
    sr_t = F.col("TARGET_SUCCESS_RATE")
    return j.select(
        "PRODUCT",
        "SUBSIDIARY",
        "actual_vol",
        "TARGET_VOLUME",
        kpi.rnd(kpi.pct("actual_vol", "TARGET_VOLUME"), 1).alias("vol_attainment_pct"),
        kpi.rag("actual_vol", "TARGET_VOLUME").alias("vol_rag"),
        F.col("actual_val_usd").cast("double").alias("actual_val_usd"),
        kpi.rnd("TARGET_VALUE_USD", 2).alias("target_val_usd"),
        kpi.rnd(kpi.pct("actual_val_usd", "TARGET_VALUE_USD"), 1).alias("val_attainment_pct"),
        kpi.rag("actual_val_usd", "TARGET_VALUE_USD").alias("val_rag"),
        F.col("actual_sr").cast("double").alias("actual_sr"),
        sr_t.cast("double").alias("TARGET_SUCCESS_RATE"),
        F.when(F.col("actual_sr") >= sr_t, "GREEN")
        .when(F.col("actual_sr") >= sr_t - F.lit(5), "AMBER")
        .otherwise("RED")
        .alias("sr_rag"),
        "actual_custs",
        "TARGET_ACTIVE_CUSTOMERS",
        kpi.rnd(kpi.pct("actual_custs", "TARGET_ACTIVE_CUSTOMERS"), 1).alias("cust_attainment_pct"),
        "active_agents",
    ).orderBy(F.col("vol_attainment_pct").asc_nulls_last())


# ---------------------------------------------------------------- R03
def failure_spikes(
    txns: DataFrame,
    as_of: dt.date,
    window_days: int = 28,
    recent_days: int = 7,
    spike: str = "1.5",
    improve: str = "0.7",
) -> DataFrame:
    """Failures in the recent period vs the average prior period, per channel/product/failure.

    The original two-step aggregate (per period, then pivot) collapses into
    one aggregate with conditional sums. Thresholds are tested exactly as
    ``this * k > prior * spike`` (no rounding of ``prior / k``). ``k``, the
    number of prior periods, is what the window holds besides the recent one:
    3 for 28 and 7 days, and the exact fraction for other windows, so the
    tests multiply by the days on both sides.
    """
    prior_days = window_days - recent_days
    if recent_days < 1 or prior_days < 1:
        raise ValueError(f"a window of {window_days} days holds nothing before its last {recent_days}")
    recent_start = as_of - dt.timedelta(days=recent_days)
    start = as_of - dt.timedelta(days=window_days)
    recent = F.col(D) >= F.lit(recent_start)
    f = kpi.date_window(txns, start).filter(kpi.status_is(kpi.FAILED) & kpi.non_blank("FAILURE_DESCRIPTION"))
    p = f.groupBy(
        F.col("CHANNEL").alias("channel"),
        F.col("CHANNEL_TYPE").alias("channel_type"),
        F.col("PRODUCT").alias("product"),
        F.col("FAILURE_DESCRIPTION").alias("failure_description"),
        F.col("FAILURE_CATEGORY").alias("failure_category"),
    ).agg(
        kpi.count_when(recent).alias("this_week"),
        kpi.count_when(~recent).alias("prior_3wk"),
        F.sum(F.when(recent, F.coalesce("TXN_AMOUNT_LOCAL", F.lit(0)))).alias("tw_val_local"),
        F.sum(F.when(recent, F.coalesce("TXN_AMOUNT_USD", F.lit(0)))).alias("tw_val_usd"),
    )
    # counts scaled to the same number of days
    tw, pw = F.col("this_week") * F.lit(prior_days), F.col("prior_3wk") * F.lit(recent_days)
    avg_prior = kpi.as_double(pw) / F.lit(float(prior_days))
    return (
        p.filter(tw > 0)
        .select(
            "channel",
            "channel_type",
            "product",
            "failure_description",
            "failure_category",
            "this_week",
            kpi.rnd(avg_prior, 1).alias("avg_prior_wk"),
            kpi.rnd(F.coalesce("tw_val_local", F.lit(0)), 2).alias("failed_val_local"),
            kpi.rnd(F.coalesce(kpi.round_dec("tw_val_usd", 2), F.lit(0)), 2).alias("failed_val_usd"),
            F.when(pw == 0, "NEW")
            .when(tw > pw * kpi.dec(spike), "SPIKING")
            .when(tw < pw * kpi.dec(improve), "IMPROVING")
            .otherwise("STABLE")
            .alias("trend_flag"),
            kpi.rnd(kpi.pct(tw - pw, pw), 0).alias("wow_pct"),
        )
        .orderBy(F.col("this_week").desc(), F.col("failed_val_usd").desc())
    )


# ---------------------------------------------------------------- R04
def agent_scorecard(
    txns: DataFrame,
    agents: DataFrame,
    as_of: dt.date,
    product: str,
    months: int = 1,
    dormant_days: int = 14,
) -> DataFrame:
    """Per-agent activity in the prior month(s) with quartile band, float risk and dormancy.

    Transactions are aggregated per agent first (map-side partial aggregation),
    and only the per-agent result is joined to the agent dimension, so the
    join input is one row per agent rather than one per transaction. The join
    is inner: agents without activity do not appear (as in the report).
    ``NTILE`` ties are broken by AGENT_ID; the quartiles are computed with the
    distributed ``plans.ordered.ntile`` rather than a window per region.
    """
    start, end = prior_month_bounds(as_of)
    start = add_months(end, -months)
    f = kpi.date_window(txns, start, end).filter((F.col("PRODUCT") == F.lit(product)) & kpi.non_blank("AGENT_ID"))
    per_agent = f.groupBy("AGENT_ID").agg(
        F.count(F.lit(1)).alias("total_txns"),
        kpi.successes().alias("successful_txns"),
        kpi.failures().alias("failed_txns"),
        kpi.round_dec(F.sum(F.coalesce("TXN_AMOUNT_LOCAL", F.lit(0))), 2).alias("total_value_kes"),
        kpi.round_dec(F.sum(F.coalesce("TXN_AMOUNT_USD", F.lit(0))), 2).alias("total_value_usd"),
        kpi.round_dec(F.sum(F.coalesce("FEE_AMOUNT_LOCAL", F.lit(0))), 2).alias("commission_kes"),
        F.countDistinct("CUSTOMER_ID").alias("unique_customers"),
        F.countDistinct(kpi.txn_date()).alias("active_days"),
        F.max(kpi.txn_date()).alias("last_txn_date"),
        kpi.count_when(F.col("FAILURE_CODE") == "INSUFF_FLOAT").alias("float_failures"),
        kpi.rnd(kpi.avg_exact("PROCESSING_TIME_SECS"), 0).alias("avg_proc_secs"),
    )
    a = agents.select("AGENT_ID", "AGENT_NAME", "AGENT_TIER", "REGION", "COUNTY", "FLOAT_LIMIT_KES")
    stats = per_agent.join(a, "AGENT_ID").filter(F.col("total_txns") > 0)
    # NTILE per region, distributed: a region holding most agents spans many tasks
    ranked = ntile(stats, 4, ["REGION"], [F.col("total_txns").desc(), F.col("AGENT_ID").asc()], "perf_quartile")
    ff = F.col("float_failures")
    return ranked.select(
        "AGENT_ID",
        "AGENT_TIER",
        "REGION",
        "COUNTY",
        "total_txns",
        "successful_txns",
        "failed_txns",
        kpi.rnd(kpi.pct("successful_txns", "total_txns"), 1).alias("success_rate"),
        kpi.rnd("total_value_kes", 0).alias("total_value_kes"),
        F.col("total_value_usd").cast("double").alias("total_value_usd"),
        F.col("commission_kes").cast("double").alias("commission_kes"),
        "unique_customers",
        "active_days",
        "float_failures",
        kpi.rnd(kpi.ratio("total_value_kes", "FLOAT_LIMIT_KES"), 2).alias("float_util_ratio"),
        kpi.rnd(kpi.pct("commission_kes", "total_value_kes"), 3).alias("commission_rate_pct"),
        "avg_proc_secs",
        F.when(F.col("perf_quartile") == 1, "TOP")
        .when(F.col("perf_quartile") == 2, "UPPER")
        .when(F.col("perf_quartile") == 3, "LOWER")
        .otherwise("BOTTOM")
        .alias("band"),
        F.when(ff > 5, "HIGH RISK").when(ff.between(1, 5), "MEDIUM").otherwise("OK").alias("float_risk"),
        F.when(F.col("last_txn_date") < F.lit(as_of - dt.timedelta(days=dormant_days)), "DORMANT")
        .otherwise("ACTIVE")
        .alias("dormancy"),
    ).orderBy(F.col("total_txns").desc(), "AGENT_ID")


# ---------------------------------------------------------------- R05
def corridor_analysis(txns: DataFrame, as_of: dt.date, product: str, months: int = 3) -> DataFrame:
    """Cross-border corridors (``IS DISTINCT FROM``): monthly volume, value, fees, MoM and value rank.

    A corridor with a NULL end is NULL (string concatenation with NULL), as in
    the report.
    """
    end = month_start(as_of)
    start = add_months(end, -months)
    f = kpi.date_window(txns, start, end).filter(
        (F.col("PRODUCT") == F.lit(product)) & ~F.col("SOURCE_COUNTRY").eqNullSafe(F.col("DEST_COUNTRY"))
    )
    local = F.coalesce("TXN_AMOUNT_LOCAL", F.lit(0))
    c = f.groupBy(
        F.concat(F.col("SOURCE_COUNTRY"), F.lit("->"), F.col("DEST_COUNTRY")).alias("corridor"),
        kpi.month_date(D).alias("txn_month"),
    ).agg(
        F.count(F.lit(1)).alias("total_txns"),
        kpi.successes().alias("successful_txns"),
        kpi.failures().alias("failed_txns"),
        kpi.round_dec(F.sum(F.coalesce("TXN_AMOUNT_USD", F.lit(0))), 2).alias("value_usd"),
        kpi.rnd(kpi.avg_exact(local), 0).alias("avg_txn_local"),
        kpi.rnd(kpi.avg_exact(F.coalesce("PROCESSING_TIME_SECS", F.lit(0))) / F.lit(60.0), 1).alias("avg_proc_mins"),
        kpi.rnd(F.avg(kpi.as_double(F.coalesce("FEE_AMOUNT_LOCAL", F.lit(0))) / F.nullif(kpi.as_double(local), F.lit(0.0)))
                * F.lit(100.0), 3).alias("avg_fee_rate_pct"),
        F.countDistinct("CUSTOMER_ID").alias("unique_senders"),
    )
    w = Window.partitionBy("corridor").orderBy("txn_month")
    wr = Window.partitionBy("txn_month").orderBy(F.col("value_usd").desc_nulls_first())
    return (
        c.withColumn("prev_mo_txns", F.lag("total_txns").over(w))
        .select(
            "corridor",
            "txn_month",
            "total_txns",
            "successful_txns",
            "failed_txns",
            kpi.rnd(kpi.pct("successful_txns", "total_txns"), 1).alias("success_rate_pct"),
            F.col("value_usd").cast("double").alias("value_usd"),
            "avg_txn_local",
            "avg_proc_mins",
            "avg_fee_rate_pct",
            "unique_senders",
            "prev_mo_txns",
            kpi.rnd(kpi.pct_change("total_txns", "prev_mo_txns"), 1).alias("mom_growth_pct"),
            F.rank().over(wr).alias("rank_by_value"),
        )
        .orderBy(F.col("txn_month").desc(), F.col("value_usd").desc())
    )


# ---------------------------------------------------------------- R06
def rolling_success_rate(
    txns: DataFrame,
    as_of: dt.date,
    months: int = 5,
    avg_rows: int = 3,
    vol_rows: int = 6,
    monthly: DataFrame | None = None,
) -> DataFrame:
    """Monthly success rate (2 dp) with its rolling mean, change and max-min volatility.

    Windows run on the already rounded monthly rate, over rows (present
    months), and the month filter applies after the windows. ``monthly`` is the
    kept rollup of the base measures by product and subsidiary.
    """
    monthly = measures.monthly_measures(txns, ["PRODUCT", "SUBSIDIARY"]) if monthly is None else monthly
    m = monthly.select(
        F.col(measures.MONTH).alias("txn_month"), "PRODUCT", "SUBSIDIARY",
        F.col("total_transactions").alias("total"),
        F.col("successful_transactions").alias("success"),
        kpi.round_dec(F.coalesce("total_value_usd", F.lit(0)), 2).alias("value_usd"),
    ).withColumn("sr", kpi.round_dec(kpi.pct("success", "total"), 2))
    w = Window.partitionBy("PRODUCT", "SUBSIDIARY").orderBy("txn_month")
    e = (
        m.withColumn("rolling_3m_sr", F.avg("sr").over(w.rowsBetween(-(avg_rows - 1), 0)))
        .withColumn("sr_change_pp", F.col("sr") - F.lag("sr", 1).over(w))
        .withColumn(
            "sr_volatility_6m",
            F.max("sr").over(w.rowsBetween(-(vol_rows - 1), 0)) - F.min("sr").over(w.rowsBetween(-(vol_rows - 1), 0)),
        )
    )
    first = month_start(add_months(as_of, -months))
    return (
        e.filter(F.col("txn_month") >= F.lit(first))
        .select(
            "txn_month",
            "PRODUCT",
            "SUBSIDIARY",
            "total",
            F.col("sr").cast("double").alias("monthly_sr"),
            F.col("value_usd").cast("double").alias("value_usd"),
            kpi.rnd("rolling_3m_sr", 2).alias("rolling_3m_sr"),
            kpi.rnd(F.coalesce("sr_change_pp", F.lit(0)), 2).alias("sr_change_pp"),
            kpi.rnd(F.coalesce("sr_volatility_6m", F.lit(0)), 2).alias("sr_volatility_6m"),
        )
        .orderBy("PRODUCT", "SUBSIDIARY", "txn_month")
    )


# ---------------------------------------------------------------- R07
def segment_revenue(txns: DataFrame, customers: DataFrame, as_of: dt.date, months: int = 3) -> DataFrame:
    """Success-only revenue by CRM segment since the start of the month ``months`` back.

    The fact is first reduced to one row per (customer, product) -- the grain
    the segment measures need -- so the join with the customer dimension sees
    pairs, not transactions.
    """
    start = month_start(add_months(as_of, -months))
    f = kpi.date_window(txns, start).filter(kpi.status_is(kpi.SUCCESS))
    pairs = f.groupBy("CUSTOMER_ID", "PRODUCT").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.coalesce("TXN_AMOUNT_USD", F.lit(0))).alias("usd"),
        F.sum(F.coalesce("FEE_AMOUNT_LOCAL", F.lit(0))).alias("fee"),
        kpi.successes().alias("ok"),
    )
    j = pairs.join(customers.select("CUSTOMER_ID", "SEGMENT"), "CUSTOMER_ID")
    g = j.groupBy("SEGMENT").agg(
        F.countDistinct("CUSTOMER_ID").alias("customer_count"),
        F.sum("n").alias("total_txns"),
        F.sum("usd").alias("rev"),
        F.sum("fee").alias("fees"),
        F.sum("ok").alias("ok"),
        F.countDistinct("PRODUCT").alias("products_used"),
    )
    return g.select(
        "SEGMENT",
        "customer_count",
        "total_txns",
        kpi.rnd(kpi.ratio("total_txns", "customer_count"), 1).alias("txns_per_customer"),
        kpi.rnd("rev", 2).alias("total_rev_usd"),
        kpi.rnd(kpi.ratio("rev", "customer_count"), 2).alias("rev_per_customer_usd"),
        kpi.rnd(kpi.ratio("rev", "total_txns"), 2).alias("avg_txn_usd"),
        kpi.rnd(kpi.pct("ok", "total_txns"), 2).alias("success_rate_pct"),
        "products_used",
        kpi.rnd(kpi.ratio("fees", "customer_count"), 2).alias("avg_fee_per_cust"),
    ).orderBy(F.col("rev_per_customer_usd").desc())


# ---------------------------------------------------------------- R08
def channel_product_matrix(txns: DataFrame, as_of: dt.date, months: int = 3) -> DataFrame:
    """Channel x product success, speed, value and fee, with two rankings."""
    start = month_start(add_months(as_of, -months))
    secs = F.col("PROCESSING_TIME_SECS")
    cp = kpi.date_window(txns, start).groupBy(
        F.col("CHANNEL").alias("channel"), F.col("CHANNEL_TYPE").alias("channel_type"), F.col("PRODUCT").alias("product")
    ).agg(
        F.count(F.lit(1)).alias("total_txns"),
        kpi.successes().alias("successful_txns"),
        kpi.round_dec(kpi.avg_exact(F.coalesce(secs, F.lit(0))), 1).alias("avg_proc_secs"),
        kpi.round_dec(kpi.avg_exact(F.when(kpi.status_is(kpi.FAILED), secs)), 1).alias("avg_fail_proc_secs"),
        kpi.round_dec(F.sum(F.coalesce("TXN_AMOUNT_USD", F.lit(0))), 2).alias("value_usd"),
        kpi.round_dec(kpi.avg_exact(F.coalesce("FEE_AMOUNT_LOCAL", F.lit(0))), 2).alias("avg_fee"),
    ).withColumn("success_rate", kpi.round_dec(kpi.pct("successful_txns", "total_txns"), 2))
    w1 = Window.partitionBy("channel").orderBy(F.col("success_rate").asc_nulls_last())
    w2 = Window.partitionBy("product").orderBy(F.col("total_txns").desc())
    return cp.select(
        "channel",
        "channel_type",
        "product",
        "total_txns",
        "successful_txns",
        F.col("success_rate").cast("double").alias("success_rate"),
        F.col("avg_proc_secs").cast("double").alias("avg_proc_secs"),
        F.col("avg_fail_proc_secs").cast("double").alias("avg_fail_proc_secs"),
        kpi.rnd("value_usd", 0).alias("value_usd"),
        F.col("avg_fee").cast("double").alias("avg_fee"),
        F.rank().over(w1).alias("worst_sr_rank"),
        F.rank().over(w2).alias("vol_rank_in_product"),
    ).orderBy(F.col("success_rate").asc(), F.col("total_txns").desc())


# ---------------------------------------------------------------- R10
def subsidiary_benchmark(
    txns: DataFrame, as_of: dt.date, remit_product: str, months: int = 3, approx: bool = False
) -> DataFrame:
    """Subsidiary x country KPIs over a rolling ``months`` window (day-level start).

    ``remit_txns`` uses ``<>`` (NULL countries are not counted), as the report does.
    Products and channels are bounded catalogues, so their distinct values are
    collected as sets in the same pass; customers are the one real distinct
    count (no Expand of the rows). ``approx=True`` counts customers with a
    HyperLogLog++ sketch instead (about 1 % relative error).
    """
    start = add_months(as_of, -months)
    f = kpi.date_window(txns, start)
    remit = (F.col("PRODUCT") == F.lit(remit_product)) & (F.col("SOURCE_COUNTRY") != F.col("DEST_COUNTRY"))
    distinct = F.approx_count_distinct if approx else F.countDistinct
    return f.groupBy("SUBSIDIARY", "COUNTRY").agg(
        F.count(F.lit(1)).alias("total_txns"),
        kpi.successes().alias("successful_txns"),
        kpi.rnd(F.sum("TXN_AMOUNT_USD"), 2).alias("total_value_usd"),
        kpi.rnd(kpi.avg_exact("TXN_AMOUNT_USD"), 2).alias("avg_txn_usd"),
        distinct("CUSTOMER_ID").alias("active_customers"),
        F.size(F.collect_set("PRODUCT")).cast("bigint").alias("products_offered"),
        F.size(F.collect_set("CHANNEL")).cast("bigint").alias("channels_used"),
        kpi.rnd(kpi.pct(kpi.successes(), F.count(F.lit(1))), 2).alias("success_rate"),
        kpi.rnd(kpi.avg_exact("PROCESSING_TIME_SECS"), 1).alias("avg_proc_secs"),
        kpi.count_when(F.coalesce(remit, F.lit(False))).alias("remit_txns"),
    )


# ---------------------------------------------------------------- R11
def fee_profitability(txns: DataFrame, fx: DataFrame, as_of: dt.date) -> DataFrame:
    """Prior-month success fees per product/subsidiary/currency in local and USD, ranked in subsidiary.

    The month equality of the report is rewritten as a date range so it is
    pushed to the scan. FX rates (subsidiary x month) are broadcast after a size check;
    a duplicate rate row would double the fees, exactly as the SQL join would.
    """
    start, end = prior_month_bounds(as_of)
    f = kpi.date_window(txns, start, end).filter(kpi.status_is(kpi.SUCCESS)).withColumn(
        "_m", kpi.month_date(D)
    )
    r = broadcast_if_small(
        fx.select(
            F.col("SUBSIDIARY_NAME").alias("_sub"),
            F.trunc(F.to_date("RATE_MONTH"), "month").alias("_rm"),
            "USD_RATE",
        ).filter((F.col("_rm") >= F.lit(start)) & (F.col("_rm") < F.lit(end)))
    )
    j = f.join(r, (F.col("SUBSIDIARY") == F.col("_sub")) & (F.col("_m") == F.col("_rm")))
    fee, local = F.col("FEE_AMOUNT_LOCAL"), F.col("TXN_AMOUNT_LOCAL")
    g = j.groupBy("PRODUCT", "SUBSIDIARY", "CURRENCY").agg(
        F.count(F.lit(1)).alias("total_txns"),
        kpi.successes().alias("paid_txns"),
        F.sum(fee).alias("fees"),
        F.sum(fee * F.col("USD_RATE")).alias("fees_usd"),
        kpi.avg_exact(fee).alias("avg_fee"),
        F.avg(F.when(local > 0, kpi.as_double(fee) / kpi.as_double(local) * F.lit(100.0))).alias("fee_rate"),
    )
    w = Window.partitionBy("SUBSIDIARY").orderBy(F.col("fees").desc_nulls_first())
    return g.select(
        "PRODUCT",
        "SUBSIDIARY",
        "CURRENCY",
        "total_txns",
        "paid_txns",
        kpi.rnd("fees", 2).alias("total_fees_local"),
        kpi.rnd("fees_usd", 2).alias("total_fees_usd"),
        kpi.rnd("avg_fee", 2).alias("avg_fee_local"),
        kpi.rnd("fee_rate", 3).alias("avg_fee_rate_pct"),
        F.rank().over(w).alias("fee_rank"),
    ).orderBy(F.col("total_fees_usd").desc())


# ---------------------------------------------------------------- R12
DAY_LABELS = {
    # PostgreSQL DOW (0 = Sunday) -> label; fixed values of the report
    0: "7-Sun",
    1: "1-Mon",
    2: "2-Tue",
    3: "3-Wed",
    4: "4-Thu",
    5: "5-Fri",
    6: "6-Sat",
}


def day_label(ts) -> F.Column:
    dow = F.dayofweek(ts) - 1  # Spark: 1 = Sunday
    e = None
    for k, v in DAY_LABELS.items():
        e = F.when(dow == k, v) if e is None else e.when(dow == k, v)
    return e


def activity_heatmap(txns: DataFrame, as_of: dt.date, months: int = 3) -> DataFrame:
    """Day-of-week x hour volume, success rate, value and speed since the month ``months`` back."""
    start = month_start(add_months(as_of, -months))
    f = kpi.date_window(txns, start)
    return (
        f.groupBy(day_label(F.col(D)).alias("day_of_week"), F.hour(D).cast("bigint").alias("hour_of_day"))
        .agg(
            F.count(F.lit(1)).alias("total_txns"),
            kpi.successes().alias("successful_txns"),
            kpi.rnd(kpi.pct(kpi.successes(), F.count(F.lit(1))), 1).alias("success_rate_pct"),
            kpi.rnd(kpi.avg_exact("TXN_AMOUNT_USD"), 2).alias("avg_value_usd"),
            kpi.rnd(kpi.avg_exact("PROCESSING_TIME_SECS"), 1).alias("avg_proc_secs"),
        )
        .orderBy("day_of_week", "hour_of_day")
    )
