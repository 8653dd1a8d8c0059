"""The measure layer (M01-M42) and its calendar time intelligence.

A measure is evaluated for the rows of ``by`` -- the filter context of a
report visual. Base measures are one aggregate; prior-period measures join a
monthly aggregate to itself shifted by whole calendar months (not LAG: a
missing month is blank, not the previous present one); rolling and YTD
measures run over a month spine, so empty months exist as rows.

Blank handling follows the measure definitions: ``DIVIDE(a, b, 0)`` gives 0,
``DIVIDE(a, b, BLANK())`` gives NULL, and a blank count stays NULL.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import kpi
from ledgerlens.plans.joins import broadcast_if_small

D = "TRANSACTION_DATE"
MONTH = "month"
EM_DASH = "—"


def _div0(a: Column | str, b: Column | str) -> Column:
    """``DIVIDE(a, b, 0)``."""
    return F.coalesce(kpi.ratio(a, b), F.lit(0.0))


def _divb(a: Column | str, b: Column | str) -> Column:
    """``DIVIDE(a, b, BLANK())``."""
    return kpi.ratio(a, b)


def with_month(txns: DataFrame) -> DataFrame:
    return txns.withColumn(MONTH, kpi.month_date(D))


# ---------------------------------------------------------------- M01-M09
def base_measures(txns: DataFrame, by: list[str], count_blank_customer: bool = True, known_customers: bool = False) -> DataFrame:
    """Totals, success/failure counts and rates, value, fees, minutes and distinct customers per ``by``.

    ``count_blank_customer`` adds one to the distinct count when a NULL
    customer is present (DISTINCTCOUNT counts BLANK as a value);
    ``known_customers`` adds a column with the count that leaves it out.
    """
    known = uniq = F.countDistinct("CUSTOMER_ID")
    if count_blank_customer:
        uniq = uniq + F.max(F.when(F.col("CUSTOMER_ID").isNull(), 1).otherwise(0))
    g = txns.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_transactions"),
        kpi.successes().alias("successful_transactions"),
        kpi.failures().alias("failed_transactions"),
        F.sum("TXN_AMOUNT_USD").alias("total_value_usd"),
        F.sum("FEE_AMOUNT_LOCAL").alias("total_fee_revenue_local"),
        (kpi.avg_exact("PROCESSING_TIME_SECS") / F.lit(60.0)).alias("avg_processing_time_mins"),
        uniq.alias("unique_customers"),
        *([known.alias("known_customers")] if known_customers else []),
    )
    return g.withColumn("success_rate_pct", _div0("successful_transactions", "total_transactions") * F.lit(100.0)).withColumn(
        "failure_rate_pct", _div0("failed_transactions", "total_transactions") * F.lit(100.0)
    )


def monthly_measures(txns: DataFrame, by: list[str], known_customers: bool = False) -> DataFrame:
    return base_measures(with_month(txns), [MONTH, *by], known_customers=known_customers)


# ---------------------------------------------------------------- M10-M21
def _shifted(value: str, by: list[str], months: int) -> Column:
    """The value of the same group exactly ``months`` calendar months earlier (NULL when absent).

    A range frame on the month index selects at most one row, so this is a
    calendar shift, not a LAG to the previous present month, and it needs no
    self-join: one window partitioned by the group over the monthly aggregate.
    """
    w = Window.partitionBy(*by).orderBy(kpi.month_index(MONTH)).rangeBetween(-months, -months)
    return F.max(value).over(w)


def prior_period_measures(monthly: DataFrame, by: list[str]) -> DataFrame:
    """LM / LY values by calendar shift and the growth measures built on them.

    A row exists for every month of the data's calendar in which a group has a
    value now, a month ago or a year ago: a group that stops selling shows
    blank counts, rates of 0 and a growth of -100 %. Each monthly row is dealt
    to the three months it counts for, and one aggregate per (month, group)
    puts them together: no self-join, no window.
    """
    values = [c for c in monthly.columns if c not in (MONTH, *by)]
    ends = monthly.select(F.max(MONTH)).scalar()
    dealt = monthly.select(
        *by, F.struct(*values).alias("_v"), F.explode(F.array(*[F.lit(k) for k in (0, 1, 12)])).alias("_k"), F.col(MONTH).alias("_from")
    ).withColumn(MONTH, F.add_months("_from", F.col("_k")))

    def ago(months: int) -> Column:
        return F.max(F.when(F.col("_k") == months, F.col("_v")))

    met = dealt.filter(F.col(MONTH) <= ends).groupBy(MONTH, *by).agg(ago(0).alias("_now"), ago(1).alias("_lm"), ago(12).alias("_ly"))
    rates = ("success_rate_pct", "failure_rate_pct")  # DIVIDE(.., .., 0): 0, not blank, without transactions
    now = [(F.coalesce(F.col(f"_now.{c}"), F.lit(0.0)) if c in rates else F.col(f"_now.{c}")).alias(c) for c in values]
    j = met.select(
        MONTH, *by, *now,
        F.col("_lm.total_transactions").alias("transactions_lm"),
        F.col("_lm.total_value_usd").alias("value_usd_lm"),
        F.col("_lm.unique_customers").alias("customers_lm"),
        F.col("_ly.total_transactions").alias("transactions_ly"),
        F.col("_ly.total_value_usd").alias("value_usd_ly"),
        F.coalesce("_lm.success_rate_pct", F.lit(0.0)).alias("success_rate_lm"),
    )

    def growth(value: str, prior: str) -> Column:
        return _divb(F.coalesce(F.col(value), F.lit(0)) - F.col(prior), prior) * F.lit(100.0)  # blank counts as 0 in a difference

    g = (
        j.withColumn("mom_volume_growth_pct", growth("total_transactions", "transactions_lm"))
        .withColumn("yoy_volume_growth_pct", growth("total_transactions", "transactions_ly"))
        .withColumn("mom_value_growth_pct", growth("total_value_usd", "value_usd_lm"))
        .withColumn("mom_success_rate_change_pp", F.col("success_rate_pct") - F.col("success_rate_lm"))
        .withColumn("mom_customer_growth_pct", growth("unique_customers", "customers_lm"))
    )
    return g.withColumn("mom_arrow", kpi.arrow("mom_volume_growth_pct", weak_inclusive=False, blank=EM_DASH))


# ---------------------------------------------------------------- M22-M26
def attainment_measures(monthly: DataFrame, targets: DataFrame) -> DataFrame:
    """Volume/value attainment vs the month's target, RAGs, and SR RAG vs the best target of any month.

    ``monthly`` must be keyed by (month, PRODUCT, SUBSIDIARY). A month with
    transactions but no target and a target without transactions both have a
    row (attainment 0, RED), hence the full join.
    """
    t = targets.groupBy(
        F.col("PRODUCT").alias("_p"), F.col("SUBSIDIARY_NAME").alias("_s"), F.to_date("TARGET_MONTH").alias("_m")
    ).agg(F.sum("TARGET_VOLUME").alias("target_volume"), F.sum("TARGET_VALUE_USD").alias("target_value_usd"))
    sr = targets.groupBy(F.col("PRODUCT").alias("_p2"), F.col("SUBSIDIARY_NAME").alias("_s2")).agg(
        F.max("TARGET_SUCCESS_RATE").alias("target_success_rate")
    )
    j = monthly.join(
        t, (F.col("PRODUCT") == F.col("_p")) & (F.col("SUBSIDIARY") == F.col("_s")) & (F.col(MONTH) == F.col("_m")), "full"
    )
    j = j.withColumns({
        MONTH: F.coalesce(MONTH, "_m"), "PRODUCT": F.coalesce("PRODUCT", "_p"), "SUBSIDIARY": F.coalesce("SUBSIDIARY", "_s"),
        "success_rate_pct": F.coalesce("success_rate_pct", F.lit(0.0)),
    })
    j = j.join(broadcast_if_small(sr), (F.col("PRODUCT") == F.col("_p2")) & (F.col("SUBSIDIARY") == F.col("_s2")), "left")
    vol = _div0("total_transactions", "target_volume") * F.lit(100.0)
    val = _div0("total_value_usd", "target_value_usd") * F.lit(100.0)
    tsr = F.coalesce(F.col("target_success_rate").cast("double"), F.lit(0.0))  # blank compares as 0
    out = j.select(
        MONTH, "PRODUCT", "SUBSIDIARY", "total_transactions", "total_value_usd", "success_rate_pct",
        F.col("target_volume"), F.col("target_value_usd"), F.col("target_success_rate"),
        vol.alias("volume_attainment_pct"), val.alias("value_attainment_pct"),
    )
    v = F.col("volume_attainment_pct")
    out = out.withColumn("volume_rag", F.when(v >= 95, "GREEN").when(v >= 80, "AMBER").otherwise("RED"))
    out = out.withColumn(
        "volume_rag_numeric",
        F.when(F.col("volume_rag") == "GREEN", 1).when(F.col("volume_rag") == "AMBER", 2).otherwise(3).cast("bigint"),
    )
    s = F.col("success_rate_pct")
    return out.withColumn(
        "success_rate_rag", F.when(s >= tsr, "GREEN").when(s >= tsr - F.lit(5.0), "AMBER").otherwise("RED")
    )


# ---------------------------------------------------------------- calendar
def date_table(txns: DataFrame) -> DataFrame:
    """The day calendar the time-intelligence measures assume: every date from the first to the
    last transaction with its month (``Date``, ``MonthYear``, ``Year``, ``Month``).

    The bounds are one global aggregate; ``sequence`` expands them on one row,
    so the calendar's size is the number of days, independent of the fact size.
    """
    b = txns.agg(F.min(kpi.txn_date(D)).alias("_lo"), F.max(kpi.txn_date(D)).alias("_hi"))
    days = b.select(F.explode(F.sequence("_lo", "_hi")).alias("Date"))
    return days.select(
        "Date",
        F.date_format("Date", "MMM yyyy").alias("MonthYear"),
        F.year("Date").alias("Year"),
        F.month("Date").alias("Month"),
    )


# ---------------------------------------------------------------- spine
def month_spine(monthly: DataFrame, by: list[str]) -> DataFrame:
    """Every calendar month between the first and last month of the data, for every ``by`` group.

    The calendar bounds are scalar subqueries over the (small) monthly
    aggregate; each group row is expanded with ``sequence``.
    """
    step = F.expr("INTERVAL 1 MONTH")
    if not by:
        bounds = monthly.agg(F.min(MONTH).alias("_lo"), F.max(MONTH).alias("_hi"))
        spine = bounds.select(F.explode(F.sequence("_lo", "_hi", step)).alias(MONTH))
    else:
        lo = monthly.select(F.min(MONTH)).scalar()
        hi = monthly.select(F.max(MONTH)).scalar()
        spine = monthly.select(*by).distinct().select(*by, F.explode(F.sequence(lo, hi, step)).alias(MONTH))
    return spine.join(monthly, [MONTH, *by], "left")


# ---------------------------------------------------------------- M27-M29
def rolling_measures(monthly: DataFrame, by: list[str], months: int = 3) -> DataFrame:
    """Rolling mean of monthly success rate (empty month = 0) and of volume (empty month skipped)."""
    s = month_spine(monthly, by)
    sr = F.coalesce("success_rate_pct", F.lit(0.0))
    w = Window.partitionBy(*by).orderBy(MONTH).rowsBetween(-(months - 1), 0) if by else Window.orderBy(MONTH).rowsBetween(-(months - 1), 0)
    return s.select(
        MONTH,
        *by,
        F.col("total_transactions"),
        sr.alias("success_rate_pct"),
        F.avg(sr).over(w).alias("rolling_3m_avg_success_rate"),
        F.avg("total_transactions").over(w).alias("rolling_3m_avg_transactions"),
    ).withColumn("sr_vs_rolling_3m", F.col("success_rate_pct") - F.col("rolling_3m_avg_success_rate"))


# ---------------------------------------------------------------- M30-M32
def ytd_measures(monthly: DataFrame, by: list[str]) -> DataFrame:
    """Year-to-date transactions and value, and YTD growth vs the same point of the prior year."""
    s = month_spine(monthly, by)
    w = Window.partitionBy(*by, F.year(MONTH)).orderBy(MONTH).rowsBetween(Window.unboundedPreceding, 0)
    y = s.select(
        MONTH,
        *by,
        F.sum("total_transactions").over(w).alias("ytd_transactions"),
        F.sum("total_value_usd").over(w).alias("ytd_value_usd"),
    )
    j = y.withColumn("_py", _shifted("ytd_transactions", by, 12))
    return j.select(
        MONTH,
        *by,
        "ytd_transactions",
        "ytd_value_usd",
        (_divb(F.coalesce("ytd_transactions", F.lit(0)) - F.col("_py"), "_py") * F.lit(100.0)).alias("ytd_vs_prior_year_pct"),
    )


def ytd_as_of(totals: DataFrame, as_of: dt.date) -> DataFrame:
    """M30-M32 through a day, per subsidiary, from the kept day totals: this year up to ``as_of`` and last year up to the same day."""
    last = as_of.replace(year=as_of.year - 1, day=28 if (as_of.month, as_of.day) == (2, 29) else as_of.day)

    def through(day: dt.date, column: str) -> Column:
        return F.sum(F.when(F.col("day").between(F.lit(dt.date(day.year, 1, 1)), F.lit(day)), F.col(column)))

    y = totals.filter(F.col("day").between(F.lit(dt.date(last.year, 1, 1)), F.lit(as_of))).groupBy("SUBSIDIARY").agg(
        through(as_of, "total_transactions").alias("ytd_transactions"), through(as_of, "total_value_usd").alias("ytd_value_usd"),
        through(last, "total_transactions").alias("_py"),
    )
    growth = _divb(F.coalesce("ytd_transactions", F.lit(0)) - F.col("_py"), "_py") * F.lit(100.0)
    return y.select("SUBSIDIARY", "ytd_transactions", "ytd_value_usd", growth.alias("ytd_vs_prior_year_pct"))


# ---------------------------------------------------------------- M33-M35
def agent_activity_measures(txns: DataFrame, by: list[str], agency_product: str, more: list[Column] | None = None) -> DataFrame:
    """Active agents (successful agency transactions, non-blank agent) and successful txns per agent.

    ``more`` aggregates go into the same pass.
    """
    active = kpi.status_is(kpi.SUCCESS) & F.col("AGENT_ID").isNotNull() & (F.col("AGENT_ID") != "") & (
        F.col("PRODUCT") == F.lit(agency_product)
    )
    g = txns.groupBy(*by).agg(
        F.countDistinct(F.when(active, F.col("AGENT_ID"))).alias("active_agents"),
        kpi.successes().alias("successful_transactions"),
        *(more or []),
    )
    return g.withColumn("txns_per_active_agent", _div0("successful_transactions", "active_agents"))


def float_utilisation_ratio(txns: DataFrame, agents: DataFrame) -> DataFrame:
    """Per agent: local value of all its transactions / its float limit; 0 when the limit is 0 or absent."""
    v = txns.filter(kpi.non_blank("AGENT_ID")).groupBy("AGENT_ID").agg(F.sum("TXN_AMOUNT_LOCAL").alias("value_local"))
    lim = agents.groupBy("AGENT_ID").agg(F.sum("FLOAT_LIMIT_KES").alias("float_limit"))
    return v.join(lim, "AGENT_ID", "left").select(
        "AGENT_ID", "value_local", "float_limit", _div0("value_local", "float_limit").alias("float_utilisation_ratio")
    )


# ---------------------------------------------------------------- M36-M39
def corridor_column(src: str = "SOURCE_COUNTRY", dst: str = "DEST_COUNTRY") -> Column:
    """Calculated column: blank ends become empty text, so the corridor is never NULL."""
    return F.concat(F.coalesce(F.col(src), F.lit("")), F.lit("->"), F.coalesce(F.col(dst), F.lit("")))


def cross_border_volume(txns: DataFrame, by: list[str], remit_product: str) -> DataFrame:
    cb = (F.col("PRODUCT") == F.lit(remit_product)) & (F.col("SOURCE_COUNTRY") != F.col("DEST_COUNTRY"))
    return txns.groupBy(*by).agg(F.sum(F.when(cb, F.col("TXN_AMOUNT_USD"))).alias("cross_border_volume_usd"))


def new_customers(txns: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Customers whose first transaction falls in the month (set difference with all earlier customers).

    One aggregate to each customer's first month, then a count per month:
    no anti-join against the growing set of earlier customers.
    """
    by = by or []
    first = txns.groupBy("CUSTOMER_ID", *by).agg(F.min(kpi.month_date(D)).alias(MONTH))
    return first.groupBy(MONTH, *by).agg(F.count(F.lit(1)).alias("new_customers"))


def revenue_per_customer(base: DataFrame) -> DataFrame:
    return base.withColumn("revenue_per_customer_usd", _div0("total_value_usd", "unique_customers"))


# ---------------------------------------------------------------- M40-M42
def dense_rank_desc(df: DataFrame, value: str, out: str, within: list[str] | None = None) -> DataFrame:
    """RANKX(..., DESC, DENSE) over an aggregate (one row per ranked member)."""
    w = Window.partitionBy(*within).orderBy(F.col(value).desc_nulls_last()) if within else Window.orderBy(F.col(value).desc_nulls_last())
    return df.withColumn(out, F.dense_rank().over(w))


def report_title(as_of: Column, prefix: str = "Payments Performance") -> Column:
    """``prefix — <Month YYYY>`` of the last full month before ``as_of``."""
    eom = F.last_day(F.add_months(as_of, -1))
    return F.concat(F.lit(prefix + " " + EM_DASH + " "), F.date_format(eom, "MMMM yyyy"))


def report_title_for(txns: DataFrame, as_of: dt.date | None = None, prefix: str = "Payments Performance") -> DataFrame:
    """One-row title; without ``as_of`` the day after the last transaction is the report date."""
    if as_of is not None:
        anchor = F.lit(as_of)
        return txns.agg(F.count(F.lit(1)).alias("_n")).select(report_title(anchor, prefix).alias("report_title"))
    return txns.agg(F.max(kpi.txn_date(D)).alias("_d")).select(
        F.col("_d").alias("last_txn_date"), report_title(F.date_add("_d", 1), prefix).alias("report_title")
    )

