"""Statistical jobs: rolling z-score anomalies (P1), complete months (P1b),
two-proportion A/B test (P2) and linear volume forecast (P4).

The per-series Python loops of the original become window functions
partitioned by series, so every series is processed in parallel and only the
small monthly aggregate is windowed.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import kpi
from ledgerlens.params import month_start

D = "TRANSACTION_DATE"


def monthly_volume(txns: DataFrame, series: list[str], monthly: DataFrame | None = None) -> DataFrame:
    """``month`` (yyyy-MM) x series keys -> ``total_txns``; ``monthly`` is a kept rollup of the base measures by ``series``."""
    if monthly is not None:
        return monthly.select(F.date_format("month", "yyyy-MM").alias("month"), *series, F.col("total_transactions").alias("total_txns"))
    return txns.groupBy(kpi.month_key(D).alias("month"), *series).agg(F.count(F.lit(1)).alias("total_txns"))


# ---------------------------------------------------------------- P1
def zscore_anomalies(
    txns: DataFrame,
    series: tuple[str, ...] = ("PRODUCT", "SUBSIDIARY"),
    window: int = 5,
    min_periods: int = 3,
    threshold: float = 1.3,
    min_days: int | None = None,
    monthly: DataFrame | None = None,
) -> DataFrame:
    """Months whose volume deviates from the trailing mean by more than ``threshold`` sample SDs.

    The rolling frame includes the current month (as pandas ``rolling`` does);
    z is rounded to 2 dp before the strict ``abs(z) > threshold`` test; a zero
    SD gives no z. Sorted by ``abs(z)`` descending (the report prints the top 10).
    ``min_days`` drops partial months (fewer distinct dates) before the
    windows, the filter the original recommends for its partial-month drops.
    """
    m = monthly_volume(txns, list(series), monthly)
    if min_days is not None:
        full = complete_months(txns, min_days).filter("is_complete").select("month")
        m = m.join(full, "month", "left_semi")
    w = Window.partitionBy(*series).orderBy("month").rowsBetween(-(window - 1), 0)
    n = F.count("total_txns").over(w)
    mean = F.when(n >= min_periods, F.avg("total_txns").over(w))
    sd = F.when(n >= min_periods, F.stddev_samp("total_txns").over(w))
    z = m.select(
        "month", *series, "total_txns", mean.alias("roll_mean"), sd.alias("roll_std")
    ).withColumn(
        "z_score", kpi.rnd((F.col("total_txns") - F.col("roll_mean")) / F.nullif(F.col("roll_std"), F.lit(0.0)), 2)
    )
    return (
        z.filter(F.abs("z_score") > F.lit(threshold))
        .select(
            "month",
            *series,
            "total_txns",
            kpi.rnd("roll_mean", 2).alias("roll_mean"),
            "z_score",
            F.when(F.col("z_score") > 0, "SPIKE").otherwise("DROP").alias("direction"),
        )
        .orderBy(F.abs("z_score").desc(), "month", *series)
    )


# ---------------------------------------------------------------- P1b
def complete_months(txns: DataFrame, min_days: int = 28, days: DataFrame | None = None) -> DataFrame:
    """Months with at least ``min_days`` distinct transaction dates (partial-month guard).

    ``days``: the kept day totals, so that no transaction is read.
    """
    if days is not None:
        per = days.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.countDistinct("day").alias("day_count"), F.sum("total_transactions").alias("total_txns"))
        return per.withColumn("is_complete", F.col("day_count") >= min_days)
    return (
        txns.groupBy(kpi.month_key(D).alias("month"))
        .agg(F.countDistinct(kpi.txn_date(D)).alias("day_count"), F.count(F.lit(1)).alias("total_txns"))
        .withColumn("is_complete", F.col("day_count") >= min_days)
    )


# ---------------------------------------------------------------- P2
# Abramowitz & Stegun 26.2.17 normal tail polynomial (fixed published constants)
AS_P = 0.2316419
AS_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_two_sided_p(z: Column) -> Column:
    """``2 * (1 - Phi(|z|))`` with the A&S 26.2.17 polynomial (abs error < 7.5e-8 per tail)."""
    x = F.abs(z)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(AS_P) * x)
    poly = F.lit(0.0)
    for b in reversed(AS_B):
        poly = (poly + F.lit(b)) * t
    pdf = F.exp(-(x * x) / F.lit(2.0)) / F.lit(math.sqrt(2.0 * math.pi))
    return F.lit(2.0) * pdf * poly


def ab_test_success_rate(
    txns: DataFrame,
    control: str,
    treatment: str,
    product: str,
    as_of: dt.date,
    days: int = 90,
    alpha: float = 0.05,
) -> DataFrame:
    """Pooled two-proportion z-test of success rate, treatment vs control channel.

    One global aggregate with conditional counts produces the single result row.
    """
    start = as_of - dt.timedelta(days=days)
    f = kpi.date_window(txns, start).filter(F.col("CHANNEL").isin(control, treatment) & (F.col("PRODUCT") == F.lit(product)))
    is_c, is_t = F.col("CHANNEL") == F.lit(control), F.col("CHANNEL") == F.lit(treatment)
    ok = kpi.status_is(kpi.SUCCESS)
    a = f.agg(
        kpi.count_when(is_c).alias("n_control"),
        kpi.count_when(is_c & ok).alias("s_control"),
        kpi.count_when(is_t).alias("n_treatment"),
        kpi.count_when(is_t & ok).alias("s_treatment"),
    )
    pc = kpi.ratio("s_control", "n_control")
    pt = kpi.ratio("s_treatment", "n_treatment")
    pool = kpi.ratio(F.col("s_control") + F.col("s_treatment"), F.col("n_control") + F.col("n_treatment"))
    se = F.sqrt(pool * (F.lit(1.0) - pool) * (F.lit(1.0) / kpi.as_double("n_control") + F.lit(1.0) / kpi.as_double("n_treatment")))
    z = (pt - pc) / F.nullif(se, F.lit(0.0))
    r = a.select("*", pc.alias("_pc"), pt.alias("_pt"), z.alias("_z"))
    p = normal_two_sided_p(F.col("_z"))
    return r.select(
        F.lit(control).alias("control"),
        F.lit(treatment).alias("treatment"),
        "n_control",
        "s_control",
        "n_treatment",
        "s_treatment",
        kpi.rnd(F.col("_pc") * 100.0, 2).alias("control_sr_pct"),
        kpi.rnd(F.col("_pt") * 100.0, 2).alias("treatment_sr_pct"),
        kpi.rnd((F.col("_pt") - F.col("_pc")) * 100.0, 2).alias("lift_pp"),
        kpi.rnd("_z", 3).alias("z"),
        kpi.rnd(p, 4).alias("p_value"),
        (p < F.lit(alpha)).alias("significant"),
    )


# ---------------------------------------------------------------- P4
def linear_forecast(
    txns: DataFrame,
    as_of: dt.date,
    series: tuple[str, ...] = ("PRODUCT", "SUBSIDIARY"),
    history: int = 10,
    horizon: int = 3,
    z: float = 1.96,
    monthly: DataFrame | None = None,
) -> DataFrame:
    """OLS trend on the last ``history`` complete months of each series, ``horizon`` months ahead.

    x is the month position 0..n-1. Slope and intercept are exact rationals of
    integer sums, so the point forecast truncates (Python ``int``) exactly;
    the band is ``z`` x population SD of the residuals; the lower bound is
    clipped at 0. One output row per series x step.
    """
    cur = month_start(as_of).strftime("%Y-%m")
    m = monthly_volume(kpi.date_window(txns, None, month_start(as_of)), list(series), monthly).filter(F.col("month") < cur)
    w_desc = Window.partitionBy(*series).orderBy(F.col("month").desc())
    tail = m.withColumn("_r", F.row_number().over(w_desc)).filter(F.col("_r") <= history)
    w_all = Window.partitionBy(*series)
    tail = tail.withColumn("_n", F.count(F.lit(1)).over(w_all)).withColumn("x", (F.col("_n") - F.col("_r")).cast("bigint"))
    y = F.col("total_txns")
    g = tail.groupBy(*series).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("x").alias("sx"),
        F.sum(y).alias("sy"),
        F.sum(F.col("x") * F.col("x")).alias("sxx"),
        F.sum(F.col("x") * y).alias("sxy"),
        F.max("month").alias("last_month"),
        F.regr_r2(y.cast("double"), F.col("x").cast("double")).alias("r2"),
    )
    den = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")  # n * Sxx, integer
    num = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    g = g.withColumn("_den", den).withColumn("_num", num).filter(F.col("_den") != 0)
    slope = kpi.as_double("_num") / kpi.as_double("_den")
    intercept = kpi.as_double(F.col("sy") * F.col("_den") - F.col("_num") * F.col("sx")) / kpi.as_double(F.col("n") * F.col("_den"))
    g = g.withColumn("slope", slope).withColumn("intercept", intercept)
    # residual spread: join the fit back to its own points (one row per month)
    res = tail.join(g.select(*series, "slope", "intercept"), list(series)).groupBy(*series).agg(
        F.stddev_pop(kpi.as_double("total_txns") - (F.col("intercept") + F.col("slope") * kpi.as_double("x"))).alias("_sd")
    )
    g = g.join(res, list(series))
    steps = g.select("*", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("step"))
    xf = F.col("n") + F.col("step")
    # exact point forecast numerator / denominator: (sy*den + num*(n*x - sx)) / (n*den)
    pnum = F.col("sy") * F.col("_den") + F.col("_num") * (F.col("n") * xf - F.col("sx"))
    pden = F.col("n") * F.col("_den")
    pred = kpi.as_double(pnum) / kpi.as_double(pden)
    ci = F.lit(z) * F.col("_sd")
    return steps.select(
        *series,
        F.date_format(F.add_months(F.to_date(F.concat("last_month", F.lit("-01"))), F.col("step") + 1), "yyyy-MM").alias("month"),
        (F.col("step") + 1).cast("bigint").alias("step"),
        F.expr("(sy * _den + _num * (n * (n + step) - sx)) div (n * _den)").alias("forecast"),
        F.greatest(F.lit(0), (pred - ci).cast("bigint")).alias("lower_95"),
        (pred + ci).cast("bigint").alias("upper_95"),
        kpi.rnd("slope", 1).alias("slope"),
        kpi.rnd("r2", 3).alias("r2"),
        F.col("n").alias("n_months"),
    ).orderBy(*series, "step")
