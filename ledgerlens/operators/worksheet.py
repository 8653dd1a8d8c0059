"""Worksheet formulas (X1-X10) as DataFrame operators.

A formula evaluated per worksheet row (COUNTIFS, SUMPRODUCT, XLOOKUP) becomes
one aggregate over the fact plus a join to the row set; the spilled dynamic
arrays become long or pivoted DataFrames. "Last month" is the last full
calendar month before ``as_of`` (``EOMONTH(TODAY(),-1)``).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import kpi
from ledgerlens.plans.joins import broadcast_if_small
from ledgerlens.params import add_months, prior_month_bounds
from ledgerlens.plans.ordered import running_sum

D = "TRANSACTION_DATE"


def with_txn_month(txns: DataFrame) -> DataFrame:
    """The ``TXN_MONTH`` helper column (``yyyy-MM``)."""
    return txns.withColumn("TXN_MONTH", kpi.month_key(D))


def _last_month(txns: DataFrame, as_of: dt.date, back: int = 1) -> DataFrame:
    start, end = prior_month_bounds(as_of)
    if back > 1:
        start, end = add_months(start, -(back - 1)), add_months(end, -(back - 1))
    return kpi.date_window(txns, start, end)


def _in_month(start: dt.date) -> Column:
    return (F.col(D) >= F.lit(start)) & (F.col(D) < F.lit(add_months(start, 1)))


# The row labels of X1-X3 and X6 are all keys of the history, so these reports
# are one aggregate of it with the months as conditions, not a second scan. Over
# a long history pass the monthly rollup's labels as ``labels`` instead: then
# only the months of the formula are read.
def _labelled(txns: DataFrame, labels: DataFrame | None, keys: list[str], start: dt.date, end: dt.date, aggs: list[Column]) -> DataFrame:
    if labels is None:
        return txns.groupBy(*keys).agg(*aggs)
    c = kpi.date_window(txns, start, end).groupBy(*keys).agg(*aggs)
    same = [labels[k].eqNullSafe(c[k]) for k in keys]
    return labels.select(*keys).distinct().join(c, same, "left").select(*[labels[k] for k in keys], *[c[x] for x in c.columns if x not in keys])


# ---------------------------------------------------------------- X1
def last_month_volume(txns: DataFrame, as_of: dt.date, subsidiary: str, labels: DataFrame | None = None) -> DataFrame:
    """Per product: transactions of ``subsidiary`` in the last full month (0 when none)."""
    start, end = prior_month_bounds(as_of)
    n = kpi.count_when(_in_month(start) & (F.col("SUBSIDIARY") == F.lit(subsidiary))).alias("last_month_txns")
    return _labelled(txns, labels, ["PRODUCT"], start, end, [n]).select(
        "PRODUCT", F.coalesce("last_month_txns", F.lit(0)).cast("bigint").alias("last_month_txns")
    )


# ---------------------------------------------------------------- X2
def last_month_success_rate(txns: DataFrame, as_of: dt.date, labels: DataFrame | None = None) -> DataFrame:
    """Per product x subsidiary: success share of last month's transactions; no rows -> 0."""
    start, end = prior_month_bounds(as_of)
    month = _in_month(start)
    aggs = [kpi.count_when(month).alias("n"), kpi.count_when(month & kpi.status_is(kpi.SUCCESS)).alias("s")]
    return _labelled(txns, labels, ["PRODUCT", "SUBSIDIARY"], start, end, aggs).select(
        "PRODUCT",
        "SUBSIDIARY",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("last_month_txns"),
        F.coalesce(kpi.ratio("s", "n"), F.lit(0.0)).alias("success_rate"),
    )


# ---------------------------------------------------------------- X3
def volume_rag(txns: DataFrame, targets: DataFrame, as_of: dt.date, labels: DataFrame | None = None) -> DataFrame:
    """Last-month volume vs target looked up on the concatenated product & subsidiary key.

    A missing target counts as 0, so attainment is 0 and the status RED. With
    several target months for one key the earliest month is taken (the lookup
    returns the first match).
    """
    start, end = prior_month_bounds(as_of)
    rows = _labelled(txns, labels, ["PRODUCT", "SUBSIDIARY"], start, end, [kpi.count_when(_in_month(start)).alias("actual")])
    t = targets.groupBy(F.concat("PRODUCT", "SUBSIDIARY_NAME").alias("_key")).agg(
        F.min_by("TARGET_VOLUME", "TARGET_MONTH").alias("target")
    )
    j = rows.join(broadcast_if_small(t), F.concat("PRODUCT", "SUBSIDIARY") == F.col("_key"), "left")
    att = F.coalesce(kpi.ratio(F.coalesce("actual", F.lit(0)), F.coalesce("target", F.lit(0))), F.lit(0.0))
    return j.select(
        "PRODUCT",
        "SUBSIDIARY",
        F.coalesce("actual", F.lit(0)).cast("bigint").alias("actual"),
        F.coalesce("target", F.lit(0)).cast("bigint").alias("target"),
        att.alias("attainment"),
        kpi.rag_on_ratio(att).alias("rag"),
    )


# ---------------------------------------------------------------- X4
def top_failures(txns: DataFrame, as_of: dt.date, n: int = 5) -> DataFrame:
    """Top ``n`` failure descriptions of the last full month by count (ties by description)."""
    return (
        _last_month(txns, as_of)
        .filter(kpi.status_is(kpi.FAILED) & F.col("FAILURE_DESCRIPTION").isNotNull() & (F.col("FAILURE_DESCRIPTION") != ""))
        .groupBy("FAILURE_DESCRIPTION")
        .agg(F.count(F.lit(1)).alias("failures"))
        .orderBy(F.col("failures").desc(), F.col("FAILURE_DESCRIPTION").asc())
        .limit(n)
    )


# ---------------------------------------------------------------- X5
def channel_product_sr(txns: DataFrame) -> DataFrame:
    """Channel x product success share over all history, long form: every pair that occurs, whatever the products."""
    return txns.groupBy("CHANNEL", "PRODUCT").agg(
        F.count(F.lit(1)).alias("total_transactions"), kpi.ratio(kpi.successes(), F.count(F.lit(1))).alias("success_rate")
    )


#: column of the rows without a product, where the list has None
BLANK = "(blank)"


def _listed(products: list[str | None]) -> Column:
    named = F.coalesce(F.col("PRODUCT").isin(*[p for p in products if p is not None]), F.lit(False))
    return named | F.col("PRODUCT").isNull() if None in products else named


def listed_only(products: list[str | None], value: Column) -> Column:
    """``value`` of a wide aggregate, which fails if a row's product is not among the columns (instead of losing it)."""
    extra = F.min(F.when(~_listed(products), F.coalesce("PRODUCT", F.lit("NULL"))))
    return F.when(extra.isNotNull(), F.raise_error(F.concat(F.lit("product without a column: "), extra))).otherwise(value)


def channel_product_sr_matrix(txns: DataFrame, products: list[str | None]) -> DataFrame:
    """Channel rows x product columns of success share over all history; empty cell -> 0.

    The product columns are an explicit list (the schema of a wide result must
    be known before the job runs); each cell is a conditional aggregate, so the
    whole matrix is one pass with map-side partial aggregation. A product that
    is not listed makes the job fail; ``sources.labels.values`` lists them all,
    and the long form has no list. None in the list is the column ``BLANK``.
    """
    ok = kpi.status_is(kpi.SUCCESS)
    aggs = []
    for p in products:
        is_p = F.col("PRODUCT").eqNullSafe(F.lit(p))
        cell = F.coalesce(kpi.ratio(kpi.count_when(is_p & ok), kpi.count_when(is_p)), F.lit(0.0))
        aggs.append((cell if aggs else listed_only(products, cell)).alias(BLANK if p is None else p))
    return txns.groupBy("CHANNEL").agg(*aggs)


# ---------------------------------------------------------------- X6
def mom_arrow(txns: DataFrame, as_of: dt.date, labels: DataFrame | None = None) -> DataFrame:
    """Per product: last vs previous full month volume, growth (0 on error) and arrow text."""
    s1, e1 = prior_month_bounds(as_of)
    s2 = add_months(s1, -1)
    aggs = [kpi.count_when(_in_month(s1)).alias("curr"), kpi.count_when(_in_month(s2)).alias("prev")]
    r = _labelled(txns, labels, ["PRODUCT"], s2, e1, aggs).select(
        "PRODUCT",
        F.coalesce("curr", F.lit(0)).cast("bigint").alias("curr_txns"),
        F.coalesce("prev", F.lit(0)).cast("bigint").alias("prev_txns"),
    )
    g = F.coalesce(kpi.pct_change("curr_txns", "prev_txns"), F.lit(0.0))
    return r.select("*", kpi.rnd(g, 1).alias("mom_pct"), kpi.arrow(g, weak_inclusive=True).alias("mom_arrow"))


# ---------------------------------------------------------------- X7
def float_utilisation(txns: DataFrame, agents: DataFrame, as_of: dt.date) -> DataFrame:
    """Per agent of the agent table or with transactions last month: local value (any product) / float limit.

    The rows are the worksheet's agent list, with 0 for an agent without
    transactions. An agent missing from that list gets limit 1; a zero limit
    gives NULL (the worksheet shows "N/A"). Only last month is read.
    """
    v = _last_month(txns, as_of).filter(kpi.non_blank("AGENT_ID")).groupBy("AGENT_ID").agg(
        F.sum("TXN_AMOUNT_LOCAL").alias("value_local")
    )
    lim = agents.filter(kpi.non_blank("AGENT_ID")).select("AGENT_ID", "FLOAT_LIMIT_KES")
    j = lim.join(v, "AGENT_ID", "full")
    limit = F.coalesce("FLOAT_LIMIT_KES", F.lit(1))  # a blank limit counts as no entry
    value = F.coalesce("value_local", F.lit(0))
    return j.select(
        "AGENT_ID",
        kpi.rnd(value, 2).alias("value_local"),
        limit.cast("bigint").alias("float_limit"),
        kpi.rnd(kpi.ratio(value, limit), 2).alias("float_utilisation"),
    )


# ---------------------------------------------------------------- X8
def corridor_month_matrix(txns: DataFrame, product: str, restrict_product: bool = False) -> DataFrame:
    """Month x corridor USD value, long form (absent cells are 0 in the matrix).

    Corridors and months come from the remittance product's cross-border rows
    (``<>``, so NULL ends are excluded); the cells sum *all* products on those
    corridors and months, as the worksheet does, unless ``restrict_product``.
    One aggregate of the fact per (month, corridor) carries the value and
    whether a remittance row is in it; the label sets are windows over that.
    """
    t = with_txn_month(txns).withColumn("corridor", F.concat("SOURCE_COUNTRY", F.lit("->"), "DEST_COUNTRY"))
    mine = F.col("PRODUCT") == F.lit(product)
    remit = mine & (F.col("SOURCE_COUNTRY") != F.col("DEST_COUNTRY"))
    counted = mine if restrict_product else F.lit(True)
    cells = t.filter(F.col("corridor").isNotNull()).groupBy("TXN_MONTH", "corridor").agg(
        F.sum(F.when(counted, F.col("TXN_AMOUNT_USD"))).alias("_value"),
        kpi.count_when(counted).alias("_rows"),
        F.max(F.when(remit, 1).otherwise(0)).alias("_remit"),
    )
    in_corridor = F.max("_remit").over(Window.partitionBy("corridor"))
    in_month = F.max("_remit").over(Window.partitionBy("TXN_MONTH"))
    kept = cells.withColumn("_c", in_corridor).withColumn("_m", in_month).filter("_c = 1 AND _m = 1 AND _rows > 0")
    return kept.select("TXN_MONTH", "corridor", kpi.rnd("_value", 2).alias("value_usd"))


def corridor_month_grid(long: DataFrame) -> DataFrame:
    """The spilled matrix with its zeros, long form: every month x every corridor of ``corridor_month_matrix``.

    Each corridor's months are collected from the distinct months (a calendar's
    worth, not transactions), so the grid needs no list of columns.
    """
    months = long.select(F.sort_array(F.collect_set("TXN_MONTH")).alias("months"))
    corridors = long.groupBy("corridor").agg(F.map_from_entries(F.collect_list(F.struct("TXN_MONTH", "value_usd"))).alias("_v"))
    spread = corridors.withColumn("TXN_MONTH", F.explode(months.scalar()))
    return spread.select("TXN_MONTH", "corridor", F.coalesce(F.element_at("_v", F.col("TXN_MONTH")), F.lit(0.0)).alias("value_usd"))


def pivot_corridors(long: DataFrame, corridors: list[str]) -> DataFrame:
    """The spilled matrix: one row per month, one column per corridor, 0 where empty; a corridor that is not listed fails."""
    extra = F.when(~F.col("corridor").isin(*corridors), F.raise_error(F.concat(F.lit("corridor without a column: "), "corridor")))
    checked = long.withColumn("corridor", F.coalesce(extra.cast("string"), "corridor"))
    return checked.groupBy("TXN_MONTH").pivot("corridor", corridors).agg(F.first("value_usd")).fillna(0.0)


# ---------------------------------------------------------------- X9
def ytd_running_total(
    txns: DataFrame,
    as_of: dt.date,
    subsidiary: str,
    order_cols: tuple[str, ...] = ("TXN_AMOUNT_USD", "CUSTOMER_ID", "PRODUCT", "CHANNEL"),
    days: tuple[dt.date, dt.date] | None = None,
    totals: DataFrame | None = None,
) -> DataFrame:
    """Row-level running sum of successful USD value this year, in date then ``order_cols`` order.

    The scan runs distributed (``plans.ordered.running_sum``): no task holds a
    whole subsidiary-year or day. The row order is made total by
    ``order_cols``; rows equal on all of them are interchangeable.

    ``days`` (first, last) of that year: only their rows, which is all that is
    read; what came before is a sum of the kept day totals (``totals``).
    """
    start, end = dt.date(as_of.year, 1, 1), dt.date(as_of.year + 1, 1, 1)
    before = F.lit(0)
    if days is not None:
        if totals is None or not start <= days[0] <= days[1] < end:
            raise ValueError("days of the year of as_of, with the day totals before them")
        earlier = (F.col("day") >= F.lit(start)) & (F.col("day") < F.lit(days[0])) & (F.col("SUBSIDIARY") == F.lit(subsidiary))
        before = F.coalesce(totals.filter(earlier).select(F.sum("successful_value_usd")).scalar(), F.lit(0))
        start, end = days[0], days[1] + dt.timedelta(days=1)
    f = kpi.date_window(txns, start, end).filter(
        (F.col("SUBSIDIARY") == F.lit(subsidiary)) & kpi.status_is(kpi.SUCCESS)
    ).select(kpi.txn_date(D).alias("txn_date"), *order_cols)
    r = running_sum(f, "TXN_AMOUNT_USD", [], ["txn_date", *order_cols], "_ytd")
    return r.select("txn_date", *order_cols, kpi.rnd(F.col("_ytd") + before, 4).alias("ytd_usd"))


# ---------------------------------------------------------------- X10
def rolling_mean(df: DataFrame, value: str, order: str, partition: list[str], rows: int = 3, out: str | None = None) -> DataFrame:
    """Mean of the current and ``rows - 1`` preceding rows (OFFSET(-2,0,3) intent; short at the start)."""
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(-(rows - 1), 0)
    return df.withColumn(out or f"rolling_{rows}_{value}", F.avg(value).over(w))
