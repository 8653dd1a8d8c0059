"""Mergeable top-k: monthly lists of the most frequent values, with a bound on every value that is not listed.

The most frequent values of a period cannot be had by adding up months' top lists: a value may be just below the list every
month. So each month keeps its ``m`` most frequent values with their exact counts and the count of the next one, which
no unlisted value of that month exceeds. For any span of months these give each listed value a least and a greatest
possible count, and every unlisted one a greatest: the sum of the bounds. If the k-th least count exceeds what the others
can reach, and the k are settled among themselves, the lists alone give the exact top k. If only some listed values are in
doubt, those candidates are counted in the transactions of the span; if an unlisted value could enter, all are.

Lists are a few rows a month whatever the number of values, are made month by month (so a new month adds its own), and are
kept beside a materialised star.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import kpi
from ledgerlens.plans.joins import broadcast_if_small
from ledgerlens.sources.rollup import kept
from ledgerlens.sources.star import Star

D = "TRANSACTION_DATE"
MONTH = "month"
LISTED = 100


@dataclass(frozen=True)
class Counted:
    """What is counted: a value (NULL is none), the rows that count, and the groups each with a top k of their own."""

    name: str
    value: str  # SQL expression
    where: str = "TRUE"
    by: tuple[str, ...] = ()

    def rows(self, txns: DataFrame) -> DataFrame:
        return txns.filter(F.expr(self.where)).select(kpi.month_date(D).alias(MONTH), *self.by, F.expr(self.value).cast("string").alias("value")).filter("value is not null")


def lists(txns: DataFrame, what: Counted, listed: int = LISTED) -> DataFrame:
    """(month, groups, value, n): the ``listed`` most frequent values; the row with value NULL has the bound of the others."""
    counts = what.rows(txns).groupBy(MONTH, *what.by, "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy(MONTH, *what.by).orderBy(F.desc("n"), "value")
    top = counts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= listed + 1)
    return top.select(MONTH, *what.by, F.when(F.col("_r") <= listed, F.col("value")).alias("value"), "n")


def kept_lists(star: Star, what: Counted, listed: int = LISTED) -> DataFrame:
    return kept(star, f"top-{what.name}-{listed}", lambda txns: lists(txns, what, listed), MONTH)


def _span(first: dt.date | None, last: dt.date | None) -> Column:
    ends = ([F.col(MONTH) >= F.lit(first)] if first else []) + ([F.col(MONTH) <= F.lit(last)] if last else [])
    return reduce(lambda a, b: a & b, ends) if ends else F.lit(True)


def bounds(monthly: DataFrame, what: Counted, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
    """(groups, value, low, high) of every listed value of the span; the row with value NULL has what an unlisted one can reach."""
    by = list(what.by)
    span = monthly.filter(_span(first, last))
    rest = span.filter("value is null").select(MONTH, *by, F.col("n").alias("_rest"))
    own = span.filter("value is not null").select(*[F.col(c).alias(f"_{c}") for c in (MONTH, *by)], "value", "n")
    same = reduce(lambda a, b: a & b, (F.col(f"_{c}").eqNullSafe(F.col(c)) for c in (MONTH, *by)))
    met = own.join(rest, same, "left").groupBy(*[F.col(f"_{c}").alias(c) for c in by], "value").agg(
        F.sum("n").alias("low"), F.sum(F.coalesce("_rest", F.lit(0))).alias("_inside")
    )
    whole = (rest.groupBy(*by) if by else rest).agg(F.sum("_rest").alias("_all")).withColumnsRenamed({c: f"_{c}" for c in by})
    if by:
        joined = met.join(whole, reduce(lambda a, b: a & b, (F.col(f"_{c}").eqNullSafe(F.col(c)) for c in by)), "left")
    else:
        joined = met.withColumn("_all", whole.select("_all").scalar())
    listed = joined.select(*by, "value", "low", (F.col("low") + F.coalesce("_all", F.lit(0)) - F.col("_inside")).alias("high"))
    others = whole.select(*[F.col(f"_{c}").alias(c) for c in by], F.lit(None).cast("string").alias("value"), F.lit(0).cast("long").alias("low"), F.col("_all").alias("high"))
    return listed.unionByName(others.filter("high > 0"))


@dataclass(frozen=True)
class Top:
    """The rows (groups, value, n, rank) and how they were had: ``lists``, ``candidates`` (counted) or ``transactions``."""

    rows: DataFrame
    source: str


def top(star: Star, what: Counted, k: int, first: dt.date | None = None, last: dt.date | None = None, listed: int = LISTED) -> Top:
    """The ``k`` most frequent values of each group in the months ``first`` to ``last``; equal counts by value."""
    by = list(what.by)
    found = bounds(kept_lists(star, what, listed), what, first, last)
    w = Window.partitionBy(*by).orderBy(F.desc("low"), "value")
    # the k-th least count of the group: no value that cannot reach it is in the top k
    ranked = found.withColumn("_r", F.row_number().over(w)).withColumn("_kth", F.max(F.when(F.col("_r") == k, F.col("low"))).over(Window.partitionBy(*by)))
    ranked = ranked.withColumn("_kth", F.coalesce("_kth", F.lit(0)))
    candidates = ranked.filter(F.col("high") >= F.col("_kth"))
    doubt = candidates.agg(
        F.max(F.col("value").isNull()).alias("unlisted"), F.max(F.col("value").isNotNull() & (F.col("high") > F.col("low"))).alias("listed")
    ).first()
    if not doubt["unlisted"] and not doubt["listed"]:
        exact, source = candidates.select(*by, "value", F.col("low").alias("n")), "lists"
    else:
        rows = what.rows(kpi.date_window(star.transactions, first, None if last is None else _next_month(last)))
        source = "transactions" if doubt["unlisted"] else "candidates"
        if source == "candidates":
            some = broadcast_if_small(candidates.select("value").distinct().withColumnRenamed("value", "_v"))
            rows = rows.join(some, F.col("value") == F.col("_v"), "left_semi")
        exact = rows.groupBy(*by, "value").agg(F.count("*").alias("n"))
    best = exact.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "value")).cast("bigint"))
    return Top(best.filter(F.col("rank") <= k).select(*by, "value", "n", "rank"), source)


def _next_month(d: dt.date) -> dt.date:
    return dt.date(d.year + d.month // 12, d.month % 12 + 1, 1)
