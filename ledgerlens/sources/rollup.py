"""Exact monthly rollups of the fact, one partition per month.

The month-over-month reports need the whole history of a series (a row-based
LAG has no safe date bound), but only as one row per month and group; distinct
customers of a month never depend on another month. So each grain is aggregated
once, month by month, and kept beside the materialised star. A report over it
reads a few rows per month instead of the transactions. When transactions of
some months change, ``refresh_months`` recomputes those months only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import kpi
from ledgerlens.operators import measures, reports
from ledgerlens.session import application_id
from ledgerlens.sources.star import Star, published

D = "TRANSACTION_DATE"
MONTH = measures.MONTH


def measure_months(by: list[str]) -> Callable[[DataFrame], DataFrame]:
    """The base measures per month and group, with the customer count that ignores blanks beside them."""

    def build(txns: DataFrame) -> DataFrame:
        return measures.monthly_measures(txns, by, known_customers=True)

    return build


def day_totals(txns: DataFrame) -> DataFrame:
    """(day, SUBSIDIARY, transactions, successes, value, successful value): what running totals and day counts start from."""
    usd = F.col("TXN_AMOUNT_USD")
    return txns.groupBy(kpi.txn_date(D).alias("day"), "SUBSIDIARY").agg(
        F.count(F.lit(1)).alias("total_transactions"), kpi.successes().alias("successful_transactions"),
        F.sum(usd).alias("total_value_usd"), F.sum(F.when(kpi.status_is(kpi.SUCCESS), usd)).alias("successful_value_usd"),
    )


#: name -> (definition over the transactions, month column)
GRAINS: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {
    "all": (measure_months([]), MONTH),
    "product": (measure_months(["PRODUCT"]), MONTH),
    "product_subsidiary": (measure_months(["PRODUCT", "SUBSIDIARY"]), MONTH),
    "product_subsidiary_country_channel": (measure_months(["PRODUCT", "SUBSIDIARY", "COUNTRY", "CHANNEL"]), MONTH),
    "product_category": (reports.product_months, "txn_month"),
    "day_subsidiary": (day_totals, "day"),
}


def rollup(star: Star, grain: str) -> DataFrame:
    """The rollup of a materialised star (built on first use); without a folder, the aggregate itself."""
    define, month = GRAINS[grain]
    return kept(star, f"rollup-{grain}", define, month)


# resolved tables per (application, session, folder, name): lazy DataFrames, so reuse only skips the look-up and file listing
_KEPT: dict[tuple, DataFrame] = {}


def kept(star: Star, name: str, define: Callable[[DataFrame], DataFrame], month: str) -> DataFrame:
    """A table derived from the transactions month by month, kept beside a materialised star (built on first use).

    A star's folder is one version of it and never changes, so a table that was found once stays where it is.
    """
    if star.folder is None:
        return define(star.transactions)
    spark = star.transactions.sparkSession
    key = (application_id(spark), id(spark), star.folder, name)
    df = _KEPT.get(key)
    if df is None or df.sparkSession is not spark:
        made = define(star.transactions)
        folder = published(spark, f"{star.folder}/{name}", lambda place: _write(made, month, f"{place}/t"))
        df = _KEPT[key] = read(spark, f"{folder}/t", made.schema)
    return df


def read(spark, path: str, schema) -> DataFrame:
    return spark.read.parquet(path).drop("_month").select(*schema.fieldNames())


def _write(df: DataFrame, month: str, path: str, mode: str = "overwrite") -> None:
    """One folder per month, one file each: a month of a grain is small."""
    key = F.date_format(month, "yyyy-MM") if dict(df.dtypes)[month] == "date" else F.col(month)
    out = df.withColumn("_month", key).repartition("_month")
    w = out.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("_month")
    w.parquet(path)


def refresh_months(txns: DataFrame, grain: str, path: str, months: list[str]) -> None:
    """Recompute the given months (``yyyy-MM``) of a rollup at ``path``; other months' files are not touched.

    Reads only those months of a month-partitioned fact. A month that has no
    transactions any more must be removed with its folder by the caller.
    """
    define, month = GRAINS[grain]
    rows = txns.filter(F.col("TXN_MONTH").isin(*months)) if "TXN_MONTH" in txns.columns else txns
    _write(define(rows.filter(kpi.month_key(D).isin(*months))), month, path)
