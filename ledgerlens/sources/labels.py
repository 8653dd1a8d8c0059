"""Label dictionaries: which values a column of the fact has had, and when.

A worksheet has a row for every product there ever was, though its formula counts one month; a spilled matrix has a column
for every value. Asking the fact for its labels reads all of history, so they are kept beside a materialised star: one row
per value (or combination) with the first and last month it occurs in. NULL is a value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import kpi
from ledgerlens.session import application_id
from ledgerlens.sources.star import Star, published

D = "TRANSACTION_DATE"
#: columns a wide table may have
WIDEST = 2000


class TooWide(ValueError):
    """A column has more values than a wide table can have columns."""


def labels_of(txns: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, first_month, last_month) of every combination in the fact."""
    month = kpi.month_date(D)
    return txns.groupBy(*columns).agg(F.min(month).alias("first_month"), F.max(month).alias("last_month"))


# resolved dictionaries per (application, session, folder, columns)
_KEPT: dict[tuple, DataFrame] = {}


def labels(star: Star, columns: list[str]) -> DataFrame | None:
    """The dictionary of a materialised star (built on first use); None for a star without a folder."""
    if star.folder is None:
        return None
    spark = star.transactions.sparkSession
    key = (application_id(spark), id(spark), star.folder, *columns)
    df = _KEPT.get(key)
    if df is None or df.sparkSession is not spark:
        made = labels_of(star.transactions, columns)
        folder = published(spark, f"{star.folder}/labels-{'_'.join(columns).lower()}", lambda place: made.write.parquet(f"{place}/t"))
        df = _KEPT[key] = spark.read.schema(made.schema).parquet(f"{folder}/t")
    return df


def values(star: Star, column: str, most: int = WIDEST) -> list:
    """All values of a column in order, NULL last: the columns of a wide table. More than ``most`` are refused."""
    found = labels(star, [column])
    found = labels_of(star.transactions, [column]) if found is None else found
    if found.count() > most:
        raise TooWide(f"{column} has more than {most} values; take the long form")
    row = found.agg(F.sort_array(F.collect_set(column)), F.max(F.col(column).isNull())).first()
    return [*row[0], *([None] if row[1] else [])]
