"""Column expressions shared by the reports: counters, safe ratios, rounding, flags.

Numeric contract (kept identical in the DuckDB oracle):
* amounts stay DECIMAL, so sums are exact and independent of partitioning;
* ratios are computed in DOUBLE (a correctly rounded division in any engine);
* a displayed value is rounded half away from zero through DECIMAL(28,8) --
  the shortest decimal form of the double, as PostgreSQL ``numeric`` would
  hold it -- and then returned as DOUBLE.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

SUCCESS = "SUCCESS"
FAILED = "FAILED"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def status_is(value: str, status: str | Column = "STATUS") -> Column:
    return col(status) == F.lit(value)


def count_when(cond: Column) -> Column:
    """``SUM(CASE WHEN cond THEN 1 ELSE 0 END)``: 0 for a group with no match."""
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def successes(status: str | Column = "STATUS") -> Column:
    return count_when(status_is(SUCCESS, status))


def failures(status: str | Column = "STATUS") -> Column:
    return count_when(status_is(FAILED, status))


def as_double(c: str | Column) -> Column:
    return col(c).cast("double")


def ratio(num: str | Column, den: str | Column) -> Column:
    """``num / NULLIF(den, 0)`` in DOUBLE."""
    return as_double(num) / F.nullif(as_double(den), F.lit(0.0))


def pct(num: str | Column, den: str | Column) -> Column:
    """``100.0 * num / NULLIF(den, 0)`` in DOUBLE."""
    return F.lit(100.0) * as_double(num) / F.nullif(as_double(den), F.lit(0.0))


def pct_change(cur: str | Column, prev: str | Column) -> Column:
    """``100.0 * (cur - prev) / NULLIF(prev, 0)``; the difference is exact before the division."""
    return F.lit(100.0) * as_double(col(cur) - col(prev)) / F.nullif(as_double(prev), F.lit(0.0))


def round_dec(c: str | Column, scale: int) -> Column:
    """Half-away-from-zero rounding through DECIMAL(28,8); result stays DECIMAL."""
    return F.round(col(c).cast("decimal(28,8)"), scale)


def rnd(c: str | Column, scale: int) -> Column:
    """Displayed value: ``round_dec`` returned as DOUBLE."""
    return round_dec(c, scale).cast("double")


def avg_exact(c: str | Column) -> Column:
    """Mean of a DECIMAL or integer column as exact sum over count (DOUBLE result)."""
    return as_double(F.sum(col(c))) / F.nullif(F.count(col(c)).cast("double"), F.lit(0.0))


def dec(value: str | float) -> Column:
    """Exact decimal literal, so threshold tests (``x >= t * 0.95``) are exact."""
    d = Decimal(str(value))
    exp = d.as_tuple().exponent
    scale = max(0, -exp) if isinstance(exp, int) else 0
    digits = max(len(d.as_tuple().digits), scale + 1)
    return F.lit(str(d)).cast(f"decimal({digits},{scale})")


def rag(actual: str | Column, target: str | Column, green: str = "0.95", amber: str = "0.80") -> Column:
    """GREEN / AMBER / RED on ``actual >= target * green`` then ``* amber`` (else RED, also for NULL)."""
    a, t = col(actual), col(target)
    return F.when(a >= t * dec(green), "GREEN").when(a >= t * dec(amber), "AMBER").otherwise("RED")


def rag_on_ratio(att: str | Column, green: float = 0.95, amber: float = 0.80) -> Column:
    a = col(att)
    return F.when(a >= F.lit(green), "GREEN").when(a >= F.lit(amber), "AMBER").otherwise("RED")


def text_1dp(c: str | Column) -> Column:
    """Number formatted with one decimal (``0.0``), half away from zero."""
    return round_dec(c, 1).cast("decimal(18,1)").cast("string")


def arrow(growth_pct: str | Column, strong: float = 10.0, weak_inclusive: bool = True, blank: str | None = None) -> Column:
    """Trend arrow text for a growth in percent.

    ``weak_inclusive`` selects the lower band test: ``>= -strong`` (worksheet
    form) or ``> -strong`` (measure form). ``blank`` is returned for NULL growth.
    """
    g = col(growth_pct)
    low = g >= F.lit(-strong) if weak_inclusive else g > F.lit(-strong)
    out = (
        F.when(g >= F.lit(strong), F.concat(F.lit("▲▲ "), text_1dp(g), F.lit("%")))
        .when(g > F.lit(0.0), F.concat(F.lit("▲ "), text_1dp(g), F.lit("%")))
        .when(low, F.concat(F.lit("▼ "), text_1dp(F.abs(g)), F.lit("%")))
        .otherwise(F.concat(F.lit("▼▼ "), text_1dp(F.abs(g)), F.lit("%")))
    )
    if blank is not None:
        out = F.when(g.isNull(), F.lit(blank)).otherwise(out)
    return out


def non_blank(c: str | Column) -> Column:
    """``x IS NOT NULL AND TRIM(x) <> ''``."""
    return col(c).isNotNull() & (F.trim(col(c)) != F.lit(""))


def txn_date(c: str = "TRANSACTION_DATE") -> Column:
    return F.to_date(F.col(c))


def month_key(c: str = "TRANSACTION_DATE") -> Column:
    """``yyyy-MM`` text month (the worksheet helper column and the SQL ``TO_CHAR``)."""
    return F.date_format(F.col(c), "yyyy-MM")


def month_date(c: str = "TRANSACTION_DATE") -> Column:
    """First day of the month as DATE."""
    return F.trunc(F.to_date(F.col(c)), "month")


def month_index(c: str | Column) -> Column:
    """``year * 12 + month`` for month arithmetic and range frames."""
    d = col(c)
    return F.year(d) * 12 + F.month(d)


def in_range(c: str, start, end=None) -> Column:
    """``start <= c < end`` on the date column (``end`` optional), pushed to the scan as a range."""
    d = F.col(c)
    cond = d >= F.lit(start) if start is not None else F.lit(True)
    if end is not None:
        cond = cond & (d < F.lit(end))
    return cond


def date_window(df, start=None, end=None, c: str = "TRANSACTION_DATE"):
    """Rows with ``start <= c < end``; on a month-partitioned fact also the implied month range.

    A fact written by ``sources.star.materialize`` carries the ``TXN_MONTH``
    partition column (``yyyy-MM`` of the date). The month predicate is implied
    by the date range, so adding it never changes the result, but it lets
    Spark prune whole month folders before any file is opened.
    """
    import datetime as _dt

    out = df.filter(in_range(c, start, end))
    if "TXN_MONTH" in df.columns:
        if start is not None:
            out = out.filter(F.col("TXN_MONTH") >= F.lit(start.strftime("%Y-%m")))
        if end is not None:
            last = end - _dt.timedelta(days=1) if not isinstance(end, _dt.datetime) else end
            out = out.filter(F.col("TXN_MONTH") <= F.lit(last.strftime("%Y-%m")))
    return out
