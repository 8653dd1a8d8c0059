"""A star over growing files rewrites the months a change touches."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import cohort, measures, reports, worksheet
from ledgerlens.plans.inspect import physical_plan
from ledgerlens.sources import members, schemas
from ledgerlens.sources.rollup import GRAINS
from ledgerlens.sources.tracked import TrackedStar

AS_OF = dt.date(2024, 7, 3)


def rows(seed: int, months: list[int], n: int = 40) -> list[dict]:
    rng = random.Random(seed)
    return [
        dict(TRANSACTION_DATE=dt.datetime(2024, rng.choice(months), rng.randint(1, 28), 23, 59), PRODUCT=rng.choice(["P1", "P2"]), SUBSIDIARY=rng.choice(["S1", "S2"]),
             STATUS=rng.choice(["SUCCESS", "FAILED"]), CUSTOMER_ID=rng.choice([None, *range(12)])) for _ in range(n)
    ]


def plain(df) -> list:
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(params=["parquet", "csv"])
def source(spark, txns, frame, tmp_path, request):
    base, fmt = str(tmp_path / "star with space"), request.param
    dims = {
        "agents": frame([("AG1", "a", "GOLD", "R", "K", 100)], schemas.AGENTS), "customers": frame([(1, "RETAIL", "S1")], schemas.CUSTOMERS),
        "kpi_targets": frame([("P1", "S1", dt.date(2024, 6, 1), 3, None, None, 1)], schemas.KPI_TARGETS), "forex_rates": frame([], schemas.FOREX_RATES),
    }
    end = ".csv" if fmt == "csv" else ""
    for name, df in dims.items():
        (df.coalesce(1).write.option("header", True).csv if fmt == "csv" else df.coalesce(1).write.parquet)(f"{base}/{name}{end}")

    def add(name: str, data: list[dict]) -> None:
        w = txns(data).coalesce(1).write.mode("overwrite")
        (w.option("header", True).csv if fmt == "csv" else w.parquet)(f"{base}/transactions{end}/{name}")

    return base, fmt, add, tmp_path


def test_a_change_of_files_rewrites_the_months_it_touches(spark, txns, source):
    base, fmt, add, tmp = source
    parts = {"a": rows(1, [1, 2, 3]), "b": rows(2, [3, 4]), "c": rows(3, [6])}
    for name, data in parts.items():
        add(name, data)
    tracked = TrackedStar(spark, base, str(tmp / "kept"), fmt)
    assert tracked.star().transactions.count() == 0
    first, months = tracked.refresh()
    assert months == ["2024-01", "2024-02", "2024-03", "2024-04", "2024-06"]
    define, month = GRAINS["product_subsidiary"]
    bits = lambda t: members.bitmaps(t, ["SUBSIDIARY"])

    def same(touched: list[str]) -> None:
        whole = txns([r for data in parts.values() for r in data])
        star = tracked.star()
        assert plain(star.transactions.drop("TXN_MONTH")) == plain(whole)
        assert plain(tracked.table("product_subsidiary", define, month)) == plain(define(whole))
        assert plain(members.over_year_to_date(tracked.table("members", bits), ["SUBSIDIARY"])) == plain(members.over_year_to_date(bits(whole), ["SUBSIDIARY"]))
        history = tracked.history(touched)
        assert plain(cohort.cohort_retention(None, cohort_months=None, kept=history.retention())) == plain(cohort.cohort_retention(whole, cohort_months=None))
        assert plain(history.arrivals().select("month", "new_customers")) == plain(measures.new_customers(whole).select("month", "new_customers"))

    same(months)
    one = worksheet.mom_arrow(tracked.star().transactions, AS_OF, labels=tracked.table("product_subsidiary", define, month))
    assert "TXN_MONTH" in physical_plan(one) and plain(one) == plain(worksheet.mom_arrow(txns([r for d in parts.values() for r in d]), AS_OF))
    assert tracked.refresh()[1] == []

    # an appended file: two months, of which one is new; every other month's folder and rollup stay
    parts["d"] = rows(4, [2, 5])
    add("d", parts["d"])
    before = tracked.version()
    after, months = tracked.refresh()
    assert months == ["2024-02", "2024-05"]
    assert {m for m in after.months if after.months[m] != before.months.get(m)} == {"2024-02", "2024-05"}
    assert all(set(t) == set(before.months) - {"2024-02"} for t in after.tables.values())
    same(months)
    done = tracked.version().tables["product_subsidiary"]
    assert {m for m in done if done[m] != before.tables["product_subsidiary"].get(m)} == {"2024-02", "2024-05"}
    assert plain(tracked.star(first).transactions) and tracked.star(first).transactions.filter("TXN_MONTH = '2024-05'").isEmpty()  # an older version

    # a file that changes and loses a month
    parts["b"] = rows(5, [3])
    add("b", parts["b"])
    after, months = tracked.refresh()
    assert months == ["2024-03", "2024-04"] and "2024-04" not in after.months
    same(months)


def test_undated_rows_and_a_late_writer(spark, txns, source):
    base, fmt, add, tmp = source
    add("a", rows(1, [1]) + [dict(TRANSACTION_DATE=None)])
    tracked = TrackedStar(spark, base, str(tmp / "kept"), fmt)
    v, _ = tracked.refresh()
    assert v.undated == 1 and tracked.star().transactions.count() == 40
    with pytest.raises(Exception, match="exist|EXIST"):
        tracked._publish(type(v)(v.number - 1))
    assert reports.failure_spikes(tracked.star().transactions, AS_OF).columns
