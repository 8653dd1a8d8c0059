"""Running totals and day counts from kept day totals."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from ledgerlens.operators import measures, stats, worksheet
from ledgerlens.sources import schemas
from ledgerlens.sources.rollup import day_totals, rollup
from ledgerlens.sources.star import Star, materialize

AS_OF = dt.date(2024, 6, 10)


@pytest.fixture
def star(txns, frame, tmp_path):
    rng = random.Random(6)
    rows = [
        dict(TRANSACTION_DATE=dt.datetime(rng.choice([2023, 2024]), rng.randint(1, 6), rng.randint(1, 28), rng.randint(0, 23)), SUBSIDIARY=rng.choice(["S1", "S2", None]),
             STATUS=rng.choice(["SUCCESS", "FAILED"]), TXN_AMOUNT_USD=rng.randint(1, 500), CUSTOMER_ID=k) for k in range(400)
    ]
    empty = {n: frame([], schemas.TABLES[n]) for n in ("agents", "customers", "kpi_targets", "forex_rates")}
    return materialize(Star(transactions=txns(rows), **empty), str(tmp_path / "star"))


def plain(df) -> list:
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_running_total_of_days_is_that_of_the_year(star):
    whole = worksheet.ytd_running_total(star.transactions, AS_OF, "S1").collect()
    totals = rollup(star, "day_subsidiary")
    for first, last in ((dt.date(2024, 1, 1), dt.date(2024, 12, 31)), (dt.date(2024, 3, 7), dt.date(2024, 3, 9)), (dt.date(2024, 5, 28), dt.date(2024, 6, 2)), (dt.date(2024, 1, 1), dt.date(2024, 1, 1))):
        some = worksheet.ytd_running_total(star.transactions, AS_OF, "S1", days=(first, last), totals=totals)
        assert plain(some) == sorted((tuple(r) for r in whole if first <= r.txn_date <= last), key=str)
    with pytest.raises(ValueError):
        worksheet.ytd_running_total(star.transactions, AS_OF, "S1", days=(dt.date(2023, 1, 1), dt.date(2024, 1, 1)), totals=totals)


def test_complete_months_and_year_to_date_without_transactions(star):
    totals = rollup(star, "day_subsidiary")
    months = stats.complete_months(star.transactions, 10, days=totals)
    assert plain(months) == plain(stats.complete_months(star.transactions, 10)) and not [f for f in months.inputFiles() if "/transactions/" in f]
    rows = star.transactions.collect()
    for day in (dt.date(2024, 2, 29), dt.date(2024, 4, 15), dt.date(2023, 6, 28)):
        got = {r.SUBSIDIARY: r[1:] for r in measures.ytd_as_of(totals, day).collect()}
        before = day.replace(year=day.year - 1, day=min(day.day, 28))
        for s in ("S1", "S2", None):
            now = [r for r in rows if r.SUBSIDIARY == s and dt.date(day.year, 1, 1) <= r.TRANSACTION_DATE.date() <= day]
            last = [r for r in rows if r.SUBSIDIARY == s and dt.date(before.year, 1, 1) <= r.TRANSACTION_DATE.date() <= before]
            assert got[s][:2] == (len(now), sum(r.TXN_AMOUNT_USD for r in now))
            assert got[s][2] == (pytest.approx(100 * (len(now) - len(last)) / len(last)) if last else None)
    assert day_totals(star.transactions.limit(0)).collect() == []
