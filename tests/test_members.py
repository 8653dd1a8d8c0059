"""Distinct customers of any span from kept bitmaps, against sets."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest

from ledgerlens.sources import members

IDS = [None, 0, 1, -1, 5, -5, 32767, 32768, 32769, -32768, 10**12, 10**12 + 1, -(10**15), 2**62]


def made(seed: int = 0):
    rng = random.Random(seed)
    return [(rng.choice([1, 2, 3, 5, 11, 12, 13, 14]), rng.choice(["P1", "P2", None]), rng.choice(["S1", "S2"]), rng.choice(IDS)) for _ in range(400)]


def day(k: int) -> dt.date:
    return dt.date(2023 + (k - 1) // 12, (k - 1) % 12 + 1, 9)


@pytest.fixture
def rows(txns):
    data = made()
    t = txns([dict(TRANSACTION_DATE=day(k), PRODUCT=p, SUBSIDIARY=s, CUSTOMER_ID=c) for k, p, s, c in data])
    return data, members.bitmaps(t, ["PRODUCT", "SUBSIDIARY"]), t


def sizes(found: set) -> tuple[int, int]:
    return len(found), len(found - {None})


def expected(data, group, months) -> dict:
    """months: month number -> the month numbers its span holds."""
    out: dict = {}
    for m, span in months.items():
        for k, p, s, c in data:
            if k in span:
                out.setdefault((day(m).replace(day=1), *group(p, s)), set()).add(c)
    return {k: sizes(v) for k, v in out.items()}


def got(df) -> dict:
    return {tuple(r)[:-2]: (r.unique_customers, r.known_customers) for r in df.collect()}


def test_spans_and_coarser_groups(rows):
    data, bits, _ = rows
    year = {m: set(range(m - (m - 1) % 12, m + 1)) for m in range(1, 15)}
    three = {m: {m - 2, m - 1, m} for m in range(1, 15)}
    one = {m: {m} for m in range(1, 15)}
    for by, group in ((["PRODUCT", "SUBSIDIARY"], lambda p, s: (p, s)), (["SUBSIDIARY"], lambda p, s: (s,)), ([], lambda p, s: ())):
        assert got(members.over_year_to_date(bits, by)) == expected(data, group, year)
        assert got(members.over_months(bits, by, 3)) == expected(data, group, three)
        assert got(members.over_months(bits, by, 1)) == expected(data, group, one)


def test_period(rows):
    data, bits, _ = rows
    period = members.over_period(bits, ["SUBSIDIARY"], dt.date(2023, 3, 1), dt.date(2024, 1, 1)).collect()
    assert {r.SUBSIDIARY: (r.unique_customers, r.known_customers) for r in period} == {s: sizes({c for k, _, t, c in data if 3 <= k <= 13 and t == s}) for s in ("S1", "S2")}
    assert members.over_period(bits, []).collect()[0][:] == sizes({c for *_, c in data})


def test_a_new_month_is_merged_without_the_others(rows, spark, tmp_path):
    """Bitmaps of months computed apart unite to the same counts."""
    data, bits, t = rows
    from pyspark.sql import functions as F

    parts = [members.bitmaps(t.filter(F.trunc("TRANSACTION_DATE", "month") == F.lit(day(m).replace(day=1))), ["PRODUCT", "SUBSIDIARY"]) for m in sorted({k for k, *_ in data})]
    for i, p in enumerate(parts):
        p.write.mode("append").parquet(str(tmp_path / "bits"))
    stored = spark.read.parquet(str(tmp_path / "bits"))
    assert got(members.over_year_to_date(stored, ["SUBSIDIARY"])) == got(members.over_year_to_date(bits, ["SUBSIDIARY"]))


def test_sketches_are_near(rows):
    data, bits, t = rows
    near = got(members.over_months(members.sketches(t, ["SUBSIDIARY"]), ["SUBSIDIARY"], 3))
    exact = got(members.over_months(bits, ["SUBSIDIARY"], 3))
    assert near.keys() == exact.keys() and all(abs(near[k][1] - exact[k][1]) <= 1 and near[k][0] >= near[k][1] for k in near)


def test_no_rows(txns):
    bits = members.bitmaps(txns([]), ["PRODUCT"])
    assert members.over_year_to_date(bits, ["PRODUCT"]).collect() == [] and members.over_months(bits, ["PRODUCT"]).collect() == []
    assert members.over_period(bits, ["PRODUCT"]).collect() == []


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="test data not present")
@pytest.mark.parametrize("name", ["m09_customers_year_to_date", "m09_customers_rolling_3m", "m09_customers_of_period", "m09_customers_ever"])
def test_no_transaction_is_read(spark, name):
    import __spark_entry__ as entry

    files = entry.queries()[name](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and all("/members-" in f for f in files)
