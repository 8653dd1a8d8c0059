"""Top values of any span from monthly lists, against counting everything."""

from __future__ import annotations

import datetime as dt
import os
import random
from collections import Counter

import pytest

from ledgerlens.sources import schemas, topk
from ledgerlens.sources.star import Star, materialize

CORRIDOR = topk.Counted("corridor", "SOURCE_COUNTRY || '->' || DEST_COUNTRY", "STATUS = 'SUCCESS'", ("SUBSIDIARY",))


def made(shape: str) -> list[dict]:
    rng = random.Random(7)
    out = []
    for month in range(1, 7):
        for s in ("S1", "S2", None):
            if shape == "steep":  # the frequent ones are frequent in every month
                values = [f"c{i}" for i in range(30) for _ in range(max(1, 60 >> i))]
            elif shape == "shifted":  # each month has its own head; one value is just below every list
                values = [f"c{month}{i}" for i in range(4) for _ in range(9)] + ["steady"] * 8 + [f"r{rng.randrange(40)}" for _ in range(40)]
            else:
                values = [f"c{rng.randrange(12)}" for _ in range(60)]
            out += [dict(TRANSACTION_DATE=dt.datetime(2024, month, rng.randint(1, 28)), SUBSIDIARY=s, SOURCE_COUNTRY=v, DEST_COUNTRY=None if rng.random() < 0.05 else "X", STATUS=rng.choice(["SUCCESS", "SUCCESS", "FAILED"])) for v in values]
    return out


def expected(rows: list[dict], k: int, first: int, last: int) -> list[tuple]:
    counts: dict = {}
    for r in rows:
        if first <= r["TRANSACTION_DATE"].month <= last and r["STATUS"] == "SUCCESS" and r["DEST_COUNTRY"]:
            counts.setdefault(r["SUBSIDIARY"], Counter())[r["SOURCE_COUNTRY"] + "->X"] += 1
    return sorted(((s, v, n, i + 1) for s, c in counts.items() for i, (v, n) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:k])), key=str)


@pytest.mark.parametrize("shape, listed, source", [("steep", 8, "lists"), ("shifted", 4, "transactions"), ("even", 11, "candidates"), ("even", 20, "lists")])
def test_top_values_are_exact_whatever_the_lists_settle(spark, txns, frame, tmp_path, shape, listed, source):
    rows = made(shape)
    empty = {n: frame([], schemas.TABLES[n]) for n in ("agents", "customers", "kpi_targets", "forex_rates")}
    star = materialize(Star(transactions=txns(rows), **empty), str(tmp_path / "star"))
    found = set()
    for first, last in ((1, 6), (2, 4), (5, 5)):
        for k in (1, 3):
            got = topk.top(star, CORRIDOR, k, dt.date(2024, first, 1), dt.date(2024, last, 1), listed)
            found.add(got.source)
            assert sorted((tuple(r) for r in got.rows.collect()), key=str) == expected(rows, k, first, last), (first, last, k, got.source)
            if got.source == "lists":
                assert not [f for f in got.rows.inputFiles() if "/transactions/" in f]
    assert source in found
    assert [tuple(r) for r in topk.top(star, CORRIDOR, 2, listed=listed).rows.orderBy("SUBSIDIARY", "rank").collect()] == sorted(expected(rows, 2, 1, 6), key=lambda r: (r[0] or "", r[3]))


def test_no_rows_and_one_group(spark, txns, frame, tmp_path):
    empty = {n: frame([], schemas.TABLES[n]) for n in ("agents", "customers", "kpi_targets", "forex_rates")}
    what = topk.Counted("channel", "CHANNEL")
    star = materialize(Star(transactions=txns([dict(CHANNEL="A"), dict(CHANNEL="B"), dict(CHANNEL="A"), dict(CHANNEL=None)]), **empty), str(tmp_path / "one"))
    assert [tuple(r) for r in topk.top(star, what, 5).rows.orderBy("rank").collect()] == [("A", 2, 1), ("B", 1, 2)]
    assert topk.top(star, what, 5, dt.date(2030, 1, 1)).rows.collect() == []


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="test data not present")
@pytest.mark.parametrize("name", ["x4_top_failures_of_period", "top_corridors_of_period"])
def test_registered_periods_come_from_the_lists(spark, name):
    import __spark_entry__ as entry

    files = entry.queries()[name](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and (name != "x4_top_failures_of_period" or not [f for f in files if "/transactions/" in f])
