"""Sources and sinks: CSV star with explicit schemas, materialisation round trip."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest

from ledgerlens.operators import reports
from ledgerlens.sources import schemas
from ledgerlens.sources.star import Star, materialize, star_from_files


def test_csv_star_round_trip(spark, txns, frame, tmp_path):
    base = str(tmp_path)
    t = txns([{"TRANSACTION_DATE": dt.datetime(2024, 5, 3, 10, 30), "AGENT_ID": "AG1", "PRODUCT": "AG"}] * 3)
    dims = {
        "agents": frame([("AG1", "a", "GOLD", "R", "K", 100)], schemas.AGENTS),
        "customers": frame([(1, "RETAIL", "S1")], schemas.CUSTOMERS),
        "kpi_targets": frame([("AG", "S1", dt.date(2024, 5, 1), 3, Decimal("3.00"), Decimal("90.00"), 1)], schemas.KPI_TARGETS),
        "forex_rates": frame([("S1", dt.date(2024, 5, 1), Decimal("0.010000"))], schemas.FOREX_RATES),
    }
    for name, df in {"transactions": t, **dims}.items():
        df.coalesce(1).write.option("header", True).csv(f"{base}/{name}.csv")
    star = star_from_files(spark, base, fmt="csv")
    assert star.transactions.schema == schemas.TRANSACTIONS
    assert star.transactions.collect()[0].TRANSACTION_DATE == dt.datetime(2024, 5, 3, 10, 30)
    out = reports.kpi_rag(star.transactions, star.kpi_targets, dt.date(2024, 6, 10)).collect()
    assert out[0].actual_vol == 3 and out[0].vol_rag == "GREEN"


def test_materialize_partitions_by_month(spark, txns, frame, tmp_path):
    t = txns([{"TRANSACTION_DATE": dt.date(2024, m, 1)} for m in (1, 2, 2, 3)])
    star = Star(
        transactions=t,
        agents=frame([("AG1", "a", "GOLD", "R", "K", 100)], schemas.AGENTS),
        customers=frame([(1, "RETAIL", "S1")], schemas.CUSTOMERS),
        kpi_targets=frame([], schemas.KPI_TARGETS),
        forex_rates=frame([], schemas.FOREX_RATES),
    )
    m = materialize(star, str(tmp_path / "star"))
    assert sorted(p.name for p in (tmp_path / "star" / "transactions").iterdir() if p.name.startswith("TXN_MONTH")) == [
        "TXN_MONTH=2024-01", "TXN_MONTH=2024-02", "TXN_MONTH=2024-03"
    ]
    assert m.transactions.count() == 4
    assert [c for c in m.transactions.columns if c != "TXN_MONTH"] == schemas.TRANSACTIONS.fieldNames()


def _views(spark, raw):
    raw.createOrReplaceTempView("transactions")
    for name, schema in schemas.TABLES.items():
        if name != "transactions":
            spark.createDataFrame([], schema).createOrReplaceTempView(name)


TEXT = "TRANSACTION_DATE string, PRODUCT string, STATUS string, TXN_AMOUNT_USD string, CUSTOMER_ID string"
GIVEN = ("TRANSACTION_DATE", "PRODUCT", "STATUS", "TXN_AMOUNT_USD", "CUSTOMER_ID")
OTHERS = tuple(c for c in schemas.TRANSACTIONS.fieldNames() if c not in GIVEN)


def test_text_columns_become_typed_and_bad_values_do_not_pass(spark):
    from pyspark.errors import PySparkException

    from ledgerlens.sources.star import StarError, conform, rejects, star_from_catalog

    raw = spark.createDataFrame(
        [("2024-05-03 10:30:00", "P", "SUCCESS", "12.50", "7"), ("not a date", "P", "FAILED", "x", None), ("2024-05-04", "Q", "FAILED", " ", "8")], TEXT
    )
    _views(spark, raw)
    with pytest.raises(StarError, match="transactions lacks the columns .*AGENT_ID"):
        star_from_catalog(spark)
    star = star_from_catalog(spark, absent=OTHERS)
    assert star.transactions.schema == schemas.TRANSACTIONS
    assert star.transactions.filter("PRODUCT = 'Q'").select("PRODUCT").collect()[0].PRODUCT == "Q"
    with pytest.raises(PySparkException, match="transactions.TRANSACTION_DATE cannot be read: not a date"):
        star.transactions.collect()
    found = {r.column: (r.rejected, r.example) for r in rejects(raw, schemas.TRANSACTIONS, "transactions").collect()}
    assert found == {"TRANSACTION_DATE": (1, "not a date"), "TXN_AMOUNT_USD": (1, "x")}
    rows = conform(raw, schemas.TRANSACTIONS, absent=OTHERS, bad="drop").orderBy("PRODUCT").collect()
    assert [r.PRODUCT for r in rows] == ["P", "Q"]
    assert rows[0].TRANSACTION_DATE == dt.datetime(2024, 5, 3, 10, 30) and rows[0].TXN_AMOUNT_USD == Decimal("12.5000")
    assert rows[0].CUSTOMER_ID == 7 and rows[0].AGENT_ID is None and rows[1].TXN_AMOUNT_USD is None  # blank text is NULL


def test_csv_columns_are_taken_by_header(spark, tmp_path):
    from ledgerlens.sources.star import StarError, conform, read_files

    (tmp_path / "agents.csv").write_text("AGENT_ID,AGENT_NAME,AGENT_TIER,COUNTY,REGION,FLOAT_LIMIT_KES\nAG1,a,GOLD,county,region,10\n")
    row = conform(read_files(spark, str(tmp_path), "agents"), schemas.AGENTS, "agents").collect()[0]
    assert (row.REGION, row.COUNTY, row.FLOAT_LIMIT_KES) == ("region", "county", 10)
    (tmp_path / "customers.csv").write_text("CUSTOMER_ID,SEGMENT\n1,RETAIL\n")
    with pytest.raises(StarError, match="customers lacks the columns SUBSIDIARY_NAME"):
        conform(read_files(spark, str(tmp_path), "customers"), schemas.CUSTOMERS, "customers")
    many = tmp_path / "forex_rates.csv"
    many.mkdir()
    (many / "a.csv").write_text("SUBSIDIARY_NAME,RATE_MONTH,USD_RATE\nS,2024-05-01,0.01\n")
    (many / "b.csv").write_text("SUBSIDIARY_NAME,USD_RATE,RATE_MONTH\nT,0.02,2024-05-01\n")
    with pytest.raises(Exception, match="CSV header does not conform"):  # of one table's files: refused, not read by position
        conform(read_files(spark, str(tmp_path), "forex_rates"), schemas.FOREX_RATES, "forex_rates").collect()


def test_a_half_written_star_is_never_read(spark, tmp_path):
    from ledgerlens.sources.star import published

    path = f"file:{tmp_path}/x"

    def fails(place):
        spark.range(3).write.parquet(f"{place}/t")
        raise OSError("executor lost")

    with pytest.raises(OSError):
        published(spark, path, fails)
    place = published(spark, path, lambda p: spark.range(5).write.parquet(f"{p}/t"))
    assert spark.read.parquet(f"{place}/t").count() == 5
    assert published(spark, path, fails) == place  # finished: nothing is built again


def test_changed_sources_give_another_star(spark, tmp_path):
    from ledgerlens.sources.star import SOURCE_TABLES, _source_fingerprint

    for name in SOURCE_TABLES:
        spark.range(2).write.parquet(f"{tmp_path}/{name}.parquet")
    before = _source_fingerprint(spark, f"file:{tmp_path}")
    assert before == _source_fingerprint(spark, f"file:{tmp_path}")
    spark.range(1).write.mode("append").parquet(f"{tmp_path}/orders.parquet")
    assert before != _source_fingerprint(spark, f"file:{tmp_path}")


def test_rollups_equal_the_aggregates_and_refresh_by_month(spark, txns, frame, tmp_path):
    from ledgerlens.sources.rollup import GRAINS, read, refresh_months, rollup
    from ledgerlens.sources.star import Star

    data = [{"TRANSACTION_DATE": dt.date(2024, m, 1 + i % 3), "CUSTOMER_ID": i % 4 or None, "PRODUCT": f"P{i % 2}"} for m in (1, 2, 4) for i in range(9)]
    empty = {n: frame([], s) for n, s in schemas.TABLES.items() if n != "transactions"}
    star = Star(transactions=txns(data), folder=f"file:{tmp_path}/star", **empty)
    for grain, (define, _) in GRAINS.items():
        direct = sorted(map(tuple, define(star.transactions).collect()), key=str)
        assert sorted(map(tuple, rollup(star, grain).collect()), key=str) == direct, grain
    path = f"file:{tmp_path}/r"
    refresh_months(star.transactions, "product", path, ["2024-01", "2024-02", "2024-04"])
    more = txns([*data, *[{"TRANSACTION_DATE": dt.date(2024, 2, 9), "PRODUCT": "P0"}] * 5])
    refresh_months(more, "product", path, ["2024-02"])
    define, _ = GRAINS["product"]
    after = sorted(map(tuple, read(spark, path, define(more).schema).collect()), key=str)
    assert after == sorted(map(tuple, define(more).collect()), key=str)


def test_check_star_finds_duplicate_dimension_keys(spark, txns, frame):
    from ledgerlens.sources.checks import check_star

    star = Star(
        transactions=txns([{}]),
        agents=frame([("AG1", "a", "GOLD", "R", "K", 1), ("AG1", "b", "GOLD", "R", "K", 2)], schemas.AGENTS),
        customers=frame([(1, "RETAIL", "S1")], schemas.CUSTOMERS),
        kpi_targets=frame([], schemas.KPI_TARGETS),
        forex_rates=frame([("S1", dt.date(2024, 5, 1), Decimal("0.01")), ("S1", dt.date(2024, 5, 1), Decimal("0.02"))], schemas.FOREX_RATES),
    )
    got = {(r.table, r.key, r.rows) for r in check_star(star).collect()}
    assert got == {("agents", "AG1", 2), ("forex_rates", "S1|2024-05-01", 2)}


def test_test_star_is_sound(spark):
    import os

    from ledgerlens.sources.checks import check_star
    from ledgerlens.sources.star import materialized_star

    if os.path.exists("/root/testdata/sf0.001"):
        assert check_star(materialized_star(spark, "/root/testdata/sf0.001")).count() == 0


def test_reports_identical_from_csv_star(spark, tmp_path):
    import os

    from ledgerlens.catalog.queries import P, normalise
    from ledgerlens.operators import cohort as C
    from ledgerlens.sources.star import materialized_star

    sf = "/root/testdata/sf0.001"
    if not os.path.exists(sf):
        return
    src = materialized_star(spark, sf)
    base = str(tmp_path)
    for name in ("transactions", "agents", "customers", "kpi_targets", "forex_rates"):
        df = getattr(src, name)
        df = df.drop("TXN_MONTH") if "TXN_MONTH" in df.columns else df
        df.write.option("header", True).csv(f"{base}/{name}.csv")
    csv = star_from_files(spark, base, fmt="csv")
    runs = {
        "r02": lambda s: reports.kpi_rag(s.transactions, s.kpi_targets, P.as_of),
        "r04": lambda s: reports.agent_scorecard(s.transactions, s.agents, P.as_of, P.agency_product),
        "r11": lambda s: reports.fee_profitability(s.transactions, s.forex_rates, P.as_of),
        "r09b": lambda s: C.cohort_retention(s.transactions, cohort_months=None),
    }
    for name, run in runs.items():
        a = sorted(map(tuple, normalise(run(src)).collect()), key=str)
        b = sorted(map(tuple, normalise(run(csv)).collect()), key=str)
        assert a == b, name
