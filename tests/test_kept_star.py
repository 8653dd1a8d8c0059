"""Any star can be kept by month with rollups, labels and slicers beside it."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.__main__ import main, slicers
from ledgerlens.operators import context, dashboards, reports, worksheet
from ledgerlens.plans.inspect import fact_scans, physical_plan
from ledgerlens.sources import schemas
from ledgerlens.sources.labels import TooWide, labels, values
from ledgerlens.sources.rollup import rollup
from ledgerlens.sources.star import Star, materialize, star_from_catalog, star_from_files

SF = "/root/testdata/sf0.001"
AS_OF = dt.date(2024, 6, 10)


def written(spark, txns, frame, base: str) -> None:
    rng = random.Random(1)
    t = txns([
        dict(TRANSACTION_DATE=dt.datetime(2024, rng.randint(1, 6), rng.randint(1, 28)), PRODUCT=rng.choice(["P1", "P2", None]), SUBSIDIARY=rng.choice(["S1", "S2"]),
             STATUS=rng.choice(["SUCCESS", "FAILED"]), CUSTOMER_ID=rng.randint(1, 9)) for _ in range(200)
    ])
    dims = {
        "agents": frame([("AG1", "a", "GOLD", "R", "K", 100)], schemas.AGENTS), "customers": frame([(1, "RETAIL", "S1")], schemas.CUSTOMERS),
        "kpi_targets": frame([("P1", "S1", dt.date(2024, 5, 1), 3, None, None, 1)], schemas.KPI_TARGETS), "forex_rates": frame([], schemas.FOREX_RATES),
    }
    for name, df in {"transactions": t, **dims}.items():
        df.coalesce(2).write.parquet(f"{base}/{name}")


def plain(df) -> list:
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_a_file_star_is_kept_once_for_each_state_of_its_files(spark, txns, frame, tmp_path):
    base, keep = str(tmp_path / "star"), str(tmp_path / "kept")
    written(spark, txns, frame, base)
    loose = star_from_files(spark, base, "parquet")
    assert loose.folder is None and labels(loose, ["PRODUCT"]) is None
    star = star_from_files(spark, base, "parquet", keep=keep)
    assert star.folder.startswith(keep) and star_from_files(spark, base, "parquet", keep=keep).folder == star.folder
    assert plain(star.transactions.drop("TXN_MONTH")) == plain(loose.transactions)
    one = worksheet.last_month_volume(star.transactions, AS_OF, "S1", labels=labels(star, ["PRODUCT"]))
    assert plain(one) == plain(worksheet.last_month_volume(loose.transactions, AS_OF, "S1"))
    assert "TXN_MONTH" in physical_plan(one).split("PartitionFilters: [")[1].split("]")[0] and fact_scans(one) == 1
    assert plain(reports.rolling_success_rate(star.transactions, AS_OF, monthly=rollup(star, "product_subsidiary"))) == plain(reports.rolling_success_rate(loose.transactions, AS_OF))
    # another file: another version
    loose.transactions.limit(1).withColumn("PRODUCT", F.lit("P9")).write.mode("append").parquet(f"{base}/transactions")
    after = star_from_files(spark, base, "parquet", keep=keep)
    assert after.folder != star.folder and "P9" in values(after, "PRODUCT") and "P9" not in values(star, "PRODUCT")


def test_a_star_that_lies_by_month_is_read_by_month(spark, txns, frame, tmp_path):
    base = str(tmp_path / "star")
    written(spark, txns, frame, base)
    made = materialize(star_from_files(spark, base, "parquet"), str(tmp_path / "by-month"))
    assert made.folder == str(tmp_path / "by-month")
    star = star_from_files(spark, made.folder, "parquet")
    assert star.folder and star.folder != made.folder and "TXN_MONTH" in star.transactions.columns
    one = worksheet.mom_arrow(star.transactions, AS_OF, labels=labels(star, ["PRODUCT"]))
    assert "TXN_MONTH" in physical_plan(one).split("PartitionFilters: [")[1].split("]")[0]
    assert plain(one) == plain(worksheet.mom_arrow(made.transactions, AS_OF))


def test_catalog_star_kept_by_version(spark, txns, frame, tmp_path):
    base = str(tmp_path / "star")
    written(spark, txns, frame, base)
    for name in schemas.TABLES:
        spark.read.parquet(f"{base}/{name}").createOrReplaceTempView(name)
    one = star_from_catalog(spark, keep=str(tmp_path / "kept"), version="2024-06-10")
    again = star_from_catalog(spark, keep=str(tmp_path / "kept"), version="2024-06-10")
    other = star_from_catalog(spark, keep=str(tmp_path / "kept"), version="2024-06-11")
    assert one.folder == again.folder != other.folder and one.transactions.count() == 200


def test_wide_tables_take_their_columns_from_the_labels(spark, txns, frame, tmp_path):
    base = str(tmp_path / "star")
    written(spark, txns, frame, base)
    star = star_from_files(spark, base, "parquet", keep=str(tmp_path / "kept"))
    assert values(star, "PRODUCT") == ["P1", "P2", None]
    wide = worksheet.channel_product_sr_matrix(star.transactions, values(star, "PRODUCT"))
    assert wide.columns == ["CHANNEL", "P1", "P2", worksheet.BLANK]
    long = {(r.CHANNEL, r.PRODUCT): r.success_rate for r in worksheet.channel_product_sr(star.transactions).collect()}
    for r in wide.collect():
        assert r["P1"] == long[(r.CHANNEL, "P1")] and r[worksheet.BLANK] == long[(r.CHANNEL, None)]
    months = dashboards.month_product_matrix(star.transactions, values(star, "PRODUCT"))
    assert sum(sum(r[1:]) for r in months.collect()) == 200
    with pytest.raises(Exception, match="product without a column: NULL"):
        worksheet.channel_product_sr_matrix(star.transactions, ["P1", "P2"]).collect()
    with pytest.raises(TooWide):
        values(star, "PRODUCT", most=2)


def test_slicers_of_the_command_line():
    got = slicers(["SUBSIDIARY=S1,S2", "month=2024-01-01..2024-03-01", "TXN_AMOUNT_USD=..5"])
    assert got["SUBSIDIARY"] == ["S1", "S2"] and got["month"] == context.between("month", dt.date(2024, 1, 1), dt.date(2024, 3, 1))
    assert got["TXN_AMOUNT_USD"] == context.between("TXN_AMOUNT_USD", None, "5")
    with pytest.raises(ValueError):
        slicers(["SUBSIDIARY"])


@pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")
def test_command_line_prunes_and_slices(spark, tmp_path, capsys):
    common = ["--tpch", SF, "--keep", str(tmp_path / "kept"), "--as-of", "2001-11-04", "--home-subsidiary", "AFRICA"]
    for report in ("x1", "x2", "x3", "x6"):
        assert main([report, *common, "--explain"]) == 0
        plan = capsys.readouterr().out
        assert "TXN_MONTH" in plan.split("PartitionFilters: [")[1].split("]")[0] and plan.count("/transactions") == 1
    for report in ("r01", "r06", "r09b", "p1", "p4", "x10", "m-growth", "m-ytd", "m-new-customers"):
        assert main([report, *common, "--explain"]) == 0
        assert "/transactions" not in capsys.readouterr().out, report
    assert main(["r10", *common, "--filter", "SUBSIDIARY=AFRICA,ASIA", "--filter", "PRODUCT=PROMO", "--out", str(tmp_path / "r10")]) == 0
    assert {r.SUBSIDIARY for r in spark.read.parquet(str(tmp_path / "r10")).collect()} <= {"AFRICA", "ASIA"}
    assert main(["page3", *common, "--out", str(tmp_path / "page3")]) == 0
    assert sorted(p.name for p in (tmp_path / "page3").iterdir()) == ["failed_value_by_category", "failure_overview", "failure_rate_by_month_channel", "failures_by_description"]
    assert main(["x5-wide", *common, "--out", str(tmp_path / "x5")]) == 0
    assert len(spark.read.parquet(str(tmp_path / "x5")).columns) == 7
