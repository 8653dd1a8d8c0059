"""Pages and pack from one pass over the fact."""

from __future__ import annotations

import datetime as dt
import os
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerlens.catalog.queries import PAGES, P
from ledgerlens.operators import dashboards, export, pages
from ledgerlens.operators.shared import ROWS, Part, cells, count_if, gather
from ledgerlens.plans.inspect import fact_scans
from ledgerlens.sources import schemas
from ledgerlens.sources.star import Star, materialized_star

SF = "/root/testdata/sf0.001"


def plain(df) -> list:
    return sorted((tuple(sorted(r.asDict().items())) for r in df.collect()), key=str)


@pytest.fixture
def star(spark, txns, frame):
    rng = random.Random(4)
    rows = [
        dict(
            TRANSACTION_DATE=dt.datetime(2024, rng.randint(1, 6), rng.randint(1, 28)), PRODUCT=rng.choice(["AG", "RM", "P", None]), SUBSIDIARY=rng.choice(["S1", "S2", None]),
            STATUS=rng.choice(["SUCCESS", "FAILED", "REVERSED"]), CHANNEL=rng.choice(["A", None]), CUSTOMER_ID=rng.choice([None, 1, 2, 3, 4]), AGENT_ID=rng.choice([None, "", " ", "AG1", "AG2", "AG9"]),
            SOURCE_COUNTRY=rng.choice(["X", "Y", None]), DEST_COUNTRY=rng.choice(["X", "Z", None]), TXN_AMOUNT_USD=rng.randint(1, 99), PROCESSING_TIME_SECS=rng.choice([None, 60, 90]),
            TXN_AMOUNT_LOCAL=rng.choice([None, 0, 50, 70]), FEE_AMOUNT_LOCAL=rng.choice([None, 1, 2]), FAILURE_CODE=rng.choice([None, "INSUFF_FLOAT"]), FAILURE_DESCRIPTION=rng.choice([None, "", "d1", "d2"]),
            FAILURE_CATEGORY=rng.choice([None, "c1"]),
        )
        for _ in range(400)
    ]
    return Star(
        transactions=txns(rows), agents=frame([("AG1", "a", "GOLD", "R", "K", 100), ("AG2", "b", "BASIC", "R", "L", 0)], schemas.AGENTS),
        customers=frame([(1, "RETAIL", "S1"), (2, "RETAIL", "S1"), (3, "SME", "S2")], schemas.CUSTOMERS),
        kpi_targets=frame([("AG", "S1", dt.date(2024, 5, 1), 3, None, None, 1)], schemas.KPI_TARGETS), forex_rates=frame([], schemas.FOREX_RATES),
    )


AS_OF = dt.date(2024, 6, 10)


def apart(s: Star) -> dict:
    t = s.transactions
    return {
        "pack": export.report_pack(t, s.agents, s.customers, AS_OF, "AG", "RM"),
        "d1": {"kpi_cards": dashboards.kpi_cards(t, AS_OF), "product_table": dashboards.product_table(t, s.kpi_targets, AS_OF), "subsidiary_value": dashboards.subsidiary_value(t)},
        "d2": {"month_product": dashboards.month_product(t), "product_scatter": dashboards.product_scatter(t), "channel_share": dashboards.channel_share(t), "product_status": dashboards.product_status(t)},
        "d3": {"failure_overview": dashboards.failure_overview(t), "failures_by_description": dashboards.failures_by_description(t), "failed_value_by_category": dashboards.failed_value_by_category(t), "failure_rate_by_month_channel": dashboards.failure_rate_by_month_channel(t)},
        "d4": {"destination_volume": dashboards.destination_volume(t, "RM"), "corridor_cards": dashboards.corridor_cards(t, "RM"), "corridor_table": dashboards.corridor_table(t, "RM")},
        "d5": {"agent_cards": dashboards.agent_cards(t, "AG"), "region_totals": dashboards.region_totals(t, s.agents, "AG"), "county_value": dashboards.county_value(t, s.agents, "AG")},
    }


def together(s: Star, folder: str) -> dict:
    return {
        "pack": pages.report_pack(s, AS_OF, "AG", "RM", folder), "d1": pages.executive_page(s, AS_OF, folder), "d2": pages.product_channel_page(s, folder),
        "d3": pages.failure_page(s, folder), "d4": pages.corridor_page(s, "RM", folder), "d5": pages.agent_page(s, "AG", folder),
    }


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_tables_equal_those_made_apart(star, tmp_path, rows):
    s = star if rows == "odd" else replace(star, transactions=star.transactions.limit(0))
    one, many = together(s, str(tmp_path)), apart(s)
    for page in many:
        assert one[page].keys() == many[page].keys()
        for name in many[page]:
            assert one[page][name].columns == many[page][name].columns, name
            assert plain(one[page][name]) == plain(many[page][name]), name


def test_every_row_of_the_fact_is_read_once_for_a_page(spark, star, tmp_path):
    rows, read = star.transactions.count(), spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    t = star.transactions.mapInArrow(seen, star.transactions.schema)
    found = together(replace(star, transactions=t), str(tmp_path))
    for tables in found.values():
        for df in tables.values():
            df.collect()
    assert read.value == len(found) * rows


@pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")
def test_plans_of_the_passes(spark):
    s = materialized_star(spark, SF)
    for parts in (
        pages.pack_parts(s, P.as_of, P.agency_product, P.remit_product), pages.executive_parts(s, P.as_of), pages.product_channel_parts(),
        pages.failure_parts(), pages.corridor_parts(P.remit_product), pages.agent_parts(P.agency_product),
    ):
        assert fact_scans(cells(s.transactions, parts)[0]) == 1
    # rows of no part stay at the scan
    plan = cells(s.transactions, pages.corridor_parts(P.remit_product))[0]._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "PRODUCT" in plan.split("PushedFilters")[1][:300]
    for page in PAGES:
        tables = {"pack": [k for k in entry.REGISTRY if k.startswith("pack_")]}.get(page, [k for k in entry.REGISTRY if k.startswith(f"page_{page}")])
        assert tables and not [f for k in tables for f in entry.queries()[k](spark, SF).inputFiles() if "/transactions/" in f]


def test_parts_share_keys_and_aggregates(star):
    parts = {
        "a": Part({"k": F.col("PRODUCT")}, {"n": ROWS, "v": ("sum", F.col("TXN_AMOUNT_USD"))}),
        "b": Part({"k": F.col("CHANNEL")}, {"m": ROWS, "w": ("sum", F.col("TXN_AMOUNT_USD"))}, F.col("STATUS") == "FAILED"),
        "c": Part({"k": F.col("PROCESSING_TIME_SECS")}, {"least": ("min", F.col("TXN_AMOUNT_USD")), "ok": count_if(F.col("STATUS") == "SUCCESS")}),
    }
    rows, columns = cells(star.transactions, parts)
    assert columns["a"]["k"] == columns["b"]["k"] != columns["c"]["k"]  # of another type
    assert columns["a"]["n"] == columns["b"]["m"] and columns["a"]["v"] == columns["b"]["w"]
    out = gather(star.transactions, parts)
    t = star.transactions
    assert plain(out["a"]) == plain(t.groupBy(F.col("PRODUCT").alias("k")).agg(F.count("*").alias("n"), F.sum("TXN_AMOUNT_USD").alias("v")))
    assert plain(out["b"]) == plain(t.filter("STATUS = 'FAILED'").groupBy(F.col("CHANNEL").alias("k")).agg(F.count("*").alias("m"), F.sum("TXN_AMOUNT_USD").alias("w")))
    assert plain(out["c"]) == plain(t.groupBy(F.col("PROCESSING_TIME_SECS").alias("k")).agg(F.min("TXN_AMOUNT_USD").alias("least"), F.count(F.when(F.col("STATUS") == "SUCCESS", 1)).alias("ok")))
    with pytest.raises(ValueError):
        cells(t, {"x": Part({}, {}, None, {"p": F.col("AGENT_ID"), "q": F.col("CUSTOMER_ID")})})


def test_rows_are_tagged_without_a_function_per_row(spark, star):
    """Tags are made in generated code: a lambda over each row's array of tags took a third of the pass."""
    from ledgerlens.plans.inspect import physical_plan

    parts = pages.pack_parts(star, P.as_of, "AG", "RM")
    rows, _ = cells(star.transactions, parts)
    assert "lambda" not in physical_plan(rows)
