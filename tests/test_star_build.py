"""The derived star: what its build moves, and that the written fact is the derived one."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.plans.inspect import physical_plan
from ledgerlens.sources import schemas, star

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")


@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_lines_are_shuffled_by_part_and_by_order_only(spark, threshold):
    """At any size: no shuffle by customer or supplier, no broadcast of parts or orders."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        plan = physical_plan(star.transactions_from_tpch(spark, SF), "simple")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(re.findall(r"hashpartitioning\((l_\w+)#", plan)) == ["l_orderkey", "l_partkey"]
    lines = plan[: plan.index("hashpartitioning(l_partkey")].split("hashpartitioning(o_custkey")
    assert len(lines) == 1 or "l_quantity" not in lines[1]
    assert plan.count("SortMergeJoin [l_") == 2


def test_rows_moved_hold_no_derived_text(spark):
    moved = star._line_rows(spark, SF)
    assert not {"PRODUCT_CATEGORY", "COUNTRY", "CURRENCY", "STATUS", "FAILURE_DESCRIPTION", "c_nation", "c_region", "s_nation"} & set(moved.columns)


def test_rows_moved_hold_codes_and_agents_only(spark):
    """Text only where a table's own values are needed, suppliers only where they are agents."""
    moved = star._line_rows(spark, SF)
    assert {f.name for f in moved.schema if f.dataType.typeName() == "string"} == {"p_type", "o_orderpriority"}
    assert moved.filter((F.col("p_type") != star.AGENCY_PRODUCT) & F.col("l_suppkey").isNotNull()).isEmpty()


def test_months_are_dealt_as_numbers(spark):
    plan = physical_plan(star._by_month(star._line_rows(spark, SF), "l_shipdate"), "simple")
    above, below = re.split(r"hashpartitioning\(_month#", plan)
    assert "TXN_MONTH" in above and "TXN_MONTH" not in below


def test_written_fact_is_the_derived_one(spark, tmp_path):
    made = star.transactions_from_tpch(spark, SF)
    assert made.columns == schemas.TRANSACTIONS.fieldNames()
    kept = star._write_fact_of_tpch(spark, SF, str(tmp_path))
    assert kept.filter(F.col("TXN_MONTH") != F.date_format("TRANSACTION_DATE", "yyyy-MM")).isEmpty()
    rows = kept.select(*made.columns)
    assert rows.schema.simpleString() == made.schema.simpleString()
    assert rows.exceptAll(made).isEmpty() and made.exceptAll(rows).isEmpty()


def test_written_files_ascend_by_date(spark, tmp_path):
    """Row groups of a file hold consecutive days, so a date range skips the others."""
    kept = star._write_fact_of_tpch(spark, SF, str(tmp_path))
    one = kept.select(F.input_file_name().alias("f")).first()["f"]
    days = [r[0] for r in spark.read.parquet(one).select("TRANSACTION_DATE").toLocalIterator()]
    assert days == sorted(days)
