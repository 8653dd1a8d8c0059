"""Worksheet formulas, the measure layer and dashboards on hand-made frames."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerlens.operators import dashboards, export, measures, worksheet
from ledgerlens.sources import schemas

AS_OF = dt.date(2024, 6, 10)
MAY, APR = dt.date(2024, 5, 5), dt.date(2024, 4, 5)


def test_x3_missing_target_is_red_and_attainment_zero(txns, frame):
    targets = frame([("P1", "S1", dt.date(2024, 5, 1), 2, Decimal("1.00"), Decimal("90.00"), 1)], schemas.KPI_TARGETS)
    data = [{"TRANSACTION_DATE": MAY}] * 2 + [{"TRANSACTION_DATE": MAY, "PRODUCT": "P2"}]
    out = {r.PRODUCT: r for r in worksheet.volume_rag(txns(data), targets, AS_OF).collect()}
    assert out["P1"].rag == "GREEN" and out["P1"].attainment == 1.0
    assert out["P2"].target == 0 and out["P2"].attainment == 0.0 and out["P2"].rag == "RED"


def test_x6_arrow_bands(txns):
    def grp(p, cur, prev):
        return [{"PRODUCT": p, "TRANSACTION_DATE": MAY}] * cur + [{"PRODUCT": p, "TRANSACTION_DATE": APR}] * prev

    data = grp("UP10", 11, 10) + grp("UP", 21, 20) + grp("DOWN10", 9, 10) + grp("DOWNBIG", 8, 10) + grp("NOPREV", 3, 0)
    out = {r.PRODUCT: r.mom_arrow for r in worksheet.mom_arrow(txns(data), AS_OF).collect()}
    assert out["UP10"] == "▲▲ 10.0%"
    assert out["UP"] == "▲ 5.0%"
    assert out["DOWN10"] == "▼ 10.0%"  # -10 % is inside the single-arrow band (>= -0.1)
    assert out["DOWNBIG"] == "▼▼ 20.0%"
    assert out["NOPREV"] == "▼ 0.0%"  # division error -> 0 -> single down arrow


def test_x7_missing_agent_and_zero_limit(txns, frame):
    agents = frame([("AG1", "a", "GOLD", "R", "K", 0)], schemas.AGENTS)
    data = [{"AGENT_ID": "AG1", "TRANSACTION_DATE": MAY}, {"AGENT_ID": "AG9", "TRANSACTION_DATE": MAY}]
    out = {r.AGENT_ID: r for r in worksheet.float_utilisation(txns(data), agents, AS_OF).collect()}
    assert out["AG1"].float_utilisation is None  # "N/A"
    assert out["AG9"].float_limit == 1 and out["AG9"].float_utilisation == 100.0


def test_x8_cells_sum_all_products(txns):
    data = [
        {"PRODUCT": "R", "SOURCE_COUNTRY": "A", "DEST_COUNTRY": "B", "TRANSACTION_DATE": MAY, "TXN_AMOUNT_USD": 1},
        {"PRODUCT": "Z", "SOURCE_COUNTRY": "A", "DEST_COUNTRY": "B", "TRANSACTION_DATE": MAY, "TXN_AMOUNT_USD": 2},
        {"PRODUCT": "Z", "SOURCE_COUNTRY": "A", "DEST_COUNTRY": "C", "TRANSACTION_DATE": MAY, "TXN_AMOUNT_USD": 4},
    ]
    out = {(r.TXN_MONTH, r.corridor): r.value_usd for r in worksheet.corridor_month_matrix(txns(data), "R").collect()}
    assert out == {("2024-05", "A->B"): 3.0}
    only = worksheet.corridor_month_matrix(txns(data), "R", restrict_product=True).collect()
    assert only[0].value_usd == 1.0


def test_x9_ytd_running_total_ends_at_year_total(txns):
    data = [{"TRANSACTION_DATE": dt.date(2024, 1 + i % 5, 1 + i % 3), "TXN_AMOUNT_USD": i, "CUSTOMER_ID": i}
            for i in range(1, 40)]
    data += [{"TRANSACTION_DATE": dt.date(2023, 12, 31), "TXN_AMOUNT_USD": 1000}]  # previous year excluded
    out = worksheet.ytd_running_total(txns(data), AS_OF, "S1").collect()
    ordered = sorted(out, key=lambda r: (r.txn_date, r.TXN_AMOUNT_USD, r.CUSTOMER_ID))
    running = 0
    for r in ordered:
        running += float(r.TXN_AMOUNT_USD)
        assert r.ytd_usd == running
    assert running == sum(range(1, 40))


def test_m10_calendar_shift_not_lag(txns):
    data = [{"TRANSACTION_DATE": dt.date(2024, 1, 2)}] * 4 + [{"TRANSACTION_DATE": dt.date(2024, 3, 2)}] * 5
    monthly = measures.monthly_measures(txns(data), ["PRODUCT"])
    out = {r.month: r for r in measures.prior_period_measures(monthly, ["PRODUCT"]).collect()}
    mar = out[dt.date(2024, 3, 1)]
    assert mar.transactions_lm is None and mar.mom_volume_growth_pct is None and mar.mom_arrow == "—"
    assert mar.success_rate_lm == 0.0 and mar.mom_success_rate_change_pp == 100.0  # empty prior month SR is 0
    feb = out[dt.date(2024, 2, 1)]  # nothing sold: blank, and all of January lost
    assert feb.total_transactions is None and feb.transactions_lm == 4 and feb.mom_volume_growth_pct == -100.0
    assert feb.success_rate_pct == 0.0 and feb.mom_success_rate_change_pp == -100.0 and feb.mom_customer_growth_pct == -100.0
    assert feb.mom_value_growth_pct == -100.0 and feb.mom_arrow == "▼▼ 100.0%"
    assert set(out) == {dt.date(2024, m, 1) for m in (1, 2, 3)}  # no month beyond the calendar


def test_m21_arrow_exclusive_lower_band(txns):
    data = [{"TRANSACTION_DATE": dt.date(2024, 1, 2)}] * 10 + [{"TRANSACTION_DATE": dt.date(2024, 2, 2)}] * 9
    monthly = measures.monthly_measures(txns(data), [])
    out = {r.month: r.mom_arrow for r in measures.prior_period_measures(monthly, []).collect()}
    assert out[dt.date(2024, 2, 1)] == "▼▼ 10.0%"  # measure form: > -10 for the single arrow


def test_m27_m28_empty_month_policies(txns):
    data = [{"TRANSACTION_DATE": dt.date(2024, 1, 2)}] * 3 + [{"TRANSACTION_DATE": dt.date(2024, 3, 2)}] * 6
    monthly = measures.monthly_measures(txns(data), ["PRODUCT"])
    out = {r.month: r for r in measures.rolling_measures(monthly, ["PRODUCT"]).collect()}
    mar = out[dt.date(2024, 3, 1)]
    assert mar.rolling_3m_avg_success_rate == (100.0 + 0.0 + 100.0) / 3  # empty February counts as 0
    assert mar.rolling_3m_avg_transactions == 4.5  # empty February skipped
    assert out[dt.date(2024, 2, 1)].total_transactions is None


def test_m30_ytd_december_equals_year_total(txns):
    data = [{"TRANSACTION_DATE": dt.date(2023, m, 1)} for m in range(1, 13) for _ in range(m)]
    data += [{"TRANSACTION_DATE": dt.date(2024, 2, 1)}] * 3
    monthly = measures.monthly_measures(txns(data), ["PRODUCT"])
    out = {r.month: r for r in measures.ytd_measures(monthly, ["PRODUCT"]).collect()}
    assert out[dt.date(2023, 12, 1)].ytd_transactions == sum(range(1, 13))
    assert out[dt.date(2024, 2, 1)].ytd_transactions == 3
    assert out[dt.date(2024, 2, 1)].ytd_vs_prior_year_pct == (3 - 3) / 3 * 100.0  # Jan+Feb 2023 = 1 + 2


def test_m38_new_customers_sum_to_distinct(txns):
    data = [{"CUSTOMER_ID": c, "TRANSACTION_DATE": dt.date(2024, m, 1)} for c, m in [(1, 1), (1, 2), (2, 2), (3, 3), (2, 3)]]
    out = {r.month: r.new_customers for r in measures.new_customers(txns(data)).collect()}
    assert out == {dt.date(2024, 1, 1): 1, dt.date(2024, 2, 1): 1, dt.date(2024, 3, 1): 1}
    assert sum(out.values()) == 3


def test_m26_sr_rag_uses_best_target_of_any_month(txns, frame):
    targets = frame(
        [("P1", "S1", dt.date(2024, 1, 1), 1, Decimal("1.00"), Decimal("90.00"), 1),
         ("P1", "S1", dt.date(2024, 2, 1), 1, Decimal("1.00"), Decimal("99.00"), 1)],
        schemas.KPI_TARGETS,
    )
    data = [{"TRANSACTION_DATE": dt.date(2024, 1, 3)}] * 19 + [{"TRANSACTION_DATE": dt.date(2024, 1, 3), "STATUS": "FAILED"}]
    monthly = measures.monthly_measures(txns(data), ["PRODUCT", "SUBSIDIARY"])
    r = measures.attainment_measures(monthly, targets).collect()[0]
    assert r.success_rate_rag == "AMBER"  # 95 vs max target 99 (not January's 90)
    assert r.volume_attainment_pct == 2000.0 and r.volume_rag == "GREEN" and r.volume_rag_numeric == 1


def test_m22_target_without_sales_is_red(txns, frame):
    targets = frame([("P9", "S1", dt.date(2024, 1, 1), 5, Decimal("1.00"), Decimal("90.00"), 1)], schemas.KPI_TARGETS)
    monthly = measures.monthly_measures(txns([{"TRANSACTION_DATE": dt.date(2024, 1, 3)}]), ["PRODUCT", "SUBSIDIARY"])
    out = {r.PRODUCT: r for r in measures.attainment_measures(monthly, targets).collect()}
    assert out["P1"].target_volume is None and out["P1"].volume_rag == "RED"
    assert out["P9"].total_transactions is None and out["P9"].volume_attainment_pct == 0.0
    assert (out["P9"].volume_rag, out["P9"].success_rate_rag) == ("RED", "RED")


def test_wide_matrices_refuse_unlisted_products(txns):
    import pytest
    from pyspark.errors import PySparkException

    t = txns([{"PRODUCT": p} for p in ("A", "B", "NEW")])
    assert worksheet.channel_product_sr(t).count() == 3 and dashboards.month_product(t).count() == 3
    for wide in (worksheet.channel_product_sr_matrix, dashboards.month_product_matrix):
        assert wide(t, ["A", "B", "NEW"]).count() == 1
        with pytest.raises(PySparkException, match="product without a column: NEW"):
            wide(t, ["A", "B"]).collect()


def test_x8_grid_has_the_zeros(txns):
    data = [{"PRODUCT": "R", "SOURCE_COUNTRY": "A", "DEST_COUNTRY": d, "TRANSACTION_DATE": m, "TXN_AMOUNT_USD": 2} for d, m in (("B", MAY), ("C", APR))]
    long = worksheet.corridor_month_matrix(txns(data), "R")
    grid = {(r.TXN_MONTH, r.corridor): r.value_usd for r in worksheet.corridor_month_grid(long).collect()}
    assert grid == {("2024-04", "A->B"): 0.0, ("2024-05", "A->B"): 2.0, ("2024-04", "A->C"): 2.0, ("2024-05", "A->C"): 0.0}


def test_x7_rows_are_the_agent_list(txns, frame):
    agents = frame([("AG1", "a", "GOLD", "R", "K", 10), ("AG2", "b", "GOLD", "R", "K", 10)], schemas.AGENTS)
    out = {r.AGENT_ID: r.value_local for r in worksheet.float_utilisation(txns([{"AGENT_ID": "AG1", "TRANSACTION_DATE": MAY}]), agents, AS_OF).collect()}
    assert out == {"AG1": 100.0, "AG2": 0.0}


def test_labels_give_the_same_rows(txns, frame):
    data = [{"PRODUCT": p, "TRANSACTION_DATE": d} for p, d in (("A", MAY), ("A", APR), ("B", dt.date(2024, 1, 1)))]
    t, targets = txns(data), frame([], schemas.KPI_TARGETS)
    labels = measures.monthly_measures(t, ["PRODUCT", "SUBSIDIARY"])
    for f in (
        lambda x: worksheet.last_month_volume(t, AS_OF, "S1", labels=x), lambda x: worksheet.last_month_success_rate(t, AS_OF, labels=x),
        lambda x: worksheet.volume_rag(t, targets, AS_OF, labels=x), lambda x: worksheet.mom_arrow(t, AS_OF, labels=x),
    ):
        assert sorted(map(tuple, f(labels).collect())) == sorted(map(tuple, f(None).collect()))


def test_m42_title(spark):
    t = spark.range(1).select(measures.report_title(F.lit(AS_OF)).alias("t"))
    assert t.collect()[0].t == "Payments Performance — May 2024"


def test_p6_failure_summary_excludes_blank_and_null(txns):
    data = [{"STATUS": "FAILED", "FAILURE_DESCRIPTION": d, "FAILURE_CATEGORY": "c"} for d in ("x", "", None)]
    out = export.failure_summary(txns(data)).collect()
    assert [r.FAILURE_DESCRIPTION for r in out] == ["x"]


def test_write_pack(tmp_path, txns, frame):
    agents = frame([("AG1", "a", "GOLD", "R", "K", 10)], schemas.AGENTS)
    customers = frame([(1, "RETAIL", "S1")], schemas.CUSTOMERS)
    t = txns([{"TRANSACTION_DATE": MAY, "AGENT_ID": "AG1", "PRODUCT": "AG"}])
    pack = export.report_pack(t, agents, customers, AS_OF, "AG", "R")
    paths = export.write_pack(pack, str(tmp_path), fmt="csv")
    assert set(paths) == {"Monthly_KPIs", "Failure_Summary", "Agent_Scorecard", "Corridor_Performance", "Customer_Segments"}
    spark = t.sparkSession
    assert spark.read.option("header", True).csv(paths["Monthly_KPIs"]).count() == 1


def test_d2_channel_share_sums_to_100(txns):
    data = [{"CHANNEL": c} for c in ("A", "A", "B", "C")]
    out = dashboards.channel_share(txns(data)).collect()
    assert abs(sum(r.share_pct for r in out) - 100.0) < 1e-9


def test_date_table_covers_every_day(txns):
    data = [{"TRANSACTION_DATE": dt.date(2024, 1, 30)}, {"TRANSACTION_DATE": dt.date(2024, 3, 2)}]
    cal = measures.date_table(txns(data)).collect()
    assert len(cal) == 33 and cal[0].MonthYear == "Jan 2024"


def test_m09_distinct_count_counts_blank_once(txns):
    data = [{"CUSTOMER_ID": c} for c in (1, 1, 2, None, None)]
    assert measures.base_measures(txns(data), []).collect()[0].unique_customers == 3
    assert measures.base_measures(txns(data), [], count_blank_customer=False).collect()[0].unique_customers == 2


def test_d1_cards_measure_arrow_and_blank_yoy(txns):
    data = [{"TRANSACTION_DATE": dt.date(2024, 4, 3)}] * 10 + [{"TRANSACTION_DATE": dt.date(2024, 5, 3)}] * 9
    r = dashboards.kpi_cards(txns(data), AS_OF).collect()[0]
    assert r.total_transactions == 9 and r.mom_arrow == "▼▼ 10.0%" and r.yoy_volume_growth_pct is None


def test_d4_corridor_table_excludes_null_ends(txns):
    data = [
        {"PRODUCT": "R", "SOURCE_COUNTRY": "A", "DEST_COUNTRY": "B"},
        {"PRODUCT": "R", "SOURCE_COUNTRY": None, "DEST_COUNTRY": "B"},
        {"PRODUCT": "R", "SOURCE_COUNTRY": "A", "DEST_COUNTRY": "A"},
    ]
    out = dashboards.corridor_table(txns(data), "R").collect()
    assert [(r.corridor, r.total_transactions) for r in out] == [("A->B", 1)]


def test_d5_region_totals_per_agent_then_region(txns, frame):
    agents = frame([("AG1", "a", "GOLD", "R1", "K1", 1), ("AG2", "b", "GOLD", "R1", "K2", 1)], schemas.AGENTS)
    data = [{"PRODUCT": "AG", "AGENT_ID": "AG1"}] * 3 + [{"PRODUCT": "AG", "AGENT_ID": "AG2"}] + [{"PRODUCT": "AG", "AGENT_ID": ""}]
    r = dashboards.region_totals(txns(data), agents, "AG").collect()[0]
    assert (r.REGION, r.total_transactions, r.agents) == ("R1", 4, 2)
