"""Micro-frame tests for the report operators: the semantic traps of SURVEY 2.13."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from ledgerlens.operators import cohort, reports
from ledgerlens.sources import schemas

AS_OF = dt.date(2024, 6, 10)


def rows(df, *order):
    return [r.asDict() for r in df.orderBy(*order).collect()] if order else [r.asDict() for r in df.collect()]


def test_r01_lag_is_row_based_and_filter_after_window(txns):
    # months 2024-01, 2024-03 (Feb missing), 2024-04 ... LAG gives the previous *present* month
    data = []
    for m, n in [(1, 2), (3, 4), (4, 5), (5, 10)]:
        data += [{"TRANSACTION_DATE": dt.date(2024, m, 3), "CUSTOMER_ID": i} for i in range(n)]
    out = reports.monthly_product_performance(txns(data), AS_OF, "S1", months=3)
    r = {x["txn_month"]: x for x in rows(out)}
    assert set(r) == {"2024-03", "2024-04", "2024-05"}  # >= 2024-03 (trunc(as_of) - 3 months)
    assert r["2024-03"]["mom_vol_pct"] == 100.0  # vs January (row-based), from history below the window
    assert r["2024-05"]["mom_vol_pct"] == 100.0
    assert r["2024-05"]["yoy_vol_pct"] is None
    assert r["2024-05"]["sla_status"] == "OK"


def test_r01_sla_breach_below_95(txns):
    data = [{"STATUS": "SUCCESS"}] * 19 + [{"STATUS": "FAILED"}]  # exactly 95.0 -> OK
    data2 = [{"STATUS": "SUCCESS", "PRODUCT": "P2"}] * 18 + [{"STATUS": "FAILED", "PRODUCT": "P2"}] * 2
    out = reports.monthly_product_performance(txns(data + data2), AS_OF, None, months=3)
    r = {x["PRODUCT"]: x for x in rows(out)}
    assert r["P1"]["success_rate_pct"] == 95.0 and r["P1"]["sla_status"] == "OK"
    assert r["P2"]["sla_status"] == "BREACH"


def test_r02_rag_thresholds_and_missing_target(txns, frame):
    prior = dt.date(2024, 5, 20)
    data = [{"TRANSACTION_DATE": prior, "PRODUCT": " p1 ", "SUBSIDIARY": "s1", "CUSTOMER_ID": i,
             "AGENT_ID": a} for i, a in enumerate(["AG1", " ag1 ", "", None, "AG2"] + ["AG3"] * 14)]
    data += [{"TRANSACTION_DATE": prior, "PRODUCT": "P9", "CUSTOMER_ID": 1}]  # no target
    targets = frame(
        [("P1", "S1", dt.date(2024, 5, 1), 20, Decimal("19.00"), Decimal("95.00"), 19)], schemas.KPI_TARGETS
    )
    out = rows(reports.kpi_rag(txns(data), targets, AS_OF))
    assert len(out) == 1  # missing target dropped (inner join)
    r = out[0]
    assert r["actual_vol"] == 19 and r["vol_attainment_pct"] == 95.0 and r["vol_rag"] == "GREEN"  # 19 >= 20*0.95
    assert r["active_agents"] == 3  # AG1 (trim/upper merges ' ag1 '), AG2, AG3; blank and NULL ignored
    red = rows(reports.kpi_rag(txns(data), targets, AS_OF, missing_target="red"))
    assert {x["PRODUCT"]: x["vol_rag"] for x in red}["P9"] == "RED"


def test_r03_trend_flags_exact_ties(txns):
    base = {"STATUS": "FAILED", "FAILURE_DESCRIPTION": "x", "FAILURE_CATEGORY": "c"}
    recent, prior = dt.date(2024, 6, 8), dt.date(2024, 5, 25)

    def grp(ch, tw, pw):
        return [{**base, "CHANNEL": ch, "TRANSACTION_DATE": recent}] * tw + [
            {**base, "CHANNEL": ch, "TRANSACTION_DATE": prior}
        ] * pw

    data = grp("NEW", 1, 0) + grp("TIE", 2, 4) + grp("SPIKE", 3, 4) + grp("IMPR", 1, 6) + grp("ZERO", 0, 3)
    out = {r["channel"]: r for r in rows(reports.failure_spikes(txns(data), AS_OF))}
    assert "ZERO" not in out  # this_week > 0
    assert out["NEW"]["trend_flag"] == "NEW"
    assert out["TIE"]["trend_flag"] == "STABLE"  # 2 == (4/3)*1.5 exactly: not strictly greater
    assert out["SPIKE"]["trend_flag"] == "SPIKING"
    assert out["IMPR"]["trend_flag"] == "IMPROVING"  # 1 < 2*0.7
    assert out["TIE"]["avg_prior_wk"] == 1.3 and out["TIE"]["wow_pct"] == 50.0


def test_r04_ntile_float_risk_dormancy_zero_limit(txns, frame):
    prior = dt.date(2024, 5, 2)
    agents = frame(
        [("AG1", "n1", "GOLD", "R1", "K1", 0), ("AG2", "n2", "BASIC", "R1", "K2", 1000)], schemas.AGENTS
    )
    data = [{"PRODUCT": "AGENCY", "AGENT_ID": "AG1", "TRANSACTION_DATE": prior, "STATUS": "FAILED",
             "FAILURE_CODE": "INSUFF_FLOAT"}] * 6
    data += [{"PRODUCT": "AGENCY", "AGENT_ID": "AG2", "TRANSACTION_DATE": dt.date(2024, 5, 30)}] * 6
    data += [{"PRODUCT": "AGENCY", "AGENT_ID": "", "TRANSACTION_DATE": prior}]
    out = {r["AGENT_ID"]: r for r in rows(reports.agent_scorecard(txns(data), agents, AS_OF, "AGENCY"))}
    assert out["AG1"]["float_util_ratio"] is None  # limit 0 -> NULLIF
    assert out["AG1"]["float_risk"] == "HIGH RISK" and out["AG2"]["float_risk"] == "OK"
    assert out["AG1"]["dormancy"] == "DORMANT" and out["AG2"]["dormancy"] == "ACTIVE"
    assert {out["AG1"]["band"], out["AG2"]["band"]} == {"TOP", "UPPER"}  # tie broken by AGENT_ID
    assert out["AG1"]["band"] == "TOP"


def test_r05_null_countries_distinct_from(txns):
    d = dt.date(2024, 4, 5)
    data = [
        {"PRODUCT": "R", "SOURCE_COUNTRY": "A", "DEST_COUNTRY": "A", "TRANSACTION_DATE": d},
        {"PRODUCT": "R", "SOURCE_COUNTRY": None, "DEST_COUNTRY": "A", "TRANSACTION_DATE": d},
        {"PRODUCT": "R", "SOURCE_COUNTRY": None, "DEST_COUNTRY": None, "TRANSACTION_DATE": d},
        {"PRODUCT": "R", "SOURCE_COUNTRY": "A", "DEST_COUNTRY": "B", "TRANSACTION_DATE": d},
    ]
    out = rows(reports.corridor_analysis(txns(data), AS_OF, "R"))
    corr = sorted((r["corridor"] or "<null>") for r in out)
    assert corr == ["<null>", "A->B"]  # NULL-vs-value is distinct (NULL corridor); equal ends excluded


def test_r06_first_month_change_zero(txns):
    data = [{"TRANSACTION_DATE": dt.date(2024, m, 1)} for m in (1, 2, 3, 4, 5, 6)]
    out = rows(reports.rolling_success_rate(txns(data), AS_OF), "txn_month")
    assert out[0]["sr_change_pp"] == 0.0 and out[0]["sr_volatility_6m"] == 0.0


def test_r08_rank_ties(txns):
    d = dt.date(2024, 5, 1)
    data = [{"CHANNEL": "C", "PRODUCT": p, "TRANSACTION_DATE": d} for p in ("A", "B")]
    out = rows(reports.channel_product_matrix(txns(data), AS_OF))
    assert [r["worst_sr_rank"] for r in out] == [1, 1]


def test_r12_day_labels(txns):
    data = [
        {"TRANSACTION_DATE": dt.datetime(2024, 6, 2, 23, 0)},  # Sunday
        {"TRANSACTION_DATE": dt.datetime(2024, 6, 3, 1, 0)},  # Monday
    ]
    out = {(r["day_of_week"], r["hour_of_day"]) for r in rows(reports.activity_heatmap(txns(data), AS_OF))}
    assert out == {("7-Sun", 23), ("1-Mon", 1)}


def test_r09_offset_zero_is_full_cohort(txns):
    data = [{"CUSTOMER_ID": c, "TRANSACTION_DATE": dt.date(2024, m, 1)} for c, m in [(1, 1), (1, 3), (2, 1), (3, 2)]]
    data += [{"CUSTOMER_ID": 4, "TRANSACTION_DATE": dt.date(2024, 1, 1), "STATUS": "FAILED"}]
    out = rows(cohort.cohort_retention(txns(data), cohort_months=None), "cohort_month", "month_offset")
    zero = [r for r in out if r["month_offset"] == 0]
    assert all(r["retention_rate_pct"] == 100.0 for r in zero)
    jan = {r["month_offset"]: r for r in out if r["cohort_month"] == dt.date(2024, 1, 1)}
    assert jan[0]["cohort_n"] == 2 and jan[2]["retained"] == 1 and 1 not in jan


def test_r10_remit_uses_not_equal(txns):
    data = [
        {"PRODUCT": "R", "SOURCE_COUNTRY": None, "DEST_COUNTRY": "A", "TRANSACTION_DATE": dt.date(2024, 5, 1)},
        {"PRODUCT": "R", "SOURCE_COUNTRY": "B", "DEST_COUNTRY": "A", "TRANSACTION_DATE": dt.date(2024, 5, 1)},
    ]
    out = rows(reports.subsidiary_benchmark(txns(data), AS_OF, "R"))
    assert out[0]["remit_txns"] == 1


def test_r11_fx_join_and_rank(txns, frame):
    d = dt.date(2024, 5, 3)
    fx = frame([("S1", dt.date(2024, 5, 1), Decimal("0.010000"))], schemas.FOREX_RATES)
    data = [{"PRODUCT": "A", "TRANSACTION_DATE": d, "FEE_AMOUNT_LOCAL": 10}, {"PRODUCT": "B", "TRANSACTION_DATE": d}]
    out = {r["PRODUCT"]: r for r in rows(reports.fee_profitability(txns(data), fx, AS_OF))}
    assert out["A"]["total_fees_usd"] == 0.1 and out["A"]["fee_rank"] == 1 and out["B"]["fee_rank"] == 2


def test_results_do_not_depend_on_shuffle_partitions(spark, txns):
    data = [{"CUSTOMER_ID": i % 7, "PRODUCT": f"P{i % 3}", "TRANSACTION_DATE": dt.date(2024, 1 + i % 5, 1 + i % 27),
             "TXN_AMOUNT_USD": Decimal(i) / 7} for i in range(300)]
    df = txns(data)
    a = sorted(map(tuple, reports.monthly_product_performance(df, AS_OF, None, months=12).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        b = sorted(map(tuple, reports.monthly_product_performance(df.repartition(5), AS_OF, None, months=12).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b


def test_success_plus_failed_le_total(txns):
    data = [{"STATUS": s} for s in ("SUCCESS", "FAILED", "REVERSED")]
    r = rows(reports.monthly_product_performance(txns(data), AS_OF, None))[0]
    assert r["successful_txns"] + r["failed_txns"] <= r["total_txns"] == 3


def test_category_is_a_function_of_product(txns):
    ok = txns([{"PRODUCT": "A", "PRODUCT_CATEGORY": "X"}, {"PRODUCT": "B", "PRODUCT_CATEGORY": "Y"}])
    assert reports.category_conflicts(ok).count() == 0
    bad = txns([{"PRODUCT": "A", "PRODUCT_CATEGORY": "X"}, {"PRODUCT": "A", "PRODUCT_CATEGORY": "Y"}])
    assert [r.PRODUCT for r in reports.category_conflicts(bad).collect()] == ["A"]
