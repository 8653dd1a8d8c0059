"""Statistical operators: golden arithmetic from the published outputs, bounds, and traps."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import rfm, stats
from ledgerlens.plans.ordered import exact_quantiles, global_index
from ledgerlens.sources import schemas

AS_OF = dt.date(2024, 6, 10)


def test_ab_test_reproduces_published_numbers(txns):
    # back-solved counts: control 4,426 of 4,811, treatment 4,339 of 4,718
    d = dt.date(2024, 5, 1)
    data = (
        [{"CHANNEL": "C", "PRODUCT": "X", "TRANSACTION_DATE": d}] * 4426
        + [{"CHANNEL": "C", "PRODUCT": "X", "TRANSACTION_DATE": d, "STATUS": "FAILED"}] * (4811 - 4426)
        + [{"CHANNEL": "T", "PRODUCT": "X", "TRANSACTION_DATE": d}] * 4339
        + [{"CHANNEL": "T", "PRODUCT": "X", "TRANSACTION_DATE": d, "STATUS": "FAILED"}] * (4718 - 4339)
    )
    r = stats.ab_test_success_rate(txns(data), "C", "T", "X", AS_OF).collect()[0]
    assert (r.control_sr_pct, r.treatment_sr_pct) == (92.0, 91.97)
    assert r.z == -0.055 and r.p_value == 0.9562 and r.significant is False
    assert r.lift_pp == -0.03


def test_normal_tail_polynomial_accuracy(spark):
    zs = [0.0, 0.5, 1.0, 1.96, 2.5, 4.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    got = [r.p for r in df.select(stats.normal_two_sided_p(F.col("z")).alias("p")).collect()]
    for z, p in zip(zs, got):
        exact = math.erfc(z / math.sqrt(2.0))
        assert abs(p - exact) < 3e-7


def test_zscore_bound_and_zero_std(txns):
    # five months for S1 (volumes 10,10,10,10,30) and constant volumes for S2
    data = []
    for m, n in enumerate([10, 10, 10, 10, 30], start=1):
        data += [{"TRANSACTION_DATE": dt.date(2024, m, 1), "SUBSIDIARY": "S1"}] * n
        data += [{"TRANSACTION_DATE": dt.date(2024, m, 1), "SUBSIDIARY": "S2"}] * 7
    out = stats.zscore_anomalies(txns(data)).collect()
    assert [r.SUBSIDIARY for r in out] == ["S1"]  # zero std never flags
    assert out[0].z_score == 1.79 and out[0].direction == "SPIKE"  # (n-1)/sqrt(n) = 1.789 for n = 5
    assert abs(out[0].z_score) <= (5 - 1) / math.sqrt(5) + 0.005


def test_three_points_cannot_flag(txns):
    data = []
    for m, n in enumerate([1, 1, 50], start=1):
        data += [{"TRANSACTION_DATE": dt.date(2024, m, 1)}] * n
    assert stats.zscore_anomalies(txns(data)).count() == 0  # max |z| with 3 points is 1.155


def test_linear_forecast_exact_line(txns):
    # volumes 100, 110, ..., 190 in the ten complete months before June 2024
    data = []
    for i in range(10):
        m = dt.date(2023, 8, 1).replace(year=2023 + (7 + i) // 12, month=(7 + i) % 12 + 1)
        data += [{"TRANSACTION_DATE": m}] * (100 + 10 * i)
    data += [{"TRANSACTION_DATE": dt.date(2024, 6, 2)}] * 5  # current month ignored
    out = stats.linear_forecast(txns(data), AS_OF).orderBy("step").collect()
    assert [r.forecast for r in out] == [200, 210, 220]
    assert [r.month for r in out] == ["2024-06", "2024-07", "2024-08"]
    assert out[0].lower_95 == 200 and out[0].upper_95 == 200 and out[0].slope == 10.0 and out[0].r2 == 1.0


def test_complete_months(txns):
    data = [{"TRANSACTION_DATE": dt.date(2024, 1, d)} for d in range(1, 29)] + [{"TRANSACTION_DATE": dt.date(2024, 2, 1)}]
    out = {r.month: r.is_complete for r in stats.complete_months(txns(data)).collect()}
    assert out == {"2024-01": True, "2024-02": False}


@pytest.mark.parametrize("n", [1, 2, 7, 101, 1000])
def test_exact_quantiles_match_numpy(spark, n):
    rng = np.random.default_rng(n)
    a = rng.integers(0, 50, n).astype(float)
    b = rng.normal(size=n)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    probs = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
    got = {(r.column, r.q): r.value for r in exact_quantiles(df, ["a", "b"], probs).collect()}
    for col, arr in (("a", a), ("b", b)):
        for p in probs:
            assert got[(col, p)] == pytest.approx(np.quantile(arr, p), rel=1e-12, abs=1e-12)


def test_global_index_is_a_permutation(spark):
    df = spark.range(0, 500).select((F.col("id") % 13).alias("k"), "id")
    idx = global_index(df, ["k", "id"], num_partitions=7).collect()
    assert sorted(r._idx for r in idx) == list(range(500))
    ordered = [(r.k, r.id) for r in sorted(idx, key=lambda r: r._idx)]
    assert ordered == sorted(ordered)


def test_rfm_recency_floors_elapsed_time(spark, txns, frame):
    customers = frame([(1, "RETAIL", "S1"), (2, "SME", "S1")], schemas.CUSTOMERS)
    data = [
        {"CUSTOMER_ID": 1, "TRANSACTION_DATE": dt.datetime(2024, 6, 1, 23, 0)},
        {"CUSTOMER_ID": 2, "TRANSACTION_DATE": dt.datetime(2024, 6, 2, 1, 0)},  # snapshot
    ]
    out = {r.CUSTOMER_ID: r.recency for r in rfm.rfm_features(txns(data), customers, AS_OF).collect()}
    assert out == {1: 0, 2: 0}  # two hours: 0 whole days, although the dates differ


def test_rfm_segments_and_revenue_at_risk(spark, txns, frame):
    customers = frame([(i, "RETAIL", "S1") for i in range(10)], schemas.CUSTOMERS)
    data = []
    for i in range(10):
        data += [{"CUSTOMER_ID": i, "TRANSACTION_DATE": dt.date(2024, 6, 1) - dt.timedelta(days=i),
                  "TXN_AMOUNT_USD": 10 * (i + 1)}] * (i + 1)
    scored = rfm.rfm_scores(rfm.rfm_features(txns(data), customers, AS_OF))
    seg = {r.CUSTOMER_ID: (r.R, r.F, r.M, r.RFM_SEGMENT) for r in scored.collect()}
    assert seg[0][0] == 5 and seg[9][0] == 1  # most recent scores highest on R
    assert all(s[3] in {"Champions", "Loyal", "Potential Loyalists", "At Risk", "Lost"} for s in seg.values())
    risk = rfm.revenue_at_risk(scored).collect()[0]
    expect = sum((i + 1) * 10 * (i + 1) for i, s in seg.items() if s[3] in ("At Risk", "Lost"))
    assert risk.revenue_at_risk == expect
    summary = {r.RFM_SEGMENT: r for r in rfm.rfm_summary(scored).collect()}
    assert sum(r.customers for r in summary.values()) == 10


def test_running_sum_with_hot_group_spanning_partitions(spark):
    from ledgerlens.plans.ordered import running_sum

    # group "hot" holds most rows, so it spans several range partitions
    rows = [("hot" if i % 10 else f"g{i % 3}", i, float(i % 17)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, o long, v double")
    got = {(r.g, r.o): r.rs for r in running_sum(df, "v", ["g"], ["o"], "rs", num_partitions=9).collect()}
    acc: dict[str, float] = {}
    for g, o, v in sorted(rows, key=lambda t: (t[0], t[1])):
        acc[g] = acc.get(g, 0.0) + v
        assert got[(g, o)] == acc[g]


def test_zscore_skips_partial_months_on_request(txns):
    data = []
    for m in range(1, 6):
        data += [{"TRANSACTION_DATE": dt.date(2024, m, d)} for d in range(1, 29)] * 2
    data += [{"TRANSACTION_DATE": dt.date(2024, 6, 1)}]  # partial month: a big DROP
    assert [r.month for r in stats.zscore_anomalies(txns(data)).collect()] == ["2024-06"]
    assert stats.zscore_anomalies(txns(data), min_days=28).count() == 0


def test_rfm_approximate_quintiles_close_to_exact(spark, txns, frame):
    customers = frame([(i, "RETAIL", "S1") for i in range(40)], schemas.CUSTOMERS)
    data = []
    for i in range(40):
        data += [{"CUSTOMER_ID": i, "TRANSACTION_DATE": dt.date(2024, 6, 1) - dt.timedelta(days=i % 9),
                  "TXN_AMOUNT_USD": 3 * i + 1}] * (1 + i % 5)
    feats = rfm.rfm_features(txns(data), customers, AS_OF)
    exact = {r.CUSTOMER_ID: r.RFM for r in rfm.rfm_scores(feats).collect()}
    approx = {r.CUSTOMER_ID: r.RFM for r in rfm.rfm_scores(feats, exact=False).collect()}
    assert exact.keys() == approx.keys()
    assert sum(abs(exact[k] - approx[k]) for k in exact) <= len(exact)  # boundary cases only


def test_revenue_at_risk_golden_sum(spark):
    # the published segment totals: At Risk 2,545,050.5 + Lost 183,480.2 = 2,728,530.7
    from decimal import Decimal as Dec

    scored = spark.createDataFrame(
        [("At Risk", Dec("2545050.5")), ("Lost", Dec("183480.2")), ("Loyal", Dec("5428957.5")), ("Champions", Dec("2833216.5"))],
        "RFM_SEGMENT string, monetary decimal(20,4)",
    )
    r = rfm.revenue_at_risk(scored).collect()[0]
    assert r.revenue_at_risk == 2728530.7 and r.customers_at_risk == 2


def test_calendar_helpers_match_spark(spark):
    from ledgerlens.params import add_months, prior_month_bounds

    days = [dt.date(2024, 1, 31), dt.date(2024, 3, 31), dt.date(2023, 12, 15), dt.date(2024, 2, 29)]
    for d in days:
        for n in (-13, -12, -3, -1, 1, 12):
            spark_val = spark.range(1).select(F.add_months(F.lit(d), n).alias("v")).collect()[0].v
            assert add_months(d, n) == spark_val, (d, n)
    assert prior_month_bounds(dt.date(2024, 1, 10)) == (dt.date(2023, 12, 1), dt.date(2024, 1, 1))


@pytest.mark.parametrize("parts", [1, 5, 13])
def test_distributed_ntile_matches_window_ntile(spark, parts):
    from pyspark.sql import Window

    from ledgerlens.plans.ordered import ntile

    rows = [("big" if i % 7 else ("s" if i % 2 else None), i % 23, i) for i in range(700)] + [("tiny", 1, 9999)]
    df = spark.createDataFrame(rows, "g string, v long, k long")
    order = [F.col("v").desc(), F.col("k").asc()]
    want = {r.k: r.t for r in df.withColumn("t", F.ntile(4).over(Window.partitionBy("g").orderBy(*order))).collect()}
    got = {r.k: r.t for r in ntile(df, 4, ["g"], order, "t", num_partitions=parts).collect()}
    assert got == want


def test_single_month_series_has_no_forecast_and_no_anomaly(txns):
    data = [{"TRANSACTION_DATE": dt.date(2024, 3, 1), "SUBSIDIARY": "ONE"}] * 5
    data += [{"TRANSACTION_DATE": dt.date(2024, m, 1), "SUBSIDIARY": "MANY"} for m in (1, 2, 3, 4) for _ in range(m)]
    f = stats.linear_forecast(txns(data), AS_OF).collect()
    assert {r.SUBSIDIARY for r in f} == {"MANY"}  # one month: no line to fit
    assert stats.zscore_anomalies(txns(data), threshold=0.0).filter("SUBSIDIARY = 'ONE'").count() == 0


def test_four_point_zscore_bound(txns):
    # with n points |z| <= (n-1)/sqrt(n): 1.5 for four points, reached by 1, 1, 1, big
    data = []
    for m, n in enumerate([1, 1, 1, 1000], start=1):
        data += [{"TRANSACTION_DATE": dt.date(2024, m, 1)}] * n
    out = stats.zscore_anomalies(txns(data)).collect()
    assert len(out) == 1 and out[0].z_score == 1.5


def test_quantiles_of_a_hot_value_stay_spread(spark):
    """80 % of the rows share a value: the ranked table has one row for it, and no task gets the rows."""
    from pyspark.sql import functions as F

    rows = [(7,)] * 16_000 + [(i,) for i in range(4_000)]
    df = spark.createDataFrame(rows, "v long").repartition(8)
    out = {r.q: r.value for r in exact_quantiles(df, ["v"], [0.2, 0.5, 0.9], num_partitions=8).collect()}
    expected = np.quantile([r[0] for r in rows], [0.2, 0.5, 0.9])
    assert [out[q] for q in (0.2, 0.5, 0.9)] == list(expected)
    counted = df.groupBy("v").agg(F.count("*").alias("c"))
    assert counted.count() == 4_000
