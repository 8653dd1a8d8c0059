"""Results do not depend on input order or on the number of shuffle partitions."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest

from ledgerlens.operators import cohort, measures, reports, rfm, stats, worksheet
from ledgerlens.sources import schemas

AS_OF = dt.date(2024, 6, 10)
rng = random.Random(7)
ROWS = [
    {
        "TRANSACTION_DATE": dt.datetime(2023, 1, 1) + dt.timedelta(days=rng.randrange(520), hours=rng.randrange(24)),
        "PRODUCT": rng.choice(["A", "B", "C"]),
        "SUBSIDIARY": rng.choice(["S1", "S2"]),
        "CHANNEL": rng.choice(["USSD", "APP", "WEB"]),
        "STATUS": rng.choice(["SUCCESS"] * 8 + ["FAILED", "REVERSED"]),
        "CUSTOMER_ID": rng.randrange(60),
        "AGENT_ID": rng.choice(["AG1", "AG2", "AG3", "", None]),
        "SOURCE_COUNTRY": rng.choice(["K", "U", None]),
        "DEST_COUNTRY": rng.choice(["K", "U", "T"]),
        "TXN_AMOUNT_LOCAL": Decimal(rng.randrange(1, 100000)) / 100,
        "TXN_AMOUNT_USD": Decimal(rng.randrange(1, 1000000)) / 10000,
        "FEE_AMOUNT_LOCAL": Decimal(rng.randrange(0, 10000)) / 10000,
        "PROCESSING_TIME_SECS": rng.choice([None, 5, 30, 61]),
        "FAILURE_DESCRIPTION": rng.choice(["timeout", "declined"]),
        "FAILURE_CATEGORY": "X",
        "FAILURE_CODE": rng.choice(["INSUFF_FLOAT", "TIMEOUT"]),
    }
    for _ in range(800)
]

OPS = {
    "r01": lambda t, d: reports.monthly_product_performance(t, AS_OF, None, months=12),
    "r03": lambda t, d: reports.failure_spikes(t, AS_OF, window_days=200, recent_days=60),
    "r04": lambda t, d: reports.agent_scorecard(t, d["agents"], AS_OF, "A", months=6),
    "r05": lambda t, d: reports.corridor_analysis(t, AS_OF, "B", months=6),
    "r06": lambda t, d: reports.rolling_success_rate(t, AS_OF),
    "r07": lambda t, d: reports.segment_revenue(t, d["customers"], AS_OF, months=6),
    "r08": lambda t, d: reports.channel_product_matrix(t, AS_OF),
    "r09": lambda t, d: cohort.cohort_retention(t, cohort_months=None),
    "p1": lambda t, d: stats.zscore_anomalies(t, threshold=0.5),
    "p3": lambda t, d: rfm.rfm_scores(rfm.rfm_features(t, d["customers"], AS_OF, days=400)),
    "p4": lambda t, d: stats.linear_forecast(t, AS_OF),
    "m10": lambda t, d: measures.prior_period_measures(measures.monthly_measures(t, ["PRODUCT"]), ["PRODUCT"]),
    "m27": lambda t, d: measures.rolling_measures(measures.monthly_measures(t, ["PRODUCT"]), ["PRODUCT"]),
    "x9": lambda t, d: worksheet.ytd_running_total(t, AS_OF, "S1"),
}


@pytest.fixture(scope="module")
def data(spark):
    from tests.conftest import _DEFAULTS, _coerce

    names = schemas.TRANSACTIONS.fieldNames()
    t = spark.createDataFrame([tuple(_coerce(k, {**_DEFAULTS, **r}[k]) for k in names) for r in ROWS], schemas.TRANSACTIONS)
    agents = spark.createDataFrame(
        [("AG1", "a", "GOLD", "R1", "K1", 0), ("AG2", "b", "BASIC", "R1", "K2", 5000), ("AG3", "c", "BASIC", "R2", "K3", 10)],
        schemas.AGENTS,
    )
    customers = spark.createDataFrame([(i, ["RETAIL", "SME"][i % 2], "S1") for i in range(60)], schemas.CUSTOMERS)
    return t, {"agents": agents, "customers": customers}


def _rows(df):
    def key(r):
        return tuple((v is None, str(v)) for v in r)

    return sorted((tuple(r) for r in df.collect()), key=key)


@pytest.mark.parametrize("name", sorted(OPS))
def test_independent_of_order_and_partitions(spark, data, name):
    t, dims = data
    a = _rows(OPS[name](t, dims))
    assert a, f"{name} produced no rows on the property frame"
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        b = _rows(OPS[name](t.repartition(7).sortWithinPartitions("CUSTOMER_ID"), dims))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b
