from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from ledgerlens.session import configure  # noqa: E402
from ledgerlens.sources import schemas  # noqa: E402


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    s = (
        SparkSession.builder.master("local[4]")
        .appName("ledgerlens-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    configure(s)
    yield s


_DEFAULTS = dict(
    TRANSACTION_DATE=dt.datetime(2024, 5, 15, 12, 0),
    PRODUCT="P1",
    PRODUCT_CATEGORY="CORE",
    SUBSIDIARY="S1",
    COUNTRY="C1",
    CURRENCY="CUR",
    CHANNEL="CH1",
    CHANNEL_TYPE="DIGITAL",
    STATUS="SUCCESS",
    CUSTOMER_ID=1,
    AGENT_ID=None,
    SOURCE_COUNTRY="A",
    DEST_COUNTRY="B",
    TXN_AMOUNT_LOCAL=Decimal("100.00"),
    TXN_AMOUNT_USD=Decimal("1.0000"),
    FEE_AMOUNT_LOCAL=Decimal("1.0000"),
    PROCESSING_TIME_SECS=60,
    FAILURE_CODE=None,
    FAILURE_DESCRIPTION=None,
    FAILURE_CATEGORY=None,
)


def _coerce(k, v):
    if k == "TRANSACTION_DATE" and isinstance(v, dt.date) and not isinstance(v, dt.datetime):
        return dt.datetime(v.year, v.month, v.day)
    if k in ("TXN_AMOUNT_LOCAL", "TXN_AMOUNT_USD", "FEE_AMOUNT_LOCAL") and v is not None and not isinstance(v, Decimal):
        return Decimal(str(v))
    return v


@pytest.fixture
def txns(spark):
    """Build a transactions frame from partial rows (other columns take defaults)."""

    def make(rows: list[dict]):
        names = schemas.TRANSACTIONS.fieldNames()
        data = [tuple(_coerce(k, {**_DEFAULTS, **r}[k]) for k in names) for r in rows]
        return spark.createDataFrame(data, schemas.TRANSACTIONS)

    return make


@pytest.fixture
def frame(spark):
    def make(rows: list[tuple], schema):
        return spark.createDataFrame(rows, schema)

    return make
