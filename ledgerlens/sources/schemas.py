"""Explicit schemas for the star: one fact table and its dimensions.

The reports never infer a schema; CSV or JDBC inputs are read with these types.
"""

from pyspark.sql import types as T

TRANSACTIONS = T.StructType(
    [
        T.StructField("TRANSACTION_DATE", T.TimestampNTZType()),
        T.StructField("PRODUCT", T.StringType()),
        T.StructField("PRODUCT_CATEGORY", T.StringType()),
        T.StructField("SUBSIDIARY", T.StringType()),
        T.StructField("COUNTRY", T.StringType()),
        T.StructField("CURRENCY", T.StringType()),
        T.StructField("CHANNEL", T.StringType()),
        T.StructField("CHANNEL_TYPE", T.StringType()),
        T.StructField("STATUS", T.StringType()),
        T.StructField("CUSTOMER_ID", T.LongType()),
        T.StructField("AGENT_ID", T.StringType()),
        T.StructField("SOURCE_COUNTRY", T.StringType()),
        T.StructField("DEST_COUNTRY", T.StringType()),
        T.StructField("TXN_AMOUNT_LOCAL", T.DecimalType(18, 2)),
        T.StructField("TXN_AMOUNT_USD", T.DecimalType(18, 4)),
        T.StructField("FEE_AMOUNT_LOCAL", T.DecimalType(18, 4)),
        T.StructField("PROCESSING_TIME_SECS", T.IntegerType()),
        T.StructField("FAILURE_CODE", T.StringType()),
        T.StructField("FAILURE_DESCRIPTION", T.StringType()),
        T.StructField("FAILURE_CATEGORY", T.StringType()),
    ]
)

KPI_TARGETS = T.StructType(
    [
        T.StructField("PRODUCT", T.StringType()),
        T.StructField("SUBSIDIARY_NAME", T.StringType()),
        T.StructField("TARGET_MONTH", T.DateType()),
        T.StructField("TARGET_VOLUME", T.LongType()),
        T.StructField("TARGET_VALUE_USD", T.DecimalType(18, 2)),
        T.StructField("TARGET_SUCCESS_RATE", T.DecimalType(5, 2)),
        T.StructField("TARGET_ACTIVE_CUSTOMERS", T.LongType()),
    ]
)

AGENTS = T.StructType(
    [
        T.StructField("AGENT_ID", T.StringType()),
        T.StructField("AGENT_NAME", T.StringType()),
        T.StructField("AGENT_TIER", T.StringType()),
        T.StructField("REGION", T.StringType()),
        T.StructField("COUNTY", T.StringType()),
        T.StructField("FLOAT_LIMIT_KES", T.LongType()),
    ]
)

CUSTOMERS = T.StructType(
    [
        T.StructField("CUSTOMER_ID", T.LongType()),
        T.StructField("SEGMENT", T.StringType()),
        T.StructField("SUBSIDIARY_NAME", T.StringType()),
    ]
)

FOREX_RATES = T.StructType(
    [
        T.StructField("SUBSIDIARY_NAME", T.StringType()),
        T.StructField("RATE_MONTH", T.DateType()),
        T.StructField("USD_RATE", T.DecimalType(18, 6)),
    ]
)

TABLES = {
    "transactions": TRANSACTIONS,
    "kpi_targets": KPI_TARGETS,
    "agents": AGENTS,
    "customers": CUSTOMERS,
    "forex_rates": FOREX_RATES,
}
