"""The report measures as expressions of the filter-context layer (``operators.context``).

Any of them can stand side by side at any grain and under any slicers, in one pass over the fact::

    evaluate(model_of(star), BASE | CUSTOMERS, by=["month", "SUBSIDIARY"], filters={"PRODUCT": ["A", "B"]})
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import kpi
from ledgerlens.operators import measures
from ledgerlens.operators.context import (
    MONTH, Measure, Model, among, clear, clear_but, distinct, divide, evaluate, formula, greatest, mean, new_members, only, or_blank, rank, rows, that, total, visible, where,
)

TARGETS = "kpi_targets"

TOTAL = rows()
SUCCESSFUL = rows().calculate(only("STATUS", kpi.SUCCESS))
FAILED = rows().calculate(only("STATUS", kpi.FAILED))
VALUE = total("TXN_AMOUNT_USD")
SUCCESS_RATE = divide(SUCCESSFUL, TOTAL, 0.0) * 100.0
CUSTOMERS = distinct("CUSTOMER_ID")

#: M01-M09
BASE: dict[str, Measure] = {
    "total_transactions": TOTAL,
    "successful_transactions": SUCCESSFUL,
    "failed_transactions": FAILED,
    "total_value_usd": VALUE,
    "total_fee_revenue_local": total("FEE_AMOUNT_LOCAL"),
    "avg_processing_time_mins": formula(lambda x: x / F.lit(60.0), mean("PROCESSING_TIME_SECS")),
    "unique_customers": CUSTOMERS,
    "success_rate_pct": SUCCESS_RATE,
    "failure_rate_pct": divide(FAILED, TOTAL, 0.0) * 100.0,
}

#: the month's target, and the best success rate ever set for the product and subsidiary
TARGET_VOLUME = total("TARGET_VOLUME", TARGETS).calculate(clear_but("PRODUCT", "SUBSIDIARY", MONTH))
TARGET_VALUE = total("TARGET_VALUE_USD", TARGETS).calculate(clear_but("PRODUCT", "SUBSIDIARY", MONTH))
TARGET_RATE = greatest("TARGET_SUCCESS_RATE", TARGETS).calculate(clear_but("PRODUCT", "SUBSIDIARY"))


def _bands(x: Column, green: Column, amber: Column) -> Column:
    return F.when(x >= green, "GREEN").when(x >= amber, "AMBER").otherwise("RED")


VOLUME_ATTAINMENT = divide(TOTAL, TARGET_VOLUME, 0.0) * 100.0
VOLUME_RAG = formula(lambda x: _bands(x, F.lit(95), F.lit(80)), VOLUME_ATTAINMENT)

#: M22-M26, at the grain month, PRODUCT, SUBSIDIARY
ATTAINMENT: dict[str, Measure] = {
    "total_transactions": or_blank(TOTAL),  # blank where there is only a target
    "total_value_usd": VALUE,
    "success_rate_pct": SUCCESS_RATE,
    "target_volume": TARGET_VOLUME,
    "target_value_usd": TARGET_VALUE,
    "target_success_rate": TARGET_RATE,
    "volume_attainment_pct": VOLUME_ATTAINMENT,
    "value_attainment_pct": divide(VALUE, TARGET_VALUE, 0.0) * 100.0,
    "volume_rag": VOLUME_RAG,
    "volume_rag_numeric": formula(lambda x: F.when(x == "GREEN", 1).when(x == "AMBER", 2).otherwise(3).cast("bigint"), VOLUME_RAG),
    "success_rate_rag": formula(
        lambda x, t: _bands(x, F.coalesce(t.cast("double"), F.lit(0.0)), F.coalesce(t.cast("double"), F.lit(0.0)) - F.lit(5.0)), SUCCESS_RATE, TARGET_RATE
    ),
}

#: M38 (a cell column is the month)
NEW_CUSTOMERS = or_blank(new_members("CUSTOMER_ID", MONTH))
#: M39
REVENUE_PER_CUSTOMER = divide(VALUE, CUSTOMERS, 0.0)
#: Among the selected members
PRODUCT_RANK = rank(TOTAL, "PRODUCT")
SUBSIDIARY_RANK = rank(VALUE, "SUBSIDIARY")


def active_agents(agency_product: str) -> Measure:
    """M33"""
    named = that("AGENT_ID IS NOT NULL AND AGENT_ID <> ''", "AGENT_ID")
    return distinct("AGENT_ID", blank=False).calculate(where(among("STATUS", kpi.SUCCESS), among("PRODUCT", agency_product), named))


def txns_per_active_agent(agency_product: str) -> Measure:
    """M34"""
    return divide(SUCCESSFUL, active_agents(agency_product), 0.0)


def cross_border(remit_product: str) -> Measure:
    """M36"""
    return VALUE.calculate(where(among("PRODUCT", remit_product), that("SOURCE_COUNTRY <> DEST_COUNTRY", "SOURCE_COUNTRY", "DEST_COUNTRY")))


def share(measure: Measure, *columns: str, of_all: bool = False) -> Measure:
    """Percent of the measure over the selected members of the columns, or over all members whatever is selected."""
    return divide(measure, measure.calculate(clear(*columns) if of_all else visible(*columns))) * 100.0


def growth(model: Model, by: list[str], filters: dict | None = None) -> DataFrame:
    """M10-M21 under slicers: prior months come from the same context (``by`` without the month)."""
    return measures.prior_period_measures(evaluate(model, BASE, [MONTH, *by], filters), by)
