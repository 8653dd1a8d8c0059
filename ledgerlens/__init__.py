"""ledgerlens: payment-performance report operators on Spark DataFrames.

Every operator is a pure function ``(DataFrames, as_of, params) -> DataFrame``
built from Spark SQL expressions, joins, aggregates and windows, so Catalyst
plans it and the work is distributed across executors.
"""

from ledgerlens.params import ReportParams

__all__ = ["ReportParams"]
