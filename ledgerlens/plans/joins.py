"""Join helpers: broadcast only what is checked to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A broadcast side is shipped to every executor and held in memory there.
DEFAULT_MAX_BYTES = 32 << 20


def planned_bytes(df: DataFrame) -> int | None:
    """The optimizer's size estimate (file sizes carried through the plan; it errs upward), None where it has none."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:  # Spark Connect has no plan on this side
        return None


def broadcast_if_small(df: DataFrame, max_bytes: int = DEFAULT_MAX_BYTES) -> DataFrame:
    """``broadcast(df)`` when its estimated size is at most ``max_bytes``, else ``df`` unchanged.

    Nothing runs for the decision. Beyond the bound, or without an estimate, the
    join is left to the planner: a shuffle join, or AQE's own runtime broadcast
    when the side turns out small.
    """
    size = planned_bytes(df)
    return F.broadcast(df) if size is not None and size <= max_bytes else df
