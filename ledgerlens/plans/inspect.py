"""Plan inspection helpers: what a reviewer checks with ``explain``."""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas")


def physical_plan(df: DataFrame, mode: str = "formatted") -> str:
    """The text ``df.explain(mode)`` prints."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def fact_scans(df: DataFrame, table: str = "transactions") -> int:
    """How often the plan reads the files of a table (subqueries included, reused exchanges not counted)."""
    scans = re.findall(r"\(\d+\) Scan parquet[^\n]*\n(?:[^\n]+\n)*?Location: [^\n]*", physical_plan(df))
    return sum(f"/{table}" in s.rsplit("Location:", 1)[1] for s in scans)
