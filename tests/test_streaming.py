"""The scheduled refresh: two runs over arriving files, each resuming from its checkpoint."""

from __future__ import annotations

import datetime as dt

from ledgerlens.operators import reports
from ledgerlens.plans.inspect import physical_plan
from ledgerlens.streaming.refresh import latest_report, read_fact, refresh_on_arrival

AS_OF = dt.date(2024, 6, 10)


def test_refresh_processes_new_files_once(spark, txns, tmp_path):
    landing, fact, out, ckpt = (str(tmp_path / n) for n in ("landing", "fact", "out", "ckpt"))
    fail = {"STATUS": "FAILED", "FAILURE_DESCRIPTION": "x", "FAILURE_CATEGORY": "c"}
    txns([{**fail, "TRANSACTION_DATE": dt.date(2024, 6, 8)}] * 2).write.parquet(f"{landing}/f1")

    def report(fact_df):
        return reports.failure_spikes(fact_df, AS_OF)

    q = refresh_on_arrival(spark, landing + "/*", fact, report, out, ckpt)
    q.awaitTermination(120)
    assert latest_report(spark, out).collect()[0].this_week == 2

    txns([{**fail, "TRANSACTION_DATE": dt.date(2024, 6, 9)}] * 3).write.parquet(f"{landing}/f2")
    q = refresh_on_arrival(spark, landing + "/*", fact, report, out, ckpt)
    q.awaitTermination(120)
    assert read_fact(spark, fact).count() == 5  # the first file is not ingested twice
    assert latest_report(spark, out).collect()[0].this_week == 5
    plan = physical_plan(reports.failure_spikes(read_fact(spark, fact), AS_OF))
    assert "TXN_MONTH" in plan.split("PartitionFilters: [")[1].split("]")[0]  # the refresh prunes old months

    # a new checkpoint starts its batches at 0 again: it adds, it does not replace
    txns([{**fail, "TRANSACTION_DATE": dt.date(2024, 6, 9)}] * 4).write.parquet(f"{tmp_path}/landing2/f3")
    q = refresh_on_arrival(spark, f"{tmp_path}/landing2/*", fact, report, out, str(tmp_path / "ckpt2"))
    q.awaitTermination(120)
    assert read_fact(spark, fact).count() == 9
    assert latest_report(spark, out).collect()[0].this_week == 9
