"""The command-line runner."""

from __future__ import annotations

import os

import pytest

from ledgerlens.__main__ import REPORTS, main

SF = "/root/testdata/sf0.001"


def test_list(capsys):
    assert main(["list"]) == 0
    out = capsys.readouterr().out
    assert all(k in out for k in REPORTS) and "pack" in out


@pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")
def test_report_and_pack_write(spark, tmp_path):
    assert main(["r10", "--tpch", SF, "--as-of", "2001-11-04", "--remit-product", "PROMO", "--out", str(tmp_path / "r10")]) == 0
    assert spark.read.parquet(str(tmp_path / "r10")).count() > 0
    assert main(["pack", "--tpch", SF, "--agency-product", "STANDARD", "--out", str(tmp_path / "pack"), "--format", "csv"]) == 0
    assert sorted(p.name for p in (tmp_path / "pack").iterdir()) == [
        "Agent_Scorecard", "Corridor_Performance", "Customer_Segments", "Failure_Summary", "Monthly_KPIs"
    ]
