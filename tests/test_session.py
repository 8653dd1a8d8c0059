"""Session defaults: unset settings are filled in, set ones stay."""

from __future__ import annotations

from ledgerlens.session import SPLIT_BYTES, configure

SPLIT = "spark.sql.files.maxPartitionBytes"


def test_read_splits_are_bounded_where_unset(spark):
    other = spark.newSession()
    other.conf.unset(SPLIT)
    assert configure(other).conf.get(SPLIT) == SPLIT_BYTES


def test_given_read_splits_stay(spark):
    other = spark.newSession()
    other.conf.set(SPLIT, "64m")
    assert configure(other).conf.get(SPLIT) == "64m"
