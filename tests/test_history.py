"""Customer history merged month by month against the reports over all transactions."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import cohort, measures
from ledgerlens.plans.inspect import physical_plan
from ledgerlens.sources.history import CustomerHistory


def made(seed: int, months: list[int], customers: int = 30) -> list[dict]:
    rng = random.Random(seed)
    return [
        dict(TRANSACTION_DATE=dt.datetime(2024, m, rng.randint(1, 28)), CUSTOMER_ID=rng.choice([None, *range(customers)]), STATUS=rng.choice(["SUCCESS", "FAILED"]))
        for m in months for _ in range(25)
    ]


def same(history: CustomerHistory, txns) -> None:
    def rows(df):
        return sorted(tuple(r) for r in df.collect())

    assert rows(cohort.cohort_retention(None, cohort_months=None, kept=history.retention())) == rows(cohort.cohort_retention(txns, cohort_months=None))
    assert rows(cohort.cohort_grid(None, kept=history.retention())) == rows(cohort.cohort_grid(txns))
    assert rows(history.arrivals().select("month", "new_customers")) == rows(measures.new_customers(txns).select("month", "new_customers"))


def month(df, name: str):
    return df.filter(F.date_format("TRANSACTION_DATE", "yyyy-MM") == name)


def test_month_by_month_equals_all_at_once(spark, txns, tmp_path):
    t = txns(made(1, [1, 2, 3, 4, 6]))
    history = CustomerHistory(spark, str(tmp_path / "h"), buckets=4)
    for upto, new in (("2024-02", ["2024-01", "2024-02"]), ("2024-03", ["2024-03"]), ("2024-04", ["2024-04"]), ("2024-06", ["2024-06"])):
        before = history.state()
        after = history.refresh(t, new)
        assert set(after.months) - set(before.months) == set(new)
        assert before.retention == after.retention[:-1] and all(after.months[m] == p for m, p in before.months.items())
        same(history, t.filter(F.date_format("TRANSACTION_DATE", "yyyy-MM") <= upto))
    assert history.refresh(t).__dict__ == history.state().__dict__ == after.__dict__  # nothing is new


def test_months_in_any_order_and_again(spark, txns, tmp_path):
    rows = made(2, [1, 2, 3, 5])
    t = txns(rows)
    history = CustomerHistory(spark, str(tmp_path / "h"), buckets=4)
    seen = None
    for name in ("2024-03", "2024-05", "2024-01", "2024-02"):
        history.refresh(t, [name])
        seen = month(t, name) if seen is None else seen.unionByName(month(t, name))
        same(history, seen)
    # a month read again without some of its customers, and one that has lost all its rows
    fewer = txns([r for r in rows if r["TRANSACTION_DATE"].month != 1 or (r["CUSTOMER_ID"] or 0) % 2])
    history.refresh(fewer, ["2024-01"])
    same(history, fewer)
    without = month(fewer, "2024-01").unionByName(month(fewer, "2024-03")).unionByName(month(fewer, "2024-05"))
    history.refresh(without, ["2024-02"])
    assert "2024-02" not in history.state().months
    same(history, without)


def test_a_refresh_reads_its_months_and_the_state_only(spark, txns, tmp_path):
    t = txns(made(3, [1, 2, 3]))
    path = str(tmp_path / "fact")
    t.withColumn("TXN_MONTH", F.date_format("TRANSACTION_DATE", "yyyy-MM")).write.partitionBy("TXN_MONTH").parquet(path)
    fact = spark.read.parquet(path)
    history = CustomerHistory(spark, str(tmp_path / "h"), buckets=4)
    history.refresh(fact, ["2024-01", "2024-02"])
    # any other month's row would fail the job
    guard = F.when(F.col("TXN_MONTH") < "2024-03", F.raise_error(F.lit("an old month was read"))).otherwise(F.col("STATUS"))
    history.refresh(fact.withColumn("STATUS", guard), ["2024-03"])
    same(history, t)
    # the state keeps its place in the merge: only what comes to it is dealt out
    merge = history.first_seen().join(spark.range(100).withColumnRenamed("id", "_id"), F.col("CUSTOMER_ID") == F.col("_id"), "full")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = physical_plan(merge, "simple")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan


def test_another_session_reads_the_state(spark, txns, tmp_path):
    t = txns(made(4, [1, 2]))
    CustomerHistory(spark, str(tmp_path / "h"), buckets=4).refresh(t)
    spark.sql("show tables like 'ledgerlens_first_seen*'").collect()
    for r in spark.sql("show tables like 'ledgerlens_first_seen*'").collect():
        spark.sql(f"DROP TABLE {r.tableName}")  # external: the files stay
    other = CustomerHistory(spark, str(tmp_path / "h"), buckets=4)
    assert other.first_seen().count() == t.select("CUSTOMER_ID").distinct().where("CUSTOMER_ID is not null").count()
    same(other, t)


def test_unpublished_work_is_not_read_and_writers_do_not_overtake(spark, txns, tmp_path, monkeypatch):
    t = txns(made(5, [1, 2]))
    history = CustomerHistory(spark, str(tmp_path / "h"), buckets=4)
    history.refresh(t, ["2024-01"])
    with monkeypatch.context() as m:
        m.setattr(CustomerHistory, "_write_counts", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            history.refresh(t, ["2024-02"])
    assert set(history.state().months) == {"2024-01"}
    with pytest.raises(Exception, match="exist|EXIST"):
        history._publish(history.state(), 1)
    history.refresh(t)
    same(history, t)


def test_no_rows(spark, txns, tmp_path):
    history = CustomerHistory(spark, str(tmp_path / "h"))
    assert history.refresh(txns([])).months == {}
    assert history.retention().collect() == [] and history.arrivals().collect() == [] and history.first_seen().collect() == []
    history.refresh(txns([]), ["2024-01"])
    assert history.arrivals().collect() == []
