"""Distributed ordering helpers agree with Spark's own window functions on random inputs."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.plans.ordered import ntile, running_sum

rows_strategy = st.lists(
    st.tuples(st.sampled_from(["a", "b", "hot", None]), st.integers(0, 9)), min_size=1, max_size=120
)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows_strategy, parts=st.integers(1, 9), buckets=st.integers(1, 6))
def test_ntile_and_running_sum_match_windows(spark, rows, parts, buckets):
    data = [(g, v, i) for i, (g, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "g string, v long, k long")
    order = [F.col("v").desc(), F.col("k").asc()]
    w = Window.partitionBy("g").orderBy(*order)
    want = {
        r.k: (r.t, r.s)
        for r in df.select(
            "k", F.ntile(buckets).over(w).alias("t"), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s")
        ).collect()
    }
    t = {r.k: r.t for r in ntile(df, buckets, ["g"], order, "t", num_partitions=parts).collect()}
    s = {r.k: r.s for r in running_sum(df, "v", ["g"], order, "s", num_partitions=parts).collect()}
    assert {k: (t[k], s[k]) for k in t} == want
