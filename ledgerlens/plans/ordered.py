"""Order-dependent computations that stay distributed.

A global rank or quantile written as ``row_number().over(Window.orderBy(x))`` or
``percentile(x)`` moves every row (or every distinct value) into one task.
Here the data is range-partitioned on the sort key instead; each task sums its
rows locally, and the per-partition totals -- one row per partition and group --
give each partition its offset. Range partitioning keeps equal keys together,
so the key must be total (rows) or pre-aggregated to one row per key (values):
``exact_quantiles`` counts equal values first, ``ntile`` and ``running_sum``
take an order that ends with a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


_LOCAL_BITS = 33  # monotonically_increasing_id: partition index above bit 33


def _partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return num_partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def global_index(df: DataFrame, order_cols: list[str | Column], out: str = "_idx",
                 num_partitions: int | None = None) -> DataFrame:
    """Add ``out``: the 0-based position of each row in the total order ``order_cols``.

    Rows equal on every order column get consecutive positions in an
    unspecified order. The range-partitioned, locally sorted data is
    checkpointed to the session's checkpoint folder so partition numbering is
    fixed (AQE cannot re-coalesce it between the two reads, and a lost
    executor re-reads the checkpoint instead of recomputing a new numbering).
    """
    n = _partitions(df, num_partitions)
    ranged = (
        df.repartitionByRange(n, *order_cols)
        .sortWithinPartitions(*order_cols)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_pid", F.shiftright(F.col("_mid"), _LOCAL_BITS))
        .withColumn("_local", F.col("_mid").bitwiseAND((1 << _LOCAL_BITS) - 1))
        .drop("_mid")
        .checkpoint(eager=True)
    )
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: an unpartitioned window over it is bounded by n
    offsets = counts.select(
        "_pid",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_off"),
    )
    # offsets has one row per partition (bounded by n): a proven-small broadcast
    return (
        ranged.join(F.broadcast(offsets), "_pid")
        .withColumn(out, F.col("_local") + F.col("_off"))
        .drop("_pid", "_local", "_off")
    )


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], num_partitions: int | None = None) -> DataFrame:
    """Linear-interpolated quantiles (numpy/pandas default, SQL ``quantile_cont``) computed distributed.

    All columns are handled in one pass: values are stacked as (column id,
    value) and counted per distinct value first, with map-side combine, so a
    value that most rows share is one row. A running count over the distinct
    values then gives the range of positions each one fills, and the order
    statistics around a quantile's position are the values whose range holds
    them; nothing is collected. Returns ``(column, q, value)`` rows; NULL values
    are ignored.
    """
    stacked = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("_f"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(cols)])
        ).alias("_s")
    ).select("_s._f", "_s._v")
    counted = stacked.filter(F.col("_v").isNotNull()).groupBy("_f", "_v").agg(F.count(F.lit(1)).alias("_c"))
    scan = _prefix_scan(counted, "_c", ["_f"], ["_v"], num_partitions)
    upto = F.col("_local") + F.col("_off")
    ranks = scan.select("_f", "_v", (upto - F.col("_c")).alias("_from"), upto.alias("_to"), F.col("_gtotal").alias("_n"))
    # the positions wanted are a short literal array, so each distinct value picks its own
    wanted = F.array(*[
        F.struct(
            F.lit(float(p)).alias("q"),
            ((F.col("_n") - 1).cast("double") * F.lit(float(p))).alias("h"),
        )
        for p in probs
    ])
    def holds(position: Column) -> Column:
        return (position >= F.col("_from")) & (position < F.col("_to"))

    picked = ranks.select("_f", "_v", "_from", "_to", F.explode(wanted).alias("w")).filter(
        holds(F.floor("w.h")) | holds(F.ceil("w.h"))
    )
    h = F.col("w.h")
    ends = picked.groupBy("_f", F.col("w.q").alias("q")).agg(
        F.max(F.when(holds(F.floor(h)), F.col("_v"))).alias("_vlo"),
        F.max(F.when(holds(F.ceil(h)), F.col("_v"))).alias("_vhi"),
        F.max(h - F.floor(h)).alias("_frac"),
    )
    names = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("_f") + 1)
    return ends.select(
        names.alias("column"), "q", (F.col("_vlo") + F.col("_frac") * (F.col("_vhi") - F.col("_vlo"))).alias("value")
    )


def quantile_key(column: str, p: float) -> Column:
    return F.concat_ws(":", F.lit(column), F.lit(float(p)).cast("string"))


def quantile_map(df: DataFrame, cols: list[str], probs: list[float]) -> Column:
    """All quantiles of ``exact_quantiles`` as one scalar subquery: a map keyed ``column:q``.

    Bind it once with ``withColumn`` and look thresholds up with
    ``element_at(col, quantile_key(column, p))`` so the subquery runs once.
    """
    q = exact_quantiles(df, cols, probs)
    key = F.concat_ws(":", F.col("column"), F.col("q").cast("string"))
    return q.agg(F.map_from_entries(F.collect_list(F.struct(key, F.col("value"))))).scalar()


def _prefix_scan(df: DataFrame, value: str, group_cols: list[str], order_cols: list[str | Column],
                 num_partitions: int | None) -> DataFrame:
    """Rows of ``df`` with ``_local`` (running sum of ``value`` inside their range partition and
    group), ``_off`` (sum of the group's rows in earlier partitions) and ``_gtotal`` (group total).

    Range partitioning on (group, order) lets a group holding a third of all
    rows span many tasks. The partitioned data is checkpointed so partition
    numbers are fixed. The offsets table has one row per (partition, group)
    pair present -- at most partitions + groups rows -- and is broadcast only
    after a size check.
    """
    from ledgerlens.plans.joins import broadcast_if_small

    n = _partitions(df, num_partitions)
    keys = [*group_cols, *order_cols]
    ranged = (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_pid", F.spark_partition_id())
        .checkpoint(eager=True)
    )
    local_w = Window.partitionBy("_pid", *group_cols).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("_local", F.sum(value).over(local_w))
    totals = ranged.groupBy("_pid", *group_cols).agg(F.sum(value).alias("_t"))
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("_pid").alias("_opid"),
        *[F.col(g).alias(f"_og_{g}") for g in group_cols],
        F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"),
        F.sum("_t").over(Window.partitionBy(*group_cols)).alias("_gtotal"),
    )
    cond = F.col("_pid") == F.col("_opid")
    for g in group_cols:  # NULL is a group of its own, as in a window partition
        cond = cond & F.col(g).eqNullSafe(F.col(f"_og_{g}"))
    return local.join(broadcast_if_small(offsets), cond).drop("_pid", "_opid", *[f"_og_{g}" for g in group_cols])


def running_sum(df: DataFrame, value: str, group_cols: list[str], order_cols: list[str | Column], out: str,
                num_partitions: int | None = None) -> DataFrame:
    """Running sum of ``value`` within each group in ``order_cols`` order, without per-group tasks.

    Rows equal on every order column are summed in an unspecified order (their
    output rows are then interchangeable only if the rows themselves are).
    """
    scan = _prefix_scan(df, value, group_cols, order_cols, num_partitions)
    return scan.withColumn(out, F.col("_local") + F.col("_off")).drop("_local", "_off", "_gtotal")


def ntile(df: DataFrame, buckets: int, group_cols: list[str], order_cols: list[str | Column], out: str,
          num_partitions: int | None = None) -> DataFrame:
    """``NTILE(buckets) OVER (PARTITION BY group ORDER BY order_cols)`` without one task per group.

    The position is a distributed running count and the group size comes from
    the same scan. As in SQL, the first ``n mod buckets`` buckets hold one row
    more than the others. Give ``order_cols`` a total order (end with a key).
    """
    scan = _prefix_scan(df.withColumn("_one", F.lit(1)), "_one", group_cols, order_cols, num_partitions)
    p, n = F.col("_local") + F.col("_off"), F.col("_gtotal")
    q = F.floor(n / F.lit(buckets))
    r = n - q * F.lit(buckets)
    big = r * (q + 1)
    bucket = F.when(p <= big, F.floor((p - 1) / (q + 1)) + 1).otherwise(r + F.floor((p - 1 - big) / q) + 1)
    return scan.withColumn(out, bucket.cast("int")).drop("_one", "_local", "_off", "_gtotal")
