"""Scheduled report refresh as a Structured Streaming job.

The original failure-spike report "runs hourly": a batch query over the whole
fact table. Here new transaction files land in a folder; a file-source stream
picks up what arrived since the last run, appends it to the fact table, and
recomputes the report over the full table. ``trigger(availableNow=True)``
processes everything pending and stops, so an external scheduler runs it
hourly; the checkpoint makes each run resume where the last one ended.

Each micro-batch is written to its own ``run=<stream id>/batch=<id>`` folder
with overwrite: a batch retried after a failure replaces its own output, and a
stream started with a new checkpoint has a new id, so it never touches what an
earlier one wrote. Reports are written to a folder of their own per batch
(``version=<time>-<stream id>-<batch>``); ``latest_report`` reads the newest
complete one, so a reader never sees a report being replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ledgerlens.sources import schemas


def read_fact(spark: SparkSession, fact_path: str) -> DataFrame:
    """The accumulated fact table.

    ``run``, ``batch`` and ``TXN_MONTH`` are partition folders; the month column
    stays, so a report's date window prunes the months it does not need and each
    hourly refresh reads only its window, not the whole history.
    """
    return spark.read.parquet(fact_path).drop("run", "batch")


def latest_report(spark: SparkSession, out_path: str) -> DataFrame:
    """The newest report written under ``out_path``."""
    every = spark.read.parquet(out_path)
    return every.filter(F.col("version") == every.select(F.max("version")).scalar()).drop("version")


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """An id that lives and dies with the checkpoint folder (a small table inside it)."""
    from pyspark.errors import AnalysisException

    place = f"{checkpoint.rstrip('/')}/stream-id"
    try:
        return spark.read.schema("value string").text(place).first()["value"]
    except (AnalysisException, TypeError):  # no such folder yet, or an unfinished write
        new = uuid.uuid4().hex
        spark.createDataFrame([(new,)], "value string").write.mode("overwrite").text(place)
        return new


def refresh_on_arrival(
    spark: SparkSession,
    landing_path: str,
    fact_path: str,
    report: Callable[[DataFrame], DataFrame],
    out_path: str,
    checkpoint: str,
    schema: StructType = schemas.TRANSACTIONS,
    fmt: str = "parquet",
    available_now: bool = True,
    processing_time: str | None = None,
) -> StreamingQuery:
    """Start the ingest-and-refresh stream; returns the running query."""
    run = _stream_id(spark, checkpoint)
    stream = spark.readStream.schema(schema).format(fmt).load(landing_path)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn("TXN_MONTH", F.date_format("TRANSACTION_DATE", "yyyy-MM"))
            .write.mode("overwrite")
            .partitionBy("TXN_MONTH")
            .parquet(f"{fact_path}/run={run}/batch={batch_id}")
        )
        now = batch.sparkSession.sql("SELECT date_format(current_timestamp(), 'yyyyMMddHHmmssSSS') AS t").first()["t"]
        report(read_fact(spark, fact_path)).write.mode("overwrite").parquet(f"{out_path}/version={now}-{run}-{batch_id:09d}")

    w = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", f"{checkpoint.rstrip('/')}/state")
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()
