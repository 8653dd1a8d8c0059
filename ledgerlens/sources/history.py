"""Customer history as state: first months and months of activity, merged month by month.

Cohorts and new customers depend on a customer's first month, so computed from the transactions each run reads all of
history. Kept here instead, under one folder:

* ``activity``: one row per customer and month (did any transaction succeed?), a table for each month read;
* ``first_seen``: one row per customer (first month, first successful month), bucketed by customer, so that a merge
  shuffles the new months' customers only and the state keeps its place;
* ``retention`` (cohort, month, customers) and ``arrivals`` (month, new customers): what the reports read, a few rows.

``refresh`` reads the months it is given and the state. Months may come in any order and again: a month read for the first
time can only move first months back, so it is merged; a month read again may have lost customers, so first months are
then taken anew from ``activity``, still without the other months' transactions. Counts of later months are taken anew
from ``activity`` where earlier months changed; a month after all others adds rows and changes none.

Every refresh writes a version of its own and names it in ``log`` last: a failed one leaves nothing that is read, and of
two at once the second fails on the log entry and is run again. Unchanged tables are named by the new version, not copied.
A customer NULL is a customer for ``arrivals`` (blank is a member) and none for cohorts.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import kpi

D = "TRANSACTION_DATE"
BUCKETS = 64
ACTIVITY = "month date, CUSTOMER_ID bigint, succeeded boolean"
FIRST = "CUSTOMER_ID bigint, first_month date, first_success date"
RETENTION = "cohort_month date, month date, retained bigint"
ARRIVALS = "month date, new_customers bigint"


def members_of(column: DataFrame) -> list[str]:
    """The values of a table's only column in order, as one row: for months and the like, which are few."""
    return column.agg(F.sort_array(F.collect_set(column.columns[0]))).first()[0]


def activity_of(txns: DataFrame) -> DataFrame:
    """(month, CUSTOMER_ID, succeeded): one row per customer and month."""
    return txns.groupBy(kpi.month_date(D).alias("month"), "CUSTOMER_ID").agg(F.max(kpi.status_is(kpi.SUCCESS)).alias("_s")).select(
        "month", "CUSTOMER_ID", F.coalesce("_s", F.lit(False)).alias("succeeded")
    )


def first_of(activity: DataFrame) -> DataFrame:
    """(CUSTOMER_ID, first_month, first_success) of activity rows; a customer NULL has none."""
    return activity.filter(F.col("CUSTOMER_ID").isNotNull()).groupBy("CUSTOMER_ID").agg(
        F.min("month").alias("first_month"), F.min(F.when(F.col("succeeded"), F.col("month"))).alias("first_success")
    )


@dataclass
class State:
    """One version: which table holds what."""

    months: dict[str, str] = field(default_factory=dict)  # yyyy-MM -> folder of its activity
    first: str | None = None
    retention: list[str] = field(default_factory=list)
    arrivals: list[str] = field(default_factory=list)
    blank_since: str | None = None  # first month with a customer NULL


class CustomerHistory:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # -- versions
    def _newest(self) -> tuple[int, State]:
        """Number and state of the newest entry (0 and an empty one before the first): a line with a folder name per month."""
        try:
            log = self.spark.read.schema("value string").option("recursiveFileLookup", "true").text(f"{self.path}/log")
        except AnalysisException:  # nothing published yet
            return 0, State()
        line = log.agg(F.max_by("value", F.get_json_object("value", "$.number").cast("long"))).first()[0]
        if line is None:
            return 0, State()
        entry = json.loads(line)
        return entry["number"], State(**entry["state"])

    def state(self) -> State:
        return self._newest()[1]

    def _publish(self, state: State, number: int) -> None:
        entry = json.dumps({"number": number, "state": state.__dict__})
        self.spark.createDataFrame([(entry,)], "value string").coalesce(1).write.mode("error").text(f"{self.path}/log/{number:08d}")

    # -- tables
    def activity(self, state: State | None = None, months: list[str] | None = None) -> DataFrame:
        state = state or self.state()
        places = [state.months[m] for m in sorted(state.months) if months is None or m in months]
        return self.spark.read.schema(ACTIVITY).parquet(*places) if places else self.spark.createDataFrame([], ACTIVITY)

    def first_seen(self, state: State | None = None) -> DataFrame:
        state = state or self.state()
        if state.first is None:
            return self.spark.createDataFrame([], FIRST)
        table = "ledgerlens_first_seen_" + state.first.rstrip("/").split("/")[-2].replace("-", "_")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({FIRST}) USING parquet CLUSTERED BY (CUSTOMER_ID) SORTED BY (CUSTOMER_ID) "
            f"INTO {self.buckets} BUCKETS LOCATION '{state.first}'"
        )
        return self.spark.table(table)

    def retention(self) -> DataFrame:
        """(cohort_month, month, retained): customers of a cohort with a success in a month."""
        places = self.state().retention
        return self.spark.read.schema(RETENTION).parquet(*places) if places else self.spark.createDataFrame([], RETENTION)

    def arrivals(self) -> DataFrame:
        """(month, new_customers): customers whose first transaction is in the month."""
        places = self.state().arrivals
        return self.spark.read.schema(ARRIVALS).parquet(*places) if places else self.spark.createDataFrame([], ARRIVALS)

    # -- refresh
    def refresh(self, txns: DataFrame, months: list[str] | None = None) -> State:
        """Read the given months (``yyyy-MM``) of the transactions, by default those of the fact that the state lacks."""
        number, old = self._newest()
        month = F.col("TXN_MONTH") if "TXN_MONTH" in txns.columns else kpi.month_key(D)
        if months is None:
            months = [m for m in members_of(txns.select(month.alias("m"))) if m not in old.months]
        months = sorted(set(months))
        if not months:
            return old
        version = f"{self.path}/v-{uuid.uuid4().hex}"
        rows = activity_of(txns.filter(month.isin(*months)))
        rows.withColumn("_month", F.date_format("month", "yyyy-MM")).repartition("_month", F.pmod(F.xxhash64("CUSTOMER_ID"), F.lit(16))).write.partitionBy("_month").parquet(f"{version}/activity")
        written = set(members_of(self.spark.read.schema(f"{ACTIVITY}, _month string").parquet(f"{version}/activity").select("_month")))
        new = State(months={**{m: p for m, p in old.months.items() if m not in months}, **{m: f"{version}/activity/_month={m}" for m in months if m in written}})
        again = [m for m in months if m in old.months]
        later = not again and (not old.months or months[0] > max(old.months))
        self._write_first(old, new, [m for m in months if m in written], again, version)
        self._write_counts(old, new, [m for m in months if m in written] if later else sorted(new.months), later, version)
        self._publish(new, number + 1)
        return new

    def _write_first(self, old: State, new: State, months: list[str], again: list[str], version: str) -> None:
        blank = self.activity(new, None if again else months).filter(F.col("CUSTOMER_ID").isNull()).agg(F.date_format(F.min("month"), "yyyy-MM")).first()[0]
        new.blank_since = blank if again or old.blank_since is None else min(x for x in (blank, old.blank_since) if x)
        merged = first_of(self.activity(new, None if again else months))
        if old.first is not None and not again:
            came = merged.select(F.col("CUSTOMER_ID").alias("_id"), F.col("first_month").alias("_m"), F.col("first_success").alias("_s"))
            merged = self.first_seen(old).join(came, F.col("CUSTOMER_ID") == F.col("_id"), "full").select(
                F.coalesce("CUSTOMER_ID", "_id").alias("CUSTOMER_ID"), F.least("first_month", "_m").alias("first_month"), F.least("first_success", "_s").alias("first_success")
            )
        new.first = f"{version}/first"
        name = "ledgerlens_first_seen_" + version.split("/")[-1].replace("-", "_")
        # one file per bucket: rows are dealt as the buckets are
        dealt = merged.repartition(self.buckets, "CUSTOMER_ID")
        dealt.write.format("parquet").option("path", new.first).bucketBy(self.buckets, "CUSTOMER_ID").sortBy("CUSTOMER_ID").saveAsTable(name)

    def _write_counts(self, old: State, new: State, months: list[str], later: bool, version: str) -> None:
        """Counts of the given months; with ``later`` the others' stay as they are."""
        active = self.activity(new, months).filter(F.col("succeeded") & F.col("CUSTOMER_ID").isNotNull()).select(F.col("CUSTOMER_ID").alias("_id"), "month")
        first = self.first_seen(new)
        kept = active.join(first, F.col("_id") == F.col("CUSTOMER_ID")).groupBy(F.col("first_success").alias("cohort_month"), "month").agg(F.count("*").alias("retained"))
        kept.write.parquet(f"{version}/retention")
        came = first.filter(F.date_format("first_month", "yyyy-MM").isin(*months)).select(F.col("first_month").alias("month"))
        if new.blank_since in months:
            came = came.unionByName(self.spark.range(1).select(F.to_date(F.lit(f"{new.blank_since}-01")).alias("month")))
        came.groupBy("month").agg(F.count("*").alias("new_customers")).write.parquet(f"{version}/arrivals")
        new.retention = (old.retention if later else []) + [f"{version}/retention"]
        new.arrivals = (old.arrivals if later else []) + [f"{version}/arrivals"]
