"""A star over growing files: a change of some files rewrites the months they touch, nothing else.

A manifest says which source file holds which months of the fact. ``refresh`` lists the files (names, lengths, times; no
content), reads only new or changed ones for the months in them, and writes those months anew, together with the months of
files that changed or went: from the files that hold them, by the manifest. All other months stay the folders they are, and
so do their rollups, bitmaps and the customer history, which are kept month by month too.

A version is a list of month folders, published by a log entry after its folders are complete (as in ``sources.history``):
nothing half-written is read, older versions stay readable, and of two refreshes at once the second fails and is run again.
The fact is a table whose partitions lie where their month was last written, so reports prune months as ever. Dimensions
are small beside the fact and are read from their files. A row without a date is in no month and is left out, as in every
month of a report; ``undated`` counts such rows of the files read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions import kpi
from ledgerlens.sources import schemas
from ledgerlens.sources.history import CustomerHistory, members_of
from ledgerlens.sources.star import Star, conform, read_files

D = "TRANSACTION_DATE"
MANIFEST = "file string, length long, modified timestamp, month string"


@dataclass
class Version:
    """Month -> folder of the fact, kept table -> month -> folder, and the manifest's folder."""

    number: int = 0
    months: dict[str, str] = field(default_factory=dict)
    tables: dict[str, dict[str, str]] = field(default_factory=dict)
    manifest: str | None = None
    undated: int = 0


class TrackedStar:
    def __init__(self, spark: SparkSession, base: str, keep: str, fmt: str = "parquet", absent: tuple[str, ...] = (), bad: str = "fail"):
        self.spark, self.base, self.keep, self.fmt = spark, base.rstrip("/"), keep.rstrip("/"), fmt
        self.absent, self.bad = absent, bad

    # -- versions
    def version(self) -> Version:
        try:
            log = self.spark.read.schema("value string").option("recursiveFileLookup", "true").text(f"{self.keep}/log")
        except AnalysisException:  # nothing published yet
            return Version()
        line = log.agg(F.max_by("value", F.get_json_object("value", "$.number").cast("long"))).first()[0]
        return Version(**json.loads(line)) if line else Version()

    def _publish(self, v: Version) -> Version:
        v.number += 1
        self.spark.createDataFrame([(json.dumps(v.__dict__),)], "value string").coalesce(1).write.mode("error").text(f"{self.keep}/log/{v.number:08d}")
        return v

    # -- the source files
    def _place(self) -> str:
        return f"{self.base}/transactions" + (".csv" if self.fmt == "csv" else "")

    def _files(self) -> DataFrame:
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self._place())
        return listed.select(F.col("path").alias("file"), "length", F.col("modificationTime").alias("modified")).filter(~F.element_at(F.split("file", "/"), -1).rlike("^[._]"))

    def manifest(self, v: Version | None = None) -> DataFrame:
        """(file, length, modified, month): a row for each month of each file; month NULL for a file without dates."""
        v = v or self.version()
        return self.spark.read.schema(MANIFEST).parquet(v.manifest) if v.manifest else self.spark.createDataFrame([], MANIFEST)

    def _rows(self, files: list[str]) -> DataFrame:
        """The typed rows of some files, with ``file`` and ``TXN_MONTH``."""
        if self.fmt == "csv":
            raw = self.spark.read.option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(files)
        else:
            raw = self.spark.read.format(self.fmt).load(files)
        raw = raw.withColumn("_file", F.col("_metadata.file_path"))
        schema = T.StructType([*schemas.TRANSACTIONS.fields, T.StructField("_file", T.StringType())])
        return conform(raw, schema, "transactions", self.absent, self.bad).withColumn("TXN_MONTH", kpi.month_key(D))

    # -- refresh
    def refresh(self) -> tuple[Version, list[str]]:
        """Bring the kept fact up to date; returns the version and the months written or removed."""
        old = self.version()
        before = self.manifest(old)
        known = before.select("file", "length", "modified").distinct()
        now = self._files()
        # names of files that changed: as many as the change, not as the fact, is large
        fresh = members_of(now.join(known, ["file", "length", "modified"], "left_anti").select("file"))
        gone = before.join(now, ["file", "length", "modified"], "left_anti")
        touched = set(members_of(gone.select("month")))
        if not fresh and gone.isEmpty():
            return old, []
        new = Version(old.number, dict(old.months), dict(old.tables))
        place = f"{self.keep}/v-{uuid.uuid4().hex}"
        kept = before.join(now, ["file", "length", "modified"], "left_semi").select(*before.columns)
        if fresh:
            held = self._rows(fresh).groupBy(F.col("_file").alias("file"), F.col("TXN_MONTH").alias("month")).agg(F.count("*").alias("rows"))
            held.write.parquet(f"{place}/held")
            held = self.spark.read.schema("file string, month string, rows long").parquet(f"{place}/held")
            touched |= set(members_of(held.select("month")))
            new.undated = held.filter("month is null").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
            same = now.join(self.spark.createDataFrame([(f,) for f in fresh], "file string"), "file")
            found = same.withColumn("_key", self._key("file")).join(held.select(self._key("file").alias("_key"), "month"), "_key", "left")
            kept = kept.unionByName(found.select("file", "length", "modified", "month"))
        new.manifest = f"{place}/manifest"
        kept.write.parquet(new.manifest)
        months = sorted(touched)
        sources = members_of(self.manifest(new).filter(F.col("month").isin(months)).select("file"))
        written: set[str] = set()
        if months and sources:
            rows = self._rows(sources).drop("_file").filter(F.col("TXN_MONTH").isin(months))
            rows.hint("rebalance", "TXN_MONTH").sortWithinPartitions("TXN_MONTH", D).write.partitionBy("TXN_MONTH").parquet(f"{place}/transactions")
            there = self.spark.read.schema(f"{D} timestamp, TXN_MONTH string").parquet(f"{place}/transactions")
            written = set(members_of(there.select("TXN_MONTH")))
        for m in months:
            new.months.pop(m, None)
            for name in new.tables:
                new.tables[name] = {k: p for k, p in new.tables[name].items() if k != m}
        new.months |= {m: f"{place}/transactions/TXN_MONTH={m}" for m in written}
        return self._publish(new), months

    @staticmethod
    def _key(column: str):
        """A file's name without its scheme, which listings and readers spell in different ways."""
        return F.regexp_replace(F.url_decode(F.regexp_replace(column, r"\+", "%2B")), "^file:/+", "/")

    # -- reading
    def star(self, v: Version | None = None) -> Star:
        """The star of a version; its fact is a table partitioned by month."""
        v = v or self.version()
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schemas.TRANSACTIONS.fields)
        name = f"ledgerlens_fact_{uuid.uuid5(uuid.NAMESPACE_URL, self.keep).hex}_{v.number}"
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} ({fields}, TXN_MONTH string) USING parquet PARTITIONED BY (TXN_MONTH) LOCATION '{self.keep}/none-{v.number}'")
            if v.months:
                parts = " ".join(f"PARTITION (TXN_MONTH = '{m}') LOCATION '{p}'" for m, p in sorted(v.months.items()))
                self.spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {parts}")

        def dimension(table: str) -> DataFrame:
            return conform(read_files(self.spark, self.base, table, self.fmt), schemas.TABLES[table], table, self.absent, self.bad)

        return Star(self.spark.table(name), *(dimension(t) for t in ("agents", "customers", "kpi_targets", "forex_rates")))

    def table(self, name: str, define: Callable[[DataFrame], DataFrame], month: str = "month") -> DataFrame:
        """A table derived month by month (a rollup, bitmaps); only months without it are computed, from their rows.

        ``define`` must give each month's rows from that month's transactions alone; ``month`` is its DATE or ``yyyy-MM`` column.
        """
        v = self.version()
        fact = self.star(v).transactions
        made = define(fact)
        lacking = sorted(set(v.months) - set(v.tables.get(name, {})))
        if lacking:
            place = f"{self.keep}/t-{uuid.uuid4().hex}"
            own = define(fact.filter(F.col("TXN_MONTH").isin(lacking)))
            key = F.date_format(month, "yyyy-MM") if dict(own.dtypes)[month] == "date" else F.col(month)
            own.withColumn("_month", key).hint("rebalance", "_month").write.partitionBy("_month").parquet(place)
            v.tables[name] = v.tables.get(name, {}) | {m: f"{place}/_month={m}" for m in lacking}
            v = self._publish(v)
        places = [p for m, p in sorted(v.tables.get(name, {}).items()) if m in v.months]
        return self.spark.read.schema(made.schema).parquet(*places) if places else self.spark.createDataFrame([], made.schema)

    def history(self, months: list[str]) -> CustomerHistory:
        """The customer history, brought up to date with the months a refresh has touched."""
        history = CustomerHistory(self.spark, f"{self.keep}/customer-history")
        fact = self.star().transactions
        history.refresh(fact, sorted(set(months) | (set(self.version().months) - set(history.state().months))))
        return history
