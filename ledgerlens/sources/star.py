"""The star the reports read, as a bundle of DataFrames.

``Star`` is what every operator consumes. ``star_from_tpch`` derives it from
the synthetic TPC-H-like tables used for tests and benches (mapping in
FIXTURES.md); ``star_from_files`` and ``star_from_catalog`` read a real star
(CSV/Parquet files or catalog tables) with the explicit schemas, and
``materialize`` writes the fact table partitioned by month so later reports
prune partitions and push date filters into the scan.
"""

from __future__ import annotations

import datetime as dt
import threading
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions import kpi
from ledgerlens.plans.joins import broadcast_if_small
from ledgerlens.sources import schemas


@dataclass(frozen=True)
class Star:
    transactions: DataFrame
    agents: DataFrame
    customers: DataFrame
    kpi_targets: DataFrame
    forex_rates: DataFrame
    folder: str | None = None  # where a materialised star lies; its rollups are kept there


# Fixed values of the synthetic mapping (FIXTURES.md section 2).
TRANSFER_PRODUCTS = ("PROMO", "SMALL")
DIGITAL_CHANNELS = ("1-URGENT", "2-HIGH")
AGENCY_PRODUCT = "STANDARD"
FAILURE_TEXT = {
    # code: (description, category)
    "INSUFF_FLOAT": ("Agent float insufficient", "LIQUIDITY"),
    "TIMEOUT": ("Switch timeout", "TECHNICAL"),
    "DECLINED": ("Declined by issuer", "ISSUER"),
}
SUCCEEDED, FAILED, REVERSED = 0, 1, 2  # a line's outcome while it is moved
TARGET_MONTH = dt.date(2001, 10, 1)
TARGET_SUCCESS_RATE = "93.00"
TARGET_DIVISOR = 83


def read_tpch(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _failure_case(code: Column, pick: int) -> Column:
    expr = None
    for k, v in FAILURE_TEXT.items():
        expr = (F.when(code == k, F.lit(v[pick])) if expr is None else expr.when(code == k, F.lit(v[pick])))
    return expr


def _line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per lineitem with what its transaction is made of: keys, codes and figures, no derived text.

    These rows are what the joins and the layout by month move. Orders take
    their customer first, so that the lines are shuffled once by part and once
    by order whatever the size: those two joins are merge joins by hint, never
    a broadcast of a table that grows. Suppliers, the fewest, are left to their
    size; past them a line's supplier is kept only where it is an agent. The
    flag becomes a code before the first shuffle. Nation and region (25 and 5
    rows in every scale factor) are joined in ``_named``, as broadcasts after a
    bounded size check.
    """
    outcome = (
        F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40), FAILED)
        .when((F.col("l_returnflag") == "A") & (F.col("l_quantity") == 50), REVERSED)
        .otherwise(SUCCEEDED)
        .cast("tinyint")
    )
    agent = F.when(F.col("p_type") == AGENCY_PRODUCT, F.col("l_suppkey"))
    cust = read_tpch(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = read_tpch(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    orders = orders.join(cust, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey")
    part = read_tpch(spark, sf_dir, "part").select("p_partkey", "p_type")
    supp = read_tpch(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    li = read_tpch(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", outcome.alias("outcome"), "l_shipdate"
    )
    return (
        li.join(part.hint("merge"), F.col("l_partkey") == F.col("p_partkey"))
        .join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(broadcast_if_small(supp), F.col("l_suppkey") == F.col("s_suppkey"))
        .drop("l_orderkey", "o_orderkey", "l_partkey", "p_partkey", "s_suppkey")
        .withColumn("l_suppkey", agent)
    )


def _named(lines: DataFrame, sf_dir: str) -> DataFrame:
    """``_line_rows`` with the nations of customer and supplier and the customer's region."""
    spark = lines.sparkSession
    nation = read_tpch(spark, sf_dir, "nation")
    region = read_tpch(spark, sf_dir, "region")
    home = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("c_nation"), F.col("n_regionkey").alias("c_regionkey")).join(
        broadcast_if_small(region.select(F.col("r_regionkey").alias("c_regionkey"), F.col("r_name").alias("c_region"))), "c_regionkey"
    )
    away = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("s_nation"))
    return lines.join(broadcast_if_small(home), "c_nationkey").join(broadcast_if_small(away), "s_nationkey")


def _as_transactions(t: DataFrame, *extra: str) -> DataFrame:
    """The star's fact from ``_named`` rows, row by row (FIXTURES.md section 2), with ``extra`` columns kept."""
    status = F.when(F.col("outcome") == FAILED, "FAILED").when(F.col("outcome") == REVERSED, "REVERSED").otherwise("SUCCESS")
    code = (
        F.when(F.col("l_linenumber") <= 2, "INSUFF_FLOAT")
        .when(F.col("l_linenumber") <= 4, "TIMEOUT")
        .otherwise("DECLINED")
    )
    t = t.select(
        F.col("l_shipdate").alias("TRANSACTION_DATE"),
        F.col("p_type").alias("PRODUCT"),
        F.when(F.col("p_type").isin(*TRANSFER_PRODUCTS), "TRANSFER").otherwise("CORE").alias("PRODUCT_CATEGORY"),
        F.col("c_region").alias("SUBSIDIARY"),
        F.col("c_nation").alias("COUNTRY"),
        F.concat(F.lit("CUR_"), F.col("c_regionkey").cast("string")).alias("CURRENCY"),
        F.col("o_orderpriority").alias("CHANNEL"),
        F.when(F.col("o_orderpriority").isin(*DIGITAL_CHANNELS), "DIGITAL").otherwise("ASSISTED").alias("CHANNEL_TYPE"),
        status.alias("STATUS"),
        F.col("c_custkey").alias("CUSTOMER_ID"),
        F.when(F.col("p_type") == AGENCY_PRODUCT,
               F.when(F.col("l_linenumber") == 7, F.lit(""))
               .otherwise(F.concat(F.lit("AG"), F.col("l_suppkey").cast("string")))).alias("AGENT_ID"),
        F.col("c_nation").alias("SOURCE_COUNTRY"),
        F.col("s_nation").alias("DEST_COUNTRY"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("TXN_AMOUNT_LOCAL"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").alias("TXN_AMOUNT_USD"),
        (F.col("l_extendedprice") * F.col("l_tax")).cast("decimal(18,4)").alias("FEE_AMOUNT_LOCAL"),
        (F.col("l_quantity") * 6).cast("int").alias("PROCESSING_TIME_SECS"),
        code.alias("_code"),
        *extra,
    )
    failed = F.col("STATUS") == "FAILED"
    return t.select(
        *[c for c in schemas.TRANSACTIONS.fieldNames() if c not in ("FAILURE_CODE", "FAILURE_DESCRIPTION", "FAILURE_CATEGORY")],
        F.when(failed, F.col("_code")).alias("FAILURE_CODE"),
        F.when(failed, _failure_case(F.col("_code"), 0)).alias("FAILURE_DESCRIPTION"),
        F.when(failed, _failure_case(F.col("_code"), 1)).alias("FAILURE_CATEGORY"),
        *extra,
    )


def transactions_from_tpch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction per lineitem; dimension attributes from order/customer/part/supplier."""
    return _as_transactions(_named(_line_rows(spark, sf_dir), sf_dir))


def agents_from_tpch(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_tpch(spark, sf_dir, "nation")
    region = read_tpch(spark, sf_dir, "region")
    return (
        read_tpch(spark, sf_dir, "supplier")
        .join(broadcast_if_small(nation), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(broadcast_if_small(region), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.concat(F.lit("AG"), F.col("s_suppkey").cast("string")).alias("AGENT_ID"),
            F.col("s_name").alias("AGENT_NAME"),
            F.when(F.col("s_acctbal") > 5000, "GOLD").otherwise("BASIC").alias("AGENT_TIER"),
            F.col("r_name").alias("REGION"),
            F.col("n_name").alias("COUNTY"),
            F.when(F.col("s_acctbal") < 0, F.lit(0)).otherwise(F.floor(F.col("s_acctbal") * 10)).cast("bigint")
            .alias("FLOAT_LIMIT_KES"),
        )
    )


def customers_from_tpch(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_tpch(spark, sf_dir, "nation")
    region = read_tpch(spark, sf_dir, "region")
    return (
        read_tpch(spark, sf_dir, "customer")
        .join(broadcast_if_small(nation), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(broadcast_if_small(region), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("c_custkey").alias("CUSTOMER_ID"),
            F.col("c_mktsegment").alias("SEGMENT"),
            F.col("r_name").alias("SUBSIDIARY_NAME"),
        )
    )


def kpi_targets_from_transactions(txns: DataFrame) -> DataFrame:
    """One target row per product x subsidiary for the fixture month (FIXTURES.md section 3)."""
    n = F.count(F.lit(1))
    return (
        txns.groupBy("PRODUCT", F.col("SUBSIDIARY").alias("SUBSIDIARY_NAME"))
        .agg(
            (F.floor(n / TARGET_DIVISOR) + F.length("SUBSIDIARY_NAME") - 5).cast("bigint").alias("TARGET_VOLUME"),
            (F.floor(F.sum("TXN_AMOUNT_USD")).cast("bigint") / TARGET_DIVISOR).cast("decimal(18,2)")
            .alias("TARGET_VALUE_USD"),
            F.floor(n / TARGET_DIVISOR).cast("bigint").alias("TARGET_ACTIVE_CUSTOMERS"),
        )
        .select(
            "PRODUCT",
            "SUBSIDIARY_NAME",
            F.lit(TARGET_MONTH).alias("TARGET_MONTH"),
            "TARGET_VOLUME",
            "TARGET_VALUE_USD",
            F.lit(TARGET_SUCCESS_RATE).cast("decimal(5,2)").alias("TARGET_SUCCESS_RATE"),
            "TARGET_ACTIVE_CUSTOMERS",
        )
    )


def forex_from_transactions(txns: DataFrame) -> DataFrame:
    """Distinct subsidiary x month with a deterministic synthetic USD rate."""
    m = F.trunc(F.to_date("TRANSACTION_DATE"), "month")
    return (
        txns.select(F.col("SUBSIDIARY").alias("SUBSIDIARY_NAME"), m.alias("RATE_MONTH"))
        .distinct()
        .select(
            "SUBSIDIARY_NAME",
            "RATE_MONTH",
            (F.lit(0.005).cast("decimal(4,3)") + F.lit(0.001).cast("decimal(4,3)") * F.length("SUBSIDIARY_NAME")
             + F.lit(0.0001).cast("decimal(5,4)") * F.month("RATE_MONTH")).cast("decimal(18,6)").alias("USD_RATE"),
        )
    )


def star_from_tpch(spark: SparkSession, sf_dir: str) -> Star:
    txns = transactions_from_tpch(spark, sf_dir)
    return Star(
        transactions=txns,
        agents=agents_from_tpch(spark, sf_dir),
        customers=customers_from_tpch(spark, sf_dir),
        kpi_targets=kpi_targets_from_transactions(txns),
        forex_rates=forex_from_transactions(txns),
    )


def events_as_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` stream seen as transactions with real hours of day (FIXTURES.md section 5).

    ``error`` events are failures; the event value is the USD amount; events
    carry no processing time, so that column is NULL.
    """
    ev = read_tpch(spark, sf_dir, "events")
    return ev.select(
        F.col("ts").alias("TRANSACTION_DATE"),
        F.when(F.col("event_type") == "error", "FAILED").otherwise("SUCCESS").alias("STATUS"),
        F.col("value").cast("decimal(18,4)").alias("TXN_AMOUNT_USD"),
        F.lit(None).cast("int").alias("PROCESSING_TIME_SECS"),
        F.col("user_id").alias("CUSTOMER_ID"),
        F.col("event_type").alias("PRODUCT"),
    )


class StarError(ValueError):
    """A source table cannot be read as its star table."""


def _unreadable(df: DataFrame, f) -> Column | None:
    """Condition: the source has a value that does not convert to the column's type (None if types agree)."""
    src = df.schema[f.name].dataType
    if src == f.dataType:
        return None
    c = F.col(f"`{f.name}`")
    given = c.isNotNull() & (F.trim(c) != "") if src.typeName() in ("string", "varchar", "char") else c.isNotNull()
    return given & c.try_cast(f.dataType).isNull()


def conform(df: DataFrame, schema, table: str = "table", absent: tuple[str, ...] = (), bad: str = "fail") -> DataFrame:
    """Cast a table to the star's schema once, at the source; the same rule for files and catalog tables.

    Columns are taken by name. A missing column is an error unless named in
    ``absent`` (then it is NULL). Text dates and amounts become typed columns;
    blank text is NULL. A value that does not convert makes the job fail with
    the column and the value (``bad="fail"``), or drops its row
    (``bad="drop"``); ``rejects`` counts such values beforehand.
    """
    if bad not in ("fail", "drop"):
        raise ValueError(f"bad must be 'fail' or 'drop', not {bad!r}")
    missing = [f.name for f in schema.fields if f.name not in df.columns and f.name not in absent]
    if missing:
        raise StarError(f"{table} lacks the columns {', '.join(missing)}")
    cols, sound = [], None
    for f in schema.fields:
        if f.name not in df.columns:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        c, wrong = F.col(f"`{f.name}`"), _unreadable(df, f)
        if wrong is None:
            cols.append(c.alias(f.name))
        elif bad == "drop":
            sound = ~wrong if sound is None else sound & ~wrong
            cols.append(c.try_cast(f.dataType).alias(f.name))
        else:
            message = F.concat(F.lit(f"{table}.{f.name} cannot be read: "), c.cast("string"))
            cols.append(F.when(wrong, F.raise_error(message)).otherwise(c.try_cast(f.dataType)).alias(f.name))
    return (df if sound is None else df.filter(sound)).select(*cols)


def rejects(df: DataFrame, schema, table: str = "table") -> DataFrame:
    """(table, column, rejected, example): values that do not convert to the schema, one row per column that has any."""
    cols = [(f.name, w) for f in schema.fields if f.name in df.columns and (w := _unreadable(df, f)) is not None]
    aggs = [
        F.struct(
            F.lit(table).alias("table"), F.lit(n).alias("column"), F.count_if(w).alias("rejected"),
            F.min(F.when(w, F.col(f"`{n}`").cast("string"))).alias("example"),
        )
        for n, w in cols
    ]
    kind = "array<struct<table:string,column:string,rejected:bigint,example:string>>"
    found = df.agg((F.array(*aggs) if aggs else F.array().cast(kind)).alias("r"))
    return found.select(F.explode("r").alias("r")).select("r.*").filter(F.col("rejected") > 0)


def star_from_catalog(
    spark: SparkSession, names: dict[str, str] | None = None, database: str | None = None, absent: tuple[str, ...] = (), bad: str = "fail",
    keep: str | None = None, version: str = "1",
) -> Star:
    """Read the star from catalog tables or views (Hive/Delta tables, JDBC-backed views, ...).

    ``names`` maps star table names to catalog names (default: the same name,
    optionally qualified by ``database``); each table is conformed to its schema.
    With ``keep`` the star is written there, laid out by month, and read from
    there (``kept_star``); a new ``version`` reads the tables anew.
    """
    names = names or {}

    def table(name: str) -> DataFrame:
        full = names.get(name) or (f"{database}.{name}" if database else name)
        return conform(spark.table(full), schemas.TABLES[name], name, absent, bad)

    star = Star(
        transactions=table("transactions"),
        agents=table("agents"),
        customers=table("customers"),
        kpi_targets=table("kpi_targets"),
        forex_rates=table("forex_rates"),
    )
    return star if keep is None else kept_star(star, keep, version)


def read_files(spark: SparkSession, base: str, name: str, fmt: str = "csv") -> DataFrame:
    """One source table as it is: CSV by header, all text (every file's header must agree); other formats with their types."""
    if fmt == "csv":
        return spark.read.option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(f"{base}/{name}.csv")
    return spark.read.format(fmt).load(f"{base}/{name}")


def star_from_files(
    spark: SparkSession, base: str, fmt: str = "csv", absent: tuple[str, ...] = (), bad: str = "fail", keep: str | None = None
) -> Star:
    """Read a real star: one file or folder per table, columns by name, each table conformed to its schema.

    A fact that lies partitioned by ``TXN_MONTH`` (as ``materialize`` writes it) keeps that column, so reports prune months,
    and the star has a folder for its rollups, named by the fact's files. Any other star gets both with ``keep``: it is
    written there, once for each state of its files (``kept_star``).
    """
    by_month = False

    def read(name: str) -> DataFrame:
        nonlocal by_month
        df, schema = read_files(spark, base, name, fmt), schemas.TABLES[name]
        if name == "transactions" and "TXN_MONTH" in df.columns and fmt != "csv":
            by_month = True
            schema = T.StructType([*schema.fields, T.StructField("TXN_MONTH", T.StringType())])
        return conform(df, schema, name, absent, bad)

    star = Star(
        transactions=read("transactions"),
        agents=read("agents"),
        customers=read("customers"),
        kpi_targets=read("kpi_targets"),
        forex_rates=read("forex_rates"),
    )
    if not by_month and keep is None:
        return star
    from ledgerlens.session import shared_root

    suffix = ".csv" if fmt == "csv" else ""
    mark = files_fingerprint(spark, [f"{base}/{name}{suffix}" for name in (schemas.TABLES if keep else ["transactions"])], base)
    if keep is not None:
        return kept_star(star, keep, mark)
    return replace(star, folder=f"{shared_root(spark)}/ledgerlens-tables/{mark}")


def _source_fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Identity of the source files and of this derivation.

    Files are listed by Spark (names, lengths, modification times; no content
    is read), so any store Spark can read is seen, and the listing is folded to
    one row on the executors.
    """
    return files_fingerprint(spark, [f"{sf_dir}/{name}.parquet" for name in SOURCE_TABLES], sf_dir)


def files_fingerprint(spark: SparkSession, places: list[str], base: str) -> str:
    """Names, lengths and modification times of all files under the places, and this code, in 16 hex digits."""
    import hashlib

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(places)
    # the name below the source folder: the same files by another path are the same star
    name = F.regexp_extract("path", r"([^/]+(?:\.parquet|\.csv|TXN_MONTH=[^/]*)(?:/.*)?|[^/]+/[^/]+)$", 1)
    mark = F.xxhash64(name, "length", "modificationTime")
    seen = files.agg(F.count("*").alias("n"), F.sum("length").alias("b"), F.sum(mark.cast("decimal(38,0)")).alias("h")).first()
    h = hashlib.sha1(f"{base}|{seen['n']}|{seen['b']}|{seen['h']}".encode())
    for code in (__file__, schemas.__file__):  # a change to the derivation invalidates written stars
        with open(code, "rb") as f:
            h.update(f.read())
    return h.hexdigest()[:16]


SOURCE_TABLES = ("lineitem", "orders", "customer", "nation", "region", "part", "supplier")


def _read_star(spark: SparkSession, path: str) -> Star:
    r = spark.read.format("parquet")
    return Star(
        # TXN_MONTH (the partition column) stays: date windows add it for pruning
        transactions=r.load(f"{path}/transactions"),
        agents=r.load(f"{path}/agents"),
        customers=r.load(f"{path}/customers"),
        kpi_targets=r.load(f"{path}/kpi_targets"),
        forex_rates=r.load(f"{path}/forex_rates"),
    )


def materialized_star(spark: SparkSession, sf_dir: str) -> Star:
    """Derive the star from ``sf_dir`` once and keep it under the shared checkpoint folder.

    The folder comes from ``ledgerlens.star.root`` or ``spark.checkpoint.dir``
    (the cluster's shared storage). A rerun with unchanged sources and code
    reads the written tables (see ``published``).
    """
    from ledgerlens.session import application_id, shared_root

    path = f"{shared_root(spark)}/ledgerlens-star/{_source_fingerprint(spark, sf_dir)}"
    key = (application_id(spark), id(spark), path)
    with _LOCK:
        star = _LOADED.get(key)
        if star is None or star.transactions.sparkSession is not spark:
            folder = published(spark, path, lambda place: _build(spark, sf_dir, place))
            star = _LOADED[key] = replace(_read_star(spark, folder), folder=folder)
        return star


def published(spark: SparkSession, path: str, build) -> str:
    """The folder of a finished version under ``path``, building one with ``build(folder)`` if there is none.

    A builder writes to a folder of its own and names it in ``path/ready`` only
    when every table in it is complete, so a half-written version is never read
    and two builders at once do not touch each other's files; if both finish,
    all readers take the one whose name sorts first.
    """
    import uuid

    from pyspark.errors import AnalysisException

    def ready() -> str | None:
        try:
            return spark.read.schema("value string").text(f"{path}/ready").agg(F.min("value")).first()[0]
        except AnalysisException:  # nothing published yet
            return None

    done = ready()
    if done is None:
        name = f"v-{uuid.uuid4().hex}"
        build(f"{path}/{name}")
        spark.createDataFrame([(name,)], "value string").coalesce(1).write.mode("append").text(f"{path}/ready")
        done = ready()
    return f"{path}/{done}"


def _build(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Write the derived star. Independent writes run as concurrent Spark jobs.

    The fact and the two source dimensions are written side by side; targets
    and FX rates are derived from the *written* fact (so the source join runs
    once) and written after it.
    """
    from concurrent.futures import ThreadPoolExecutor

    def save(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{path}/{name}")

    with ThreadPoolExecutor(max_workers=3) as pool:
        fact_job = pool.submit(_write_fact_of_tpch, spark, sf_dir, path)
        dims = [pool.submit(save, agents_from_tpch(spark, sf_dir), "agents"),
                pool.submit(save, customers_from_tpch(spark, sf_dir), "customers")]
        fact = fact_job.result()
        dims += [pool.submit(save, kpi_targets_from_transactions(fact), "kpi_targets"),
                 pool.submit(save, forex_from_transactions(fact), "forex_rates")]
        for d in dims:
            d.result()


# loaded stars per (application, session, folder): lazy DataFrames, so reuse only skips file listing
_LOADED: dict[tuple, Star] = {}
_LOCK = threading.RLock()


def _by_month(rows: DataFrame, date: str) -> DataFrame:
    """Rows dealt to writer tasks by month.

    AQE rebalance: a month larger than the advisory partition size is split
    over several writer tasks, small months are coalesced, so files come out
    evenly sized however skewed the months are. The month is moved as a number;
    its text is made where the row arrives.
    """
    dealt = rows.withColumn("_month", kpi.month_index(date)).hint("rebalance", "_month").drop("_month")
    return dealt.withColumn("TXN_MONTH", F.date_format(date, "yyyy-MM"))


def _save_fact(by_month: DataFrame, path: str) -> DataFrame:
    by_month.write.mode("overwrite").partitionBy("TXN_MONTH").parquet(f"{path}/transactions")
    return by_month.sparkSession.read.parquet(f"{path}/transactions")


def _write_fact(txns: DataFrame, path: str) -> DataFrame:
    return _save_fact(_by_month(txns, "TRANSACTION_DATE").sortWithinPartitions("TXN_MONTH", "TRANSACTION_DATE"), path)


def _write_fact_of_tpch(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """The fact of ``transactions_from_tpch``, written: the narrow rows are dealt by month and sorted, then made transactions."""
    dealt = _named(_by_month(_line_rows(spark, sf_dir), "l_shipdate"), sf_dir)
    return _save_fact(_as_transactions(dealt.sortWithinPartitions("TXN_MONTH", "l_shipdate"), "TXN_MONTH"), path)


def _write_dims(star: Star, path: str) -> Star:
    for name in ("agents", "customers", "kpi_targets", "forex_rates"):
        getattr(star, name).write.mode("overwrite").parquet(f"{path}/{name}")
    return _read_star(star.transactions.sparkSession, path)


def materialize(star: Star, path: str) -> Star:
    """Write the fact partitioned by month, then the dimensions, and re-read them.

    Reports filter on date ranges; a month-partitioned fact sorted by date turns
    those into partition pruning plus Parquet row-group skipping. The write is
    rebalanced by month (AQE splits a month holding a third of the rows over
    many writer tasks instead of one, and merges small months). Re-reading also
    cuts the lineage of the derived star, so a lost executor recomputes from files.
    """
    _write_fact(star.transactions, path)
    return replace(_write_dims(star, path), folder=path)


def kept_star(star: Star, keep: str, version: str) -> Star:
    """The star as written under ``keep`` for this version of its sources, written if it is not there (see ``published``).

    Reports then read month folders, and rollups, labels and histories are kept beside it.
    """
    folder = published(star.transactions.sparkSession, f"{keep.rstrip('/')}/{version}", lambda place: materialize(star, place))
    return replace(_read_star(star.transactions.sparkSession, folder), folder=folder)
