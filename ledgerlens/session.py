"""Session helpers.

On a cluster the session comes from the platform; these helpers only fill in
settings that are unset (tests, local benches). The checkpoint folder is read
from ``spark.checkpoint.dir`` and is never replaced when the cluster names one.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "ledgerlens") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


#: Customers per group are counted exactly, so a task's partial aggregate holds nearly every row it reads: 100 times the
#: compressed bytes. 16 MB of files a task keep that near 0.5 GB whatever the size of the fact.
SPLIT_BYTES = "16m"


def configure(spark: SparkSession) -> SparkSession:
    """Defaults for settings the session leaves unset; what the caller has set stays."""
    given = spark.conf.getAll
    for key, value in (
        ("spark.sql.session.timeZone", "UTC"), ("spark.sql.adaptive.enabled", "true"), ("spark.sql.adaptive.skewJoin.enabled", "true"),
        ("spark.sql.files.maxPartitionBytes", SPLIT_BYTES),
    ):
        if key not in given:
            spark.conf.set(key, value)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; a local one is made only for a local session without a setting."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server side owns the context and its checkpoint folder
        return configured or ""
    current = sc.getCheckpointDir()
    if current:
        return current
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def application_id(spark: SparkSession) -> str:
    try:
        return spark.sparkContext.applicationId
    except Exception:  # Spark Connect
        return spark.conf.get("spark.app.id", None) or "connect"


def shared_root(spark: SparkSession) -> str:
    """Folder for tables this library writes: ``ledgerlens.star.root``, else the checkpoint folder."""
    root = spark.conf.get("ledgerlens.star.root", None) or spark.conf.get("spark.checkpoint.dir", None)
    return (root or ensure_checkpoint_dir(spark)).rstrip("/")
