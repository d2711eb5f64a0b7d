"""Session helpers: a tuned builder and a lineage cut that survives executor loss."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Folders of local sessions without the setting, which a running session cannot be given.
_LOCAL: dict[str, str] = {}


def local_session(cores: int = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("shortlist")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SHORTLIST_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    A machine-local folder is used only on a ``local`` master, where driver and
    executors are one process; on a cluster the setting is required.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    return _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-shortlist-"))


def is_complete(spark: SparkSession, folder: str) -> bool:
    """Whether a writer finished ``folder``; any file system Spark reads will do.

    Spark's readers pass over names that start with an underscore, so Hadoop is asked.
    """
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a result feeds several later scans.  A lost executor costs a
    re-read of a file, not a recomputation of the plan above it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/shortlist-{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
