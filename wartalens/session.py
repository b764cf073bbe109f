"""Session helpers: building a session, sizing, spreading and staging tables."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app_name: str = "wartalens", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or fetch) a session with the settings the operators assume."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan; for a file scan it is the file size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _bytes_conf(spark: SparkSession, key: str, default: int) -> int:
    raw = spark.conf.get(key, str(default)).strip().lower()
    units = {"k": 2**10, "m": 2**20, "g": 2**30}
    digits = raw.rstrip("b")
    if digits and digits[-1] in units:
        return int(float(digits[:-1]) * units[digits[-1]])
    return int(digits)


SPREAD_BYTES = 4 * 2**20      # stored bytes of a spread part; text of this size is seconds of work


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash a *small* scan over all cores; leave a large scan alone.

    A table below one full split per core (often one file, one row group) would run
    on a few tasks only. A larger one already fills the cores, and moving its wide
    text rows would be a shuffle for nothing. The parts are at least as many as cores and
    grow with the table, so that no task does.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = _bytes_conf(spark, "spark.sql.files.maxPartitionBytes", 128 * 2**20)
    size = estimated_bytes(df)
    if size < cores * split:
        return df.repartition(max(cores, math.ceil(size / SPREAD_BYTES)), key)
    return df


_local_work: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """Shared folder for staged tables: the cluster's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if "folder" not in _local_work:
        _local_work["folder"] = tempfile.mkdtemp(prefix="wartalens-")
    return _local_work["folder"]


def new_path(spark: SparkSession, name: str) -> str:
    return os.path.join(work_dir(spark), "wartalens", f"{name}-{uuid.uuid4().hex}")


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a table that several later steps read, and return the written table.

    Cuts lineage: a lost executor costs a re-read of parquet, not a recomputation,
    and later joins see the true size of the table.
    """
    path = new_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered_rows(df: DataFrame, name: str = "_row") -> DataFrame:
    """Stage a table with a row number, so that exploded parts find their row whatever its key is."""
    return stage(df.withColumn(name, F.monotonically_increasing_id()), "rows")

