"""Session defaults and small helpers that every module shares."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("quern")
    for key, value in {**DEFAULTS, "spark.sql.shuffle.partitions": str(partitions), **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    share_package(spark)
    return spark


def share_package(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it, whatever the working folder is."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data directory (a file or a folder of part files)."""
    share_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows over at least as many partitions as there are cores, for heavy work on a scan of few splits.

    A large scan has more splits than cores and stays as it is; only a small one is shuffled.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's shared checkpoint folder; set one of our own only in a local session where none is configured."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp")))
