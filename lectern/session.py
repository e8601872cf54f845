"""A session with the settings the plans are written for."""

import tempfile

from pyspark.sql import DataFrame, SparkSession

from . import config


def session(master: str | None = None, **settings: str) -> SparkSession:
    """AQE on, UTC, Arrow on. Shuffle partitions are left to AQE on a cluster; tests pass their own."""
    builder = SparkSession.builder.appName("lectern")
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (base | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan over all cores: a file of one row group is read by one task, so its rows are dealt out if tasks are fewer
    than cores. Scans of large inputs have more and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small(df: DataFrame, rows: int = config.BROADCAST_ROWS) -> bool:
    """Whether a table is proven small enough to broadcast: it has at most so many rows. Reads no more than that."""
    return df.select().limit(rows + 1).count() <= rows


def written(df: DataFrame) -> DataFrame:
    """The rows of df from a checkpoint in the shared folder, which lost executors can't take with them.

    The folder is spark.checkpoint.dir of the session, or the one set on its context. Without either, a local session
    gets a folder of its own; on a cluster that is an error, as a folder of one machine can't be read by others.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)
