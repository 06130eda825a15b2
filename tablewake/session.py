"""Session settings and the shared folder that intermediate tables go to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local_folders: dict[str, str] = {}
_job_folders: list[str] = []


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """Session for tests and the bench; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tablewake")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    local = spark.sparkContext.master.startswith("local")
    if named and named.startswith("file:") and not local:
        raise ValueError(f"spark.checkpoint.dir is {named}: executors do not share a folder of their own machine")
    if named:
        return named
    if not local:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="tablewake-")
    return _local_folders[app]


def save_folder(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{shared_folder(spark)}/tablewake-{spark.sparkContext.applicationId}"


@contextmanager
def job_save_points(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside go when the block ends, also if it fails."""
    _job_folders.append(f"{save_folder(spark)}/job-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        remove_folder(spark, _job_folders.pop())


def clear_save_points(spark: SparkSession) -> None:
    """Remove the intermediate tables of this application, once its results are written."""
    remove_folder(spark, save_folder(spark))


def remove_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def save_point(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage so that a lost executor costs one re-read, and gives the planner true sizes.
    """
    return counted_save_point(df, partition_by=partition_by)[0]


def counted_save_point(
    df: DataFrame, partition_by: Sequence[str] = (), **counts: Column
) -> tuple[DataFrame, dict[str, int]]:
    """`save_point`, with the number of ``rows`` and of rows that meet each condition, taken on the way."""
    path = f"{_job_folders[-1] if _job_folders else save_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    seen = Observation()
    counted = df.observe(
        seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in counts.items()]
    )
    counted.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get


def gathered(df: DataFrame, rows: int, each: int = 250_000) -> DataFrame:
    """A written table of so many rows in as few partitions as they fill, so that a short one is worked on without shuffles."""
    return df.coalesce(1 + rows // each)


@contextmanager
def short_tables_together(spark: SparkSession) -> Iterator[None]:
    """Joins of single partitions planned inside stay in one task.

    The planner takes each join's size as the product of its sides, so a chain of joins over short tables soon looks too large
    for one task and is shuffled at each step.
    """
    key = "spark.sql.maxSinglePartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(1 << 60))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def spread(df: DataFrame) -> DataFrame:
    """Share out rows that were read as fewer splits than there are cores, for costly row-wise work.

    Only for frames that read files directly: to ask a shuffled one for its partitions would run it.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


def spread_evenly(df: DataFrame, rows: int = 250_000) -> DataFrame:
    """Deal out rows, at most so many to a task on average, for row-wise work that costs far more than a shuffle.

    The splits of a file say little about its rows: each holds the row groups that begin in it, so some are empty while others hold
    millions. The number of tasks therefore follows the number of rows, which the files' footers tell.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)))
