"""Session set-up and the few execution helpers every job shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

#: Input estimated below this fits one task whatever its key distribution.
TASK_BYTES = 512 * 1024 * 1024
#: Rows of one key that a single window or grouped task may hold.
TASK_ROWS = 2_000_000
#: Scans below this size per core are spread when their files are few.
SPREAD_BYTES = 128 * 1024 * 1024


def build_session(app: str = "quire", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings the jobs are written for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # batch session windows merge on the map side before they shuffle
        "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def task_limit(spark: SparkSession, name: str, default: int) -> int:
    """A size limit, overridable per session as ``quire.<name>``."""
    return int(spark.conf.get(f"quire.{name}", str(default)))


def estimated_bytes(df: DataFrame) -> int:
    """Size of what a plan reads, from Catalyst's statistics; runs no job."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def fits_one_task(df: DataFrame) -> bool:
    limit = task_limit(df.sparkSession, "taskBytes", TASK_BYTES)
    return estimated_bytes(df) <= limit


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores where a few files could not occupy them.

    For scans that feed costly text work. A data set with a file per core, or
    too large to be worth a shuffle, stays as it is read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if estimated_bytes(df) > cores * SPREAD_BYTES or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores, key)


def writing_tasks(spark: SparkSession) -> int:
    """Tasks for a write of many small files, whose bytes alone would put them into one."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for what is started meanwhile."""
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@contextmanager
def folder_listing(spark: SparkSession) -> Iterator[None]:
    """Folders are listed many to a task, not one."""
    tasks = str(4 * spark.sparkContext.defaultParallelism)
    with settings(spark, {"spark.sql.sources.parallelPartitionDiscovery.parallelism": tasks}):
        yield


def has_heavy_key(df: DataFrame, keys: list[str]) -> bool:
    """True if one key holds more rows than a single task should take.

    Small inputs are decided from the plan's size estimate. Only larger ones
    pay for a count per key, which combines on the map side.
    """
    if fits_one_task(df):
        return False
    rows = task_limit(df.sparkSession, "taskRows", TASK_ROWS)
    counts = df.groupBy(*keys).count()
    return not counts.where(counts["count"] > rows).limit(1).isEmpty()


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder the cluster names in spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        base = _local_folder()
    path = f"{base.rstrip('/')}/quire-{uuid.uuid4().hex}"
    _written.append(path)
    return path


#: Folders given out and not yet removed.
_written: list[str] = []


def remove_written(spark: SparkSession) -> int:
    """Remove the intermediate tables of this driver, once the results built on them are stored.

    Tables and stream logs alike; returns how many folders went. Results not
    yet computed lose what they read, so this is the caller's to call.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf, gone = spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _written:
        path = _written.pop()
        for name in (path, f"{path}-log", f"{path}-ticks"):
            where = hadoop(name)
            gone += where.getFileSystem(conf).delete(where, True)
    return gone


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="quire-")


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage by writing the rows to the shared folder.

    A written table survives lost executors as a checkpoint does. Unlike one
    it has the size of its data, by which Spark then chooses joins, and gives
    up only the columns asked for.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keyed state in RocksDB, its changes written rather than whole snapshots, no
#: room taken in advance by the files of a partition.
DISK_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextmanager
def disk_state(spark: SparkSession) -> Iterator[None]:
    """Streams started meanwhile keep their state on disk."""
    with settings(spark, DISK_STATE):
        yield


def checkpointed_stream(stream: DataFrame, path: str | None = None) -> DataFrame:
    """Run an append stream over what its source now holds; read its rows back."""
    path = path or shared_folder(stream.sparkSession)
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{path}-log")
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
