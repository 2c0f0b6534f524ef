"""Spark session settings that the engine expects, and folders for intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; cluster settings given by the submitter stay."""
    builder = SparkSession.builder.appName("quarry")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return builder.config(map=settings).getOrCreate()


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over all cores: dealt by key where a scan has fewer partitions than there are cores (a small file, few row groups).

    A large table has more partitions than that and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); a local one only where none is set and the master is local, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quarry-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_FOLDERS: dict[str, SparkSession] = {}  # what this process has written and not yet released


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; its folder is deleted by release(), or when the driver's process ends."""
    folder = f"{shared_dir(spark)}/quarry-{uuid.uuid4().hex}"
    if not _FOLDERS:
        atexit.unregister(release)
        atexit.register(release)
    _FOLDERS[folder] = spark
    return f"{folder}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: what made it isn't run again, and it outlives executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete the intermediate tables of this process. Results that still read them must have been written before."""
    for folder, spark in list(_FOLDERS.items()):
        _FOLDERS.pop(folder)
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        except Exception:  # noqa: BLE001, PERF203 - the JVM may be gone: the folder stays, as after a crash
            return
