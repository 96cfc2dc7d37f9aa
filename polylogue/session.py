"""Session helpers: building a local session and finding the shared scratch folder."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, app: str = "polylogue",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session or build one with settings suited to these jobs.

    On a cluster the session normally exists already and is returned unchanged;
    the settings below matter for local runs and tests.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    master = master or os.environ.get("POLYLOGUE_MASTER", "local[*]")
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("POLYLOGUE_DRIVER_MEMORY", "16g"))
    )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    The cluster's setting is always used when present. Only a local master may run
    without it (tests): a fresh folder is then created and registered. Elsewhere the
    executors would each write to a disk of their own, so a missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="polylogue-ckpt-")
    sc.setCheckpointDir(conf)
    return (sc.getCheckpointDir() or conf).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path below the shared checkpoint folder, removed when the application ends."""
    path = f"{checkpoint_root(spark)}/polylogue/{name}-{uuid.uuid4().hex[:12]}"
    removed_at_end(spark, path)
    return path


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` stored once below the shared folder and read again; this also cuts the lineage. ``compression`` (default: the session's) suits texts."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for ``path``."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def removed_at_end(spark: SparkSession, path: str) -> None:
    """Have ``path`` removed when the driver's JVM ends; what is there then goes."""
    fs, p = hadoop_path(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    fs.delete(p, True)


def fingerprint(spark: SparkSession, path: str) -> str:
    """Name, size and time of the files of ``path``: another value once the input has changed."""
    fs, p = hadoop_path(spark, path)
    if not fs.exists(p):
        return "none"
    files = fs.listFiles(p, True)
    seen = []
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
    return hashlib.sha1("\n".join(sorted(seen)).encode()).hexdigest()[:12]


def table_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files of ``path``."""
    fs, p = hadoop_path(spark, path)
    return int(fs.getContentSummary(p).getLength())
