"""Session settings and intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUN = uuid.uuid4().hex[:12]
_owned: set[str] = set()


def get_session(app: str = "memlattice", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow batches of bounded size."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of this run under ``spark.checkpoint.dir``.

    The cluster names a folder that all executors share. Only where the setting is
    absent (tests, one machine) a temporary folder is made and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="memlattice-")
        atexit.register(shutil.rmtree, root, True)
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    mine = os.path.join(root, f"memlattice-{_RUN}")
    if mine not in _owned:
        _owned.add(mine)
        path, files = _path(spark, mine)
        files.mkdirs(path)
        files.deleteOnExit(path)  # the run's tables end with the driver
    return mine


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage and outlives lost executors; the table goes with the run's folder.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:10]}")
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a table of ``materialize`` that nothing reads any more (an iteration's earlier round)."""
    written = getattr(df, "_written", None)
    if written:
        path, files = _path(df.sparkSession, written)
        files.delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores: a few large files would else keep
    an expensive Python stage on as few tasks. Larger inputs stay as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
