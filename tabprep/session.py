"""Session helpers: a configured SparkSession for local runs, and the shared
folder used to cut lineage.

Lineage is cut by writing Parquet under the folder the cluster names in
``spark.checkpoint.dir`` (never ``localCheckpoint``, never a machine-local
folder on a cluster). Only when that setting is absent *and* the master is
local (tests, the benchmark) is a fresh temporary folder set instead.
"""

from __future__ import annotations

import contextlib
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int | None = None,
                  app: str = "tabprep") -> SparkSession:
    """A SparkSession for local runs (tests, benchmark)."""
    parts = shuffle_partitions or (8 if cores == "*" else int(cores))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    Read from the session (``SparkContext.getCheckpointDir`` or the
    ``spark.checkpoint.dir`` setting). If neither is set, a local master gets a
    fresh temporary folder; any other master raises, because a machine-local
    folder is not visible to the executors.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        try:
            conf_dir = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            conf_dir = None
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    master = sc.master or ""
    if not master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; set it to a folder shared by the cluster")
    path = tempfile.mkdtemp(prefix="tabprep-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique directory name below the checkpoint root."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, most: int | None):
    """Inside, Arrow batches have at most ``most`` rows (``None``: as the session has it)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(spark.conf.get(name))
    if most is None or 0 < held <= most:
        yield
        return
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, held)


def materialize(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the checkpoint root and read it back.

    Cuts the lineage (later jobs start from the files, so a lost executor only
    costs re-reading them) and gives the optimizer real size statistics for
    its broadcast decisions. The folder is removed when the session's JVM ends.
    ``batch_rows`` bounds the Arrow batches of the write: an executor holds each
    task's batch several times, outside the heap and in its Python worker.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with arrow_rows(spark, batch_rows):
        df.write.mode("overwrite").parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.parquet(path)


def ship_package(spark: SparkSession) -> str:
    """Send this package to the executors as a zip file, for clusters on which it
    is not installed (the Arrow functions are found there by import). Call it
    once per session; returns the zip's path on the driver."""
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tabprep-ship-")
    archive = shutil.make_archive(os.path.join(folder, "tabprep"), "zip", os.path.dirname(root), "tabprep")
    spark.sparkContext.addPyFile(archive)
    return archive
