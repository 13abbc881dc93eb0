"""Session defaults and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build(master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; `conf` overrides by keyword with `__` for dots.

    Master, partitions and memory that a cluster submits are kept: only where no master is given, here or by the submission, is it local[8]
    with few partitions.
    """
    from pyspark import SparkConf

    submitted = SparkConf().get("spark.master", None)
    b = SparkSession.builder.appName("graphloom")
    if master or not submitted:
        b = b.master(master or "local[8]")
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if master or not submitted:
        base |= {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}
    base |= {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in base.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Only where that setting is unset and the master is a local one (tests) a folder of this machine is used.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = os.path.join(tempfile.gettempdir(), "graphloom-checkpoints")
    return d


def cut(df: DataFrame) -> DataFrame:
    """`df`, written once to the shared folder: later stages neither recompute nor lose it with an executor."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder; columns stay prunable and filters stay pushable."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


_written: list[str] = []


def tidy(spark: SparkSession) -> None:
    """Deletes the tables that `written` and `cut` left in the shared folder. What was built on them can't be read again after it.

    Called by itself when the driver ends; call it earlier where a session lives long.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in [*_written, *filter(None, [spark.sparkContext.getCheckpointDir()])]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    _written.clear()


def _at_end() -> None:
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None:
            tidy(spark)
    except Exception:  # the session is gone, and with it the way to its file system
        pass


atexit.register(_at_end)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers, once per application, so that they need no path of their own to it."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = Path(folder) / "graphloom_package.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, Path(root.name) / p.relative_to(root))
        spark.sparkContext.addPyFile(str(path))
        _shipped.add(app)
    return spark
