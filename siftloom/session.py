"""Sessions, and the package's way to the executors."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the library expects."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("siftloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("SIFTLOOM_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and tables that executors and driver share: spark.checkpoint.dir.

    Only a local session without one gets a temporary folder; on a cluster that would be a
    folder of the driver alone, so there it is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None and sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="siftloom-"))
    return (named or sc.getCheckpointDir()).rstrip("/")


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store, if it is there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's sources to the executors, once per application.

    Python workers import the package by name; this way they find it without an
    installation or a shared folder.
    """
    sc = spark.sparkContext
    if getattr(sc, "_siftloom_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    if root.parent.suffix == ".zip" or not root.is_dir():  # runs from a shipped copy already
        return spark
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    folder = Path(tempfile.mkdtemp(prefix="siftloom-"))
    (folder / "siftloom.zip").write_bytes(data.getvalue())
    sc.addPyFile(str(folder / "siftloom.zip"))
    sc._siftloom_shipped = True
    return spark
