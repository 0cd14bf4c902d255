"""Makes the package importable on Python workers, wherever the driver was started; cuts lineages."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_own: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="sources-")  # the driver serves the file from here for as long as it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share, named in spark.checkpoint.dir.  Where executors live in the driver and
    none is named, a folder of this process is used."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, _own[sc.applicationId], ignore_errors=True)
    return _own[sc.applicationId]


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"

    def gone() -> None:
        with contextlib.suppress(Exception):  # the session may be gone already
            _remove(spark, path)

    atexit.register(gone)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their plan: a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared(df.sparkSession))
    return df.checkpoint()


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """The rows dealt out by columns to as many tasks as the session has for shuffles.  Adaptive execution would join these
    into few by their packed bytes, which say little of what a task holds of rows that are all much alike."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)
