"""Tables in the folder that the driver and all executors share, and join hints behind a counted bound."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch, and what Spark has if nothing is set.
BATCH_BYTES, _UNBOUNDED = 2 << 20, str(2**31 - 1)
_OWN: list[str] = []
_MADE: list[tuple] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where it is unset and Spark runs in this process, as in tests, one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="pixelveil-"))
        folder = "file://" + _OWN[0]
    return folder.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A path of its own in the shared folder, removed when Python ends."""
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def file_system(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system of a path, and the path for it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _drop(made: list[tuple]) -> None:
    for spark, path in made:
        if getattr(spark.sparkContext, "_jsc", None) is not None:
            try:
                fs, p = file_system(spark, path)
                fs.delete(p, True)
            except Exception:  # noqa: BLE001  the session may have ended, and the table's folder with it
                continue


def _drop_all() -> None:
    _drop(_MADE)
    for d in _OWN:
        shutil.rmtree(d, ignore_errors=True)


atexit.register(_drop_all)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write a table once to the shared folder and read it from there: lineage is cut and lost executors cost nothing."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], what: str) -> DataFrame:
    """``make()`` as a stored table; the tables that were stored on the way to it are removed when it is there."""
    began = len(_MADE)
    out = stored(make(), what)
    _drop(_MADE[began:-1])
    del _MADE[began:-1]
    return out


def with_import_path(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver found it, as tests and notebooks need.

    On a cluster the package is installed or sent with ``--py-files``. Arrow batches, of which a worker holds one, are
    also bounded by bytes, unless the session has a bound of its own: rows may hold long texts.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", _UNBOUNDED) == _UNBOUNDED:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if top not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), top) if x)
    return spark


def small_or_not(df: DataFrame, rows: int, most: int) -> DataFrame:
    """A broadcast hint for a side whose counted rows are at most ``most``; else Spark shuffles both sides."""
    return F.broadcast(df) if rows <= most else df
