"""Intermediate tables in the folder that all executors share.

A staged table cuts lineage: a lost executor costs the running task, not the work that
led to the table.  The folder is ``spark.checkpoint.dir`` of the session; where that is
unset (tests, a laptop) a folder of the driver is used, which needs a local master.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_fallback: dict[str, str] = {}
_folders: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables, the session's own setting first."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"
    if "dir" not in _fallback:
        _fallback["dir"] = tempfile.mkdtemp(prefix="siftline-")
        atexit.register(__import__("shutil").rmtree, _fallback["dir"], True)
    return "file://" + _fallback["dir"]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return it read back.

    Tables of an application lie in a folder of their own, which goes when the driver ends.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}"
    _clear_at_end(spark, folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def _clear_at_end(spark: SparkSession, folder: str) -> None:
    if folder not in _folders:
        _folders.add(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())

        def clear() -> None:
            with contextlib.suppress(Py4JError, OSError):  # the JVM may be gone before Python
                files.delete(path, True)

        atexit.register(clear)


def discard(*frames: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in frames:
        path = getattr(df, "_staged_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
