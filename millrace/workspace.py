"""Intermediate tables that survive the loss of executors.

Iterative operators cut their lineage by writing a Parquet table into the folder that ``spark.checkpoint.dir`` names; every
executor of a cluster can read it. A folder of our own is set only where the session has none, as in tests.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_WRITTEN: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session, or for a local session without one a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return _LOCAL["dir"]


def materialise(df: DataFrame, label: str = "step", by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: one computation, short lineage, compressed; with ``by``, in a folder for each value."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{label}-{uuid.uuid4().hex}"
    w = df.write.option("compression", "zstd")
    (w if by is None else w.partitionBy(by)).parquet(path)
    _WRITTEN[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._step = path
    return out


def release(*steps: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing reads any more, such as those of earlier rounds; others are left alone."""
    for df in steps:
        path = getattr(df, "_step", None)
        if path in _WRITTEN:
            _delete(_WRITTEN.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for path, spark in _WRITTEN.items():
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone; the folder is a temporary one then
            pass
    _WRITTEN.clear()


atexit.register(_clean)
