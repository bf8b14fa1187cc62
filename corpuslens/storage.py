"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing a table there and reading it back, so that a lost
executor costs a re-read and never a recomputation from the sources.  The
folder is the session's ``spark.checkpoint.dir``; only a local session without
that setting gets a folder of its own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_own: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; raises on a cluster that names none."""
    global _own
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="corpuslens-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return f"file://{_own}"


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed by ``release`` or when the process ends."""
    path = f"{shared_dir(spark)}/corpuslens-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and return a DataFrame that reads it."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table that ``materialise`` returned, once no plan reads it any more; anything else is left alone."""
    path = getattr(df, "_stored_at", None)
    if path is not None:
        drop(df.sparkSession, path)
        _made[:] = [(s, p) for s, p in _made if p != path]


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release() -> None:
    """Delete all tables that ``materialise`` wrote in this process."""
    while _made:
        spark, path = _made.pop()
        try:
            drop(spark, path)
        except Exception:  # the session may be gone; the folder is the cluster's to clean then
            pass


atexit.register(release)


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, if a scan gives fewer; otherwise df as it is.

    For scans with costly work per row: a table in one small file would keep all
    but one core idle.  A large table has more partitions than cores and isn't
    shuffled.  df must be a scan with filters and projections.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
