"""Session factory and the settings the plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that hold on a laptop and on a cluster; sizes are left to the caller.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def build_session(name: str = "corpuslens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS; keyword arguments use ``__`` for dots and override them."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Give the package to the Python workers of a session's executors, once per application.

    The driver serves the archive to the executors, so it stays until the process ends.
    """
    import atexit
    import shutil
    import tempfile
    from pathlib import Path

    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        home = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="corpuslens-ship-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        shutil.copytree(home, Path(folder, "src", home.name), ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(str(Path(folder, home.name)), "zip", Path(folder, "src")))
        _shipped.add(sc.applicationId)
    return spark
