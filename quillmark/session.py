"""Session settings the engine is tuned for; every one can be overridden by the caller's builder."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, app: str = "quillmark", **settings: str) -> SparkSession:
    """A SparkSession with the engine's defaults. On a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app).config(map=DEFAULTS | settings)
    return (builder.master(master) if master else builder).getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the executors' Python workers, once for each application."""
    import shutil
    import tempfile
    from pathlib import Path

    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="quillmark-")
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/quillmark-src", "zip", root.parent, root.name))
        _SHIPPED.add(app)
    return spark
