"""Spark sessions with the settings the engine relies on."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

from .errors import EngineError

#: Settings that change results: applied to every session the engine works with.
SEMANTICS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def session(app: str = "stratalog", **conf: str) -> SparkSession:
    """A session on whatever master the environment names, one machine by default."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true")
    for key, value in (SEMANTICS | conf).items():
        builder = builder.config(key, value)
    return prepared(builder.getOrCreate())


def prepared(spark: SparkSession) -> SparkSession:
    """spark with the settings that results depend on."""
    for key, value in SEMANTICS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir. Only on one
    machine does a temporary folder stand in where that is unset; it goes at exit."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise EngineError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="stratalog-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


def dropped(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediate data, wherever it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
