"""Session factory: UTC, ANSI arithmetic and adaptive execution."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent_to: set[str] = set()


def session(name: str = "corvane", cores: int | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators count on.

    ``cores`` makes it a local session; on a cluster leave it out, and the
    master, memory and shared folder come from spark-submit.
    """
    builder = SparkSession.builder.appName(name)
    if cores:
        builder = builder.master(f"local[{cores}]").config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    if shuffle_partitions or cores:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions or cores)
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once per application, so that tasks find it wherever the driver was started."""
    context = spark.sparkContext
    if context.applicationId in _sent_to:
        return
    folder = tempfile.mkdtemp(prefix="corvane-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    home = Path(__file__).resolve().parent
    context.addPyFile(shutil.make_archive(f"{folder}/corvane", "zip", home.parent, home.name))
    _sent_to.add(context.applicationId)
