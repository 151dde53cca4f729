"""Session builder with the settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "tessella", *, master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew-join handling, UTC and Arrow. Settings given by the cluster stay."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master).config("spark.driver.memory", conf.pop("driver_memory", "6g"))
        b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in {**settings, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()
