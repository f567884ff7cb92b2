"""Session factory used by tests, the bench and notebooks."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "plumbline", master: str | None = None, **conf: object) -> SparkSession:
    """A session in UTC with adaptive execution; keyword options override the defaults."""
    options = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
    } | {k.replace("__", "."): str(v) for k, v in conf.items()}
    builder = SparkSession.builder.appName(app)
    master = master or os.environ.get("PLUMBLINE_MASTER")
    if master:
        builder = builder.master(master)
    return builder.config(map=options).getOrCreate()
