"""Session settings shared by the tests, the bench and ad-hoc runs."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, memory: str = "6g", **extra: str) -> SparkSession:
    """A local session for tests and benches; clusters bring their own session."""
    conf = DEFAULTS | {
        "spark.sql.shuffle.partitions": str(os.environ.get("QK_SHUFFLE", 8)),
        "spark.driver.memory": memory,
    } | extra
    return SparkSession.builder.master(f"local[{cores}]").config(map=conf).getOrCreate()
