"""SparkSession factory with the settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "orrery", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # one BLAS thread a Python worker: the tasks are the parallelism
        "spark.executorEnv.OMP_NUM_THREADS": "1",
    }
    for key, value in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
