"""Session helpers."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession | None = None) -> SparkSession | None:
    """Let Python workers of a local run import this package.

    On a cluster the package is installed on all nodes or sent by ``--py-files``.
    """
    spark = spark or SparkSession.getActiveSession()
    if spark is not None:
        env = spark.sparkContext.environment
        paths = env.get("PYTHONPATH", "").split(os.pathsep)
        if _ROOT not in paths:
            env["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])
    return spark
