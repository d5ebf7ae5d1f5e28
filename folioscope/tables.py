"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import functools
import os
import re
import shutil
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is not set, a local session uses a folder below its warehouse (as in tests); on a
    cluster that would be a folder of one machine, so it is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_shared")


#: Tables written by ``stored`` in each open scope, the innermost last; the first is the process.
_scopes: list[list[tuple[SparkSession, str]]] = [[]]


def stored(df: DataFrame, name: str, level: int = -1) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    The table goes when the scope it was written in closes (``scope``), by ``drop_stored``, or when
    the process ends.  level: -1 for the innermost scope, -2 for the one around it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _scopes[level].append((spark, path))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folioscope_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_stored(df: DataFrame) -> None:
    """Delete what ``stored`` wrote for ``df``; nothing that still reads it may follow."""
    path = getattr(df, "_folioscope_path", None)
    if path:
        for tables in _scopes:
            tables[:] = [t for t in tables if t[1] != path]
        _delete(df.sparkSession, path)


@contextlib.contextmanager
def scope() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that ``stored`` writes inside go at the end; results must be written by then.

        with scope() as keep:
            groups = keep(similarity_groups(df), "groups")

    ``keep`` is ``stored``, but its table belongs to the scope around this one.
    """
    _scopes.append([])
    try:
        yield functools.partial(stored, level=-2)
    finally:
        for spark, path in _scopes.pop():
            _delete(spark, path)


@atexit.register
def _at_exit() -> None:
    """Where the session has ended before the process, only local folders can still be deleted."""
    for spark, path in (t for tables in _scopes for t in tables):
        with contextlib.suppress(Exception):
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
            elif re.match("file:|(?!.*://)", path):
                shutil.rmtree(re.sub("^file:(//)?", "", path), ignore_errors=True)
