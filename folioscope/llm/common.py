"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import drop_stored, scope, shared_dir, stored  # noqa: F401

#: Rows and bytes of text that a worker handles at once, whatever the size of Spark's batches.
SLICE_ROWS, SLICE_BYTES = 1000, 1 << 22

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Bytes of an Arrow batch on its way to a worker, where the session leaves Spark's default.
BATCH_BYTES = "4m"


def prepare(spark: SparkSession) -> SparkSession:
    """Short Arrow batches, and this package on the workers' path.

    A batch is bounded by bytes, as texts may be long; a session that names a bound of its own
    keeps it.  Batches are made when a result is read, so the setting can't be taken back here.
    On a cluster the package is installed or sent by ``--py-files``; the path only helps local runs.
    """
    sc = spark.sparkContext
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound, None) is None:
        spark.conf.set(bound, BATCH_BYTES)
    paths = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])
    return spark


def docs(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def spread(*keys: Column, seed: int = 0) -> Column:
    """A repeatable number in [0, 1) from a key."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


_resident: list[tuple[object, object]] = []


def resident(key: object, make: Callable[[], object]) -> object:
    """What ``make`` built for ``key`` in this worker process; only the last key's is kept.

    So a worker that turns to another operator holds nothing large of the one before.
    """
    if not _resident or _resident[0][0] is not key:
        release()
        _resident.append((key, make()))
    return _resident[0][1]


@functools.cache
def _trim() -> Callable[[int], int]:
    """The C library's way to return free memory, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError, TypeError):
        return lambda _: 0


def give_back() -> None:
    """Return free memory to the system: else a worker keeps what its largest batch took, idle too."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def release() -> None:
    """Drop what this worker process keeps, and give free memory back."""
    _resident.clear()
    give_back()


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of at most SLICE_ROWS rows and about SLICE_BYTES of the column ``text``, without copying."""
    per_row = max(1, batch.column(text).nbytes // max(1, batch.num_rows))
    step = max(1, min(SLICE_ROWS, SLICE_BYTES // per_row))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def map_arrow(df: DataFrame, fn: Callable[..., list], schema: str, text: int = 1, keeps: bool = False) -> DataFrame:
    """Apply ``fn`` to the columns (Arrow arrays) of slices of ``df``; it returns one list, numpy or Arrow array for each output column.

    keeps: whether ``fn`` uses ``resident``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            release()
        for batch in batches:
            for part in slices(batch, text):
                cols = fn(*part.columns)
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(cols, arrow)],
                    schema=arrow
                )
            give_back()

    return df.mapInArrow(run, schema)


def map_text(df: DataFrame, fn: Callable[..., list], schema: str, text: int = 1, keeps: bool = False) -> DataFrame:
    """``map_arrow`` with columns as Python lists."""
    return map_arrow(df, lambda *cols: fn(*[c.to_pylist() for c in cols]), schema, text, keeps)
