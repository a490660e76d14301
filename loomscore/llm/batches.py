"""Arrow batches in and out of Python, a bounded number of rows and bytes at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows that are in Python's hands at a time, and bytes of their texts if there is more than one row.
ROWS, BYTES = 500, 4 << 20
#: Spark's setting for the bytes of a batch that it hands to Python, and its default.
SETTING, DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20)


def texts(values: list[bytes | None]) -> list[str]:
    """Decoded UTF-8; null gives an empty text, malformed bytes U+FFFD."""
    return [v.decode("utf-8", "replace") if v else "" for v in values]


def row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of each row's texts and byte strings."""
    out = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            out += pc.binary_length(c).fill_null(0).to_numpy(zero_copy_only=False)
    return out


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of at most ``rows`` rows and ``most`` bytes of text; a longer row stands alone."""
    for batch in batches:
        ends = np.cumsum(row_bytes(batch))
        start = 0
        while start < batch.num_rows:
            held = ends[start - 1] if start else 0
            stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, held + most, side="right"))))
            yield batch.slice(start, stop - start)
            start = stop


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow`` with batches of about BYTES at most, which the executor and Python each hold whole.

    The session's setting is changed only where it has Spark's default; what
    Arrow keeps for later batches is given back at a task's end, as Spark
    keeps the worker for other stages.
    """
    conf = df.sparkSession.conf
    if conf.get(SETTING).rstrip("b") == DEFAULT:
        conf.set(SETTING, str(BYTES))

    def released(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(it)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(released, schema)


def append(df: DataFrame, source: str, target: str, kind: T.DataType, factory: Callable[[], Callable[[list], list]], drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with column ``target`` computed from ``source`` (given as bytes).

    ``factory`` is called once a task; what it returns maps a list of values
    to a list of as many results.  An existing ``target`` is replaced; columns
    in ``drop`` don't reach Python and are not returned.
    """

    def one() -> Callable[[list], list[list]]:
        f = factory()
        return lambda v: [f(v)]

    return append_all(df, source, {target: kind}, one, drop)


def append_all(df: DataFrame, source: str, targets: dict[str, T.DataType], factory: Callable[[], Callable[[list], list[list]]], drop: tuple[str, ...] = (), most: int = BYTES) -> DataFrame:
    """As ``append`` for several columns, computed in one pass by one worker, ``most`` bytes of text at a time: results are a list for each target."""
    keep = [c for c in df.columns if c not in drop and c not in targets]
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(t, k) for t, k in targets.items())])
    arrow, names = [to_arrow_type(k) for k in targets.values()], [*keep, *targets]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = factory()
        for b in slices(batches, most=most):
            out = [pa.array(v, k) for v, k in zip(f(b.column(len(keep)).to_pylist()), arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *out], names)

    return mapped(df.select(*keep, F.col(source).cast("binary").alias("__source")), run, schema)
