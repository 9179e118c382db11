"""Helpers the operators share: table access, streaming Arrow output, cached worker objects."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of variable-length output after which a task hands a batch over.
FLUSH_ROWS = 2_000
FLUSH_BYTES = 8_000_000

_objects: dict = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cached(key, make: Callable):
    """One object per key and Python worker; keeps the last few only."""
    if key not in _objects:
        while len(_objects) >= 8:
            _objects.pop(next(iter(_objects)))
        _objects[key] = make()
    return _objects[key]


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows of a batch, one Python object per cell at a time."""
    columns = [batch.column(i) for i in range(batch.num_columns)]
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in columns)


def batches_of(rows: Iterable[tuple], schema: pa.Schema, weight: Callable[[tuple], int] | None = None) -> Iterator[pa.RecordBatch]:
    """Gather rows into batches that stay small however long single cells are."""
    kept, size = [], 0
    for row in rows:
        kept.append(row)
        size += weight(row) if weight else 0
        if len(kept) >= FLUSH_ROWS or size >= FLUSH_BYTES:
            yield _batch(kept, schema)
            kept, size = [], 0
    if kept:
        yield _batch(kept, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
