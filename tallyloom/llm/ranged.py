"""Running sums over sorted ranges, for keys that may hold any share of all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from tallyloom.sources.workspace import stage


def running(df: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """The rows, written, with ``name``: the sum of the long ``value`` over the rows of the same ``key`` up to this one.

    Rows are dealt out by ranges of key and order, so a hot key spreads over many tasks. Every task sums its own range;
    what a key has in earlier ranges is added afterwards. Only a range's first and last key
    can have rows in other ranges, so the table of offsets has at most two rows per range and is broadcast.
    ``key`` must hold no nulls; rows equal in key and order follow each other in any order.
    """
    laid = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("part", F.spark_partition_id())
    schema = StructType(list(laid.schema.fields)).add(name, "long")

    def run(batches):
        last, total = None, 0
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            keys, values = batch.column(key), batch.column(value).to_numpy().astype(np.int64)
            opens = np.ones(n, bool)
            opens[0] = last is None or not keys[0].equals(last)
            if n > 1:
                opens[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            sums = np.cumsum(values)
            starts = np.flatnonzero(opens)
            before = np.concatenate([[-total], sums[starts] - values[starts]])
            local = sums - before[np.cumsum(opens)]
            last, total = keys[n - 1], int(local[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local)], names=[*batch.schema.names, name])

    summed = stage(laid.mapInArrow(run, schema), "ranges")
    parts = summed.groupBy(key, "part").agg(F.sum(value).alias("held"))
    spread = parts.groupBy(key).agg(F.count("*").alias("parts")).where("parts > 1").select(key)
    earlier = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.join(spread, key).select(key, "part", F.sum("held").over(earlier).alias("offset")).where("offset IS NOT NULL")
    return summed.join(F.broadcast(offsets), [key, "part"], "left").withColumn(name, F.col(name) + F.coalesce("offset", F.lit(0))).drop("part", "offset")
