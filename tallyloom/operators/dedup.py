"""Choosing one row among duplicates.

Duplicates collapse inside every map task, before the shuffle: by partial aggregation, or
by the rank limit that a ``rank = 1`` filter puts below the exchange of its window. A key
with a large share of all rows then sends one row per task.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.schema import COPIES, SEQ

# Fewest mapped columns that identify a row well enough to drop others like it.
MIN_SUBSET = 3


def _pick(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*[F.col(f"`{key}`") for key in keys]).orderBy(order))
    return df.withColumn("rank", rank).where(F.col("rank") == 1).drop("rank")


def keep_last(df: DataFrame, keys: list[str]) -> DataFrame:
    """The row with the highest ``seq`` per key."""
    return _pick(df, keys, F.desc(SEQ))


def keep_first(df: DataFrame, keys: list[str]) -> DataFrame:
    """The row with the lowest ``seq`` per key."""
    return _pick(df, keys, F.asc(SEQ))


def first_by_subset(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keep the first row per key subset, but only where enough columns form it."""
    return df if len(keys) < MIN_SUBSET else keep_first(df, keys)


def distinct_rows(df: DataFrame) -> DataFrame:
    """Rows that differ in some column, nulls being equal; keeps the lowest ``seq`` of each
    and the number of ``copies`` it stands for."""
    same = [F.col(f"`{name}`") for name in df.columns if name != SEQ]
    return df.groupBy(*same).agg(F.min(SEQ).alias(SEQ), F.count("*").alias(COPIES))


def sample_per_value(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """The first row, by ``seq``, of each listed value of a column."""
    return keep_first(df.where(F.col(column).isin(values)), [column])


def valid_keys(keys: list[str]) -> Column:
    """Predicate: no key column is null or blank."""
    out = F.lit(True)
    for key in keys:  # named once each: a filter repeats the expressions behind the names
        out = out & F.coalesce(F.col(key).cast("string") != "", F.lit(False))
    return out
