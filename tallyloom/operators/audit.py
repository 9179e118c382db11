"""Health, reconciliation and profile reports over sales rows."""

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom import fixed
from tallyloom.operators import filters
from tallyloom.operators.dedup import sample_per_value
from tallyloom.schema import DERIVED_COLUMNS, UPSERT_KEYS

KNOWN_TYPES = [fixed.SHIPMENT, fixed.REFUND, fixed.FREE_REPLACEMENT, fixed.CANCEL]


def table_summary(df: DataFrame) -> DataFrame:
    """Rows, date range and number of distinct sources."""
    return df.agg(
        F.count("*").alias("total_rows"),
        F.min("order_date").alias("date_range_start"),
        F.max("order_date").alias("date_range_end"),
        F.count_distinct("data_source").alias("data_sources"),
    )


def data_health(df: DataFrame) -> DataFrame:
    """Rows, distinct upsert keys and date range."""
    return df.agg(
        F.count("*").alias("total_rows"),
        F.count_distinct(*UPSERT_KEYS).alias("unique_keys"),
        F.min("order_date").alias("date_range_start"),
        F.max("order_date").alias("date_range_end"),
    )


def value_counts(df: DataFrame, column: str, with_null: bool = True) -> DataFrame:
    """Rows per value, most frequent first; the null value counts too unless told not to."""
    rows = df if with_null else df.where(F.col(column).isNotNull())
    return rows.groupBy(column).count().orderBy(F.desc("count"), column)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def null_types(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.col("transaction_type").isNull()).alias("null_types"))


def reconcile_amounts(df: DataFrame, amount: str = "revenue_in_inr") -> DataFrame:
    """Original against derived revenue per type."""
    return df.groupBy("transaction_type").agg(
        F.sum(amount).alias("original_amount"), F.sum("revenue_calc").alias("derived_revenue")
    )


def sign_distribution(df: DataFrame) -> DataFrame:
    """How many derived revenues are positive, negative and zero, their total, and whether
    all of them are zero."""
    revenue = F.col("revenue_calc")
    return df.agg(
        F.count_if(revenue > 0).alias("positive_rows"),
        F.count_if(revenue < 0).alias("negative_rows"),
        F.count_if(revenue == 0).alias("zero_rows"),
        F.sum(revenue).alias("total_revenue"),
        (F.coalesce(F.sum(F.abs(revenue)), F.lit(0)) == 0).alias("all_zero"),
    )


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, type, non_null, total) of the columns; only numbers have a total."""
    numeric = [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]
    flat = df.agg(
        *[F.count(c).alias(f"count_{i}") for i, c in enumerate(columns)],
        *[F.sum(c).cast("decimal(38,4)").alias(f"sum_{i}") for i, c in enumerate(columns) if c in numeric],
    )
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(df.schema[c].dataType.simpleString()).alias("type"),
            F.col(f"count_{i}").alias("non_null"),
            (F.col(f"sum_{i}") if c in numeric else F.lit(None).cast("decimal(38,4)")).alias("total"),
        )
        for i, c in enumerate(columns)
    ]
    return flat.select(F.inline(F.array(*entries)))


def derived_totals(df: DataFrame) -> DataFrame:
    return df.agg(
        F.sum("revenue_calc").alias("revenue_calc"),
        F.sum("shipping_loss_calc").alias("shipping_loss_calc"),
        F.sum("units_sold_calc").alias("units_sold_calc"),
        F.min("order_date").alias("min_date"),
        F.max("order_date").alias("max_date"),
    )


def totals_by_type(df: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    """Per type: rows, rows inside the date range (without one, all dated rows), derived
    totals and date range, in one pass."""
    day = F.col("order_date")
    inside = day.isNotNull() if start is None or end is None else day.between(F.lit(start), F.lit(end))
    return df.groupBy("transaction_type").agg(
        F.count("*").alias("rows"),
        F.count_if(inside).alias("rows_in_range"),
        F.sum("revenue_calc").alias("revenue_calc"),
        F.sum("shipping_loss_calc").alias("shipping_loss_calc"),
        F.sum("units_sold_calc").alias("units_sold_calc"),
        F.min(day).alias("min_date"),
        F.max(day).alias("max_date"),
    )


def sample_per_type(df: DataFrame) -> DataFrame:
    """The first row of each of the four known types."""
    return sample_per_value(df, "transaction_type", KNOWN_TYPES)


def sample_rows(df: DataFrame, rows: int = 5, columns: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Some rows; with ``order`` always the same ones."""
    picked = df.orderBy(*order).limit(rows) if order else df.limit(rows)
    return picked.select(*columns) if columns else picked


def overall_totals(df: DataFrame) -> DataFrame:
    """One row: signed revenue, distinct orders and units of all rows."""
    return df.agg(
        F.sum("revenue_in_inr").alias("total_revenue"),
        F.count_distinct("order_id").alias("total_orders"),
        F.sum("quantity").alias("total_units"),
    )
