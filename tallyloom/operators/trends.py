"""Daily, status and region figures, and the week-over-week change."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom import fixed
from tallyloom.functions import values


def _rows(weight: str | None) -> Column:
    """Aggregate: rows, or what groups of rows stand for."""
    return F.count("*") if weight is None else F.sum(weight)


def daily_trend(df: DataFrame, weight: str | None = None) -> DataFrame:
    """Signed revenue and rows per day, of rows or of groups that stand for ``weight`` rows."""
    return (
        df.where(F.col("order_date").isNotNull())
        .groupBy("order_date")
        .agg(F.sum("revenue_in_inr").alias("revenue"), _rows(weight).alias("rows"))
    )


def wow_change(daily: DataFrame) -> DataFrame:
    """One row: the last week up to the last day against the seven days before it.

    Works on the daily trend, whose size is bounded by the calendar: it is gathered into
    one array, and both windows are sums over it. The current window has eight days, both
    its ends included. The change is null without previous rows, 0 when they sum to no gain.
    """
    gathered = daily.agg(
        F.max("order_date").alias("last_day"),
        F.collect_list(F.struct("order_date", "revenue", "rows")).alias("days"),
    )
    start = F.date_sub(F.col("last_day"), 7)

    def total(field: str, kind: str, inside) -> Column:
        days = F.filter("days", lambda day: inside(day["order_date"]))
        return F.aggregate(days, F.lit(0).cast(kind), lambda acc, day: (acc + day[field]).cast(kind))

    def is_current(day: Column) -> Column:
        return day >= start

    def is_previous(day: Column) -> Column:
        return (day >= F.date_sub(start, 7)) & (day < start)

    change = F.when(F.col("previous_rows") == 0, None).otherwise(
        F.when(
            F.col("previous_revenue") > 0,
            values.percent_change(F.col("current_revenue"), F.col("previous_revenue")),
        ).otherwise(0.0)
    )
    return gathered.select(
        "last_day",
        total("revenue", "decimal(38,4)", is_current).alias("current_revenue"),
        total("revenue", "decimal(38,4)", is_previous).alias("previous_revenue"),
        total("rows", "bigint", is_previous).alias("previous_rows"),
    ).withColumn("wow_revenue_change", change)


def status_counts(df: DataFrame, weight: str | None = None) -> DataFrame:
    counts = df.where(F.col("status").isNotNull()).groupBy("status").agg(_rows(weight).alias("count"))
    return counts.orderBy(F.desc("count"), "status")


def region_revenue(df: DataFrame, k: int = fixed.TOP_REGIONS) -> DataFrame:
    """Best regions by signed revenue; spellings are unified on the grouped regions only."""
    spelled = df.where(F.col("region").isNotNull()).groupBy("region").agg(F.sum("revenue_in_inr").alias("revenue"))
    return (
        spelled.groupBy(values.region(F.col("region")).alias("region"))
        .agg(F.sum("revenue").alias("revenue"))
        .orderBy(F.desc("revenue"), "region")
        .limit(k)
    )
