"""Product totals, rankings and week-over-week movers."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom import fixed
from tallyloom.functions import values
from tallyloom.functions.text import product_label, sku_label
from tallyloom.sources.workspace import stage


def product_totals(df: DataFrame, by_asin: bool = True) -> DataFrame:
    """Derived revenue and units per (sku, asin), or per sku; rows without a key are left out."""
    keys = ["sku", "asin"] if by_asin else ["sku"]
    label = product_label(F.col("sku"), F.col("asin")) if by_asin else sku_label(F.col("sku"))
    return (
        df.na.drop(subset=keys)
        .groupBy(*keys)
        .agg(F.sum("revenue_calc").alias("revenue"), F.sum("units_sold_calc").alias("units"))
        .withColumn("display_name", label)
    )


def top_products(totals: DataFrame, measure: str = "revenue", k: int = fixed.TOP_PRODUCTS) -> DataFrame:
    """The ``k`` best products; equal ones are ordered by key."""
    keys = [name for name in ("sku", "asin") if name in totals.columns]
    return totals.orderBy(F.desc(measure), *keys).limit(k)


def top_by_revenue(df: DataFrame, k: int = 5, by_asin: bool = True) -> DataFrame:
    """Ranking over rows with a SKU, an absent ASIN forming its own product."""
    keys = ["sku", "asin"] if by_asin else ["sku"]
    totals = df.where(F.col("sku").isNotNull()).groupBy(*keys).agg(F.sum("revenue_calc").alias("revenue"))
    return top_products(totals, k=k)


def best_product(df: DataFrame, by_asin: bool = True) -> DataFrame:
    return top_products(product_totals(df, by_asin), k=1)


def weekly_products(df: DataFrame, by_asin: bool = True) -> DataFrame:
    """Signed revenue and quantity per week, sku and asin (null when grouped by sku only)."""
    keys = ["sku", "asin"] if by_asin else ["sku"]
    out = (
        df.na.drop(subset=["order_date", *keys])
        .groupBy(values.week_start(F.col("order_date")).alias("week"), *keys)
        .agg(F.sum("revenue_in_inr").alias("revenue"), F.sum("quantity").alias("quantity"))
    )
    return out if by_asin else out.withColumn("asin", F.lit(None).cast("string"))


def last_two_weeks(df: DataFrame, by_asin: bool = True) -> DataFrame:
    """Weekly products of the last week with sales and the calendar week before it.

    The last week is a scalar subquery over the dates, so the heavy grouping reads two
    weeks only (and, on stored rows, their months only).
    """
    keys = ["sku", "asin"] if by_asin else ["sku"]
    dated = df.na.drop(subset=["order_date", *keys])
    last_week = values.week_start(dated.agg(F.max("order_date")).scalar())
    recent = dated.where(F.col("order_date") >= F.date_sub(last_week, 7))
    if "month_tag" in df.columns:
        recent = recent.where(F.col("month_tag") >= values.month_tag(F.date_sub(last_week, 7)))
    is_current = F.col("week") == last_week
    return weekly_products(recent, by_asin).withColumn("is_current", is_current)


def compare_weeks(two_weeks: DataFrame) -> DataFrame:
    """Every current product against the same product of the previous week.

    Products are matched on SKU and ASIN (absent ones being equal), so a product gives one row at most
    however many ASINs share its SKU. ``two_weeks`` is read twice and should be staged.
    """
    current = two_weeks.where("is_current").select(
        "sku", "asin", F.col("revenue").alias("revenue_current"), F.col("quantity").alias("quantity_current")
    )
    previous = two_weeks.where("NOT is_current").select(
        F.col("sku").alias("previous_sku"),
        F.col("asin").alias("previous_asin"),
        F.col("revenue").alias("revenue_previous"),
        F.col("quantity").alias("quantity_previous"),
    )
    same = (F.col("sku") == F.col("previous_sku")) & F.col("asin").eqNullSafe(F.col("previous_asin"))
    return (
        current.join(previous, same)
        .drop("previous_sku", "previous_asin")
        .withColumn("wow_change", values.percent_change(F.col("revenue_current"), F.col("revenue_previous")))
        .withColumn("display_name", product_label(F.col("sku"), F.col("asin")))
    )


def fast_movers(compared: DataFrame, min_units: int = fixed.MOVER_UNITS) -> DataFrame:
    """Products that gained at least 30 % and sold ``min_units`` this week, best first."""
    return _moved(
        compared, (F.col("wow_change") >= fixed.MOVER_CHANGE) & (F.col("quantity_current") >= min_units)
    ).orderBy(F.desc("wow_change"), "display_name")


def decliners(compared: DataFrame, min_units: int = fixed.MOVER_UNITS) -> DataFrame:
    """Products that lost at least 30 % and sold ``min_units`` last week, worst first."""
    return _moved(
        compared, (F.col("wow_change") <= -fixed.MOVER_CHANGE) & (F.col("quantity_previous") >= min_units)
    ).orderBy("wow_change", "display_name")


def _moved(compared: DataFrame, test: Column) -> DataFrame:
    return compared.where(test).select("display_name", "revenue_current", "wow_change")


def movers(df: DataFrame, min_units: int = fixed.MOVER_UNITS, by_asin: bool = True) -> tuple[DataFrame, DataFrame]:
    """(decliners, fast movers) of the last two weeks in the rows."""
    compared = compare_weeks(stage(last_two_weeks(df, by_asin), "two-weeks"))
    return decliners(compared, min_units), fast_movers(compared, min_units)
