"""All dashboard figures of one filtered set of rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import percent, rupees, thousands
from tallyloom.operators import products, revenue, trends
from tallyloom.operators.canonical import read_back
from tallyloom.sources.workspace import stage


def business_kpis(df: DataFrame, ship_col: str | None = None) -> dict[str, DataFrame]:
    """Every figure as a frame of its own.

    The rows are read four times: for the summary, the breakdown, the product totals, and the sums per
    day, status and region that the other figures come from. The latter two are staged. When ``df`` is more than a
    scan of stored rows, stage it before the call.
    """
    rows = read_back(df)
    totals = stage(products.product_totals(rows), "product-totals")
    groups = rows.groupBy("order_date", "status", "region").agg(
        F.sum("revenue_in_inr").alias("revenue_in_inr"), F.count("*").alias("rows")
    )
    groups = stage(groups, "day-groups")
    daily = trends.daily_trend(groups, "rows")
    return {
        "summary": revenue.revenue(rows, ship_col),
        "breakdown": revenue.breakdown(rows),
        "wow": trends.wow_change(daily),
        "top_products_revenue": products.top_products(totals, "revenue"),
        "top_products_units": products.top_products(totals, "units"),
        "status_breakdown": trends.status_counts(groups, "rows"),
        "region_revenue": trends.region_revenue(groups),
        "revenue_trend": daily.select(F.col("order_date").alias("date"), "revenue"),
    }


def kpi_rows(kpis: dict[str, DataFrame]) -> DataFrame:
    """The figures of ``business_kpis`` as one long frame of (kpi, item, value)."""

    def rows(kpi: str, item, value) -> DataFrame:
        return kpis[kpi].select(F.lit(kpi).alias("kpi"), item.alias("item"), value.cast("double").alias("value"))

    def wide(kpi: str, names: list[str]) -> DataFrame:
        entries = [
            F.struct(F.lit(kpi).alias("kpi"), F.lit(n).alias("item"), F.col(n).cast("double").alias("value"))
            for n in names
        ]
        return kpis[kpi].select(F.inline(F.array(*entries)))

    parts = [
        wide("summary", revenue.SUMMARY_COLUMNS),
        rows("breakdown", F.col("transaction_type"), F.col("revenue")),
        wide("wow", ["wow_revenue_change"]),
        rows("top_products_revenue", F.col("display_name"), F.col("revenue")),
        rows("top_products_units", F.col("display_name"), F.col("units")),
        rows("status_breakdown", F.col("status"), F.col("count")),
        rows("region_revenue", F.col("region"), F.col("revenue")),
        rows("revenue_trend", F.col("date").cast("string"), F.col("revenue")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def breakdown_display(breakdown: DataFrame) -> DataFrame:
    return breakdown.select(
        "transaction_type", "count", rupees(F.col("revenue")).alias("revenue_impact"), "units", "orders", "description"
    )


def products_display(top: DataFrame, measure: str) -> DataFrame:
    text = rupees(F.col(measure)) if measure == "revenue" else thousands(F.col(measure))
    return top.select(F.col("display_name").alias("product"), text.alias(measure))


def movers_display(moved: DataFrame, gains: bool) -> DataFrame:
    return moved.select(
        F.col("display_name").alias("product"),
        rupees(F.col("revenue_current")).alias("revenue"),
        percent(F.col("wow_change"), signed=gains).alias("wow_change"),
    )


def wow_text(wow: DataFrame) -> DataFrame:
    """``WoW: +12.3%``, ``WoW: 0%`` for no change, null when there is nothing to compare."""
    change = F.col("wow_revenue_change")
    return wow.select(
        F.when(change == 0, "WoW: 0%")
        .when(change.isNotNull(), F.concat(F.lit("WoW: "), percent(change, signed=True)))
        .alias("wow_text")
    )
