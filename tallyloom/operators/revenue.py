"""Revenue summaries.

A summary needs totals per ASIN (what a free replacement costs follows from the mean
shipment of its ASIN) and the number of distinct orders. Both come from one pass with
grouping sets: the shuffle carries partial sums per ASIN and one row per order, so hot
ASINs such as the unknown one collapse before it, and no join is needed.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom import fixed
from tallyloom.functions import values
from tallyloom.schema import MONEY

TOTAL = "decimal(38,4)"
ESTIMATE = "decimal(38,6)"
SUMMARY_COLUMNS = [
    "gross_revenue",
    "refunds",
    "free_replacement_cost",
    "shipping_cost_loss",
    "net_revenue",
    "units_sold",
    "orders",
    "aov",
]


def _zero_if_null(col: Column, kind: str) -> Column:
    return F.coalesce(col.cast(kind), F.lit(0).cast(kind))


def _per_key(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """The measures per order and per ASIN, told apart by ``by_order``."""
    return df.groupingSets(
        [[F.col("order_id")], [F.col("asin")]], F.col("order_id"), F.col("asin")
    ).agg(
        (F.grouping("order_id") == 0).alias("by_order"),
        *[measure.alias(name) for name, measure in measures.items()],
    )


def _by_asin(col: Column | str) -> Column:
    """Aggregate: total over the ASIN rows of ``_per_key``."""
    return F.sum(F.when(~F.col("by_order"), F.col(col) if isinstance(col, str) else col))


def _orders(counted: Column) -> Column:
    return F.count_if(F.col("by_order") & F.col("order_id").isNotNull() & counted)


def _replacement_measures(kind: Column, revenue: Column, shipping: Column | None) -> dict[str, Column]:
    """Free replacements, and what their ASIN's shipments bring on average."""
    shipped = kind == fixed.SHIPMENT
    replaced = (kind == fixed.FREE_REPLACEMENT) & (F.col("asin") != "")
    measures = {
        "replacements": F.count_if(replaced),
        "shipments": F.count_if(shipped),
        "priced": F.count(F.when(shipped, revenue)),
        "shipped_revenue": F.sum(F.when(shipped, revenue)),
    }
    if shipping is not None:
        measures["freighted"] = F.count(F.when(shipped, shipping))
        measures["shipped_freight"] = F.sum(F.when(shipped, shipping))
        measures["own_freight"] = F.sum(F.when(replaced, shipping))
    return measures


def _mean_times(factor: int, total: str, count: str) -> Column:
    """replacements x factor x mean, exact to six digits so that sums keep no order."""
    mean = values.ratio(F.col(total), F.col(count))
    return (F.col("replacements") * factor * mean).cast(ESTIMATE)


def _finish(totals: DataFrame) -> DataFrame:
    """Net revenue and order value of a row of totals."""
    net = (
        F.col("gross_revenue") - F.col("refunds") - F.col("shipping_cost_loss") - F.col("free_replacement_cost")
    )
    aov = F.when(F.col("orders") > 0, values.ratio(F.col("net_revenue"), F.col("orders"))).otherwise(0.0)
    return totals.withColumn("net_revenue", net).withColumn("aov", aov)


def revenue_summary(df: DataFrame, ship_col: str | None = None) -> DataFrame:
    """One row of revenue figures from the derived columns; zeros for no rows.

    A free replacement costs the mean revenue of its ASIN's shipments and, with
    ``ship_col``, twice their mean shipping; without shipments it adds nothing.
    """
    revenue, kind = F.col("revenue_calc"), F.col("transaction_type")
    shipping = F.col(ship_col) if ship_col else None
    keyed = _per_key(
        df,
        {
            "gain": F.sum(F.when(revenue > 0, revenue)),
            "loss": F.sum(F.when(revenue < 0, revenue)),
            "shipping_loss": F.sum("shipping_loss_calc"),
            "units": F.sum("units_sold_calc"),
            **_replacement_measures(kind, revenue, shipping),
        },
    )
    freight = _zero_if_null(_by_asin("shipping_loss"), ESTIMATE)
    if ship_col:
        freight = freight + _zero_if_null(_by_asin(_mean_times(2, "shipped_freight", "freighted")), ESTIMATE)
    totals = keyed.agg(
        _zero_if_null(_by_asin("gain"), TOTAL).alias("gross_revenue"),
        F.abs(_zero_if_null(_by_asin("loss"), TOTAL)).alias("refunds"),
        _zero_if_null(_by_asin(_mean_times(1, "shipped_revenue", "priced")), ESTIMATE).alias("free_replacement_cost"),
        freight.cast(ESTIMATE).alias("shipping_cost_loss"),
        _zero_if_null(_by_asin("units"), "bigint").alias("units_sold"),
        _orders(F.lit(True)).alias("orders"),
    )
    return _finish(totals).select(*SUMMARY_COLUMNS)


def breakdown(df: DataFrame) -> DataFrame:
    """Rows, revenue, units and distinct orders per transaction type."""
    return (
        df.where(F.col("transaction_type").isNotNull())
        .groupBy("transaction_type")
        .agg(
            F.count("*").alias("count"),
            F.sum("revenue_calc").alias("revenue"),
            F.sum("units_sold_calc").alias("units"),
            F.count_distinct("order_id").alias("orders"),
        )
        .withColumn("description", F.concat("transaction_type", F.lit(" transactions")))
    )


def _nonderived_totals(df: DataFrame) -> DataFrame:
    """One row of per-type totals from the stored amounts, types normalized on the fly."""
    typed = df.select(
        "order_id",
        "asin",
        values.transaction_type(F.col("transaction_type")).alias("kind"),
        F.coalesce("revenue_in_inr", F.lit(0).cast(MONEY)).alias("revenue"),
        F.coalesce("shipping_amount", F.lit(0).cast(MONEY)).alias("shipping"),
        F.coalesce("quantity", F.lit(0)).alias("units"),
    )
    kind, revenue, shipping = F.col("kind"), F.col("revenue"), F.col("shipping")
    refunded = kind == fixed.REFUND
    keyed = _per_key(
        typed,
        {
            "cancels": F.count_if(kind == fixed.CANCEL),
            "refund_rows": F.count_if(refunded),
            "replacement_rows": F.count_if(kind == fixed.FREE_REPLACEMENT),
            "refunded": F.sum(F.when(refunded, revenue)),
            "refund_freight": F.sum(F.when(refunded, shipping)),
            "shipped_units": F.sum(F.when(kind == fixed.SHIPMENT, F.col("units"))),
            **_replacement_measures(kind, revenue, shipping),
        },
    )
    matched = F.col("shipments") > 0
    freight = F.when(matched, _mean_times(2, "shipped_freight", "freighted")).otherwise(
        (F.col("own_freight") * 2).cast(ESTIMATE)
    )
    return keyed.agg(
        _zero_if_null(_by_asin("shipped_revenue"), TOTAL).alias("gross_revenue"),
        F.abs(_zero_if_null(_by_asin("refunded"), TOTAL)).alias("refunds"),
        _zero_if_null(_by_asin(_mean_times(1, "shipped_revenue", "priced")), ESTIMATE).alias("free_replacement_cost"),
        _zero_if_null(_by_asin("refund_freight"), ESTIMATE).alias("refund_freight"),
        _zero_if_null(_by_asin(freight), ESTIMATE).alias("replacement_freight"),
        _zero_if_null(_by_asin("shipped_units"), "bigint").alias("units_sold"),
        _orders(F.col("shipments") > 0).alias("orders"),
        *[
            _zero_if_null(_by_asin(name), "bigint").alias(name)
            for name in ("shipments", "cancels", "refund_rows", "replacement_rows")
        ],
    )


def revenue_nonderived(df: DataFrame) -> DataFrame:
    """``revenue_summary`` for rows without derived columns.

    Orders and units are those of shipments, refunds lose their own shipping, and a
    replacement whose ASIN has no shipment loses twice its own shipping.
    """
    totals = _nonderived_totals(df).withColumn(
        "shipping_cost_loss", F.col("refund_freight") + F.col("replacement_freight")
    )
    return _finish(totals).select(*SUMMARY_COLUMNS)


def breakdown_nonderived(df: DataFrame) -> DataFrame:
    """Breakdown of the four known types from the stored amounts; other types get no row."""

    def entry(kind: str, count: str, revenue: Column, units: Column, orders: Column, lost: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("transaction_type"),
            F.col(count).alias("count"),
            revenue.cast(ESTIMATE).alias("revenue"),
            units.cast("bigint").alias("units"),
            orders.cast("bigint").alias("orders"),
            lost.cast(ESTIMATE).alias("shipping_loss"),
            F.lit(fixed.TYPE_DESCRIPTIONS[kind]).alias("description"),
        )

    zero = F.lit(0)
    entries = F.array(
        entry(fixed.SHIPMENT, "shipments", F.col("gross_revenue"), F.col("units_sold"), F.col("orders"), zero),
        entry(fixed.CANCEL, "cancels", zero, zero, zero, zero),
        entry(fixed.REFUND, "refund_rows", -F.col("refunds"), zero, zero, F.col("refund_freight")),
        entry(
            fixed.FREE_REPLACEMENT,
            "replacement_rows",
            -F.col("free_replacement_cost"),
            zero,
            zero,
            F.col("replacement_freight"),
        ),
    )
    return _nonderived_totals(df).select(F.inline(entries)).where(F.col("count") > 0)


def revenue_untyped(df: DataFrame) -> DataFrame:
    """``revenue_summary`` for rows without a transaction type: all count as shipments."""
    totals = df.agg(
        _zero_if_null(F.sum("revenue_in_inr"), TOTAL).alias("gross_revenue"),
        _zero_if_null(F.sum("quantity"), "bigint").alias("units_sold"),
        F.count_distinct("order_id").alias("orders"),
    ).withColumns({name: F.lit(0).cast(TOTAL) for name in ("refunds", "free_replacement_cost", "shipping_cost_loss")})
    return _finish(totals).select(*SUMMARY_COLUMNS)


def breakdown_untyped(df: DataFrame) -> DataFrame:
    return df.agg(
        F.lit(fixed.SHIPMENT).alias("transaction_type"),
        F.count("*").alias("count"),
        _zero_if_null(F.sum("revenue_in_inr"), TOTAL).alias("revenue"),
        F.lit(fixed.UNTYPED_DESCRIPTION).alias("description"),
    )


def revenue(df: DataFrame, ship_col: str | None = None) -> DataFrame:
    """Revenue summary by whichever columns the rows have."""
    if {"revenue_calc", "shipping_loss_calc"} <= set(df.columns):
        return revenue_summary(df, ship_col)
    return revenue_nonderived(df) if "transaction_type" in df.columns else revenue_untyped(df)
