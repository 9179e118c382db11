"""Keyword-routed questions over the sales rows, as a table job."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom import fixed
from tallyloom.functions.text import product_label, rupees, thousands
from tallyloom.operators.products import top_by_revenue
from tallyloom.operators.revenue import revenue

TOP_SIZES = [3, 5, 10]


def _mentions(text: Column, *words: str) -> Column:
    return reduce(or_, [text.contains(word) for word in words])


def route(questions: DataFrame) -> DataFrame:
    """Add class, intent and, for top-product questions, ``k`` to rows with a ``text``.

    Tests run in a fixed order and the first match decides, so "top 30" is read as 3 and a
    question about top SKUs by revenue as one about revenue.
    """
    text = F.lower("text")
    numeric = _mentions(text, *fixed.NUMERIC_WORDS)
    top = _mentions(text, "top") & _mentions(text, *fixed.PRODUCT_WORDS)
    intent = (
        F.when(numeric & _mentions(text, *fixed.REVENUE_ROUTE), "revenue")
        .when(numeric & _mentions(text, *fixed.ORDERS_ROUTE), "orders")
        .when(numeric & _mentions(text, *fixed.UNITS_ROUTE), "units")
        .when(numeric & top, "top products")
        .when(numeric, "not understood")
        .when(_mentions(text, *fixed.TOTALS_ROUTE), "totals")
        .when(_mentions(text, *fixed.DECLINES_ROUTE), "declines")
        .otherwise("summary")
    )
    k = F.when(_mentions(text, "top 3"), 3).when(_mentions(text, "top 10"), 10).otherwise(5)
    return questions.withColumns(
        {
            "class": F.when(numeric, "numeric").otherwise("descriptive"),
            "intent": intent,
            "k": F.when(intent == "top products", k).otherwise(0),
        }
    )


def answers(df: DataFrame) -> DataFrame:
    """(intent, k, answer) for every intent over the sales rows: fewer than a dozen rows.

    Ranked products are the largest ``k`` only, so gathering them is bounded. ``df`` is read several times and should be
    staged if it is more than a scan. Without rows, revenue and product questions are not understood.
    """
    money = revenue(df).select(
        F.format_string(
            fixed.REVENUE_ANSWER,
            *[
                rupees(F.col(name).cast("decimal(38,2)"))
                for name in ("net_revenue", "gross_revenue", "refunds", "free_replacement_cost")
            ],
        ).alias("revenue")
    )
    plain = df.agg(
        F.coalesce(F.sum("revenue_in_inr"), F.lit(0)).alias("total"),
        F.count_distinct("order_id").alias("orders"),
        F.coalesce(F.sum("quantity"), F.lit(0)).alias("units"),
        F.count("*").alias("rows"),
    )
    total, orders, units = rupees(F.col("total").cast("decimal(38,2)")), F.col("orders"), F.col("units")

    def described(text: Column) -> Column:
        return F.when(F.col("rows") > 0, text).otherwise(fixed.NO_DATA)

    def entry(intent: str, answer: Column, k: int = 0) -> Column:
        return F.struct(F.lit(intent).alias("intent"), F.lit(k).alias("k"), answer.alias("answer"))

    texts = plain.select(
        F.inline(
            F.array(
                entry("orders", F.concat(F.lit(fixed.ORDERS_ANSWER), thousands(orders))),
                entry("units", F.concat(F.lit(fixed.UNITS_ANSWER), thousands(units))),
                entry("not understood", F.lit(fixed.NOT_UNDERSTOOD)),
                entry(
                    "totals",
                    described(
                        F.format_string(
                            fixed.TOTALS_ANSWER,
                            total,
                            orders.cast("string"),
                            units.cast("string"),
                        )
                    ),
                ),
                entry("declines", described(F.lit(fixed.NO_TIME_SERIES))),
                entry(
                    "summary",
                    described(
                        F.format_string(
                            fixed.SUMMARY_ANSWER, orders.cast("string"), total
                        )
                    ),
                ),
            )
        )
    )
    ranked = top_by_revenue(df, max(TOP_SIZES)).agg(
        F.array_sort(
            F.collect_list(
                F.struct((-F.col("revenue")).alias("low_first"), "sku", F.coalesce("asin", F.lit("")).alias("asin"))
            )
        ).alias("best")
    )

    def listing(k: int) -> Column:
        lines = F.transform(
            F.slice("best", 1, k),
            lambda item, i: F.concat(
                (i + 1).cast("string"),
                F.lit(". "),
                product_label(item["sku"], item["asin"]),
                F.lit(": "),
                rupees((-item["low_first"]).cast("decimal(38,2)")),
            ),
        )
        text = F.concat(F.lit(fixed.PRODUCTS_ANSWER), F.array_join(lines, "\n"), F.lit("\n"))
        return F.when(F.size("best") > 0, text).otherwise(fixed.NOT_UNDERSTOOD)

    tops = ranked.select(F.inline(F.array(*[entry("top products", listing(k), k) for k in TOP_SIZES])))
    revenue_row = money.select(
        F.lit("revenue").alias("intent"),
        F.lit(0).alias("k"),
        F.when(plain.select("rows").scalar() > 0, F.col("revenue")).otherwise(fixed.NOT_UNDERSTOOD).alias("answer"),
    )
    return texts.unionByName(tops).unionByName(revenue_row)


def answer(questions: DataFrame, df: DataFrame) -> DataFrame:
    """Questions with their answers. The answer table has one row per intent and size, so it
    is broadcast and a popular intent needs no shuffle."""
    return route(questions).join(F.broadcast(answers(df)), ["intent", "k"], "left")
