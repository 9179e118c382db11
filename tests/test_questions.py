from datetime import date
from decimal import Decimal

from tallyloom import fixed
from tallyloom.plans import dashboard, questions

ROUTES = [
    ("Revenue so far, please", "numeric", "revenue", 0),
    ("Count of orders in the table", "numeric", "orders", 0),
    ("Sum of units shipped", "numeric", "units", 0),
    ("List the top 3 products", "numeric", "top products", 3),
    ("Give me the top 10 items", "numeric", "top products", 10),
    ("Top products", "numeric", "top products", 5),
    ("The top SKUs when ranked by revenue", "numeric", "revenue", 0),
    ("Show the top 30 products", "numeric", "top products", 3),
    ("Name the best one", "numeric", "not understood", 0),
    ("A total of what?", "numeric", "not understood", 0),
    ("Is performance fine?", "descriptive", "totals", 0),
    ("Any trend, declining or not", "descriptive", "totals", 0),
    ("Anything declining at all?", "descriptive", "declines", 0),
    ("Did something drop lately?", "descriptive", "declines", 0),
    ("Good morning", "descriptive", "summary", 0),
]
SCHEMA = (
    "order_date date, order_id string, sku string, asin string, quantity int, revenue_in_inr decimal(18,4), "
    "shipping_amount decimal(18,4), transaction_type string, region string, status string, "
    "revenue_calc decimal(18,4), shipping_loss_calc decimal(18,4), units_sold_calc int"
)


def sales(spark, rows):
    data = [
        (date(2024, 1, 1), o, s, a, 2, Decimal(r), Decimal(0), "Shipment", "pune", "ok", Decimal(r), Decimal(0), 2)
        for o, s, a, r in rows
    ]
    return spark.createDataFrame(data, SCHEMA)


def asked(spark):
    return spark.createDataFrame([(i, row[0]) for i, row in enumerate(ROUTES)], "question_id int, text string")


def test_routes(spark):
    found = questions.route(asked(spark)).orderBy("question_id").collect()
    assert [(r.text, r["class"], r.intent, r.k) for r in found] == ROUTES


def test_answers(spark):
    rows = sales(spark, [("1", "a", "X", 1000), ("1", "b", None, 250), ("2", "a", "X", "0.5")])
    found = {r.text: r.answer for r in questions.answer(asked(spark), rows).collect()}
    assert len(found) == len(ROUTES)
    assert found["Count of orders in the table"] == "**Total Orders:** 2"
    assert found["Sum of units shipped"] == "**Total Units Sold:** 6"
    assert found["List the top 3 products"] == "**Top Products by Revenue:**\n1. a (X): ₹1,000.50\n2. b: ₹250.00\n"
    assert found["Did something drop lately?"] == fixed.NO_TIME_SERIES
    assert found["Name the best one"] == fixed.NOT_UNDERSTOOD
    assert found["Good morning"] == "Here's a summary: 2 orders totaling ₹1,250.50 in revenue."
    assert found["Any trend, declining or not"] == (
        "Based on the data: Total revenue is ₹1,250.50, with 2 orders and 6 units sold."
    )
    assert found["Revenue so far, please"].splitlines()[1] == "• **Net Revenue:** ₹1,250.50"


def test_no_data(spark):
    found = {r.text: r.answer for r in questions.answer(asked(spark), sales(spark, [])).collect()}
    assert found["Good morning"] == found["Is performance fine?"] == fixed.NO_DATA
    assert found["Count of orders in the table"] == "**Total Orders:** 0"
    assert found["Revenue so far, please"] == found["List the top 3 products"] == fixed.NOT_UNDERSTOOD


def test_displays(spark):
    kpis = dashboard.business_kpis(sales(spark, [("1", "a", "X", 1000)]))
    top = dashboard.products_display(kpis["top_products_revenue"], "revenue").first()
    assert tuple(top) == ("a (X)", "₹1,000.00")
    assert dashboard.products_display(kpis["top_products_units"], "units").first()[1] == "2"
    assert dashboard.wow_text(kpis["wow"]).first().wow_text is None
    assert dashboard.breakdown_display(kpis["breakdown"]).first().revenue_impact == "₹1,000.00"
    assert kpis["region_revenue"].first().region == "Pune"
    same = kpis["wow"].selectExpr("CAST(0 AS DOUBLE) AS wow_revenue_change")
    assert dashboard.wow_text(same).first().wow_text == "WoW: 0%"
