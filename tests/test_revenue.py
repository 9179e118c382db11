from decimal import Decimal

from pyspark.sql import functions as F

from tallyloom.operators import revenue
from tallyloom.operators.derive import add_derived

SCHEMA = (
    "order_id string, asin string, transaction_type string, revenue_in_inr decimal(18,4), "
    "shipping_amount decimal(18,4), quantity int"
)


def frame(spark, rows):
    return spark.createDataFrame([(o, a, t, Decimal(r), Decimal(s), q) for o, a, t, r, s, q in rows], SCHEMA)


def derived(df):
    return add_derived(df, F.col("revenue_in_inr"), F.col("shipping_amount"), F.col("quantity"))


ROWS = [
    ("1", "A", "Shipment", 100, 10, 2),
    ("2", "A", "Shipment", 300, 20, 1),
    ("2", "B", "Shipment", 50, 4, 5),
    ("3", "A", "Refund", -40, 7, 1),
    ("4", "A", "FreeReplacement", 0, 3, 1),
    ("5", "A", "FreeReplacement", 0, 3, 1),
    ("6", "Z", "FreeReplacement", 0, 9, 1),
    ("7", "", "FreeReplacement", 0, 9, 1),
    ("8", None, "FreeReplacement", 0, 9, 1),
    (None, "B", "Cancel", 5, 5, 1),
]


def test_summary(spark):
    row = revenue.revenue(derived(frame(spark, ROWS))).first()
    assert (row.gross_revenue, row.refunds, row.shipping_cost_loss) == (450, 40, 7)
    assert row.free_replacement_cost == 400  # two replacements of A at a mean of 200
    assert row.net_revenue == 450 - 40 - 7 - 400
    assert (row.units_sold, row.orders, row.aov) == (8, 8, 3 / 8)


def test_summary_with_shipping(spark):
    row = revenue.revenue_summary(derived(frame(spark, ROWS)), "shipping_amount").first()
    assert row.shipping_cost_loss == 7 + 2 * 2 * 15


def test_nonderived_falls_back_to_own_shipping(spark):
    row = revenue.revenue(frame(spark, ROWS)).first()
    # A: two replacements at twice the mean shipping of 15; Z has no shipment: twice its own 9.
    assert row.shipping_cost_loss == 7 + 2 * 2 * 15 + 2 * 9
    assert (row.gross_revenue, row.refunds, row.free_replacement_cost) == (450, 40, 400)
    assert (row.orders, row.units_sold) == (2, 8)
    kinds = {r.transaction_type: r for r in revenue.breakdown_nonderived(frame(spark, ROWS)).collect()}
    assert kinds["Refund"].revenue == -40 and kinds["Cancel"].revenue == 0
    assert kinds["FreeReplacement"]["count"] == 5 and kinds["FreeReplacement"].shipping_loss == 78


def test_untyped(spark):
    row = revenue.revenue(frame(spark, ROWS).drop("transaction_type")).first()
    assert (row.gross_revenue, row.net_revenue, row.orders, row.units_sold) == (415 - 0, 415, 8, 15)


def test_empty_input_is_zero(spark):
    empty = frame(spark, [])
    for found in (
        revenue.revenue(derived(empty)),
        revenue.revenue(empty),
        revenue.revenue(empty.drop("transaction_type")),
    ):
        assert [float(x) for x in found.first()] == [0.0] * 8
    assert revenue.breakdown(derived(empty)).count() == 0


def test_unknown_and_null_types(spark):
    df = derived(frame(spark, [("1", "A", "Adjustment Fee", 9, 0, 1), ("2", "A", None, 9, 0, 1)]))
    assert [(r.transaction_type, r["count"], r.revenue) for r in revenue.breakdown(df).collect()] == [
        ("Adjustment Fee", 1, 0)
    ]
