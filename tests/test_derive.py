from decimal import Decimal

from pyspark.sql import functions as F

from tallyloom.operators.derive import add_derived

# type, amount, shipping, quantity -> revenue, shipping loss, units, needs estimation
CASES = [
    ("Shipment", "1250.0", "50.0", 2, "1250.0", "0", 2, False),
    ("Shipment", "899.0", "0", 1, "899.0", "0", 1, False),
    ("Refund", "-450.0", "30.0", 1, "-450.0", "30.0", 0, False),
    ("Refund", "450.0", "-30.0", 1, "-450.0", "30.0", 0, False),
    ("Refund", None, "30.0", 1, "0", "0", 0, False),
    ("Shipment", "-100.0", "0", 3, "100.0", "0", 3, False),
    ("Shipment", None, "0", 3, "0", "0", 0, False),
    ("Cancel", "500.0", "20.0", 1, "0", "0", 0, False),
    ("FreeReplacement", "500.0", "20.0", 1, "0", "0", 0, True),
    ("Adjustment Fee", "500.0", "20.0", 1, "0", "0", 0, False),
    (None, "500.0", "20.0", 1, "0", "0", 0, False),
]


def rows(spark):
    data = [(i, t, a and Decimal(a), Decimal(s), q) for i, (t, a, s, q, *_) in enumerate(CASES)]
    return spark.createDataFrame(
        data, "i int, transaction_type string, amount decimal(18,4), shipping decimal(18,4), qty int"
    )


def test_by_type(spark):
    found = add_derived(rows(spark), F.col("amount"), F.col("shipping"), F.col("qty")).orderBy("i").collect()
    for row, case in zip(found, CASES):
        expected = (Decimal(case[4]), Decimal(case[5]), case[6], case[7])
        assert tuple(row)[-4:] == expected, case


def test_without_amount_all_zero(spark):
    found = add_derived(rows(spark), None).select("revenue_calc", "units_sold_calc", "needs_estimation").distinct()
    assert [tuple(r) for r in found.collect()] == [(0, 0, False)]


def test_without_shipping_and_quantity(spark):
    found = add_derived(rows(spark), F.col("amount")).agg(F.sum("shipping_loss_calc"), F.sum("units_sold_calc"))
    assert tuple(found.first()) == (0, 0)
