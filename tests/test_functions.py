"""Scalar rules against values worked out by hand."""

import random
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyloom import fixed
from tallyloom.functions import text, values


def apply(spark, expression, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [row.y for row in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def check(spark, expression, cases):
    assert apply(spark, expression, list(cases)) == list(cases.values())


def test_money(spark):
    cases = {"₹ 1,234.50": "1234.50", "$7": "7", "-5": "-5", "1e3": "1000", ".5": "0.5", " 2\t": "2", " 3": "3"}
    assert apply(spark, values.money, list(cases)) == [Decimal(v) for v in cases.values()]
    assert apply(spark, values.money, ["(5)", "abc", "", "5D", "7f", "0x10", "inf", "NaN", None]) == [None] * 9
    assert apply(spark, values.money_or_zero, ["abc", None, "4"]) == [0, 0, 4]


def test_quantity(spark):
    cases = {"3.7": 3, "-2.9": -2, "": 0, "12": 12, " 4 ": 4, "x": 0, "99999999999": 99999999999, None: 0, "1e2": 100, "₹5": 0}
    check(spark, values.quantity, cases)
    check(spark, values.missing_quantity, {"3.7": False, "": True, None: True, "x": True, "0": False})


def test_transaction_type(spark):
    cases = {
        "SHIP": "Shipment",
        " shipment ": "Shipment",
        "Cancelled": "Cancel",
        "cancellation": "Cancel",
        "refunds": "Refund",
        "free_replacement": "FreeReplacement",
        "Free Replacement": "FreeReplacement",
        "nan": None,
        "None": None,
        "": None,
        None: None,
        "adjustment fee": "Adjustment Fee",
    }
    check(spark, values.transaction_type, cases)


def test_title_case_is_pythons(spark):
    assert apply(spark, text.title_case, ["o'brien new-delhi 3rd ST"]) == ["O'Brien New-Delhi 3Rd St"]
    rng = random.Random(7)
    letters = "abcXYZ éÉñß'-_.0123\t\nЖжçŒœ日１２ａ"
    samples = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(500)]
    assert apply(spark, text.title_case, samples) == [s.title() for s in samples]


def test_strip_is_pythons(spark):
    samples = [c + "a b" + c for c in text.WHITESPACE] + ["  ", "", "​x"]
    assert apply(spark, text.strip, samples) == [s.strip() for s in samples]


def test_headers(spark):
    check(spark, text.normalize_header, {"  Order   ID ": "order id", "Sku": "sku", "A \tB": "a b"})


def test_labels(spark):
    rows = [("S", "A"), ("S", None), ("", "A"), (" ", ""), (None, None)]
    df = spark.createDataFrame(rows, "sku string, asin string").coalesce(1)
    found = [r[0] for r in df.select(text.product_label(F.col("sku"), F.col("asin"))).collect()]
    assert found == ["S (A)", "S", "Unknown (A)", "Unknown Product", "Unknown Product"]
    check(spark, text.sku_label, {"S": "S", " ": "Unknown Product", None: "Unknown Product"})


def test_formats(spark):
    def shown(expression, numbers):
        df = spark.createDataFrame([(float(n),) for n in numbers], "x double").coalesce(1)
        return [r[0] for r in df.select(expression(F.col("x"))).collect()]

    assert shown(text.rupees, [1234.5, -1234.5, 0.125]) == ["₹1,234.50", "₹-1,234.50", "₹0.12"]
    assert shown(text.percent, [0.25, -30, 1234.56]) == ["0.2%", "-30.0%", "1234.6%"]
    assert shown(text.percent, ["inf", "-inf"]) == ["inf%", "-inf%"]
    assert shown(lambda c: text.percent(c, signed=True), [12.34, -3, 0]) == ["+12.3%", "-3.0%", "+0.0%"]
    assert shown(text.thousands, [1234567]) == ["1,234,567"]


@pytest.mark.parametrize(
    ("form", "given", "expected"),
    [
        ("yyyy-M-d", ["2024-01-05", " 2024-1-5 ", "2024-01", "2024-01-05 10:00:00", "2024-02-30", "x", None], 2),
        ("M/d/yyyy", ["01/05/2024", "13/02/2024", "1/5/2024"], None),
        ("d/M/yyyy", ["05/01/2024"], None),
        ("d MMM yyyy", ["5 Jan 2024", "2024-01-05"], None),
        ("yyyy-M-d H:m:s", ["2024-01-05 10:11:12"], None),
    ],
)
def test_dates(spark, form, given, expected):
    found = apply(spark, lambda c: values.parse_date(c, form), given)
    assert found[0] == date(2024, 1, 5)
    if expected:
        assert [d is not None for d in found] == [i < expected for i in range(len(given))]
    assert form in fixed.DATE_FORMATS


def test_weeks_and_months(spark):
    days = {"2024-01-07": date(2024, 1, 1), "2024-01-08": date(2024, 1, 8)}
    check(spark, lambda c: values.week_start(c.cast("date")), days)
    check(spark, lambda c: values.month_tag(c.cast("date")), {"2024-02-29": "2024-02"})


def test_placeholders_and_keys(spark):
    fill = lambda c: values.placeholder(c, "UNKNOWN_SKU")
    check(spark, fill, {None: "UNKNOWN_SKU", "nan": "UNKNOWN_SKU", "": "UNKNOWN_SKU", "None": "None", "a": "a"})
    check(spark, values.key_text, {" ab-1 ": "AB-1", "x": "X", "  ": None})


def test_percent_change(spark):
    rows = [(10, 0), (-10, 0), (0, 0), (150, 100), (-100, -50)]
    df = spark.createDataFrame(rows, "cur int, prev int").coalesce(1)
    found = [r[0] for r in df.select(values.percent_change(F.col("cur"), F.col("prev"))).collect()]
    assert found == [float("inf"), float("-inf"), None, 50.0, 100.0]


def test_row_hash_counts_equal_rows(spark):
    one = spark.createDataFrame([("a", None), ("b", "c")], "x string, y string")
    hashed = lambda df: df.agg(values.row_hash_sum(F.col("x"), F.col("y"))).first()[0]
    assert hashed(one) == hashed(one.orderBy(F.desc("x")))
    assert hashed(one) != hashed(one.unionByName(one))
