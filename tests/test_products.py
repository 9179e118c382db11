import random
from collections import defaultdict
from datetime import date, timedelta
from decimal import Decimal

from tallyloom.operators import products, trends

SCHEMA = (
    "order_date date, sku string, asin string, revenue_in_inr decimal(18,4), quantity int, "
    "revenue_calc decimal(18,4), units_sold_calc int"
)
MONDAY = date(2024, 1, 8)


def frame(spark, rows):
    return spark.createDataFrame([(d, s, a, Decimal(r), q, Decimal(r), q) for d, s, a, r, q in rows], SCHEMA)


def test_movers_from_nothing(spark):
    before, now = MONDAY - timedelta(days=7), MONDAY
    rows = []
    for sku, previous, current in [("up", 0, 10), ("down", 0, -10), ("flat", 0, 0), ("half", 100, 40), ("few", 10, 90)]:
        units = 2 if sku == "few" else 50
        rows += [(before, sku, "A", previous, units), (now, sku, "A", current, units)]
    declined, moved = products.movers(frame(spark, rows))
    assert [(r.display_name, r.wow_change) for r in declined.collect()] == [
        ("down (A)", float("-inf")),
        ("half (A)", -60.0),
    ]
    assert [(r.display_name, r.wow_change) for r in moved.collect()] == [("up (A)", float("inf"))]


def test_movers_need_both_weeks(spark):
    rows = [(MONDAY, "s", "A", 10, 20), (MONDAY - timedelta(days=14), "s", "A", 1, 20)]
    assert [df.count() for df in products.movers(frame(spark, rows))] == [0, 0]
    assert [df.count() for df in products.movers(frame(spark, []))] == [0, 0]


def test_many_asins_of_a_sku_match_one_to_one(spark):
    rows = [(MONDAY - timedelta(days=7 * week), "HOT", f"A{n}", 10 + n, 20) for week in (0, 1) for n in range(300)]
    assert products.compare_weeks(products.last_two_weeks(frame(spark, rows))).count() == 300


def test_movers_against_brute_force(spark):
    rng = random.Random(3)
    rows = [
        (MONDAY - timedelta(days=rng.randint(0, 13) - 6), "HOT" if i % 3 else f"S{i % 40}", f"A{rng.randint(0, 700)}",
         rng.randint(-50, 200), rng.randint(0, 30))
        for i in range(4000)
    ]
    weekly = defaultdict(lambda: [0, 0])
    for day, sku, asin, amount, units in rows:
        week = day - timedelta(days=day.weekday())
        weekly[week, sku, asin][0] += amount
        weekly[week, sku, asin][1] += units
    last = max(week for week, *_ in weekly)
    before = last - timedelta(days=7)
    expected = [
        (sku, asin, now[0], weekly[before, sku, asin][0])
        for (week, sku, asin), now in list(weekly.items())
        if week == last and (before, sku, asin) in weekly
    ]
    two_weeks = products.last_two_weeks(frame(spark, rows))
    found = products.compare_weeks(two_weeks).select("sku", "asin", "revenue_current", "revenue_previous").collect()
    assert sorted(map(tuple, found)) == sorted(expected)
    by_sku = products.compare_weeks(products.last_two_weeks(frame(spark, rows), by_asin=False))
    assert by_sku.groupBy("sku").count().where("count > 1").isEmpty() and by_sku.count() > 30


def test_ties_and_null_keys(spark):
    rows = [(MONDAY, "b", "A", 5, 1), (MONDAY, "a", "B", 5, 1), (MONDAY, "a", "A", 5, 1), (MONDAY, None, "A", 9, 1)]
    df = frame(spark, rows)
    top = products.top_products(products.product_totals(df), k=2).collect()
    assert [(r.sku, r.asin) for r in top] == [("a", "A"), ("a", "B")]
    assert products.best_product(df, by_asin=False).first().display_name == "a"


def test_wow_windows(spark):
    last = date(2024, 3, 15)
    # The current window takes in day -7, the previous one days -14 to -8.
    rows = [(last - timedelta(days=n), "s", "A", 10**i, 1) for i, n in enumerate([0, 7, 8, 14, 15])]
    row = trends.wow_change(trends.daily_trend(frame(spark, rows))).first()
    assert (row.current_revenue, row.previous_revenue, row.previous_rows) == (11, 1100, 2)
    assert row.wow_revenue_change == (11 - 1100) / 1100 * 100


def test_wow_without_previous(spark):
    def change(rows):
        return trends.wow_change(trends.daily_trend(frame(spark, rows))).first().wow_revenue_change

    assert change([(MONDAY, "s", "A", 1, 1)]) is None
    assert change([(MONDAY, "s", "A", 1, 1), (MONDAY - timedelta(days=9), "s", "A", -5, 1)]) == 0
    assert change([]) is None
