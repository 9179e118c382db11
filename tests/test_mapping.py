from datetime import datetime

from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.operators import mapping as maps
from tallyloom.schema import SEQ
from tallyloom.sources.store import SalesStore
from tests.headers import HEADERS, SIGNATURE

DATES = ["Invoice Date", "Order Date", "Shipment Date", "Credit Note Date"]
NUMBERS = [h for h in HEADERS if h.endswith(("Amount", "Rate", "Tax", "Gross")) or h == "Quantity"]


def report(spark, columns):
    """Three rows: dates that parse, numbers, and text elsewhere."""
    def value(header, i):
        return f"2024-01-0{i}" if header in DATES else str(i) if header in NUMBERS else f"text {i}"

    rows = [(*[value(h, i) for h in columns], i) for i in (1, 2, 3)]
    return spark.createDataFrame(rows, [*columns, SEQ])


def mapped(spark, df):
    headers = maps.headers_of(df)
    wanted = maps.columns_to_profile([c for c in df.columns if c != SEQ])
    profiles = maps.profile(maps.cells(df, wanted)) if wanted else None
    frame = maps.auto_map(headers, profiles)
    return headers, frame, frame.first()["mappings"]


def test_signature(spark):
    df = spark.createDataFrame([(HEADERS,)], "headers array<string>")
    assert df.select(text.header_signature(F.col("headers"))).first()[0] == SIGNATURE


def test_tax_report(spark):
    headers, frame, found = mapped(spark, report(spark, HEADERS))
    assert found == {
        "order_date": "Invoice Date",
        "order_id": "Order Id",
        "sku": None,
        "asin": "Asin",
        "product_name": None,
        "quantity": "Quantity",
        "revenue_amount": "Invoice Amount",
        "shipping_amount": None,
        "transaction_type": "Transaction Type",
        "shipment_item_id": None,
        "region": None,
        "status": None,
    }
    open_fields = {r.field for r in maps.ambiguous_fields(headers, frame).collect()}
    assert open_fields == {"sku", "product_name", "shipping_amount", "shipment_item_id"}
    counts = {r.field: r["count"] for r in maps.candidates_of(headers).groupBy("field").count().collect()}
    assert counts == {
        "order_date": 4, "order_id": 1, "sku": 2, "asin": 1, "product_name": 2, "quantity": 1, "revenue_amount": 13,
        "shipping_amount": 10, "transaction_type": 1, "shipment_item_id": 2, "region": 3,
    }


def test_choice_by_values(spark):
    rows = [("x", "1", "12", "a", "5", i) for i in range(4)]
    df = spark.createDataFrame(rows, ["Invoice Amount", "Total Amount", "Qty", "Units", "Date", SEQ])
    _, _, found = mapped(spark, df)
    # The invoice column holds no numbers; the first numeric candidate is taken instead.
    assert found["revenue_amount"] == "Total Amount"
    assert found["quantity"] == "Qty"
    assert found["order_date"] == "Date"  # a single candidate is not profiled


def test_used_headers_are_out(spark):
    df = spark.createDataFrame([("1", "2", 0)], ["Item Id", "Sku", SEQ])
    _, _, found = mapped(spark, df)
    assert found["sku"] is None and found["shipment_item_id"] == "Item Id"
    df = spark.createDataFrame([("1", 0)], ["Item Id", SEQ])
    _, _, found = mapped(spark, df)
    assert found["sku"] == "Item Id" and found["shipment_item_id"] is None


def test_no_header_matches(spark):
    df = spark.createDataFrame([("1", 0)], ["zzz", SEQ])
    headers, frame, found = mapped(spark, df)
    assert set(found) == set(maps.FIELDS) and not any(found.values())
    assert maps.ambiguous_fields(headers, frame).count() == 0


def test_profile_uses_all_values(spark):
    df = spark.range(1000).select(
        F.when(F.col("id") % 2 == 0, F.when(F.col("id") < 400, "2024-01-01").otherwise("x")).alias("Date"),
        F.col("id").alias(SEQ),
    )
    row = maps.profile(maps.cells(df, ["Date"])).first()
    assert (row.sampled, row.date_ratio, row.is_date) == (500, 0.4, False)
    wide = maps.profiles_of(maps.profile_upload(df, ["Date"]))
    assert wide.first() == row


def test_date_format_choice(spark):
    def chosen(values):
        df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"Date string, {SEQ} int")
        return maps.profile(maps.cells(df, ["Date"])).first().date_format

    assert chosen(["01/02/2024", "03/04/2024"]) == "M/d/yyyy"
    assert chosen(["01/02/2024", "13/02/2024"]) == "d/M/yyyy"
    assert chosen(["2024-01-02 03:04:05"]) == "yyyy-M-d H:m:s"
    assert chosen(["x"]) is None
    assert chosen(["01/02/2024"] * 200 + ["13/02/2024"] * 300) == "d/M/yyyy"
    for text, form in [
        ("05-01-2024", "d-M-yyyy"), ("2024/01/05", "yyyy/M/d"), ("2024-01-05T10:20:30", "yyyy-M-d'T'H:m:s"),
        ("05-Jan-2024", "d-MMM-yyyy"), ("Jan 5, 2024", "MMM d, yyyy"), ("5 January 2024", "d MMMM yyyy"),
        ("January 5, 2024", "MMMM d, yyyy"), ("5 Jan 2024", "d MMM yyyy"),
    ]:
        assert chosen([text]) == form


def test_registry(spark, tmp_path):
    store = SalesStore(spark, str(tmp_path))
    headers = maps.headers_of(report(spark, HEADERS))
    assert maps.lookup(store.saved_mappings(), headers).count() == 0
    for n, sku in enumerate(["Sku", None, "Shipment Item Id"]):
        store.save_mapping(headers, {"sku": sku, "asin": "Asin"}, datetime(2024, 1, 1 + n))
    shuffled = maps.headers_of(report(spark, HEADERS[::-1]))
    found = maps.lookup(store.saved_mappings(), shuffled).collect()
    assert [(r.signature, r.mappings) for r in found] == [(SIGNATURE, {"sku": "Shipment Item Id", "asin": "Asin"})]
    assert maps.lookup(store.saved_mappings(), maps.headers_of(report(spark, ["Sku"]))).count() == 0


def test_json_form(spark):
    df = spark.createDataFrame([({"sku": None, "asin": "Asin"},)], "m map<string,string>")
    row = df.select(maps.mappings_json(F.col("m")).alias("j")).withColumn("m", maps.mappings_from_json(F.col("j")))
    assert row.first().m == {"sku": None, "asin": "Asin"}


def test_overrides():
    assert maps.apply_overrides({"sku": "A", "asin": "B"}, {"sku": None, "status": "C"}) == {
        "sku": None,
        "asin": "B",
        "status": "C",
    }
