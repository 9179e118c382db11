from tallyloom.operators import cleaning

MAPPING = {"order_date": "Date", "order_id": "Id", "sku": "Sku", "quantity": "Qty", "revenue_amount": "Amount",
           "transaction_type": "Type"}
ROWS = [
    ("2024-01-01", "1", "s", "2", "10", "ship", 0),
    ("2024-01-01", "1 ", "S", "2", "10", "Shipment", 1),
    ("2024-01-01", "1", "s", "3", "10", "ship", 2),
    ("2024-01-01", "2", "s", "", "", "refund", 3),
    ("2024-01-01", "3", "s", "1", "-5", "refund", 4),
    ("x", "4", "s", "1", "5", "nan", 5),
    (None, None, None, None, None, None, 6),
]
SCHEMA = "Date string, Id string, Sku string, Qty string, Amount string, Type string, seq int"


def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_exact_duplicates_only(spark):
    kept = cleaning.clean_upload(rows(spark), MAPPING, "yyyy-M-d")
    # Rows 0 and 1 are equal once cleaned, although their ids and types were spelled apart.
    assert sorted((r.seq, r.copies) for r in kept.collect()) == [(0, 2), (2, 1), (3, 1), (4, 1), (5, 1), (6, 1)]
    report = cleaning.cleaning_report(kept, MAPPING).first()
    assert (report.total_rows_read, report.rows_kept, report.null_types, report.missing_order_date) == (7, 6, 2, 2)


def test_strict(spark):
    kept = cleaning.strict_clean(rows(spark), MAPPING, "yyyy-M-d")
    assert sorted((r.seq, r.Qty, r.missing_quantity_flag) for r in kept.collect()) == [
        (0, 2, False),
        (3, 0, True),
        (4, 1, False),
    ]
    report = cleaning.strict_report(rows(spark), MAPPING, "yyyy-M-d").first().asDict()
    assert report == {
        "total_rows_read": 7, "rows_without_keys": 2, "missing_order_id": 1, "missing_sku": 1,
        "missing_order_date": 2, "missing_quantities": 2, "rows_kept": 3, "duplicates_found": 2,
        "negative_amounts": 1, "negative_refunds": 1,
    }


def test_few_mapped_columns_keep_all(spark):
    few = {"order_id": "Id", "sku": "Sku"}
    assert cleaning.strict_clean(rows(spark), few, "yyyy-M-d").count() == 6


def test_empty_rows(spark):
    assert cleaning.drop_empty(rows(spark)).count() == 6


def test_problem_rows(spark):
    cells = cleaning.clean_cells(rows(spark), MAPPING, "yyyy-M-d", strict=True)
    found = cleaning.problem_rows(cells, MAPPING).collect()
    assert [(r.seq, r.issues, r.Id) for r in found] == [(3, ["Zero revenue", "Zero quantity"], "2")]


def test_unmapped_upload(spark):
    kept = cleaning.clean_upload(rows(spark).select("Id", "seq"), {}, "yyyy-M-d")
    assert {(r.transaction_type, r.revenue_calc, r.needs_estimation) for r in kept.collect()} == {(None, 0, False)}
