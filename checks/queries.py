"""Registered queries: each takes (spark, folder of the tables) and returns a DataFrame."""

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom import fixed
from tallyloom.functions import text, values
from tallyloom.operators import (
    audit,
    canonical,
    cleaning,
    dedup,
    filters,
    mapping,
    products,
    revenue,
    trends,
    upsert,
)
from tallyloom.plans import dashboard, ingest, questions
from tallyloom.schema import COPIES, SEQ
from tallyloom.sources import star, uploads
from tallyloom.sources.store import SalesStore, query_sales
from tallyloom.sources.workspace import Scratch, new_path, shuffles_freed, stage

RAW, FACTS = star.RAW_MAPPING, star.FACTS_MAPPING
ISO = "yyyy-M-d"
UPLOADED = datetime(2024, 1, 2, 3, 4, 5)
YEAR = (date(1998, 1, 1), date(1998, 12, 31))
AS_OF = date(2001, 7, 15)

# One question per customer, in turn.
QUESTIONS = [
    "Revenue so far, please",
    "Count of orders in the table",
    "Sum of units shipped",
    "List the top 3 products",
    "Give me the top 10 items",
    "The top SKUs when ranked by revenue",
    "Show the top 30 products",
    "Name the best one",
    "A total of what?",
    "Is performance fine?",
    "Anything declining at all?",
    "Did something drop lately?",
    "Good morning",
]


def plain(df: DataFrame, digits: int = 4) -> DataFrame:
    """Types every engine shares: 64-bit integers, rounded doubles, dates and lists as text."""

    def shared(field: T.StructField):
        col, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.DecimalType, T.DoubleType)):
            col = F.round(col, digits).cast("double")
        elif isinstance(kind, T.IntegralType):
            col = col.cast("bigint")
        elif isinstance(kind, (T.DateType, T.TimestampNTZType)):
            col = col.cast("string")
        elif isinstance(kind, T.ArrayType):
            col = F.array_join(col, ",")
        return col.alias(field.name)

    return df.select(*[shared(f) for f in df.schema if f.name != SEQ])


def facts(spark: SparkSession, folder: str) -> DataFrame:
    return star.facts(spark, folder)


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """Sales rows in the store's schema, with ``seq``."""
    return canonical.to_canonical(facts(spark, folder), FACTS, "orders", UPLOADED)


def staged(spark: SparkSession, folder: str) -> DataFrame:
    """``stored``, evaluated once for several changes of a store."""
    with shuffles_freed(spark):
        return stage(stored(spark, folder), "rows")


def cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.clean_upload(star.raw_sales(spark, folder, with_copies=True), RAW, ISO)


def new_store(spark: SparkSession) -> SalesStore:
    return SalesStore(spark, new_path(spark, "store"))


def two_batches(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines 1-4 and lines 3-7: all rows, with lines 3 and 4 in both."""
    line = F.col(f"{SEQ}.l_linenumber")
    return rows.where(line <= 4), rows.where(line >= 3)


SHOWN = ["order_id", "order_date", "sku", "asin", "quantity", "revenue_in_inr", "transaction_type", "revenue_calc"]


# --- revenue -----------------------------------------------------------------


def txn_breakdown(spark, folder):
    return plain(revenue.breakdown(facts(spark, folder)))


def revenue_summary(spark, folder):
    return plain(revenue.revenue_summary(facts(spark, folder)), 2)


def revenue_summary_with_ship(spark, folder):
    return plain(revenue.revenue_summary(facts(spark, folder), "shipping_amount"), 2)


def revenue_nonderived(spark, folder):
    return plain(revenue.revenue_nonderived(star.typed_sales(spark, folder)), 2)


def breakdown_nonderived(spark, folder):
    return plain(revenue.breakdown_nonderived(star.typed_sales(spark, folder)), 2)


def revenue_untyped(spark, folder):
    return plain(revenue.revenue_untyped(star.typed_sales(spark, folder).drop("transaction_type")), 2)


def breakdown_untyped(spark, folder):
    return plain(revenue.breakdown_untyped(star.typed_sales(spark, folder).drop("transaction_type")), 2)


# --- filters -----------------------------------------------------------------


def date_type_filter(spark, folder):
    rows = filters.filtered(facts(spark, folder), *YEAR, "Refund")
    return plain(rows.select(*SHOWN).orderBy("order_date", "order_id"))


def preset_last_month(spark, folder):
    rows = filters.in_range(facts(spark, folder), *filters.preset_bounds("Last Month", AS_OF))
    return plain(rows.select(*SHOWN))


def preset_counts(spark, folder):
    """Rows and revenue inside every preset, in one pass."""
    rows, day = facts(spark, folder), F.col("order_date")
    bounds = {name: filters.preset_bounds(name, AS_OF) for name in [*filters.PRESETS, "default"]}
    inside = {name: day.between(F.lit(a), F.lit(b)) for name, (a, b) in bounds.items()}
    flat = rows.agg(
        *[F.count_if(test).alias(f"{name} rows") for name, test in inside.items()],
        *[F.sum(F.when(test, F.col("revenue_in_inr"))).alias(f"{name} revenue") for name, test in inside.items()],
    )
    entries = [
        F.struct(
            F.lit(name).alias("preset"),
            F.lit(str(a)).alias("first_day"),
            F.lit(str(b)).alias("last_day"),
            F.col(f"{name} rows").alias("rows"),
            F.col(f"{name} revenue").alias("revenue"),
        )
        for name, (a, b) in bounds.items()
    ]
    return plain(flat.select(F.inline(F.array(*entries))))


# --- trends and products ------------------------------------------------------


def wow_change(spark, folder):
    return plain(trends.wow_change(trends.daily_trend(facts(spark, folder))))


def top_products_revenue(spark, folder):
    totals = products.product_totals(facts(spark, folder))
    return plain(products.top_products(totals, "revenue").select("display_name", "revenue"))


def top_products_units(spark, folder):
    totals = products.product_totals(facts(spark, folder))
    return plain(products.top_products(totals, "units").select("display_name", "units"))


def product_totals(spark, folder):
    return plain(products.product_totals(facts(spark, folder)))


def top_sku_only(spark, folder):
    return plain(products.top_products(products.product_totals(facts(spark, folder), by_asin=False)))


def best_product(spark, folder):
    return plain(products.best_product(facts(spark, folder)))


def topk_sql(spark, folder):
    return plain(products.top_by_revenue(facts(spark, folder), 5))


def status_counts(spark, folder):
    return plain(trends.status_counts(facts(spark, folder)))


def region_top10(spark, folder):
    return plain(trends.region_revenue(facts(spark, folder)))


def daily_trend(spark, folder):
    return plain(trends.daily_trend(facts(spark, folder)))


def weekly_products(spark, folder):
    return plain(products.weekly_products(facts(spark, folder)))


def weekly_skus(spark, folder):
    return plain(products.weekly_products(facts(spark, folder), by_asin=False).drop("asin"))


def fast_movers(spark, folder):
    return plain(products.movers(facts(spark, folder))[1])


def decliners(spark, folder):
    return plain(products.movers(facts(spark, folder))[0])


def mover_displays(spark, folder):
    down, up = products.movers(facts(spark, folder))
    return dashboard.movers_display(down, gains=False).unionByName(dashboard.movers_display(up, gains=True))


def overall_totals(spark, folder):
    return plain(audit.overall_totals(facts(spark, folder)))


def formatted_kpis(spark, folder):
    totals = products.product_totals(facts(spark, folder))
    return totals.select(
        F.col("display_name").alias("product"),
        text.rupees(F.col("revenue")).alias("revenue"),
        text.thousands(F.col("units")).alias("units"),
        text.percent(values.ratio(F.col("revenue"), F.col("units")), signed=True).alias("signed_percent"),
    )


def breakdown_display(spark, folder):
    return plain(dashboard.breakdown_display(revenue.breakdown(facts(spark, folder))))


def kpi_bundle(spark, folder):
    rows = stage(facts(spark, folder).drop(SEQ), "kpi-rows")
    return plain(dashboard.kpi_rows(dashboard.business_kpis(rows)), 2)


# --- cleaning ----------------------------------------------------------------


def clean_money(spark, folder):
    raw = star.raw_sales(spark, folder)
    amount = F.col("Invoice Amount")
    return plain(
        raw.select(
            F.trim("Order Id").alias("order_id"),
            amount.alias("amount_text"),
            values.money(amount).alias("amount"),
            values.money_or_zero(amount).alias("amount_or_zero"),
            values.money_or_zero(F.col("Shipping Amount")).alias("shipping"),
        )
    )


def clean_dates(spark, folder):
    raw = star.raw_sales(spark, folder)
    day = values.parse_date(F.col("Invoice Date"), ISO)
    return plain(
        raw.select(
            F.col("Invoice Date").alias("date_text"),
            day.alias("order_date"),
            values.month_tag(day).alias("month_tag"),
            values.week_start(day).alias("week"),
        )
    )


def clean_quantity(spark, folder):
    raw = star.raw_sales(spark, folder)
    quantity = F.col("Quantity")
    return plain(
        raw.select(
            quantity.alias("quantity_text"),
            values.quantity(quantity).alias("quantity"),
            values.missing_quantity(quantity).alias("missing_quantity"),
        )
    )


def clean_labels(spark, folder):
    raw = star.raw_sales(spark, folder)
    return raw.select(
        values.transaction_type(F.col("Transaction Type")).alias("transaction_type"),
        values.region(F.col("Ship To City")).alias("region"),
        values.key_text(F.col("Order Id")).alias("order_key"),
        text.product_label(F.col("Sku"), F.col("Asin")).alias("product"),
        text.sku_label(F.col("Sku")).alias("sku_label"),
    )


def exact_dedup(spark, folder):
    return plain(lower_names(cleaned(spark, folder)))


def lower_names(df: DataFrame) -> DataFrame:
    """Header columns under their field names."""
    fields = {header: field for field, header in RAW.items() if header}
    drop = ["transaction_type"] if "Transaction Type" in df.columns and "transaction_type" in df.columns else []
    out = df.drop(*drop)
    return out.select(*[F.col(f"`{c}`").alias(fields.get(c, c)) for c in out.columns])


def first_by_key_subset(spark, folder):
    raw = star.raw_sales(spark, folder, with_copies=True)
    return plain(lower_names(cleaning.strict_clean(raw, RAW, ISO)))


def cleaning_report(spark, folder):
    return plain(cleaning.cleaning_report(cleaned(spark, folder), RAW))


def strict_report(spark, folder):
    return plain(cleaning.strict_report(star.raw_sales(spark, folder, with_copies=True), RAW, ISO))


def problem_rows(spark, folder):
    """Among the first rows that strict cleaning keeps, in the order of their parts."""
    kept = cleaning.strict_clean(star.raw_sales(spark, folder, with_copies=True), RAW, ISO)
    by_part = ["l_partkey", "l_suppkey", "l_shipdate", "l_linenumber", "quantity", "amount"]
    found = cleaning.problem_rows(kept.withColumn(SEQ, F.struct(*[f"{SEQ}.{c}" for c in by_part], F.col("Order Id"))), RAW, rows=100)
    return plain(lower_names(found))


def canonical_projection(spark, folder):
    rows = canonical.to_canonical(cleaned(spark, folder), RAW, "upload.csv", UPLOADED)
    return plain(rows)


def valid_key_counts(spark, folder):
    rows = canonical.to_canonical(cleaned(spark, folder), RAW, "upload.csv", UPLOADED)
    return plain(canonical.count_valid(rows))


# --- store -------------------------------------------------------------------


def upsert_last_wins(spark, folder):
    rows = upsert.last_wins(stored(spark, folder))
    return plain(rows.select(*SHOWN, "month_tag", "region", "status"))


def upsert_into_stored(spark, folder):
    keys = ["normalized_order_id", "normalized_sku", "normalized_order_date"]
    first, second = two_batches(stage(stored(spark, folder).select(*SHOWN, *keys, SEQ), "rows"))
    # the stored side is read once, and lies by its keys as the merge needs it; staged, it would be shuffled again
    merged = upsert.upsert(upsert.last_wins(first), stage(upsert.last_wins(second), "second"))
    return plain(merged.select(*SHOWN))


def replace_then_append(spark, folder):
    store, (first, second) = new_store(spark), two_batches(staged(spark, folder))
    store.replace(second)
    store.replace(first)
    store.upsert(second)
    return plain(store.sales().select(*SHOWN, "month_tag"))


def append_if_absent(spark, folder):
    store, (first, second) = new_store(spark), two_batches(staged(spark, folder))
    store.append_absent(first)
    store.append_absent(second)
    return plain(store.sales().select(*SHOWN))


def append_counts(spark, folder):
    """Stored raw keys repeat here, and some rows of the batch lack a key."""
    first, second = two_batches(stage(stored(spark, folder).select("order_id", "sku", "order_date", SEQ), "rows"))
    lacking = F.when(F.col(f"{SEQ}.l_linenumber") != 7, F.col("order_id"))
    return plain(upsert.append_report(first, second.withColumn("order_id", lacking)))


def duplicate_precheck(spark, folder):
    shown = ["normalized_order_id", "normalized_sku", "normalized_order_date", "quantity", SEQ]
    first, second = two_batches(stage(stored(spark, folder).select(*shown), "rows"))
    known = upsert.already_stored(upsert.last_wins(first), second)
    return plain(known.select("normalized_order_id", "normalized_sku", "normalized_order_date", "quantity"))


def stored_range(spark, folder):
    store = new_store(spark)
    store.replace(stored(spark, folder))
    return plain(store.sales_between(*YEAR, "Shipment").select(*SHOWN))


def data_health(spark, folder):
    return plain(audit.data_health(stored(spark, folder)))


def table_summary(spark, folder):
    return plain(audit.table_summary(stored(spark, folder)))


def adhoc_sql(spark, folder):
    query = """
        SELECT sku, count(DISTINCT order_id) AS orders, sum(quantity) AS units
        FROM sales WHERE sku IS NOT NULL AND order_date IS NOT NULL GROUP BY sku
    """
    return plain(query_sales(facts(spark, folder), query))


def csv_roundtrip(spark, folder):
    """Raw rows written as CSV and read back, totals of both sides compared."""
    raw = star.raw_sales(spark, folder)
    path = uploads.write_csv(raw.drop(SEQ), new_path(spark, "upload"))
    return plain(totals_read_back(uploads.read_upload(spark, path)))


def totals_read_back(back: DataFrame) -> DataFrame:
    """One row, from one pass: totals, distinct orders, and distinct positions as the bits set in words of 64 rows.

    Counted as they are, every position would be a key of its own, its path included.
    """
    row, amount = F.col(f"{SEQ}.row"), F.col("Invoice Amount")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (row % 64).cast("int"))
    counted = {
        "rows": F.lit(1),
        "amount": values.money(amount),
        "missing_amounts": amount.isNull().cast("int"),
        "undated": values.parse_date(F.col("Invoice Date"), ISO).isNull().cast("int"),
    }
    keys = {"order": F.col("Order Id"), "path": F.col(f"{SEQ}.path"), "block": F.col(f"{SEQ}.block"), "word": F.shiftright(row, 6)}

    def entry(shown: list[str], bits: Column, filled: bool) -> Column:
        parts = {name: F.when(F.lit(name in shown), col) for name, col in keys.items()}
        parts |= {"bits": bits, **{name: F.when(F.lit(filled), col) for name, col in counted.items()}}
        return F.struct(*[col.alias(name) for name, col in parts.items()])

    entries = F.array(entry(["order"], F.lit(0).cast("long"), True), entry(["path", "block", "word"], bit, False))
    groups = back.select(F.inline(entries)).groupBy(*keys).agg(F.bit_or("bits").alias("bits"), *[F.sum(name).alias(name) for name in counted])
    whole = {name: F.sum(name) if name == "amount" else F.coalesce(F.sum(name), F.lit(0)) for name in counted}
    return groups.agg(
        *[col.alias(name) for name, col in whole.items()],
        F.count("order").alias("orders"),
        F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).alias("positions"),
    )


def snapshots(spark, folder):
    """Raw and cleaned snapshot of an upload, counted after reading them back."""
    raw = star.raw_sales(spark, folder, with_copies=True)
    with Scratch(spark):
        clean = cleaning.clean_upload(raw, RAW, ISO, staged=True).drop(COPIES)
        paths = uploads.write_snapshots(raw, clean, new_path(spark, "snapshots"), "upload", "20240102_030405")
    parts = [
        uploads.read_upload(spark, path).agg(
            F.lit(kind).alias("snapshot"),
            F.count("*").alias("rows"),
            F.sum(values.money(F.col("Invoice Amount"))).alias("amount"),
        )
        for kind, path in zip(("raw", "cleaned"), paths)
    ]
    return plain(parts[0].unionByName(parts[1]))


def report_export(spark, folder):
    """The mover report written as CSV and read back."""
    shown = dashboard.movers_display(products.movers(facts(spark, folder))[1], gains=True)
    path = uploads.write_csv(shown, new_path(spark, "fast_movers"))
    return uploads.read_upload(spark, path).drop(SEQ)


def full_ingest(spark, folder):
    """An upload taken through mapping, cleaning and upsert, then summed up by type."""
    path = uploads.write_csv(star.raw_sales(spark, folder, with_copies=True).drop(SEQ), new_path(spark, "upload"), packed=True)
    store = new_store(spark)
    ingest.ingest(store, path, "upload.csv", UPLOADED)
    rows = store.sales()
    return plain(
        rows.agg(
            F.count("*").alias("rows"),
            F.count_distinct("normalized_order_id", "normalized_sku", "normalized_order_date").alias("keys"),
            F.count_distinct("order_id").alias("orders"),
            F.min("order_date").alias("first_day"),
            F.max("order_date").alias("last_day"),
        )
    )


def registry_roundtrip(spark, folder):
    """Two registered uploads listed newest first."""
    path = uploads.write_csv(star.raw_sales(spark, folder, with_copies=True).drop(SEQ), new_path(spark, "upload"), packed=True)
    store = new_store(spark)
    ingest.ingest(store, path, "first.csv", datetime(2024, 1, 1))
    ingest.ingest(store, path, "second.csv", datetime(2024, 1, 2), mode="append_absent")
    return plain(
        store.registry().select(
            "filename",
            "upload_date",
            "row_count",
            "date_range_start",
            "date_range_end",
            mapping.mappings_from_json(F.col("column_mappings"))["revenue_amount"].alias("revenue_header"),
            "status",
            F.col("file_hash").eqNullSafe(store.registry().agg(F.min("file_hash")).scalar()).alias("same_hash"),
        )
    )


def schema_check(spark, folder):
    """Which derived columns stored files lack, for a store and for one with an older month folder."""
    rows, found = staged(spark, folder), []
    for name, dropped in (("complete", []), ("older", ["revenue_calc", "needs_estimation"])):
        store = new_store(spark)
        store.replace(rows)
        for path in sorted(set(store._state()["months"].values()))[: len(dropped)]:
            with Scratch(spark):
                old = stage(spark.read.parquet(f"{store.root}/{path}").drop(*dropped), "old")
                old.write.mode("overwrite").partitionBy("month_tag").parquet(f"{store.root}/{path}")
        missing = store.missing_columns(["revenue_calc", "shipping_loss_calc", "needs_estimation"])
        counted = stage(store.sales().agg(F.count("*").alias("rows")), "count")
        found.append(counted.select(F.lit(name).alias("store"), F.lit(",".join(missing)).alias("missing"), "rows"))
    return plain(found[0].unionByName(found[1]))


def date_forms(spark, folder):
    """Every order's date in every known form, read back by the form that the profile finds."""
    orders = star.table(spark, folder, "orders").select(F.col("o_orderkey").alias("order"), F.col("o_orderdate").cast("date").alias("day"))
    spelled = {f"form {i}": F.date_format("day", fmt) for i, fmt in enumerate(fixed.DATE_FORMATS)}
    texts = stage(orders.select("order", *[text.alias(name) for name, text in spelled.items()]), "texts")
    profiled = stage(mapping.profile_upload(texts, list(spelled)), "profiles")
    chosen = {r["header"]: r["date_format"] for r in mapping.profiles_of(profiled).collect()}  # a row per form
    back = [
        F.struct(F.lit(name).alias("form"), values.parse_date(F.col(f"`{name}`"), chosen[name]).alias("day"))
        for name in spelled
        if name in chosen
    ]
    return plain(texts.select("order", F.inline(F.array(*back))))


def mixed_headers(spark, folder):
    """An upload of two files that order their columns differently, one of them without a column."""
    raw, path = star.raw_sales(spark, folder), new_path(spark, "mixed")
    odd = F.col(f"{SEQ}.l_linenumber") % 2 == 1
    columns = ["Order Id", "Sku", "Quantity", "Invoice Amount"]
    raw.where(odd).select(*columns).write.option("header", True).option("escape", '"').csv(f"{path}/a")
    raw.where(~odd).select(*columns[2::-1]).write.option("header", True).option("escape", '"').csv(f"{path}/b")
    back = uploads.read_upload(spark, [f"{path}/a", f"{path}/b"])
    return plain(
        back.groupBy(F.coalesce(F.lower(F.trim("Sku")), F.lit("none")).alias("sku")).agg(
            F.count("*").alias("rows"),
            F.count_distinct(F.trim("Order Id")).alias("orders"),
            F.sum(values.quantity(F.col("Quantity"))).alias("units"),
            F.sum(values.money(F.col("Invoice Amount"))).alias("amount"),
        )
    )


def folder_mapping(spark, folder):
    """A folder of CSV files with three headers between them: the mapping of each, and the cells its rows fill."""
    raw, path = star.raw_sales(spark, folder), new_path(spark, "uploads")
    headers = [["Invoice Date", "Order Id", "Sku"], ["Sku", "Quantity", "Order Id", "Invoice Amount"], ["Asin", "Ship To City"]]
    for i, columns in enumerate(headers):
        rows = raw.where(F.col(f"{SEQ}.l_linenumber") % 3 == i)
        rows.select(*columns).write.option("header", True).option("escape", '"').csv(f"{path}/{i}")
    parts = []
    for layout in uploads.layouts(spark, [f"{path}/{i}" for i in range(len(headers))]):
        records = uploads.read_layout(spark, layout)
        mapped = mapping.auto_map(mapping.headers_of(records)).select(F.explode("mappings").alias("field", "header"))
        filled = mapping.cells(records, uploads.upload_headers(records)).groupBy("header")
        parts.append(mapped.join(filled.agg(F.count("*").alias("rows"), F.count("value").alias("filled")), "header"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return plain(out.select("field", "header", "rows", "filled"))


def mixed_ingest(spark, folder):
    """A folder whose files date their rows under different headers and in different forms, ingested as one upload."""
    raw, path = star.raw_sales(spark, folder), new_path(spark, "uploads")
    odd = F.col(f"{SEQ}.l_linenumber") % 2 == 1
    day = F.date_format(F.try_to_date("Invoice Date", "yyyy-MM-dd"), "dd-MM-yyyy")
    columns = ["Order Id", "Sku", "Quantity", "Invoice Amount", "Transaction Type"]
    raw.where(odd).select("Invoice Date", *columns).write.option("header", True).option("escape", '"').csv(f"{path}/a")
    raw.where(~odd).select(*columns, day.alias("Order Date")).write.option("header", True).option("escape", '"').csv(f"{path}/b")
    store = new_store(spark)
    ingest.ingest(store, [f"{path}/a", f"{path}/b"], "folder", UPLOADED)
    return plain(store.sales().groupBy("month_tag").agg(F.count("*").alias("rows"), F.count_distinct("order_id").alias("orders")))


def quoted_lines(spark, folder):
    """An upload whose product names and cities hold line breaks, commas and quotes, ingested and summed up by name."""
    raw = star.raw_sales(spark, folder)
    name = F.concat(F.regexp_replace("Item Description", " ", "\n"), F.lit(', "extra"'))
    city = F.concat(F.col("Ship To City"), F.lit("\nline two"))
    rows = raw.withColumn("Item Description", F.when(F.col(f"{SEQ}.l_partkey") % 3 == 0, name).otherwise(F.col("Item Description")))
    rows = rows.withColumn("Ship To City", F.when(F.col(f"{SEQ}.l_linenumber") == 1, city).otherwise(F.col("Ship To City")))
    back = uploads.read_upload(spark, uploads.write_csv(rows.drop(SEQ), new_path(spark, "quoted")))
    return plain(
        back.groupBy(F.replace("Item Description", F.lit("\n"), F.lit("|")).alias("product")).agg(
            F.count("*").alias("rows"),
            F.count_if(F.col("Ship To City").endswith("\nline two")).alias("two_lines"),
            F.count_distinct("Order Id").alias("orders"),
            F.sum(values.quantity(F.col("Quantity"))).alias("units"),
        )
    )


def bad_records(spark, folder):
    """Records with too many and too few cells among the line items: kept apart, by their order, and not in the rows."""
    raw = star.raw_sales(spark, folder)
    line, order = F.col(f"{SEQ}.l_linenumber"), F.coalesce(F.trim("Order Id"), F.lit(""))
    cells = F.concat_ws(",", order, "Asin", F.coalesce("Quantity", F.lit("")))
    text = F.when(line == 3, F.concat(cells, F.lit(",extra,cells"))).when(line == 5, F.concat(order, F.lit(",short"))).otherwise(cells)
    path = new_path(spark, "bad")
    lines = raw.select(text.alias("Order Id,Asin,Quantity"))  # one column of whole lines, under a whole header
    lines.write.option("header", True).option("quote", "\u0000").option("sep", "\u0001").csv(path)
    records = stage(uploads.read_records(spark, path), "records")
    good, bad = uploads.good_records(records), uploads.bad_records(records)
    kept = good.groupBy(F.lit("kept").alias("kind")).agg(
        F.count("*").alias("rows"), F.count_distinct("Order Id").alias("orders"), F.sum(values.quantity(F.col("Quantity"))).alias("units")
    )
    kind = F.when(F.col("bad_record").endswith(",short"), "short").when(F.col("bad_record").endswith(",extra,cells"), "long").otherwise("other")
    apart = bad.groupBy(kind.alias("kind")).agg(
        F.count("*").alias("rows"), F.count_distinct(F.split("bad_record", ",")[0]).alias("orders"), F.lit(0).cast("long").alias("units")
    )
    return plain(kept.unionByName(apart))


def drop_empty_rows(spark, folder):
    """Strict cleaning of an upload without key columns, in which some rows hold nothing at all."""
    line = F.col(f"{SEQ}.l_linenumber")
    raw = star.raw_sales(spark, folder)
    rows = raw.select(
        F.when(line != 7, F.col("Asin")).alias("Asin"), F.when(line < 6, F.col("Item Description")).alias("Item Description"), SEQ
    )
    kept = cleaning.complete_rows(rows, {"asin": "Asin", "product_name": "Item Description"})
    return plain(kept.groupBy("Asin").agg(F.count("*").alias("rows"), F.count("Item Description").alias("named")))


def replacement_fallback(spark, folder):
    """Totals without derived columns where the ASINs of brass have no shipment to take a cost from."""
    rows = star.typed_sales(spark, folder)
    brass = F.col("asin").endswith("BRASS") | F.col("asin").startswith("A") | F.col("asin").startswith("L")
    return plain(revenue.revenue_nonderived(rows.where(~(brass & (F.col("transaction_type") == "Shipment")))), 2)


def table_lifecycle(spark, folder):
    """Row counts of a store through its life: new, replaced, appended, cleared, refilled."""
    store, (first, second) = new_store(spark), two_batches(staged(spark, folder))
    steps = []

    def note(step: str) -> None:
        rows = store.sales().agg(F.count("*").alias("rows"), F.count_distinct("month_tag").alias("months"))
        steps.append(stage(rows.select(F.lit(step).alias("step"), "rows", "months"), "step"))

    note("1 new")
    store.replace(first)
    note("2 replaced")
    store.upsert(second)
    note("3 upserted")
    store.upsert(second)
    note("4 upserted again")
    store.clear()
    note("5 cleared")
    store.append_absent(second)
    note("6 refilled")
    out = steps[0]
    for step in steps[1:]:
        out = out.unionByName(step)
    return plain(out)


# --- audit -------------------------------------------------------------------


def type_value_counts(spark, folder):
    rows = star.raw_sales(spark, folder).select(
        values.transaction_type(F.col("Transaction Type")).alias("transaction_type")
    )
    return plain(audit.value_counts(rows, "transaction_type"))


def type_values(spark, folder):
    rows = star.raw_sales(spark, folder).select(
        values.transaction_type(F.col("Transaction Type")).alias("transaction_type")
    )
    return audit.distinct_values(rows, "transaction_type")


def null_types(spark, folder):
    rows = star.raw_sales(spark, folder).select(
        values.transaction_type(F.col("Transaction Type")).alias("transaction_type")
    )
    return plain(audit.null_types(rows))


def amount_reconciliation(spark, folder):
    return plain(audit.reconcile_amounts(facts(spark, folder)))


def sign_distribution(spark, folder):
    return plain(audit.sign_distribution(facts(spark, folder)))


def column_profile(spark, folder):
    columns = ["revenue_in_inr", "shipping_amount", "quantity", "order_id", "revenue_calc", "transaction_type"]
    return plain(audit.column_profile(facts(spark, folder), columns))


def totals_by_type(spark, folder):
    return plain(audit.totals_by_type(facts(spark, folder), *YEAR))


def derived_totals(spark, folder):
    return plain(audit.derived_totals(facts(spark, folder)))


def sample_per_type(spark, folder):
    rows = facts(spark, folder).withColumn(SEQ, F.struct(SEQ, "order_id"))
    return plain(audit.sample_per_type(rows).select(*SHOWN))


def sample_rows(spark, folder):
    return plain(audit.sample_rows(facts(spark, folder), 5, SHOWN, order=[SEQ, "order_id"]))


# --- header mapping ----------------------------------------------------------


def _profiles(spark, folder):
    return mapping.profile(star.supplier_cells(spark, folder, mapping.columns_to_profile(star.WIDE_HEADERS)))


def _mapped(spark, folder):
    headers = star.supplier_headers(spark, folder)
    return headers, mapping.auto_map(headers, stage(_profiles(spark, folder), "profiles"))


def profile_sample(spark, folder):
    return plain(_profiles(spark, folder))


def header_mapping(spark, folder):
    return _mapped(spark, folder)[1].select("upload", F.explode("mappings").alias("field", "header"))


def ambiguous_fields(spark, folder):
    return mapping.ambiguous_fields(*_mapped(spark, folder))


def header_candidates(spark, folder):
    return plain(mapping.candidates_of(star.supplier_headers(spark, folder)))


def header_signature(spark, folder):
    signed = mapping.signatures(star.supplier_headers(spark, folder))
    return plain(signed.select("upload", "signature", F.size("headers").alias("headers")))


def mapping_registry(spark, folder):
    """Saved twice under each signature, the later mapping is found again, as JSON and back."""
    headers, store = star.supplier_headers(spark, folder), new_store(spark)
    store.save_mapping(headers, RAW, datetime(2024, 1, 1))
    store.save_mapping(headers, mapping.apply_overrides(RAW, {"sku": None, "status": "Shipment Id"}), UPLOADED)
    found = mapping.lookup(store.saved_mappings(), headers)
    as_text = found.select("upload", "signature", mapping.mappings_json(F.col("mappings")).alias("json"))
    back = mapping.mappings_from_json(F.col("json"))
    return as_text.select("upload", "signature", F.explode(back).alias("field", "header"))


# --- questions ---------------------------------------------------------------


def question_intents(spark, folder):
    return plain(questions.route(star.questions(spark, folder, QUESTIONS)).drop("text"))


def question_answers(spark, folder):
    asked = star.questions(spark, folder, QUESTIONS)
    rows = stage(facts(spark, folder).drop(SEQ), "question-rows")
    return questions.answer(asked, rows).select("question_id", "intent", "answer")


def all_queries():
    return {
        f.__name__: f
        for f in (
            txn_breakdown,
            revenue_summary,
            revenue_summary_with_ship,
            revenue_nonderived,
            breakdown_nonderived,
            revenue_untyped,
            breakdown_untyped,
            date_type_filter,
            preset_last_month,
            preset_counts,
            wow_change,
            top_products_revenue,
            top_products_units,
            product_totals,
            top_sku_only,
            best_product,
            topk_sql,
            status_counts,
            region_top10,
            daily_trend,
            weekly_products,
            weekly_skus,
            fast_movers,
            decliners,
            mover_displays,
            overall_totals,
            formatted_kpis,
            breakdown_display,
            kpi_bundle,
            clean_money,
            clean_dates,
            clean_quantity,
            clean_labels,
            exact_dedup,
            first_by_key_subset,
            cleaning_report,
            strict_report,
            problem_rows,
            canonical_projection,
            valid_key_counts,
            upsert_last_wins,
            upsert_into_stored,
            replace_then_append,
            append_if_absent,
            append_counts,
            duplicate_precheck,
            stored_range,
            data_health,
            table_summary,
            adhoc_sql,
            csv_roundtrip,
            snapshots,
            report_export,
            full_ingest,
            registry_roundtrip,
            schema_check,
            date_forms,
            mixed_headers,
            folder_mapping,
            mixed_ingest,
            quoted_lines,
            bad_records,
            drop_empty_rows,
            replacement_fallback,
            table_lifecycle,
            type_value_counts,
            type_values,
            null_types,
            amount_reconciliation,
            sign_distribution,
            column_profile,
            totals_by_type,
            derived_totals,
            sample_per_type,
            sample_rows,
            profile_sample,
            header_mapping,
            ambiguous_fields,
            header_candidates,
            header_signature,
            mapping_registry,
            question_intents,
            question_answers,
        )
    }
