"""Sales rows derived from the star-schema tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom import fixed
from tallyloom.operators.derive import add_derived
from tallyloom.operators.mapping import cells
from tallyloom.schema import MONEY, SEQ

ORDER_COLUMNS = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "quantity", "amount"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sales(spark: SparkSession, folder: str) -> DataFrame:
    """One row per line item.

    The line items meet the orders after these have met customers and nations, so the largest table
    is shuffled for the order and part joins only. Which sides are broadcast is left to the measured sizes, and
    adaptive execution splits a hot key.
    """
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        "l_shipdate",
        "l_returnflag",
        "l_linestatus",
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("price"),
        F.col("l_tax").cast("decimal(4,2)").alias("tax"),
    )
    orders, customer, nation = (table(spark, folder, name) for name in ("orders", "customer", "nation"))
    of_order = F.col("l_orderkey") == F.col("o_orderkey")
    of_customer = F.col("o_custkey") == F.col("c_custkey")
    of_nation = F.col("c_nationkey") == F.col("n_nationkey")
    placed_lines = lines.join(orders.join(customer, of_customer).join(nation, of_nation), of_order)
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    negative = (flag == "R") & (F.col("l_linenumber") % 2 == 1)
    return (
        placed_lines.join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("o_orderdate").cast("date").alias("order_date"),
            F.col("l_orderkey").cast("string").alias("order_id"),
            F.col("p_brand").alias("sku"),
            F.col("p_type").alias("asin"),
            F.col("p_name").alias("product_name"),
            "quantity",
            F.when(negative, -F.col("price")).otherwise(F.col("price")).alias("amount"),
            (F.col("price") * F.col("tax")).alias("shipping_amount"),
            F.when(flag == "N", fixed.SHIPMENT)
            .when(flag == "R", fixed.REFUND)
            .when(status == "F", fixed.FREE_REPLACEMENT)
            .otherwise(fixed.CANCEL)
            .alias("transaction_type"),
            F.col("n_name").alias("region"),
            F.col("o_orderstatus").alias("status"),
            "l_linenumber",
            "l_partkey",
            "l_suppkey",
            "l_shipdate",
        )
    )


def row_order() -> Column:
    """Total order of the sales rows of an order, as the ``seq`` struct."""
    return F.struct(*ORDER_COLUMNS).alias(SEQ)


def typed_sales(spark: SparkSession, folder: str) -> DataFrame:
    """Sales rows with the store's column names, before derivation."""
    return sales(spark, folder).select(
        "order_date",
        "order_id",
        "sku",
        "asin",
        "product_name",
        "quantity",
        F.col("amount").cast(MONEY).alias("revenue_in_inr"),
        F.col("shipping_amount").cast(MONEY).alias("shipping_amount"),
        "transaction_type",
        "region",
        "status",
        row_order(),
    )


def facts(spark: SparkSession, folder: str) -> DataFrame:
    """Sales rows with their derived columns."""
    return add_derived(
        typed_sales(spark, folder), F.col("revenue_in_inr"), F.col("shipping_amount"), F.col("quantity")
    )


def raw_sales(spark: SparkSession, folder: str, with_copies: bool = False) -> DataFrame:
    """The sales rows as an upload would spell them: all text, with blanks and noise.

    ``with_copies`` adds a second copy of the rows of every fiftieth part.
    """
    line, kind = F.col("l_linenumber"), F.col("transaction_type")
    raw = sales(spark, folder).select(
        F.when(line == 6, "not a date").otherwise(F.col("order_date").cast("string")).alias("Invoice Date"),
        F.when(line != 7, F.concat(F.lit(" ord-"), "order_id", F.lit(" "))).alias("Order Id"),
        F.when(line != 2, F.lower("sku")).alias("Sku"),
        F.concat("asin", F.lit(" ")).alias("Asin"),
        F.col("product_name").alias("Item Description"),
        F.when(line == 5, "").otherwise(F.col("quantity").cast("string")).alias("Quantity"),
        F.when(line == 3, "")
        .when(line == 4, "N/A")
        .otherwise(F.concat(F.lit("₹ "), F.col("amount").cast("string")))
        .alias("Invoice Amount"),
        F.col("shipping_amount").cast("string").alias("Shipping Amount"),
        F.when((kind == fixed.SHIPMENT) & (line == 1), "SHIP")
        .when((kind == fixed.CANCEL) & (line == 1), "cancellation")
        .when(kind == fixed.FREE_REPLACEMENT, "free replacement")
        .when((kind == fixed.REFUND) & (line == 1), "adjustment fee")
        .when((kind == fixed.REFUND) & (line == 2), "nan")
        .otherwise(F.concat(F.lit(" "), F.lower(kind)))
        .alias("Transaction Type"),
        F.when(F.col("l_partkey") % 2 == 0, F.upper("region"))
        .otherwise(F.concat(F.lit(" "), F.lower("region")))
        .alias("Ship To City"),
        row_order(),
    )
    if with_copies:
        times = F.when(F.col(f"{SEQ}.l_partkey") % 50 == 0, 2).otherwise(1)
        raw = raw.withColumn("copy", F.explode(F.sequence(F.lit(1), times))).drop("copy")
    return raw


# The mapping of the columns of ``raw_sales``.
RAW_MAPPING = {
    "order_date": "Invoice Date",
    "order_id": "Order Id",
    "sku": "Sku",
    "asin": "Asin",
    "product_name": "Item Description",
    "quantity": "Quantity",
    "revenue_amount": "Invoice Amount",
    "shipping_amount": "Shipping Amount",
    "transaction_type": "Transaction Type",
    "shipment_item_id": None,
    "region": "Ship To City",
    "status": None,
}

# The mapping of the columns of ``facts``.
FACTS_MAPPING = {
    "order_date": "order_date",
    "order_id": "order_id",
    "sku": "sku",
    "asin": "asin",
    "product_name": "product_name",
    "quantity": "quantity",
    "revenue_amount": "revenue_in_inr",
    "shipping_amount": "shipping_amount",
    "transaction_type": "transaction_type",
    "shipment_item_id": None,
    "region": "region",
    "status": "status",
}


def wide_upload(spark: SparkSession, folder: str) -> DataFrame:
    """``raw_sales`` with further columns whose headers compete for the same fields."""
    key = F.col(f"{SEQ}.l_partkey").cast("string")
    supplier = F.col(f"{SEQ}.l_suppkey").cast("string")
    shipped = F.date_format(f"{SEQ}.l_shipdate", "yyyy-MM-dd")
    raw = raw_sales(spark, folder)
    return raw.select(
        "Order Id",
        supplier.alias("Shipment Id"),
        F.concat(F.lit("shipped "), shipped).alias("Shipment Date"),
        shipped.alias("Order Date"),
        *[name for name in raw.columns if name not in ("Order Id", SEQ)],
        key.alias("Shipment Item Id"),
        key.alias("Product Tax Code"),
        F.lit("12.5").alias("Tax Amount"),
        F.col("Ship To City").alias("Bill From City"),
        SEQ,
    )


# Headers of marketplace reports that the field synonyms speak of.
WIDE_HEADERS = [
    "Order Id",
    "Shipment Id",
    "Shipment Date",
    "Order Date",
    "Invoice Date",
    "Sku",
    "Asin",
    "Item Description",
    "Quantity",
    "Invoice Amount",
    "Shipping Amount",
    "Transaction Type",
    "Ship To City",
    "Shipment Item Id",
    "Product Tax Code",
    "Tax Amount",
    "Bill From City",
]


def _lacking(supplier: Column) -> Column:
    """The header a supplier's upload does without."""
    names = F.array(*map(F.lit, WIDE_HEADERS))
    return F.element_at(names, (supplier % len(WIDE_HEADERS) + 1).cast("int"))


def _spelled(header: Column, supplier: Column) -> Column:
    """A header in the supplier's spelling: upper case, spaced out, or as it is."""
    return (
        F.when(supplier % 3 == 0, F.upper(header))
        .when(supplier % 3 == 1, F.concat(F.lit("  "), F.replace(header, F.lit(" "), F.lit("   "))))
        .otherwise(header)
    )


def supplier_headers(spark: SparkSession, folder: str) -> DataFrame:
    """(upload, header, pos): every supplier as an upload with headers of its own."""
    supplier = F.col("s_suppkey")
    return (
        table(spark, folder, "supplier")
        .select(supplier, F.posexplode(F.array(*map(F.lit, WIDE_HEADERS))).alias("pos", "name"))
        .where(F.col("name") != _lacking(supplier))
        .select(supplier.cast("string").alias("upload"), _spelled(F.col("name"), supplier).alias("header"), "pos")
    )


def supplier_cells(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """(upload, header, seq, value): the rows of every supplier's upload, unpivoted."""
    supplier = F.col(f"{SEQ}.l_suppkey")
    # Rows may tie on seq across orders; a sample has to be the same every time.
    ordered = wide_upload(spark, folder).withColumn(SEQ, F.struct(f"{SEQ}.*", F.col("Order Id")))
    return (
        cells(ordered, columns, supplier.cast("string"))
        .where(F.col("header") != _lacking(supplier))
        .withColumn("header", _spelled(F.col("header"), supplier))
    )


def questions(spark: SparkSession, folder: str, texts: list[str]) -> DataFrame:
    """The user turns of the conversations, and one of the given texts per customer."""
    turns = table(spark, folder, "conversations").where(F.col("role") == "user")
    asked = F.element_at(F.array(*map(F.lit, texts)), (F.col("c_custkey") % len(texts) + 1).cast("int"))
    return turns.select(
        F.concat_ws("-", F.lit("turn"), "conv_id", "turn").alias("question_id"), "text"
    ).unionByName(
        table(spark, folder, "customer").select(
            F.concat_ws("-", F.lit("customer"), "c_custkey").alias("question_id"), asked.alias("text")
        )
    )
