"""Target schemas and column groups."""

from pyspark.sql import types as T

MONEY = T.DecimalType(24, 4)

SALES_SCHEMA = T.StructType(
    [
        T.StructField("order_date", T.DateType()),
        T.StructField("order_id", T.StringType()),
        T.StructField("sku", T.StringType()),
        T.StructField("asin", T.StringType()),
        T.StructField("product_name", T.StringType()),
        T.StructField("quantity", T.LongType()),
        T.StructField("missing_quantity_flag", T.BooleanType()),
        T.StructField("revenue_in_inr", MONEY),
        T.StructField("shipping_amount", MONEY),
        T.StructField("transaction_type", T.StringType()),
        T.StructField("shipment_item_id", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("data_source", T.StringType()),
        T.StructField("upload_date", T.TimestampNTZType()),
        T.StructField("month_tag", T.StringType()),
        T.StructField("normalized_order_id", T.StringType()),
        T.StructField("normalized_sku", T.StringType()),
        T.StructField("normalized_order_date", T.DateType()),
        T.StructField("revenue_calc", MONEY),
        T.StructField("shipping_loss_calc", MONEY),
        T.StructField("units_sold_calc", T.LongType()),
        T.StructField("needs_estimation", T.BooleanType()),
    ]
)
SALES_COLUMNS = SALES_SCHEMA.fieldNames()

REGISTRY_SCHEMA = T.StructType(
    [
        T.StructField("filename", T.StringType()),
        T.StructField("upload_date", T.TimestampNTZType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("date_range_start", T.DateType()),
        T.StructField("date_range_end", T.DateType()),
        T.StructField("column_mappings", T.StringType()),
        T.StructField("file_hash", T.StringType()),
        T.StructField("status", T.StringType()),
    ]
)

MAPPING_TYPE = T.MapType(T.StringType(), T.StringType())
MAPPINGS_SCHEMA = T.StructType(
    [
        T.StructField("signature", T.StringType()),
        T.StructField("headers", T.ArrayType(T.StringType())),
        T.StructField("mappings", MAPPING_TYPE),
        T.StructField("saved_at", T.TimestampNTZType()),
    ]
)

UPSERT_KEYS = ["normalized_order_id", "normalized_sku", "normalized_order_date"]
RAW_KEYS = ["order_id", "sku", "order_date"]
DERIVED_COLUMNS = ["revenue_calc", "shipping_loss_calc", "units_sold_calc", "needs_estimation"]

# Columns added while an upload is on its way to the store.
SEQ = "seq"
COPIES = "copies"
BAD = "bad_record"
