"""Projection of cleaned uploads onto the fixed sales schema."""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom import fixed
from tallyloom.functions import values
from tallyloom.operators.cleaning import Mapping
from tallyloom.operators.dedup import valid_keys
from tallyloom.schema import DERIVED_COLUMNS, MONEY, SALES_COLUMNS, SALES_SCHEMA, SEQ, UPSERT_KEYS


def to_canonical(
    cleaned: DataFrame,
    mapping: Mapping,
    data_source: str,
    upload_date: datetime,
    date_format: str | None = None,
) -> DataFrame:
    """Select the sales columns through the mapping; absent fields take their defaults.

    Dates still in text are parsed with ``date_format``. Derived columns are carried over
    where the cleaning made them. ``seq`` stays, for the upsert.
    """
    none = F.lit(None).cast("string")
    zero = F.lit(0).cast(MONEY)

    def source(field: str) -> Column | None:
        header = mapping.get(field)
        return F.col(f"`{header}`") if header else None

    def text(field: str, default: Column = none) -> Column:
        column = source(field)
        return default if column is None else column.cast("string")

    def filled(field: str, default: str, *extra: str) -> Column:
        column = source(field)
        return F.lit(default) if column is None else values.placeholder(column, default, extra)

    def is_text(field: str) -> bool:
        return isinstance(cleaned.schema[mapping[field]].dataType, T.StringType)

    def amount(field: str) -> Column:
        column = source(field)
        if column is None:
            return zero
        return values.money_or_zero(column) if is_text(field) else F.coalesce(column.cast(MONEY), zero)

    date = source("order_date")
    if date is None:
        date = F.lit(None).cast("date")
    elif date_format:
        date = values.parse_date(date, date_format)
    quantity, missing_quantity = source("quantity"), F.lit(False)
    if quantity is None:
        quantity = F.lit(0)
    elif is_text("quantity"):
        quantity, missing_quantity = values.quantity(quantity), values.missing_quantity(quantity)
    else:
        quantity, missing_quantity = F.coalesce(quantity, F.lit(0)), quantity.isNull()
    region = source("region")
    kind = F.col("transaction_type") if "transaction_type" in cleaned.columns else text("transaction_type")
    order_id, sku = text("order_id"), filled("sku", fixed.UNKNOWN_SKU)
    columns = {
        "order_date": date,
        "order_id": order_id,
        "sku": sku,
        "asin": filled("asin", fixed.UNKNOWN_ASIN),
        "product_name": filled("product_name", fixed.UNKNOWN_PRODUCT, "None"),
        "quantity": quantity,
        "missing_quantity_flag": missing_quantity,
        "revenue_in_inr": amount("revenue_amount"),
        "shipping_amount": amount("shipping_amount"),
        "transaction_type": kind,
        "shipment_item_id": text("shipment_item_id"),
        "region": none if region is None else values.region(region),
        "status": text("status"),
        "data_source": F.lit(data_source),
        "upload_date": F.lit(upload_date).cast("timestamp_ntz"),
        "month_tag": values.month_tag(date),
        "normalized_order_id": values.key_text(order_id),
        "normalized_sku": values.key_text(sku),
        "normalized_order_date": date,
        "revenue_calc": zero,
        "shipping_loss_calc": zero,
        "units_sold_calc": F.lit(0),
        "needs_estimation": F.lit(False),
    }
    for name in DERIVED_COLUMNS:
        if name in cleaned.columns:
            columns[name] = F.col(name)
    return cleaned.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in SALES_SCHEMA], SEQ)


def with_valid_keys(canonical: DataFrame) -> DataFrame:
    return canonical.where(valid_keys(UPSERT_KEYS))


def count_valid(canonical: DataFrame) -> DataFrame:
    """One row: how many rows have complete upsert keys and how many do not."""
    valid = valid_keys(UPSERT_KEYS)
    return canonical.agg(F.count_if(valid).alias("valid_rows"), F.count_if(~valid).alias("invalid_rows"))


def stored_columns(df: DataFrame) -> DataFrame:
    return df.select(*SALES_COLUMNS)


def read_back(df: DataFrame) -> DataFrame:
    """Stored rows as the reports need them: dated, numbers never null."""
    return df.where(F.col("order_date").isNotNull()).withColumns(
        {
            name: F.coalesce(F.col(name), F.lit(0).cast(df.schema[name].dataType))
            for name in ("revenue_in_inr", "shipping_amount", "quantity")
            if name in df.columns
        }
    )
