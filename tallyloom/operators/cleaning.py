"""Cleaning of mapped uploads, and the counts it reports.

``mapping`` names the header of each field; ``None`` or no entry means the upload lacks it.
"""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom import fixed
from tallyloom.functions import values
from tallyloom.functions.text import strip
from tallyloom.operators.dedup import MIN_SUBSET, distinct_rows, first_by_subset
from tallyloom.operators.derive import add_derived
from tallyloom.schema import COPIES, SEQ
from tallyloom.sources.workspace import BUCKETS, stage_in_parts

Mapping = dict[str, str | None]
KEY_FIELDS = ["order_id", "sku", "order_date"]
SUBSET_FIELDS = ["order_id", "sku", "asin", "transaction_type", "revenue_amount", "order_date"]


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def mapped(mapping: Mapping, fields: list[str]) -> list[str]:
    return [mapping[field] for field in fields if mapping.get(field)]


def clean_cells(df: DataFrame, mapping: Mapping, date_format: str, strict: bool = False) -> DataFrame:
    """Normalize every mapped column in place and add the standard transaction_type.

    Text is trimmed, ids are upper case, dates and amounts are parsed; missing shipping and
    quantity become 0. A missing amount stays null, or is 0 when ``strict``, which also
    flags rows that came without a quantity.
    """
    field_of = {header: field for field, header in mapping.items() if header}
    upper = ("order_id", "sku") if strict else ("order_id", "sku", "asin")

    def cleaned(name: str) -> Column:
        field, column = field_of.get(name), _col(name)
        if field == "order_date":
            return values.parse_date(column, date_format)
        if field == "revenue_amount" and not strict:
            return values.money(column)
        if field in ("revenue_amount", "shipping_amount"):
            return values.money_or_zero(column)
        if field == "transaction_type":
            return values.transaction_type(column)
        if field == "quantity":
            return values.quantity(column)
        return F.upper(strip(column)) if field in upper else strip(column)

    columns = [cleaned(name).alias(name) for name in df.columns if name != SEQ]
    kind, quantity = mapping.get("transaction_type"), mapping.get("quantity")
    if kind and kind != "transaction_type":
        columns.append(cleaned(kind).alias("transaction_type"))
    elif "transaction_type" not in df.columns:
        columns.append(F.lit(None).cast("string").alias("transaction_type"))
    if strict and quantity:
        columns.append(values.missing_quantity(_col(quantity)).alias("missing_quantity_flag"))
    return df.select(*columns, SEQ)


def clean_upload(df: DataFrame, mapping: Mapping, date_format: str, staged: bool = False) -> DataFrame:
    """Clean an upload, drop rows that are equal in every column, derive revenue columns.

    ``copies`` tells how many equal rows a kept row stands for. ``staged`` writes the result to the shared folder, where
    cleaned cells are laid out by their hash first, so that only the rows of a few hashes are shuffled at a time.
    """
    cells = clean_cells(df, mapping, date_format)
    if not staged:
        return _kept_rows(cells, mapping)
    same = F.xxhash64(*[_col(name) for name in cells.columns if name != SEQ])
    return stage_in_parts(cells, F.pmod(same, F.lit(BUCKETS)), lambda part: _kept_rows(part, mapping), "cleaned")


def _kept_rows(cells: DataFrame, mapping: Mapping) -> DataFrame:
    kept = distinct_rows(cells)
    amount, shipping, quantity = (
        _col(mapping[field]) if mapping.get(field) else None
        for field in ("revenue_amount", "shipping_amount", "quantity")
    )
    return add_derived(kept, amount, shipping, quantity)


def cleaning_report(cleaned: DataFrame, mapping: Mapping) -> DataFrame:
    """One row of counts over ``clean_upload`` rows."""
    amount, kind = mapping.get("revenue_amount"), F.col("transaction_type")
    negative = _col(amount) < 0 if amount else F.lit(False)
    copies = F.coalesce(F.sum(F.col(COPIES) - 1), F.lit(0))
    return cleaned.agg(
        F.coalesce(F.sum(COPIES), F.lit(0)).alias("total_rows_read"),
        F.count("*").alias("rows_kept"),
        copies.alias("rows_dropped"),
        copies.alias("duplicates_found"),
        F.count_if(negative).alias("negative_amounts"),
        *[
            F.count_if(_col(mapping[field]).isNull()).alias(f"missing_{field}")
            for field in KEY_FIELDS
            if mapping.get(field)
        ],
        F.count_if(kind.isNull()).alias("null_types"),
    )


def drop_without_keys(df: DataFrame, mapping: Mapping) -> DataFrame:
    """Drop rows that lack one of the mapped key columns."""
    keys = mapped(mapping, KEY_FIELDS)
    return df.na.drop(subset=keys) if keys else df


def drop_empty(df: DataFrame) -> DataFrame:
    """Drop rows with nothing but nulls (``seq`` aside)."""
    return df.na.drop("all", subset=[name for name in df.columns if name != SEQ])


def complete_rows(cells: DataFrame, mapping: Mapping) -> DataFrame:
    """Rows with their keys, and with anything at all; having a key implies the latter."""
    return drop_without_keys(cells, mapping) if mapped(mapping, KEY_FIELDS) else drop_empty(cells)


def strict_clean(df: DataFrame, mapping: Mapping, date_format: str) -> DataFrame:
    """Cleaning that needs complete keys and keeps the first row per key subset."""
    cells = clean_cells(df, mapping, date_format, strict=True)
    return first_by_subset(complete_rows(cells, mapping), mapped(mapping, SUBSET_FIELDS))


def strict_report(df: DataFrame, mapping: Mapping, date_format: str) -> DataFrame:
    """One row of counts over the stricter cleaning: before dropping, and after it."""
    cells = clean_cells(df, mapping, date_format, strict=True)
    keys = {field: _col(mapping[field]) for field in KEY_FIELDS if mapping.get(field)}
    lacks_key = reduce(or_, [key.isNull() for key in keys.values()], F.lit(False))
    amount, kind = mapping.get("revenue_amount"), F.col("transaction_type")
    negative = _col(amount) < 0 if amount else F.lit(False)
    before = {
        "total_rows_read": F.count("*"),
        "rows_without_keys": F.count_if(lacks_key),
        **{f"missing_{field}": F.count_if(key.isNull()) for field, key in keys.items()},
    }
    if mapping.get("quantity"):
        before["missing_quantities"] = F.count_if("missing_quantity_flag")
    # Amount and type belong to the subset, so its groups tell all there is to count.
    after = {
        "rows_kept": F.count("*"),
        "duplicates_found": F.sum(F.col(COPIES) - 1),
        "negative_amounts": F.count_if(negative),
        "negative_refunds": F.count_if(negative & (kind == fixed.REFUND)),
    }
    complete, subset = complete_rows(cells, mapping), mapped(mapping, SUBSET_FIELDS)
    if len(subset) < MIN_SUBSET:
        groups = complete.withColumn(COPIES, F.lit(1))
    else:
        groups = complete.groupBy(*map(_col, dict.fromkeys([*subset, "transaction_type"]))).agg(F.count("*").alias(COPIES))
    parts = cells.agg(*[column.alias(name) for name, column in before.items()]).unionByName(
        groups.agg(*[column.alias(name) for name, column in after.items()]), allowMissingColumns=True
    )
    return parts.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in parts.columns])


def problem_rows(cleaned: DataFrame, mapping: Mapping, rows: int = 5) -> DataFrame:
    """Among the first rows, those with zero revenue or zero quantity, with their issues."""
    zero = {
        issue: _col(mapping[field]) == 0
        for issue, field in (("Zero revenue", "revenue_amount"), ("Zero quantity", "quantity"))
        if mapping.get(field)
    }
    issues = F.array_compact(F.array(*[F.when(test, issue) for issue, test in zero.items()]))
    shown = mapped(mapping, ["order_id", "sku", "revenue_amount"])
    first = cleaned.orderBy(SEQ).limit(rows)
    return first.select(SEQ, issues.alias("issues"), *map(_col, shown)).where(F.size("issues") > 0)
