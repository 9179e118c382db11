"""Text expressions: trimming, casing, labels and display formats."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom import fixed

# Every character Python's str.strip removes; Spark's trim alone removes spaces.
WHITESPACE = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]
        + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)

CASED = r"\p{IsLowercase}\p{IsUppercase}\p{Lt}"
# Not a letter, and not found in text.
MARK = "\x01"


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def blank_to_null(col: Column) -> Column:
    return F.nullif(strip(col), F.lit(""))


def title_case(col: Column) -> Column:
    """Capitalize every run of letters, so ``new-delhi`` becomes ``New-Delhi``.

    Letters are those with a case. ``initcap`` starts words at spaces only; a marked space
    goes in before it wherever another character is followed by a letter, and out after it.
    """
    marked = F.regexp_replace(F.lower(col), f"([^{CASED} ])(?=[{CASED}])", f"$1{MARK} ")
    return F.replace(F.initcap(marked), F.lit(MARK + " "), F.lit(""))


def normalize_header(col: Column) -> Column:
    return F.regexp_replace(F.lower(strip(col)), r"(?U)\s+", " ")


def header_signature(headers: Column) -> Column:
    """SHA-1 of the sorted headers, the key of a saved mapping."""
    return F.sha1(F.array_join(F.array_sort(headers), "|"))


def product_label(sku: Column, asin: Column) -> Column:
    sku, asin = blank_to_null(sku), blank_to_null(asin)
    return (
        F.when(sku.isNotNull() & asin.isNotNull(), F.concat(sku, F.lit(" ("), asin, F.lit(")")))
        .when(sku.isNotNull(), sku)
        .when(asin.isNotNull(), F.concat(F.lit("Unknown ("), asin, F.lit(")")))
        .otherwise(fixed.UNKNOWN_LABEL)
    )


def sku_label(sku: Column) -> Column:
    return F.when(blank_to_null(sku).isNull(), fixed.UNKNOWN_LABEL).otherwise(sku)


def _number(value: Column, digits: int) -> Column:
    """``format_number`` with infinities spelled ``inf``."""
    as_double = value.cast("double")
    return (
        F.when(as_double == float("inf"), "inf")
        .when(as_double == float("-inf"), "-inf")
        .otherwise(F.format_number(value, digits))
    )


def rupees(amount: Column) -> Column:
    return F.concat(F.lit("₹"), _number(amount, 2))


def thousands(value: Column) -> Column:
    return F.format_number(value, 0)


def percent(value: Column, signed: bool = False) -> Column:
    """One decimal and no thousands separator; ``signed`` puts a plus before gains."""
    text = F.concat(F.translate(_number(value, 1), ",", ""), F.lit("%"))
    return F.when(value >= 0, F.concat(F.lit("+"), text)).otherwise(text) if signed else text
