"""Parsing and normalizing expressions for raw text columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom import fixed
from tallyloom.functions.text import WHITESPACE, blank_to_null, strip, title_case
from tallyloom.schema import MONEY

ISO_FORMAT = "yyyy-M-d"
# Texts that are certainly a number, in all types used here, and texts that certainly are none.
PLAIN_NUMBER = r"^-?\d{1,15}(?:\.\d{1,4})?$"
NO_NUMBER = "[A-DF-Za-df-z]"
CURRENCY_NOISE = "₹$," + WHITESPACE


def money(col: Column) -> Column:
    """Signed amount without currency noise; null when it is not a number.

    Text is cast to decimal directly: that accepts ``1e3`` and ``.5`` but none of the
    type suffixes (``5D``) and special names that a cast to double would let through.
    """
    return F.nullif(F.translate(col.cast("string"), CURRENCY_NOISE, ""), F.lit("")).try_cast(MONEY)


def money_stripped(text: Column) -> Column:
    """``money`` of a trimmed text, which is looked at once: an empty one is no number to the cast either."""
    return F.translate(text, CURRENCY_NOISE, "").try_cast(MONEY)


def money_or_zero(col: Column) -> Column:
    return F.coalesce(money(col), F.lit(0).cast(MONEY))


def number(col: Column) -> Column:
    """Plain number, no currency noise removed; null when it is not one."""
    return blank_to_null(col.cast("string")).try_cast("decimal(38,18)")


def number_stripped(text: Column) -> Column:
    """``number`` of a trimmed text."""
    return text.try_cast("decimal(38,18)")


def quantity(col: Column) -> Column:
    """Whole units, truncated toward zero; missing or unusable values count as 0."""
    return F.coalesce(_plain_int(col), number(col).try_cast("bigint"), F.lit(0).cast("bigint"))


def missing_quantity(col: Column) -> Column:
    return _plain_int(col).isNull() & number(col).isNull()


def _plain_int(col: Column) -> Column:
    """The common case, far cheaper to parse than a decimal."""
    return strip(col.cast("string")).try_cast("bigint")


def parse_date(col: Column, date_format: str) -> Column:
    """Date in the given format, null for other text."""
    shape, parsed = fixed.DATE_SHAPES.get(date_format), parse_shaped(col, date_format)
    return parsed if shape is None else F.when(strip(col).rlike(shape), parsed)  # matching is cheaper than a failed parse


def parse_shaped(col: Column, date_format: str) -> Column:
    """Date of a text that is known to have the shape of its format."""
    return parse_stripped(strip(col), date_format)


def parse_stripped(text: Column, date_format: str) -> Column:
    # the cast is faster than a formatter, but takes more forms
    return text.try_cast("date") if date_format == ISO_FORMAT else F.try_to_date(text, date_format)


def transaction_type(col: Column) -> Column:
    """Canonical type; unknown spellings are kept in title case, blanks become null."""
    text = F.lower(strip(col))
    out = F.when(text.isNull() | text.isin(fixed.BLANK_TYPES), F.lit(None).cast("string"))
    for canonical, spellings in fixed.TYPE_SPELLINGS.items():
        out = out.when(text.isin(spellings), canonical)
    return out.otherwise(title_case(text))


def region(col: Column) -> Column:
    return title_case(strip(col))


def key_text(col: Column) -> Column:
    """Upsert key form of an id: trimmed, upper case, null when blank."""
    return F.nullif(F.upper(strip(col)), F.lit(""))


def placeholder(col: Column, default: str, extra: tuple[str, ...] = ()) -> Column:
    missing = [*fixed.MISSING_TEXTS, *extra]
    return F.when(col.isNull() | col.isin(missing), default).otherwise(col)


def month_tag(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def week_start(date: Column) -> Column:
    """Monday of the week."""
    return F.trunc(date, "week")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double quotient, null when the denominator is 0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def percent_change(current: Column, previous: Column) -> Column:
    """Change in percent; from 0 it is infinite with the sign of the gain, null for 0 to 0."""
    current, previous = current.cast("double"), previous.cast("double")
    gain = current - previous
    return (
        F.when(previous != 0, F.try_divide(gain, previous) * 100)
        .when(gain > 0, float("inf"))
        .when(gain < 0, float("-inf"))
    )


def row_hash_sum(*cols: Column) -> Column:
    """Aggregate: order-free hash of a set of rows (equal rows add up, they do not cancel).

    The hash passes over nulls, so it also takes where they are.
    """
    nulls = F.concat(*[F.when(col.isNull(), "1").otherwise("0") for col in cols])
    return F.sum(F.xxhash64(*cols, nulls).cast("decimal(20,0)"))
