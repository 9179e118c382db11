"""Mapping upload headers onto the fixed fields.

Works on *cells*: rows of (upload, header, pos, seq, value), so that one job maps any
number of uploads. Matching looks at headers only; values are profiled just for the
fields that use their type to choose between several headers.
"""

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom import fixed
from tallyloom.functions import values
from tallyloom.functions.text import header_signature, normalize_header, strip
from tallyloom.operators.cleaning import Mapping
from tallyloom.schema import SEQ

FIELDS = list(fixed.SYNONYMS)
# Fields whose candidates are told apart by what their values look like.
TYPED_FIELDS = ["order_date", "quantity", "revenue_amount"]
# Bits of a value's look after those of the date formats.
NUMBER, INTEGER = len(fixed.DATE_FORMATS), len(fixed.DATE_FORMATS) + 1


def headers_of(df: DataFrame, upload: str = "upload") -> DataFrame:
    """The headers of a frame as (upload, header, pos) rows."""
    rows = [(upload, name, pos) for pos, name in enumerate(c for c in df.columns if c != SEQ)]
    return df.sparkSession.createDataFrame(rows, "upload string, header string, pos int")


def cells(df: DataFrame, columns: list[str], upload: str | Column = "upload") -> DataFrame:
    """Unpivot text columns into (upload, header, seq, value) rows."""
    name = F.lit(upload) if isinstance(upload, str) else upload
    pairs = F.array(
        *[F.struct(F.lit(c).alias("header"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]
    )
    return df.select(name.alias("upload"), SEQ, F.inline(pairs))


def match_headers(headers: DataFrame) -> DataFrame:
    """(upload, header, pos, field, field_ord, exact): a header matches a field when its
    normalized form contains a synonym of it or is contained in one.

    Every header is expanded over the fixed synonym list in its own row, which needs
    neither a join nor a shuffle.
    """
    norm = normalize_header(F.col("header"))
    fields = []
    for i, (field, words) in enumerate(fixed.SYNONYMS.items()):
        hit, exact = F.lit(False), F.lit(False)
        for word in words:
            hit = hit | F.col("norm").contains(word) | F.lit(word).contains(F.col("norm"))
            exact = exact | (F.col("norm") == word)
        fields.append(
            F.struct(F.lit(field).alias("field"), F.lit(i).alias("field_ord"), hit.alias("hit"), exact.alias("exact"))
        )
    return (
        headers.select("upload", "header", "pos", norm.alias("norm"))
        .select("upload", "header", "pos", "norm", F.inline(F.array(*fields)))
        .where("hit")
        .drop("hit")
    )


def columns_to_profile(headers: list[str]) -> list[str]:
    """Headers of one upload whose values may decide a field: several match a typed field."""

    def matches(header: str, field: str) -> bool:
        norm = " ".join(header.split()).lower()
        return any(word in norm or norm in word for word in fixed.SYNONYMS[field])

    found = {field: [h for h in headers if matches(h, field)] for field in TYPED_FIELDS}
    wanted = {h for hits in found.values() if len(hits) > 1 for h in hits}
    return [h for h in headers if h in wanted]


def date_columns(headers: list[str]) -> list[str]:
    """Headers of one upload that may become its date."""
    return [h for h in headers if any(w in " ".join(h.split()).lower() or " ".join(h.split()).lower() in w for w in fixed.SYNONYMS["order_date"])]


def profile(cell_rows: DataFrame) -> DataFrame:
    """Parse ratios over all non-null values of every (upload, header).

    Values are counted by what they look like first, so that one short row per header and look is shuffled.
    """
    value = F.when(F.col("value").isNotNull(), F.array("value"))
    looked = cell_rows.where(F.col("value").isNotNull()).select("upload", "header", _looks(value)[0].alias("looks"))
    counted = looked.groupBy("upload", "header", "looks").agg(F.count("*").alias("n"))
    return _ratios(counted.groupBy("upload", "header").agg(*_counts(F.col("looks"), F.col("n"))))


def profile_upload(df: DataFrame, columns: list[str], *also: Column, upload: str = "upload") -> DataFrame:
    """One row: the array ``profiles`` of the given columns, and further aggregates of the same pass."""
    cells_of_row = F.array(*[F.col(f"`{name}`").cast("string") for name in columns])
    looked = df.withColumn("looks of all", _looks(cells_of_row)) if columns else df
    entries = [
        F.struct(F.lit(upload).alias("upload"), F.lit(name).alias("header"), *_counts(F.col("looks of all")[i]))
        for i, name in enumerate(columns)
    ]
    return looked.agg(F.array(*entries).alias("profiles"), *also)


def profiles_of(profiled: DataFrame) -> DataFrame:
    """``profile_upload``'s array in the form of ``profile``; columns without a value are left out."""
    return _ratios(profiled.select(F.inline("profiles")).where("sampled > 0"))


def _looks(cell_values: Column) -> Column:
    """What each text may be, as bits: one per date format, then some number, then a plain number; null for null.

    A text has one shape, and is parsed by the formats of that shape only: neither a plain number nor a text with a letter
    other than ``e`` is tried as a number, and no date is one. As a function over an array this is one short piece of
    code for all columns; generated for each of them it outgrows what the JVM compiles.
    """

    # one anchor for all shapes: with one for each, the search tries every shape at every place
    any_shape = "^(?:" + "|".join(shape.removeprefix("^").removesuffix("$") for shape in dict.fromkeys(fixed.DATE_SHAPES.values())) + ")$"

    def look(text: Column) -> Column:
        of_shape: dict[str, list[Column]] = {}
        for i, (form, pattern) in enumerate(fixed.DATE_SHAPES.items()):
            parsed = F.when(values.parse_stripped(text, form).isNotNull(), 1 << i).otherwise(0)
            of_shape.setdefault(pattern, []).append(parsed)
            if "{3,}" in pattern:  # names of three letters have the shape of the full ones too
                of_shape.setdefault(pattern.replace("{3,}", "{3}"), []).append(parsed)
        date = F.lit(0)
        for pattern, forms in reversed(of_shape.items()):
            date = F.when(text.rlike(pattern), reduce(add, forms)).otherwise(date)
        number = F.when(values.money_stripped(text).isNotNull(), 1 << NUMBER).otherwise(0)
        integer = F.when(values.number_stripped(text).isNotNull(), 1 << INTEGER).otherwise(0)
        return (
            F.when(text.isNull(), F.lit(None).cast("int"))
            .when(text == "", 0)
            .when(text.rlike(values.PLAIN_NUMBER), 1 << NUMBER | 1 << INTEGER)
            .when(text.rlike(any_shape), date)
            .when(text.rlike(values.NO_NUMBER), 0)
            .when(text.rlike("[₹$,]"), number)  # an amount perhaps, but no plain number
            .otherwise(number + integer)
        )

    return F.transform(F.transform(cell_values, strip), look)


def _counts(looks: Column, n: Column | None = None) -> list[Column]:
    def count(test: Column) -> Column:
        return F.count_if(test) if n is None else F.coalesce(F.sum(F.when(test, n)), F.lit(0))

    def has(bit: int) -> Column:
        return looks.bitwiseAND(F.lit(1 << bit)) != 0

    return [
        count(looks.isNotNull()).alias("sampled"),
        F.array(*[count(has(i)) for i in range(len(fixed.DATE_FORMATS))]).alias("dates"),
        count(has(NUMBER)).alias("numbers"),
        count(has(INTEGER)).alias("integers"),
    ]


def _ratios(counts: DataFrame) -> DataFrame:
    best, limit = F.array_max("dates"), fixed.PROFILE_RATIO
    formats = F.array(*map(F.lit, fixed.DATE_FORMATS))
    shares = counts.select(
        "upload",
        "header",
        "sampled",
        values.ratio(best, F.col("sampled")).alias("date_ratio"),
        F.when(best > 0, F.element_at(formats, F.array_position("dates", best).cast("int"))).alias("date_format"),
        values.ratio(F.col("numbers"), F.col("sampled")).alias("numeric_ratio"),
        values.ratio(F.col("integers"), F.col("sampled")).alias("integer_ratio"),
    )
    kinds = {"is_date": "date_ratio", "is_numeric": "numeric_ratio", "is_integer": "integer_ratio"}
    return shares.select("*", *[(F.col(ratio) >= limit).alias(flag) for flag, ratio in kinds.items()])


def auto_map(headers: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """(upload, mappings): one header per field, or null.

    ``profiles`` covers at least the headers in ``columns_to_profile``, if there are any.

    Fields are served in their fixed order and a taken header is out for later fields. A
    single candidate is taken; among several, a date, quantity or revenue field takes the
    first whose values fit, revenue preferring headers that speak of an invoice; any other
    field stays open. The candidates of an upload are bounded by its headers, so this runs
    as one fold per upload.
    """
    matched, flags = match_headers(headers), ["is_date", "is_numeric", "is_integer"]
    if profiles is None:
        matched = matched.withColumns({flag: F.lit(False) for flag in flags})
    else:
        matched = matched.join(profiles.select("upload", "header", *flags), ["upload", "header"], "left")
    candidates = (
        matched.groupBy("upload")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "pos",
                        "field",
                        "header",
                        F.coalesce("is_date", F.lit(False)).alias("is_date"),
                        F.coalesce("is_numeric", F.lit(False)).alias("is_numeric"),
                        F.coalesce("is_integer", F.lit(False)).alias("is_integer"),
                        F.col("norm").contains("invoice").alias("is_invoice"),
                    )
                )
            ).alias("all")
        )
    )

    def first(items: Column, test) -> Column:
        return F.try_element_at(F.filter(items, test), F.lit(1))["header"]

    def pick(taken: Column, field: Column) -> Column:
        open_ = F.filter("all", lambda c: (c["field"] == field) & ~F.array_contains(taken, c["header"]))
        invoice_first = F.coalesce(
            first(open_, lambda c: c["is_invoice"] & c["is_numeric"]), first(open_, lambda c: c["is_numeric"])
        )
        return (
            F.when(F.size(open_) == 1, open_[0]["header"])
            .when(field == "order_date", first(open_, lambda c: c["is_date"]))
            .when(field == "quantity", first(open_, lambda c: c["is_integer"]))
            .when(field == "revenue_amount", invoice_first)
        )

    # Unserved fields hold an empty text while folding: arrays of taken headers stay plain.
    taken = F.aggregate(
        F.array(*[F.lit(field) for field in FIELDS]),
        F.array().cast("array<string>"),
        lambda acc, field: F.concat(acc, F.array(F.coalesce(pick(acc, field), F.lit("")))),
    )
    names = F.array(*[F.lit(field) for field in FIELDS])
    return (
        headers.select("upload").distinct()
        .join(candidates, "upload", "left")
        .select("upload", F.coalesce(taken, F.array_repeat(F.lit(""), len(FIELDS))).alias("taken"))
        .select(
            "upload",
            F.map_from_arrays(names, F.transform("taken", lambda h: F.nullif(h, F.lit("")))).alias("mappings"),
        )
    )


def candidates_of(headers: DataFrame, field: str | None = None) -> DataFrame:
    """Headers a person may choose for a field, taken ones included."""
    matched = match_headers(headers)
    return (matched if field is None else matched.where(F.col("field") == field)).select(
        "upload", "field", "pos", "header"
    )


def ambiguous_fields(headers: DataFrame, mapped: DataFrame) -> DataFrame:
    """(upload, field) left open although some header equals one of its synonyms."""
    exact = match_headers(headers).where("exact").select("upload", "field").distinct()
    return (
        exact.join(mapped, "upload")
        .where(F.element_at("mappings", F.col("field")).isNull())
        .select("upload", "field")
    )


def apply_overrides(mapping: Mapping, overrides: Mapping) -> Mapping:
    """A person's choices over an automatic mapping; ``None`` skips a field."""
    return {**mapping, **overrides}


def mappings_json(mappings: Column) -> Column:
    return F.to_json(mappings, {"ignoreNullFields": "false"})


def mappings_from_json(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")


def signatures(headers: DataFrame) -> DataFrame:
    """(upload, headers, signature): the headers of an upload in their own order."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("pos", "header"))), lambda h: h["header"])
    return (
        headers.groupBy("upload")
        .agg(in_order.alias("headers"))
        .withColumn("signature", header_signature(F.col("headers")))
    )


def latest_mappings(saved: DataFrame) -> DataFrame:
    """The last saved mapping of every signature."""
    return saved.groupBy("signature").agg(
        F.max_by("headers", "saved_at").alias("headers"), F.max_by("mappings", "saved_at").alias("mappings")
    )


def lookup(saved: DataFrame, headers: DataFrame) -> DataFrame:
    """(upload, signature, mappings) of the uploads whose headers were mapped before."""
    return (
        signatures(headers)
        .join(latest_mappings(saved).select("signature", "mappings"), "signature")
        .select("upload", "signature", "mappings")
    )
