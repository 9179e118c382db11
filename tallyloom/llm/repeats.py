"""Removal of repeated substrings by distributed prefix doubling, kept sparse.

Every byte covered by a 100-byte string that also starts earlier (smaller id, or same text and earlier
start) is removed. As in prefix doubling, positions carry the rank (name) of the string that starts there,
Spark groups equal names, positions whose name is unique leave, and the rest is named again over a longer
string, until the threshold is passed:

1. 40 bytes, at anchors only (see ``anchors``): equal 100-byte windows have equal anchors at equal offsets, so
   the windows of an anchor with a unique name are unique.
2. The whole context of an anchor: all windows that share the anchor. Of equal contexts the earliest stays; the
   windows of the others are repeats.
3. 93 bytes, for blocks of 8 neighbouring windows of one anchor: the bytes the block's windows share.
   Blocks with a unique name leave; of blocks with equal contexts the earliest stays.
4. 100 bytes, for the single windows that are left: all but the earliest of a name are repeats.

Names are pairs of 64-bit hashes or ids of a group, compared by Spark's sort or hash aggregation, which combines a hot
string's copies in the map tasks. Copies of one string are never gathered.

Cases: null and empty texts lose nothing; equal texts: the one with the smallest id stays; rows with the same id (or a null
id, which comes after all others) are ordered by their text, equal rows arbitrarily; other columns are left out; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from tallyloom.llm import anchors as A
from tallyloom.llm import words as W
from tallyloom.llm.common import batches_of
from tallyloom.sources.workspace import stage

BLOCK = 8
#: Written tables up to these bytes are sent to all tasks, larger ones are joined by shuffle.
BROADCAST_BYTES = 64_000_000
LAST = 2**63 - 1


def _small(df: DataFrame, listed: str | None = None) -> DataFrame:
    """Ask for a broadcast if the written table, of longs and perhaps a list of up to three longs each, is proven small."""
    entries = F.coalesce(F.sum(F.size(listed)), F.lit(0)) * 48 if listed else F.lit(0)
    size = df.agg((F.count("*") * (16 + 8 * len(df.columns)) + entries).alias("bytes")).first()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, dup, text, row``: ids with nulls last, a number that tells rows with equal ids apart, and the whole row."""
    rows = docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("doc"), F.coalesce(text, F.lit("")).alias("text"), F.struct("*").alias("row")
    )
    if rows.groupBy("doc").count().where("count > 1").isEmpty():
        return rows.select("doc", F.lit(0).cast("long").alias("dup"), "text", "row")
    order = Window.partitionBy("doc").orderBy("text")
    return stage(rows.select("doc", (F.row_number().over(order) - 1).cast("long").alias("dup"), "text", "row"), "keyed")


def _table(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64) if v.dtype == np.uint64 else v.astype(np.int64)) for v in columns.values()], names=list(columns))


def _names(batches):
    """Names of all anchors, without their places."""
    for batch in batches:
        for _, _, bounds, data in W.texts_of(batch.column(0)):
            for _, rolling, found in A.find(data, bounds):
                names, counts = np.unique(rolling.hashes(found.anchor, found.anchor + A.GRAM), return_counts=True)
                yield _table({"name": names, "n": counts})


def _anchors(batches):
    for batch in batches:
        doc, dup = (batch.column(i).to_numpy() for i in (0, 1))
        for first, _, bounds, data in W.texts_of(batch.column(2)):
            for offset, rolling, found in A.find(data, bounds):
                row, origin = found.row + first, bounds[found.row] - offset
                context = rolling.hashes(found.low, found.high + A.WINDOW)
                before = (found.anchor - found.low).astype(np.uint64)
                yield _table(
                    {
                        "name": rolling.hashes(found.anchor, found.anchor + A.GRAM),
                        "context": W.mix(context + before * np.uint64(0x9E3779B97F4A7C15)),
                        "doc": doc[row],
                        "dup": dup[row],
                        "anchor": found.anchor - origin,
                        "low": found.low - origin,
                        "high": found.high - origin,
                    }
                )


def _pieces(batch: pa.RecordBatch, column: str):
    """(doc, dup, bytes, positions) of rows with a list of places; a place is a tuple of longs."""
    fields = batch.schema.names
    places = batch.column(fields.index(column))
    for i in range(batch.num_rows):
        text = np.frombuffer(batch.column(fields.index("text"))[i].as_buffer(), np.uint8)
        item = places[i].values
        yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), text, [item.field(k).to_numpy() for k in range(item.type.num_fields)]


def _hashed(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of substrings of one text, slice by slice, so that memory does not follow the text's length."""
    out = np.zeros(len(starts), np.uint64)
    order = np.argsort(starts, kind="stable")
    at = 0
    while at < len(order):
        low = int(starts[order[at]])
        stop = int(np.searchsorted(starts[order], low + W.SLICE, "left"))
        chosen = order[at:stop]
        rolling = A.Rolling(text[low : int(ends[chosen].max())])
        out[chosen] = rolling.hashes(starts[chosen] - low, ends[chosen] - low)
        at = stop
    return out


def _blocks(batches):
    """Blocks of neighbouring windows of the given anchors, by their offset from the anchor."""
    for batch in batches:
        for doc, dup, text, (anchor, low, high) in _pieces(batch, "places"):
            span = A.WINDOW - A.GRAM + 1
            offset = np.arange(0, span, BLOCK)
            far = np.minimum(offset + BLOCK, span) - 1
            first = np.maximum(anchor[:, None] - far, low[:, None])
            last = np.minimum(anchor[:, None] - offset, high[:, None])
            where, k = np.nonzero(first <= last)
            first, last, anchor_ = first[where, k], last[where, k], anchor[where]
            core = _hashed(text, anchor_ - offset[k], anchor_ - far[k] + A.WINDOW)
            whole = _hashed(text, first, last + A.WINDOW)
            inside = (anchor_ - first) * 64 + (anchor_ - last)
            yield _table(
                {
                    "core": W.mix(core + k.astype(np.uint64)),
                    "whole": W.mix(whole + inside.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)),
                    "doc": np.full(len(k), doc),
                    "dup": np.full(len(k), dup),
                    "first": first,
                    "last": last,
                }
            )


def _windows(batches):
    """Every window of the given runs of starts, named by its two halves."""
    for batch in batches:
        for doc, dup, text, (first, last) in _pieces(batch, "places"):
            length = last - first + 1
            start = np.repeat(first - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
            half = A.WINDOW // 2
            yield _table(
                {
                    "left": _hashed(text, start, start + half),
                    "right": _hashed(text, start + half, start + A.WINDOW),
                    "doc": np.full(len(start), doc),
                    "dup": np.full(len(start), dup),
                    "start": start,
                }
            )


def _split(rows: DataFrame, name: list[str], place: list[str], carried: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(earliest row of each name, all other rows), both written. The rows must be written already."""
    earliest = rows.groupBy(*name).agg(F.min(F.struct(*place, *carried)).alias("best"), F.count("*").alias("n"))
    earliest = stage(earliest.select(*name, "best.*", "n"), "earliest")
    repeated = earliest.where("n > 1").select(*name, *[F.col(c).alias(f"best_{c}") for c in place])
    joined = rows.join(repeated, name)
    later = joined.where(F.struct(*place) > F.struct(*[F.col(f"best_{c}") for c in place]))
    return earliest.drop("n"), later


def _with_places(texts: DataFrame, rows: DataFrame, fields: list[str]) -> DataFrame:
    """Texts with the list of their places; one row per text, so the list is no longer than the text."""
    places = stage(rows.groupBy("doc", "dup").agg(F.collect_list(F.struct(*fields)).alias("places")), "places")
    return texts.join(_small(places, "places"), ["doc", "dup"]).select("doc", "dup", "text", "places")


def repeated_runs(texts: DataFrame) -> DataFrame:
    """``doc, dup, runs``: the merged byte ranges (``low`` to before ``high``) to remove, for texts that have any."""
    counts = texts.select("text").mapInArrow(_names, "name long, n long").groupBy("name").agg(F.sum("n").alias("n"))
    names = stage(counts.where("n > 1").select("name"), "names")
    found = texts.select("doc", "dup", "text").mapInArrow(_anchors, "name long, context long, doc long, dup long, anchor long, low long, high long")
    found = stage(found.join(_small(names), "name"), "anchors")

    firsts, later = _split(found, ["context"], ["doc", "dup", "anchor"], ["name", "low", "high"])
    spans = [later.select("doc", "dup", "low", (F.col("high") + A.WINDOW).alias("high"))]

    again = stage(firsts.groupBy("name").count().where("count > 1").select("name"), "names")
    left = firsts.join(_small(again), "name").select("doc", "dup", "anchor", "low", "high")
    blocks = _with_places(texts, left, ["anchor", "low", "high"]).mapInArrow(
        _blocks, "core long, whole long, doc long, dup long, first long, last long"
    )
    blocks = stage(blocks, "blocks")
    cores = stage(blocks.groupBy("core").count().where("count > 1").select("core"), "cores")
    blocks = stage(blocks.join(_small(cores), "core"), "blocks")
    firsts, later = _split(blocks, ["core", "whole"], ["doc", "dup", "first"], ["last"])
    spans.append(later.select("doc", "dup", F.col("first").alias("low"), (F.col("last") + A.WINDOW).alias("high")))

    again = stage(firsts.groupBy("core").count().where("count > 1").select("core"), "cores")
    left = firsts.join(_small(again), "core").select("doc", "dup", "first", "last")
    windows = _with_places(texts, left, ["first", "last"]).mapInArrow(_windows, "left long, right long, doc long, dup long, start long")
    _, later = _split(stage(windows, "windows"), ["left", "right"], ["doc", "dup", "start"])
    spans.append(later.select("doc", "dup", F.col("start").alias("low"), (F.col("start") + A.WINDOW).alias("high")))
    return _merged(spans[0].unionByName(spans[1]).unionByName(spans[2]))


def _merged(spans: DataFrame) -> DataFrame:
    """Ranges of a text that touch become one."""
    by_text = Window.partitionBy("doc", "dup").orderBy("low", "high")
    reached = F.max("high").over(by_text.rowsBetween(Window.unboundedPreceding, -1))
    starts = spans.withColumn("opens", F.coalesce(F.col("low") > reached, F.lit(True)).cast("int"))
    runs = starts.withColumn("run", F.sum("opens").over(by_text.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("doc", "dup", "run").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return stage(runs.groupBy("doc", "dup").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("runs")), "runs")


def _removed(batches):
    schema = pa.schema([("doc", pa.int64()), ("dup", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def rows():
        for batch in batches:
            for doc, dup, text, runs in zip(*batch.columns):
                content = memoryview(text.as_buffer())
                spans = [(r["low"], r["high"]) for r in runs.as_py() or []]
                parts, at = [], 0
                for low, high in spans:
                    parts.append(content[at:low])
                    at = high
                kept = b"".join([*parts, content[at:]])
                yield doc.as_py(), dup.as_py(), len(content), len(content) - len(kept), len(spans), kept

    yield from batches_of(rows(), schema, lambda row: len(row[5]))


def _digests(batches):
    for batch in _removed(batches):
        digest = pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column(5)], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], digest], names=["doc", "dup", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` of every row: the bytes left, or with ``digest`` their ``kept_sha256``."""
    texts = keyed(docs, key, text)
    runs = repeated_runs(texts)
    joined = texts.join(_small(runs, "runs"), ["doc", "dup"], "left").select("doc", "dup", "text", "runs")
    last = ("kept_sha256", "string") if digest else ("kept", "binary")
    made = joined.mapInArrow(_digests if digest else _removed, f"doc long, dup long, n_bytes long, n_removed long, n_spans long, {last[0]} {last[1]}")
    return made.select(F.nullif("doc", F.lit(LAST)).alias(key), "n_bytes", "n_removed", "n_spans", last[0])


@F.pandas_udf(StringType())
def _cut(texts: pd.Series, lows: pd.Series, highs: pd.Series) -> pd.Series:
    """Texts without the byte ranges; a character that lost some of its bytes goes."""

    def one(text, low, high):
        content, parts, at = text.encode(), [], 0
        for a, b in zip(low, high):
            parts.append(content[at:a])
            at = b
        return b"".join([*parts, content[at:]]).decode("utf-8", "ignore")

    return pd.Series([one(*x) for x in zip(texts, lows, highs)], dtype=object)


def cleaned(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """All rows and columns, the text without its repeats and ``length`` its code points; null texts stay null."""
    texts = keyed(docs, key, text)
    joined = texts.join(_small(repeated_runs(texts), "runs"), ["doc", "dup"], "left")
    runs = F.coalesce("runs", F.array().cast("array<struct<low: long, high: long>>"))
    left = F.when(F.col(f"row.{text}").isNotNull(), _cut("text", runs["low"], runs["high"]))
    joined = joined.select(left.alias("left"), "row")
    changed = {text: F.col("left"), length: F.length("left").cast(docs.schema[length].dataType)}
    return joined.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
