"""Removal of every repeated run of words by fixed-block anchors.

A word goes if it lies in a window of 35 words that also starts anywhere else. Blocks of 18 words that begin at every
eighteenth word are the index; any window holds one of them whole, and where its words start elsewhere, a rolling
window of 18 words there meets the block. Rolling windows that meet a block are hits. Hits are extended to both sides:
of the 18 windows around a hit those that start elsewhere too are kept, and together they are the maximal repeats.

A probe for each word would shuffle some seven times the input, so a first step leaves only stretches that can
repeat without being settled. Of each window the 18 words of smallest hash are its name, and neighbouring windows
mostly share one, so there is about one name in ten words. Windows whose name occurs once do not repeat. Where
all windows of a name, as far as they reach in their text, occur twice, all of them repeat and nothing more needs to
be asked; one of each such reach remains as a reference. Blocks and probes cover all the rest and the references.

Words, blocks and windows are known by 64-bit hashes, whole windows by two of them. Names, blocks and windows are
counted by Spark with sums in the map tasks; copies are never gathered.

Cases: null and empty texts and those of fewer than 35 words lose nothing; equal texts lose all words (all
copies go, none is kept); rows without an id or with a repeated one are rows of their own; other columns are left out; an
empty table gives an empty result. Texts are read in slices, but their words' hashes are held at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyloom.llm import words as W
from tallyloom.llm.anchors import Rolling
from tallyloom.llm.common import batches_of
from tallyloom.sources.workspace import stage

WINDOW = 35
BLOCK = 18
#: Words of a stretch that are one row.
CHUNK = 4_096
#: Words whose names are sought at a time.
PIECE = 1 << 20
#: Bytes up to which a written table of known size is sent to all tasks.
BROADCAST_BYTES = 64_000_000

_BYTES = np.arange(1, 257, dtype=np.uint64)
_LOW = np.uint64((1 << 21) - 1)
_TURN = np.uint64(0x9E3779B97F4A7C15)


def _slices(data: np.ndarray) -> Iterator[np.ndarray]:
    """Slices that end with white space or the text, of about a megabyte or one longer word."""
    low = 0
    while low < len(data):
        high, step = min(len(data), low + W.SLICE), W.SLICE
        while high < len(data):
            blanks = np.flatnonzero(~W._IS_WORD[data[high - step : high]])
            if len(blanks):
                high = high - step + int(blanks[-1]) + 1
                break
            high, step = min(len(data), high + W.SLICE), W.SLICE
        yield data[low:high]
        low = high


def _hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of the words of a slice, letters as they are."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = W._IS_WORD[data]
    turn = np.diff(inside)
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    power, inverse = W._power(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * power, out=sums[1:])
    return starts, W.mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def words_of(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bounds of its rows in the words, word hashes) of groups of texts."""
    for low, high, offsets, data in W.texts_of(texts):
        if high - low == 1:
            parts = [_hashes(s)[1] for s in _slices(data)]
            found = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield low, np.array([0, len(found)]), found
            continue
        spread = np.full(len(data) + high - low, 32, np.uint8)
        spread[np.arange(len(data)) + np.repeat(np.arange(high - low), np.diff(offsets))] = data
        starts, found = _hashes(spread)
        yield low, np.searchsorted(starts, offsets + np.arange(high - low + 1)), found


def named(words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, Rolling, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(offset, hashes, row, place of the name, first and last window it names) of pieces of some texts' words."""
    low = 0
    while len(words) - low >= WINDOW:
        high = min(len(words), low + PIECE)
        rolling = Rolling(words[low:high])
        blocks = rolling.every(BLOCK)
        keys = (blocks & ~_LOW) | np.arange(len(blocks), dtype=np.uint64)
        least, width = keys, 1
        span = WINDOW - BLOCK + 1
        while width * 2 <= span:
            least, width = np.minimum(least[:-width], least[width:]), width * 2
        if rest := span - width:
            least = np.minimum(least[: len(least) - rest], least[rest:])
        place = (least & _LOW).astype(np.int64)
        row = np.searchsorted(bounds - low, np.arange(len(place)), "right") - 1
        inside = np.arange(len(place)) + WINDOW <= (bounds - low)[np.minimum(row + 1, len(bounds) - 1)]
        change = np.ones(len(place) + 1, bool)
        change[1:-1] = (place[1:] != place[:-1]) | (inside[1:] != inside[:-1]) | (row[1:] != row[:-1])
        edges = np.flatnonzero(change)
        first, last = edges[:-1], edges[1:] - 1
        kept = inside[first]
        yield low, rolling, row[first[kept]], place[first[kept]], first[kept], last[kept]
        if high == len(words):
            return
        low = high - WINDOW + 1


def _table(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns.values()], names=list(columns))


def _names(batches):
    for batch in batches:
        for _, bounds, words in words_of(batch.column(0)):
            for _, rolling, _, place, _, _ in named(words, bounds):
                names, counts = np.unique(rolling.hashes(place, place + BLOCK), return_counts=True)
                yield _table(name=names, n=counts)


def _reaches(batches):
    for batch in batches:
        no = batch.column(0).to_numpy()
        for first, bounds, words in words_of(batch.column(1)):
            for offset, rolling, row, place, low, high in named(words, bounds):
                reach = rolling.hashes(low, high + WINDOW)
                shift = offset - bounds[row]
                yield _table(
                    name=rolling.hashes(place, place + BLOCK),
                    reach=W.mix(reach + (place - low).astype(np.uint64) * _TURN),
                    no=no[first + row],
                    low=low + shift,
                    high=high + shift,
                )


def _stretches(batches):
    """Words of the places, merged and cut into chunks that overlap by a window."""
    schema = pa.schema([("no", pa.int64()), ("start", pa.int64()), ("words", pa.list_(pa.int64()))])

    def rows():
        for batch in batches:
            no, texts, places = batch.columns
            for i in range(batch.num_rows):
                (_, _, words), item = next(words_of(texts.slice(i, 1))), places[i].values
                low, high = (np.sort(item.field(k).to_numpy()) for k in (0, 1))
                # sorted ends belong to sorted starts, as far as merged ranges are concerned
                opens = np.append(True, low[1:] > np.maximum.accumulate(high)[:-1] + WINDOW)
                for start, end in zip(low[opens].tolist(), high[np.append(opens[1:], True)].tolist()):
                    for at in range(start, end + 1, CHUNK):
                        yield no[i].as_py(), at, words[at : min(at + CHUNK - 1, end) + WINDOW].view(np.int64)

    yield from batches_of(rows(), schema, lambda row: 8 * len(row[2]))


def _probes(batches):
    """Every rolling window of the stretches."""
    for batch in batches:
        no, start, words = batch.columns
        for i in range(batch.num_rows):
            block = Rolling(words[i].values.to_numpy().view(np.uint64)).every(BLOCK)
            at = start[i].as_py()
            yield _table(block=block, no=np.full(len(block), no[i].as_py()), start=np.full(len(block), at), pos=at + np.arange(len(block)))


def _extended(batches):
    """The windows around the hits of each stretch, by two hashes."""
    for batch in batches:
        no, start, words, hits = batch.columns
        for i in range(batch.num_rows):
            own = words[i].values.to_numpy().view(np.uint64)
            hit = hits[i].values.to_numpy() - start[i].as_py()
            near = np.zeros(len(own) + 1, np.int64)
            np.add.at(near, np.maximum(hit - (WINDOW - BLOCK), 0), 1)
            np.add.at(near, np.minimum(hit + 1, len(own)), -1)
            at = np.flatnonzero(np.cumsum(near)[: min(CHUNK, len(own) - WINDOW + 1)] > 0)
            one, two = Rolling(own), Rolling(W.mix(own ^ _TURN))
            yield _table(x=one.hashes(at, at + WINDOW), y=two.hashes(at, at + WINDOW), no=np.full(len(at), no[i].as_py()), low=at + start[i].as_py())


def _small(df: DataFrame, row_bytes: int, listed: str | None = None) -> DataFrame:
    """Ask for a broadcast if the written table, with lists of pairs of longs, is proven small."""
    size = df.agg(F.count("*") * row_bytes + (F.coalesce(F.sum(F.size(listed)), F.lit(0)) * 32 if listed else 0)).first()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def numbered(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, bool]:
    """``no, id, text`` with a number of its own for each row, and whether that is the id: all ids are known and different."""
    ids = docs.agg(F.count("*").alias("rows"), F.count(key).alias("known"), F.count_distinct(key).alias("ids")).first()
    texts = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    if ids["rows"] == ids["ids"]:
        return texts.select(F.col("id").cast("long").alias("no"), "id", "text"), True
    return stage(texts.select(F.monotonically_increasing_id().alias("no"), "id", "text"), "numbered"), False


def repeats(texts: DataFrame) -> DataFrame:
    """``no, runs``: ranges of word numbers (``low`` to before ``high``) that repeat, for the texts ``no, text`` that have any."""
    counts = texts.select("text").mapInArrow(_names, "name long, n long").groupBy("name").agg(F.sum("n").alias("n"))
    names = stage(counts.where("n > 1").select("name"), "names")
    found = texts.select("no", "text").mapInArrow(_reaches, "name long, reach long, no long, low long, high long")
    found = stage(found.join(_small(names, 16), "name"), "reaches")
    reaches = stage(found.groupBy("name", "reach").agg(F.count("*").alias("n"), F.min(F.struct("no", "low", "high")).alias("place")), "reaches")
    settled = reaches.where("n > 1").select("name", "reach")
    spans = found.join(settled, ["name", "reach"]).select("no", "low", (F.col("high") + WINDOW).alias("high"))

    contested = reaches.groupBy("name").count().where("count > 1").select("name")
    places = reaches.join(contested, "name").select("place.*")
    places = stage(places.groupBy("no").agg(F.collect_list(F.struct("low", "high")).alias("places")), "places")
    stretches = texts.join(_small(places, 40, "places"), "no").select("no", "text", "places").mapInArrow(_stretches, "no long, start long, words array<long>")
    stretches = stage(stretches, "stretches")

    probes = stretches.mapInArrow(_probes, "block long, no long, start long, pos long")
    aligned = F.col("pos") % BLOCK == 0
    probes = stage(probes, "probes")
    met = probes.groupBy("block").agg(F.count("*").alias("n"), F.max(aligned).alias("indexed")).where("n > 1 AND indexed").select("block")
    hits = probes.join(met, "block").groupBy("no", "start").agg(F.collect_list("pos").alias("hits"))
    windows = stretches.join(hits, ["no", "start"]).select("no", "start", "words", "hits").mapInArrow(_extended, "x long, y long, no long, low long")
    windows = stage(windows, "windows")
    again = windows.groupBy("x", "y").count().where("count > 1").select("x", "y")
    more = windows.join(again, ["x", "y"]).select("no", "low", (F.col("low") + WINDOW).alias("high"))
    return _merged(spans.unionByName(more))


def _merged(spans: DataFrame) -> DataFrame:
    """Ranges of a text that meet become one."""
    by_text = Window.partitionBy("no").orderBy("low", "high")
    reached = F.max("high").over(by_text.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("opens", F.coalesce(F.col("low") > reached, F.lit(True)).cast("int"))
    runs = opened.withColumn("run", F.sum("opens").over(by_text.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("no", "run").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return stage(runs.groupBy("no").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("runs")), "runs")


def _kept(data: np.ndarray, runs: list[tuple[int, int]]) -> Iterator[list[bytes]]:
    """The words outside the runs, slice by slice; ends with nothing to tell but the number of all words."""
    count = 0
    for part in _slices(data):
        words = part.tobytes().split()
        kept, at = [], count
        for low, high in runs:
            if high <= count or low >= count + len(words):
                continue
            kept += words[at - count : max(low - count, 0)]
            at = min(max(high, at), count + len(words))
        kept += words[at - count :]
        count += len(words)
        yield kept, count


def _digests(batches):
    schema = pa.schema([("no", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def rows():
        for batch in batches:
            no, texts, runs = batch.columns
            for i in range(batch.num_rows):
                spans = [(r["low"], r["high"]) for r in runs[i].as_py() or []]
                digest, kept, count = hashlib.sha256(), 0, 0
                data = np.frombuffer(texts[i].as_buffer(), np.uint8) if texts[i].is_valid else np.zeros(0, np.uint8)
                for words, count in _kept(data, spans):
                    if words:
                        digest.update((b" " if kept else b"") + b" ".join(words))
                        kept += len(words)
                yield no[i].as_py(), count, count - kept, digest.hexdigest()

    yield from batches_of(rows(), schema)


def _cleaned(batches):
    schema = pa.schema([("no", pa.int64()), ("kept", pa.string())])

    def rows():
        for batch in batches:
            no, texts, runs = batch.columns
            for i in range(batch.num_rows):
                spans = [(r["low"], r["high"]) for r in runs[i].as_py() or []]
                data = np.frombuffer(texts[i].as_buffer(), np.uint8) if texts[i].is_valid else np.zeros(0, np.uint8)
                yield no[i].as_py(), b" ".join(w for words, _ in _kept(data, spans) for w in words).decode()

    yield from batches_of(rows(), schema, lambda row: len(row[1]))


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """Of every row the ``key`` and ``kept``, its words that do not repeat; with ``digest`` instead ``n_words, n_removed, kept_sha256``."""
    texts, by_id = numbered(docs, key, text)
    joined = texts.join(_small(repeats(texts), 40, "runs"), "no", "left").select("no", "text", "runs")
    if digest:
        made, told = joined.mapInArrow(_digests, "no long, n_words long, n_removed long, kept_sha256 string"), ["n_words", "n_removed", "kept_sha256"]
    else:
        made, told = joined.mapInArrow(_cleaned, "no long, kept string"), ["kept"]
    if by_id:
        return made.select(F.col("no").cast(docs.schema[key].dataType).alias(key), *told)
    return made.join(texts.select("no", "id"), "no").select(F.col("id").alias(key), *told)


#: The same by counting every window, for DuckDB.
SQL = r"""
WITH parts AS (
  SELECT row_number() OVER () AS id, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), windows AS (
  SELECT id, i, md5(array_to_string(w[i : i + 34], ' ')) AS h
  FROM (SELECT id, w, unnest(range(1, len(w) - 33)) AS i FROM parts WHERE len(w) >= 35)
), again AS (
  SELECT h FROM windows GROUP BY h HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT id, unnest(range(i, i + 35)) AS i FROM windows SEMI JOIN again USING (h)
), words AS (
  SELECT id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM parts
), kept AS (
  SELECT id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (id, i) GROUP BY id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM parts LEFT JOIN kept USING (id)
"""
