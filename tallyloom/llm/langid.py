"""Language identification by rank-order profiles.

A profile is a list of the most frequent character n-grams (1 to 3 letters, words padded by one
blank on each side), most frequent first. A text is given to the language whose profile is least
out of place: each of its own most frequent n-grams adds the difference of the two ranks, or the
profile's length where the profile lacks it. Equal counts are ranked by the n-gram's code points, equal
distances by the language's name.

Cases: null text, text without letters, and a corpus without a labelled row give ``und`` and score
0; a null id counts as not held out; repeated rows count (and are predicted) as often as they occur;
other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyloom.llm.common import batches_of, cached, rows_of

PROFILE = 300
UNKNOWN = "und"
#: Distinct n-grams a task holds before it hands its counts on.
HELD = 1_000_000
#: Characters of a text that are counted at a time, up to the next blank.
SLICE = 4_000_000
#: Marks a pair's code: no letter has the code point that a triple would need for this bit alone.
_PAIR = np.uint64(1 << 43)


def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes (three code points of 21 bits) and counts of the n-grams of a text, by code."""
    if len(text) <= SLICE:
        return _grams(text)
    found, low = [], 0
    while low < len(text):
        high = text.find(" ", low + SLICE)
        high = len(text) if high < 0 else high
        found.append(_grams(text[low:high]))
        low = high
    return merged(found)


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    letters = cached("letters", _letters)
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter = letters[points]
    padded = np.zeros(len(points) + 2, np.uint64)
    padded[1:-1] = np.where(is_letter, points, 0)  # 0 is the blank
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != 0) | (padded[:-1] != 0)  # one blank between words
    line = padded[keep]
    shift = np.uint64(21)
    pairs = (line[:-1] << shift) | line[1:]
    triples = (pairs[:-1] << shift) | line[2:]
    triples = triples[line[1:-1] != 0]  # none across words
    codes = np.concatenate([line[line != 0], pairs | _PAIR, triples])
    return np.unique(codes, return_counts=True)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    codes, counts = (np.concatenate(x) for x in zip(*parts))
    codes, where = np.unique(codes, return_inverse=True)
    return codes, np.bincount(where, counts, len(codes)).astype(np.int64)


def ranked(codes: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    return codes[np.argsort(-counts, kind="stable")[:length]]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", length: int = PROFILE) -> DataFrame:
    """``lang, rank, gram``: a profile per non-null language, over all rows of it."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def count(batches):
        held: dict[str, list] = {}

        def out():
            for name, parts in held.items():
                codes, counts = merged(parts)
                for low in range(0, len(codes), 100_000):
                    part = codes[low : low + 100_000]
                    yield pa.record_batch([pa.array([name] * len(part)), pa.array(part.view(np.int64)), pa.array(counts[low : low + 100_000])], schema=schema)
            held.clear()

        waiting = 0
        for batch in batches:
            for value, name in rows_of(batch):
                found = grams(value)
                held.setdefault(name, []).append(found)
                waiting += len(found[0])
                if waiting > HELD:
                    held.update({k: [merged(v)] for k, v in held.items()})
                    waiting = sum(len(v[0][0]) for v in held.values())
                    if waiting > HELD // 2:
                        yield from out()
                        waiting = 0
        yield from out()

    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(text, lang)
    totals = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= length).select("lang", "rank", "gram")


class Profiles:
    def __init__(self, rows: list[tuple[str, int, int]], length: int):
        self.length = length
        self.names = sorted({name for name, _, _ in rows})
        self._known = []
        for name in self.names:
            own = sorted((gram, rank) for n, rank, gram in rows if n == name)
            self._known.append((np.array([g for g, _ in own], np.uint64), np.array([r for _, r in own], np.int64)))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, counts = grams(text or "")
        top = ranked(codes, counts, self.length)
        if not len(top) or not self.names:
            return UNKNOWN, 0.0
        ranks = np.arange(1, len(top) + 1)
        best, name = None, UNKNOWN
        for language, (known, places) in zip(self.names, self._known):
            at = np.minimum(np.searchsorted(known, top), len(known) - 1)
            distance = int(np.where(known[at] == top, np.abs(places[at] - ranks), self.length).sum())
            if best is None or distance < best:
                best, name = distance, language
        return name, 1 - best / (len(top) * self.length)


def predict(docs: DataFrame, profiles: DataFrame, length: int = PROFILE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, lang_pred, score`` of every row; score is 1 less the mean displacement over ``length``.

    The profiles (``length`` rows per language) go to the driver and from there to the tasks.
    """
    known = [(r["lang"], r["rank"], r["gram"]) for r in profiles.collect()]
    shared = docs.sparkSession.sparkContext.broadcast(known)
    schema = pa.schema([("key", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        model = Profiles(shared.value, length)
        rows = ((doc, *model.predict(value)) for batch in batches for doc, value in rows_of(batch))
        yield from batches_of(rows, schema)

    made = docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, "key long, lang_pred string, score double")
    return made.withColumnRenamed("key", key)


def recognised(docs: DataFrame, profiles: DataFrame, least: float, length: int = PROFILE, text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text has a language with a score of ``least`` or more."""
    known = [(r["lang"], r["rank"], r["gram"]) for r in profiles.collect()]
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        model = Profiles(shared.value, length)
        for batch in batches:
            found = (model.predict(value.as_py()) for value in batch.column(text))
            yield batch.filter(pa.array([name != UNKNOWN and score >= least for name, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(key: str = "doc_id"):
    """Rows kept from learning: crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def predictions(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: learned from the rows not held out, over all rows."""
    profiles = learn(docs.where(~held_out()))
    return predict(docs, profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
