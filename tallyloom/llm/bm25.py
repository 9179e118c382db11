"""Benchmark decontamination with a BM25 index of the test items.

Training passages (windows of words that overlap by half, each twice as long as the longest item, 128 words at least)
are the queries. A word is a run of letters and digits: punctuation next to it or between words is passed over, in items and
passages alike. Terms are pairs of neighbouring words. The weight of a term in an item is its BM25 weight over the item's score for itself,
so that scores run from 0 to 1 and one threshold serves all items. Postings are ordered by item in
blocks with their largest weight; block-max WAND passes over items, blocks and whole passages whose bounds stay
below the threshold, and returns every item at or above it. A found item is verified: enough of
the 5-word shingles of its question, and of its answer if it has one, must be in the passage. The question of an item ends with
its last question mark; without one, or with nothing after it, all of it is the question.

The number of items, their mean and largest length and the items that hold a term are counted by Spark over the whole
benchmark. The index is broadcast in parts of at most ``PART_ITEMS`` items and about ``PART_WORDS`` words, in the
order of the items' ids, and the parts are run over the passages in turn, so a larger benchmark takes more passes,
not more memory. All parts have the statistics of the whole, so where it is cut changes no score.

Cases: null and empty texts match nothing, nor do items of fewer than two words, which no text can be told
to have leaked, unless punctuation standing alone makes them two (these items go by words between white space, with
their punctuation); an item of fewer than five words is one shingle; repeated rows
give repeated results; a null id of an item or document is carried as null; other columns are left out; an empty
table gives an empty result.
"""

from __future__ import annotations

import uuid
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm import words as W
from tallyloom.llm.common import batches_of, cached
from tallyloom.sources.workspace import stage

THRESHOLD = 0.5
OVERLAP = 0.5
PASSAGE = 128
BLOCK = 64
K1, B = 1.2, 0.75
PART_ITEMS = 20_000
PART_WORDS = 2_000_000


def _hashes(text: str, clean=W.unmarked) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return W.word_hashes(clean(data) if clean else data)[1]


def _cleaner(text: str):
    """How an item's words are read: without marks, or as they stand if too few are left."""
    return None if len(_hashes(text)) < 2 <= len(_hashes(text, None)) else W.unmarked


def _terms(words: np.ndarray) -> np.ndarray:
    return W.shingle_hashes(words, 2) if len(words) > 1 else words[:0]


class Whole(NamedTuple):
    """Of the whole benchmark: items with a term, their mean and largest number of terms."""

    items: int
    mean: float
    longest: int


class Item(NamedTuple):
    id: int | None
    text: str
    frequency: dict[int, int]  # of its terms: the items of the whole benchmark that hold them


class Index:
    """Items of one part: postings with block maxima, and the shingles for verification."""

    def __init__(self, items: list[Item], clean, whole: Whole):
        self.ids = [item.id for item in items]
        self.clean = clean
        self.checks = [_parts(item.text, clean) for item in items]
        self.window = max(PASSAGE, 2 * (whole.longest + 1))
        postings: dict[int, list[tuple[int, float]]] = {}
        for place, item in enumerate(items):
            terms, counts = np.unique(_terms(_hashes(item.text, clean)), return_counts=True)
            if not len(terms):
                continue
            seen = np.array([item.frequency[t] for t in terms.view(np.int64).tolist()])
            idf = np.log(1 + (whole.items - seen + 0.5) / (seen + 0.5))
            weight = idf * counts * (K1 + 1) / (counts + K1 * (1 - B + B * counts.sum() / whole.mean))
            for term, w in zip(terms, weight / weight.sum()):
                postings.setdefault(int(term), []).append((place, float(w)))
        self.terms = np.array(sorted(postings), np.uint64)
        self.lists = [postings[int(t)] for t in self.terms]
        self.blocks = [[(p[min(k + BLOCK, len(p)) - 1][0], max(w for _, w in p[k : k + BLOCK])) for k in range(0, len(p), BLOCK)] for p in self.lists]
        self.most = np.array([max(w for _, w in p) for p in self.lists])

    def found(self, words: np.ndarray) -> dict[int, tuple[float, float]]:
        """Place of every verified item in a document: best BM25 score and shingle overlap."""
        result: dict[int, tuple[float, float]] = {}
        terms = _terms(words)
        if not len(self.terms) or not len(terms):
            return result
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        known = self.terms[at] == terms
        if not known.any():
            return result
        # bounds of all passages at once: repeated words only raise a bound
        sums = np.concatenate([[0.0], np.cumsum(np.where(known, self.most[at], 0.0))])
        step = self.window // 2
        lows = np.arange(0, max(1, len(words) - step), step)
        bounds = sums[np.minimum(lows + self.window - 1, len(terms))] - sums[lows]
        for low in lows[bounds >= THRESHOLD - 1e-9]:
            part = slice(low, low + self.window)
            pairs = slice(low, low + self.window - 1)
            hits = self.retrieve(np.unique(at[pairs][known[pairs]]).tolist())
            if hits:
                shingles = np.unique(W.shingle_hashes(words[part]))
                for place, score in hits:
                    overlap = self.overlap(place, words[part], shingles)
                    if overlap >= OVERLAP:
                        result[place] = max((score, overlap), result.get(place, (0.0, 0.0)))
        return result

    def retrieve(self, terms: list[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """Block-max WAND: all items whose score reaches the threshold, by place."""
        least, found = threshold - 1e-9, []
        cursors = [[self.lists[t][0][0], 0, t] for t in terms]  # current item, position, term
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, term) in enumerate(cursors):
                bound += self.most[term]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            within = [self._block(term, position, item) for _, position, term in cursors[: pivot + 1]]
            if sum(most for _, most in within) < least:
                ends = [last for last, most in within if most]
                following = min([*ends, *(c[0] - 1 for c in cursors[pivot + 1 : pivot + 2])]) + 1
                cursors = self._advance(cursors, max(following, item + 1), pivot + 1)
            elif cursors[0][0] == item:
                score = sum(sorted(self.lists[term][position][1] for _, position, term in cursors[: pivot + 1]))  # in any part the same
                if score >= least:
                    found.append((item, score))
                cursors = self._advance(cursors, item + 1, pivot + 1)
            else:
                cursors = self._advance(cursors, item, pivot)
        return found

    def _block(self, term: int, position: int, item: int) -> tuple[int, float]:
        """Last item and largest weight of the block that may hold ``item``."""
        blocks, k = self.blocks[term], position // BLOCK
        while k < len(blocks) and blocks[k][0] < item:
            k += 1
        return blocks[k] if k < len(blocks) else (2**62, 0.0)

    def _advance(self, cursors: list, item: int, count: int) -> list:
        """Move the first ``count`` cursors to ``item`` or beyond; those at their end go."""
        kept = []
        for cursor in cursors[:count]:
            postings, position, blocks = self.lists[cursor[2]], cursor[1], self.blocks[cursor[2]]
            k = position // BLOCK
            while k < len(blocks) and blocks[k][0] < item:
                k += 1
            position = max(position, k * BLOCK)
            while position < len(postings) and postings[position][0] < item:
                position += 1
            if position < len(postings):
                kept.append([postings[position][0], position, cursor[2]])
        return kept + cursors[count:]

    def overlap(self, place: int, words: np.ndarray, shingles: np.ndarray) -> float:
        """The smaller share of the question's and of the answer's shingles that the passage has."""
        shares = []
        for size, wanted in self.checks[place]:
            own = shingles if size == W.SHINGLE else np.unique(W.shingle_hashes(words, size)) if len(words) >= size else shingles[:0]
            shares.append(float(np.isin(wanted, own).mean()))
        return min(shares, default=0.0)


def _parts(text: str, clean) -> list[tuple[int, np.ndarray]]:
    question, mark, answer = text.rpartition("?")
    parts = [question + mark, answer] if mark and answer.strip() else [text]
    found = []
    for part in parts:
        words = _hashes(part, clean)
        if len(words):
            found.append((min(W.SHINGLE, len(words)), np.unique(W.shingle_hashes(words))))
    return found


def _read(batches):
    """Items with the hashes of their terms, and whether marks count as words."""
    schema = pa.schema([("item_id", pa.int64()), ("text", pa.string()), ("marks", pa.bool_()), ("terms", pa.list_(pa.int64()))])

    def rows():
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1)):
                value = text.as_py() or ""
                clean = _cleaner(value)
                yield item.as_py(), value, clean is None, _terms(_hashes(value, clean)).view(np.int64)

    yield from batches_of(rows(), schema, lambda row: len(row[1]) + 8 * len(row[3]))


def _counted(items: DataFrame) -> tuple[DataFrame, Whole]:
    """``item_id, text, marks, frequency`` in the order of the parts, and what is known of the whole benchmark."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    read = items.mapInArrow(_read, "item_id long, text string, marks boolean, terms array<long>")
    read = stage(read.withColumn("no", F.monotonically_increasing_id()), "items")
    size = F.size("terms")
    whole = read.where(size > 0).agg(F.count("*").alias("n"), F.avg(size).alias("mean"), F.max(size).alias("longest")).first()
    held = read.select("no", F.explode(F.array_distinct("terms")).alias("term"))
    counts = held.groupBy("term").agg(F.count("*").alias("n"))
    known = held.join(counts, "term").groupBy("no").agg(F.map_from_entries(F.collect_list(F.struct("term", "n"))).alias("frequency"))
    rows = read.join(known, "no", "left").select("item_id", "text", "marks", "frequency")
    return rows.orderBy("marks", "item_id", "text"), Whole(whole["n"], whole["mean"] or 0.0, whole["longest"] or 0)


def _pieces(items: DataFrame):
    """Parts of the benchmark with bounded items and words, one at a time on the driver, and how their words are read."""
    rows, whole = _counted(items)
    part, words, marks = [], 0, None
    for row in rows.toLocalIterator():
        if part and (row["marks"] != marks or len(part) >= PART_ITEMS or words >= PART_WORDS):
            yield part, None if marks else W.unmarked, whole
            part, words = [], 0
        marks = row["marks"]
        part.append(Item(row["item_id"], row["text"], row["frequency"] or {}))
        words += len(row["text"]) // 4
    if part:
        yield part, None if marks else W.unmarked, whole


def find(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, item_id, score, overlap`` of every document and item that it leaks."""
    schema = "doc_id long, item_id long, score double, overlap double"
    rows = docs.select(F.col(key).cast("long"), F.col(text))
    context = docs.sparkSession.sparkContext
    found = [rows.mapInArrow(_searcher(context.broadcast((uuid.uuid4().hex, *part))), schema) for part in _pieces(items)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text leaks no item."""

    def cleaner(shared):
        def run(batches):
            name, *part = shared.value
            index = cached(("bm25", name), lambda: Index(*part))
            for batch in batches:
                clean = [not index.found(words) for _, words in W.words_of(batch.column(text), index.clean)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    for part in _pieces(items):
        docs = docs.mapInArrow(cleaner(docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, *part))), docs.schema)
    return docs


def _searcher(shared):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("overlap", pa.float64())])

    def run(batches):
        name, *part = shared.value
        index = cached(("bm25", name), lambda: Index(*part))

        def rows():
            for batch in batches:
                ids = batch.column(0)
                for row, words in W.words_of(batch.column(1), index.clean):
                    for place, (score, overlap) in sorted(index.found(words).items()):
                        yield ids[row].as_py(), index.ids[place], score, overlap

        yield from batches_of(rows(), schema)

    return run
