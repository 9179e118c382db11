"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is halved down to leaves, leaves are encoded, and neighbours are joined: the end of the left
part and the start of the right part are encoded again as one window, and the tokens outside the
window stay. The window grows until each end is a *cut*: a place where the split pattern has a
boundary whatever stands around it, so that the text on either side encodes on its own. Cuts are
changes of character class after a non-space (letters | digits | other), except from other to a
letter, because of contractions. No match of the pattern spans a cut, and none ends differently
because of what follows one. Where a part has no cut, the window takes all of it. Decoding
concatenates bytes up a tree of the ids.

Cases: null text counts as empty (0 tokens); repeated rows give repeated results; null ids stay;
other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm.common import batches_of, cached, rows_of

LEAF_CHARS = 4096
LEAF_IDS = 4096
WINDOW = 32

_CUT = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=[^\p{White_Space}\p{L}\p{N}])(?=[\p{White_Space}\p{N}])")


class Codec:
    """A rank file and its split pattern; encodes and decodes single texts."""

    def __init__(self, ranks: bytes, pattern: str, leaf: int = LEAF_CHARS, window: int = WINDOW):
        pairs = (line.split() for line in ranks.splitlines() if line)
        table = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self._library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.leaf, self.window = leaf, window

    def _ids(self, text: str) -> list[int]:
        return self._library.encode_ordinary(text)

    def encode(self, text: str) -> np.ndarray:
        return self._reduce(text, 0, len(text))

    def _reduce(self, text: str, start: int, end: int) -> np.ndarray:
        if end - start <= self.leaf:
            return np.array(self._ids(text[start:end]), dtype="<u4")
        middle = (start + end) // 2
        left, right = self._reduce(text, start, middle), self._reduce(text, middle, end)
        first, last = self._cut_before(text, start, middle), self._cut_after(text, middle, end)
        kept = len(left) - len(self._ids(text[first:middle]))
        skipped = len(self._ids(text[middle:last]))
        window = np.array(self._ids(text[first:last]), dtype="<u4")
        return np.concatenate([left[:kept], window, right[skipped:]])

    def _cut_before(self, text: str, start: int, middle: int) -> int:
        """Last cut of the left part, or its start."""
        width = self.window
        while True:
            low = max(start, middle - width)
            found = [m.start() for m in _CUT.finditer(text[low:middle])]
            if found:
                return low + found[-1]
            if low == start:
                return start
            width *= 2

    def _cut_after(self, text: str, middle: int, end: int) -> int:
        """First cut of the right part, or its end."""
        width = self.window
        while True:
            high = min(end, middle + width)
            found = _CUT.search(text[middle:high])
            if found:
                return middle + found.start()
            if high == end:
                return end
            width *= 2

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= LEAF_IDS:
            return self._library.decode_bytes(ids.tolist())
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def _codec(shared) -> Codec:
    ranks, pattern = shared.value
    return cached(("bpe", hashlib.sha1(ranks).digest(), pattern), lambda: Codec(ranks, pattern))


def _shared(df: DataFrame, path: str, pattern: str):
    """The rank file (a fixed vocabulary of about a megabyte) for all executors."""
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast((file.read(), pattern))


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``ids`` (array of int), ``n_tokens`` of every row."""
    shared = _shared(docs, path, pattern)
    schema = pa.schema([("key", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64())])

    def run(batches):
        codec = _codec(shared)

        def rows():
            for batch in batches:
                for doc, value in rows_of(batch):
                    ids = codec.encode(value or "")
                    yield doc, ids.astype(np.int32), len(ids)

        yield from batches_of(rows(), schema, lambda row: 4 * row[2])

    made = docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, "key long, ids array<int>, n_tokens long")
    return made.withColumnRenamed("key", key)


def decode(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and ``bytes`` of every row of ids; null ids decode to nothing."""
    shared = _shared(encoded, path, pattern)
    schema = pa.schema([("key", pa.int64()), ("bytes", pa.binary())])

    def run(batches):
        codec = _codec(shared)
        rows = ((doc, codec.decode(np.array(value or [], "<u4"))) for batch in batches for doc, value in rows_of(batch))
        yield from batches_of(rows, schema, lambda row: len(row[1]))

    made = encoded.select(F.col(key).cast("long"), F.col(ids)).mapInArrow(run, "key long, bytes binary")
    return made.withColumnRenamed("key", key)


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode in one task.

    Returns ``key, n_tokens, ids_sha256`` (ids as little-endian unsigned 32-bit) and ``decoded_sha256``, and the
    ``ids`` themselves if asked for.
    """
    shared = _shared(docs, path, pattern)
    fields = [("key", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches):
        codec = _codec(shared)

        def rows():
            for batch in batches:
                for doc, value in rows_of(batch):
                    ids = codec.encode(value or "")
                    digests = hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()
                    yield (doc, len(ids), *digests, *[ids.astype(np.int32)] * with_ids)

        yield from batches_of(rows(), schema, lambda row: 4 * row[1] * with_ids)

    made = docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(
        run, "key long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    )
    return made.withColumnRenamed("key", key)
