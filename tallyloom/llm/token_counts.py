"""Token counts by overlap resynchronisation.

Texts longer than ``CHUNK`` characters are encoded in chunks that overlap, with the offsets of their tokens. Neighbours are
spliced where both have a token that begins after white space inside the overlap, and the same tokens for the word that
follows. Such a boundary is stable: the tokenizer splits at white space and drops it, and neither its normalizer nor an
added token reaches across, so what stands on one side has no effect on the other. Where no boundary is
shared the overlap is doubled, and after that the chunk grows, up to the whole text.

Whether a tokenizer splits at white space is read from its file; the texts of any other are encoded whole.

Shorter texts are summed up from their words between white space, by the same property. The token counts of words
are kept by each Python worker in two generations of bounded size: what was not seen in the last one goes.

Cases: null text counts as empty; repeated rows give repeated results; null ids stay; other columns
are left out; an empty table gives an empty result. Texts may be of any length; one chunk is encoded at a time.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from tallyloom.llm.common import batches_of, cached, rows_of

CHUNK = 65_536
OVERLAP = 256
#: Words a worker keeps in a generation; longer ones are never kept.
STORED_WORDS = 500_000
STORED_LENGTH = 64
#: Characters of texts whose new words are encoded in one call.
TOGETHER = 1_000_000

#: The characters of Unicode's White_Space property.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = re.compile(f"[{SPACES}]")
_WORD = re.compile(f"[^{SPACES}]+")
#: str.split() also splits here, which the tokenizers do not.
_CONTROLS = re.compile("[\x1c-\x1f]")


def splits_at_white_space(definition: str) -> bool:
    """Whether a tokenizer, by its file, drops white space before anything else and no added token holds any."""
    found = json.loads(definition)
    first = found.get("pre_tokenizer") or {}
    while first.get("type") == "Sequence":
        first = (first["pretokenizers"] or [{}])[0]
    if any(_SPACE.search(token["content"]) for token in found.get("added_tokens") or ()):
        return False
    if first.get("type") in ("WhitespaceSplit", "Whitespace", "BertPreTokenizer"):
        return True
    pattern = first.get("pattern", {}).get("Regex")
    if first.get("type") != "Split" or first.get("behavior") != "Removed" or not first.get("invert") or pattern is None:
        return False
    around = ["a", "1", "!", "'", "'s", "\u00e9", ""]
    probes = (f"{a}{w}{b}" for w in "\t\n\r \x0b\x0c\x85\xa0\u1680\u2003\u2028\u2029\u202f\u205f\u3000" for a in around for b in around)
    return not any(_SPACE.search(match[0]) for probe in probes for match in regex.finditer(pattern, probe))


class Tokens(NamedTuple):
    """Tokens of a chunk, with their offsets in the whole text."""

    ids: np.ndarray
    starts: np.ndarray


class Counter:
    """Counts tokens of texts with a tokenizers file."""

    def __init__(self, definition: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        self._library = Tokenizer.from_str(definition)
        self._library.no_truncation()
        self._library.no_padding()
        self._splits = splits_at_white_space(definition)
        self._kept: dict[str, int] = {}
        self._before: dict[str, int] = {}
        self.chunk, self.overlap = chunk, overlap

    def _words(self, text: str) -> list[str]:
        return _WORD.findall(text) if _CONTROLS.search(text) else text.split()

    def _learn(self, words) -> None:
        """Take the words that are not kept from the generation before, or encode them, in few calls."""
        missing = {w for w in words if w not in self._kept}
        if len(self._kept) + len(missing) > STORED_WORDS:
            self._before, self._kept = self._kept, {}
            missing = set(words)
        kept, before, fresh = self._kept, self._before, []
        for word in missing:
            if (n := before.get(word)) is not None:
                kept[word] = n
            elif len(word) <= STORED_LENGTH:
                fresh.append(word)
        for low in range(0, len(fresh), 20_000):
            part = fresh[low : low + 20_000]
            encoded = self._library.encode_batch_fast(part, add_special_tokens=False)
            kept.update(zip(part, (len(e) for e in encoded)))

    def _size(self, word: str) -> int:
        found = self._kept.get(word)
        return len(self._library.encode(word, add_special_tokens=False)) if found is None else found

    def count(self, text: str) -> int:
        return self.counts([text])[0]

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        if not self._splits:
            return [len(self._library.encode(text, add_special_tokens=False)) for text in texts]
        words = [None if len(text) > self.chunk else self._words(text) for text in texts]
        self._learn(list(chain.from_iterable(filter(None, words))))
        return [self._spliced(text) if own is None else self._sum(own) for text, own in zip(texts, words)]

    def _sum(self, words: list[str]) -> int:
        try:
            return sum(map(self._kept.__getitem__, words))
        except KeyError:  # a long word
            return sum(map(self._size, words))

    def _tokens(self, text: str, start: int, end: int) -> Tokens:
        encoded = self._library.encode(text[start:end], add_special_tokens=False)
        return Tokens(np.array(encoded.ids, np.int64), np.array([a for a, _ in encoded.offsets], np.int64) + start)

    def _spliced(self, text: str) -> int:
        """Walk over the chunks: tokens up to a boundary that both have, then on from there."""
        total, done, start, length = 0, 0, 0, len(text)
        end = min(length, self.chunk)
        left = self._tokens(text, start, end)
        while end < length:
            overlap, boundary = self.overlap, None
            while boundary is None and overlap < end - start:
                begin = end - overlap
                following = min(length, begin + max(self.chunk, 2 * overlap))
                right = self._tokens(text, begin, following)
                boundary = self._boundary(text, left, right, max(begin, done), end)
                overlap *= 2
            if boundary is None:  # nothing aligned: the chunk itself grows
                end = min(length, end + max(self.chunk, end - start))
                left = self._tokens(text, start, end)
                continue
            total += int(((left.starts >= done) & (left.starts < boundary)).sum())
            done, start, end, left = boundary, begin, following, right
        return total + int((left.starts >= done).sum())

    def _boundary(self, text: str, left: Tokens, right: Tokens, after: int, end: int) -> int | None:
        """The last token start after white space that both chunks have, with the same tokens up to the word's end."""
        shared = np.intersect1d(left.starts[left.starts > after], right.starts)
        for at in shared[::-1].tolist():
            if not _SPACE.match(text[at - 1]):
                continue
            stop = _WORD.match(text, at)
            if stop is None or stop.end() >= end:  # the chunk may cut the word off
                continue
            one, two = (t.ids[(t.starts >= at) & (t.starts < stop.end())] for t in (left, right))
            if np.array_equal(one, two):
                return at
        return None


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes`` (UTF-8), ``n_tokens, over_limit`` (more than ``limit`` tokens) of every row."""
    with open(path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())  # a fixed vocabulary
    schema = pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches):
        definition = shared.value
        counter = cached(("tokens", hashlib.sha1(definition.encode()).digest()), lambda: Counter(definition))

        def rows():
            for batch in batches:
                held, size = [], 0
                for row in chain(rows_of(batch), [None]):
                    if row is not None:
                        held.append((row[0], row[1] or ""))
                        size += len(held[-1][1])
                    if held and (row is None or size >= TOGETHER):
                        for (doc, value), n in zip(held, counter.counts([value for _, value in held])):
                            yield doc, len(value.encode()), n, n > limit
                        held, size = [], 0

        yield from batches_of(rows(), schema)

    made = docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(
        run, "key long, n_bytes long, n_tokens long, over_limit boolean"
    )
    return made.withColumnRenamed("key", key)
