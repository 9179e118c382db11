"""License statements in texts, found by an exact set-similarity join.

Every run of ``BLOCK`` words of a text (of twice the template's words, if that is more) is a block, and line ends
only separate words, so a statement counts however its lines are wrapped. Blocks are joined with
the templates whose token set they contain to a share of ``threshold`` or more. Tokens are ordered by their
frequency in the corpus, rarest first. A block that contains enough of a template holds one token
of the template's prefix (its ``size - needed + 1`` rarest); texts with fewer of its tokens than
``needed`` are passed over (length filter), and so are words too far from every prefix token to share a block
with one (positional filter). What is left is counted in one pass over the places of the template's tokens.
Templates are a parameter of bounded size, so their index goes to every task; texts never move.

Apart from the join, the places of fixed phrases are listed; their labels always count.

Cases: null text counts as empty (no words, score 0, null places, empty labels); repeated rows give
repeated results; null ids stay; other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm.common import batches_of, rows_of

THRESHOLD = 0.9
BLOCK = 64

#: Phrase and label.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Label and wording of statements that the join looks for.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]

#: Bytes of words are lower-cased ASCII letters, digits and everything above ASCII; others separate.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 or c == 10 else 32 for c in range(256)
)


def folded(text: str | None) -> bytes:
    return (text or "").encode().translate(_FOLD)


class Index:
    """Templates with their tokens in global order, and the prefix tokens that lead to them."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[bytes, int], threshold: float):
        self.templates = []
        for label, wording in templates:
            words = folded(wording).split()
            tokens = sorted(set(words), key=lambda t: (frequency.get(t, 0), t))
            needed = _ceil(threshold, len(tokens))
            prefix = frozenset(tokens[: len(tokens) - needed + 1])
            self.templates.append((label, tokens, needed, prefix, max(BLOCK, 2 * len(words))))
        self.first = frozenset().union(*(t[3] for t in self.templates))
        self.tokens = frozenset(token for t in self.templates for token in t[1])

    def matches(self, words: list[bytes]) -> tuple[dict[int, float], int]:
        """Template and largest containment of every template that a block of the text contains to the
        threshold; number of places, apart from each other, where they stand."""
        at: dict[bytes, list[int]] = {}
        for place, word in enumerate(words):
            if word in self.tokens:
                at.setdefault(word, []).append(place)
        found, spans = {}, []
        for template, (_, tokens, needed, prefix, size) in enumerate(self.templates):
            if prefix.isdisjoint(at) or sum(t in at for t in tokens) < needed:
                continue
            near = sorted(p for t in prefix for p in at.get(t, ()))
            hits = sorted((p, t) for t in tokens for p in at.get(t, ()))
            most = 0
            for low, high in _stretches(near, size):
                part = hits[bisect_left(hits, (low,)) : bisect_left(hits, (high,))]
                if len(part) >= needed:
                    most = max(most, _sweep(part, size, needed, spans))
            if most:
                found[template] = most / len(tokens)
        spans.sort()
        apart, end = 0, -1
        for first, last in spans:
            apart += first > end
            end = max(end, last)
        return found, apart


def _stretches(places: list[int], size: int):
    """Ranges of words that share a block with one of the places; ranges that touch are one."""
    low = high = None
    for place in places:
        if high is not None and place - size + 1 <= high:
            high = place + size
            continue
        if high is not None:
            yield low, high
        low, high = place - size + 1, place + size
    if high is not None:
        yield low, high


def _sweep(hits: list[tuple[int, bytes]], size: int, needed: int, spans: list[tuple[int, int]]) -> int:
    """Most distinct tokens in a block, 0 if below ``needed``; first and last token of the blocks that
    reach it are added to ``spans``."""
    counts: Counter = Counter()
    most = left = 0
    for place, token in hits:
        counts[token] += 1
        while hits[left][0] <= place - size or counts[hits[left][1]] > 1:
            gone = hits[left][1]
            counts[gone] -= 1
            if not counts[gone]:
                del counts[gone]
            left += 1
        if len(counts) >= needed:
            most = max(most, len(counts))
            spans.append((hits[left][0], place))
    return most


def _ceil(threshold: float, size: int) -> int:
    return -int(-threshold * size * (1 - 1e-12) // 1)


def blocks(text: bytes, size: int = BLOCK):
    """All runs of ``size`` words of a folded text: what the join finds templates in, by its definition."""
    words = text.split()
    for low in range(max(1, len(words) - size + 1)):
        yield words[low : low + size]


def places(words: list[bytes], phrases: list[bytes]) -> list[tuple[int, int]]:
    """(first word, phrase) of every place where a phrase's words stand one after the other."""
    line = b" " + b" ".join(words) + b" "
    found, before = [], []
    for n, phrase in enumerate(phrases):
        inner, at = b" " + phrase + b" ", -1
        while (at := line.find(inner, at + 1)) >= 0:
            before = before or list(accumulate((len(word) + 1 for word in words), initial=0))  # the blank before each word
            found.append((bisect_left(before, at), n))
    return found


def token_frequency(docs: DataFrame, templates: list[tuple[str, str]], text: str = "text") -> dict[bytes, int]:
    """Occurrences in all texts of the tokens the templates hold (as many rows as they have tokens)."""
    wanted = frozenset(t for _, wording in templates for t in folded(wording).split())
    schema = pa.schema([("token", pa.binary()), ("n", pa.int64())])

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for (value,) in rows_of(batch):
                counts.update(filter(wanted.__contains__, folded(value).split()))
        yield from batches_of(counts.items(), schema)

    rows = docs.select(text).mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {bytes(r["token"]): r["n"] for r in rows.collect()}


def scan(
    docs: DataFrame,
    templates: list[tuple[str, str]] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
    threshold: float = THRESHOLD,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per row: ``key, n_words, n_base`` (places of all phrases), ``first_word, last_word`` (smallest and
    largest start of a place), ``base_labels, labels`` (phrases' labels; the join's as well), ``score``
    (1 with a phrase, else the largest containment the join found, else 0), ``n_blocks`` (places, apart from each other,
    where it found them).
    """
    frequency = token_frequency(docs, templates, text)
    fixed = [b" ".join(folded(p).split()) for p in phrases]
    names = list(phrases.values())
    schema = pa.schema(
        [("key", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())]
        + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("n_blocks", pa.int64())]
    )

    def run(batches):
        index = Index(templates, frequency, threshold)

        def rows():
            for batch in batches:
                for doc, value in rows_of(batch):
                    content = folded(value)
                    words = content.split()
                    base = places(words, fixed)
                    starts = [start for start, _ in base]
                    base_labels = {names[n] for _, n in base}
                    found, n_blocks = {}, 0
                    if not index.first.isdisjoint(words):
                        found, n_blocks = index.matches(words)
                    labels = base_labels | {index.templates[t][0] for t in found}
                    score = 1.0 if base else max(found.values(), default=0.0)
                    yield (
                        *(doc, len(words), len(base), min(starts, default=None), max(starts, default=None)),
                        *(",".join(sorted(base_labels)), ",".join(sorted(labels)), score, n_blocks),
                    )

        yield from batches_of(rows(), schema)

    made = docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(
        run,
        "key long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_blocks long",
    )
    return made.withColumnRenamed("key", key)
