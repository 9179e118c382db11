"""Scores that do not depend on how a benchmark is cut, and license places in long texts."""

import collections
import math
import random
import time

from tallyloom.llm import bm25, licenses
from tests.llm.conftest import prose


def brute_scores(items, passages):
    """BM25 of word pairs over an item's own score, by its definition."""
    pairs = {i: collections.Counter(zip(t.split(), t.split()[1:])) for i, t in items}
    pairs = {i: c for i, c in pairs.items() if c}
    mean = sum(c.total() for c in pairs.values()) / len(pairs)
    found = {}
    for i, own in pairs.items():
        weights = {}
        for pair, n in own.items():
            seen = sum(pair in c for c in pairs.values())
            idf = math.log(1 + (len(pairs) - seen + 0.5) / (seen + 0.5))
            weights[pair] = idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * own.total() / mean))
        for doc, text in passages:
            words = text.split()
            held = sum(w for pair, w in weights.items() if pair in set(zip(words, words[1:])))
            found[doc, i] = held / sum(weights.values())
    return found


def test_scores_do_not_depend_on_parts_or_order(spark, docs, monkeypatch):
    rng = random.Random(3)
    common = prose(rng, 12)
    items = [(i, f"{prose(rng, rng.randint(5, 15))} {common} {prose(rng, rng.randint(5, 15))}") for i in range(25)]
    passages = []
    for i, text in items:
        words = text.split()
        passages.append((i, " ".join(words[: rng.randint(len(words) // 2, len(words))])))
    seen = []
    for size, order in ((1, 1), (7, 2), (20_000, 3), (7, 4)):
        monkeypatch.setattr(bm25, "PART_ITEMS", size)
        rng.shuffle(items)
        table = spark.createDataFrame(items, "item_id long, text string").repartition(order)
        seen.append(sorted(map(tuple, bm25.find(docs(passages), table).collect())))
    assert seen[0] == seen[1] == seen[2] == seen[3]
    expected = brute_scores(items, passages)
    assert all(abs(score - expected[doc, item]) < 1e-9 for doc, item, score, _ in seen[0])
    assert {(doc, item) for doc, item, _, _ in seen[0]} <= {k for k, v in expected.items() if v >= 0.5 - 1e-9}
    assert len(seen[0]) >= 15


def test_many_places_take_linear_time():
    words, start = b"cc by nc".split() * 120_000, time.process_time()
    found = licenses.places(words, [b"cc by nc", b"by nc cc"])
    assert len(found) == 239_999 and found[:2] == [(0, 0), (3, 0)] and found[-1] == (359_995, 1)
    assert time.process_time() - start < 20
