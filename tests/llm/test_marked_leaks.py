"""Leaks whose words stand next to punctuation, or are lightly edited."""

import random
import unicodedata

import numpy as np

from tallyloom.llm import bm25
from tallyloom.llm import words as W
from tests.llm.conftest import prose


def test_marks_are_blanked():
    text = "Sea?Paris, «mer» “x” don’t 漢字。かな é_1 😀 é कि।"
    expected = "".join(" " * len(c.encode()) if unicodedata.category(c)[0] in "PSZ" else c for c in text)
    assert W.unmarked(np.frombuffer(text.encode(), np.uint8)).tobytes().decode() == expected
    assert not len(W.unmarked(np.zeros(0, np.uint8)))


def test_short_answers_next_to_punctuation(spark, docs):
    rng = random.Random(12)
    asked = "What is the capital of the old kingdom by the sea?"
    items = [(1, f"{asked} Brindle"), (2, "four plain words stand"), (3, "Who wrote it? Anna of Brindle"), (4, "+ - × ÷"), (5, "Paris")]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = {
        1: [f"{asked} Brindle{m}" for m in (".", ",", "!", "”", "。")] + [f"“{asked}” (Brindle)", f"{asked[:-1]} ? — *Brindle*", f"{asked}\nA: Brindle\n"],
        2: ["(four plain words stand)", "\"four plain, words stand.\"", "so: four plain words stand; so", "«four plain words stand»"],
        3: ["who wrote it? Anna of Brindle.", "Who wrote it: 'Anna of Brindle'?"],
        4: ["see + - × ÷ there"],
    }
    rows, expected = [], []
    for item, texts in found.items():
        for text in texts:
            expected.append((len(rows), item))
            rows.append((len(rows), f"{prose(rng, 90)} {text} {prose(rng, 90)}"))
    others = [asked, f"{asked} Brandle.", "four plain words, then stand", "Who wrote it?", "+ - ÷", "Paris."]
    rows += [(100 + n, f"{prose(rng, 90)} {text} {prose(rng, 90)}") for n, text in enumerate(others)]
    got = bm25.find(docs(rows), table).select("doc_id", "item_id").collect()
    assert sorted(map(tuple, got)) == sorted(expected)
    kept = bm25.without_leaks(docs(rows), table).select("doc_id").collect()
    assert sorted(r[0] for r in kept) == list(range(100, 100 + len(others)))


def test_lightly_edited_items(spark, docs):
    rng = random.Random(13)
    items = [(n, prose(rng, 40)) for n in range(20)]
    rows = []
    for n, text in items:
        words = [w + rng.choice(["", "", ",", ".", ";", ")", "!"]) for w in text.split()]
        words[rng.randrange(40)] = "other"
        words.pop(rng.randrange(40))
        rows.append((n, f"{prose(rng, 200)} ({' '.join(words).title()}) {prose(rng, 70)}"))
    table = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, bm25.find(docs(rows), table).select("doc_id", "item_id").collect())) == [(n, n) for n in range(20)]
    assert bm25.without_leaks(docs(rows), table).count() == 0
