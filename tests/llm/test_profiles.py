"""Language profiles, distances, ties and scores against their definition in plain Python."""

import collections
import random
import zlib

import pytest

from tallyloom.llm import langid


def brute_grams(text):
    counts = collections.Counter()
    word = ""
    for char in [*(text or "").lower(), " "]:
        if char.isalpha():
            word += char
            continue
        if word:
            padded = f"\0{word}\0"
            counts.update(word)
            counts.update((padded[i : i + 2], "pair") for i in range(len(padded) - 1))
            counts.update(padded[i : i + 3] for i in range(len(padded) - 2))
        word = ""
    return counts


def order(gram):
    """The code of a gram, by which equal counts are ranked."""
    text, pair = gram if isinstance(gram, tuple) else (gram, None)
    code = 0
    for char in text:
        code = code << 21 | ord(char)
    return code | (1 << 43 if pair else 0)


def ranks(counts, length):
    best = sorted(counts, key=lambda g: (-counts[g], order(g)))[:length]
    return {gram: rank for rank, gram in enumerate(best, 1)}


def brute(rows, length):
    known = collections.defaultdict(collections.Counter)
    for doc, text, lang in rows:
        if text is not None and lang is not None and (doc is None or zlib.crc32(str(doc).encode()) % 4 != 2):
            known[lang].update(brute_grams(text))
    profiles = {lang: ranks(counts, length) for lang, counts in sorted(known.items()) if counts}
    result = []
    for doc, text, _ in rows:
        own = ranks(brute_grams(text), length)
        if not own or not profiles:
            result.append((doc, "und", 0.0))
            continue
        far = {lang: sum(abs(p[g] - r) if g in p else length for g, r in own.items()) for lang, p in profiles.items()}
        least = min(far.values())
        result.append((doc, min(k for k, v in far.items() if v == least), round(1 - least / (len(own) * length), 9)))
    return sorted(result, key=str)


@pytest.mark.parametrize("length", [5, 300])
def test_predictions_follow_the_definition(docs, monkeypatch, length):
    monkeypatch.setattr(langid, "HELD", 50)
    rng = random.Random(length)
    letters = {"aa": "abcdé ", "bb": "cdefß ", "cc": "漢字かな ", "dd": "abcdé "}  # two languages that are alike tie
    rows = []
    for doc in range(60):
        lang = rng.choice(list(letters))
        text = "".join(rng.choice(letters[lang]) for _ in range(rng.randint(0, 80)))
        rows.append((doc, text, rng.choice([lang, lang, None])))
    rows += [(None, "abc é", "aa"), (3, None, "aa"), (4, "", None), (5, "123 !", "bb"), (6, "İß Σς", None), (6, "İß Σς", None)]
    profiles = langid.learn(docs(rows).where(~langid.held_out()), length=length)
    found = langid.predict(docs(rows), profiles, length)
    assert sorted(((r[0], r[1], round(r[2], 9)) for r in found.collect()), key=str) == brute(rows, length)
