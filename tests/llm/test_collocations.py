"""Phrases of a de Bruijn graph against brute force, and its compacted paths."""

import collections
import random
import re

import pytest

from tallyloom.llm import collocations
from tallyloom.llm import words as W
from tests.llm.test_search import FOLD


def counted(rows):
    grams = collections.defaultdict(collections.Counter)
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            for k in (1, 2, 3):
                grams["und" if lang is None else lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return grams


def brute(rows, least, top):
    result = []
    for lang, f in counted(rows).items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        phrases = [p for p in f if len(p) > 1 and f[p] >= least]
        longer = [p for p in phrases if len(p) == 3]
        inside = {part for p in longer for part in (p[:2], p[1:]) if 100 * f[p] >= 50 * f[part]}
        scored = []
        for p in phrases:
            if p not in inside:
                score, k = min((1000000 * f[p] ** 2 // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            result.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(result)


def texts(rng, n):
    words = ["a", "b", "The", "the", "É", "é", "x#", "z"]
    fixed = ["new york city", "New York", "to be or not to be", "a a a a", "b\tb", "one two three four five six seven"]
    rows = [(1, None, "en"), (2, "", "en"), (3, " . , ", None), (4, "alone", "xx"), (5, "Ünd", "und")]
    for k in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.randint(0, 30))]
        text = "".join(p + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "? "]) for p in parts)
        rows.append((k % 50, text, rng.choice(["en", "de", None, "und"])))
    return rows


@pytest.mark.parametrize("size,buffer,top", [(1 << 20, 2_000_000, 2000), (64, 50, 7)])
def test_phrases(docs, monkeypatch, size, buffer, top):
    monkeypatch.setattr(W, "SLICE", size)
    monkeypatch.setattr(collocations, "BUFFER", buffer)
    rows = texts(random.Random(top), 200)
    rows.append((9, "long text without an end " * 40 + "\n" + "short one. " * 60, "en"))
    found = collocations.mine(docs(rows), least=3, top=top)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == brute(rows, 3, top)


def test_no_documents(docs):
    assert collocations.mine(docs([(1, "a")]).limit(0)).collect() == []
    assert collocations.mine(docs([(1, None), (2, "a b c")])).collect() == []


def test_compacted_paths(docs):
    rows = [(k, "p q r s t u", "en") for k in range(4)] + [(9, "x q r y", "en")] * 3
    found = collocations.graph(docs(rows), least=2)
    nodes = collocations.compacted(found)
    assert sorted((r["n"], r["unary"]) for r in nodes.collect()) == [(3, False), (3, False), (4, False), (4, False), (4, True), (4, True), (7, False)]
    ahead = sorted((r["n"], r["ahead"]) for r in collocations.paths(found, nodes).collect())
    assert ahead == [(3, 0), (3, 0), (4, 0), (4, 0), (4, 1), (4, 2)]
