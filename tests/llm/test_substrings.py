"""Removal of repeated runs of words against brute force."""

import collections
import hashlib
import random
import re

import pytest

from tallyloom.llm import substrings
from tallyloom.llm import words as W
from tests.llm.conftest import prose


def kept_words(rows, width=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", text or "") for _, text in rows]
    starts = collections.Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    for own in words:
        gone = set()
        for i in range(len(own) - width + 1):
            if starts[tuple(own[i : i + width])] > 1:
                gone.update(range(i, i + width))
        yield len(own), [w for k, w in enumerate(own) if k not in gone]


def brute(rows):
    result = [(doc, n, n - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()) for (doc, _), (n, kept) in zip(rows, kept_words(rows))]
    return sorted(result, key=str)


def found(docs, rows):
    out = substrings.remove(docs(rows), digest=True)
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return sorted(map(tuple, out.collect()), key=str)


def texts(rng):
    passages = [prose(rng, n) for n in (34, 35, 36, 50, 90, 300)]
    made = []
    for _ in range(60):
        parts = [prose(rng, rng.randint(0, 50))]
        for _ in range(rng.randint(0, 3)):
            words = rng.choice(passages).split()
            if rng.random() < 0.5:
                low = rng.randrange(len(words))
                words = words[low : low + rng.randint(20, 80)]
            if rng.random() < 0.4:
                words[rng.randrange(len(words))] = "edited"
            parts += [" ".join(words), prose(rng, rng.randint(0, 20))]
        made.append(rng.choice([" ", "\n", " \t "]).join(parts))
    base = prose(rng, 120).split()
    for k in range(40):  # copies that differ in a word each
        made.append(" ".join([*base[:k], f"w{k}", *base[k + 1 :]]))
    made += [made[0], made[0], made[1].upper(), None, "", " \n", "x " * 34, "y " * 35, "z " * 36, "a b " * 60, "É " * 40 + "é"]
    return made


@pytest.mark.parametrize("seed,size,piece,chunk,limit", [(1, 1 << 20, 1 << 20, 4096, 64_000_000), (2, 300, 100, 20, 0)])
def test_words_left(docs, monkeypatch, seed, size, piece, chunk, limit):
    for module, name, value in ((W, "SLICE", size), (substrings, "PIECE", piece), (substrings, "CHUNK", chunk), (substrings, "BROADCAST_BYTES", limit)):
        monkeypatch.setattr(module, name, value)
    rng = random.Random(seed)
    made = texts(rng)
    rng.shuffle(made)
    assert found(docs, list(enumerate(made))) == brute(list(enumerate(made)))


def test_rows_without_their_own_id(docs):
    passage = prose(random.Random(3), 60)
    rows = [(1, passage), (1, "before " + passage), (None, passage + " after"), (None, None), (2, "alone")]
    assert found(docs, rows) == brute(rows)
    kept = substrings.remove(docs(rows)).collect()
    assert sorted((r["kept"] for r in kept)) == ["", "", "after", "alone", "before"]


def test_one_long_text_and_none(docs):
    rng = random.Random(5)
    long = prose(rng, 3_000)
    rows = [(1, f"{long} middle {long}"), (2, prose(rng, 30))]
    assert found(docs, rows) == brute(rows)
    assert substrings.remove(docs(rows).limit(0), digest=True).collect() == []
