"""Similarity join, repeats, decontamination, licenses and languages against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from tallyloom.llm import bm25, jaccard, langid, licenses, repeats
from tallyloom.llm import words as W
from tests.llm.conftest import prose

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_components(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[find(i)].append(doc)
    known = {k: min((d for d in v if d is not None), default=None) for k, v in least.items()}
    return sorted(((d, len(sets[i]), known[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def near_copies(rng, n_bases, n_copies, most):
    rows = []
    for base in range(n_bases):
        words = prose(rng, rng.choice([3, 6, 40, 90, 160])).split()
        for _ in range(n_copies):
            own = list(words)
            for _ in range(rng.randint(0, most)):
                own[rng.randrange(len(own))] = rng.choice(["to", "of", f"w{rng.randrange(9)}"])
            rows.append(" ".join(own))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components(docs, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "CHUNK", 4)
    rng = random.Random(seed)
    passage = prose(rng, 30)
    texts = near_copies(rng, 6, 22, 6) + [f"{prose(rng, 30)} {passage}" for _ in range(25)]
    texts += [None, "", " \n ", "one", "One", "a b c", "x " * 400, "x " * 400, "É é"]
    rng.shuffle(texts)
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[5]), (None, "alone here for once and all")]
    near = prose(rng, 60)
    rows += [(None, near), (None, near + " more"), (900, near + " else"), (7, near + " other")]  # ids that are null or repeated
    found = jaccard.join(docs(rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found), key=str) == brute_components(rows)


def test_components_of_nothing(docs):
    assert jaccard.join(docs([(1, "a")]).limit(0)).collect() == []
    kept = jaccard.one_per_group(docs([(1, "a b c"), (2, "A b c"), (2, "A b c"), (None, "a b c"), (5, None), (6, "")]))
    assert sorted(r["text"] or "" for r in kept.collect())[:2] == ["", ""] and kept.count() == 3
    assert kept.columns == docs([(1, "a")]).columns


def test_small_levels_are_raised(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "LEVELS", [(2**62, 0.12)])
    rng = random.Random(9)
    rows = list(enumerate(near_copies(rng, 5, 6, 3)))
    found = jaccard.join(docs(rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found), key=str) == brute_components(rows)


def test_word_hashes_follow_words():
    texts = ["A b  c\n", None, "", "É x\x0b y", "b a", "w" * 3000, "A b c"]
    seen, back = {}, {}
    import pyarrow as pa

    for row, hashes in W.words_of(pa.array(texts, pa.string())):
        words = re.findall(r"[^\x20\x09-\x0D]+", (texts[row] or "").translate(FOLD))
        assert len(words) == len(hashes)
        for word, value in zip(words, hashes.tolist()):
            assert seen.setdefault(word, value) == value and back.setdefault(value, word) == word
    long = " ".join(f"w{i}" for i in range(400_000)).encode()
    assert len(long) > 2 * W.SLICE and len(W.word_hashes(np.frombuffer(long, np.uint8))[0]) == 400_000


def brute_repeats(rows):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1] or ""))
    seen, result = set(), []
    for i in order:
        data = (rows[i][1] or "").encode()
        covered = bytearray(len(data))
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                covered[s : s + 100] = b"\1" * 100
            seen.add(data[s : s + 100])
        spans = sum(1 for k in range(len(data)) if covered[k] and (k == 0 or not covered[k - 1]))
        kept = bytes(b for b, c in zip(data, covered) if not c)
        result.append((rows[i][0], len(data), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(result, key=str)


def test_repeats(docs):
    rng = random.Random(4)
    passages = [prose(rng, n) for n in (12, 16, 30, 60)]
    texts = []
    for n in range(40):
        parts = [prose(rng, rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            passage = rng.choice(passages)
            cut = rng.randrange(len(passage) // 2)
            parts += [passage[cut : cut + rng.choice([60, 99, 100, 101, 160, 400])], prose(rng, rng.randint(0, 5))]
        texts.append(rng.choice(["", " ", "\n"]).join(parts))
    texts += [texts[0], texts[3] + "é" * 70, "é" * 120, "ab" * 200, "a" * 250, None, "", "x" * 99, texts[7][:120] + texts[8]]
    rows = [*enumerate(texts), (2, texts[2]), (None, texts[9]), (None, "a" * 120)]
    found = repeats.remove(docs(rows), digest=True).collect()
    assert sorted(map(tuple, found), key=str) == brute_repeats(rows)
    kept = {r["doc_id"]: hashlib.sha256(bytes(r["kept"])).hexdigest() for r in repeats.remove(docs(rows[:20])).collect()}
    assert kept == {r[0]: r[4] for r in brute_repeats(rows[:20])}


def test_repeats_of_long_texts(docs, monkeypatch):
    rng = random.Random(6)
    for module in (repeats.A, W):
        monkeypatch.setattr(module, "SLICE", 4096)  # on the driver; workers keep theirs
    long = prose(rng, 6000)
    data = np.frombuffer(long.encode(), np.uint8)
    covered = np.zeros(len(data), bool)
    for offset, _, found in repeats.A.find(data, np.array([0, len(data)])):
        for low, high in zip(found.low + offset, found.high + offset):
            assert not covered[low : high + 1].any()
            covered[low : high + 1] = True
    assert covered[: len(data) - 99].all() and not covered[len(data) - 99 :].any()
    starts = np.arange(0, len(data) - 100, 37)
    assert (repeats._hashed(data, starts, starts + 100) == repeats.A.Rolling(data).hashes(starts, starts + 100)).all()


def test_cleaned_keeps_rows_and_columns(docs):
    rows = [(1, "x" * 150), (2, "x" * 150 + "é tail"), (3, None), (4, "short")]
    made = repeats.cleaned(docs(rows))
    assert made.columns == docs(rows).columns
    found = {r["doc_id"]: (r["text"], r["n_chars"]) for r in made.collect()}
    assert found == {1: ("x", 1), 2: ("é tail", 6), 3: (None, None), 4: ("short", 5)}
    assert repeats.cleaned(docs(rows).limit(0)).collect() == []


def test_wand_equals_exhaustive_search(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, rng.randint(2, 40))) for i in range(300)]
    index = bm25.Index(*next(bm25._pieces(spark.createDataFrame(items, "item_id long, text string"))))
    for _ in range(200):
        terms = sorted(rng.sample(range(len(index.terms)), 400))
        threshold = rng.choice([0.02, 0.05, 0.1, 0.3])
        scores = collections.defaultdict(float)
        for term in terms:
            for place, weight in index.lists[term]:
                scores[place] += weight
        expected = sorted((p, round(s, 6)) for p, s in scores.items() if s >= threshold - 1e-9)
        assert [(p, round(s, 6)) for p, s in index.retrieve(terms, threshold)] == expected


def test_leaks(spark, docs, monkeypatch):
    rng = random.Random(2)
    items = [(i, prose(rng, rng.randint(8, 50))) for i in range(30)]
    items += [(30, "What is the capital of the old kingdom by the sea? It is the small town of Brindle"), (31, None), (32, ""), (33, "one"), (None, "four words stand here")]
    asked = "What is the capital of the old kingdom by the sea?"
    rows = [(i, prose(rng, 300)) for i in range(20)]
    rows += [(100 + i, f"{prose(rng, rng.randint(0, 400))} {items[i][1].upper()} {prose(rng, 50)}") for i in range(10)]
    rows += [(200, asked), (201, f"{asked} It is the small town of Brindle"), (202, None), (203, ""), (204, "x four words stand here y"), (None, items[3][1])]
    table = spark.createDataFrame(items, "item_id long, text string")
    expected = sorted([(100 + i, i) for i in range(10)] + [(201, 30), (204, None), (None, 3)], key=str)
    for part in (20_000, 7):
        monkeypatch.setattr(bm25, "PART_ITEMS", part)
        found = bm25.find(docs(rows), table).select("doc_id", "item_id").collect()
        assert sorted(map(tuple, found), key=str) == expected
    clean = bm25.without_leaks(docs(rows), table)
    assert clean.count() == len(rows) - len(expected) and clean.columns == docs(rows).columns
    assert bm25.find(docs(rows), table.limit(0)).collect() == [] and bm25.find(docs(rows).limit(0), table).collect() == []


def brute_license(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    starts, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        own = phrase.split()
        for i in range(len(words) - len(own) + 1):
            if words[i : i + len(own)] == own:
                starts.append(i)
                labels.add(label)
    found = {}
    for block in licenses.blocks((text or "").translate(FOLD).encode().translate(licenses._FOLD)):
        for label, wording in licenses.TEMPLATES:
            tokens = set(licenses.folded(wording).split())
            share = len(tokens & set(block)) / len(tokens)
            if share >= licenses.THRESHOLD - 1e-12:
                found[label] = max(share, found.get(label, 0))
    score = 1.0 if starts else max(found.values(), default=0.0)
    return (
        len(words), len(starts), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(labels)), ",".join(sorted(labels | set(found))), score,
    )


def test_licenses(docs):
    rng = random.Random(3)
    texts = [None, "", "CC BY-NC cc by nc cc-by-nc", "Released under the MIT License.", "é under the mit licensé", "Under The MIT: License!"]
    texts += ["Licensed under the Apache License, Version 2.0", "apache license version 20"]
    for _, wording in licenses.TEMPLATES:
        words = wording.split()
        for drop in (0, 1, 2, 3):
            own = list(words)
            for _ in range(drop):
                own.pop(rng.randrange(len(own)))
            rng.shuffle(own) if drop == 1 else None
            texts.append(prose(rng, rng.randint(0, 90)) + rng.choice(["\n", " "]) + " ".join(own) + "\n" + prose(rng, 5))
    rows = [*enumerate(texts), (None, texts[3]), (2, texts[2])]
    found = licenses.scan(docs(rows)).drop("n_blocks").collect()
    assert sorted(map(tuple, found), key=str) == sorted(((d, *brute_license(t)) for d, t in rows), key=str)
    assert licenses.scan(docs(rows).limit(0)).collect() == []


def brute_grams(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    counts = collections.Counter()
    for word in words:
        padded = f"\0{word}\0"
        counts.update(word)
        counts.update((padded[i], padded[i + 1]) for i in range(len(padded) - 1))
        counts.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return counts


def test_grams():
    for text in ("", "a", "Ab a, b1c É", "straße ẞ", "x" * 50, "漢字 かな", "a  b"):
        codes, counts = langid.grams(text)
        assert sorted(counts.tolist()) == sorted(brute_grams(text).values())
        assert len(codes) == len(set(codes.tolist()))


def test_languages(docs, monkeypatch):
    lines = {"en": "the cat and the dog were in the house with", "de": "der hund und die katze sind nicht in dem haus", "fr": "le chat et les chiens sont dans la maison avec"}
    rng = random.Random(1)
    rows = [(n, " ".join(rng.choices(lines[lang].split(), k=rng.randint(6, 30))), lang) for n, lang in enumerate(list(lines) * 40)]
    rows += [(500, None, "en"), (501, "12 !?", "de"), (502, "the dog and the cat", None), (None, "und die katze nicht", "de"), (502, "the dog and the cat", None)]
    found = langid.predictions(docs(rows)).collect()
    assert len(found) == len(rows)
    got = collections.defaultdict(list)
    for r in found:
        got[r["doc_id"]].append((r["held_out"], r["lang_pred"], r["score"]))
    right = [got[doc][0][1] == lang for doc, text, lang in rows[:120]]
    assert sum(right) >= 118 and got[500][0][1:] == got[501][0][1:] == ("und", 0.0)
    assert got[502][0][1] == got[502][1][1] == "en" and got[None][0][:2] == (False, "de")
    import zlib

    assert all(got[d][0][0] == (zlib.crc32(str(d).encode()) % 4 == 2) for d in range(120))
    nothing = langid.predictions(docs([(1, "abc", None)])).collect()
    assert [tuple(r) for r in nothing] == [(1, False, "und", 0.0)]
    assert langid.predictions(docs(rows).limit(0)).collect() == []
    profiles = langid.learn(docs(rows))
    kept = langid.recognised(docs(rows), profiles, 0.25)
    assert kept.columns == docs(rows).columns and kept.count() == len(rows) - 2
