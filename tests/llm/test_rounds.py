"""Large groups of near copies of near copies, and sets that parity bits cannot tell apart."""

import random

import numpy as np
import pyarrow as pa

from tallyloom.llm import jaccard
from tests.llm.conftest import prose
from tests.llm.test_search import brute_components


def copies_of_copies(rng, n, size):
    """A chain with branches: each text is an earlier one with a few words changed."""
    made = [prose(rng, size).split()]
    while len(made) < n:
        words = list(rng.choice(made[-40:]))
        for _ in range(rng.randint(1, 2)):
            words[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
        made.append(words)
    return [" ".join(words) for words in made]


def test_hundreds_of_copies_of_copies(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 50)
    rng = random.Random(21)
    texts = copies_of_copies(rng, 350, 60)
    texts += [t.replace("e1", "f1") for t in texts[::25]] + [prose(rng, 60) for _ in range(20)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    found = jaccard.join(docs(rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found), key=str) == brute_components(rows)


def test_refuted_pairs_lead_to_further_members(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "BITS", 64)  # far too few: most pairs are refuted by their whole sets
    monkeypatch.setattr(jaccard, "MORE", 2)
    rng = random.Random(22)
    shared = prose(rng, 60)
    texts = copies_of_copies(rng, 60, 80) + [f"{shared} {prose(rng, 30)}" for _ in range(25)]
    rows = list(enumerate(texts))
    found = jaccard.join(docs(rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found), key=str) == brute_components(rows)


def test_forests_hold_few_edges_at_once(monkeypatch):
    n, seeds = 60, np.random.default_rng(7)
    marks = [np.packbits((seeds.random(jaccard.BITS) < 0.02).astype(np.uint8)).view(np.int64).tolist() for _ in range(n)]
    role, node = [0] * n + [1] * n, [*range(n)] * 2
    schema = pa.schema([(c, pa.int64()) for c in ("block", "role", "node", "n", "alone", "label")] + [(c, pa.list_(pa.int64())) for c in ("bits", "wrong")])
    columns = [[1] * 2 * n, role, node, [1000] * 2 * n, [0] * 2 * n, node, marks * 2, [[]] * 2 * n]
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
    held, forest = [], jaccard._forest
    monkeypatch.setattr(jaccard, "_forest", lambda low, *rest: held.append(len(low)) or forest(low, *rest))

    def found():
        return sorted((tuple(row.values()) for b in jaccard._nearest(None)([batch]) for row in b.to_pylist()), key=str)

    whole = found()
    assert held == [n * (n - 1)] and len([row for row in whole if row[1] is not None]) == n - 1
    monkeypatch.setattr(jaccard, "HELD_EDGES", 200)
    assert found() == whole and max(held[1:]) < 200 + 2 * n


def test_near_copies_of_one_component_ask_no_more(docs, monkeypatch):
    rng = random.Random(23)
    base = prose(rng, 150).split()
    texts = [" ".join(base)]
    for k in range(100):  # one word of the base differs in each copy, in some two
        words = list(base)
        for _ in range(1 + k % 2):
            words[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    asked, contested = [], jaccard._contested
    monkeypatch.setattr(jaccard, "_contested", lambda members, opened, labels: asked.append(opened.count()) or contested(members, opened, labels))
    found = jaccard.join(docs(rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found), key=str) == brute_components(rows)
    assert asked[0] > 200 and sum(asked[1:]) < asked[0] / 4, asked
