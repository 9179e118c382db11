"""Licence statements wrapped over lines and in long lines, against every run of words of the text."""

import random
import re
import textwrap

import pytest

from tallyloom.llm import licenses
from tests.llm.conftest import prose


def brute_joined(text, templates):
    """Labels and best share over all runs of words; line ends are blanks."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    labels, best = set(), 0.0
    for label, wording in templates:
        tokens, size = set(wording.split()), max(licenses.BLOCK, 2 * len(wording.split()))
        for low in range(max(1, len(words) - size + 1)):
            share = len(tokens & set(words[low : low + size])) / len(tokens)
            if share >= licenses.THRESHOLD - 1e-12:
                labels.add(label)
                best = max(best, share)
    return labels, best


@pytest.mark.parametrize("mark", ["", "# ", " * "])
def test_wrapped_statements(docs, mark):
    rng = random.Random(5)
    rows, expected = [], {}
    for n, (label, wording) in enumerate(licenses.TEMPLATES):
        for k, width in enumerate((30, 50, 78)):
            lines = textwrap.wrap(f"{prose(rng, rng.randint(0, 9))} {wording}", width)
            text = prose(rng, 40) + "\n" + "".join(f"{mark}{x}\n" for x in lines) + prose(rng, 40)
            rows.append((10 * n + k, text))
            expected[10 * n + k] = brute_joined(text, licenses.TEMPLATES)
            assert label in expected[10 * n + k][0]
    for r in licenses.scan(docs(rows), phrases={}).collect():
        assert (set(r["labels"].split(",")), r["score"]) == expected[r["doc_id"]] and r["n_blocks"] == 1


def test_long_templates_in_long_lines(docs):
    rng = random.Random(6)
    templates = [("long", prose(rng, 40)), ("longer", prose(rng, 90))]
    rows, expected = [], {}
    for n in range(120):
        wording = templates[n % 2][1].split()
        for _ in range(rng.choice([0, 2, 4, 12])):
            wording.pop(rng.randrange(len(wording)))
        rows.append((n, f"{prose(rng, n)} {' '.join(wording)} {prose(rng, 60)}"))
        expected[n] = brute_joined(rows[-1][1], templates)
    found = licenses.scan(docs(rows), templates, {}).collect()
    assert {r["doc_id"]: (set(filter(None, r["labels"].split(","))), r["score"]) for r in found} == expected


def test_places_apart_are_counted(docs):
    statement = "Licensed under the\nGNU General Public License\nversion 3"
    rows = [(1, statement), (2, f"{statement}\n{'x ' * 200}\n{statement}"), (3, "licensed " * 5 + "x " * 80 + "under the gnu general public license version 3"), (4, None)]
    found = {r["doc_id"]: (r["labels"], r["n_blocks"]) for r in licenses.scan(docs(rows)).collect()}
    assert found == {1: ("gpl-3", 1), 2: ("gpl-3", 2), 3: ("", 0), 4: ("", 0)}
