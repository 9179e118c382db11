"""Splicing of overlapping chunks: where it may happen, where it fails, and tokenizers it must not be used for."""

import json
import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tallyloom.llm import token_counts
from tallyloom.llm.token_counts import Counter, splits_at_white_space
from tests.llm.conftest import prose

with open(P.path("word_bpe_49k.json"), encoding="utf-8") as file:
    DEFINITION = file.read()
LIBRARY = Tokenizer.from_str(DEFINITION)


def changed(**parts):
    return json.dumps({**json.loads(DEFINITION), **parts})


HOLDING = changed(pre_tokenizer={"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": True})


def expected(text, library=LIBRARY):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_which_tokenizers_split_at_white_space():
    assert splits_at_white_space(DEFINITION)
    assert not splits_at_white_space(HOLDING) and not splits_at_white_space(changed(pre_tokenizer=None))
    assert splits_at_white_space(changed(pre_tokenizer={"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}]}))
    spaced = [{**json.loads(DEFINITION)["added_tokens"][0], "content": "two words"}]
    assert not splits_at_white_space(changed(added_tokens=spaced))


@pytest.mark.parametrize("chunk,overlap", [(40, 4), (64, 16), (300, 40)])
def test_chunks_of_prose(chunk, overlap):
    rng = random.Random(chunk)
    counter = Counter(DEFINITION, chunk, overlap)
    for _ in range(30):
        text = prose(rng, rng.randint(20, 200)).replace(" ", rng.choice([" ", "\n", " \t ", "　"])) + rng.choice(["", "é!", " <|endoftext|> it's"])
        assert counter.count(text) == expected(text)


def test_alignment_fails_and_overlaps_widen(monkeypatch):
    counter, seen = Counter(DEFINITION, 50, 4), []
    tokens = Counter._tokens
    monkeypatch.setattr(Counter, "_tokens", lambda self, text, a, b: seen.append((a, b)) or tokens(self, text, a, b))
    text = "short words " * 6 + "x" * 400 + " and more short words to end with " * 4
    assert counter.count(text) == expected(text)
    lengths = [b - a for a, b in seen]
    assert max(lengths) > 400 and min(lengths) <= 50  # the chunk grew over the long word, and only there
    starts = [a for a, _ in seen]
    assert any(0 < a - b for a, b in zip(starts, starts[1:]))  # the overlap was widened to the left


def test_tokens_with_blanks_are_counted_whole():
    library, counter = Tokenizer.from_str(HOLDING), Counter(HOLDING, 50, 4)
    text = prose(random.Random(1), 200)
    assert counter.count(text) == expected(text, library)


def test_words_of_two_generations(monkeypatch):
    monkeypatch.setattr(token_counts, "STORED_WORDS", 30)
    counter, rng = Counter(DEFINITION), random.Random(2)
    texts = [prose(rng, 25) for _ in range(40)] + ["y" * 200, ""]
    assert counter.counts(texts) == [expected(text) for text in texts]
    assert [counter.count(text) for text in texts] == [expected(text) for text in texts]
    assert len(counter._kept) <= 60
