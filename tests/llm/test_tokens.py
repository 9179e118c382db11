"""BPE tree reduction and spliced token counts against the libraries themselves."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyloom.llm import bpe, token_counts

RANKS = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()
CODEC = bpe.Codec(RANKS, P.PATTERN)
SMALL = bpe.Codec(RANKS, P.PATTERN, leaf=7, window=2)
DEFINITION = open(P.path("word_bpe_49k.json"), encoding="utf-8").read()
COUNTER, CHUNKED = token_counts.Counter(DEFINITION), token_counts.Counter(DEFINITION, chunk=20, overlap=4)
LIBRARY = Tokenizer.from_str(DEFINITION)
PIECES = [*"ab's'tre l\n\t\r\x1c\x85é漢12٣!?-’😀́Σİſ", " ", "   ", " the", "'re", "'ll", " \n\n", "<|endoftext|>", "<|startoftext|>", " "]
ODD = st.lists(st.sampled_from(PIECES), max_size=90).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.one_of(ODD, st.text(st.characters(exclude_categories=["Cs"]), max_size=200)))
def test_tree_equals_library(text):
    expected = CODEC._library.encode_ordinary(text)
    ids = SMALL.encode(text)
    assert ids.tolist() == expected
    assert SMALL.decode(ids) == text.encode()


def test_texts_without_cuts():
    for text in ("a" * 20_000, " " * 20_000, "漢字" * 9_000, "'" * 9_000, "ab1" * 5_000):
        assert CODEC.encode(text).tolist() == CODEC._library.encode_ordinary(text)


def test_round_trip_query_columns(docs):
    rows = [(1, "Hello world, it's 2024!" * 900), (2, None), (3, ""), (None, "x y"), (4, "same"), (4, "same")]
    path = P.path("byte_bpe_50k.tiktoken")
    found = bpe.round_trip(docs(rows), path, P.PATTERN).collect()
    encoder = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=CODEC._library._mergeable_ranks, special_tokens={})

    def expected(doc, text):
        ids = np.array(encoder.encode_ordinary(text or ""), "<u4")
        return doc, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    assert sorted(map(tuple, found), key=str) == sorted((expected(*r) for r in rows), key=str)
    encoded = bpe.encode(docs(rows), path, P.PATTERN)
    decoded = {r["doc_id"]: bytes(r["bytes"]).decode() for r in bpe.decode(encoded, path, P.PATTERN).collect()}
    assert decoded == {doc: text or "" for doc, text in rows}
    assert bpe.round_trip(docs(rows).limit(0), path, P.PATTERN).collect() == []


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_counts_equal_library(text):
    expected = len(LIBRARY.encode(text, add_special_tokens=False).ids)
    assert COUNTER.count(text) == CHUNKED.count(text) == expected


def test_long_texts_are_spliced():
    rng = random.Random(5)
    text = "".join(rng.choice([*PIECES, "word ", "longer words "]) for _ in range(90_000))
    assert len(text) > 2 * token_counts.CHUNK
    assert COUNTER.count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)
    assert COUNTER.count("x" * 150_000 + " y") == len(LIBRARY.encode("x" * 150_000 + " y", add_special_tokens=False).ids)


def test_count_table(docs):
    rows = [(1, "one two three"), (2, None), (3, ""), (None, "é"), (1, "one two three"), (5, "a " * 3000)]
    path = P.path("word_bpe_49k.json")
    found = token_counts.count_tokens(docs(rows), path).collect()
    expected = []
    for doc, text in rows:
        n = len(LIBRARY.encode(text or "", add_special_tokens=False).ids)
        expected.append((doc, len((text or "").encode()), n, n > 2048))
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    assert token_counts.count_tokens(docs(rows).limit(0), path).collect() == []
