"""What a worker holds at once while it hashes texts."""

import random
import tracemalloc

import pyarrow as pa

from tallyloom.llm import repeats
from tallyloom.llm import words as W
from tests.llm.conftest import prose


def test_hashing_holds_few_bytes_of_many_texts():
    rng = random.Random(31)
    texts = pa.array([prose(rng, 400) for _ in range(1_500)], pa.string())
    assert texts.nbytes > 2_500_000
    batch = pa.record_batch([texts], names=["text"])
    for work in (lambda: sum(len(W.shingle_hashes(w)) for _, w in W.words_of(texts)), lambda: sum(b.num_rows for b in repeats._names([batch]))):
        tracemalloc.start()
        try:
            assert work() > 1_000
            assert tracemalloc.get_traced_memory()[1] < 50_000_000
        finally:
            tracemalloc.stop()
