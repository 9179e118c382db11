import pytest
from pyspark.sql import types as T

LOREM = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix bronze potions near dark rivers".split()


@pytest.fixture
def docs(spark):
    """Frames of documents from (id, text[, lang]) rows, with columns that clash with the operators' own names."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, ids string, n_tokens string, row string, tokens string, score string"
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), "x", "x", "x", "x", "x") for r in rows]
        return spark.createDataFrame(full, schema).repartition(3)

    return make


@pytest.fixture
def pages(spark):
    def make(rows):
        schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("digest", T.StringType())])
        return spark.createDataFrame([(*r, "clash") for r in rows], schema).repartition(3)

    return make


def prose(rng, n):
    return " ".join(f"{rng.choice(LOREM)}{rng.randrange(300)}" for _ in range(n))
