"""WARC archives, main text, quality rules and the registered queries."""

import base64
import collections
import hashlib
import importlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
import corpus_pipeline
from checks.compare import connect, difference
from tallyloom.llm import blocks, divergence, queries, warc
from tallyloom.sources.workspace import new_path

FOLDER = "/root/testdata/sf0.001"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_archives(spark, pages):
    tricky = "a\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nb\r\n\r\nWARC/1.1\r\n"
    rows = [(n, f"http://x/{n}", html) for n, html in enumerate(["one", "two", "one", None, "", tricky, "é\n\n", "one", "x" * 300_000])]
    rows += [(None, None, "one"), (5, "http://x/5", tricky), (20, None, tricky)]
    found = warc.round_trip(pages(rows)).collect()
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    expected = []
    for page, _, html in rows:
        original = first[html or ""]
        again = page is not None and page != original
        expected.append((page, len((html or "").encode()), digest(html), "revisit" if again else "response", original if again else None))
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    assert warc.round_trip(pages(rows).limit(0)).collect() == []


def test_captures_are_nested(spark, pages):
    path = new_path(spark, "warc")
    warc.write(pages([(1, "http://a", "p"), (2, "http://b\r\nX: y", "p")]), path)
    records = warc.read(spark, path)
    assert collections.Counter(r["type"] for r in records.collect()) == {"request": 2, "metadata": 2, "response": 1, "revisit": 1}
    captures = {r["metadata"]["page_id"]: r for r in warc.assemble(records).collect()}
    assert captures[1]["response"]["block"].endswith(b"\r\n\r\np") and captures[1]["response"]["payload_sha1"] == digest("p")
    assert captures[2]["response"]["type"] == "revisit" and captures[2]["response"]["refers_to_page"] == 1
    assert captures[2]["request"]["uri"] == "http://b X: y" and b"GET http://b X: y" in captures[2]["request"]["block"]


def test_payloads_without_their_digest_are_an_error(spark, pages):
    path = new_path(spark, "warc")
    warc.write(pages([(1, "http://a", "p")]), path)
    records = warc.read(spark, path).withColumn("digest", F.when(F.col("type") == "response", F.lit("sha1:AAAA")))
    with pytest.raises(Exception, match="does not have its digest"):
        warc.page_table(warc.assemble(records)).collect()


def test_block_reader():
    page = '<html><head><title>t</title><style>p{}</style></head><body><nav><a href="x">Menu</a></nav><p>A &amp; b<br>c<p><b>d</b>e <script>var t="</p>";</script>f&nbsp;g</p><!-- <p>no</p> --><ul><li>x<li>y</ul>1 &lt; 2<p title="a>b">q'
    assert [text for _, text, _ in blocks.blocks_of(page)] == ["Menu", "A & b", "c", "de", "f g", "x", "y", "1 < 2", "q"]
    paths = {text: path for path, text, _ in blocks.blocks_of(page)}
    assert paths["Menu"][-1] == "nav" and paths["y"] == ("html", "body", "ul", "li")
    assert blocks.blocks_of("") == [] and blocks.blocks_of("<p") == [] and blocks.blocks_of("<div class='") == []
    assert blocks.blocks_of("<p class='x' id=\"y z\">t")[0][0] == ("p.x.y.z",)


def test_gradients_of_the_labeller():
    draw = np.random.default_rng(1)
    model = blocks.Labeller(seed=3)
    x, mask = blocks.padded([draw.random((4, blocks.WIDTH)).astype(np.float32), draw.random((2, blocks.WIDTH)).astype(np.float32)])
    labels = (draw.random(mask.shape) < 0.5).astype(np.float32)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}

    def loss():
        score = model.scores(x, mask)
        return -np.where(mask, labels * np.log(score) + (1 - labels) * np.log(1 - score), 0).sum() / mask.sum()

    for name, gradient in model.gradients(x, mask, labels).items():
        place = np.unravel_index(np.abs(gradient).argmax(), gradient.shape)
        kept, step = model.weights[name][place], 1e-3
        model.weights[name][place] = kept + step
        up = loss()
        model.weights[name][place] = kept - step
        down = loss()
        model.weights[name][place] = kept
        assert abs((up - down) / (2 * step) - gradient[place]) < 2e-4, name


def test_labels_of_unseen_pages():
    model, generator = blocks.Labeller(blocks.trained()), blocks.Generator(4242)
    made = [generator.page() for _ in range(200)]
    read = [blocks.blocks_of(page) for page, _ in made]
    found = blocks.label(model, read)
    wrong = sum(int(a) != b for kept, (_, labels) in zip(found, made) for a, b in zip(kept, labels))
    assert wrong <= 0.02 * sum(map(len, read))
    assert blocks.label(model, [read[0]]) == found[:1]  # neighbours in a batch change nothing


def test_extracted_text(pages):
    body = "<article><h1>Head &amp; line</h1><p>First  part of the\n story that goes on.</p><p>Second part, with <b>bold</b> words.</p></article>"
    page = f'<html><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy now</div>{body}<footer>(c) us</footer></body></html>'
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", page), (1, "u", page)]
    found = blocks.extract(pages(rows)).collect()
    text = "Head & line First part of the story that goes on. Second part, with bold words."
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in found) == sorted(
        [("1", text, len(text)), ("1", text, len(text)), ("2", "", 0), ("3", "", 0), ("None", text, len(text))]
    )
    assert blocks.extract(pages(rows).limit(0)).collect() == []


def test_quality_cases(docs):
    sentence = "The house of the man and the dog is in the old town with it to be for that. "
    clean = sentence + " ".join(f"word{i}" for i in range(60))
    junk = " ".join(f"w{i}%%% &&&###" for i in range(80))
    rows = [(1, clean), (2, junk), (3, None), (4, ""), (5, "a b c " * 40), (6, "l1 x\nl1 x\n \n\nl1 x"), (None, clean), (7, clean), (7, clean, None)]
    rows += [(n, sentence + " ".join(f"word{n}x{i}" for i in range(60))) for n in range(100, 130)]
    found = {r["doc_id"]: r for r in divergence.judge(docs(rows)).collect()}
    assert found[1]["kept"] and found[None]["kept"] and not found[2]["kept"] and not found[2]["base_failed"]
    assert found[3]["base_failed"] and found[3]["n_words"] == 0 and not found[4]["kept"]
    assert found[5]["n_repeat_words"] == 120 and found[6]["n_dup_lines"] == 2 and found[2]["n_symbols"] == 80 * 9
    assert divergence.judge(docs(rows).limit(0)).collect() == []


def test_distance_is_jensen_shannon(spark):
    df = spark.createDataFrame([([1, 3, 0],), ([0, 0, 5],), ([0, 0, 0],)], "c array<bigint>")
    got = [r[0] for r in df.select(divergence.distance("c", [2, 2, 0])).collect()]
    p, q = np.array([0.25, 0.75, 0]), np.array([0.5, 0.5, 0])
    m = (p + q) / 2
    js = (sum(a * np.log2(a / b) for a, b in zip(p, m) if a) + sum(a * np.log2(a / b) for a, b in zip(q, m) if a)) / 2
    assert abs(got[0] - js**0.5) < 1e-9 and abs(got[1] - 1) < 1e-9


def test_quality_plan_has_no_python(spark):
    df = divergence.judge(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    assert "Python" not in df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", sorted(queries.all_oracles()))
def test_query_equals_sql(spark, name):
    problem, _ = difference(spark, connect(FOLDER), queries.all_queries()[name], queries.all_oracles()[name], FOLDER)
    assert problem is None


def test_all_are_registered():
    own = {name.split("_")[0] for name in queries.all_queries()}
    assert own == {*(f"op{n}" for n in range(1, 14)), "pipeline"}
    assert set(queries.all_queries()) <= set(registered.queries()) and importlib.import_module("corpus_pipeline") is corpus_pipeline


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    kept = {r["doc_id"] for r in docs.collect()}
    leaks = {r["doc_id"] for r in queries.op9_decontamination(spark, FOLDER).collect()}
    copies = {r["doc_id"] for r in queries.op4_jaccard(spark, FOLDER).where("doc_id <> component_id").collect()}
    sizes = {r["doc_id"]: r["n_bytes"] - r["n_removed"] for r in queries.op8_repeats(spark, FOLDER).collect()}
    for name, work in corpus_pipeline.STAGES[:2]:
        docs = corpus_pipeline.stage(work(spark, docs, FOLDER), "test")
        assert docs.columns == columns
    assert {r["doc_id"] for r in docs.collect()} == kept - copies
    final = corpus_pipeline.run(spark, FOLDER)
    got = {r["doc_id"]: r for r in final.collect()}
    assert set(got) <= kept - copies and len(got) == final.count()
    # passages that many texts share go before leaks are looked for, so some leaks are gone by then
    assert kept - copies - leaks <= set(got)
    assert all(r["n_tokens"] == len(r["ids"]) and (r["n_tokens"] > 0) >= (sizes[doc] > 0) for doc, r in got.items())
    assert duckdb.sql("select 1").fetchall() == [(1,)] and corpus_pipeline.ORACLE_SQL is None
