"""Collocations of two and three words by a weighted de Bruijn graph.

Nodes are pairs of words, an edge of weight f(abc) runs from ab to bc. A pair that ends its piece has an edge to no node.
All shorter counts come from flows: f(ab) is what flows out of the node ab, f(a) what flows out of all nodes that begin
with a, plus the pieces that end with the word a. Both are linear, so a task derives the words' shares
from its own part of the graph, adds up equal edges, and sends every edge once per million; nodes are complete
after the one shuffle, which is by node. Sorted edges are summed as they stream by, however many there are.

What occurs ``least`` times stays as the frequent graph. Its unary nodes, which all of one edge's weight enters and all of
another's leaves, are compacted: their count is the path's weight, and no phrase of two words inside a path can stay, as
the three words around it are as frequent. The other nodes and all edges are candidates.

A word is known by a 64-bit hash of its bytes and its language; words are read again from the texts at the end.

Cases: null text is empty, a null lang is ``und``; nulls and repeated rows count as often as they occur; equal scores and
counts are ordered by phrase; other columns are left out; an empty table gives an empty result. A text is
read in slices that end with a piece, so memory follows the longest piece, not the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyloom.llm import words as W
from tallyloom.llm.common import batches_of
from tallyloom.sources.workspace import stage

LEAST = 10
SHARE = 50
TOP = 2_000
#: Edges that a task adds up at a time.
BUFFER = 1_000_000
#: Bytes up to which a table of known size is sent to all tasks.
BROADCAST_BYTES = 64_000_000

_KIND = np.zeros(256, np.uint8)  # 1: blank, 2: end of a piece
_KIND[[9, 32]] = 1
_KIND[[10, 11, 12, 13, *b".,;:!?"]] = 2
_MANY = np.uint64(0x9E3779B97F4A7C15)
# what stands in an edge for no word, and marks the rows of words and of whole languages
_NONE, _WORD, _LANGUAGE = 0, 0, 1


class Words(NamedTuple):
    """Words of some whole pieces, in order."""

    hashes: np.ndarray
    piece: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    data: np.ndarray


def _slice(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    kind = _KIND[data]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = kind == 0
    turn = np.diff(inside)
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    power, inverse = W._power(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(W._FOLD[data] * power, out=sums[1:])
    hashes = W.mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.cumsum(kind == 2)[starts] if len(starts) else starts, starts, ends


def _cuts(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Slices of a long text that end with a piece."""
    low = 0
    while low < len(data):
        high, step = min(len(data), low + W.SLICE), W.SLICE
        while high < len(data):
            stops = np.flatnonzero(_KIND[data[high - step : high]] == 2)
            if len(stops):
                high = high - step + int(stops[-1]) + 1
                break
            high, step = min(len(data), high + W.SLICE), W.SLICE
        yield low, high
        low = high


def words_of(texts: pa.Array, seeds: np.ndarray) -> Iterator[Words]:
    """Words of a string column; ``seeds`` holds a 64-bit number per row that its words' hashes depend on."""
    for low, high, offsets, data in W.texts_of(texts):
        if high - low == 1:
            rows = [(data[a:b], np.zeros(0, np.int64)) for a, b in _cuts(data)]
        else:
            spread = np.full(len(data) + high - low, 10, np.uint8)
            shift = np.repeat(np.arange(high - low), np.diff(offsets))
            spread[np.arange(len(data)) + shift] = data
            rows = [(spread, offsets[1:-1] + np.arange(1, high - low))]
        for content, bounds in rows:
            hashes, piece, starts, ends = _slice(content)
            row = low + np.searchsorted(bounds, starts, "right")
            hashes = W.mix(hashes ^ W.mix(seeds[row] * _MANY))
            yield Words(np.maximum(hashes, np.uint64(2)), piece, starts, ends, row, content)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array]:
    return batch.column(0).to_numpy().view(np.uint64), batch.column(1)


def _rows(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns], names=list("abcn"))


def _summed(keys: list[np.ndarray], counts: np.ndarray, known: np.ndarray | None = None) -> tuple:
    """Sums of the counts of equal neighbours, and what is ``known`` of the first of them."""
    opens = np.ones(len(counts), bool)
    if len(counts) > 1:
        opens[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(opens)
    sums = np.add.reduceat(counts, at) if len(at) else counts
    return ([k[at] for k in keys], sums) if known is None else ([k[at] for k in keys], sums, known[at])


def _added(words: np.ndarray, counts: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(words)
    (words,), counts, seeds = _summed([words[order]], counts[order], seeds[order])
    return words, counts, seeds


def _local_graph(edges: list, lasts: list, totals: list) -> Iterator[pa.RecordBatch]:
    """Equal edges of a task's buffer added up; its words' counts from its nodes' flows and its pieces' ends."""
    *keys, seeds = (np.concatenate([e[k] for e in edges]) for k in range(4))
    edges.clear()
    order = np.lexsort(keys[::-1])
    for k in range(3):
        keys[k] = keys[k][order]
    seeds = seeds[order]
    del order
    keys, weight, seeds = _summed(keys, np.ones(len(seeds), np.int64), seeds)
    yield _rows(*keys, weight)
    (firsts,), flow, seeds = _summed(keys[:1], weight, seeds)
    last, of = (np.concatenate([x[k] for x in lasts]) for k in range(2))
    words, counts, seeds = _added(np.concatenate([firsts, last]), np.concatenate([flow, np.ones(len(last), np.int64)]), np.concatenate([seeds, of]))
    yield _rows(words, np.full(len(words), _WORD), seeds, counts)
    of, counts, _ = _added(*(np.concatenate([t[k] for t in totals]) for k in (0, 1, 0)))
    yield _rows(of, np.full(len(of), _LANGUAGE), np.full(len(of), _NONE), counts)


def _edges(batches):
    edges, lasts, totals, size = [], [], [], 0
    for batch in batches:
        seeds, texts = _columns(batch)
        for found in words_of(texts, seeds):
            h, piece, of = found.hashes, found.piece, seeds[found.row]
            if not len(h):
                continue
            # texts begin new pieces, so a piece has one row
            paired = piece[:-1] == piece[1:]
            three = np.flatnonzero(paired[:-1] & paired[1:])
            edges.append((h[three], h[three + 1], h[three + 2], of[three]))
            two = np.flatnonzero(paired & ~np.append(paired[1:], False))
            edges.append((h[two], h[two + 1], np.full(len(two), _NONE, np.uint64), of[two]))
            last = ~np.append(paired, False)
            lasts.append((h[last], of[last]))
            (languages,), counts = _summed([of], np.ones(len(h), np.int64))
            totals.append((languages, counts))
            size += len(h)
            if size >= BUFFER:
                yield from _local_graph(edges, lasts, totals)
                edges, lasts, totals, size = [], [], [], 0
    if size:
        yield from _local_graph(edges, lasts, totals)


def _frequent(least: int):
    """Sorted edges added up, and what flows out of each node, as they stream by: rows that count ``least`` at least."""

    def run(batches):
        edge, node = [np.zeros(0, np.uint64)] * 3 + [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)]

        def given(columns: list[np.ndarray], kind: int):
            chosen = columns[-1] >= (least if kind else 0)
            if chosen.any():
                a, b, c, n = (x[chosen].astype(np.int64) if x.dtype != np.uint64 else x[chosen].view(np.int64) for x in columns)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(a), kind, np.int64), a, b, c, n)], names=["kind", *"abcn"])

        def told(edges: list[np.ndarray], node: list[np.ndarray], last: bool):
            """Gives all of these edges and their nodes but the last, which is returned."""
            a, b, c, n = edges
            plain = b > np.uint64(_LANGUAGE)
            yield from given([x[b == np.uint64(_LANGUAGE)] for x in edges], 0)
            yield from given([x[b == np.uint64(_WORD)] for x in edges], 1)
            yield from given([x[plain & (c != np.uint64(_NONE))] for x in edges], 3)
            keys, flow = _summed([np.concatenate([k, x[plain]]) for k, x in zip(node[:2], (a, b))], np.concatenate([node[2], n[plain]]))
            end = len(flow) if last else max(0, len(flow) - 1)
            yield from given([*[k[:end] for k in keys], np.zeros(end, np.uint64), flow[:end]], 2)
            node[:] = [*[k[end:] for k in keys], flow[end:]]

        for batch in batches:
            if batch.num_rows == 0:
                continue
            columns = [np.concatenate([held, x.to_numpy().view(held.dtype)]) for held, x in zip(edge, batch.columns)]
            keys, counts = _summed(columns[:3], columns[3])
            edge = [*[k[-1:] for k in keys], counts[-1:]]
            yield from told([*[k[:-1] for k in keys], counts[:-1]], node, False)
        yield from told(edge, node, True)

    return run


def graph(docs: DataFrame, least: int = LEAST, text: str = "text", lang: str = "lang") -> DataFrame:
    """The frequent graph, written: ``kind, a, b, c, n`` with languages (0), words and their languages (1), nodes (2) and edges (3)."""
    texts = docs.select(F.xxhash64(_language(lang)).alias("seed"), F.col(text).cast("string").alias("text"))
    edges = texts.mapInArrow(_edges, "a long, b long, c long, n long")
    laid = edges.repartition("a", "b").sortWithinPartitions("a", "b", "c")
    return stage(laid.mapInArrow(_frequent(least), "kind long, a long, b long, c long, n long"), "graph")


def _language(name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit("und"))


def compacted(found: DataFrame) -> DataFrame:
    """The edges, written, with ``source`` and ``target``: the counts of their two nodes, ``branching`` pairs apart.

    A node with one edge in and one out that both have its own count is inside a path and takes the path's weight.
    """
    nodes, edges = found.where("kind = 2").select("a", "b", "n"), found.where("kind = 3").select("a", "b", "c", "n")
    out = edges.groupBy("a", "b").agg(F.count("*").alias("leaving"), F.max("n").alias("most_out"))
    into = edges.groupBy(F.col("b").alias("a"), F.col("c").alias("b")).agg(F.count("*").alias("entering"), F.max("n").alias("most_in"))
    known = nodes.join(out, ["a", "b"], "left").join(into, ["a", "b"], "left")
    unary = (F.col("leaving") == 1) & (F.col("entering") == 1) & (F.col("most_in") == F.col("n")) & (F.col("most_out") == F.col("n"))
    return stage(known.select("a", "b", "n", "most_in", "most_out", F.coalesce(unary, F.lit(False)).alias("unary")), "nodes")


def paths(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """``a, b, c, n, ahead, x, y``: every edge's distance to the last edge of its compacted path, and that edge's last pair.

    Pointers are doubled, so a path of length d takes about log d rounds.
    """
    inner = nodes.where("unary").select("a", "b")
    edges = found.where("kind = 3").select("a", "b", "c", "n")
    followed = edges.join(inner.select(F.col("a").alias("b"), F.col("b").alias("c"), F.lit(True).alias("inner")), ["b", "c"], "left")
    # the path goes on at the pair x, y
    at = stage(followed.select("a", "b", "c", "n", F.col("b").alias("x"), F.col("c").alias("y"), F.col("inner").isNotNull().alias("open"), F.lit(0).cast("long").alias("ahead")), "paths")
    while not at.where("open").isEmpty():
        by_source = at.join(inner, ["a", "b"], "left_semi").select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("open").alias("open2"), F.col("ahead").alias("more"))
        joined = at.where("open").join(by_source, ["x", "y"]).select("a", "b", "c", "n", F.col("x2").alias("x"), F.col("y2").alias("y"), F.col("open2").alias("open"), (F.col("ahead") + F.col("more") + 1).alias("ahead"))
        at = stage(at.where("NOT open").unionByName(joined), "paths")
    return at.drop("open")


def _spellings(batches):
    """Hash and folded spelling of words, mostly once a task."""
    schema = pa.schema([("h", pa.int64()), ("word", pa.string())])
    given = np.zeros(0, np.uint64)

    def rows():
        nonlocal given
        for batch in batches:
            seeds, texts = _columns(batch)
            for found in words_of(texts, seeds):
                hashes, first = np.unique(found.hashes, return_index=True)
                fresh = ~np.isin(hashes, given, assume_unique=True)
                hashes, first = hashes[fresh], first[fresh]
                given = np.concatenate([given, hashes]) if len(given) < BUFFER // 4 else hashes
                data = found.data.tobytes()
                for h, a, b in zip(hashes.view(np.int64).tolist(), found.starts[first].tolist(), found.ends[first].tolist()):
                    yield h, data[a:b].lower().decode()

    yield from batches_of(rows(), schema, lambda r: len(r[1]))


def _score(a: str, left: str, right: str):
    whole = [f"cast({x} as decimal(38,0))" for x in (a, a, left, right)]
    return F.expr(f"(cast(1000000 as decimal(38,0)) * {whole[0]} * {whole[1]}) div ({whole[2]} * {whole[3]})")


def mine(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's best ``top`` phrases."""
    found = graph(docs, least, text, lang)
    nodes = compacted(found)
    counts = found.where("kind = 1").select(F.col("a").alias("w"), F.col("c").alias("seed"), "n")
    one, other, end = (counts.select(F.col("w").alias(x), F.col("n").alias(f"f{x}"), *(["seed"] if x == "a" else [])) for x in "abc")
    edges = found.where("kind = 3").select("a", "b", "c", "n")
    # nodes inside a path have the weight of their edges
    branching = nodes.where("NOT unary").select("a", "b", F.col("n").alias("flow"))
    three = (
        edges.join(branching.withColumnRenamed("flow", "fab"), ["a", "b"], "left")
        .join(branching.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("flow").alias("fbc")), ["b", "c"], "left")
        .withColumns({"fab": F.coalesce("fab", "n"), "fbc": F.coalesce("fbc", "n")})
        .join(one, "a")
        .join(end, "c")
        .withColumns({"s1": _score("n", "fa", "fbc"), "s2": _score("n", "fab", "fc")})
        .withColumn("cut", F.when(F.col("s2") < F.col("s1"), 2).otherwise(1))
        .select("seed", "a", "b", "c", "n", F.when(F.col("cut") == 1, F.col("fa")).otherwise(F.col("fab")).alias("l"), F.when(F.col("cut") == 1, F.col("fbc")).otherwise(F.col("fc")).alias("r"), F.least("s1", "s2").alias("score"))
    )
    whole = F.greatest(F.coalesce("most_in", F.lit(0)), F.coalesce("most_out", F.lit(0)))
    two = nodes.where(~F.col("unary")).where(~((whole > 0) & (100 * whole >= share * F.col("n")))).select("a", "b", "n").join(one, "a").join(other, "b")
    two = two.select("seed", "a", "b", F.lit(None).cast("long").alias("c"), "n", F.col("fa").alias("l"), F.col("fb").alias("r"), _score("n", "fa", "fb").alias("score"))
    # only what is among the best by score and count, ties included, is spelled out and ordered by phrase
    by_score = Window.partitionBy("seed").orderBy(F.desc("score"), F.desc("n"))
    scored = three.unionByName(two).withColumn("place", F.rank().over(by_score)).where(F.col("place") <= top).drop("place")
    scored = stage(scored, "scored")

    wanted = stage(scored.select(F.explode(F.array("a", "b", "c")).alias("h")).where("h IS NOT NULL").distinct(), "wanted")
    texts = docs.select(F.xxhash64(_language(lang)).alias("seed"), F.col(text).cast("string").alias("text"))
    spelled = texts.mapInArrow(_spellings, "h long, word string")
    known = F.broadcast(wanted) if 16 * wanted.count() <= BROADCAST_BYTES else wanted
    spelled = stage(spelled.join(known, "h").groupBy("h").agg(F.first("word").alias("word")), "spellings")
    named = scored
    for x in "abc":
        named = named.join(spelled.select(F.col("h").alias(x), F.col("word").alias(f"w{x}")), x, "left" if x == "c" else "inner")
    languages = docs.select(_language(lang).alias("lang")).distinct().withColumn("seed", F.xxhash64("lang"))
    totals = found.where("kind = 0").select(F.col("a").alias("seed"), F.col("n").alias("words")).join(languages, "seed")
    phrases = named.select("seed", F.concat_ws(" ", "wa", "wb", "wc").alias("phrase"), F.col("n").alias("a"), "l", "r", "score")
    by_rank = Window.partitionBy("seed").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = phrases.withColumn("rank", F.row_number().over(by_rank).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "seed").select("lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), F.col("score").cast("long").alias("score"))


#: The same by counting every phrase, for DuckDB.
SQL = r"""
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), pieces AS (
  SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs
), parts AS (
  SELECT lang, row_number() OVER () AS id, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), words AS (
  SELECT lang, id, unnest(w) AS a, unnest(range(len(w))) AS i FROM parts
), runs AS (
  SELECT lang, a, lead(a, 1) OVER p AS b, lead(a, 2) OVER p AS c FROM words WINDOW p AS (PARTITION BY id ORDER BY i)
), one AS (
  SELECT lang, a, count(*)::HUGEINT AS f FROM runs GROUP BY ALL
), two AS (
  SELECT lang, a, b, count(*)::HUGEINT AS f FROM runs WHERE b IS NOT NULL GROUP BY ALL
), three AS (
  SELECT lang, a, b, c, count(*)::HUGEINT AS f FROM runs WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), totals AS (
  SELECT lang, sum(f) AS n FROM one GROUP BY lang
), cuts AS (
  SELECT t.lang, t.a || ' ' || t.b || ' ' || t.c AS phrase, t.f, 1 AS cut, x.f AS l, y.f AS r
  FROM three t JOIN one x ON x.lang = t.lang AND x.a = t.a JOIN two y ON y.lang = t.lang AND y.a = t.b AND y.b = t.c
  UNION ALL
  SELECT t.lang, t.a || ' ' || t.b || ' ' || t.c, t.f, 2, x.f, y.f
  FROM three t JOIN two x ON x.lang = t.lang AND x.a = t.a AND x.b = t.b JOIN one y ON y.lang = t.lang AND y.a = t.c
), longest AS (
  SELECT lang, a, b, max(f) AS f FROM (SELECT lang, a, b, f FROM three UNION ALL SELECT lang, b, c, f FROM three) GROUP BY ALL
), scored AS (
  SELECT lang, phrase, f, l, r, (1000000 * f * f) // (l * r) AS score FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
  UNION ALL
  SELECT t.lang, t.a || ' ' || t.b, t.f, x.f, y.f, (1000000 * t.f * t.f) // (x.f * y.f)
  FROM two t JOIN one x ON x.lang = t.lang AND x.a = t.a JOIN one y ON y.lang = t.lang AND y.a = t.b
  LEFT JOIN longest m ON m.lang = t.lang AND m.a = t.a AND m.b = t.b
  WHERE t.f >= 10 AND coalesce(100 * m.f < 50 * t.f, true)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, phrase) AS rank, phrase,
       f::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM scored JOIN totals USING (lang)
QUALIFY rank <= 2000
"""
