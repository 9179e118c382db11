"""Exact similarity join of word shingle sets by a token-group matrix.

Two documents link when 9 * shared >= 4 * (size + size), that is, at a Jaccard similarity of 0.8.

Equal sets are one node. Of each set the *visible* tokens are looked at: those whose 64-bit hash is below a
level that depends on the set's size only. A set that links to one at least as large has 8/9 of its tokens in
common with it, so ``needed`` of its visible tokens, and so one of its ``probes``, its visible tokens
without the ``needed - 1`` most frequent ones. Tokens of one node only link nothing and are dropped.

Nodes are partitioned into groups by their most frequent probe and their size. The matrix holds the
token union of every group. A query opens a group if the union may have ``needed`` of its visible tokens, a probe among them.
Every node is compared with the most typical member of its own group first. Nodes that are linked by
then need no further comparison with each other. Then come rounds: the queries and the members of each opened group
meet in blocks, where a task compares the parity bits of their whole sets. Linked sets differ in a ninth of both
sizes at most, and so do their bits. Of the pairs of two components that may link by that bound, the first rounds name
a forest per block, those with the fewest different bits first, so no more pairs than the block has sets. In later rounds a query
names the nearest member of each other component, 64 times as many in every further round. These sets are compared
whole; links merge components, refuted pairs are not named again, and a query that has named all it could in a block asks
there no more, nor does anyone in a block that is one component by now. The
rounds end when no query is left: then no link between two components is left.

Cases: null or blank text has an empty set, links with nothing and is its own component; repeated rows have
one set and come back as often as they occur; a null id is carried and is nobody's component id unless
no row of the component has one; other columns are left out; an empty table gives an empty result. Sets
and tokens are known by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyloom.llm import words as W
from tallyloom.llm.common import batches_of
from tallyloom.llm.graph import components
from tallyloom.sources.workspace import Scratch, stage

#: Share of hashes that are visible for sets up to a size; raised if a set sees too few of its own.
LEVELS = [(64, 1.0), (256, 0.5), (1024, 0.25), (4096, 0.18), (2**62, 0.15)]
#: Written tables of fixed-width rows are sent to all tasks up to these bytes; larger ones are joined by shuffle.
BROADCAST_BYTES = 64_000_000
#: Members compared with one other set in one task.
CHUNK = 2_000
REMEMBERED = 200_000
#: Rounds that name a forest of pairs per block; near copies, however many, are one component after them.
FORESTS = 2
#: Edges of a forest that are looked at between two searches for those that join nothing any more.
EDGES = 4_096
#: Edges of a block that are kept at once; beyond them those that are no forest's go.
HELD_EDGES = 200_000
#: How many times as many members of a component a query names in every further round.
MORE = 64
#: Nodes beyond which a token that is no probe counts as shared without being looked up.
FREQUENT = 64
#: Parity bits of a set.
BITS = 1024
_SPAN = float(2**64)


def level(size, scale: int = 1):
    """Visible hashes of a set of ``size``, as a share of all; ``scale`` doubles it."""
    for most, share in LEVELS:
        if size <= most:
            return min(1.0, share * scale)
    raise ValueError(size)


def least_common(size: int) -> int:
    """Tokens that a set shares with any set at least as large that it links to."""
    return -(-8 * size // 9)


def sets_of(column: pa.Array):
    """(row, sorted distinct shingle hashes) of every text."""
    for row, words in W.words_of(column):
        yield row, np.unique(W.shingle_hashes(words))


def node_of(tokens: np.ndarray) -> int | None:
    if not len(tokens):
        return None
    pair = np.array([W.mix(tokens).sum(), W.mix(tokens ^ np.uint64(0x9E3779B97F4A7C15)).sum() + np.uint64(len(tokens))], np.uint64)
    return int((W.mix(pair) * np.array([1, 0xD6E8FEB86659FD93], np.uint64)).sum().view(np.int64))


def measure(docs: DataFrame, scale: int = 1) -> DataFrame:
    """``doc_id, n, node, seen, cut, at`` and the visible ``tokens`` (null where the task has given this node's before).

    ``seen`` counts the visible tokens by the set's own level; ``tokens`` go on to the level of sets a fifth smaller.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("seen", pa.int64()), ("cut", pa.int64()), ("at", pa.int64())]
        + [("tokens", pa.list_(pa.int64()))]
    )

    def run(batches):
        given: set[int] = set()

        def rows():
            for batch in batches:
                ids, places = batch.column(0), batch.column(2)
                for row, tokens in sets_of(batch.column(1)):
                    doc, at = ids[row].as_py(), places[row].as_py()
                    n, node = len(tokens), node_of(tokens)
                    if n == 0:
                        yield doc, 0, None, 0, 0, at, None
                        continue
                    own, wide = (_below(tokens, level(s, scale)) for s in (n, max(1, 4 * n // 5)))
                    cut = int(tokens[own - 1].view(np.int64)) if own else 0
                    if node in given:
                        yield doc, n, node, own, cut, at, None
                        continue
                    if len(given) >= REMEMBERED:
                        given.clear()
                    given.add(node)
                    yield doc, n, node, own, cut, at, tokens[: max(own, wide)].view(np.int64)

        yield from batches_of(rows(), schema, lambda row: 0 if row[6] is None else 8 * len(row[6]))

    return docs.mapInArrow(run, "doc_id long, n long, node long, seen long, cut long, at long, tokens array<long>")


def _below(tokens: np.ndarray, share: float) -> int:
    if share >= 1:
        return len(tokens)
    return int(np.searchsorted(tokens, np.uint64(int(share * _SPAN))))


def _small(df: DataFrame) -> DataFrame:
    """Ask for a broadcast if the (written) table, of longs only, is proven small."""
    return F.broadcast(df) if df.count() * (16 + 8 * len(df.columns)) <= BROADCAST_BYTES else df


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, node`` of every row."""
    # a row is found again by its id, or else by its text; rows found along with it do no harm
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    docs = docs.withColumn("at", F.coalesce("doc_id", F.xxhash64("text")))
    spark = docs.sparkSession
    with Scratch(spark) as passing:
        index, rows, nodes = _indexed(docs)
        links = _links(docs, index, nodes)
        labels = components(links)
        least = labels.join(nodes, "node").groupBy("label").agg(F.min("first").alias("component_id"))
        known = nodes.join(labels.join(least, "label"), "node", "left").select("node", F.coalesce("component_id", "first").alias("component_id"))
        rows = rows.select("doc_id", F.col("n").alias("n_shingles"), "node").join(known, "node", "left")
        out = stage(rows.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "node"), "components")
        passing.spare()
    return out


def _indexed(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the index of visible tokens that several nodes have, all rows, all nodes), written; the token lists are deleted."""
    with Scratch(docs.sparkSession) as passing:
        scale = 1
        while True:
            measured = stage(measure(docs, scale), "sets")
            short = F.col("seen") < F.col("n") - F.ceil(8 * F.col("n") / 9) + 1  # a link might not be seen
            if measured.where((F.col("n") > 0) & short).isEmpty():
                break
            scale *= 2
        rows = stage(measured.select("doc_id", "n", "node"), "rows")
        passing.spare()
        nodes = measured.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("seen").alias("seen"), F.first("cut").alias("cut"), F.min("at").alias("at"))
        nodes = stage(nodes, "nodes")
        passing.spare()
        index = _index(measured, nodes)
        passing.spare()
    return index, rows, nodes


def one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, with all their columns, without the near-duplicates of a row with a smaller key.

    Rows with null or repeated keys are told apart by a number of their own. Texts without a word stay.
    """
    ids = docs.agg(F.count("*").alias("rows"), F.count(key).alias("known"), F.count_distinct(key).alias("ids")).first()
    if ids["rows"] == ids["ids"]:
        rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("content"), F.struct("*").alias("row"))
    else:
        numbered = docs.select(F.monotonically_increasing_id().alias("id"), F.col(text).alias("content"), F.struct("*").alias("row"))
        rows = stage(numbered, "numbered")
    found = join(rows, "id", "content")
    going = stage(found.where("doc_id <> component_id").select(F.col("doc_id").alias("id")), "copies")
    return rows.join(_small(going), "id", "left_anti").select("row.*")


def _index(measured: DataFrame, nodes: DataFrame) -> DataFrame:
    visible = measured.where("tokens IS NOT NULL").select("node", F.explode("tokens").alias("token"))
    counts = stage(visible.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "tokens")
    shared = visible.join(counts, "token").join(nodes.select("node", "n", "seen", "cut"), "node").dropDuplicates(["node", "token"])
    # probes: the visible tokens by rising frequency without the needed - 1 last; dropped ones (of one node) come first
    shared = shared.withColumn("own", _unsigned("token") <= _unsigned("cut"))
    by_node = Window.partitionBy("node")
    from_top = F.row_number().over(by_node.orderBy(F.desc("own"), F.desc("df"), "token"))
    needed = F.ceil(8 * F.col("n") / 9) - F.col("n") + F.col("seen")
    ranked = shared.select("*", from_top.alias("from_top"), needed.alias("needed"), F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25))).cast("int").alias("band"))
    ranked = ranked.withColumn("probe", F.col("own") & (F.col("from_top") >= F.col("needed")))
    # the most frequent probe: what near-duplicates have in common, and texts that share one passage have not
    top = F.max(F.struct("probe", "df", "token")).over(by_node)
    n_own = F.sum(F.col("own").cast("long")).over(by_node)
    typical = F.round(F.sum(F.when(F.col("own"), F.log("df"))).over(by_node) / F.col("seen"), 6)
    taken = F.sum((F.col("own") & ~F.col("probe") & (F.col("df") > FREQUENT)).cast("long")).over(by_node)
    return stage(ranked.select("node", "token", "n", "df", "own", "probe", "needed", "band", top["token"].alias("core"), typical.alias("typical"), taken.alias("taken"), n_own.alias("n_own"), (F.col("seen") - n_own).alias("alone")), "index")


def _links(docs: DataFrame, index: DataFrame, nodes: DataFrame) -> DataFrame:
    with Scratch(docs.sparkSession) as passing:
        opened = _opened(index)
        passing.spare()
    # the most typical member has the most frequent tokens: of a text and its edited copies, the text
    group = ["core", "band"]
    pivots = index.groupBy(*group).agg(F.max(F.struct("typical", "node")).alias("best"))
    pivots = stage(pivots.select(*group, F.col("best.node").alias("pivot")), "pivots")
    members = stage(index.select("node", "n", "alone", *group).dropDuplicates(["node"]), "members")
    # a node meets its own group's pivot only: one pair, however many groups it opens
    first = members.join(pivots, group).where("node <> pivot").select("node", F.col("pivot").alias("other"))
    links = _verified(docs, nodes, first)
    bits, refuted = docs.sparkSession.createDataFrame([], "node long, bits array<long>"), None
    asked, turn, labels = opened, 0, components(links)
    while True:
        most = MORE ** (turn - FORESTS) if turn >= FORESTS else None
        with Scratch(docs.sparkSession) as passing:
            contested = _contested(members, asked, labels)
            tags = stage(contested.select("core", "band", _block(), "label").distinct(), "tags")
            passing.spare()
            fresh = contested.select("node").distinct().join(bits.select("node"), "node", "left_anti")
            made = stage(_made(docs, nodes, fresh, _bits, "node long, bits array<long>").dropDuplicates(["node"]), "bits")
            passing.spare()
            bits = bits.unionByName(made)
            named = stage(_named(contested, bits, refuted, most), "named")
            passing.spare()
        if named.isEmpty():
            return links
        pairs = named.where("other IS NOT NULL").select("node", "other").distinct()
        found = _verified(docs, nodes, pairs)
        links = links.unionByName(found)
        further = named.where("more").select("node", "block").distinct()
        if further.isEmpty():
            return links
        # all others have named every member they may link to
        labels, turn = components(links), turn + 1
        asked = stage(_unsettled(further, tags, labels), "asked")
        wrong = pairs.join(found.select(F.col("a").alias("node"), F.col("b").alias("other")), ["node", "other"], "left_anti")
        refuted = stage(wrong if refuted is None else refuted.unionByName(wrong), "refuted")


def _block():
    """The number of a block of queries and members."""
    return F.xxhash64("core", "band", "i", "j").alias("block")


def _unsettled(further: DataFrame, tags: DataFrame, labels: DataFrame) -> DataFrame:
    """``node, core, band``: the groups a query has to ask again, by the blocks ``further`` where it could name more.

    ``tags`` are the components each block held; a block with one component left has nothing to ask. Blocks are told by
    their few components, so that a large group of near copies, one component by now, is not joined query by query.
    """
    now = tags.join(labels.select(F.col("node").alias("label"), F.col("label").alias("now")), "label", "left")
    merged = F.coalesce("now", "label")
    split = now.groupBy("core", "band", "block").agg(F.min(merged).alias("low"), F.max(merged).alias("high")).where("low <> high")
    return further.join(split.select("core", "band", "block"), "block").select("node", "core", "band").distinct()


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    with Scratch(docs.sparkSession) as passing:
        links = stage(verify(docs, nodes, pairs), "links")
        passing.spare()
    return links


def _opened(index: DataFrame) -> DataFrame:
    """``node, core, band``: the groups that a query opens."""
    group = ["core", "band"]
    matrix = stage(index.groupBy("token", *group).agg(F.min("n").alias("least"), F.max("n").alias("most")), "matrix")
    # a query needs 9 * shared >= 4 * (own size + partner's size); what it shares is at most n - alone
    # frequent tokens that are no probes are taken as shared instead of being looked up in many groups
    queries = index.where("own AND n_own >= needed").select("node", "token", "n", "df", "probe", "needed", "taken")
    met = queries.where(f"probe OR df <= {FREQUENT}").join(matrix, "token").where("most >= n AND least <= floor(5 * n / 4)")
    opened = met.groupBy("node", *group).agg(
        F.count("*").alias("overlap"), F.max("probe").alias("probed"), F.first("needed").alias("needed"), F.first("taken").alias("taken")
    )
    return stage(opened.where("probed AND overlap + taken >= needed").select("node", *group), "opened")


def _contested(members: DataFrame, opened: DataFrame, labels: DataFrame) -> DataFrame:
    """Queries and members of the opened groups where components differ, dealt into blocks, written."""
    group = ["core", "band"]
    named = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    asking = opened.join(named.where("8 * n <= 9 * (n - alone)").drop(*group), "node")
    columns = ["node", *group, "n", "alone", "label"]
    both = asking.select(*columns, F.lit(0).alias("role")).unionByName(named.where("7.2 * n <= 9 * (n - alone)").select(*columns, F.lit(1).alias("role")))
    asks = F.col("role") == 0
    asker, holder = F.when(asks, F.col("label")), F.when(~asks, F.col("label"))
    counted = both.groupBy(*group).agg(
        F.count(asker).alias("asks"), F.count(holder).alias("held"),
        F.min(asker).alias("asks_low"), F.max(asker).alias("asks_high"), F.min(holder).alias("held_low"), F.max(holder).alias("held_high"),
    )
    places = stage(counted.where("asks > 0 AND held > 0 AND least(asks_low, held_low) <> greatest(asks_high, held_high)"), "places")
    # who has nobody of another component to meet stays away
    meets = F.when(asks, (F.col("label") != F.col("held_low")) | (F.col("label") != F.col("held_high")))
    meets = meets.otherwise((F.col("label") != F.col("asks_low")) | (F.col("label") != F.col("asks_high")))
    # blocks of queries times blocks of members, so that no group is one task's however many share it
    sized = both.join(places, group).where(meets)
    rows, across = F.ceil(F.col("asks") / CHUNK), F.ceil(F.col("held") / CHUNK)
    own = F.pmod(F.xxhash64("node"), F.when(asks, rows).otherwise(across))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.when(asks, across).otherwise(rows) - 1))
    dealt = sized.select(*columns, "role", own.alias("own"), every.alias("every"))
    return stage(dealt.select(*columns, "role", F.when(asks, F.col("own")).otherwise(F.col("every")).alias("i"), F.when(asks, F.col("every")).otherwise(F.col("own")).alias("j")), "contested")


def _named(contested: DataFrame, bits: DataFrame, refuted: DataFrame | None, most: int | None) -> DataFrame:
    """``node, other, more, block``: of each other component's members that a query may link to, the ``most`` nearest by parity bits.

    Without ``most``, a forest of them per block. ``more`` tells that the block had further ones, also in a row without ``other``.
    """
    block = ["core", "band", "i", "j"]
    rows = contested.join(bits, "node")
    none = F.array().cast("array<long>")
    if refuted is None:
        rows = rows.withColumn("wrong", none)
    else:
        wrong = refuted.groupBy("node").agg(F.collect_list("other").alias("wrong"))
        rows = rows.join(wrong, "node", "left").withColumn("wrong", F.when(F.col("role") == 0, F.coalesce("wrong", none)).otherwise(none))
    laid = rows.repartition(*block).sortWithinPartitions(*block)
    laid = laid.select(_block(), "role", "node", "n", "alone", "label", "bits", "wrong")
    return laid.mapInArrow(_nearest(most), "node long, other long, more boolean, block long").distinct()


def _forest(low: np.ndarray, high: np.ndarray, apart: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which of the pairs ``low, high``, nearest first, join two trees of the labels' graph."""
    tree = np.unique(label, return_inverse=True)[1]
    left, kept = np.argsort(apart, kind="stable"), []
    while len(left):
        above = list(range(int(tree.max()) + 1))
        for k in left[:EDGES].tolist():
            ends = [int(tree[low[k]]), int(tree[high[k]])]
            for e in (0, 1):
                while above[ends[e]] != ends[e]:
                    above[ends[e]] = above[above[ends[e]]]
                    ends[e] = above[ends[e]]
            if ends[0] != ends[1]:
                above[max(ends)] = min(ends)
                kept.append(k)
        roots = np.array(above)
        while not np.array_equal(roots, roots[roots]):
            roots = roots[roots]
        tree, left = roots[tree], left[EDGES:]
        left = left[tree[low[left]] != tree[high[left]]]
    return np.array(kept, np.int64)


def _nearest(most: int | None):
    schema = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("more", pa.bool_()), ("block", pa.int64())])

    def found(group, block):
        role, node, n, alone, label, marks, wrong = (np.concatenate([g[k] for g in group]) for k in range(7))
        asks, held = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        edges, skipped, pending = [], set(), 0

        def forest():
            """The edges so far, in their order, without those that no forest has: later ones cannot bring these back."""
            low, high, apart = (np.concatenate(part) for part in zip(*edges))
            kept = np.sort(_forest(low, high, apart, label))
            skipped.update(np.delete(low, kept).tolist())
            return [(low[kept], high[kept], apart[kept])]

        for tag in np.unique(label[asks]).tolist() if len(held) else ():
            others = held[label[held] != tag]
            if not len(others):
                continue
            sizes, left = n[others], n[others] - alone[others]
            for at in asks[label[asks] == tag]:
                both = sizes + n[at]
                fits = np.flatnonzero((sizes >= n[at]) & (4 * both <= 9 * np.minimum(n[at] - alone[at], left)))
                if not len(fits):
                    continue
                near = others[fits]
                apart = np.bitwise_count(marks[near] ^ marks[at]).sum(axis=1, dtype=np.int64)
                may = 9 * apart <= both[fits]
                if len(wrong[at]):
                    may &= ~np.isin(node[near], wrong[at])
                near, apart = near[may], apart[may]
                order = np.lexsort((node[near], apart, label[near]))
                tags = label[near][order]
                opens = np.flatnonzero(np.append(True, tags[1:] != tags[:-1])) if len(order) else order
                place = np.arange(len(order)) - np.repeat(opens, np.diff(np.append(opens, len(order))))
                if most is None:
                    first = order[place < 1]
                    edges.append((np.full(len(first), at, np.int32), near[first].astype(np.int32), apart[first].astype(np.int32)))
                    if len(first) < len(order):
                        skipped.add(int(at))
                    pending += len(first)
                    if pending >= HELD_EDGES:
                        edges, pending = forest(), 0
                    continue
                more = bool((place >= most).any())
                for k in order[place < most]:
                    yield int(node[at]), int(node[near[k]]), more, block
        if edges:
            for low, high, _ in forest():
                for a, b in zip(low, high):
                    yield int(node[a]), int(node[b]), False, block
            for at in skipped:
                yield int(node[at]), None, True, block

    def run(batches):
        def rows():
            held, group = None, []
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                block = batch.column(0).to_numpy()
                plain = [batch.column(k).to_numpy() for k in range(1, 6)]
                marks = batch.column(6).flatten().to_numpy().view(np.uint64).reshape(-1, BITS // 64)
                wrong = np.empty(batch.num_rows, object)
                for i, w in enumerate(batch.column(7)):
                    wrong[i] = w.values.to_numpy()
                edges = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
                for low, high in zip(edges.tolist(), [*edges[1:].tolist(), batch.num_rows]):
                    if group and block[low] != held:
                        yield from found(group, held)
                        group = []
                    held = int(block[low])
                    group.append((*[c[low:high] for c in plain], marks[low:high], wrong[low:high]))
            if group:
                yield from found(group, held)

        yield from batches_of(rows(), schema)

    return run


def _made(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, work, schema: str) -> DataFrame:
    """What ``work`` makes of the given nodes' sets, which come again from the text of one row of each."""
    rows = stage(wanted.distinct().join(nodes.select("node", "at"), "node"), "wanted")
    texts = docs.join(_small(rows.select("at").distinct()), "at").select("at", "text")
    return texts.mapInArrow(work, schema)


def _unsigned(name: str):
    """Signed longs in the order of the unsigned hashes they stand for."""
    return F.col(name).bitwiseXOR(F.lit(-(2**63)))


def verify(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b``: the pairs ``node, other`` whose whole sets link.

    Sets are made again from the texts of one row per node, and only for nodes in the pairs. Pairs of one
    ``other`` are dealt out in chunks; in each the other set comes first and is held while the members stream by.
    """
    pairs = stage(pairs, "pairs")
    sizes = pairs.groupBy("other").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = pairs.join(sizes, "other").withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks"))
    members = dealt.select(F.col("node"), "other", "chunk", F.lit(1).alias("role"))
    heads = dealt.select(F.col("other").alias("node"), "other", "chunk", F.lit(0).alias("role")).distinct()
    parts = stage(members.unionByName(heads), "parts")
    sets = _made(docs, nodes, parts.select("node"), _whole_sets, "node long, tokens array<long>")
    laid = sets.join(_small(parts), "node").repartition("other", "chunk").sortWithinPartitions("other", "chunk", "role")
    return laid.select("node", "other", "chunk", "role", "tokens").mapInArrow(_compare, "a long, b long").distinct()


def _whole_sets(batches):
    schema = pa.schema([("node", pa.int64()), ("tokens", pa.list_(pa.int64()))])
    rows = ((node_of(t), t.view(np.int64)) for batch in batches for _, t in sets_of(batch.column(1)) if len(t))
    yield from batches_of(rows, schema, lambda row: 8 * len(row[1]))


def _bits(batches):
    """Whether a set has an odd number of tokens in each of ``BITS`` classes."""
    schema = pa.schema([("node", pa.int64()), ("bits", pa.list_(pa.int64()))])

    def rows():
        for batch in batches:
            for _, tokens in sets_of(batch.column(1)):
                if len(tokens):
                    odd = np.bincount((tokens % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
                    yield node_of(tokens), np.packbits(odd.astype(np.uint8)).view(np.int64)

    yield from batches_of(rows(), schema)


def _compare(batches):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def rows():
        held, head = None, None
        for batch in batches:
            node, other, chunk, role, tokens = batch.columns
            values, bounds = tokens.flatten().to_numpy(), tokens.value_lengths().to_numpy().cumsum()
            for i in range(batch.num_rows):
                own = values[bounds[i - 1] if i else 0 : bounds[i]]
                place = (other[i].as_py(), chunk[i].as_py())
                if role[i].as_py() == 0:
                    held, head = place, own.copy()
                elif held == place:
                    common = len(np.intersect1d(own, head))
                    if 9 * common >= 4 * (len(own) + len(head)):
                        yield node[i].as_py(), place[0]

    yield from batches_of(rows(), schema)
