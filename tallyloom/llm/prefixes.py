"""Prefix trie of conversations by distributed burst tries.

Every conversation is rebuilt first: the first h turns of its base (``conv_id - conv_id % 100``), then its own turns after
its first h, with h = crc32(conv_id) % 6. Conversations with the same turns are one sequence with a number of members.

The sequences are suffixes in *containers*, each under the trie head of its common prefix; the first is under the root. A
container with more than ``CONTAINER`` turns bursts: the turns all its sequences have in common next become a chain of
nodes, and by the turn that follows its sequences are dealt into new containers under new heads. That is a
grouping by container and position, so a container of any size, or a single sequence of any length, is never in one
task. Containers that are left are sorted by their turns, and each is swept into nodes by one task.
Sums over subtrees come back up through the heads, one small job a round of bursts; sums along chains are running sums
over ranges.

Turns are known by the MD5 of role and text, sequences by their length and two 64-bit sums over turns and places.

Cases: null role or text is empty; turns of one number follow each other by that digest, equal rows stay as often as they occur; a
null turn comes first; rows without a conv_id belong to no conversation and are left out; a conversation may be
rebuilt without turns and then ends at the root; other columns are left out; an empty table has no members, so
not even a root. A text may have any length, only its digest and number of code points are carried.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm.common import batches_of
from tallyloom.llm.ranged import running
from tallyloom.sources.workspace import stage

#: Turns a container may hold without being burst; what one task sweeps at a time.
CONTAINER = 8_000
#: Bytes of member ids that are hashed as one row.
CHUNK = 60_000
BASE = 100
TAKEN = 6
EMPTY = hashlib.sha256(b"").hexdigest()
ROOT = bytes(16)

_LONG = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
COLUMNS = [*_LONG, "ends_sha256"]


def rebuilt(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(all ``conv``, the rebuilt turns ``conv, pos, tid, chars`` with positions from 1), both written."""
    said = F.coalesce(F.col(text).cast("string"), F.lit(""))
    spoken = F.coalesce(F.col(role).cast("string"), F.lit(""))
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.length(spoken).cast("string"), F.lit(":"), spoken, said))).alias("tid"),
        F.length(said).cast("long").alias("chars"),
        F.lit(1).cast("long").alias("one"),
    )
    own = running(rows, "conv", ["turn", "tid"], "one", "pos").select("conv", "pos", "tid", "chars")
    own = stage(own, "turns")
    taken = F.crc32(F.col("conv").cast("string")) % TAKEN
    base = own.where((F.col("conv") % BASE == 0) & (F.col("pos") < TAKEN))
    heads = base.groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "tid", "chars"))).alias("head"))
    convs = own.select("conv").distinct().withColumn("h", taken).withColumn("base", F.col("conv") - F.col("conv") % BASE)
    empty = F.array().cast("array<struct<pos: long, tid: binary, chars: long>>")
    convs = stage(convs.join(heads, "base", "left").select("conv", "h", F.slice(F.coalesce("head", empty), F.lit(1), F.col("h").cast("int")).alias("head")), "convs")
    late = own.where(F.col("pos") > taken).join(convs.select("conv", (F.size("head") - F.col("h")).alias("shift")), "conv")
    turns = convs.select("conv", F.inline("head")).unionByName(late.select("conv", (F.col("pos") + F.col("shift")).alias("pos"), "tid", "chars"))
    return convs.select("conv"), stage(turns, "rebuilt")


def _sequences(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """``conv, seq, len``: the smallest conversation with the same turns, for all conversations."""
    places = [F.xxhash64("pos", "tid", F.lit(k)) for k in (1, 2)]
    told = turns.groupBy("conv").agg(F.count("*").alias("len"), *[F.bit_xor(p).alias(f"x{k}") for k, p in enumerate(places)])
    known = convs.join(told, "conv", "left").select("conv", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("len", "x0", "x1")])
    known = stage(known, "known")
    classes = known.groupBy("len", "x0", "x1").agg(F.min("conv").alias("seq"), F.count("*").alias("n"))
    return stage(known.join(classes, ["len", "x0", "x1"]).select("conv", "seq", "len", "n"), "members")


def _joined_ids(batches):
    """Member ids of a sorted range as comma-joined pieces."""
    schema = pa.schema([("seq", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])

    def rows():
        held, first, parts, size = None, None, [], 0
        for batch in batches:
            for seq, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if parts and (seq != held or size >= CHUNK):
                    yield held, first, ",".join(parts)
                    parts, size = [], 0
                if not parts:
                    held, first = seq, conv
                parts.append(str(conv))
                size += len(parts[-1]) + 1
        if parts:
            yield held, first, ",".join(parts)

    yield from batches_of(rows(), schema, lambda row: len(row[2]))


def _hashed_ids(batches):
    schema = pa.schema([("seq", pa.int64()), ("ends", pa.string())])

    def rows():
        held, state = None, None
        for batch in batches:
            for seq, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                if state is None or seq != held:
                    if state is not None:
                        yield held, state.hexdigest()
                    held, state = seq, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_py().encode())
        if state is not None:
            yield held, state.hexdigest()

    yield from batches_of(rows(), schema)


def _ends(members: DataFrame) -> DataFrame:
    """``seq, ends``: SHA-256 of the sorted member ids; many ids come as few long pieces."""
    alone = members.where("n = 1").select("seq", F.sha2(F.col("seq").cast("string").cast("binary"), 256).alias("ends"))
    many = members.where("n > 1").select("seq", "conv")
    pieces = many.repartitionByRange("seq", "conv").sortWithinPartitions("seq", "conv").mapInArrow(_joined_ids, "seq long, first long, ids string")
    laid = pieces.repartition("seq").sortWithinPartitions("seq", "first").select("seq", "ids")
    return alone.unionByName(laid.mapInArrow(_hashed_ids, "seq long, ends string"))


_NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, top binary"


def _sweep(batches):
    """Nodes of whole containers whose sequences come sorted; the head's own row names the container above in ``top``."""
    schema = pa.schema([(c, pa.int64()) for c in _LONG] + [("ends_sha256", pa.string()), ("top", pa.binary())])

    def nodes(group):
        top, depth, chars, parent, *_ = group[0]
        # preorder: each node [conv, up, n, children, leaves, saved, ends, depth, chars]
        made = [[None, -1, 0, 0, 0, 0, EMPTY, depth, chars]]
        path, last = [0], ()
        for _, _, _, _, seq, n, ends, tids, lengths in group:
            same = 0
            while same < len(last) and same < len(tids) and last[same] == tids[same]:
                same += 1
            del path[same + 1 :]
            for k in range(same, len(tids)):
                made.append([None, path[-1], 0, 0, 0, 0, EMPTY, depth + k + 1, lengths[k]])
                path.append(len(made) - 1)
            end = made[path[-1]]
            end[0], end[2], end[6] = (seq if end[0] is None else min(seq, end[0])), end[2] + n, ends
            last = tids
        for node in reversed(made):
            node[4] = node[4] or 1
            node[5] += (node[2] - 1) * node[8]
            if node[1] >= 0:
                up = made[node[1]]
                up[0] = node[0] if up[0] is None else min(up[0], node[0])
                up[2] += node[2]
                up[3] += 1
                up[4] += node[4]
                up[5] += node[5]
        for conv, up, n, children, leaves, saved, ends, at, _ in made:
            yield conv, at, parent if up < 0 else made[up][0], n, children, leaves, saved, ends, top if up < 0 else None

    def rows():
        held, group = None, []
        for batch in batches:
            container, *rest = batch.columns
            for i in range(batch.num_rows):
                key = container[i].as_py()
                if group and key != held:
                    yield from nodes(group)
                    group = []
                held = key
                group.append(tuple(c[i].as_py() for c in rest))
        if group:
            yield from nodes(group)

    yield from batches_of(rows(), schema)


def _burst(assigned: DataFrame, turns: DataFrame, oversized: DataFrame, level: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(burst heads, their chains, the sequences in new containers) of one round."""
    inside = assigned.join(oversized.select("container"), "container", "left_semi")
    rows = turns.join(inside.select("seq", "container", "depth", "chars_above", "parent_conv", "top"), "seq").where("pos > depth")
    at = rows.groupBy("container", "pos").agg(F.min("tid").alias("one"), F.max("tid").alias("other"), F.count("*").alias("here"), F.max("chars").alias("chars"))
    at = stage(at.join(oversized, "container"), "positions")
    splits = at.groupBy("container").agg(F.min(F.when((F.col("one") != F.col("other")) | (F.col("here") < F.col("sequences")), F.col("pos"))).alias("split"), F.max("pos").alias("reach"))
    splits = splits.select("container", F.coalesce("split", F.col("reach") + 1).alias("split"))
    heads = stage(oversized.join(splits, "container").withColumn("level", F.lit(level)), "heads")
    chains = at.join(heads.select("container", "split"), "container").where("pos < split").select("container", "pos", "chars", "n", "conv")
    following = turns.join(inside.select("seq", "n", "len", "ends", "container"), "seq").join(heads.select("container", "split", F.col("conv").alias("parent_conv")), "container").where("pos = split")
    below = following.select(
        "seq",
        "n",
        "len",
        "ends",
        F.unhex(F.md5(F.concat("container", F.col("split").cast("string").cast("binary"), "tid"))).alias("container"),
        F.col("split").alias("depth"),
        F.col("chars").alias("chars_above"),
        "parent_conv",
        F.col("container").alias("top"),
    )
    ended = inside.join(heads.select("container", "split"), "container").where("len < split").select("container", "ends")
    heads = heads.join(ended, "container", "left")
    return stage(heads, "heads"), stage(chains, "chains"), stage(below, "containers")


def trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", container: int | None = None) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, with ``COLUMNS``."""
    limit = CONTAINER if container is None else container
    convs, turns = rebuilt(conversations, conv, turn, role, text)
    members = _sequences(convs, turns)
    sequences = members.where("conv = seq").select("seq", "n", "len")
    turns = stage(turns.withColumnRenamed("conv", "seq").join(sequences.select("seq"), "seq", "left_semi"), "sequences")
    assigned = sequences.join(_ends(members), "seq").select(
        "seq", "n", "len", "ends", F.lit(ROOT).alias("container"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars_above"),
        F.lit(None).cast("long").alias("parent_conv"), F.lit(None).cast("binary").alias("top"),
    )
    assigned, small, bursts, chains, level = stage(assigned, "containers"), [], [], [], 0
    while True:
        sizes = assigned.groupBy("container").agg(
            F.sum(F.col("len") - F.col("depth")).alias("size"), F.sum("n").alias("n"), F.min("seq").alias("conv"), F.count("*").alias("sequences"),
            F.first("depth").alias("depth"), F.first("chars_above").alias("chars_above"), F.first("parent_conv").alias("parent_conv"), F.first("top").alias("top"),
        )
        oversized = stage(sizes.where(F.col("size") > limit).drop("size"), "oversized")
        if oversized.isEmpty():
            small.append(assigned)
            break
        small.append(assigned.join(oversized.select("container"), "container", "left_anti"))
        heads, chain, assigned = _burst(assigned, turns, oversized, level)
        bursts.append(heads)
        chains.append(chain)
        level += 1
    swept = _swept(_all(small), turns)
    if not bursts:
        return swept.select(*COLUMNS)
    return _with_bursts(swept, bursts, _all(chains))


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _swept(small: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes of the containers that fit one task each."""
    ahead = turns.join(small.select("seq", "depth"), "seq").where("pos > depth")
    suffixes = ahead.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("pos", "tid", "chars"))).alias("rest"))
    none = F.array().cast("array<struct<pos: long, tid: binary, chars: long>>")
    laid = small.join(suffixes, "seq", "left").withColumn("rest", F.coalesce("rest", none))
    laid = laid.select("container", "top", "depth", "chars_above", "parent_conv", "seq", "n", "ends", F.col("rest.tid").alias("tids"), F.col("rest.chars").alias("lengths"))
    laid = laid.repartition("container").sortWithinPartitions("container", "tids")
    return stage(laid.mapInArrow(_sweep, _NODES), "nodes")


def _with_bursts(swept: DataFrame, bursts: list[DataFrame], chains: DataFrame) -> DataFrame:
    """Adds the nodes of burst containers, from the deepest round of bursts up."""
    weighed = chains.withColumn("saved", (F.col("n") - 1) * F.col("chars"))
    along = running(weighed, "container", ["pos"], "saved", "above") if not chains.isEmpty() else weighed.withColumn("above", F.lit(0).cast("long"))
    whole = along.groupBy("container").agg(F.sum("saved").alias("chain_saved"), F.max("pos").alias("chain_end"), F.count("*").alias("chain"))
    tops = swept.where("top IS NOT NULL").select("top", "n_leaves", "saved_tokens")
    parts = [swept.select(*COLUMNS)]
    for heads in reversed(bursts):
        below = tops.groupBy(F.col("top").alias("container")).agg(F.count("*").alias("below"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("below_saved"))
        full = heads.join(whole, "container", "left").join(below, "container", "left")
        full = full.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("chain", "chain_saved", "below", "leaves", "below_saved")})
        full = full.withColumn("leaves", F.greatest("leaves", F.lit(1).cast("long"))).withColumn("ends", F.coalesce("ends", F.lit(EMPTY)))
        full = stage(full.withColumn("total", F.col("chain_saved") + F.col("below_saved") + (F.col("n") - 1) * F.col("chars_above")), "burst")
        long = F.col("chain") > 0
        parts.append(
            full.select(
                F.col("conv").alias("conv_id"),
                "depth",
                F.col("parent_conv").alias("parent_conv_id"),
                F.col("n").alias("n_convs"),
                F.when(long, F.lit(1).cast("long")).otherwise(F.col("below")).alias("n_children"),
                F.col("leaves").alias("n_leaves"),
                F.col("total").alias("saved_tokens"),
                F.when(long, F.lit(EMPTY)).otherwise(F.col("ends")).alias("ends_sha256"),
            )
        )
        last = F.col("pos") == F.col("chain_end")
        on_chain = along.join(full.select("container", "chain_end", "chain_saved", "below", "leaves", "below_saved", "ends"), "container")
        parts.append(
            on_chain.select(
                F.col("conv").alias("conv_id"),
                F.col("pos").alias("depth"),
                F.col("conv").alias("parent_conv_id"),
                F.col("n").alias("n_convs"),
                F.when(last, F.col("below")).otherwise(F.lit(1).cast("long")).alias("n_children"),
                F.col("leaves").alias("n_leaves"),
                (F.col("chain_saved") - F.col("above") + F.col("saved") + F.col("below_saved")).alias("saved_tokens"),
                F.when(last, F.col("ends")).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
            )
        )
        tops = tops.unionByName(full.where("top IS NOT NULL").select("top", F.col("leaves").alias("n_leaves"), F.col("total").alias("saved_tokens")))
    return _all([p.select(*COLUMNS) for p in parts])
