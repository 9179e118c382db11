"""The trie of rebuilt conversations against brute force."""

import collections
import hashlib
import random
import zlib

import pytest

from tallyloom.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string, seq string, container string"


def brute(rows):
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tid = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            turns[conv].append((turn is not None, turn or 0, tid, (role, text)))
    own = {c: [t[3] for t in sorted(v)] for c, v in turns.items()}
    made = {}
    for conv in own:
        h = zlib.crc32(str(conv).encode()) % 6
        base = conv - int(abs(conv) % 100) * (1 if conv >= 0 else -1)
        made[conv] = tuple(own.get(base, [])[:h] + own[conv][h:])
    members = collections.defaultdict(list)
    for conv, seq in made.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(conv)
    children = collections.defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[c] for c in children[node])
    result = []
    for node, ids in members.items():
        ends = ",".join(map(str, sorted(c for c in ids if len(made[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        result.append((min(ids), len(node), parent, len(ids), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(result, key=str)


def found(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], SCHEMA).repartition(5)
    out = prefixes.trie(df, **more)
    assert out.columns == prefixes.COLUMNS and all(t == "bigint" for c, t in out.dtypes if c != "ends_sha256")
    return sorted(map(tuple, out.collect()), key=str)


def talks(rng, n, words, longest=9):
    rows = []
    for conv in rng.sample(range(-150, 900), n):
        for turn in range(rng.randint(1, longest)):
            rows.append((conv, turn, rng.choice(["user", "user", "system", None]), rng.choice(words)))
    return rows


@pytest.mark.parametrize("container", [6, 8000])
def test_nodes(spark, container):
    rng = random.Random(container)
    rows = talks(rng, 90, ["a", "b", "", None, "é😀"], 6)
    same = [(1000 + k, t, "user", f"t{min(t, 9)}") for k in range(1, 60) for t in range(12)]  # many equal talks
    rows += same + [(None, 1, "user", "a"), (7001, None, "user", "first"), (7001, 0, "user", "second"), (7001, 0, "user", "second")]
    rows += [(5000 + k, t, "user", "same" if t < 30 + k else "other") for k in range(4) for t in range(45)]  # long common beginnings
    rng.shuffle(rows)
    assert found(spark, rows, container=container) == brute(rows)


def test_hot_conversation_and_ids_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "CHUNK", 10)
    rows = [(300, t, "user", f"{t % 7}") for t in range(900)] + [(k, 0, "user", "hello") for k in range(301, 420)]
    rng = random.Random(2)
    rng.shuffle(rows)
    assert found(spark, rows, container=50) == brute(rows)


def test_conversations_without_turns_and_empty_table(spark):
    lone = [(k, 0, "user", "x") for k in range(1, 40)]  # most have h > 0 and no base
    assert found(spark, lone) == brute(lone)
    assert found(spark, [(None, 0, "user", "x")]) == []
