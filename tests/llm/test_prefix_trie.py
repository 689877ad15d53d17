"""The trie of prefixes against sets of prefixes, whatever the shards."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import types as T

from tidemark.llm import prefix_trie as trie

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("depth", T.StringType())])


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def rebuilt(rows):
    own = {}
    for c, turn, role, text, _ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(turns)] for c, turns in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[: h[c]] + own[c][h[c] :] for c in own}


def plain(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for path in nodes:
        if path:
            children.setdefault(path[:-1], []).append(path)

    def subtree(path):
        yield path
        for child in children.get(path, []):
            yield from subtree(child)

    found = []
    for path, members in nodes.items():
        below = list(subtree(path))
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(path))))
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        parent = min(nodes[path[:-1]]) if path else None
        found.append((min(members), len(path), parent, len(members), len(children.get(path, [])), sum(p not in children for p in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=repr)


def conversations():
    draw = random.Random(11)
    said = ["", "a", "naïve 你好", "b" * 50]
    rows = []
    for c in range(160):
        for turn in range(draw.choice([1, 2, 3, 5, 9, 14])):
            rows.append((c * 2 if c % 4 else c, turn, draw.choice(["user", "assistant", None]), draw.choice(said[: 1 + turn % 3] + [None]), "x"))
    rows += [(1000 + k, t, "user", f"same {t}", "x") for k in range(60) for t in range(12)]
    rows += [(2000, t, "user", "long", "x") for t in range(300)] + [(None, 0, "user", "nobody", "x"), (3001, None, "user", "z", "x"), (3001, 0, "user", "a", "x"), (3001, 0, "user", "a", "x"), (3001, 0, "role", "a", "x")]
    return rows


@pytest.mark.parametrize("shard_paths, fewest", [(20_000, 1_000), (20, 1_000)])
def test_against_sets_of_prefixes(spark, monkeypatch, shard_paths, fewest):
    monkeypatch.setattr(trie, "FEWEST_PATHS", fewest)
    monkeypatch.setattr(trie, "CHUNK", 40)
    monkeypatch.setattr(trie, "BATCH_NODES", 50)
    rows = conversations()
    paths = trie.with_borrowed_heads(trie.conversation_paths(spark.createDataFrame(rows, SCHEMA)))
    assert sorted(map(tuple, trie.prefix_trie(paths, shard_paths).collect()), key=repr) == plain(rebuilt(rows))


def test_turnless_and_single(spark):
    rows = [(4, 0, "user", "x", None)]
    made = rebuilt(rows)
    paths = trie.with_borrowed_heads(trie.conversation_paths(spark.createDataFrame(rows, SCHEMA)))
    assert made[4] == [] and sorted(map(tuple, trie.prefix_trie(paths).collect()), key=repr) == plain(made)


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert trie.prefix_trie(trie.with_borrowed_heads(trie.conversation_paths(none))).collect() == []
