"""Near-duplicates against brute force over every pair."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from tidemark.llm import neardup
from tidemark.llm.components import components
from tidemark.llm.neardup import near_duplicates

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("node", T.StringType())])


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if sets[x] and sets[y] and 100 * both >= 75 * (len(sets[x]) + len(sets[y]) - both):
                parent[max(root(x), root(y))] = min(root(x), root(y))
    least = {}
    for x, r in enumerate(rows):
        if r[0] is not None:
            least[root(x)] = min(least.get(root(x), r[0]), r[0])
    return sorted(((r[0], len(sets[x]), least.get(root(x))) for x, r in enumerate(rows)), key=str)


def test_near_duplicates_match_brute_force(spark):
    pick = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for base in range(25):
        text = [pick.choice(words) for _ in range(pick.choice([3, 6, 30, 200]))]
        for _ in range(pick.choice([1, 2, 8])):
            copy = list(text)
            for _ in range(pick.choice([0, 1, 2, 6])):
                copy[pick.randrange(len(copy))] = pick.choice(words).upper()
            rows.append((len(rows), pick.choice([" ", "\n\t"]).join(copy), "x"))
    rows += [(1000, None, "x"), (1001, "", None), (1002, " \t\n", "x"), (None, rows[0][1], "x"), (None, "alone here", "x"), rows[3], (1003, "word " * 30_000, "x"), (1004, "WORD\v" * 30_000, "x"), (1005, "a b", "x"), (1006, "A  b", "x"), (1007, "a b", "x")]
    pick.shuffle(rows)
    found = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_no_rows(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).columns[:4] == ["doc_id", "n_shingles", "component_id", "kept"]
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def threshold_group(members, seed=3):
    """Copies of one text of 80 words with two edits each, so that pairs lie about the threshold."""
    pick = random.Random(seed)
    base, texts = [f"v{pick.randrange(5000)}" for _ in range(80)], []
    for k in range(members):
        copy = list(base)
        for edit, at in enumerate(pick.sample(range(80), 2)):
            copy[at] = f"edit{k}x{edit}"
        texts.append(" ".join(copy))
    return texts


def test_group_about_the_threshold(spark, monkeypatch):
    """What leaves the join of open nodes is about as many pairs as there are links, so little is confirmed on texts."""
    left = []
    open_pairs = neardup._open_pairs

    def counted(*args):
        pairs, paths = open_pairs(*args)
        left.append(pairs.count())
        return pairs, paths

    monkeypatch.setattr(neardup, "_open_pairs", counted)
    rows = [(k, text, "x") for k, text in enumerate(threshold_group(260))]
    found = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute(rows)
    assert left[0] < 260 * 4


def long_group(members, words, changed, own, seed=4):
    """Copies of one text: the last ``own`` words are each copy's own, and ``changed`` single words elsewhere are."""
    pick = random.Random(seed)
    base, texts = [f"v{pick.randrange(100_000)}" for _ in range(words)], []
    for k in range(members):
        copy = base[: words - own] + [f"own{k}x{n}" for n in range(own)]
        for edit, at in enumerate(pick.sample(range(words - own), changed)):
            copy[at] = f"edit{k}x{edit}"
        texts.append(" ".join(copy))
    return texts


def met_and_left(spark, monkeypatch, texts):
    """Pairs of open nodes that are looked at, that leave the join, and that are confirmed on texts; and the result's rows."""
    seen = {}
    sides, refuted, open_pairs = neardup._sides, neardup._refuted, neardup._open_pairs

    def counted_sides(early, percent):
        x, y = sides(early, percent)
        rows = x.join(y, (x.shingle == y.of) & (x["class"] == y.of_class) & (x.minor_x | y.minor_y) & (x.node_x != y.node_y))
        seen["met"] = rows.count()
        return x, y

    def counted_refuted(pairs, *rest):
        seen["left"] = pairs.count()
        return refuted(pairs, *rest)

    def counted_pairs(*args):
        pairs, paths = open_pairs(*args)
        seen["confirmed"] = pairs.count()
        return pairs, paths

    with monkeypatch.context() as patched:
        patched.setattr(neardup, "_sides", counted_sides)
        patched.setattr(neardup, "_refuted", counted_refuted)
        patched.setattr(neardup, "_open_pairs", counted_pairs)
        rows = [(k, text, "x") for k, text in enumerate(texts)]
        found = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    return seen, sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str), rows


@pytest.mark.parametrize(("words", "own"), [(1000, 240), (1000, 170), (5000, 850)])
def test_long_texts_with_parts_of_their_own_do_not_meet(spark, monkeypatch, words, own):
    """Pairs at 0.61 and 0.71: no row of the join, however many they are."""
    for members in (30, 60):
        seen, found, rows = met_and_left(spark, monkeypatch, long_group(members, words, 0, own))
        assert found == brute(rows) and len({c for _, _, c in found}) == members
        assert seen == {"met": 0, "left": 0, "confirmed": 0}


@pytest.mark.parametrize("words", [1000, 5000])
def test_long_texts_with_scattered_edits_are_refuted_by_wide_sketches(spark, monkeypatch, words):
    """Pairs at 0.6 whose own shingles lie scattered meet, but none is confirmed on texts."""
    seen, found, rows = met_and_left(spark, monkeypatch, long_group(40, words, words * 28 // 1000, 0))
    assert found == brute(rows) and len({c for _, _, c in found}) == 40
    assert seen["confirmed"] == 0


def test_groups_across_sizes_and_the_threshold(spark, monkeypatch):
    """Edits, own parts and lengths mixed, so that links and no links of unequal sizes stand side by side."""
    pick, texts = random.Random(12), []
    base = [f"v{pick.randrange(5000)}" for _ in range(300)]
    for k in range(150):
        copy = base[: pick.randrange(200, 301)]
        for edit in range(pick.choice([0, 2, 5, 8])):
            copy[pick.randrange(len(copy))] = f"edit{k % 9}x{edit}"
        texts.append(" ".join(copy + [f"own{k}x{n}" for n in range(pick.choice([0, 10, 40, 60]))]))
    _, found, rows = met_and_left(spark, monkeypatch, texts)
    assert found == brute(rows) and 1 < len({c for _, _, c in found}) < 150


def test_sketches_never_refute_a_link():
    shingle = neardup.Shingler()
    for text in long_group(6, 1000, 10, 30) + long_group(3, 300, 5, 10):
        for other in long_group(4, 1000, 20, 100) + ["a b", ""]:
            x, y = shingle(text), shingle(other)
            bits = int(np.bitwise_count(np.bitwise_xor(*neardup.folded(neardup.wide_sketch(x), neardup.wide_sketch(y)))).sum())
            assert bits <= len(set(x.tolist()) ^ set(y.tolist()))
    sets = [shingle(text) for text in threshold_group(60)]
    for x in sets:
        for y in sets:
            bits = sum(((int(a) ^ int(b)) % 2**64).bit_count() for a, b in zip(neardup.parity_sketch(x), neardup.parity_sketch(y), strict=True))
            assert bits <= len(set(x.tolist()) ^ set(y.tolist()))


def test_components(spark):
    pick = random.Random(9)
    chain = list(range(300))
    pairs = [(a, a + 1) for a in chain[:-1]] + [(1000, 1000 + k) for k in range(1, 200)] + [(2000 + k, 2000 + (k * 7 + 3) % 50) for k in range(50)] + [(5000, 5001), (5001, 5000), (6000, 6000)]
    pick.shuffle(pairs)
    links = spark.createDataFrame([(f"{a:05}".encode(), f"{b:05}".encode()) for a, b in pairs], "a binary, b binary")
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            parent[root(a)] = root(b)
    groups, found = {}, {}
    for x in parent:
        groups.setdefault(root(x), set()).add(x)
    for r in components(links)[0].collect():
        found.setdefault(bytes(r.label), set()).add(int(bytes(r.node)))
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups.values()))
    assert components(links.limit(0))[0].count() == 0
