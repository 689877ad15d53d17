"""Event groups of equal texts, null texts among them."""

import random
from collections import Counter

import duckdb
import pytest

from tidemark import registry
from tidemark.operators import merging as M


def test_null_texts_are_no_event(spark, tmp_path):
    rows = [(k, None if k % 4 == 0 else "" if k % 7 == 0 else f"t{k % 5}" if k < 20 else f"alone {k}", "s") for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("d8_event_survivors", "d8_event_coverage"):
        found, wanted = registry.queries()[name](spark, str(tmp_path)), duck.sql(registry.oracle_sql()[name])
        assert found.columns == wanted.columns
        assert Counter(map(tuple, found.collect())) == Counter(wanted.fetchall())


def test_groups_as_rows(spark):
    items = spark.createDataFrame([(k,) for k in range(5)], "pos long")
    arrays = spark.createDataFrame([("g", [3, 1, 9]), ("h", [9, 2])], "group_id string, members array<long>")
    rows = spark.createDataFrame([("g", 3, 0, 3), ("g", 3, 1, 1), ("g", 3, 2, 9), ("h", 9, 0, 9), ("h", 9, 1, 2)], "group_id string, primary_pos long, at int, pos long")
    made = [[sorted(map(tuple, f.collect())) for f in M.merge_event_groups(items, g)] for g in (arrays, rows)]
    assert made[0] == made[1] == [[(0,), (2,), (3,), (4,)], [("g", 3, 1)]]


ITEMS = [
    (0, "base", "web", ["a", "b"], "x"), (1, "more", "feed", ["b", "c"], "x"), (2, "base", "web", None, "x"), (3, None, "web", [], "x"), (4, "", "feed", ["d"], "x"),
    (5, "late", None, None, "x"), (6, "more and more", "feed", ["e"] * 2, "x"), (7, "alone", "web", ["z"], "x"), (8, None, "web", None, "x"), (9, "more", "web", [f"p{k}" for k in range(30)], "x"),
]
GROUPS = [(1, [0, 6, 1, 2, 1, 99]), (2, [3, 4, 5]), (3, [0, 9]), (4, [77, 7]), (5, [8]), (6, []), (7, None)]
SCHEMA = "pos long, content string, source_type string, images array<string>, primary_pos string"


def merged_one_by_one(items, groups):
    rows, gone, facts = {r[0]: [r[1], list(r[3] or [])] for r in items}, set(), {}
    kind = {r[0]: r[2] for r in items}
    for group, members in sorted(groups, key=lambda g: g[0]):
        if len(members or []) < 2 or members[0] not in rows:
            continue
        head = rows[members[0]]
        facts.setdefault(members[0], []).append(f"fact {group}")
        for m in members[1:]:
            if m not in rows or m == members[0]:
                continue
            own, images = rows[m]
            if own and own not in (head[0] or ""):
                head[0] = f"{head[0] or ''}\n\n--- From {kind[m] or 'unknown'} ---\n{own}"
            for image in images:
                if image not in head[1] and len(head[1]) < 20:
                    head[1].append(image)
            gone.add(m)
    return sorted((k, v[0], v[1], facts.get(k)) for k, v in rows.items() if k not in gone)


def test_events_are_folded_into_their_primary(spark):
    items, groups = spark.createDataFrame(ITEMS, SCHEMA), spark.createDataFrame(GROUPS, "group_id long, members array<long>")
    facts = spark.createDataFrame([(g, [f"fact {g}"]) for g, _ in GROUPS] + [(50, None)], "group_id long, facts array<string>")
    found = M.merge_events(items, groups, facts)
    assert found.columns == [*items.columns, "merged_facts"]
    got = sorted((r["pos"], r["content"], r["images"] or [], r["merged_facts"]) for r in found.collect())
    assert got == merged_one_by_one(ITEMS, GROUPS)
    assert {r["primary_pos"] for r in found.collect()} == {"x"}
    assert M.merge_events(items.limit(0), groups, facts).count() == 0
    assert M.merge_events(items.drop("images"), groups.limit(0)).count() == len(ITEMS)


def test_event_sources(spark):
    rows = [(0, "https://example.com/1"), (1, "https://arxiv.org/abs/1"), (2, "https://www.arxiv.org/abs/2"), (3, None), (4, "https://openai.com/x")]
    items = spark.createDataFrame([(p, u, f"t{p}", "web", f"l{p}") for p, u in rows], "pos long, url string, title string, source_type string, label string")
    groups = spark.createDataFrame([(1, [0, 1, 2, 3]), (2, [3, 0]), (3, [0, 4])], "group_id long, members array<long>")
    primary = lambda answers=None: {(r["group_id"], r["pos"]) for r in M.event_sources(items, groups, answers).collect() if r["is_primary"]}
    assert primary() == {(1, 1), (2, 3), (3, 4)}
    said = spark.createDataFrame([(0, "https://example.com/1", "official_company_blog"), (0, "https://arxiv.org/abs/1", "social_post")], "primary_pos long, url string, role string")
    assert primary(said) == {(1, 0), (2, 3), (3, 0)}
    assert M.event_sources(items, groups).count() == 8 and M.event_sources(items.limit(0), groups).count() == 0


def similar_sets(rows, percent):
    """Pairs of class representatives by comparing all."""
    reps = {}
    for i, tokens in rows:
        if tokens:
            reps[frozenset(tokens)] = min(i, reps.get(frozenset(tokens), i))
    known = sorted((i, t) for t, i in reps.items())
    return sorted((a, b, len(x & y), len(x | y)) for k, (a, x) in enumerate(known) for b, y in known[k + 1 :] if 100 * len(x & y) >= percent * len(x | y))


@pytest.mark.parametrize(("percent", "hot"), [(50, 64), (50, 3), (75, 5), (30, 2)])
def test_event_candidates_are_those_of_all_pairs(spark, percent, hot):
    pick = random.Random(percent + hot)
    rows = [(k, [f"t{min(int(pick.expovariate(0.15)), 60)}" for _ in range(pick.choice([1, 2, 3, 5, 8, 13]))]) for k in range(400)]
    rows += [(900, None), (901, []), (902, [f"t{k}" for k in range(90)]), (903, [f"t{k}" for k in range(80)] + ["x"]), (904, ["t1", "t1"])]
    pairs, members = M.event_candidates(spark.createDataFrame(rows, "id long, tokens array<string>"), percent, hot)
    assert sorted(map(tuple, pairs.collect())) == similar_sets(rows, percent)
    assert members.count() == sum(bool(t) for _, t in rows)


def test_hot_tokens_meet_in_pairs(spark, monkeypatch):
    """Half of all titles share their early tokens: what meets grows as the titles do."""
    met = []
    keys = M._meeting_keys

    def counted(*args):
        smaller, larger = keys(*args)
        met.append(smaller.select("class", "key").join(larger.select("class", "key"), ["class", "key"]).count())
        return smaller, larger

    monkeypatch.setattr(M, "_meeting_keys", counted)
    for n in (1000, 2000):
        pick, rows = random.Random(n), []
        for k in range(n):
            head = ["breaking", "news", "live"] if k % 2 else []
            rows.append((k, head + [f"w{pick.randrange(n)}" for _ in range(5)]))
        pairs, _ = M.event_candidates(spark.createDataFrame(rows, "id long, tokens array<string>"), 50)
        assert sorted(map(tuple, pairs.collect())) == similar_sets(rows, 50)
    assert met[1] < 2.6 * met[0] and met[1] < 100 * 2000
