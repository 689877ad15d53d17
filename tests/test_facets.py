"""Facets that are kept per date against counts of the items as they are."""

from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators import facets as C
from tidemark.operators import sinks as K

KIND = "id long, kind string, tags array<string>, ai_score double"
NAMES = ("kind", "tags")


def saved(spark, path, day, rows):
    K.save_items(spark, path, spark.createDataFrame(rows, KIND), day)


def direct(spark, items):
    found = Counter()
    for r in K.read_items(spark, items, spark.createDataFrame([], KIND).schema).collect():
        for facet, values in ((C.EVERY, [None]), ("kind", [r.kind]), ("tags", sorted(set(r.tags or []), key=str))):
            for v in values:
                found[facet, v] += 1
    return found


def kept(spark, facets):
    return Counter({(name, r.value): r.n for name in (C.EVERY, *NAMES) for r in C.facet_counts(spark, facets, name).collect()})


@pytest.fixture()
def places(tmp_path):
    return f"file://{tmp_path}/items", f"file://{tmp_path}/facets"


def test_only_changed_dates_are_counted_anew(spark, places):
    items, facets = places
    schema = spark.createDataFrame([], KIND).schema
    refresh = lambda: C.refresh_facets(spark, items, schema, facets, {n: F.col(n) for n in NAMES})
    assert refresh() == set() and C.facet_counts(spark, facets).count() == 0
    saved(spark, items, "2024-01-01", [(1, "a", ["x", "y", "x"], 1.0), (2, None, None, None), (3, "b", [], 0.1)])
    saved(spark, items, "2024-01-02", [(4, "a", ["x", None], 2.5), (5, "", ["z"], 0.2)])
    saved(spark, items, "2024-01-03", [(6, "a", ["y"], 3.0)])
    assert refresh() == {"2024-01-01", "2024-01-02", "2024-01-03"} and kept(spark, facets) == direct(spark, items)
    assert refresh() == set()
    # An item moves from the first date to the third, and another of the third goes.
    saved(spark, items, "2024-01-03", [(1, "c", ["x"], 4.0)])
    before = K.slots(spark, facets)[1]
    assert refresh() == {"2024-01-01", "2024-01-03"} and kept(spark, facets) == direct(spark, items)
    after = K.slots(spark, facets)[1]
    assert {d for d in before if before[d] != after[d]} == {"2024-01-01", "2024-01-03"}
    # A date that has lost its last item loses its facets.
    saved(spark, items, "2024-01-01", [(1, "c", ["x"], 4.0)])
    assert refresh() == {"2024-01-01", "2024-01-03"} and set(K.slots(spark, facets)[1]) == {"2024-01-01", "2024-01-02"}
    assert kept(spark, facets) == direct(spark, items)
    assert {r.value: r.n for r in C.facet_counts(spark, facets, "tags", {"2024-01-02"}).collect()} == {"x": 1, None: 1, "z": 1}


def test_sums_and_sketches_add_up(spark, places):
    items, facets = places
    for day in range(1, 4):
        saved(spark, items, f"2024-01-0{day}", [(day * 1000 + k, "a" if k % 3 else "b", None, None if k % 10 == 0 else k / 10) for k in range(400)])
    C.refresh_facets(spark, items, spark.createDataFrame([], KIND).schema, facets, {n: F.col(n) for n in NAMES})
    found = {r.value: r for r in C.facet_counts(spark, facets, "kind").collect()}
    for name, test in (("a", lambda k: k % 3), ("b", lambda k: not k % 3)):
        scores = [Decimal(k) / 10 for k in range(400) if test(k) and k % 10] * 3
        n = 3 * sum(1 for k in range(400) if test(k))
        assert (found[name].n, found[name].scored, found[name].max_score) == (n, len(scores), float(max(scores)))
        assert found[name].avg_score == round(float(sum(scores)) / len(scores), 6) and abs(found[name].distinct - n) < 0.1 * n
    assert C.facet_counts(spark, facets, "kind", least=500).count() == 1


def test_an_unrefreshed_commit_is_made_up_for(spark, places, monkeypatch):
    items, facets = places
    schema = spark.createDataFrame([], KIND).schema
    saved(spark, items, "2024-01-01", [(1, "a", ["x"], 1.0)])
    C.refresh_facets(spark, items, schema, facets, {n: F.col(n) for n in NAMES})
    saved(spark, items, "2024-01-01", [(1, "b", ["x"], 1.0), (2, "b", [], None)])

    def dies(*_):
        raise RuntimeError("died")

    with monkeypatch.context() as m:
        m.setattr(K, "commit", dies)
        with pytest.raises(RuntimeError):
            C.refresh_facets(spark, items, schema, facets, {n: F.col(n) for n in NAMES})
    assert kept(spark, facets)["kind", "a"] == 1
    assert C.refresh_facets(spark, items, schema, facets, {n: F.col(n) for n in NAMES}) == {"2024-01-01"} and kept(spark, facets) == direct(spark, items)
