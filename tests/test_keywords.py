"""Keywords of texts, natively and by automaton, against plain containment."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import subjects as S


@pytest.mark.parametrize("few", [0, 100])
def test_hits_are_those_of_plain_containment(spark, monkeypatch, few):
    monkeypatch.setattr(S, "FEW_KEYWORDS", few)
    rng = random.Random(3)
    keywords = ["a", "ab", "abc", "bc", "c a", "é", "模型", "", "ab", *("".join(rng.choice("abc ") for _ in range(rng.randrange(1, 6))) + "x" for _ in range(40))]
    texts = [None, "", "ABC", "É 模型 x", *("".join(rng.choice("abcABC x") for _ in range(rng.randrange(60))) for _ in range(80)), "abc " * 20_000]
    found = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", S.keyword_hits(F.col("text"), keywords).alias("hits")).collect()
    assert len(found) == len(texts)
    for r in found:
        assert sorted(r.hits) == sorted({k for k in keywords if k and texts[r.id] is not None and k in texts[r.id].lower()}), texts[r.id]
    assert spark.range(1).select(S.keyword_hits(F.lit("a"), []).alias("h")).first().h == []


def test_topics_and_filters_are_alike_both_ways(spark, monkeypatch):
    rows = [(k, t, a, c) for k, (t, a, c) in enumerate([("Deep Learning of agents", None, ["cs.CL", "cs.CV"]), ("An image", "language model, LLM", []), (None, None, []), ("Neural network", "deep learning", ["Topic Modeling"])])]
    papers = spark.createDataFrame(rows, "id int, title string, abstract string, categories array<string>")
    told = []
    for few in (0, 100):
        monkeypatch.setattr(S, "FEW_KEYWORDS", few)
        topics = sorted((r.id, r.slug, r.confidence, r.reason) for r in S.paper_topics(papers).collect())
        kept = sorted(r.id for r in S.filter_by_keywords(papers, ["LLM", "Agents"], ["title", "abstract"]).collect())
        told.append((topics, kept, S.filter_by_keywords(papers, ["nothing such"], ["title"]).count(), S.filter_by_keywords(papers, [], ["title"]).count()))
    assert told[0] == told[1] and told[0][1:] == ([0, 1], 4, 4)
    assert (3, "deep-learning", 0.7, "keyword: deep learning") in told[0][0] and (2, "other", 0.5, "no topic matched") in told[0][0]
    assert (0, "nlp-llm", 0.85, "arXiv category: cs.CL") in told[0][0] and (1, "nlp-llm", 0.7, "keyword: language model") in told[0][0]
