"""Classifiers: held-out accuracy on the given labels, awkward rows, and the grammar clause by clause."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from tidemark.llm import quality as Q
from tidemark.llm import toxicity as X
from tidemark.llm.labelled import sample

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("label", T.StringType()), T.StructField("score", T.StringType())])
DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("judge", "column", "modulus", "rest", "least"), [(Q.quality, "quality", 5, 0, 0.95), (X.toxicity, "toxic", 3, 1, 0.93)])
def test_held_out_accuracy(spark, judge, column, modulus, rest, least):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    found = {r.doc_id: r for r in judge(docs, labels).collect()}
    assert len(found) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) and 0 <= r.score <= 1 for r in found.values())
    held = [(found[r.doc_id].predicted, r[column]) for r in labels.collect() if found[r.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) >= least


def test_awkward_rows(spark):
    rows = [(1, None, "x", "x"), (2, "", "x", "x"), (None, "some text", None, "x"), (3, "you idiot. " * 20_000, "x", "x"), (4, "same", "x", "x"), (4, "same", "x", "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(1, 0, 0), (3, None, 1), (4, 1, None), (4, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for judge in (Q.quality, X.toxicity):
        for known in (labels, none):
            found = judge(docs, known).collect()
            assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in found)
        assert judge(docs.limit(0), labels).count() == 0
    assert next(r for r in X.toxicity(docs, none).collect() if r.doc_id == 3).predicted == 1


def test_grammar():
    grammar = X.Grammar(X.Lexicon(frozenset({"^gruf"}), frozenset({"meh"})))
    raw = grammar.raw
    assert raw("a kind word") == raw(None) == raw("") == 0
    bare = X.INSULT["I"]
    assert raw("idiot") == raw("GRUFFLE!") == bare and raw("meh") == X.INSULT["i"]
    assert raw("not an idiot") < raw("the idiot") < raw("you idiot") < raw("you are an idiot") == raw("you are such an idiot")
    assert raw("she said idiot") < raw("she left. idiot") and raw("not. idiot") == bare
    assert raw("idiot as you all like") == bare + X.TARGETED["I"] and raw("he is an idiot") == bare + X.PREDICATED["I"]
    assert raw("kill time") == raw("did you crush the garlic") == raw("you beat them 3-0") == 0 and raw("I will kill you") == X.THREAT
    assert raw("never kill you") == raw("I will never kill you") == raw("he said I will kill you") == 0


def test_marks_do_not_end_clauses():
    """Reported speech, negation and targets reach over commas, colons and quotation marks, but not over the end of a sentence."""
    raw = X.Grammar(X.Lexicon(frozenset(), frozenset())).raw
    plain = raw("you are an idiot")
    for text in ("he said you are an idiot", "he said: you are an idiot", "he said, you are an idiot", 'he said: "you are an idiot"', "he said, “you are an idiot”"):
        assert raw(text) < plain, text
    assert raw("he said nothing. you are an idiot") == raw("he said!\nyou are an idiot") == plain
    assert raw("not, an idiot") == raw("not an idiot") < raw("idiot") and raw("not; an idiot") == raw("idiot")
    assert raw("I will kill, you") == raw("I will kill you") > 0 and raw("I will kill. you") == 0


def test_bare_words_weigh_little():
    """Without labels a bare word stays below the threshold, an address or a threat reaches it."""
    grammar = X.Grammar(X.Lexicon(frozenset(), frozenset()))
    for text in ("the pig farm", "a trash can", "the fool in King Lear", "did you crush the garlic", "you beat them 3-0", "burn the letter before you leave"):
        assert grammar.score(grammar.raw(text)) < 0.5, text
    for text in ("you are an idiot", "I will kill you", "we are going to hurt you"):
        assert grammar.score(grammar.raw(text)) >= 0.7, text


def written(machine, signs):
    """Every path of one transducer: (what it writes, its weight)."""
    paths = [(machine.start, "", 0.0)]
    for sign in signs:
        paths = [(target, text + wrote, total + weight) for state, text, total in paths for wrote, weight, target in machine.arcs.get((state, sign), ())]
    return {(text, round(total, 9)) for state, text, total in paths if state in machine.final}


def test_clause_weights_equal_path_enumeration():
    pick = random.Random(6)
    for _ in range(300):
        signs = "".join(pick.choice("IiVTNRAP....") for _ in range(pick.randint(0, 14)))
        paths = {(signs, 0.0)}
        for machine in X.machines():
            paths = {(text, round(total + more, 9)) for before, total in paths for text, more in written(machine, before)}
        assert abs(X.clause_weight(signs) - max(total for _, total in paths)) < 1e-9, signs


def test_scores_are_summed_clauses():
    """A text's score from the enumeration of its clauses, word by word, against the query's function."""
    lexicon = X.Lexicon(frozenset({"gruf"}), frozenset({"meh"}), (-2.0, 3.0))
    grammar, kinds = X.Grammar(lexicon), {"gruf": "I", "meh": "i", "you": "T", "not": "N", "said": "R", "kill": "V", "lamp": ".", "we": "A", "such": "P"}
    pick = random.Random(8)
    for _ in range(200):
        clauses = [[pick.choice(list(kinds)) for _ in range(pick.randint(0, 8))] for _ in range(pick.randint(0, 5))]
        total = 0.0
        for clause in clauses:
            paths = {("".join(kinds[w] for w in clause), 0.0)}
            for machine in X.machines():
                paths = {(text, x + more) for before, x in paths for text, more in written(machine, before)}
            total += max(x for _, x in paths)
        text = pick.choice([". ", "\n", "; "]).join(map(" ".join, clauses))
        assert abs(grammar.raw(text) - total) < 1e-6
        assert abs(grammar.score(grammar.raw(text)) - 1 / (1 + np.exp(2 - 3 * np.log1p(total)))) < 1e-6


def test_pool_and_chunks():
    ids, vectors = np.arange(50) % 7, np.random.default_rng(0).normal(size=(Q.BUCKETS, Q.DIM))
    assert np.allclose(Q.pool(ids, vectors)[: Q.DIM], vectors[ids].mean(axis=0), atol=1e-5)
    old, Q.CHUNK = Q.CHUNK, 9
    try:
        small = Q.pool(ids, vectors)
    finally:
        Q.CHUNK = old
    assert np.allclose(small, Q.pool(ids, vectors), atol=1e-4)


def test_pooled_scores_equal_a_plain_network():
    """Scores against features and layers written out one number at a time."""
    draw = np.random.default_rng(3)
    x = draw.normal(size=(300, Q.FEATURES))
    network = Q.train(x, (x[:, 0] + x[:, 3] > 0).astype(float))
    for row, score in zip(x[:20], network.scores(x[:20]), strict=True):
        z = [(row[k] - network.centre[k]) / network.scale[k] for k in range(Q.FEATURES)] + [1.0]
        hidden = [np.tanh(sum(z[k] * network.first[k, h] for k in range(len(z)))) for h in range(Q.HIDDEN)] + [1.0]
        logit = sum(hidden[h] * network.second[h] for h in range(len(hidden))) / network.temperature
        assert abs(score - 1 / (1 + np.exp(-logit))) < 1e-9
    ids, vectors = draw.integers(0, 50, 40), draw.normal(size=(Q.BUCKETS, Q.DIM)).astype(np.float32)
    found, rows = Q.pool(ids, vectors), [vectors[k].astype(float) for k in ids]
    mean = sum(rows) / 40
    spread = [np.sqrt(sum((r[d] - mean[d]) ** 2 for r in rows) / 40) for d in range(Q.DIM)]
    alike = sum(float(a @ b) for a, b in zip(rows[:-1], rows[1:], strict=True)) / 40
    same = sum(a == b for a, b in zip(ids[:-1], ids[1:], strict=True)) / 40
    assert np.allclose(found, [*mean, *spread, alike, same, len(set(ids.tolist())) / 40, np.log1p(40)], atol=1e-4)


def test_samples_are_bounded_in_rows(spark):
    docs = spark.createDataFrame([(k % 40, f"text {k}") for k in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(40)], "doc_id long, quality int")
    found = [r.doc_id for r in sample(docs, labels, "quality", 5, 0, rows=10).collect()]
    assert len(found) == len(set(found)) == 10


def looped(texts):
    """Counts and context sums by bucket, token by token."""
    tokens, index = Q.Tokens(), Q.index_vectors().astype(np.int64)
    n, sums = {}, {}
    for text in texts:
        ids = tokens(text).tolist()
        for at, own in enumerate(ids):
            n[own] = n.get(own, 0) + 1
            for near in range(max(0, at - Q.WINDOW), min(len(ids), at + Q.WINDOW + 1)):
                sums.setdefault(own, np.zeros(Q.DIM, np.int64))
                if near != at:
                    sums[own] += index[ids[near]]
    return n, sums


def context_texts():
    rng = random.Random(11)
    words = [f"w{k}" if k % 3 else "abc"[k % 2 :] + "é" * (k % 4) for k in range(30)]
    return [None, "", "one", "a, b; c 12", "same same same", *(" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(60))]


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 100_000])
def test_context_sums_equal_a_double_loop(monkeypatch, chunk):
    """Documents do not reach into one another, and pieces of a chunk lose no neighbour at their borders."""
    monkeypatch.setattr(Q, "CHUNK", chunk)
    texts = context_texts()
    n, sums = looped(texts)
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[at : at + 9], pa.string())], ["text"]) for at in range(0, len(texts), 9)]
    found = pa.Table.from_batches(Q._contexts(iter(batches))).to_pylist()
    assert {r["bucket"]: r["n"] for r in found} == n
    for r in found:
        assert [r[f"d{k}"] for k in range(Q.DIM)] == sums[r["bucket"]].tolist()


def test_word_vectors_equal_a_double_loop(spark):
    texts = context_texts()
    n, sums = looped(texts)
    wanted, total = np.zeros((Q.BUCKETS, Q.DIM)), sum(n.values())
    for b in n:
        wanted[b] = sums[b] / n[b]
    centre = sum(wanted[b] * n[b] for b in n) / total
    for b in n:
        wanted[b] -= centre
        wanted[b] /= max(np.sqrt((wanted[b] ** 2).sum()), 1e-9)
    docs = spark.createDataFrame([(t, "x") for t in texts], "text string, bucket string").repartition(3)
    assert np.allclose(Q.word_vectors(docs), wanted, atol=1e-5)
    assert not Q.word_vectors(docs.limit(0)).any()
