"""The pipeline against its stages done plainly."""

import collections

import corpus_pipeline as P
from tests.llm.test_neardup import brute
from tidemark.llm.packing import Encoder, default_tokenizer
from tidemark.llm.pii import Pseudonyms
from tidemark.llm.toxicity import Grammar, fit


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.limit(120)
    extra = rows.limit(1).selectExpr("900001L doc_id", "cast(null as string) text", "cast(null as string) lang", "cast(null as string) source", "cast(null as long) n_chars")
    docs = spark.createDataFrame(rows.union(rows.limit(5)).union(extra).collect(), docs.schema)
    before = docs.collect()
    grammar = Grammar(fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    clean = P.drop_toxic(spark, docs, sf_dir).collect()
    assert collections.Counter(clean) == collections.Counter(r for r in before if grammar.score(grammar.raw(r.text)) < P.TOXIC_FROM)
    docs = spark.createDataFrame(clean, docs.schema)
    kept = P.drop_near_duplicates(spark, docs, sf_dir).collect()
    wanted = {i for i, n, c in brute([(r.doc_id, r.text) for r in clean]) if i == c}
    assert sorted(r.doc_id for r in kept) == sorted(wanted)
    spark.conf.set(P.KEY_SETTING, "a key of the test")
    named = P.pseudonymise(spark, spark.createDataFrame(kept, docs.schema), sf_dir).collect()
    spark.conf.unset(P.KEY_SETTING)
    names = Pseudonyms(b"a key of the test")
    assert {r.doc_id: r.text for r in named} == {r.doc_id: r.text and names.replace(r.text)[0] for r in kept}
    mixed = P.mix_sources(spark, spark.createDataFrame(named, docs.schema), sf_dir).collect()
    words = lambda rows: sum(len((r.text or "").encode().split()) for r in rows)
    assert abs(words(mixed) - words(named)) < 0.3 * words(named) and set(mixed) <= set(named)
    assert max(collections.Counter(r.doc_id for r in mixed).values()) <= 3
    packed = P.pack_sequences(spark, spark.createDataFrame(mixed, docs.schema), sf_dir).collect()
    encode, tokens, filled = Encoder(default_tokenizer()), collections.Counter(), collections.defaultdict(list)
    for r in packed:
        tokens[r.doc_id] += r.length
        filled[r.sequence_id].append((r.offset, r.length))
    assert tokens == sum((collections.Counter({r.doc_id: len(encode(r.text or "")) // 4 + 1}) for r in mixed), collections.Counter())
    for spots in filled.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(spots), [*sorted(spots)[1:], (sum(n for _, n in spots), 0)], strict=True)) and sum(n for _, n in spots) <= 1024


def test_without_a_key_each_run_has_its_own(spark):
    assert P.pseudonym_key(spark) != P.pseudonym_key(spark)


def test_awkward_and_empty_documents(spark, sf_dir):
    rows = [(1, "some words here", None, None, None, "x", 1), (1, "some words here", None, None, None, "x", 1), (None, "other words there", "en", "src0", 5, None, None), (2, None, "en", "src0", 5, "x", 1), (3, "", "en", "src0", 0, "x", 1), (4, "long " * 50_000, "en", "src1", 9, "x", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, part string, size int"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in P.STAGES:
            docs = stage(spark, docs, sf_dir)
            assert docs.columns == P.COLUMNS or name == "packing", name
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.count() >= 0
