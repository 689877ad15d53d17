"""The pool of title candidates against all pairs."""

import difflib

import numpy as np
import pandas as pd

from tidemark.operators import linking as L

WORDS = "deep networks network transformers transformer learning for image images recognition with attention".split()


def brute(seeds, works):
    found = []
    for s, a in seeds:
        near = [(-difflib.SequenceMatcher(None, L.plain_title(a), L.plain_title(b)).ratio(), w) for w, b, gone in works if not gone and b]
        near = sorted(x for x in near if -x[0] >= L.SIMILAR)[:5]
        found += [(s, w, round(-r, 9), k + 1) for k, (r, w) in enumerate(near)]
    return sorted(found)


def test_pool_is_that_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(L, "SEED_BLOCK", 20)
    monkeypatch.setattr(L, "WORK_BLOCK", 30)
    titles = ["U-Net", "UNet", "u net", "transformers", "Transformer", "Transformérs", "GPT", "GPT-2", "a", "é", "word2vec", "word 2 vec"]
    titles += [" ".join(WORDS[(k * j + j) % len(WORDS)] for j in range(1, 2 + k % 12)) for k in range(60)]
    titles += ["On " + "very " * 20 + "long titles", "On " + "very " * 21 + "long title"]
    works = [(k, t, k % 17 == 16) for k, t in enumerate(titles + titles[4:8] * 3)] + [(900, None, False)]
    seeds = list(enumerate([*titles, "Unets", "image attentions"]))
    pool = L.candidate_pool(spark.createDataFrame(seeds, "seed_id long, title string"), spark.createDataFrame(works, "work_id long, title string, is_retracted boolean"))
    found = sorted((r.seed_id, r.work_id, round(r.similarity, 9), r.place) for r in pool.collect())
    wanted = brute([x for x in seeds if L.plain_title(x[1])], [w for w in works if w[1] is None or L.plain_title(w[1])])
    assert (0, 1) in {x[:2] for x in found} and found == wanted


def test_pool_of_many_similar_titles(spark, monkeypatch):
    """Hundreds of titles near one seed, ties among them and titles that several works bear; no cell gives more than its best."""
    monkeypatch.setattr(L, "WORK_BLOCK", 40)
    monkeypatch.setattr(L, "TITLE_BLOCK", 8)
    base = "deep residual learning for image recognition at scale"
    titles = [base[:k] + c + base[k + 1 :] for k in range(0, 50, 2) for c in "xyz"] + [base[:k] + base[k + 2 :] for k in range(0, 50, 3)] + [base] * 3
    works = [((37 * k) % 1009, t, k % 29 == 28) for k, t in enumerate(titles * 2)]
    seeds = [(1, base), (2, base + "s"), (3, base.replace("deep", "dep")), (4, "x" * 300 + " " + base)]
    columns = "work_id long, title string, is_retracted boolean"
    pool = L.candidate_pool(spark.createDataFrame(seeds, "seed_id long, title string"), spark.createDataFrame(works, columns))
    assert sorted((r.seed_id, r.work_id, round(r.similarity, 9), r.place) for r in pool.collect()) == brute(seeds, works)
    near = L._nearest_in_cell(pd.DataFrame({"plain": [base]}), pd.DataFrame({"plain": sorted(set(titles)), "first_id": range(len(set(titles)))}))
    assert len(near) == L.MOST_CANDIDATES


def test_abstracts_are_rebuilt_row_by_row(spark, tmp_path):
    """As its SQL, empty and missing texts and repeated ids too; no words are shuffled."""
    import duckdb

    from tidemark import registry

    texts = ["the cat and the dog and the cat", " two  spaces ", "", None, "   ", "one", "é z é a\nb a", " ".join(f"w{k % 700}" for k in range(5000))]
    spark.createDataFrame([*enumerate(texts), (5, "again one")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.queries()["p9_reconstruct_abstract"](spark, str(tmp_path))
    documents = duckdb.connect()
    documents.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    wanted = documents.execute(registry.oracle_sql()["p9_reconstruct_abstract"]).fetchall()
    assert sorted(map(tuple, found.collect()), key=str) == sorted(wanted, key=str)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_seeds_share_passes_over_a_cell(spark, monkeypatch):
    """Short and long titles and many of one character, as all pairs give; many seeds take one pass for their subsequences."""
    calls, real = [], L._common_lengths
    monkeypatch.setattr(L, "_common_lengths", lambda *a: calls.append(len(a[0])) or real(*a))
    base = [" ".join(WORDS[(k * j + j * j) % len(WORDS)] for j in range(1, 2 + k % 7))[: 20 + k % 60] for k in range(150)]
    base += ["a" * k for k in (1, 2, 15, 16, 17, 18, 40, 63, 64, 65, 66)] + ["z" * 30 + "q" * 270, "z" * 31 + "q" * 268, "x" * 300, "0"]
    works = pd.DataFrame({"plain": list(dict.fromkeys(base))})
    works["first_id"] = range(len(works))
    seeds = pd.DataFrame({"plain": sorted({x[:-1] + "s" for x in base} | set(base))})
    found = L._nearest_in_cell(seeds, works)
    wanted = []
    for a in seeds["plain"]:
        near = [(-difflib.SequenceMatcher(None, a, b).ratio(), i, b) for b, i in zip(works["plain"], works["first_id"], strict=True)]
        wanted += [(a, b, -r, i) for r, i, b in sorted(x for x in near if -x[0] >= L.SIMILAR)[:5]]
    assert sorted(map(tuple, found.to_numpy().tolist())) == sorted(wanted)
    assert max(calls) > 20 and len(calls) < len(seeds) / 4


def test_few_titles_are_compared_by_subsequence(spark, monkeypatch):
    """Titles of one language, which have their letters in common: sketches leave few of the pairs, and none of the similar ones is lost."""
    pairs, real = [], L._common_lengths
    monkeypatch.setattr(L, "_common_lengths", lambda seeds, of, codes: pairs.append(len(of)) or real(seeds, of, codes))
    random = np.random.default_rng(4)
    parts = "the an ed th ou is on en er re nd ha at in es or ti to it st ea hi ng le".split()
    titles = [" ".join("".join(random.choice(parts, 1 + k % 3)) for k in range(14))[:60].strip() for _ in range(3000)]
    near = []
    for t in titles[:120]:
        places = random.choice(len(t), random.integers(1, 12), replace=False)
        near.append(L.plain_title("".join(("", c + "q", "x", c)[random.integers(4)] if k in places else c for k, c in enumerate(t))))
    works = pd.DataFrame({"plain": list(dict.fromkeys([*titles, *near[:60]]))})
    works["first_id"] = range(len(works))
    seeds = pd.DataFrame({"plain": sorted({*titles[60:180], *near[30:], titles[0] + "s"})})
    found, wanted = L._nearest_in_cell(seeds, works), []
    for a in seeds["plain"]:
        close = [(-difflib.SequenceMatcher(None, a, b).ratio(), i, b) for b, i in zip(works["plain"], works["first_id"], strict=True) if difflib.SequenceMatcher(None, a, b).quick_ratio() >= L.SIMILAR]
        wanted += [(a, b, -r, i) for r, i, b in sorted(x for x in close if -x[0] >= L.SIMILAR)[:5]]
    assert len(wanted) > len(seeds) and sorted(map(tuple, found.to_numpy().tolist())) == sorted(wanted)
    assert sum(pairs) < 0.03 * len(seeds) * len(works)


def test_sketches_never_differ_more_than_titles():
    random = np.random.default_rng(5)
    titles = ["".join(random.choice(list("aabbbcde 12"), random.integers(1, 90))) for _ in range(200)]
    counts = np.array([[t.count(c) for t in titles] for c in "abcde 12"])
    first, bits = np.full(128, 63), np.ones(128, dtype=int)
    codes = [ord(c) for c in "abcde 12"]
    first[codes], bits[codes] = L._sketch_bits(counts)
    cut = L._cut_sketches(titles, first, bits)
    for n, a in enumerate(titles):
        for m, b in enumerate(titles[:20]):
            for i, j in ((len(a), len(b)), (len(a) // 2, len(b) // 3)):
                outside = lambda x, y: sum(abs(x.count(c) - y.count(c)) for c in "abcde 12")
                assert np.bitwise_count(cut[n][0][i] ^ cut[m][0][j]) <= outside(a[:i], b[:j])
                assert np.bitwise_count(cut[n][1][i] ^ cut[m][1][j]) <= outside(a[i:], b[j:])


def test_ratio_is_that_of_the_matcher():
    random = np.random.default_rng(6)
    for k in range(3000):
        a, b = ("".join(random.choice(list("abc "), random.integers(0, 30 if k % 100 else 250))) for _ in "ab")
        ratio = difflib.SequenceMatcher(None, a, b).ratio()
        assert L._ratio(a, b) == ratio and L._ratio(a, b, 0.7) in ({ratio} if ratio >= 0.7 else {ratio, 0.0})


def _plan(spark, name, folder):
    from tidemark import registry

    rows = [(k, f"a title about {WORDS[k % 12]} and {WORDS[k * 7 % 11]} in part {k // 30}") for k in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return registry.queries()[name](spark, str(folder))._jdf.queryExecution().optimizedPlan().toString()


def test_seeds_reach_python_by_the_batch(spark, tmp_path):
    plan = _plan(spark, "p7_collapse_same_work", tmp_path)
    assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan


def test_titles_are_normalised_once(spark, tmp_path):
    """What follows reads the written titles, no more the documents."""
    assert "doc_id" not in _plan(spark, "p5_candidate_pool", tmp_path)
