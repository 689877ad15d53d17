"""Golden cases: ties, falsy values, order-dependent folds, fallbacks."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import html as H
from tidemark.functions import text as T
from tidemark.functions import urls as U
from tidemark.operators import linking as L
from tidemark.operators import merging as M
from tidemark.operators import reads as R
from tidemark.operators import scoring as S
from tidemark.operators import sinks as K


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("http://WWW.Example.com/A/b/", "example.com/A/b"),
        ("https://example.com/a#top", "example.com/a"),
        ("https://example.com/a?b=2&a=1", "example.com/a?a=1&b=2"),
        ("https://example.com/a?UTM_Source=x&a=", "example.com/a"),
        ("https://example.com/a?q=x%20y+z", "example.com/a?q=x y z"),
        ("https://u:p@example.com:8080//", "example.com"),
        ("https://mp.weixin.qq.com/s?__biz=1&sn=2&from=x", "mp.weixin.qq.com/s?__biz=1&sn=2"),
    ],
)
def test_url_keys(spark, url, key):
    made = spark.createDataFrame([(url,)], "url string").select(U.normalize_url(F.col("url"))).first()[0]
    assert made == key
    again = spark.createDataFrame([("https://" + key.replace(" ", "%20"),)], "url string").select(U.normalize_url(F.col("url"))).first()[0]
    assert again == key


def test_gates_and_roles(spark):
    rows = spark.createDataFrame([(1, "https://gist.github.com/x"), (2, "https://example.com/a.PDF"), (3, "https://openai.com/x"), (4, "https://ai.meta.com/blog/x"), (5, "not a url"), (6, None)], "pos int, url string")
    found = {r.pos: (r.reason, r.role) for r in U.with_role(rows).withColumn("reason", U.skip_reason(F.col("url"))).collect()}
    assert found == {1: ("skip_domain:github.com", "unknown"), 2: ("skip_extension:.pdf", "unknown"), 3: (None, "official_company_blog"), 4: (None, "official_company_blog"), 5: (None, "unknown"), 6: (None, "unknown")}


def scored(spark, *rows):
    return spark.createDataFrame([(k, k, *r) for k, r in enumerate(rows)], "id int, pos int, ai_score double, category string")


def test_backfill_skips_null_and_zero(spark):
    items = scored(spark, (None, "a"), (0.0, "a"), (7.0, "a"), (6.0, "a"), (6.0, "b"), (9.0, "a"))
    ids = lambda f: sorted(r.id for r in f.collect())
    assert ids(S.threshold_with_backfill(items, 7.0, 3)) == [2, 3, 5]
    assert ids(S.threshold_with_backfill(items, 7.0, 9)) == [2, 3, 4, 5]
    assert ids(S.threshold_with_backfill(items, 7.0, 1)) == [2, 5]
    assert ids(S.threshold_with_backfill(items, 7.0, None)) == [2, 5]


def test_quota_order(spark):
    items = scored(spark, (7.0, "ai"), (6.0, "finance"), (9.5, "world"), (9.0, "ml"), (8.5, "finance"), (8.0, "ai"), (5.0, None))
    quotas = S.Quotas({"ai": S.Group(["ai", "ml"], 2), "finance": S.Group(["finance", "ai"], 1)}, "other", 1)
    assert [r.id for r in S.balanced_digest(items, quotas).orderBy(F.desc("ai_score")).collect()] == [2, 3, 4, 5]
    assert S.balanced_digest(items, S.Quotas()).count() == 7
    clash = S.Quotas({"other": S.Group(["x"], 2)}, "other", 0)
    assert S.balanced_digest(items, clash).count() == 2


def test_content_fold_promotes_and_appends(spark):
    rows = [
        (0, "p", "http://a.org/x", "web", "long primary content", None, "failed"),
        (1, "q", "http://www.a.org/x/", "feed", "early", None, None),
        (2, "r", "http://a.org/x?utm_source=f", "hn", "later", "extracted", "success"),
        (3, "s", "http://a.org/x#y", "hn", "early", "other", "success"),
        (4, "t", "http://b.org", "web", None, None, None),
    ]
    items = spark.createDataFrame(rows, "pos int, id string, url string, source_type string, content string, raw_content string, extraction_status string")
    found = {r.key: r for r in M.merge_url_duplicates(items).collect()}
    assert found["a.org/x"].content == "extracted\n\n--- From hn ---\nlater\n\n--- From hn ---\nearly"
    assert (found["a.org/x"].id, found["a.org/x"].n_items, found["b.org"].content) == ("p", 4, None)


def test_metadata_fold(spark):
    rows = [("k", 0, False, "a", "x"), ("k", 1, True, "a", ""), ("k", 2, False, "a", "y"), ("k", 0, False, "b", ""), ("k", 1, True, "b", ""), ("k", 2, False, "b", None), ("k", 1, True, "c", "own"), ("k", 0, False, "c", "z")]
    found = {r["name"]: r["value"] for r in M.merge_metadata(spark.createDataFrame(rows, "key string, pos int, is_primary boolean, name string, value string")).collect()}
    assert found == {"a": "x", "b": None, "c": "own"}


def test_search_is_literal_and_folds_ascii_only(spark):
    rows = spark.createDataFrame([(1, "100% É"), (2, "100 é"), (3, "a_b\\c"), (4, "axb")], "id int, title string")
    ids = lambda c: sorted(r.id for r in rows.filter(c).collect())
    assert ids(R.matches("%", "title")) == [1] and ids(R.matches("É", "title")) == [1] and ids(R.matches("A_B\\", "title")) == [3]
    assert ids(R.like("A_B", "title")) == [3, 4]
    assert R.fulltext(rows, "ab", "title").count() == 0


def test_cleaning():
    body = "Real text with enough words to stay in place. " * 6
    assert T.clean_text(f"My Title!\n\n{body}\nRead more at x.org\n\n\n\nEnd. Subscribe to our newsletter.\n— Site Name", "my title") == f"{body.strip()}\n\nEnd."
    assert T.clean_text("Subscribe now.\nSign up today.") == "Subscribe now.\nSign up today."
    assert T.clean_text(None) == T.clean_text(" ") == ""
    assert T.clean_text("I&#x27;m here") == "I'm here"
    assert T.fill("#{a?limit=5&split=,} #{b}", {"a": "xx,yyy,z"}) == "xx #{b}"
    assert T.flatten("<details><summary>S</summary>\na\nb\n</details> [x](http://a.org/(b)) [y](javascript:1)") == "- S\n  - a\n  - b [x](http://a.org/(b)) y"


def test_model_json(spark):
    said = ['{"a": 1}', '```json\n{"a": 2}\n```', '```\n{"a": 3}\n```', 'Well: {"a": "}{"} done', "{broken", "none", None]
    rows = spark.createDataFrame([(k, s) for k, s in enumerate(said)], "id int, s string")
    assert [r[0] for r in rows.orderBy("id").select(T.parse_model_json(F.col("s"))).collect()] == ['{"a": 1}', '{"a": 2}', '{"a": 3}', '{"a": "}{"}', None, None, None]


def test_html():
    page = '<html><body><nav>n</nav><article><h1>Head</h1><p>One <b>two</b><script>x()</script></p><div class="load">kept</div><div class="side-ad x">gone</div><aside>gone</aside><p>Please subscribe</p></article></body></html>'
    assert H.article_text(page) == "Head\nOne two\nkept\nPlease subscribe"
    assert H.sanitize('<p onclick="x">a<script>b</script><a href="javascript:x">c</a><a href="https://x.org">d</a><u>e</u></p>') == '<p>a<a>c</a><a href="https://x.org">d</a>e</p>'
    assert H.structured(page) == "<h2>Head</h2>\n<p>One <strong>two</strong></p>"
    assert [x[1] for x in H.images('<meta property="og:image" content="/c.png"><img src="a.png">', "http://x.org/y/")] == ["http://x.org/c.png", "http://x.org/y/a.png"]


def test_leap_day_and_reprint(spark):
    rows = "id int, canonical_title string, work_title string, canonical_year int, publication_year int, canonical_doi string, seed_doi string, reprint_doi string, work_doi string, published_at date"
    frame = spark.sql("SELECT 1 id, null canonical_title, 't' work_title, 2001 canonical_year, 2000 publication_year, null canonical_doi, null seed_doi, 'r' reprint_doi, 'w' work_doi, date'2000-02-29' published_at").to(spark.createDataFrame([], rows).schema)
    made = L.canonical_overrides(frame).first()
    assert (str(made.published_at), made.doi, made.title, made.publication_year) == ("2001-01-01", None, "t", 2001)


def test_same_work_collapses(spark):
    rows = [(1, 10, "A Paper: on things", 2020, True, "10.48550/arxiv.1", 90, 1), (1, 11, "A paper on things", 2021, False, "10.1/x", 5, 2), (2, 20, "Same title", 2000, False, "", 1, 1), (2, 21, "Same title", 2010, False, "", 2, 2)]
    found = L.collapse_same_work(spark.createDataFrame(rows, "seed_id long, work_id long, title string, year long, is_preprint boolean, doi string, citations long, place int")).collect()
    assert sorted((r.seed_id, r.work_id, r.distinct_works) for r in found) == [(1, 11, 1), (2, 20, 2), (2, 21, 2)]


def test_partition_counts_do_not_matter(spark, sf_dir):
    from tidemark import registry

    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        results = []
        for n in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(sorted(map(str, registry.queries()[registry.FLAGSHIP](spark, sf_dir).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1]


def test_emptied_partitions_go(spark, tmp_path):
    path = f"file://{tmp_path}/items"
    rows = lambda *ids: spark.createDataFrame([(i, "x") for i in ids], "id int, v string")
    K.save_items(spark, path, rows(1, 2), "2024-01-01")
    K.save_items(spark, path, rows(2, 3), "2024-01-02")
    K.save_items(spark, path, rows(1), "2024-01-02")
    assert [(r.id, str(r.run_date)) for r in K.read_items(spark, path, "id int, v string").collect()] == [(1, "2024-01-02")]
    assert set(K.slots(spark, path)[1]) == {"2024-01-02"}


def test_main_text_without_article_or_paragraphs():
    """Articles in div elements and line breaks are found; link lists, menus and footers are not taken for them."""
    menu = "<div><ul>" + "".join(f'<li><a href="/{k}">Section number {k} of our site</a></li>' for k in range(40)) + "</ul></div>"
    links = "<div>" + " ".join(f'<a href="/x{k}">More about the thing called {k}</a>' for k in range(30)) + "</div>"
    body = [f"Sentence {k} of the story tells what happened on that day and who was there to see it." for k in range(6)]
    page = f"<html><body>{menu}<h2>The headline</h2><div><div>{body[0]}</div><div>{body[1]} <a href='/s'>source</a></div><span>{body[2]}</span><br>{body[3]}<h3>Part</h3><div>{body[4]}</div><div>{body[5]}</div></div>{links}<div>Contact us</div></body></html>"
    lines = H.article_text(page).split("\n")
    assert lines[0] == "The headline" and "Part" in lines and not any("Section" in x or "More about" in x or "Contact" in x for x in lines)
    assert " ".join(lines).count("of the story") == 6
    assert "<h3>The headline</h3>" in H.structured(page) and "Section" not in H.structured(page)
    assert H.article_text("<div>short</div>") == "short" and H.article_text(None) == ""
    inside = f"<article><div>{body[0]}</div></article><div>{' '.join(body)}</div>"
    assert H.article_text(inside) == body[0]


def test_best_run_is_that_of_all_runs():
    import random

    pick = random.Random(2)
    for _ in range(200):
        blocks = ["".join(f"<a>w{k}</a> " if pick.random() < 0.3 else f"w{k} " for k in range(pick.choice([1, 3, 9, 15, 40]))) for _ in range(pick.randint(1, 9))]
        root = H.parse("".join(f"<div>{b}</div>" for b in blocks))
        weights = [H.block_weight(b) for b in H.text_blocks(root)]
        runs = [(sum(weights[i:j]), i, j) for i in range(len(weights)) for j in range(i + 1, len(weights) + 1)]
        best = max(x[0] for x in runs)
        found = H.main_run(root)
        if best <= 0:
            assert found is root
        else:
            assert sum(map(H.block_weight, found.children)) == best


@pytest.mark.parametrize("sort", ["score", "newest", "title", "other"])
def test_pages_by_cursor_are_pages_by_number(spark, sort):
    """Page after page by the last row's key gives every row once in the order of numbered pages, ties and missing keys included."""
    from tidemark.operators import reads as R

    rows = [(k, None if k % 5 == 0 else float(k % 4), 1000 + k // 3, None if k % 7 == 0 else f"t{k % 6}") for k in range(60)]
    items = spark.createDataFrame(rows, "id long, ai_score double, published_sec long, title string")
    seen, cursor = [], None
    while part := R.page_after(items, sort, 7, cursor).collect():
        seen += [r.id for r in part]
        cursor = (part[-1].cursor_key, part[-1].id)
    order = {"newest": lambda r: (-r[2], r[0]), "title": lambda r: (r[3] or "", r[0])}.get(sort, lambda r: (-(r[1] or 0.0), r[0]))
    assert seen == [r[0] for r in sorted(rows, key=order)]
    deep = R.page_after(items, sort, 7, cursor)._jdf.queryExecution().toString()
    assert "Offset" not in deep and "TakeOrdered" in deep
