"""The queries that SQL cannot express, against plain Python over the same tables."""

import datetime
import difflib
import html
import re
import unicodedata
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from tidemark import registry
from tidemark.functions import html as H
from tidemark.functions import text as T
from tidemark.operators import linking as L

SF = "/root/testdata/sf0.001"
QUERIES = registry.queries()


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def pages():
    return table("pages")


@pytest.fixture(scope="module")
def documents():
    return table("documents")


def found(spark, name, *columns):
    return sorted(((*(r[c] for c in columns),) for r in QUERIES[name](spark, SF).collect()), key=str)


def plain(fragment):
    return " ".join(html.unescape(re.sub("<[^>]+>", " ", fragment)).split())


def similarity(a, b):
    word = lambda t: " ".join(re.sub("[^a-z0-9]", " ", unicodedata.normalize("NFKC", t or "").lower()).split())
    return difflib.SequenceMatcher(None, word(a), word(b)).ratio()


def test_listing_posts(spark, pages):
    wanted = []
    for page in pages:
        for place, record in enumerate(re.findall("(?s)<li>.*?</li>", page["html"] or "")):
            title, link = re.search("(?s)<a[^>]*>(.*?)</a>", record), re.search('href="([^"]*)"', record)
            wanted.append((page["page_id"], place, plain(title[1]) if title else "", plain(link[1]) if link else ""))
    assert wanted and found(spark, "s6_listing_posts", "page_id", "place", "title", "link") == sorted(wanted, key=str)


def test_report_html_records(spark, pages):
    by_org = defaultdict(list)
    for page in sorted(pages, key=lambda p: p["page_id"]):
        org = (re.match(r"(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", page["url"]) or [None, ""])[1].lower()
        for place, record in enumerate(re.findall(r"(?s)<p>.*?(?=<p>|</article>|$)", page["html"] or "")):
            summary = re.search(r"(?s)<p>(.*?)(?:</p>|<br>|$)", record)
            if summary and plain(summary[1]):
                by_org[org].append((page["page_id"] * 10_000 + place, page["page_id"], place, org, plain(summary[1])))
    first = {}
    for row in sorted(row for rows in by_org.values() for row in sorted(rows)[:40]):
        first.setdefault(row[4], row)
    assert first and found(spark, "s28_report_html_records", "page_id", "place", "org", "summary") == sorted((r[1:] for r in first.values()), key=str)


def test_html_to_text(spark, pages):
    strip = lambda t: None if t is None else html.unescape(re.sub(r"[ \t\r\n]+", " ", re.sub("<[^>]+>", " ", t)).strip(" "))
    assert found(spark, "c2_html_to_text", "page_id", "plain") == sorted(((p["page_id"], strip(p["html"])) for p in pages), key=str)


def test_html_of_all_pages(spark, pages):
    """What has no boilerplate is kept word for word, what is listed is gone, and the safe markup parses to the same text."""
    words = lambda t: re.findall(r"\w+", t)
    visible = lambda source: words(H.text_of(H.parse(source)))
    sources = {p["page_id"]: p["html"] for p in pages}
    for page_id, stripped in found(spark, "c3_strip_containers", "page_id", "stripped"):
        tags = {n.tag for n in H.parse(stripped).walk()}
        assert not tags & {"aside", "footer"}
        if not re.search(r"(?i)<aside|<footer|(class|id)=", sources[page_id] or ""):
            assert visible(stripped) == visible(sources[page_id])
        assert not Counter(visible(stripped)) - Counter(visible(sources[page_id]))
    for page_id, safe in found(spark, "c10_sanitize_html", "page_id", "safe_html"):
        nodes = list(H.parse(safe).walk())
        assert {n.tag for n in nodes} <= H.SAFE_TAGS | {""} and not re.search(r"(?i)<script|javascript:|onclick", safe)
        assert all(set(n.attrs) <= set(H.SAFE_ATTRIBUTES.get(n.tag, ())) for n in nodes)
        assert not Counter(visible(safe)) - Counter(words(html.unescape(re.sub("<[^>]+>", " ", sources[page_id] or ""))) + visible(sources[page_id]))
    for page_id, structured in found(spark, "c11_structured_html", "page_id", "structured"):
        assert {n.tag for n in H.parse(structured).walk()} <= set("h2 h3 p blockquote figcaption ul ol li strong em".split()) | {""}
        assert not Counter(visible(structured)) - Counter(visible(sources[page_id]))


def test_images(spark, pages):
    """Pictures in the order of the page, each address once, at most twenty; the query adds a logo and a figure, twice."""
    from urllib.parse import urljoin

    by_page = defaultdict(list)
    for r in QUERIES["c12_extract_images"](spark, SF).collect():
        by_page[r.page_id].append((r.place, r.image_url, r.caption, r.is_cover))
    assert set(by_page) <= {p["page_id"] for p in pages}
    for page in pages:
        source = (page["html"] or "") + f'<img src="/a/logo.png"><figure><img src="b{page["page_id"] % 3}.jpg"><figcaption>cap</figcaption></figure><img src="b{page["page_id"] % 3}.jpg">'
        if page["html"] is None:
            continue
        order = list(dict.fromkeys(urljoin(page["url"], html.unescape(m)) for m in re.findall(r'<img[^>]*?\ssrc="([^"]*)"', source)))
        rows = sorted(by_page[page["page_id"]])
        assert [r[1] for r in rows if r[0] >= 0] == [u for u in order if u in {r[1] for r in rows}][:20]
        assert sum(r[3] for r in rows) <= 1 and (urljoin(page["url"], f"b{page['page_id'] % 3}.jpg") in {r[1] for r in rows})
        assert {r[2] for r in rows if r[1].endswith(f"/b{page['page_id'] % 3}.jpg")} == {"cap"}


def test_articles(spark, pages):
    """Pages that pass the gates have their article's words, in order; the others have none."""
    rows = QUERIES["c4_extract_article"](spark, SF).collect()
    assert {r.page_id for r in rows} == {p["page_id"] for p in pages}
    sources = {p["page_id"]: p["html"] for p in pages}
    for r in rows:
        if r.page_id % 7 == 0 or r.page_id % 11 == 0 or r.page_id % 13 == 0:
            assert r.status != "success" and not r.article
        elif r.status == "success":
            assert r.article == H.article_text(sources[r.page_id]) != "" and r.error is None
    assert any(r.status == "success" for r in rows)


def test_clean_texts(spark, documents):
    """The column's result is that of the function on each whole text; nothing is added, and lines keep their order."""
    for name, title in (("c8_clean_article", True), ("c22_attach_clean", False)):
        for doc_id, clean in found(spark, name, "doc_id", "clean"):
            text = next(d["text"] for d in documents if d["doc_id"] == doc_id) or ""
            assert clean == T.clean_text(text.strip() if not title else text, text.split("\n")[0] if title else None)
            lines = [" ".join(line.split()) for line in html.unescape(text).split("\n")]
            at = 0
            for line in filter(None, (" ".join(x.split()) for x in clean.split("\n"))):
                at = next(k for k in range(at, len(lines)) if line in lines[k] or all(w in lines[k] for w in line.split()))


def test_block_batches(spark, documents):
    wanted = []
    for d in documents:
        batch, held, chars = 0, 0, 0
        for at, block in enumerate((d["text"] or "").split("\n") if d["text"] is not None else []):
            if held and (held == 20 or chars + len(block) > 3000):
                batch, held, chars = batch + 1, 0, 0
            held, chars = held + 1, chars + len(block)
            wanted.append((d["doc_id"], at, batch))
    assert found(spark, "c33_block_batches", "doc_id", "at", "batch") == sorted(wanted, key=str)


def test_title_similarity(spark, documents):
    rows = {r.doc_id: r.similarity for r in QUERIES["p2_title_similarity"](spark, SF).collect()}
    assert set(rows) == {d["doc_id"] for d in documents}
    for d in documents:
        line = re.match(r"[^.\n]*", d["text"] or "")[0]
        changed = ("On " if d["doc_id"] % 3 == 0 else "") + line + ("!" if d["doc_id"] % 2 == 0 else "s")
        assert rows[d["doc_id"]] == (round(similarity(line, changed), 6) if d["text"] is not None else rows[d["doc_id"]])


def test_title_pool_and_matches(spark, documents):
    """The pool of all pairs, and by hand what becomes of each seed."""
    works = {d["doc_id"]: (d["text"] or "")[:60] for d in documents}
    seeds = {}
    for d in documents:
        i = d["doc_id"]
        if i % 20 == 0 and d["text"] is not None:
            seeds[i] = f"Unheard of: {i} and more" if i % 100 == 20 else works[i] + ("!" if i % 40 == 0 else "s")
    pool = defaultdict(list)
    for s, a in seeds.items():
        near = sorted((-similarity(a, b), w) for w, b in works.items() if w % 50 != 49 and L.plain_title(b) and L.plain_title(a))
        pool[s] = [(w, -r) for r, w in near if -r >= L.SIMILAR][:5]
    wanted = sorted(((s, w, round(r, 6), k + 1) for s, ws in pool.items() for k, (w, r) in enumerate(ws)), key=str)
    assert found(spark, "p5_candidate_pool", "seed_id", "work_id", "similarity", "place") == wanted
    matched = {r.seed_id: r for r in QUERIES["p6_match_seeds"](spark, SF).collect()}
    assert set(matched) >= set(seeds)
    for s in seeds:
        r = matched[s]
        if s % 60 == 0:
            assert (r.work_id, r.outcome, r.method) == (s, "matched", "override")
        elif s % 80 == 0 and s % 100 != 20:
            assert (r.work_id, r.outcome, r.method) == (s, "matched", "doi")
        elif s % 140 == 0:
            assert (r.work_id, r.outcome, r.method) == (s, "matched", "arxiv_id")
        elif not pool[s]:
            assert (r.work_id, r.outcome) == (None, "unmatched")
        else:
            assert r.outcome in ("matched", "manual_review") and r.work_id in {w for w, _ in pool[s]}
    report = Counter((r.outcome, r.method or "-") for r in matched.values())
    assert found(spark, "p16_match_report", "outcome", "method", "n") == sorted(((*key, n) for key, n in report.items()), key=str)
    collapsed = QUERIES["p7_collapse_same_work"](spark, SF).collect()
    assert {r.seed_id for r in collapsed} == {s for s in pool if pool[s]} and all(r.work_id in {w for w, _ in pool[r.seed_id]} for r in collapsed)


def test_merged_content(spark, pages):
    """The fold of what a URL key holds, one item after the other."""
    keyed = {r.id: r.key for r in QUERIES["d1_normalize_url"](spark, SF).collect()}
    groups = defaultdict(list)
    for p in pages:
        groups[keyed[p["page_id"]]].append((p["page_id"], "web", p["html"], False))
        if p["page_id"] % 3 == 0:
            groups[keyed[p["page_id"] + 1_000_000]].append((p["page_id"] + 1_000_000, "feed", None if p["html"] is None else p["html"].replace("e", ""), True))
    wanted = []
    for key, rows in groups.items():
        rows.sort()
        main = max(rows, key=lambda r: (len(r[2] or ""), -r[0]))
        content, ok, seen = main[2] if len(rows) == 1 else main[2] or "", main[3], set()
        for pos, kind, text, good in rows:
            if pos == main[0] or (text, good) in seen:
                continue
            seen.add((text, good))
            if good and not ok:
                content, ok = text or "", True
            if text and content and text not in content:
                content += f"\n\n--- From {kind} ---\n{text}"
        wanted.append((key, main[0], rows[0][0], len(rows), content))
    assert found(spark, "d2_merged_content", "key", "id", "first_pos", "n_items", "content") == sorted(wanted, key=str)


def digest_rows(spark):
    """Selected items by day in the order of the digest, from the query of the ratings."""
    from tidemark.plans.reads import selected_items

    by_day = defaultdict(list)
    for r in selected_items(spark, SF).filter("selected").collect():
        by_day[r.day].append(r)
    for rows in by_day.values():
        rows.sort(key=lambda r: (-(r.ai_score or 0), r.id))
    return by_day


def item_markdown(r, place, lang):
    at = datetime.datetime.fromtimestamp(r.published_sec, datetime.UTC)
    title = (f"标题 {r.id}" if lang == "zh" else r.title).replace("[", "(").replace("]", ")")
    name = "feed" if r.id % 2 == 0 else "ann"
    when = f"{at.month}月{at.day}日 {at:%H:%M}" if lang == "zh" else f"{at:%b} {at.day}, {at:%H:%M}"
    line = f"{r.source_type} · {name} · {when}"
    if r.id % 3 == 1:
        line += f" · [{'讨论' if lang == 'zh' else 'Discussion'}](https://d.org)"
    return f'<a id="item-{place}"></a>\n## [{title}]({r.url}) ⭐️ {r.ai_score:.1f}/10\n\nsum\n\n{line}\n\n**{"推荐理由" if lang == "zh" else "Why"}**: because\n\n---\n\n', f"{place}. [{title}](#item-{place}) ⭐️ {r.ai_score:.1f}/10"


def test_digest_texts(spark):
    by_day = digest_rows(spark)
    wanted = [(r.id, item_markdown(r, k + 1, "en")[0], item_markdown(r, k + 1, "zh")[0]) for rows in by_day.values() for k, r in enumerate(rows)]
    assert wanted and found(spark, "o1_digest_item_markdown", "id", "en", "zh") == sorted(wanted, key=str)
    totals = Counter(d["doc_id"] % 10 for d in table("documents"))
    words = {"en": ("Daily Digest", "items selected from", "fetched", "Nothing was selected today."), "zh": ("每日精选", "条选自", "条", "今日没有入选内容。")}
    pages = []
    for day, total in totals.items():
        for lang, (title, chosen, fetched, empty) in words.items():
            rows = by_day.get(day, [])[:30]
            head = f"# {title} - {day}\n\n> {len(rows)} {chosen} {total} {fetched}\n\n"
            made = [item_markdown(r, k + 1, lang) for k, r in enumerate(rows)]
            pages.append((day, lang, head + ("---\n\n" + "\n".join(x[1] for x in made) + "\n\n---\n\n" + "".join(x[0] for x in made) if rows else empty)))
    assert found(spark, "o2_daily_digest_markdown", "day", "lang", "markdown") == sorted(pages, key=str)
