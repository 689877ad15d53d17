"""Record linkage of papers across catalogues, their enrichment and ranking; reports and their files."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from tidemark.operators.reads import institutions
from tidemark.operators.sinks import workdir

SIMILAR, DOI_SIMILAR, SAME_WORK, MOST_CANDIDATES = 0.85, 0.75, 0.95, 5
#: Distinct titles of seeds and of works in a cell that is compared at once.
SEED_BLOCK, WORK_BLOCK = 8192, 65_536
#: Cells that there are at least, while each has this many seeds, so that they keep all cores busy.
CELLS, LEAST_SEEDS = 64, 1024
#: Titles of works, for each of so many seeds, whose common subsequences are found at once.
TITLE_BLOCK, SEEDS_AT_ONCE = 256, 64
#: Sketches of works that are compared with a group of seeds before the next ones are read.
SKETCH_BLOCK = 8192
#: How far any cut of a seed's title is at most from one that is tried, in the first pass over the halves of works and in the second.
CUTS_AWAY = (3, 1)
REQUIRED = ["title", "authors", "abstract", "publication_year", "doi", "url", "journal_ref"]


def plain_title(title: str) -> str:
    text = unicodedata.normalize("NFKC", title).lower()
    return " ".join(re.sub(r"[^a-z0-9]", " ", text).split())


@F.pandas_udf(StringType())
def _nfkc(title: pd.Series) -> pd.Series:
    return title.map(lambda t: None if t is None else plain_title(t))


def normalize_title(title: Column) -> Column:
    """Lower-case ASCII words; titles with other characters are normalised in Python, the rest natively."""
    native = F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " "))
    return F.when(title.rlike(r"^[\x00-\x7f]*$"), native).otherwise(_nfkc(F.when(~title.rlike(r"^[\x00-\x7f]*$"), title)))


@F.pandas_udf(DoubleType())
def title_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two normalised titles."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def author_overlap(a: Column, b: Column) -> Column:
    """Whether half of all last names are shared; true if either side has none."""
    last = lambda c: F.array_distinct(F.transform(c, lambda n: F.lower(F.element_at(F.split(F.trim(n), r"\s+"), -1))))
    x, y = last(a), last(b)
    return F.coalesce((F.size(x) == 0) | (F.size(y) == 0) | (F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.size(F.array_union(x, y))) >= 0.5), F.lit(True))


def year_matches(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a - b) <= 1, F.lit(True))


def _common_length(a: str, codes: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of a title and each row of character codes, 0 where a row has ended; bit-parallel."""
    if len(a) > 64:
        masks = {}
        for k, c in enumerate(a):
            masks[ord(c)] = masks.get(ord(c), 0) | 1 << k
        full, found = (1 << len(a)) - 1, []
        for row in codes.tolist():
            v = full
            for c in row:
                u = v & masks.get(c, 0)
                v = ((v + u) | (v - u)) & full
            found.append(len(a) - v.bit_count())
        return np.array(found, dtype=np.int64)
    masks = np.zeros(128, dtype=np.uint64)
    for k, c in enumerate(a):
        masks[ord(c)] |= np.uint64(1 << k)
    v = np.full(len(codes), np.uint64(2**64 - 1))
    for column in np.ascontiguousarray(codes.T):
        u = v & masks[column]
        v = (v + u) | (v - u)
    return len(a) - np.bitwise_count(v & np.uint64((1 << len(a)) - 1)).astype(np.int64)


def _common_lengths(seeds: list[str], of: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """As _common_length for pairs of seeds[of[k]], of 64 characters at most, and codes[:, k]; all pairs at once."""
    masks = [0] * (128 * len(seeds))
    for n, a in enumerate(seeds):
        for k, c in enumerate(a.encode("ascii")):
            masks[128 * n + c] |= 1 << k
    masks, v = np.array(masks, dtype=np.uint64), np.full(len(of), np.uint64(2**64 - 1))
    u, m = np.empty_like(v), np.empty_like(v)
    for place in codes + of * 128:
        np.take(masks, place, out=m, mode="clip")
        np.bitwise_and(v, m, out=u)
        np.add(v, u, out=m)
        np.subtract(v, u, out=v)
        np.bitwise_or(v, m, out=v)
    sizes = np.array([len(a) for a in seeds])
    full = np.array([(1 << len(a)) - 1 for a in seeds], dtype=np.uint64)
    return sizes[of] - np.bitwise_count(v & full[of]).astype(np.int64)


def _ratio(a: str, b: str, least: float = 0.0) -> float:
    """SequenceMatcher(None, a, b).ratio(), its longest blocks found by searches in strings; 0 once it cannot reach ``least``."""
    if not a or not b or len(b) >= 200:  # from 200 characters it sets frequent ones aside
        return difflib.SequenceMatcher(None, a, b).ratio()
    total, matched, hope, open_ = len(a) + len(b), 0, min(len(a), len(b)), [(0, len(a), 0, len(b))]
    while open_:
        a_low, a_high, b_low, b_high = open_.pop()
        i, j, size, k = a_low, b_low, 0, a_low
        while k + size < a_high:
            at = b.find(a[k : k + size + 1], b_low, b_high)
            if at < 0:
                k += 1
                continue
            i, j, size = k, at, size + 1
            while i + size < a_high and j + size < b_high and a[i + size] == b[j + size]:
                size += 1
        hope -= min(a_high - a_low, b_high - b_low)
        if size:
            left, right = min(i - a_low, j - b_low), min(a_high - i, b_high - j) - size
            matched, hope = matched + size, hope + left + right
            open_ += [(a_low, i, b_low, j)] * (left > 0) + [(i + size, a_high, j + size, b_high)] * (right > 0)
        if 2.0 * (matched + hope) / total < least:
            return 0.0
    return 2.0 * matched / total


def _sketch_bits(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first bit, bits) of each character in a sketch of 64 bits, by counts (a row for each character, a column for each title).

    The k-th occurrence of a character turns over one of its bits, in a circle, so two sketches differ in at most as many bits as
    occurrences. Bits go where they make most difference between titles; the characters that get none share the last one.
    """
    some = counts[:, :: max(1, counts.shape[1] // 1024)]
    apart = np.abs(some - np.roll(some, 1, axis=1))
    differ = [np.zeros(len(counts)), *(np.minimum(apart % (2 * n), 2 * n - apart % (2 * n)).mean(axis=1) for n in range(1, 17))]
    more, bits = np.diff(differ, axis=0, append=-np.ones((1, len(counts)))), np.zeros(len(counts), dtype=int)
    for _ in range(63):
        c = np.argmax(more[bits, np.arange(len(counts))])
        bits[c] += more[bits[c], c] > 0
    return np.where(bits > 0, np.cumsum(bits) - bits, 63), np.maximum(bits, 1)


def _signs(counts: np.ndarray) -> np.ndarray:
    """1, 0 or -1 for each character (a row of counts), so that sums of them over titles lie far apart: two similar titles' sums cannot."""
    some = counts[:, :: max(1, counts.shape[1] // 1024)]
    main = np.linalg.eigh(np.cov(some, bias=True).reshape(len(some), len(some)))[1][:, -1]
    return np.where(np.abs(main) < 0.03, 0, np.sign(main)).astype(np.int64)


def _cut_sketches(titles: list[str], first: np.ndarray, bits: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each title the sketches of all its beginnings and of the rests after them; first and bits of each character code."""
    text, sizes = np.frombuffer("".join(titles).encode("ascii"), dtype=np.uint8), np.array([len(a) for a in titles])
    keys, places = np.repeat(np.arange(len(titles)), sizes) * 128 + text, np.arange(len(text))
    order = np.argsort(keys, kind="stable")
    ranked, before, after = keys[order], np.empty_like(places), np.empty_like(places)
    before[order] = places - np.searchsorted(ranked, ranked, side="left")
    after[order] = np.searchsorted(ranked, ranked, side="right") - 1 - places
    # One run over all titles: what lies between two places is the difference of what lies before each.
    begins, ends = (np.append(np.uint64(0), np.bitwise_xor.accumulate(np.uint64(1) << (first[text] + k % bits[text]).astype(np.uint64))) for k in (before, after))
    stops = np.cumsum(sizes)
    return [(begins[i : j + 1] ^ begins[i], ends[i : j + 1] ^ ends[j]) for i, j in zip((stops - sizes).tolist(), stops.tolist(), strict=True)]


def _nearest_in_cell(seeds: pd.DataFrame, works: pd.DataFrame) -> pd.DataFrame:
    """(a, b, similarity, first_id): of one cell each seed title's MOST_CANDIDATES most similar titles, ties to the smaller first_id.

    The ratio is at most what the longest common subsequence gives, and characters outside it are few. So few characters are
    in one title only, counted as a bound by sketches: of whole titles for all pairs, then, for those that pass, of both halves of a
    work's title against every cut of the seed's. The rest are taken in the order of that bound, then by the subsequence; once the
    bound falls below the last of the best, no other title can come among them. Subsequences are found for SEEDS_AT_ONCE seeds
    together, a block of titles each.
    """
    names, ids = works["plain"].to_numpy(), works["first_id"].to_numpy()
    if not len(names):
        return pd.DataFrame({"a": [], "b": [], "similarity": [], "first_id": []}).astype({"a": object, "b": object, "similarity": float, "first_id": "int64"})
    lengths = np.array([len(n) for n in names], dtype=np.int64)
    text, starts = np.frombuffer("".join(names).encode("ascii"), dtype=np.uint8), np.cumsum(lengths) - lengths
    owner, present = np.repeat(np.arange(len(names)), lengths), np.flatnonzero(np.bincount(text))
    row = np.zeros(128, dtype=np.int64)
    row[present] = np.arange(len(present))
    row = row[text] + len(present) * (np.arange(len(text)) - starts[owner] >= (lengths // 2)[owner])
    counts = np.bincount(row * len(names) + owner, minlength=2 * len(present) * len(names)).reshape(2, len(present), len(names))
    del owner, row
    first, bits = np.full(128, 63), np.ones(128, dtype=int)
    first[present], bits[present] = _sketch_bits(counts[0] + counts[1])

    def sketched(counts: np.ndarray) -> np.ndarray:
        """A sketch of 64 bits for each column."""
        sketch = np.zeros(counts.shape[1], dtype=np.uint64)
        for of, c in zip(counts, present, strict=True):
            turned = np.bitwise_xor.accumulate([0, *(1 << int(first[c] + k % bits[c]) for k in range(2 * bits[c] - 1))], dtype=np.uint64)
            sketch ^= turned[of % len(turned)]
        return sketch

    whole, front, back = sketched(counts[0] + counts[1]), sketched(counts[0]), sketched(counts[1])
    signs, sums = np.zeros(128, dtype=np.int64), counts[0] + counts[1]
    signs[present] = _signs(sums)
    sums = signs[present] @ sums
    order = np.argsort(sums, kind="stable")
    names, ids, lengths, starts, whole, front, back, sums = (x[order] for x in (names, ids, lengths, starts, whole, front, back, sums))
    places = np.arange(len(names))
    del counts, order

    @lru_cache(maxsize=64)
    def apart(n: int) -> tuple[np.ndarray, list[list[np.ndarray]]]:
        """For a title of n characters and each one of works: one more than the characters outside the common ones that they may have to be similar,
        at most 200, 0 for none; and for each of CUTS_AWAY the places where to cut the title, by eights."""
        both, more = n + lengths, n - lengths
        least = np.floor(SIMILAR * both / 2)
        least -= 2.0 * (least - 1) / both >= SIMILAR
        least += 2.0 * least / both < SIMILAR
        spare = (both - np.abs(more)) // 2 - least.astype(np.int64)
        some, half = spare >= 0, lengths // 2
        low, high = ((half - spare + np.minimum(more, 0))[some].min(), (half + spare + np.maximum(more, 0))[some].max()) if some.any() else (0, 0)
        cuts = [np.unique(np.clip(np.arange(low + away, high + 2 * away + 1, 2 * away + 1), 0, n))[:, None] for away in CUTS_AWAY]
        return np.where(some, np.minimum(np.abs(more) + 2 * spare + 1, 200), 0).astype(np.uint8), [[c[k : k + 8] for k in range(0, len(c), 8)] for c in cuts]

    def alike(group: list[str], sketches: list[np.uint64]) -> list[np.ndarray]:
        """For each title of a group those whose sketch is near enough, and whose sum of signs can be."""
        found, limits = [[] for _ in group], [apart(len(a))[0] for a in group]
        own, most = np.array([signs[np.frombuffer(a.encode("ascii"), dtype=np.uint8)].sum() for a in group]), [np.inf if x.max() == 200 else int(x.max()) for x in limits]
        lows, highs = np.searchsorted(sums, own - most, side="left").tolist(), np.searchsorted(sums, own + most, side="right").tolist()
        differ, turned, few = (np.empty(min(SKETCH_BLOCK, len(names)), dtype=t) for t in (np.uint64, np.uint8, bool))
        for start in range(0, len(names), SKETCH_BLOCK):
            for k, limit in enumerate(limits):
                low, high = max(start, lows[k]), min(start + SKETCH_BLOCK, highs[k])
                if low < high:
                    n = high - low
                    np.bitwise_xor(whole[low:high], sketches[k], out=differ[:n])
                    np.bitwise_count(differ[:n], out=turned[:n])
                    np.less(turned[:n], limit[low:high], out=few[:n])
                    found[k].append(places[low:high][few[:n]])
        return [np.concatenate(f) if f else places[:0] for f in found]

    def near(a: str, some: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Titles that may be similar and their bounds, highest first.

        A work's half lies on a beginning of the title, up to some cut. Only every seventh is tried, then every third: the next one
        to any is at most three, or one, characters away, each of which changes two counts by one.
        """
        most, cuts = apart(len(a))
        for away, eights in zip(CUTS_AWAY, cuts, strict=True):
            x, y, differ = front[some], back[some], np.full(len(some), 255, dtype=np.uint8)
            for cut in eights:
                each = np.bitwise_count(x ^ begins[cut])
                each += np.bitwise_count(y ^ ends[cut])
                np.minimum(differ, each.min(axis=0), out=differ)
            close = np.flatnonzero(differ < most[some] + np.uint8(2 * away))
            some = some[close]
        both, differ = len(a) + lengths[some], differ[close].astype(np.int64) - 2 * away
        bound = 2.0 * ((both - np.maximum(differ, np.abs(2 * len(a) - both))) // 2) / both
        order = np.argsort(-bound, kind="stable")[: np.count_nonzero(bound >= SIMILAR)]
        return some[order], bound[order]

    def codes(block: np.ndarray) -> np.ndarray:
        """Characters of titles, a column each, 0 where a title has ended."""
        place = np.arange(lengths[block].max())[:, None]
        return np.where(place < lengths[block], text[np.minimum(starts[block] + place, len(text) - 1)], 0)

    every, found = seeds["plain"].tolist(), []
    for group in (every[k : k + SEEDS_AT_ONCE] for k in range(0, len(every), SEEDS_AT_ONCE)):
        best = {n: [] for n in range(len(group))}
        least = lambda n: best[n][-1][0] if len(best[n]) == MOST_CANDIDATES else SIMILAR
        cut = _cut_sketches(group, first, bits)
        passed = alike(group, [begins[-1] for begins, _ in cut])
        open_, start = {n: near(a, passed[n], *cut[n]) for n, a in enumerate(group)}, 0
        while open_:
            blocks = {n: some[start : start + TITLE_BLOCK][bound[start : start + TITLE_BLOCK] >= least(n)] for n, (some, bound) in open_.items()}
            blocks = {n: block for n, block in blocks.items() if len(block)}
            common = {n: _common_length(group[n], codes(block).T) for n, block in blocks.items() if len(group[n]) > 64}
            if short := [n for n in blocks if n not in common]:
                ends = np.cumsum([len(blocks[n]) for n in short])
                of = np.repeat(np.arange(len(short)), np.diff(ends, prepend=0))
                of_all = _common_lengths([group[n] for n in short], of, codes(np.concatenate([blocks[n] for n in short])))
                common |= dict(zip(short, np.split(of_all, ends[:-1]), strict=True))
            for n, block in blocks.items():
                ratio = 2.0 * common[n] / (len(group[n]) + lengths[block])
                some = np.flatnonzero(ratio >= least(n))
                for k in some[np.argsort(-ratio[some], kind="stable")]:
                    if ratio[k] < least(n):
                        break
                    similarity = _ratio(group[n], names[block[k]], least(n))
                    if similarity >= SIMILAR:
                        best[n] = sorted([*best[n], (similarity, int(ids[block[k]]), names[block[k]])], key=lambda x: (-x[0], x[1]))[:MOST_CANDIDATES]
            open_, start = {n: open_[n] for n in blocks}, start + TITLE_BLOCK
        found += [(a, b, similarity, first_id) for n, a in enumerate(group) for similarity, first_id, b in best[n]]
    return pd.DataFrame(found, columns=["a", "b", "similarity", "first_id"]).astype({"a": object, "b": object, "similarity": float, "first_id": "int64"})


def _written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the folder that all executors share, so that it is made once."""
    path = workdir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def nearest_titles(seeds: DataFrame, works: DataFrame) -> DataFrame:
    """(a, b, similarity): for each distinct ``plain`` title of the seeds the MOST_CANDIDATES most similar ones of the works.

    Similarities are at least SIMILAR; ties go to the title with the smaller ``first_id`` (works: plain, first_id, one row for
    each title), and none that belongs among the best is left out. Both sides are dealt to blocks and each pair of blocks is a
    cell, so comparisons grow with both sides: the ratio has no selective exact index, as 0.85 allows nine changed letters in
    sixty. What leaves a cell is at most MOST_CANDIDATES rows for each of its seed titles, however many are similar.
    """
    s, w = _written(seeds.select("plain").filter("plain != ''").distinct(), "seed-titles"), _written(works.select("plain", "first_id").filter("plain != ''"), "work-titles")
    n_seeds, n_w = s.count(), max(1, -(-w.count() // WORK_BLOCK))
    n_s = max(1, -(-n_seeds // SEED_BLOCK), min(n_seeds // LEAST_SEEDS, -(-CELLS // n_w)))
    deal = lambda n: F.pmod(F.xxhash64("plain"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Cells are long work on few bytes, so they are dealt by number, which adaptive execution does not put together by bytes.
    cells = lambda x: x.repartition(2 * n_s * n_w, "i", "j").groupBy("i", "j")
    x = s.select("plain", deal(n_s).alias("i")).withColumn("j", every(n_w))
    y = w.withColumn("j", deal(n_w)).withColumn("i", every(n_s))
    near = cells(x).cogroup(cells(y)).applyInPandas(_nearest_in_cell, "a string, b string, similarity double, first_id long")
    place = F.row_number().over(W.partitionBy("a").orderBy(F.desc("similarity"), "first_id"))
    return near.withColumn("_n", place).filter(F.col("_n") <= MOST_CANDIDATES).select("a", "b", "similarity")


def candidate_pool(seeds: DataFrame, works: DataFrame) -> DataFrame:
    """(seed_id, work_id, similarity, place): the best works per seed that are not retracted and similar in title.

    Titles are normalised once, and compared once however many rows have them. The best MOST_CANDIDATES works bear at most that
    many titles, which are the best titles by similarity and first work, and of works with one title only the first
    MOST_CANDIDATES can be chosen. Works without an id and titles that are null or have no letters or digits take no part.
    """
    live = works.filter(F.col("work_id").isNotNull() & ~F.coalesce("is_retracted", F.lit(False)))
    s, w = (_written(x.select(key, normalize_title(F.col("title")).alias("plain")).filter("plain != ''"), "titles") for x, key in ((seeds, "seed_id"), (live, "work_id")))
    close = nearest_titles(s, w.groupBy("plain").agg(F.min("work_id").alias("first_id")))
    first = w.select("work_id", F.col("plain").alias("b")).withColumn("_n", F.row_number().over(W.partitionBy("b").orderBy("work_id"))).filter(F.col("_n") <= MOST_CANDIDATES).drop("_n")
    ranked = close.join(first, "b").withColumn("place", F.row_number().over(W.partitionBy("a").orderBy(F.desc("similarity"), "work_id")))
    best = ranked.filter(F.col("place") <= MOST_CANDIDATES).withColumnRenamed("a", "plain")
    return s.join(best, "plain").select("seed_id", "work_id", "similarity", "place")


def match_by_keys(seeds: DataFrame, works: DataFrame) -> DataFrame:
    """(seed_id, work_id, method) by explicit id, else DOI with a similar enough title, else arXiv id; works have unique keys."""
    w = works.select("work_id", F.col("doi").alias("w_doi"), F.col("arxiv_id").alias("w_arxiv"), F.col("title").alias("w_title"))
    pinned = seeds.join(w.select("work_id"), F.col("override_id") == F.col("work_id")).select("seed_id", "work_id", F.lit("override").alias("method"), F.lit(1).alias("rank"))
    by_doi = seeds.join(w, F.lower("doi") == F.lower("w_doi")).withColumn("similarity", title_similarity(normalize_title(F.col("title")), normalize_title(F.col("w_title"))))
    by_doi = by_doi.filter(F.col("similarity") >= DOI_SIMILAR).select("seed_id", "work_id", F.lit("doi").alias("method"), F.lit(2).alias("rank"))
    by_arxiv = seeds.join(w, F.col("arxiv_id") == F.col("w_arxiv")).select("seed_id", "work_id", F.lit("arxiv_id").alias("method"), F.lit(3).alias("rank"))
    best = pinned.unionByName(by_doi).unionByName(by_arxiv).groupBy("seed_id").agg(F.min(F.struct("rank", "work_id", "method")).alias("m"))
    return best.select("seed_id", "m.work_id", "m.method")


def collapse_same_work(candidates: DataFrame) -> DataFrame:
    """Of accepted candidates (seed_id, work_id, title, year, is_preprint, doi, citations, place) one per work: published, with DOI, most cited.

    Groups are the at most MOST_CANDIDATES candidates of a seed, one row each, so that seeds reach Python by the batch.
    """

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for seed, rows in zip(batch["seed_id"].to_pylist(), batch["rows"].to_pylist(), strict=True):
                groups: list[list[dict]] = []
                for row in rows:
                    for group in groups:
                        head = group[0]
                        near = head["year"] is None or row["year"] is None or abs(head["year"] - row["year"]) <= 1
                        if near and _ratio(row["plain"], head["plain"], SAME_WORK) >= SAME_WORK:
                            group.append(row)
                            break
                    else:
                        groups.append([row])
                best = (max(g, key=lambda r: (not r["is_preprint"], r["doi"] != "", r["citations"] or 0)) for g in groups)
                found += [(seed, row["work_id"], len(groups)) for row in best]
            columns = zip(*found, strict=True) if found else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["seed_id", "work_id", "distinct_works"])

    kept = candidates.filter(F.col("place") <= MOST_CANDIDATES).withColumns({"doi": F.coalesce("doi", F.lit("")), "plain": normalize_title(F.col("title"))})
    rows = F.sort_array(F.collect_list(F.struct("place", "work_id", "plain", "year", "is_preprint", "doi", "citations")))
    return kept.groupBy("seed_id").agg(rows.alias("rows")).mapInArrow(collapse, "seed_id long, work_id long, distinct_works long")


def match_seeds(seeds: DataFrame, works: DataFrame) -> DataFrame:
    """(seed_id, work_id, outcome, method): by keys first, the remainder by title, year and authors."""
    keyed = match_by_keys(seeds, works)
    rest = seeds.join(keyed, "seed_id", "left_anti")
    pool = candidate_pool(rest, works)
    detail = pool.join(works.select("work_id", F.col("title").alias("w_title"), F.col("year").alias("w_year"), F.col("authors").alias("w_authors"), F.col("doi").alias("w_doi"), F.col("arxiv_id").alias("w_arxiv"), "citations"), "work_id")
    detail = detail.join(rest.select("seed_id", F.col("year").alias("s_year"), F.col("authors").alias("s_authors")), "seed_id")
    method = F.when(F.coalesce("w_doi", F.lit("")) != "", "doi").when(F.col("w_arxiv").isNotNull(), "arxiv_id").when(year_matches(F.col("w_year"), F.col("s_year")) & author_overlap(F.col("w_authors"), F.col("s_authors")), "title_year_author")
    judged = detail.withColumn("method", method)
    accepted = judged.filter("method IS NOT NULL").select("seed_id", "work_id", F.col("w_title").alias("title"), F.col("w_year").alias("year"), F.coalesce(F.lower("w_doi").contains("10.48550/arxiv."), F.lit(False)).alias("is_preprint"), F.col("w_doi").alias("doi"), "citations", "place")
    unique = collapse_same_work(accepted)
    single = unique.filter("distinct_works = 1").join(judged.select("seed_id", "work_id", "method"), ["seed_id", "work_id"]).select("seed_id", "work_id", F.lit("matched").alias("outcome"), "method")
    first = pool.filter("place = 1").join(single, "seed_id", "left_anti").select("seed_id", "work_id", F.lit("manual_review").alias("outcome"), F.lit(None).cast("string").alias("method"))
    none = rest.select("seed_id").join(pool.select("seed_id").distinct(), "seed_id", "left_anti").select("seed_id", F.lit(None).cast("long").alias("work_id"), F.lit("unmatched").alias("outcome"), F.lit(None).cast("string").alias("method"))
    return keyed.select("seed_id", "work_id", F.lit("matched").alias("outcome"), "method").unionByName(single).unionByName(first).unionByName(none)


def canonical_overrides(rows: DataFrame) -> DataFrame:
    """Seed values win; a reprint's DOI never becomes the DOI; a canonical year moves the date, 29 February to 1 January if need be."""
    year = F.coalesce("canonical_year", "publication_year")
    move = F.col("canonical_year").isNotNull() & ~F.col("canonical_year").eqNullSafe(F.col("publication_year"))
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    first = (F.month("published_at") == 2) & (F.dayofmonth("published_at") == 29) & ~leap
    moved = F.when(first, F.make_date(year, F.lit(1), F.lit(1))).otherwise(F.make_date(year, F.month("published_at"), F.dayofmonth("published_at")))
    own = F.coalesce("canonical_doi", "seed_doi")
    doi = F.when(own.isNotNull(), own).when(F.col("reprint_doi").isNull(), F.col("work_doi"))
    return rows.select("id", F.coalesce("canonical_title", "work_title").alias("title"), year.alias("publication_year"), doi.alias("doi"), F.when(move, moved).otherwise(F.col("published_at")).alias("published_at"))


def invert_abstracts(papers: DataFrame, words: Column, out: str) -> DataFrame:
    """Adds ``out``, a map from each word of an array to its places, in order; row by row, so nothing is moved."""
    placed = papers.withColumn("_placed", F.sort_array(F.transform(words, lambda w, p: F.struct(w.alias("w"), p.alias("p")))))
    first = F.array_compact(F.transform("_placed", lambda x, k: F.when(~x["w"].eqNullSafe(F.get("_placed", k - 1)["w"]), k)))
    runs = placed.withColumn("_first", first)
    end = lambda k: F.coalesce(F.get("_first", k + 1), F.size("_placed"))
    entry = lambda at, k: F.struct(F.get("_placed", at)["w"], F.transform(F.slice("_placed", at + 1, end(k) - at), lambda x: x["p"]))
    return runs.withColumn(out, F.map_from_entries(F.transform("_first", entry))).drop("_placed", "_first")


def reconstruct_abstract(index: Column) -> Column:
    """Text of a map from words to their places."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.sort_array(placed), lambda x: x["w"]), " ")


def extract_arxiv_id(doi: Column, landing: Column) -> Column:
    """From the DOI, else from the page's address without its version; null if neither has one."""
    from_doi = F.regexp_extract(F.lower(doi), r"10\.48550/arxiv\.(.+)", 1)
    from_url = F.regexp_replace(F.regexp_extract(landing, r"(?i)arxiv\.org/abs/([^/\s?#]+)", 1), r"v\d+$", "")
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(some(from_doi), some(from_url))


def missing_fields(columns: dict[str, str]) -> Column:
    """Names of required fields that are null or empty; columns gives the kind of each."""
    empty = lambda c: F.col(c).isNull() | ((F.size(c) == 0) if columns[c].startswith("array") else (F.col(c).cast("string") == ""))
    return F.array_compact(F.array(*(F.when(empty(c), F.lit(c)) for c in REQUIRED if c in columns)))


def fill_from_fallbacks(papers: DataFrame, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Fills empty fields of papers (id and REQUIRED but authors) from each source in turn, joined by id; adds enrichment_status."""
    fields = [c for c in REQUIRED if c in papers.columns]
    found, tried = papers, F.lit(False)
    for name, source in sources:
        there = source.select("id", F.lit(True).alias(f"_{name}"), *(F.col(c).alias(f"_{name}_{c}") for c in fields if c in source.columns))
        found = found.join(there, "id", "left")
    made = []
    for c in fields:
        text = lambda x, c=c: F.nullif(F.col(x), F.lit("")) if dict(found.dtypes)[x] == "string" else F.col(x)
        value = F.coalesce(text(c), *(text(f"_{n}_{c}") for n, s in sources if c in s.columns))
        if c == "doi" and "reprint_doi" in papers.columns:
            value = F.when(F.col("reprint_doi").isNotNull() & F.col("canonical_doi").isNull(), None).otherwise(value)
        made.append(value.alias(c))
    for name, _ in sources:
        tried = tried | F.coalesce(F.col(f"_{name}"), F.lit(False))
    complete = lambda where: F.size(F.filter(F.array(*(where(c) for c in fields)), lambda x: x)) == 0
    before = complete(lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == "")
    filled = found.select("id", before.alias("_before"), tried.alias("_tried"), *made)
    after = complete(lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == "")
    return filled.withColumn("enrichment_status", F.when(F.col("_before") | after, "complete").when(F.col("_tried"), "partial").otherwise("failed")).drop("_before", "_tried")


def overlay(papers: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """Values of ``other`` (id, columns) replace those of papers unless they are empty."""
    there = other.select("id", *(F.col(c).alias(f"_o_{c}") for c in columns))
    joined = papers.join(there, "id", "left")
    for c in columns:
        joined = joined.withColumn(c, F.coalesce(F.nullif(F.col(f"_o_{c}"), F.lit("")), F.col(c))).drop(f"_o_{c}")
    return joined


def top_papers(papers: DataFrame, n: int, wanted: Column | None = None, least: int = 100) -> DataFrame:
    """The n with most votes among the max(least, n) best that meet the condition; no votes count 0, ties keep pos."""
    order = [F.coalesce("upvotes", F.lit(0)).desc(), F.col("pos").asc()]
    best = papers.orderBy(*order).limit(max(least, n))
    return (best.filter(wanted) if wanted is not None else best).orderBy(*order).limit(n)


def period_keys(day: Column) -> Column:
    """The last full month and the last full ISO week before a day."""
    before = F.add_months(F.trunc(day, "month"), -1)
    monday = F.date_sub(F.date_trunc("week", day).cast("date"), 7)
    week = F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), monday), F.weekofyear(monday))
    return F.struct(F.date_format(before, "yyyy-MM").alias("last_month"), week.alias("last_week"))


def match_report(results: DataFrame) -> DataFrame:
    return results.groupBy("outcome", F.coalesce("method", F.lit("-")).alias("method")).agg(F.count("*").alias("n"))


def pending(papers: DataFrame, topics: DataFrame) -> DataFrame:
    """(id, what) of papers that lack a translation or topics."""
    untranslated = papers.filter(F.coalesce("title_zh", F.lit("")) == "").select("id", F.lit("translation").alias("what"))
    return untranslated.unionByName(papers.join(topics.select("id").distinct(), "id", "left_anti").select("id", F.lit("topics").alias("what")))


def copy_if_zh(papers: DataFrame, language: Column) -> DataFrame:
    """Papers (title, abstract, title_zh, abstract_zh) with their language; those in Chinese are their own translation."""
    known = papers.withColumn("original_language", language)
    zh = F.col("original_language") == "zh"
    return known.withColumns({f"{c}_zh": F.when(zh, F.col(c)).otherwise(F.col(f"{c}_zh")) for c in ("title", "abstract")})


# --- reports ------------------------------------------------------------------------------------------------------


def relevance_filter(reports: DataFrame, verdicts: DataFrame, filtered_sources: list[str] | None = None) -> DataFrame:
    """Reports whose verdict is not no; a missing verdict keeps, and so does a source that is not filtered."""
    joined = reports.join(verdicts.select("id", "verdict"), "id", "left")
    free = ~F.col("source").isin(filtered_sources) if filtered_sources is not None else F.lit(False)
    return joined.filter(free | F.coalesce("verdict", F.lit(True))).drop("verdict")


def default_category(categories: Column) -> Column:
    return F.when(F.coalesce(F.size(categories), F.lit(0)) <= 0, F.array(F.lit("其他"))).otherwise(categories)


def first_institution(raw: Column) -> Column:
    return F.coalesce(F.get(institutions(raw), F.lit(0)), raw)


def pdf_backfill_plan(reports: DataFrame, limit: int) -> DataFrame:
    """(id, way) of reports without a local file: those with a file address first, then those with a reader page, up to the limit."""
    some = lambda test: F.exists("pdf_urls", test)
    local = some(lambda p: F.coalesce(p["local_path"], F.lit("")) != "")
    remote = lambda p: F.coalesce(p["local_path"], F.lit("")) == ""
    is_file = lambda p: remote(p) & ~F.coalesce(p["type"] == "reader", F.lit(False)) & F.coalesce(p["url"].rlike(r"\.pdf([?#]|$)"), F.lit(False))
    way = F.when(local, "local").when(some(is_file), "http").when(some(remote), "reader")
    open_ = reports.withColumn("way", way).filter(F.col("way").isin("http", "reader"))
    return open_.orderBy((F.col("way") == "reader").asc(), "pos").limit(limit).select("id", "way")


def pdf_summary(reports: DataFrame) -> DataFrame:
    files = reports.select(F.explode("pdf_urls").alias("p"))
    return files.agg(F.count("*").alias("total"), F.count_if(F.coalesce("p.local_path", F.lit("")) != "").alias("local"))


def pdf_valid(content: Column) -> Column:
    """At least 1000 bytes that begin with the mark of a PDF."""
    return (F.length(content) >= 1000) & (F.substring(content, 1, 4) == F.lit(b"%PDF"))
