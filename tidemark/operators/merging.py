"""Duplicates by URL key and by event, folds of what they hold, and the provenance of sources."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.urls import ROLE_PRIORITY, normalize_url, with_role

MOST_IMAGES, TITLE_CHARS = 20, 60
#: Step of the classes of set sizes; holders from which a token is hot; the largest sets whose hot tokens are paired.
SIZE_STEP, HOT_TOKEN, MOST_PAIRED_TOKENS = 1.25, 64, 64


def truthy(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) != ""


def primaries(items: DataFrame, key: str = "key") -> DataFrame:
    """Per key: primary id and pos (longest content, the first on a tie), the first pos and the number of items."""
    longest = F.struct(F.length(F.coalesce("content", F.lit(""))).alias("n"), (-F.col("pos")).alias("at"))
    return items.groupBy(key).agg(F.max_by("id", longest).alias("id"), F.max_by("pos", longest).alias("primary_pos"), F.min("pos").alias("first_pos"), F.count("*").alias("n_items"))


def merge_url_duplicates(items: DataFrame) -> DataFrame:
    """One row per URL key of (pos, id, url, source_type, content[, raw_content, extraction_status]): key, id, first_pos, n_items, content.

    Equal contents of a key are one before they are gathered, so copies cost nothing. The rest is folded in order of pos: a
    successful extraction replaces the content of a primary whose own failed, other contents are appended unless contained.
    """
    has = "extraction_status" in items.columns
    keyed = items.withColumn("key", normalize_url(F.col("url")))
    keyed = keyed.withColumn("_ok", (F.col("extraction_status") == "success") if has else F.lit(False)).withColumn("_raw", F.col("raw_content") if has else F.lit(None).cast("string"))
    heads = primaries(keyed)
    alone = heads.filter("n_items = 1").join(keyed.select("key", "content"), "key").select("key", "id", "first_pos", "n_items", "content")
    parts = keyed.join(heads.filter("n_items > 1").select("key", "primary_pos"), "key")
    same = parts.groupBy("key", "content", "_ok", "_raw", F.col("pos").eqNullSafe(F.col("primary_pos")).alias("main")).agg(F.min("pos").alias("pos"), F.min_by("source_type", "pos").alias("kind"))
    gathered = same.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "main", "content", "kind", "_ok", "_raw"))).alias("parts"))
    main = F.get(F.filter("parts", lambda p: p["main"]), F.lit(0))
    start = F.struct(F.coalesce(main["content"], F.lit("")).alias("content"), F.coalesce(main["_ok"], F.lit(False)).alias("ok"))

    def add(state: Column, part: Column) -> Column:
        promoted = ~state["ok"] & F.coalesce(part["_ok"], F.lit(False))
        content = F.when(promoted, F.coalesce(part["_raw"], F.lit(""))).otherwise(state["content"])
        fresh = truthy(part["content"]) & (content != "") & ~content.contains(part["content"])
        grown = F.when(fresh, F.concat(content, F.lit("\n\n--- From "), part["kind"], F.lit(" ---\n"), part["content"])).otherwise(content)
        return F.struct(grown.alias("content"), (state["ok"] | promoted).alias("ok"))

    folded = gathered.select("key", F.aggregate(F.filter("parts", lambda p: ~p["main"]), start, add)["content"].alias("content"))
    merged = heads.filter("n_items > 1").join(folded, "key").select("key", "id", "first_pos", "n_items", "content")
    return alone.unionByName(merged)


def merge_extraction(items: DataFrame, fields: list[str], key: str = "key") -> DataFrame:
    """Per key the fields of the primary, or of the first item whose extraction succeeded if the primary's did not."""
    longest = F.struct(F.length(F.coalesce("content", F.lit(""))).alias("n"), (-F.col("pos")).alias("at"))
    ok, row = F.col("extraction_status") == "success", F.struct(*fields)
    agg = items.groupBy(key).agg(F.max_by(F.struct("extraction_status", *fields), longest).alias("own"), F.min_by(F.when(ok, row), F.when(ok, F.col("pos"))).alias("good"))
    chosen = F.when((F.col("own.extraction_status") == "success") | F.col("good").isNull(), F.struct(*(F.col(f"own.{f}") for f in fields))).otherwise(F.col("good"))
    return agg.select(key, chosen.alias("e")).select(key, "e.*")


def first_images(shown: DataFrame, key: str) -> DataFrame:
    """Per key of (key, at, place, image) up to MOST_IMAGES distinct images, by at and place."""
    first = shown.groupBy(key, "image").agg(F.min(F.struct("at", "place")).alias("order"))
    ranked = first.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy("order"))).filter(F.col("n") <= MOST_IMAGES)
    return ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "image"))), lambda x: x["image"]).alias("images"))


def merge_images(items: DataFrame, key: str = "key") -> DataFrame:
    """Per key up to MOST_IMAGES distinct images, the primary's first, then by pos and place."""
    mine = items.join(primaries(items, key).select(key, "primary_pos"), key)
    one = mine.select(key, F.when(F.col("pos") == F.col("primary_pos"), -1).otherwise(F.col("pos")).alias("at"), F.posexplode("images").alias("place", "image"))
    return first_images(one, key)


def merge_metadata(entries: DataFrame, key: str = "key") -> DataFrame:
    """(key, name, value) of entries (key, pos, is_primary, name, value): the primary's value if it says something, else the first that does, else the last."""
    says = truthy(F.col("value"))
    order = F.struct((~F.col("is_primary")).alias("other"), "pos")
    found = entries.groupBy(key, "name").agg(F.min_by(F.when(says, F.col("value")), F.when(says, order)).alias("first"), F.max_by("value", "pos").alias("last"))
    return found.select(key, "name", F.coalesce("first", "last").alias("value"))


def source_label(columns: list[str]) -> Column:
    """The most telling name of an item's source; each rule needs its column."""
    rules = [
        (("subreddit",), lambda c: F.concat(F.lit("r/"), c("subreddit"))),
        (("feed_name",), lambda c: c("feed_name")),
        (("channel",), lambda c: F.concat(F.lit("@"), c("channel"))),
        (("period", "repo"), lambda c: F.concat(F.lit("ossinsight:"), F.coalesce(F.nullif(F.col("primary_language"), F.lit("")), F.lit("all")) if "primary_language" in columns else F.lit("all"))),
        (("repo",), lambda c: c("repo")),
        (("watchlist",), lambda c: c("watchlist")),
        (("source_name",), lambda c: c("source_name")),
        (("gn_query",), lambda c: F.concat(F.lit("google_news:"), c("gn_query"))),
        (("domain",), lambda c: c("domain")),
        (("author",), lambda c: c("author")),
    ]
    chain = []
    for needed, make in rules:
        if set(needed) <= set(columns):
            there = F.lit(True)
            for c in needed:
                there = there & truthy(F.col(c))
            chain.append(F.when(there, make(F.col)))
    return F.coalesce(*chain, F.lit("unknown"))


def event_members(items: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, primary_pos, at, pos) of groups (group_id, members: array of pos): the primary at 0, and the other members that are items.

    Groups of one member or without a primary among the items, and null members, are none. Groups of any size can come as rows
    of the result's columns instead.
    """
    members = groups.filter(F.size("members") > 1).select("group_id", F.col("members")[0].alias("primary_pos"), F.posexplode("members").alias("at", "pos")) if "members" in groups.columns else groups.select("group_id", "primary_pos", "at", "pos")
    valid = members.join(items.select("pos"), "pos").join(items.select(F.col("pos").alias("primary_pos")), "primary_pos")
    return valid.filter("at = 0 OR pos != primary_pos").select("group_id", "primary_pos", "at", "pos")


def merge_event_groups(items: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(survivors, coverage) for groups as event_members takes them: the first member stays, the other valid ones go and are covered by it."""
    dropped = event_members(items, groups).filter("at > 0")
    return items.join(dropped.select("pos").distinct(), "pos", "left_anti"), dropped.select("group_id", "primary_pos", F.col("pos").alias("covered_pos"))


def merge_events(items: DataFrame, groups: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """The survivors of items (pos, content, source_type[, images]) with what they cover folded into them; other columns are kept.

    In order of groups and members, contents are appended under their source type unless contained, and images (distinct, at
    most MOST_IMAGES) follow the primary's. ``facts`` (group_id, facts) adds ``merged_facts``, those of all groups of a primary.
    Equal contents of a primary are one, and those that its own content holds are gone, before any are gathered; what is
    gathered is what the merged content can hold. Members bring their own content only: groups are not chained.
    """
    members = event_members(items, groups)
    covered = members.filter("at > 0").withColumn("place", F.struct("group_id", "at"))
    kept = items.join(covered.select("pos").distinct(), "pos", "left_anti")
    own = items.select(F.col("pos").alias("primary_pos"), F.coalesce("content", F.lit("")).alias("own"))
    parts = covered.join(items.select("pos", "content", "source_type").filter(truthy(F.col("content"))), "pos")
    first = parts.groupBy("primary_pos", "content").agg(F.min("place").alias("place"), F.min_by("source_type", "place").alias("kind"))
    fresh = first.join(own, "primary_pos").filter(~F.col("own").contains(F.col("content")))
    gathered = fresh.groupBy("primary_pos").agg(F.first("own").alias("own"), F.array_sort(F.collect_list(F.struct("place", "kind", "content"))).alias("parts"))
    label = lambda p: F.concat(F.lit("\n\n--- From "), F.coalesce(p["kind"], F.lit("unknown")), F.lit(" ---\n"))
    grown = F.aggregate("parts", F.col("own"), lambda text, p: F.when(text.contains(p["content"]), text).otherwise(F.concat(text, label(p), p["content"])))
    merged = kept.join(gathered.select(F.col("primary_pos").alias("pos"), grown.alias("_grown")), "pos", "left")
    merged = merged.withColumn("content", F.coalesce("_grown", "content")).drop("_grown")
    if "images" in items.columns:
        mine = covered.select("primary_pos", "place", "pos").join(items.select("pos", "images"), "pos").select("primary_pos", F.lit(1).alias("other"), "place", "images")
        heads = covered.select("primary_pos").distinct().join(items.select(F.col("pos").alias("primary_pos"), "images"), "primary_pos")
        shown = mine.unionByName(heads.select("primary_pos", F.lit(0).alias("other"), F.lit(None).cast(covered.schema["place"].dataType).alias("place"), "images"))
        one = shown.select("primary_pos", F.struct("other", "place").alias("at"), F.posexplode("images").alias("place", "image"))
        merged = merged.join(first_images(one, "primary_pos").select(F.col("primary_pos").alias("pos"), F.col("images").alias("_images")), "pos", "left")
        merged = merged.withColumn("images", F.coalesce("_images", "images")).drop("_images")
    if facts is not None:
        told = members.filter("at = 0").select("group_id", "primary_pos").join(facts.select("group_id", "facts").filter("facts IS NOT NULL"), "group_id")
        listed = told.groupBy("primary_pos").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("group_id", "facts"))), lambda t: t["facts"])).alias("merged_facts"))
        merged = merged.join(listed.withColumnRenamed("primary_pos", "pos"), "pos", "left")
    return merged


def event_sources(items: DataFrame, groups: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Source entries of each group's members, of items (pos, url, title, source_type, label): group_id, primary_pos, at, pos, label, url, role, title, is_primary.

    The entries with the URL of the most authoritative one, the first on a tie, are primary. ``answers`` (primary_pos, url,
    role) are a model's own roles; they count for the entry of the group's primary if the URL is its.
    """
    entries = with_role(event_members(items, groups).join(items.select("pos", "url", "title", "source_type", "label"), "pos"))
    if answers is not None:
        said = answers.groupBy("primary_pos", "url").agg(F.max("role").alias("said")).withColumn("at", F.lit(0))
        entries = entries.join(said, ["primary_pos", "url", "at"], "left").withColumn("role", F.coalesce("said", "role")).drop("said")
    priority = F.create_map(*(F.lit(x) for pair in ROLE_PRIORITY.items() for x in pair))
    ranked = entries.withColumn("_order", F.struct(F.coalesce(priority[F.col("role")], F.lit(10)).alias("n"), "at"))
    best = ranked.groupBy("group_id").agg(F.min_by("url", "_order").alias("best"))
    marked = ranked.join(best, "group_id").withColumn("is_primary", F.col("url").eqNullSafe(F.col("best")))
    return marked.select("group_id", "primary_pos", "at", "pos", "label", "url", "role", "title", "source_type", "is_primary")


def size_class(n: Column) -> Column:
    """Sizes in steps of SIZE_STEP."""
    return F.floor(F.log(n.cast("double")) / math.log(SIZE_STEP)).cast("int")


def _meeting_keys(sets: DataFrame, percent: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """(smaller, larger): keys under which sets (rep, n, order: array of (place, df, token)) meet as the smaller or the larger of two.

    A pair is looked for in the class of its smaller size, which gives the overlap it needs. Where that is two or more, both
    share two tokens within one place more than a single one would take: a token with at most ``hot`` holders is a key by
    itself, and hot ones are keys only two by two. So what meets under a single token is bounded for each set.
    """
    share = lambda both: F.ceil(both * percent / (100 + percent))
    least = F.floor(F.pow(F.lit(SIZE_STEP), "class"))
    deep = (share(2 * least) >= 2) & (F.col("n") <= MOST_PAIRED_TOKENS)
    smaller = sets.withColumn("class", size_class(F.col("n"))).withColumn("need", share(2 * F.col("n")))
    larger = sets.withColumn("class", F.explode(F.sequence(size_class(F.ceil(F.col("n") * percent / 100)), size_class(F.col("n"))))).withColumn("need", share(F.col("n") + least))

    def keyed(rows: DataFrame) -> DataFrame:
        reach = F.col("n") - F.col("need") + 1 + deep.cast("int")
        rows = rows.withColumn("deep", deep).withColumn("near", F.filter("order", lambda t: t["place"] <= reach))
        single = F.transform(F.filter("near", lambda t: ~F.col("deep") | (t["df"] <= hot)), lambda t: F.xxhash64(t["token"]))
        rows = rows.withColumn("hot", F.filter("near", lambda t: F.col("deep") & (t["df"] > hot)))
        pairs = F.flatten(F.transform("hot", lambda t, k: F.transform(F.slice("hot", k + 2, F.size("hot")), lambda u: F.xxhash64(t["token"], u["token"]))))
        return rows.withColumn("key", F.explode(F.concat(single, pairs))).select("class", "key", "rep", "n", "s0", "s1")

    return keyed(smaller), keyed(larger)


def event_candidates(items: DataFrame, percent: int = 50, hot: int = HOT_TOKEN) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): classes of items (id, tokens) with equal token sets, and pairs of class representatives whose Jaccard similarity reaches the percentage.

    Tokens are ordered by frequency, the rarest first. Sets meet under early tokens, frequent ones only two by two (see
    _meeting_keys), and a parity sketch of 128 bits, whose differing bits no two sets can exceed by fewer differing tokens,
    refutes most of what meets in the join. Sets of more than MOST_PAIRED_TOKENS tokens meet under single tokens only.
    """
    sets = items.select("id", F.array_sort(F.array_distinct("tokens")).alias("tokens")).filter(F.size("tokens") > 0)
    reps = sets.groupBy("tokens").agg(F.min("id").alias("rep"))
    members = sets.join(reps, "tokens")
    hashes = F.transform("tokens", lambda t: F.pmod(F.xxhash64(t), F.lit(128)).cast("int"))
    odd = lambda half: F.aggregate(hashes, F.lit(0).cast("long"), lambda bits, h: F.when(F.floor(h / 64) == half, bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), h % 64))).otherwise(bits))
    shown = reps.select("rep", F.size("tokens").alias("n"), odd(0).alias("s0"), odd(1).alias("s1"), F.explode("tokens").alias("token"))
    counted = shown.join(shown.groupBy("token").agg(F.count("*").alias("df")), "token")
    ranked = F.transform(F.array_sort(F.collect_list(F.struct("df", "token"))), lambda t, k: F.struct((k + 1).alias("place"), t["df"].alias("df"), t["token"].alias("token")))
    ordered = counted.groupBy("rep", "n", "s0", "s1").agg(F.filter(ranked, lambda t: t["df"] > 1).alias("order"))
    smaller, larger = _meeting_keys(ordered, percent, hot)
    x, y = smaller.alias("x"), larger.alias("y")
    sizes = F.col("x.n") + F.col("y.n")
    differ = F.bit_count(F.col("x.s0").bitwiseXOR(F.col("y.s0"))) + F.bit_count(F.col("x.s1").bitwiseXOR(F.col("y.s1")))
    near = (100 + percent) * differ <= (100 - percent) * sizes
    once = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.rep") < F.col("y.rep")))
    met = x.join(y, (F.col("x.class") == F.col("y.class")) & (F.col("x.key") == F.col("y.key")) & once & near)
    pairs = met.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()
    both = pairs.join(reps.select(F.col("rep").alias("a"), F.col("tokens").alias("ta")), "a").join(reps.select(F.col("rep").alias("b"), F.col("tokens").alias("tb")), "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    union = F.size("ta") + F.size("tb") - shared
    found = both.withColumn("shared", shared).withColumn("total", union).filter(100 * F.col("shared") >= percent * F.col("total"))
    return found.select("a", "b", "shared", "total"), members.select("id", "rep")


def source_attribution(entries: DataFrame, key: str = "key") -> DataFrame:
    """Per item the distinct source URLs of entries (key, pos, url, title, role), most authoritative first: place, is_primary, source_count, short title."""
    first = entries.groupBy(key, "url").agg(F.min_by(F.struct("pos", "title", "role"), "pos").alias("e")).select(key, "url", "e.*")
    priority = F.create_map(*(F.lit(x) for pair in ROLE_PRIORITY.items() for x in pair))
    ranked = first.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(F.coalesce(priority[F.col("role")], F.lit(10)), "pos")))
    count = F.count("*").over(W.partitionBy(key))
    short = F.when(F.length("title") > TITLE_CHARS, F.concat(F.substring("title", 1, TITLE_CHARS - 3), F.lit("..."))).otherwise(F.col("title"))
    return ranked.select(key, "url", "place", (F.col("place") == 1).alias("is_primary"), count.alias("source_count"), short.alias("title"))


def dedup_by_id_last(rows: DataFrame) -> DataFrame:
    """Of rows with one id the last by pos stays."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy(F.desc("pos")))).filter("_n = 1").drop("_n")
