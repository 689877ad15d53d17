"""Composable reads: filters, search, pages, facets and joins to topics and user state. All are lazy plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SORTS = {"score": lambda: [F.coalesce("ai_score", F.lit(0.0)).desc(), F.col("id").asc()], "newest": lambda: [F.col("published_sec").desc(), F.col("id").asc()], "title": lambda: [F.col("title").asc(), F.col("id").asc()]}


def get_items(items: DataFrame, *, day: int | None = None, category: str | None = None, source_type: str | None = None, min_score: float | None = None, selected: bool | None = None, tag: str | None = None, tags: DataFrame | None = None, search: str | None = None, blocked: DataFrame | None = None) -> DataFrame:
    """Items that meet all given filters. A search takes precedence over a tag."""
    for column, value in (("day", day), ("category", category), ("source_type", source_type), ("selected", selected)):
        if value is not None:
            items = items.filter(F.col(column) == F.lit(value))
    if min_score is not None:
        items = items.filter(F.col("ai_score") >= min_score)
    if search:
        items = items.filter(matches(search, "title", "text"))
    elif tag is not None and tags is not None:
        items = items.join(tags.filter(F.col("tag") == tag).select("id"), "id", "left_semi")
    return without_blocked(items, blocked) if blocked is not None else items


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def matches(search: str, *columns: str) -> Column:
    """Any column holds the text; only ASCII letters match in either case, and no character is a wildcard."""
    wanted, found = ascii_lower(F.lit(search)), F.lit(False)
    for c in columns:
        found = found | ascii_lower(F.coalesce(F.col(c), F.lit(""))).contains(wanted)
    return found


def like(search: str, *columns: str) -> Column:
    """As matches, but % and _ are wildcards."""
    pattern, found = ascii_lower(F.lit(f"%{search}%")), F.lit(False)
    for c in columns:
        found = found | F.like(ascii_lower(F.coalesce(F.col(c), F.lit(""))), pattern)
    return found


def fulltext(items: DataFrame, search: str, *columns: str) -> DataFrame:
    """A search of at least three characters; a shorter one finds nothing."""
    return items.filter(matches(search, *columns)) if len(search) >= 3 else items.filter(F.lit(False))


def page(found: DataFrame, sort: str, number: int, size: int) -> DataFrame:
    """One page in a listed order, each row with the total and the number of pages (at least 1)."""
    order = SORTS[sort if sort in SORTS else "score"]()
    total = found.agg(F.count("*").alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long"))
    return found.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))


CURSORS = {"score": lambda: (F.coalesce("ai_score", F.lit(0.0)), "double", True), "newest": lambda: (F.col("published_sec"), "bigint", True), "title": lambda: (F.coalesce("title", F.lit("")), "string", False)}


def page_after(found: DataFrame, sort: str, size: int, cursor: tuple | None = None) -> DataFrame:
    """The page that follows ``cursor``, the (key, id) of the last row before it, or the first page; adds ``cursor_key``.

    The order is that of ``page``, equal keys by id, with missing scores as 0 and missing titles as empty. What lies before the
    cursor is filtered out where it is scanned, so a deep page sorts no more rows than the first. ``published_sec`` may not be null.
    """
    key, kind, falling = CURSORS[sort if sort in CURSORS else "score"]()
    if cursor is not None:
        last, at = F.lit(cursor[0]).cast(kind), F.lit(cursor[1])
        beyond = key < last if falling else key > last
        found = found.filter(beyond | ((key == last) & (F.col("id") > at)))
    return found.withColumn("cursor_key", key).orderBy(F.desc("cursor_key") if falling else F.asc("cursor_key"), "id").limit(size)


def without_blocked(items: DataFrame, blocked: DataFrame) -> DataFrame:
    """Items that are not under any blocked topic; blocked has their ids."""
    return items.join(blocked.select("id"), "id", "left_anti")


def with_topics(items: DataFrame, bridge: DataFrame, topics: DataFrame) -> DataFrame:
    """Adds ``topics``: the ordered names of each item's topics, an empty list without any."""
    named = bridge.join(topics.select("topic", "name"), "topic")
    lists = named.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("topic", "name"))).alias("t"))
    return items.join(lists, "id", "left").withColumn("topics", F.coalesce(F.transform("t", lambda t: t["name"]), F.array().cast("array<string>"))).drop("t")


def tag_counts(tags: DataFrame, least: int = 1) -> DataFrame:
    return tags.groupBy("tag").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def category_counts(items: DataFrame) -> DataFrame:
    """Null and empty categories are counted apart, and both shown as unknown."""
    return items.groupBy("category").agg(F.count("*").alias("n")).select(F.when(F.coalesce("category", F.lit("")) == "", "unknown").otherwise(F.col("category")).alias("category"), "n")


def stats(items: DataFrame) -> DataFrame:
    """Count, mean to two places (null if 0), maximum and number of sources."""
    mean = F.bround(F.avg("ai_score"), 2)
    return items.agg(F.count("*").alias("total"), F.nullif(mean, F.lit(0.0)).alias("avg_score"), F.max("ai_score").alias("max_score"), F.countDistinct("source_type").alias("sources"))


def latest(rows: DataFrame, column: str, n: int) -> DataFrame:
    return rows.select(column).distinct().orderBy(F.desc(column)).limit(n)


def topics_with_counts(topics: DataFrame, bridge: DataFrame, items: DataFrame) -> DataFrame:
    """Active topics with the number of selected items, 0 too: the selection is made before the outer join."""
    used = bridge.join(items.filter("selected").select("id"), "id").groupBy("topic").agg(F.count("*").alias("n"))
    return topics.filter("is_active").join(used, "topic", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def nest_by_group(topics: DataFrame) -> DataFrame:
    return topics.groupBy("group_name").agg(F.array_sort(F.collect_list(F.struct("topic", "name", "n"))).alias("topics"))


def filter_blocked_groups(groups: DataFrame, blocked: list[int]) -> DataFrame:
    """Nested topics without the blocked ones, and without groups that are then empty."""
    kept = groups.withColumn("topics", F.filter("topics", lambda t: ~t["topic"].isin(blocked)))
    return kept.filter(F.size("topics") > 0)


def topic_items(items: DataFrame, bridge: DataFrame, topic: int, blocked: list[int]) -> DataFrame:
    """Selected items of a topic; none if it is blocked."""
    wanted = bridge.filter((F.col("topic") == topic) & F.lit(topic not in blocked)).select("id")
    return items.filter("selected").join(wanted, "id", "left_semi")


def month_counts(rows: DataFrame, ts: str) -> DataFrame:
    return rows.groupBy(F.date_format(ts, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


SEPARATORS = r"\s*[&,、;；]\s*"


def institutions(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, SEPARATORS), lambda x: F.trim(x)), lambda x: x != "")


def institution_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(F.explode(institutions(F.col(column))).alias("institution"), "source").groupBy("institution", "source").agg(F.count("*").alias("n"))


def mean_score_label(page_rows: DataFrame) -> DataFrame:
    """The mean of scores that are neither null nor 0, to one place; a dash without any."""
    mean = F.avg(F.when(F.col("ai_score") != 0, F.col("ai_score")))
    return page_rows.agg(F.coalesce(F.format_number(mean, 1), F.lit("—")).alias("mean_score"))


def global_search(search: str, kinds: dict[str, tuple[DataFrame, list[str]]], size: int) -> DataFrame:
    """The first rows of each kind that match, as (kind, id, place)."""
    found = None
    for kind, (rows, columns) in kinds.items():
        first = rows.filter(matches(search, *columns)).select("id").orderBy("id").limit(size)
        numbered = first.select(F.lit(kind).alias("kind"), "id", F.row_number().over(W.orderBy("id")).alias("place"))
        found = numbered if found is None else found.unionByName(numbered)
    return found


# --- user state ---------------------------------------------------------------------------------------------------


def latest_state(events: DataFrame, keys: list[str], state: str, order: list[str]) -> DataFrame:
    """The last state per key; later events win whatever came before, so repeats change nothing."""
    return events.groupBy(*keys).agg(F.max_by(state, F.struct(*order)).alias(state))


def favorites_of(events: DataFrame) -> DataFrame:
    """(user_id, item_id, sec) still marked by events (user_id, item_id, action, sec, event_id)."""
    last = events.groupBy("user_id", "item_id").agg(F.max_by(F.struct("action", "sec"), F.struct("sec", "event_id")).alias("s"))
    return last.filter("s.action = 'add'").select("user_id", "item_id", F.col("s.sec").alias("sec"))


def flag_favorited(items: DataFrame, favorites: DataFrame, user: int | None) -> DataFrame:
    """Adds ``favorited`` for a user; without one nothing is added."""
    if user is None:
        return items
    mine = favorites.filter(F.col("user_id") == user).select(F.col("item_id").alias("id"), F.lit(True).alias("favorited"))
    return items.join(mine, "id", "left").withColumn("favorited", F.coalesce("favorited", F.lit(False)))


def subscribers(messages: DataFrame) -> DataFrame:
    """Addresses whose last exact SUBSCRIBE or UNSUBSCRIBE was the former; senders that take no answers are skipped."""
    wanted = messages.withColumn("word", F.upper(F.trim("subject"))).filter(F.col("word").isin("SUBSCRIBE", "UNSUBSCRIBE") & ~F.lower("sender").rlike("no-?reply"))
    last = latest_state(wanted.withColumn("sender", F.lower("sender")), ["sender"], "word", ["sec", "event_id"])
    return last.filter("word = 'SUBSCRIBE'").select("sender")


def usage_by_provider(log: DataFrame) -> DataFrame:
    """Tokens per provider; rows without any are ignored and negative counts are 0."""
    kept = log.filter("tokens_in > 0 OR tokens_out > 0")
    positive = lambda c: F.sum(F.greatest(F.lit(0), F.col(c))).alias(c)
    return kept.groupBy("provider").agg(positive("tokens_in"), positive("tokens_out"), F.count("*").alias("calls"))
