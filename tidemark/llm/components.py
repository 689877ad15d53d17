"""Connected components by contraction; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop, table


def components(links: DataFrame) -> tuple[DataFrame, str]:
    """(node, label) for every node of the undirected ``links`` (a, b) that differ, label one node of its component; and its path.

    Each round a node takes the name that comes first in that round's random order among its own and those next to it;
    links are then renamed and those inside one name go, so that the next round reads only what is still apart. A star is
    one name after one round, a chain halves. The rounds' names are put together at the end, the shortest tables first.
    No row holds a neighbourhood: a node of any degree only feeds a minimum that is combined before the shuffle. A table
    without links gives no rows.
    """
    apart, apart_path = table(links.filter(F.col("a") != F.col("b")).select("a", "b"), "apart")
    rounds: list[tuple[DataFrame, str]] = []
    while True:

        def drawn(name: str, turn: int = len(rounds)):
            return F.struct(F.xxhash64(name, F.lit(turn)).alias("draw"), F.col(name).alias("name"))

        ends = apart.select(F.col("a").alias("node"), F.col("b").alias("next")).union(apart.select("b", "a"))
        first = ends.groupBy("node").agg(F.min(drawn("next")).alias("first"))
        rounds.append(table(first.select("node", F.least("first", drawn("node"))["name"].alias("label")), "names"))
        of_a = rounds[-1][0].select(F.col("node").alias("a"), F.col("label").alias("name_a"))
        of_b = rounds[-1][0].select(F.col("node").alias("b"), F.col("label").alias("name_b"))
        named = apart.join(of_a, "a").join(of_b, "b").filter(F.col("name_a") != F.col("name_b"))
        left, left_path = table(named.select(F.least("name_a", "name_b").alias("a"), F.greatest("name_a", "name_b").alias("b")).distinct(), "apart")
        drop(links.sparkSession, apart_path)
        apart, apart_path = left, left_path
        if apart.isEmpty():
            break
    labels = rounds[-1][0]
    for earlier, _ in rounds[-2::-1]:
        later = labels.select(F.col("node").alias("of"), F.col("label").alias("later"))
        labels = earlier.join(later, F.col("label") == F.col("of"), "left").select("node", F.coalesce("later", "label").alias("label"))
    labels, path = table(labels, "labels")
    drop(links.sparkSession, apart_path, *(earlier for _, earlier in rounds))
    return labels, path
