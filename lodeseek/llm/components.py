"""Connected components of a distributed edge list: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.common import Work


def components(edges: DataFrame, work: Work, name: str = "components") -> DataFrame:
    """(node, root): root is the smallest node reachable, for each node of edges (a, b) that is not its own root.

    Each round moves every neighbour of a node to the smallest one: the aggregate combines before its shuffle, and its
    result is a written table, so that the join with it has two plain shuffles, which Spark can split where a node has
    very many neighbours. Rounds are written tables; they end when a round changes nothing.
    """
    now = work.table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-0")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    before, i = mark(now), 0
    while before[0]:
        # large-star: neighbours larger than a node move to its smallest neighbour (or itself)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = work.table(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{name}-{i}-least")
        large = both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = work.table(large.where("a <> b").distinct(), f"{name}-{i}-large")
        # small-star: a node and its smaller neighbours move to the smallest of them
        least = work.table(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-{i}-low")
        small = large.join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        i += 1
        now = work.table(small.where("a <> b").distinct(), f"{name}-{i}")
        work.drop(*(f"{name}-{i - 1}{x}" for x in ("", "-least", "-large", "-low")))
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
