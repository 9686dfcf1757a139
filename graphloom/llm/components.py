"""Connected components of links, by DataFrame joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.tables import drop, written


def salted(rows: DataFrame, key: str, table: DataFrame, spread: str, parts: int = 64, how: str = "inner") -> DataFrame:
    """rows joined to table, which has one row a key, where many rows may share a key: each key is looked up once for each of
    the parts that hashes of `spread` deal its rows to, and joined to that part's."""
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(parts)).cast("int"))
    found = dealt.select(key, "_part").distinct().join(table, key)
    return dealt.join(found, [key, "_part"], how).drop("_part")


def components(links: DataFrame) -> DataFrame:
    """links (a, b: long) -> (node, root): root is the least node that links lead to. Nodes without links have no row.

    Alternates large and small stars: each node's larger neighbours, then its smaller ones and itself, are linked to
    the least node seen. Links become stars around each component's least node in a few rounds, each of two
    aggregations by node (combined before the shuffle, so a hub costs no more) and joins in which a hub's links are split.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = salted(both.where("v > u"), "u", least, "v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = salted(large, "u", least, "v")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = written(small)
        # a star graph: no node that another points at points further
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(edges)
        edges = after
        if state == seen or state[0] == 0:
            break
        seen = state
    return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
