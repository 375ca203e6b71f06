"""Connected components by alternating large-star and small-star rounds.

A centre that many edges name is joined by salts, so that no task gets all of its neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_keys, spread_join


def components(edges: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """(id, component) for every node of an edge between two nodes; the component is its smallest node. rows says about
    how many edges there are.

    Nulls and loops link nothing; an empty edge table gives an empty result.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    now, seen = cut(now, rows), None
    while True:
        mark = tuple(now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).head())
        if mark == seen or mark[0] == 0:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        seen, n = mark, mark[0]
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        large = spread_join(both.where("v > u"), least.drop("n"), ["u"], hot_keys(least.select("u", "n"), "n", 2 * n), "v").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = large.union(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, low.drop("n"), ["u"], hot_keys(low.select("u", "n"), "n", 2 * n), "v").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct(), n)
