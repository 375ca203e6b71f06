"""Why an item is recommended, and what-if rankings from words or chosen histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import tokens
from .text import unit


def contributions(profile: DataFrame, item_vectors: DataFrame, pairs: DataFrame, limit: int = 3) -> DataFrame:
    """(uid, item, place, term, contribution): the terms that add most to a pair's score, ties by term."""
    parts = pairs.select("uid", "item").join(item_vectors.withColumnRenamed("w", "c"), "item").join(profile, ["uid", "term"])
    rows = parts.select("uid", "item", "term", F.round(F.col("w") * F.col("c"), 9).alias("contribution"))
    place = F.row_number().over(Window.partitionBy("uid", "item").orderBy(F.desc("contribution"), "term")).cast("long")
    return rows.withColumn("place", place).where(F.col("place") <= limit).select("uid", "item", "place", "term", F.round("contribution", 6).alias("contribution"))


def query_vector(queries: DataFrame, idf: DataFrame) -> DataFrame:
    """(query, term, w) of (query, words): unit TF-IDF of the known words."""
    tf = queries.select("query", F.explode(tokens("words")).alias("term")).groupBy("query", "term").agg(F.count("*").alias("tf"))
    return unit(tf.join(idf, "term").select("query", "term", ((F.log("tf") + 1) * F.col("idf")).alias("w")), "query", "w")


def simulate(query: DataFrame, item_vectors: DataFrame, candidates: DataFrame, limit: int = 10) -> DataFrame:
    """(query, place, item, score): positive scores only, ties by item; no shuffle order here."""
    pool = item_vectors.join(candidates, "item", "left_semi").withColumnRenamed("w", "c")
    scored = query.join(pool, "term").groupBy("query", "item").agg(F.round(F.sum(F.col("w") * F.col("c")), 9).alias("score")).where("score > 0")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "item")).cast("long")
    return scored.withColumn("place", place).where(F.col("place") <= limit).select("query", "place", "item", "score")


def history_query(chosen: DataFrame, item_vectors: DataFrame) -> DataFrame:
    """(query, term, w) of (query, item): the unit sum of the chosen items' vectors."""
    return unit(chosen.join(item_vectors, "item").groupBy("query", "term").agg(F.sum("w").alias("w")), "query", "w")


def evidence(results: DataFrame, chosen: DataFrame, item_vectors: DataFrame) -> DataFrame:
    """results with the chosen item that scores most with each, the earliest chosen on ties."""
    own = chosen.join(item_vectors.withColumnRenamed("w", "h"), "item").select("query", F.col("item").alias("evidence"), "pos", "term", "h")
    parts = results.select("query", "item").join(item_vectors, "item").join(own, ["query", "term"])
    scored = parts.groupBy("query", "item", "evidence", "pos").agg(F.round(F.sum(F.col("w") * F.col("h")), 9).alias("s"))
    pairs = results.select("query", "item").join(chosen.select("query", F.col("item").alias("evidence"), "pos"), "query").join(scored, ["query", "item", "evidence", "pos"], "left")
    best = pairs.groupBy("query", "item").agg(F.max(F.struct(F.coalesce("s", F.lit(0.0)).alias("s"), (-F.col("pos")).alias("p"), "evidence")).alias("m"))
    return results.join(best, ["query", "item"]).select("query", "place", "item", "score", F.col("m.evidence").alias("evidence"), F.round("m.s", 6).alias("evidence_score"))


def quota_sample(eligible: DataFrame, topics: list[str], quota: int, salt: str) -> DataFrame:
    """(topic, item, place): per topic in turn the first items by hash that no earlier topic took.

    One pass a topic, since later topics depend on what earlier ones took; topics are a short fixed list.
    """
    taken, out = None, None
    for topic in topics:
        free = eligible.where(F.col("topic") == topic).select("topic", "item").distinct()
        if taken is not None:
            free = free.join(taken, "item", "left_anti")
        h = F.sha2(F.concat_ws(":", F.lit(salt), F.col("topic"), F.col("item").cast("string")).cast("binary"), 256)
        got = free.withColumn("h", h).orderBy("h").limit(quota).withColumn("place", F.row_number().over(Window.partitionBy("topic").orderBy("h")).cast("long")).drop("h")
        out = got if out is None else out.unionByName(got)
        taken = out.select("item")
    return out


def search(catalog: DataFrame, words: str, topic: str) -> DataFrame:
    """Rows of catalog (title, topic, ...) whose title has the words, in any case; without words, those of the topic."""
    asked = words.strip().lower()
    return catalog.where(F.contains(F.lower("title"), F.lit(asked)) if asked else F.col("topic") == topic)


def stratified(rows: DataFrame, strata: list[str], by: str, key: str, salt: str, expected: list[tuple] = ()) -> DataFrame:
    """(*strata, key): per stratum the key of least hash; a stratum of `expected` that has no rows is an error."""
    h = F.sha2(F.concat(F.lit(f"{salt}:"), F.col(by).cast("string")).cast("binary"), 256)
    picked = rows.groupBy(*strata).agg(F.min(F.struct(h.alias("h"), key)).alias("m")).select(*strata, F.col(f"m.{key}").alias(key))
    if expected:
        got = {tuple(r) for r in picked.select(*strata).collect()}  # a row a stratum
        if missing := sorted(set(expected) - got, key=str):
            raise ValueError(f"empty strata: {missing}")
    return picked
