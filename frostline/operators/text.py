"""Sparse text vectors as long tables (item, term, w)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import tokens


def term_counts(titles: DataFrame) -> DataFrame:
    """(item, term, tf)."""
    return titles.select("item", F.explode(tokens("title")).alias("term")).groupBy("item", "term").agg(F.count("*").alias("tf"))


def document_frequency(counts: DataFrame, items: DataFrame) -> DataFrame:
    """(term, df) over the given items."""
    return counts.join(items, "item", "left_semi").groupBy("term").agg(F.count("*").alias("df"))


def inverse_frequency(counts: DataFrame, items: DataFrame, min_df: int) -> DataFrame:
    """(term, df, idf): ln((1 + N) / (1 + df)) + 1 with N counting all items, those without terms too."""
    return weighed(document_frequency(counts, items), items, min_df)


def weighed(frequency: DataFrame, items: DataFrame, min_df: int) -> DataFrame:
    """inverse_frequency from (term, df) over the items."""
    n = items.agg(F.count("*").cast("double").alias("n"))
    kept = frequency.where(F.col("df") >= min_df)
    return kept.crossJoin(F.broadcast(n)).select("term", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))  # n is one row


def vectors(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """(item, term, w): (1 + ln tf) * idf at unit length; items without known terms have no rows."""
    raw = counts.join(idf, "term").select("item", "term", ((F.log("tf") + 1) * F.col("idf")).alias("w"))
    return unit(raw, "item", "w")


def unit(df: DataFrame, key: str, value: str) -> DataFrame:
    size = F.sqrt(F.sum(F.col(value) * F.col(value)).over(Window.partitionBy(key)))
    return df.withColumn(value, F.col(value) / size)


def packed(item_vectors: DataFrame) -> DataFrame:
    """(item, v): a vector's terms and weights in one row, so that a history's vectors move as a row an item."""
    return item_vectors.groupBy("item").agg(F.collect_list(F.struct("term", "w")).alias("v"))


def profile_sums(history: DataFrame, item_vectors: DataFrame) -> DataFrame:
    """(uid, term, w): the sum of the vectors of a history, repeats counting as often as they occur.

    Histories are counted per item first, so that the join carries each pair once; a user's vectors then lie in one
    partition, and everything that is grouped by user stays there.
    """
    counted = history.groupBy("uid", "item").agg(F.count("*").alias("n"))
    rows = counted.join(packed(item_vectors), "item").repartition("uid")
    return rows.select("uid", "n", F.inline("v")).groupBy("uid", "term").agg(F.sum(F.col("n") * F.col("w")).alias("w"))


def profiles(history: DataFrame, item_vectors: DataFrame) -> DataFrame:
    """(uid, term, w): the unit sum of the vectors of a history."""
    return unit(profile_sums(history, item_vectors), "uid", "w")


def sizes(sums: DataFrame) -> DataFrame:
    """(uid, size): the length of each sum."""
    return sums.groupBy("uid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))


def scores(sums: DataFrame, item_vectors: DataFrame, candidates: DataFrame) -> DataFrame:
    """(uid, item, score) of the pairs that share a term: cosines of the sums of profile_sums with the candidates.

    A sum meets the candidates' weights by term, and itself under no item, so that one pass gives products and length.
    """
    pool = item_vectors.join(candidates, "item", "left_semi").groupBy("term").agg(F.collect_list(F.struct("item", F.col("w").alias("c"))).alias("cs"))
    own = F.array(F.struct(F.lit(None).cast(item_vectors.schema["item"].dataType).alias("item"), F.col("w").alias("c")))
    rows = sums.join(pool, "term", "left").select("uid", "w", F.inline(F.when(F.col("cs").isNull(), own).otherwise(F.concat(own, F.col("cs")))))
    dots = rows.groupBy("uid", "item").agg(F.sum(F.col("w") * F.col("c")).alias("dot"))
    size = F.sqrt(F.max(F.when(F.col("item").isNull(), F.col("dot"))).over(Window.partitionBy("uid")))
    return dots.withColumn("size", size).where(F.col("item").isNotNull()).select("uid", "item", (F.col("dot") / F.col("size")).alias("score"))


def densified(scored: DataFrame, users: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every user with every candidate; pairs without a score have 0. The full pool is the query itself."""
    pool = users.select("uid").crossJoin(candidates.select("item"))
    return pool.join(scored, ["uid", "item"], "left").select("uid", "item", F.round(F.coalesce("score", F.lit(0.0)), 9).alias("score"))
