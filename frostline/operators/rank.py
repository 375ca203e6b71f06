"""Orders of candidates by user, and what is measured on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import PROTOCOL
from ..functions.core import shuffle_key


def ranked(scored: DataFrame, seed: int = PROTOCOL.seed) -> DataFrame:
    """Adds 1-based `rank`: descending score, ties in the user's reproducible random order."""
    order = Window.partitionBy("uid").orderBy(F.desc("score"), shuffle_key(seed, F.col("uid"), F.col("item")), "item")
    return scored.withColumn("rank", F.row_number().over(order).cast("long"))


def random_order(users: DataFrame, candidates: DataFrame, seed: int = PROTOCOL.seed) -> DataFrame:
    pool = users.select("uid").crossJoin(candidates.select("item"))
    return ranked(pool.withColumn("score", F.lit(0.0)), seed)


def gain(rank) -> Column:
    return F.lit(1.0) / F.log2(rank + F.lit(1.0))


def ideal(n) -> Column:
    """The gain of n hits at ranks 1 .. n."""
    return F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.lit(0.0), lambda s, i: s + gain(i))


def user_metrics(ranks: DataFrame, positives: DataFrame, ks=PROTOCOL.ks, extra: tuple[str, ...] = ()) -> DataFrame:
    """(uid, *extra, k, recall, ndcg, hit) of every user with positives. Ranks that no positive has don't travel."""
    targets = positives.groupBy("uid").agg(F.count("*").alias("t"))
    hits = ranks.where(F.col("rank") <= max(ks)).join(positives, ["uid", "item"]).groupBy("uid", *extra).agg(
        *[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks], *[F.sum(F.when(F.col("rank") <= k, gain(F.col("rank")))).alias(f"d{k}") for k in ks]
    )
    if extra:
        groups = ranks.select(*extra).distinct()
        targets = targets.crossJoin(F.broadcast(groups))  # a grid's few settings
    rows = targets.join(hits, ["uid", *extra], "left")
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(f"h{k}", F.lit(0)).alias("h"), F.coalesce(f"d{k}", F.lit(0.0)).alias("d")) for k in ks])
    flat = rows.select("uid", *extra, "t", F.inline(each))
    return flat.select("uid", *extra, "t", "k", (F.col("h") / F.col("t")).alias("recall"), (F.col("d") / ideal(F.least("t", "k"))).alias("ndcg"), (F.col("h") > 0).cast("double").alias("hit"))


def averages(per_user: DataFrame, *by: str) -> DataFrame:
    """(*by, users, recall, ndcg, hit_rate), rounded: means over all users."""
    return per_user.groupBy(*by).agg(F.count("*").alias("users"), *[F.round(F.avg(c), 6).alias(n) for c, n in (("recall", "recall"), ("ndcg", "ndcg"), ("hit", "hit_rate"))])


def metrics(ranks: DataFrame, positives: DataFrame, ks=PROTOCOL.ks) -> DataFrame:
    return averages(user_metrics(ranks, positives, ks), "k")


def top_sets(ranks: DataFrame, k: int, name: str) -> DataFrame:
    return ranks.where(F.col("rank") <= k).groupBy("uid").agg(F.collect_set("item").alias(name))


def overlap(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """(users, mean_intersection, mean_jaccard, changed) of two rankings' top-k sets."""
    from ..functions.core import jaccard

    both = top_sets(a, k, "a").join(top_sets(b, k, "b"), "uid")
    shared = F.size(F.array_intersect("a", "b"))
    return both.agg(F.count("*").alias("users"), F.round(F.avg(shared), 6).alias("mean_intersection"), F.round(F.avg(jaccard(F.col("a"), F.col("b"))), 6).alias("mean_jaccard"), F.count_if(shared < F.greatest(F.size("a"), F.size("b"))).alias("changed"))


def hit_flags(ranks: DataFrame, positives: DataFrame, name: str, k: int = 10) -> DataFrame:
    hit = ranks.where(F.col("rank") <= k).join(positives, ["uid", "item"], "left_semi").select("uid").distinct()
    return positives.select("uid").distinct().join(hit.withColumn(name, F.lit(True)), "uid", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def contingency(text: DataFrame, visual: DataFrame, positives: DataFrame) -> DataFrame:
    """(category, users): who hits by text, by visual vectors, by both or by neither."""
    flags = hit_flags(text, positives, "t").join(hit_flags(visual, positives, "v"), "uid")
    name = F.when(F.col("t") & F.col("v"), "both").when(F.col("t"), "text_only").when(F.col("v"), "visual_only").otherwise("neither")
    return flags.groupBy(name.alias("category")).agg(F.count("*").alias("users"))
