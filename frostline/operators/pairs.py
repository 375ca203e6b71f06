"""Leave-one-out training pairs with sampled negatives that had been seen by the target's time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import PROTOCOL
from ..functions.core import dot, first_hash_byte, shuffle_key
from . import blocks
from .quantiles import count_upto, indexed

#: Places drawn for each user; those taken or repeated are skipped, and users still short take the rest exactly.
DRAWS = 64
#: Places of a short user that are listed at once.
SPAN = 4096


def tallied(train: DataFrame) -> DataFrame:
    """(uid, item, n, first_ms, last): a user's events of an item; `last` is the time and id of the last one.

    Events move once, to their users; what is asked of a user's events then lies in one partition. A persisted tally may
    be given wherever these functions take events.
    """
    if "first_ms" in train.columns:
        return train
    rows = train.select("uid", "item", "ts_ms", "event_id").repartition("uid")
    return rows.groupBy("uid", "item").agg(F.count("*").alias("n"), F.min("ts_ms").alias("first_ms"), F.max(F.struct("ts_ms", "event_id")).alias("last"))


def first_seen(train: DataFrame) -> DataFrame:
    seen = train.select("item", "first_ms") if "first_ms" in train.columns else train.select("item", F.col("ts_ms").alias("first_ms"))
    return seen.groupBy("item").agg(F.min("first_ms").alias("first_ts"))


def targets(train: DataFrame) -> DataFrame:
    """(uid, item, ts_ms): the last event of users with at least two, unless its item is in their earlier history."""
    order = F.struct(F.col("last.ts_ms").alias("ts_ms"), "item", F.col("last.event_id").alias("event_id"), "n")
    lasts = tallied(train).groupBy("uid").agg(F.max(order).alias("m"), F.sum("n").alias("total"))
    once = (F.col("m.n") == 1) | F.col("uid").isNull() | F.col("m.item").isNull()  # nulls equal nothing
    return lasts.where((F.col("total") >= 2) & once).select("uid", "m.item", "m.ts_ms")


def histories(train: DataFrame, aims: DataFrame) -> DataFrame:
    """(uid, item, n): what the users of aims had before their targets, which are no part of it."""
    rows = tallied(train).join(aims.select("uid", F.col("item").alias("target")), "uid")
    return rows.where(~F.col("item").eqNullSafe(F.col("target"))).select("uid", "item", "n")


def availability(train: DataFrame, aims: DataFrame) -> DataFrame:
    """aims with `available`: items first seen no later than the target."""
    return count_upto(first_seen(train), "first_ts", aims, "ts_ms")


def owned(train: DataFrame) -> DataFrame:
    return train.select("uid", F.col("item").alias("neg_item")).distinct()


def eligibility(train: DataFrame, aims: DataFrame) -> DataFrame:
    """(uid, available, eligible): available items, and those of them that aren't the user's own."""
    # all of a user's items are available: their target is their last event
    own = owned(train).groupBy("uid").agg(F.count("*").alias("own"))
    return availability(train, aims).join(own, "uid").select("uid", "available", (F.col("available") - F.col("own")).alias("eligible"))


def short_pools(train: DataFrame, aims: DataFrame, n: int = PROTOCOL.negatives) -> DataFrame:
    """(uid, available, eligible) of users with fewer than n eligible items: they have only that many negatives."""
    return eligibility(train, aims).where(F.col("eligible") < n)


def negatives(train: DataFrame, aims: DataFrame, n: int = PROTOCOL.negatives, seed: int = PROTOCOL.seed) -> DataFrame:
    """(uid, neg_item, draw): hashed places among the available items, without the user's own items and repeats.

    Users for whom DRAWS places give fewer than n take the rest from all their eligible items, by the least hashes of
    seed, user and item; their draws count on from DRAWS. So users have n negatives, or all eligible items if fewer.
    """
    places = indexed(first_seen(train), "first_ts", "item").select("position", F.col("item").alias("neg_item"))
    known = eligibility(train, aims)
    draws = known.select("uid", "available", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))).alias("draw"))
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("uid").cast("string"), F.col("draw").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    drawn = draws.withColumn("position", F.pmod(hashed, F.col("available"))).join(places, "position")
    own = owned(train)
    free = drawn.join(own, ["uid", "neg_item"], "left_anti").groupBy("uid", "neg_item").agg(F.min("draw").alias("draw"))
    order = Window.partitionBy("uid").orderBy("draw")
    kept = free.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n).select("uid", "neg_item", "draw").persist()
    # users own most of what is available to them, but for rare luck, so that their places are about as many as their rows
    got = F.coalesce("got", F.lit(0))
    short = known.join(kept.groupBy("uid").agg(F.count("*").alias("got")), "uid", "left").where(got < F.least("eligible", F.lit(n))).select("uid", "available", got.alias("got"))
    spans = short.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("available") - 1, F.lit(SPAN).cast("long"))).alias("low"))
    listed = spans.select("uid", "got", F.explode(F.sequence("low", F.least(F.col("low") + SPAN, F.col("available")) - 1)).alias("position"))
    rest = listed.join(places, "position").join(own, ["uid", "neg_item"], "left_anti").join(kept.select("uid", "neg_item"), ["uid", "neg_item"], "left_anti")
    least = Window.partitionBy("uid").orderBy(shuffle_key(seed, F.col("uid"), F.col("neg_item")), "neg_item")
    more = rest.withColumn("k", F.row_number().over(least)).where((F.col("k") <= n) & (F.col("k") + F.col("got") <= n))
    return kept.unionByName(more.select("uid", "neg_item", (F.col("k") + (DRAWS - 1)).cast("int").alias("draw")))


def is_calibration(user):
    return first_hash_byte(F.concat(F.lit("calibration:"), user.cast("string"))) < PROTOCOL.calibration_below


def features(train: DataFrame, counts: DataFrame, idf: DataFrame, dense_features: DataFrame) -> DataFrame:
    """(uid, neg_item, pos_text, pos_visual, pos_product, neg_text, neg_visual, neg_product, is_calibration)."""
    train = tallied(train)
    aims = targets(train)
    past = histories(train, aims).persist()
    asked = aims.select("uid", "item", F.lit(True).alias("is_target")).unionByName(negatives(train, aims).select("uid", F.col("neg_item").alias("item"), F.lit(False).alias("is_target"))).persist()
    by_text = blocks.pair_scores(past, counts, idf, asked)
    looks = blocks.dense_profiles(past, dense_features)
    by_look = asked.join(dense_features, "item").join(looks, "uid").select("uid", "item", dot(F.col("profile"), F.col("embedding")).alias("visual"))
    scored = asked.join(by_look, ["uid", "item"]).join(by_text, ["uid", "item"], "left").select("uid", "item", "is_target", F.coalesce("text", F.lit(0.0)).alias("text"), "visual")
    scored = scored.withColumn("product", F.col("text") * F.col("visual"))
    names = ("text", "visual", "product")
    # a user's target and negatives meet in one row, so that nothing is scored twice
    one = F.struct("item", *[F.round(c, 9).alias(c) for c in names])
    both = scored.groupBy("uid").agg(F.max(F.when(F.col("is_target"), one)).alias("p"), F.collect_list(F.when(~F.col("is_target"), one)).alias("ns")).where("p IS NOT NULL")
    flat = both.select("uid", "p", F.explode("ns").alias("n")).select("uid", F.col("n.item").alias("neg_item"), *[F.col(f"{s[0]}.{c}").alias(f"{s}_{c}") for s in ("pos", "neg") for c in names])
    return flat.withColumn("is_calibration", is_calibration(F.col("uid")))


def standardisation(pairs: DataFrame) -> DataFrame:
    """(feature, mean, std, low, high) over positives and negatives of the training part; a feature that doesn't vary
    can't be standardised and is an error when read."""
    part = pairs.where("not is_calibration")
    rows = part.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{s}_{c}").alias("x")) for c in ("text", "visual", "product") for s in ("pos", "neg")])).alias("f")).select("f.*")
    return rows.groupBy("feature").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("low"), F.max("x").alias("high")).withColumn(
        "std", F.when(F.col("std") > 0, F.col("std")).otherwise(F.raise_error(F.concat(F.lit("feature does not vary: "), "feature"))))


def accuracy(pairs: DataFrame) -> DataFrame:
    """(feature, strict_accuracy, tie_rate) of single features."""
    rows = pairs.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), (F.col(f"pos_{c}") - F.col(f"neg_{c}")).alias("margin")) for c in ("text", "visual", "product")])).alias("f")).select("f.*")
    share = lambda cond: F.round(F.avg(F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))), 6)
    return rows.groupBy("feature").agg(share(F.col("margin") > 0).alias("strict_accuracy"), share(F.col("margin") == 0).alias("tie_rate"))


def metadata(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """(users, pairs, train_users, train_pairs, calibration_users, calibration_pairs, smallest_pool) of a pair set, whose
    users' eligible items `known` counts."""
    of = lambda c, name: (F.countDistinct(F.when(c, F.col("uid"))).alias(f"{name}_users"), F.count_if(c).alias(f"{name}_pairs"))
    own = pairs.agg(F.countDistinct("uid").alias("users"), F.count("*").alias("pairs"), *of(~F.col("is_calibration"), "train"), *of(F.col("is_calibration"), "calibration"))
    pool = known.join(pairs.select("uid").distinct(), "uid", "left_semi").agg(F.min("eligible").alias("smallest_pool"))
    return own.crossJoin(F.broadcast(pool))  # single rows
