"""Combining two rankings: by rank, by a confidence gate, by learned weights."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import PROTOCOL
from ..functions.core import first_hash_byte, shuffle_key
from .rank import averages, ranked, user_metrics


def rank_fusion(text: DataFrame, visual: DataFrame, weights=PROTOCOL.fusion_weights, seed: int = PROTOCOL.seed) -> DataFrame:
    """(uid, weight, item, rank): ascending weight * text rank + (1 - weight) * visual rank, both from 0."""
    both = text.select("uid", "item", (F.col("rank") - 1).alias("rt")).join(visual.select("uid", "item", (F.col("rank") - 1).alias("rv")), ["uid", "item"])
    grid = both.select("*", F.explode(F.array(*[F.lit(float(w)) for w in weights])).alias("weight"))
    cost = F.round(F.col("weight") * F.col("rt") + (1 - F.col("weight")) * F.col("rv"), 9)
    order = Window.partitionBy("uid", "weight").orderBy(cost, shuffle_key(seed, F.col("uid"), F.col("item")), "item")
    return grid.select("uid", "weight", "item", F.row_number().over(order).cast("long").alias("rank"))


def fusion_grid(fused: DataFrame, positives: DataFrame) -> DataFrame:
    return averages(user_metrics(fused, positives, (10,), ("weight",)), "weight")


def selected(grid: DataFrame, setting: str) -> DataFrame:
    """The grid's best row by NDCG, then recall; the smallest setting wins ties."""
    return grid.orderBy(F.desc("ndcg"), F.desc("recall"), setting).limit(1)


def gate_partition(user: Column) -> Column:
    byte = first_hash_byte(F.concat(F.lit("gate:"), user.cast("string")))
    return F.when(byte % 2 == 0, "gate_dev").otherwise("gate_audit")


def lower_quantiles(scores: DataFrame, shares) -> DataFrame:
    """(share, threshold): the value at index floor((n - 1) * share); share 0 never switches and has a null threshold."""
    from .quantiles import values_at

    n = scores.count()
    found = values_at(scores, "top_score", [int((n - 1) * s) for s in shares], n)
    rows = [(float(s), None if s <= 0 or v is None else float(v)) for s, v in zip(shares, found, strict=True)] if n else []
    return scores.sparkSession.createDataFrame(rows, "share double, threshold double")


def gated(per_user: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(share, users, visual_users, visual_share, recall, ndcg, hit_rate): visual where the best text score is at most the threshold.

    per_user has (uid, top_score, t_recall, t_ndcg, t_hit, v_recall, v_ndcg, v_hit).
    """
    rows = per_user.crossJoin(F.broadcast(thresholds))  # a row a share
    use = F.coalesce(F.col("top_score") <= F.col("threshold"), F.lit(False))
    pick = lambda c: F.round(F.avg(F.when(use, F.col(f"v_{c}")).otherwise(F.col(f"t_{c}"))), 6)
    out = rows.groupBy("share").agg(F.count("*").alias("users"), F.count_if(use).alias("visual_users"), pick("recall").alias("recall"), pick("ndcg").alias("ndcg"), pick("hit").alias("hit_rate"))
    return out.withColumn("visual_share", F.round(F.col("visual_users") / F.col("users"), 6))


def gate_contingency(per_user: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(scope, category, users): who hits by text, by visual vectors, by both or by neither, of all users and of the
    users that the policy `gate` of thresholds sends to visual."""
    rows = per_user.crossJoin(F.broadcast(thresholds.where(F.col("share") == "gate")))  # one row
    gated_ = F.coalesce(F.col("top_score") <= F.col("threshold"), F.lit(False))
    t, v = F.col("t_hit") > 0, F.col("v_hit") > 0
    name = F.when(t & v, "both").when(t, "text_only").when(v, "visual_only").otherwise("neither")
    scopes = F.explode(F.when(gated_, F.array(F.lit("all"), F.lit("gated"))).otherwise(F.array(F.lit("all"))))
    return rows.select(scopes.alias("scope"), name.alias("category")).groupBy("scope", "category").agg(F.count("*").alias("users"))


def gate_accepted(policies: DataFrame) -> DataFrame:
    """(accepted): the gate's NDCG and recall are both strictly greater than those of text alone."""
    of = lambda c, p: F.max(F.when(F.col("share") == p, F.col(c)))
    return policies.agg(((of("ndcg", "gate") > of("ndcg", "text")) & (of("recall", "gate") > of("recall", "text"))).alias("accepted"))


def statistics(stats: DataFrame) -> DataFrame:
    """One row of mean_* and std_* from (feature, mean, std)."""
    of = lambda c, n: F.round(F.max(F.when(F.col("feature") == n, F.col(c))), 6).alias(f"{c}_{n}")
    return stats.agg(*[of(c, n) for c in ("mean", "std") for n in ("text", "visual", "product")])


def learned_scores(pairs: DataFrame, stats: DataFrame, weights=PROTOCOL.learned) -> DataFrame:
    """Scores from standardised (text, visual, product) features of (uid, item, text, visual); stats has (feature, mean, std)."""
    names, row = ("text", "visual", "product"), statistics(stats)
    terms = {"text": F.col("text"), "visual": F.col("visual"), "product": F.col("text") * F.col("visual")}
    total = sum((F.lit(w) * (terms[n] - F.col(f"mean_{n}")) / F.col(f"std_{n}") for n, w in zip(names, weights, strict=True)), F.lit(0.0))
    return pairs.crossJoin(F.broadcast(row)).select("uid", "item", F.round(total, 9).alias("score"))  # row is one row


def train_ranker(pairs: DataFrame, rate: float = 0.05, rounds: int = 50, patience: int = 5, least_gain: float = 1e-5, refit: bool = False) -> dict:
    """Softmax-simplex weights of a pairwise logistic ranker, by Adam on full-batch gradients.

    Every epoch is one aggregation of three gradient sums, so pairs stay distributed. pairs has standardised margins
    m0, m1, m2 (positive minus negative) and is_calibration; calibration rows only stop the training early. With refit,
    all rows train for exactly `rounds` epochs, as is done once the epoch is chosen.
    """
    logits, m, v = np.zeros(3), np.zeros(3), np.zeros(3)
    best, waited, history = (float("inf"), np.full(3, 1 / 3), 0), 0, []
    weights = lambda: np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
    for epoch in range(1, rounds + 1):
        w = weights()
        margin = sum((F.lit(float(x)) * F.col(f"m{i}") for i, x in enumerate(w)), F.lit(0.0))
        slope = -1 / (1 + F.exp(margin))
        loss = F.greatest(-margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin)))
        fit = F.lit(True) if refit else ~F.col("is_calibration")
        row = pairs.agg(*[F.avg(F.when(fit, slope * F.col(f"m{i}"))) for i in range(3)], F.avg(F.when(fit, loss)), F.avg(F.when(F.col("is_calibration"), loss))).head()
        g, held = np.array(row[:3], float), row[4] if row[4] is not None else row[3]
        history.append({"epoch": epoch, "train_loss": row[3], "calibration_loss": row[4], "weights": w.tolist()})
        if not refit:
            if held < best[0] - least_gain:
                best, waited = (held, w, epoch), 0
            else:
                waited += 1
                if waited >= patience:
                    break
        step = w * (g - (g * w).sum())  # through the softmax
        m, v = 0.9 * m + 0.1 * step, 0.999 * v + 0.001 * step**2
        logits = logits - rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
    if refit:
        best = (None, weights(), rounds)
    return {"weights": best[1].tolist(), "best_epoch": best[2], "history": history}


def ranker_quality(pairs: DataFrame, weights: list[float]) -> DataFrame:
    """(loss, strict_accuracy, tie_rate) of weights over all rows of pairs, as train_ranker takes them."""
    margin = sum((F.lit(float(x)) * F.col(f"m{i}") for i, x in enumerate(weights)), F.lit(0.0))
    loss = F.greatest(-margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin)))
    share = lambda c: F.avg(F.when(c, F.lit(1.0)).otherwise(F.lit(0.0)))
    return pairs.agg(F.avg(loss).alias("loss"), share(margin > 0).alias("strict_accuracy"), share(margin == 0).alias("tie_rate"))


def accepted(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    """(accepted): both NDCG@10 and Recall@10 strictly greater."""
    c, b = candidate.where("k = 10").select(F.col("ndcg").alias("cn"), F.col("recall").alias("cr")), baseline.where("k = 10").select(F.col("ndcg").alias("bn"), F.col("recall").alias("br"))
    return c.crossJoin(F.broadcast(b)).select(((F.col("cn") > F.col("bn")) & (F.col("cr") > F.col("br"))).alias("accepted"))


__all__ = ["accepted", "fusion_grid", "gate_partition", "gated", "learned_scores", "lower_quantiles", "rank_fusion", "ranked", "selected", "train_ranker"]
