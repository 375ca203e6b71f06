"""The registered queries, by family."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import PROTOCOL
from ..functions import core
from ..operators import blocks, dense, duplicates, explain, fusion, pairs, quantiles, rank, split, text
from .relations import Study

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[Study], DataFrame]) -> Callable:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Study(spark, sf_dir))
    return f


def final(f: Callable[[Study], DataFrame]) -> Callable:
    """The same query on the final test split."""
    QUERIES[f"final_{f.__name__}"] = lambda spark, sf_dir: f(Study(spark, sf_dir, "test"))
    return f


def union(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def r6(c: str):
    return F.round(c, 6).alias(c)


# --- audit ---------------------------------------------------------------------------------------


@query
def interaction_overview(s: Study) -> DataFrame:
    pairs_ = s.interactions.groupBy("uid", "item").agg(F.count("*").alias("n"), F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("hi"))
    return pairs_.agg(F.sum("n").alias("rows"), F.countDistinct("uid").alias("users"), F.countDistinct("item").alias("items"), F.min("lo").alias("ts_min"), F.max("hi").alias("ts_max"), F.sum(F.col("n") - 1).alias("repeated_pairs"))


@query
def duplicate_pairs(s: Study) -> DataFrame:
    return s.interactions.groupBy("uid", "item").agg(F.count("*").alias("n")).where("n > 1")


def activity(s: Study, key: str) -> DataFrame:
    return s.interactions.groupBy(key).agg(F.count("*").alias("n"))


@query
def user_activity_summary(s: Study) -> DataFrame:
    return quantiles.summary(activity(s, "uid"), "n")


@query
def item_activity_summary(s: Study) -> DataFrame:
    return quantiles.summary(activity(s, "item"), "n")


def both_entities(s: Study, f) -> DataFrame:
    return union(f(activity(s, k), "n").select(F.lit(n).alias("entity"), "*") for k, n in (("uid", "user"), ("item", "item")))


@query
def activity_percentiles(s: Study) -> DataFrame:
    return both_entities(s, quantiles.nearest_rank)


@query
def activity_gini(s: Study) -> DataFrame:
    return both_entities(s, quantiles.gini).select("entity", r6("gini"))


@query
def activity_concentration(s: Study) -> DataFrame:
    return both_entities(s, quantiles.head_share).select("entity", "percent", r6("share"))


@query
def non_monotonic_users(s: Study) -> DataFrame:
    before = F.lag("ts_ms").over(Window.partitionBy("uid").orderBy("event_id"))
    marked = s.interactions.withColumn("drop", before > F.col("ts_ms"))
    return marked.groupBy("uid").agg(F.bool_or(F.coalesce("drop", F.lit(False))).alias("d")).agg(F.count("*").alias("users"), F.count_if("d").alias("non_monotonic"))


@query
def sequence_consistency(s: Study) -> DataFrame:
    def sequences(order: str, name: str) -> DataFrame:
        return s.interactions.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "item"))), lambda e: e["item"]).alias(name))

    both = sequences("ts_ms", "a").join(sequences("event_id", "b"), "uid", "full_outer")
    return both.agg(F.count("*").alias("users"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("mismatched"))


@query
def title_coverage(s: Study) -> DataFrame:
    used, docs, vecs = s.interactions.select("item").distinct(), s.table("documents").select(F.col("doc_id").alias("item")).distinct(), s.features.select("item").distinct()
    marked = reduce(lambda a, b: a.join(b, "item", "full_outer"), [d.withColumn(n, F.lit(True)) for d, n in ((used, "u"), (docs, "t"), (vecs, "v"))])
    without = lambda a, b, n: F.count_if(F.col(a).isNotNull() & F.col(b).isNull()).alias(n)
    return marked.agg(F.count("u").alias("used_items"), F.count("t").alias("title_items"), without("u", "t", "used_without_title"), without("t", "u", "titles_unused"), without("u", "v", "used_without_vector"), without("v", "u", "vectors_unused"))


@query
def title_token_stats(s: Study) -> DataFrame:
    rows = s.titles.select(core.normalised_title("title").alias("t"), F.size(core.tokens("title")).alias("n"))
    return rows.agg(F.count("*").alias("items"), F.countDistinct("t").alias("unique_titles"), F.count_if(F.col("t") == "").alias("empty_titles")).crossJoin(quantiles.nearest_rank(rows, "n", (25, 50, 75, 90)).select(*[F.col(f"p{p}").cast("long") for p in (25, 50, 75, 90)]))


@query
def cutoff_timestamps(s: Study) -> DataFrame:
    dev, final = s.cuts
    return s.spark.range(1).select(F.lit(dev).cast("long").alias("dev_ms"), F.lit(final).cast("long").alias("final_ms"))


# --- split ---------------------------------------------------------------------------------------


def each_split(s: Study):
    return (("validation", s.dev), ("test", s.final))


@query
def split_counts(s: Study) -> DataFrame:
    parts = [(f"{n}_{k}", getattr(p, f"{k}_rows" if k != "train" else "train")) for n, p in each_split(s) for k in ("train", "cold", "warm")]
    return union(df.agg(F.lit(n).alias("part"), F.count("*").alias("rows"), F.countDistinct("uid").alias("users"), F.countDistinct("item").alias("items")) for n, df in parts)


@query
def cold_items(s: Study) -> DataFrame:
    return union(p.cold_items.select(F.lit(n).alias("split"), "item") for n, p in each_split(s))


def rows_of(s: Study, kind: str) -> DataFrame:
    return union(getattr(p, kind).select(F.lit(n).alias("split"), "uid", "item", "ts_ms", "event_id") for n, p in each_split(s))


@query
def cold_eval_rows(s: Study) -> DataFrame:
    return rows_of(s, "cold_rows")


@query
def warm_eval_rows(s: Study) -> DataFrame:
    return rows_of(s, "warm_rows")


@query
def split_invariants(s: Study) -> DataFrame:
    return split.violations(s.dev, s.final, s.titles)


@query
def audit_cold_feasibility(s: Study) -> DataFrame:
    def one(name: str, p: split.Split) -> DataFrame:
        # the audit asks for history before the development cut-off in both cases
        rows = p.window.join(p.train_items, "item", "left_anti").join(s.dev.train_users.withColumn("known", F.lit(True)), "uid", "left")
        return rows.agg(F.lit(name).alias("split"), F.count("*").alias("rows"), F.countDistinct("uid").alias("users"), F.countDistinct(F.when(F.col("known"), F.col("uid"))).alias("users_with_history"), F.countDistinct("item").alias("items"))

    return union(one(n, p) for n, p in each_split(s))


# --- text ----------------------------------------------------------------------------------------


@query
def token_document_frequency(s: Study) -> DataFrame:
    return text.document_frequency(s.counts, s.dev.train_items)


@query
def idf(s: Study) -> DataFrame:
    return s.idf.select("term", "df", r6("idf"))


@query
def tfidf_vectors(s: Study) -> DataFrame:
    return s.vectors.select("item", "term", r6("w"))


@query
def zero_vectors(s: Study) -> DataFrame:
    return union(pool.join(s.vectors.select("item").distinct(), "item", "left_anti").agg(F.lit(n).alias("pool"), F.count("*").alias("items")) for n, pool in (("train", s.dev.train_items), ("cold", s.candidates)))


@query
def user_text_profile(s: Study) -> DataFrame:
    return s.text_profiles.select("uid", "term", r6("w"))


@query
def user_dense_profile(s: Study) -> DataFrame:
    return s.dense_profiles.select("uid", F.posexplode("profile").alias("pos", "x")).select("uid", "pos", r6("x"))


@query
def text_scores(s: Study) -> DataFrame:
    return s.text_scores.select("uid", "item", r6("score"))


@query
def text_topk(s: Study) -> DataFrame:
    return s.text_ranks.where(F.col("rank") <= 50).select("uid", "item", r6("score"), "rank")


@final
@query
def text_metrics(s: Study) -> DataFrame:
    return rank.metrics(s.text_ranks, s.positives)


@query
def text_diagnostics(s: Study) -> DataFrame:
    profiled = s.text_profiles.select("uid").distinct().withColumn("has", F.lit(True))
    best = s.text_scores.groupBy("uid").agg(F.max("score").alias("best"))
    return s.users.join(profiled, "uid", "left").join(best, "uid", "left").agg(F.count("*").alias("users"), F.count_if(F.col("has").isNull()).alias("empty_profiles"), F.count_if(F.coalesce("best", F.lit(0.0)) == 0).alias("all_zero_users"))


def named_titles(s: Study) -> DataFrame:
    """(item, t): a digest of the normalised title, so that histories don't carry whole texts."""
    return s.titles.select("item", F.sha2(core.normalised_title("title").cast("binary"), 256).alias("t"))


@query
def title_overlap_audit(s: Study) -> DataFrame:
    named = named_titles(s)
    past = s.history.join(named, "item").select("uid", "t").distinct()
    own = s.positives.join(named, "item").join(past, ["uid", "t"], "left_semi").agg(F.count("*").alias("positives_in_own_history"))
    seen = s.dev.train_items.join(named, "item").select("t").distinct()
    pool = s.candidates.join(named, "item")
    again = pool.join(seen, "t", "left_semi").agg(F.count("*").alias("candidates_seen_in_train"))
    repeats = pool.agg((F.count("*") - F.countDistinct("t")).alias("repeated_candidate_titles"))
    return own.crossJoin(again).crossJoin(repeats)  # single rows


@query
def random_metrics(s: Study) -> DataFrame:
    return rank.metrics(rank.random_order(s.users, s.candidates), s.positives)


# --- dense ---------------------------------------------------------------------------------------


@query
def dense_scores_topk(s: Study) -> DataFrame:
    return s.dense_ranks.where(F.col("rank") <= 50).select("uid", "item", r6("score"), "rank")


@final
@query
def visual_metrics(s: Study) -> DataFrame:
    return rank.metrics(s.dense_ranks, s.positives)


@query
def visual_metrics_by_bucket(s: Study) -> DataFrame:
    per_user = rank.user_metrics(s.dense_ranks, s.positives)
    return rank.averages(per_user.join(s.buckets, "uid"), "bucket", "k")


def hash_sides(s: Study) -> tuple[DataFrame, DataFrame]:
    return s.hashes.join(s.candidates, "item", "left_semi"), s.hashes.join(s.train_items, "item", "left_semi")


@final
@query
def hamming_nearest(s: Study) -> DataFrame:
    return duplicates.nearest_hash(*hash_sides(s))


@final
@query
def hash_boundary_audit(s: Study) -> DataFrame:
    return duplicates.boundary_audit(duplicates.nearest_hash(*hash_sides(s)))


@query
def hash_boundary_examples(s: Study) -> DataFrame:
    return duplicates.nearest_examples(duplicates.nearest_hash(*hash_sides(s)))


@query
def hamming_histogram(s: Study) -> DataFrame:
    return duplicates.distance_histogram(duplicates.nearest_hash(*hash_sides(s)))


def clean(s: Study) -> tuple[DataFrame, DataFrame]:
    pool = duplicates.clean_candidates(s.candidates, s.train_items, *hash_sides(s))
    return pool, s.positives.join(pool, "item", "left_semi").select("uid", "item")


@final
@query
def clean_pool_metrics(s: Study) -> DataFrame:
    pool, positives = clean(s)
    both = ((n, df.join(pool, "item", "left_semi")) for n, df in (("text", s.text_scores), ("visual", s.dense_scores)))
    return union(rank.metrics(rank.ranked(scores), positives).select(F.lit(n).alias("model"), "*") for n, scores in both)


# --- fusion --------------------------------------------------------------------------------------


@final
@query
def rank_fusion_grid(s: Study) -> DataFrame:
    return fusion.fusion_grid(s.ranks("fused", top=10)[0], s.positives)


@query
def rank_fusion_selected(s: Study) -> DataFrame:
    return fusion.selected(fusion.fusion_grid(s.ranks("fused", top=10)[0], s.positives), "weight")


@query
def complementarity(s: Study) -> DataFrame:
    return rank.contingency(*s.ranks("text", "visual", top=10), s.positives)


@query
def topk_overlap(s: Study) -> DataFrame:
    return rank.overlap(*s.ranks("text", "visual", top=10))


@query
def gate_partition(s: Study) -> DataFrame:
    return s.users.select("uid", fusion.gate_partition(F.col("uid")).alias("partition"))


def gate_rows(s: Study) -> DataFrame:
    """(uid, partition, top_score, t_*, v_*) of every user."""
    named = lambda ranks, p: rank.user_metrics(ranks, s.positives, (10,)).select("uid", *[F.col(c).alias(f"{p}_{c}") for c in ("recall", "ndcg", "hit")])
    by_text, by_look = s.ranks("text", "visual", top=10)
    top = by_text.where("rank = 1").select("uid", F.col("score").alias("top_score"))
    return named(by_text, "t").join(named(by_look, "v"), "uid").join(top, "uid").withColumn("partition", fusion.gate_partition(F.col("uid")))


@query
def gate_thresholds(s: Study) -> DataFrame:
    top = s.ranks("text", top=1)[0].where("rank = 1").select("uid", F.col("score").alias("top_score")).where(fusion.gate_partition(F.col("uid")) == "gate_dev")
    return fusion.lower_quantiles(top, PROTOCOL.gate_shares).select("share", r6("threshold"))


def gate(s: Study) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = s.kept(gate_rows(s))
    dev = rows.where(F.col("partition") == "gate_dev")
    cuts = fusion.lower_quantiles(dev, PROTOCOL.gate_shares)
    return rows, cuts, fusion.gated(dev, cuts)


@query
def gate_dev_grid(s: Study) -> DataFrame:
    return gate(s)[2]


def audited(s: Study) -> tuple[DataFrame, DataFrame]:
    """The audit part's rows, and (share, threshold) of the policies gate, text and visual."""
    rows, cuts, grid = gate(s)
    chosen = cuts.join(F.broadcast(fusion.selected(grid, "share").select("share")), "share", "left_semi").select(F.lit("gate").alias("share"), "threshold")
    fixed = s.spark.createDataFrame([("text", None), ("visual", float("inf"))], "share string, threshold double")
    return rows.where(F.col("partition") == "gate_audit"), chosen.unionByName(fixed)


@query
def gate_audit(s: Study) -> DataFrame:
    return fusion.gated(*audited(s)).withColumnRenamed("share", "policy")


@query
def gate_contingency(s: Study) -> DataFrame:
    """(scope, category, users) of hits in the audit part: of all its users, and of those that the gate sends to visual."""
    return fusion.gate_contingency(*audited(s))


@query
def gate_acceptance(s: Study) -> DataFrame:
    return fusion.gate_accepted(fusion.gated(*audited(s)))


@query
def gate_partition_check(s: Study) -> DataFrame:
    """(users, gate_dev, gate_audit, in_both, in_none): the partition is disjoint and covers all users."""
    part = s.users.select("uid", fusion.gate_partition(F.col("uid")).alias("p"))
    each = part.groupBy("uid").agg(F.countDistinct("p").alias("n"), F.min("p").alias("p"))
    return each.agg(F.count("*").alias("users"), F.count_if(F.col("p") == "gate_dev").alias("gate_dev"), F.count_if(F.col("p") == "gate_audit").alias("gate_audit"), F.count_if(F.col("n") > 1).alias("in_both"), F.count_if(F.col("p").isNull()).alias("in_none"))


# --- learned fusion ------------------------------------------------------------------------------


@query
def first_seen(s: Study) -> DataFrame:
    return pairs.first_seen(s.dev.train)


@query
def loo_targets(s: Study) -> DataFrame:
    return pairs.targets(s.dev.train)


@query
def availability_asof(s: Study) -> DataFrame:
    return pairs.availability(s.tally, pairs.targets(s.tally)).select("uid", "item", "available")


@query
def negative_samples(s: Study) -> DataFrame:
    return pairs.negatives(s.tally, pairs.targets(s.tally))


@query
def short_negative_pools(s: Study) -> DataFrame:
    return pairs.short_pools(s.tally, pairs.targets(s.tally))


def pair_rows(s: Study) -> DataFrame:
    return pairs.features(s.tally, s.packs, s.terms, s.features)


@query
def pair_features(s: Study) -> DataFrame:
    p = pair_rows(s)
    return p.select(*[r6(c) if p.schema[c].dataType.typeName() == "double" else c for c in p.columns])


@query
def pair_standardization(s: Study) -> DataFrame:
    return pairs.standardisation(pair_rows(s)).select("feature", *[r6(c) for c in ("mean", "std", "low", "high")])


@query
def pair_accuracy(s: Study) -> DataFrame:
    return pairs.accuracy(pair_rows(s))


@query
def pair_metadata(s: Study) -> DataFrame:
    return pairs.metadata(pair_rows(s), pairs.eligibility(s.tally, pairs.targets(s.tally)))


def learned_ranks(s: Study, *more: str, **limits) -> list[DataFrame]:
    """Ranks by the learned fusion, and by more kinds."""
    stats = fusion.statistics(pairs.standardisation(pair_rows(s))).head().asDict()  # one row
    return s.ranks("learned", *more, stats=stats, **limits)


@query
def learned_fusion_metrics(s: Study) -> DataFrame:
    return rank.metrics(learned_ranks(s)[0], s.positives)


@query
def learned_fusion_clean_metrics(s: Study) -> DataFrame:
    pool, positives = clean(s)
    return rank.metrics(learned_ranks(s, pool=pool)[0], positives)


@query
def learned_fusion_overlap(s: Study) -> DataFrame:
    return rank.overlap(*learned_ranks(s, "text", top=10))


@query
def acceptance_gate(s: Study) -> DataFrame:
    return fusion.accepted(*[rank.metrics(r, s.positives, (10,)) for r in learned_ranks(s, "text", top=10)])


def margins(s: Study) -> tuple[DataFrame, list[float]]:
    """Standardised margins of the pair set, as the ranker takes them, and the features' deviations."""
    p = s.kept(pair_rows(s))
    stats = {r.feature: r["std"] for r in pairs.standardisation(p).collect()}  # three rows
    names = ("text", "visual", "product")
    rows = p.select("is_calibration", *[((F.col(f"pos_{c}") - F.col(f"neg_{c}")) / stats[c]).alias(f"m{i}") for i, c in enumerate(names)])
    return s.kept(rows), [stats[c] for c in names]


@query
def learned_fusion_train(s: Study) -> DataFrame:
    model = fusion.train_ranker(margins(s)[0])
    rows = [(h["epoch"], h["train_loss"], h["calibration_loss"], *h["weights"], h["epoch"] == model["best_epoch"]) for h in model["history"]]
    return s.spark.createDataFrame(rows, "epoch int, train_loss double, calibration_loss double, w_text double, w_visual double, w_product double, is_best boolean")


@query
def learned_fusion_refit(s: Study) -> DataFrame:
    """The final weights: all pairs for as many epochs as calibration chose, with their quality and original scale."""
    rows, stds = margins(s)
    epochs = fusion.train_ranker(rows)["best_epoch"]
    weights = fusion.train_ranker(rows, rounds=epochs, refit=True)["weights"]
    scaled = [w / z for w, z in zip(weights, stds, strict=True)]
    extra = [(f"{n}_{c}", x) for n, xs in (("w", weights), ("scale", [x / sum(scaled) for x in scaled])) for c, x in zip(("text", "visual", "product"), xs, strict=True)]
    return fusion.ranker_quality(rows, weights).withColumns({"epochs": F.lit(epochs)} | {c: F.lit(x) for c, x in extra})


# --- diagnostics ---------------------------------------------------------------------------------


def positive_ranks(s: Study) -> DataFrame:
    return s.text_ranks.join(s.positives, ["uid", "item"], "left_semi")


@query
def error_summary(s: Study) -> DataFrame:
    best = positive_ranks(s).groupBy("uid").agg(F.min("rank").alias("best"), F.count_if(F.col("score") == 0).alias("zero"))
    return best.agg(F.count("*").alias("users"), F.sum("zero").alias("zero_score_positives"), F.round(F.avg("best"), 6).alias("mean_best_rank"))


def target_similarity(s: Study) -> DataFrame:
    """(uid, item, similarity): the greatest token Jaccard of a positive with its user's history."""
    sets = s.titles.select("item", F.array_distinct(core.tokens("title")).alias("ts"))
    past = s.history.select("uid", "item").distinct().join(sets, "item").select("uid", F.col("ts").alias("hs"))
    rows = s.positives.join(sets, "item").join(past, "uid")
    return rows.groupBy("uid", "item").agg(F.max(core.jaccard(F.col("ts"), F.col("hs"))).alias("similarity"))


@query
def near_duplicate_audit(s: Study) -> DataFrame:
    near = s.kept(target_similarity(s))
    kept = near.where(F.col("similarity") < PROTOCOL.near_duplicate).select("uid", "item")
    m = rank.averages(rank.user_metrics(s.text_ranks, kept, (10,)), "k").drop("k").withColumnRenamed("users", "kept_users")
    return near.agg(F.count("*").alias("positives"), F.count_if(F.col("similarity") >= 0.5).alias("near_50"), F.count_if(F.col("similarity") >= 0.8).alias("near_80")).crossJoin(m)  # single rows


@query
def history_buckets(s: Study) -> DataFrame:
    per_user = rank.user_metrics(s.text_ranks, s.positives, (10,))
    return rank.averages(per_user.join(s.buckets, "uid"), "bucket")


def cases(s: Study) -> DataFrame:
    """(uid, best_item, best_rank, best_score, top_item, top_score, exact)."""
    named = named_titles(s)
    best = positive_ranks(s).groupBy("uid").agg(F.min(F.struct("rank", "item", "score")).alias("b")).select("uid", F.col("b.item").alias("best_item"), F.col("b.rank").alias("best_rank"), F.col("b.score").alias("best_score"))
    top = s.text_ranks.where("rank = 1").select("uid", F.col("item").alias("top_item"), F.col("score").alias("top_score"))
    past = s.history.join(named, "item").select("uid", "t").distinct().withColumn("exact", F.lit(True))
    return best.join(top, "uid").join(named.toDF("best_item", "t"), "best_item").join(past, ["uid", "t"], "left").select("uid", "best_item", "best_rank", "best_score", "top_item", "top_score", F.coalesce("exact", F.lit(False)).alias("exact"))


@query
def case_strong_hits(s: Study) -> DataFrame:
    return cases(s).where("best_rank <= 3 and not exact").orderBy(F.desc("best_score"), "uid").limit(5).select("uid", "best_item", "best_rank", r6("best_score"))


@query
def case_confident_misses(s: Study) -> DataFrame:
    return cases(s).where((F.col("best_rank") > PROTOCOL.miss_beyond) & (F.col("top_score") > 0)).orderBy(F.desc("top_score"), "uid").limit(5).select("uid", "best_item", "best_rank", "top_item", r6("top_score"))


@query
def exposure_summary(s: Study) -> DataFrame:
    def one(name: str, ranks: DataFrame) -> DataFrame:
        shown = ranks.where(F.col("rank") <= 10).groupBy("item").agg(F.count("*").alias("n"))
        slots = s.candidates.join(shown, "item", "left").select("item", F.coalesce("n", F.lit(0)).alias("n"))
        slots = s.kept(slots)
        basic = slots.agg(F.lit(name).alias("model"), F.count("*").alias("candidates"), F.round(F.avg((F.col("n") > 0).cast("double")), 6).alias("coverage"), F.max("n").alias("most"))
        share = quantiles.head_share(slots, "n", (1, 10)).groupBy().agg(*[F.round(F.max(F.when(F.col("percent") == p, F.col("share"))), 6).alias(f"top_{p}_share") for p in (1, 10)])
        return basic.crossJoin(quantiles.gini(slots, "n").select(r6("gini"))).crossJoin(share)  # single rows

    return union(one(n, r) for n, r in zip(("text", "visual"), s.ranks("text", "visual", top=10), strict=True))


# --- explanation ---------------------------------------------------------------------------------

TOPICS = {"the": "the and of", "de": "de la le", "und": "die der und", "con": "que el en"}


@query
def demo_samples(s: Study) -> DataFrame:
    """One user per bucket and outcome: the least hash."""
    hits = rank.hit_flags(s.text_ranks, s.positives, "hit")
    outcome = F.when(F.col("hit"), "hit").otherwise("miss")
    picked = explain.stratified(hits.join(s.buckets, "uid").withColumn("outcome", outcome), ["bucket", "outcome"], "uid", "uid", "sample")
    titles = s.table("documents").select(F.col("doc_id").alias("item"), core.shortened("text").alias("t"))
    last = Window.partitionBy("uid").orderBy(F.desc("event_id"))
    recent = s.history.join(F.broadcast(picked.select("uid")), "uid").withColumn("back", F.row_number().over(last)).where("back <= 6")
    recent = F.broadcast(recent).join(titles, "item")  # six rows a picked user
    recent = recent.groupBy("uid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "t"))), lambda e: e["t"]), "|").alias("history_titles"))
    return picked.join(recent, "uid")


@query
def history_catalog(s: Study) -> DataFrame:
    topics = s.spark.createDataFrame([(k, w) for k, ws in TOPICS.items() for w in ws.split()], "topic string, term string")
    eligible = s.vectors.join(s.dev.train_items, "item", "left_semi").join(F.broadcast(topics), "term").select("topic", "item").distinct()
    return explain.quota_sample(eligible, list(TOPICS), 10, "catalog")


@query
def explain_terms(s: Study) -> DataFrame:
    return blocks.top_contributions(s.past, s.packs, s.terms, s.users, s.candidates)


@query
def simulate_interest(s: Study) -> DataFrame:
    q = s.spark.createDataFrame(list(TOPICS.items()), "query string, words string")
    return explain.simulate(explain.query_vector(q, s.idf), s.vectors, s.candidates).select("query", "place", "item", r6("score"))


@query
def simulate_history(s: Study) -> DataFrame:
    catalog = history_catalog(s).where("place = 1").withColumn("pos", F.row_number().over(Window.orderBy("topic")))  # a row a topic
    chosen = catalog.select(F.lit("mine").alias("query"), "item", "pos").persist()
    results = explain.simulate(explain.history_query(chosen, s.vectors), s.vectors, s.candidates)
    return explain.evidence(results, chosen, s.vectors).withColumn("score", F.round("score", 6))


# --- duplicates and images -----------------------------------------------------------------------


def contents(s: Study) -> DataFrame:
    return s.table("documents").select(F.col("doc_id").alias("item"), F.col("text").alias("content"))


@query
def exact_duplicate_groups(s: Study) -> DataFrame:
    return duplicates.exact_groups(contents(s))


@query
def duplicate_cross_boundary(s: Study) -> DataFrame:
    return duplicates.cross_boundary(contents(s), s.dev.train_items, s.candidates)


@query
def self_join_similarity_top10(s: Study) -> DataFrame:
    return dense.most_similar_pairs(s.features, s.candidates, 10).withColumn("similarity", F.round("similarity", 6))


@query
def dhash_from_grid(s: Study) -> DataFrame:
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.transform(F.sequence(F.lit(0), F.lit(8)), lambda x: (F.col("part") * 31 + y * 17 + x * x * F.col("part")) % 256))
    return s.table("part").select(F.col("p_partkey").cast("long").alias("part")).select("part", core.difference_hash(rows).alias("dhash"))
