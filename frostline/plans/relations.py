"""The study's relations over the given tables, each a lazy DataFrame."""

from __future__ import annotations

from functools import cached_property
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PROTOCOL
from ..functions import core
from ..operators import blocks, dense, pairs, rank, split, text


class Study:
    """events give interactions, documents titles, embeddings features and sign-bit hashes.

    Relations that several parts of one query read are persisted to memory and disk, and released when the session's
    next study begins; a result that is still read then is computed without them. `stage` says which split's cold items
    are ranked: those of `validation`, or of the final `test`, whose history reaches to the second cut-off.
    """

    held: ClassVar[dict[str, list[DataFrame]]] = {}

    def __init__(self, spark: SparkSession, sf_dir: str, stage: str = "validation"):
        self.spark, self.dir, self.stage = spark, sf_dir, stage
        self.key = spark.sparkContext.applicationId
        for df in self.held.pop(self.key, []):
            df.unpersist()

    def kept(self, df: DataFrame) -> DataFrame:
        self.held.setdefault(self.key, []).append(df.persist())
        return df

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def interactions(self) -> DataFrame:
        events = self.table("events")
        ne, nv = events.count(), min(self.table("documents").count(), self.table("embeddings").count())
        base = F.floor(F.col("event_id") * nv / F.lit(ne)).cast("long") if ne else F.lit(0)
        rows = events.select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), base.alias("base"))
        item = F.when(F.col("event_id") % 3 == 0, (F.col("event_id") * 7919) % (F.col("base") + 1)).otherwise(F.col("base"))
        return self.kept(rows.select(F.col("user_id").alias("uid"), item.alias("item"), "ts_ms", "event_id"))

    @cached_property
    def cuts(self) -> tuple[int, int]:
        return split.cutoffs(self.interactions, PROTOCOL.dev_quantile, PROTOCOL.final_quantile)

    @cached_property
    def dev(self) -> split.Split:
        return split.Split("validation", self.interactions, *self.cuts)

    @cached_property
    def final(self) -> split.Split:
        return split.Split("test", self.interactions, self.cuts[1])

    @cached_property
    def split(self) -> split.Split:
        """The split whose cold items are ranked."""
        return {"validation": self.dev, "test": self.final}[self.stage]

    @cached_property
    def train_items(self) -> DataFrame:
        return self.kept(self.split.train_items)

    @cached_property
    def ranged(self) -> DataFrame:
        """Whole texts of the ids from the least item to the greatest."""
        low, high = self.interactions.agg(F.min("item"), F.max("item")).head()
        docs = self.table("documents").select(F.col("doc_id").alias("item"), F.col("text").alias("title"))
        return docs.where(F.col("item").between(F.lit(low), F.lit(high)))

    @cached_property
    def titles(self) -> DataFrame:
        """Whole texts of the items that occur; texts beyond the range of their ids don't move."""
        return self.ranged.join(self.interactions.select("item").distinct(), "item", "left_semi")

    @cached_property
    def features(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("item"), "embedding")

    @cached_property
    def hashes(self) -> DataFrame:
        return self.features.select("item", core.sign_bits(F.col("embedding")).alias("h"))

    @cached_property
    def counts(self) -> DataFrame:
        return self.kept(text.term_counts(self.titles))

    @cached_property
    def idf(self) -> DataFrame:
        return text.inverse_frequency(self.counts, self.train_items, PROTOCOL.min_df)

    @cached_property
    def worded(self) -> DataFrame:
        """The items' words, packed before they move."""
        items = self.interactions.groupBy("item").agg(F.max(F.coalesce(F.col("ts_ms") < self.split.start, F.lit(False))).alias("trained"))
        return self.kept(blocks.worded(self.ranged, items))

    @cached_property
    def terms(self) -> DataFrame:
        """idf with the terms' numbers, as blocks take them."""
        return self.kept(blocks.numbered(text.weighed(blocks.frequency(self.worded), self.train_items, PROTOCOL.min_df)))

    @cached_property
    def packs(self) -> DataFrame:
        return self.kept(blocks.packs(self.worded, self.terms))

    @cached_property
    def vectors(self) -> DataFrame:
        return self.kept(text.vectors(self.counts, self.idf))

    @cached_property
    def positives(self) -> DataFrame:
        return self.kept(self.split.positives)

    @cached_property
    def users(self) -> DataFrame:
        return self.kept(self.positives.select("uid").distinct())

    @cached_property
    def candidates(self) -> DataFrame:
        return self.kept(self.split.cold_items)

    @cached_property
    def history(self) -> DataFrame:
        """The split's history of users with positives, repeats kept."""
        return self.split.train.join(self.users, "uid", "left_semi").select("uid", "item", "event_id")

    @cached_property
    def past(self) -> DataFrame:
        """(uid, item, n): the history without repeats."""
        return self.kept(blocks.counted(self.history.select("uid", "item")))

    @cached_property
    def tally(self) -> DataFrame:
        """The events before the first cut-off by user and item, as the pair set takes them."""
        return self.kept(pairs.tallied(self.dev.train))

    @cached_property
    def text_profiles(self) -> DataFrame:
        return text.profiles(self.history, self.vectors)

    @cached_property
    def dense_profiles(self) -> DataFrame:
        return blocks.dense_profiles(self.past, self.features)

    @cached_property
    def text_scores(self) -> DataFrame:
        return self.kept(blocks.pool_scores(self.past, self.packs, self.terms, self.users, self.candidates))

    @cached_property
    def dense_scores(self) -> DataFrame:
        return self.kept(dense.scores(self.dense_profiles, self.features, self.candidates))

    def ranks(self, *kinds: str, top: int = max(PROTOCOL.ks), pool: DataFrame | None = None, positives: DataFrame | None = None, stats: dict | None = None) -> list[DataFrame]:
        """For each kind (uid, item, score, rank, weight): the first ranks and those of all positives."""
        pool, positives = self.candidates if pool is None else pool, self.positives if positives is None else positives
        found = self.kept(blocks.pool_ranks(self.past, self.packs, self.terms, positives, pool, kinds, top, self.features, stats))
        return [found.where(F.col("kind") == blocks.KINDS.index(k)).drop("kind") for k in kinds]

    @cached_property
    def text_ranks(self) -> DataFrame:
        return self.ranks("text")[0].drop("weight")

    @cached_property
    def dense_ranks(self) -> DataFrame:
        return rank.ranked(self.dense_scores)

    @cached_property
    def history_sizes(self) -> DataFrame:
        return self.split.train.groupBy("uid").agg(F.count("*").alias("n")).join(self.users, "uid", "left_semi")

    @cached_property
    def buckets(self) -> DataFrame:
        """(uid, bucket) of every user with positives, by the number of rows in the whole history."""
        sized = self.users.join(self.history_sizes, "uid", "left")
        return sized.select("uid", core.history_bucket(F.coalesce("n", F.lit(0))).alias("bucket"))
