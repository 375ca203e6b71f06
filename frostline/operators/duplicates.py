"""Exact and perceptual duplicates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1024


def exact_groups(contents: DataFrame) -> DataFrame:
    """(digest, n, first_item, last_item) of contents (item, content) that occur more than once."""
    rows = contents.select("item", F.sha2(F.col("content").cast("binary"), 256).alias("digest"))
    return rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("item").alias("first_item"), F.max("item").alias("last_item")).where("n > 1")


def cross_boundary(contents: DataFrame, train: DataFrame, cold: DataFrame) -> DataFrame:
    """(digest, n) of groups with an item on either side."""
    rows = contents.select("item", F.sha2(F.col("content").cast("binary"), 256).alias("digest"))
    sides = train.select("item", F.lit(True).alias("is_train")).join(cold.select("item", F.lit(True).alias("is_cold")), "item", "full_outer")
    grouped = rows.join(sides, "item").groupBy("digest").agg(F.count("*").alias("n"), F.bool_or(F.coalesce("is_train", F.lit(False))).alias("t"), F.bool_or(F.coalesce("is_cold", F.lit(False))).alias("c"))
    return grouped.where("t and c").select("digest", "n")


def _hash_blocks(df: DataFrame, spread: int) -> DataFrame:
    """(ids, hashes): rows of up to BLOCK items as two binary columns."""

    def pack(batches):
        for batch in batches:
            ids, h = (batch.column(i).to_numpy().astype("<i8") for i in (0, 1))
            for lo in range(0, len(ids), BLOCK):
                yield pa.RecordBatch.from_pydict({"ids": [ids[lo : lo + BLOCK].tobytes()], "hashes": [h[lo : lo + BLOCK].tobytes()]})

    return df.repartition(spread, "item").mapInArrow(pack, "ids binary, hashes binary")


def nearest_hash(cold: DataFrame, train: DataFrame) -> DataFrame:
    """(item, nearest_item, distance): the train hash of fewest differing bits, the smaller item on ties.

    The cold items are the stated queries: blocks of them meet blocks of the distinct train hashes, and a pair of blocks
    yields one row a query.
    """
    spread = int(cold.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = train.groupBy("h").agg(F.min("item").alias("item")).select("item", "h")
    pairs = _hash_blocks(distinct, spread).crossJoin(_hash_blocks(cold.select("item", "h"), max(1, spread // 4)).toDF("ids2", "hashes2"))

    def nearest(batches):
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, h, asked, g = (np.frombuffer(x, "<i8") for x in row)
                bits = np.bitwise_count(g[:, None].view(np.uint64) ^ h[None].view(np.uint64)).astype(np.int64)
                least = bits.min(1)
                best = np.where(bits == least[:, None], ids[None], np.iinfo(np.int64).max).min(1)
                yield pa.RecordBatch.from_pydict({"item": asked, "nearest_item": best, "distance": least.astype(np.int32)})

    found = pairs.mapInArrow(nearest, "item long, nearest_item long, distance int")
    best = found.groupBy("item").agg(F.min(F.struct("distance", "nearest_item")).alias("m"))
    return best.select("item", "m.nearest_item", "m.distance")


def distance_histogram(nearest: DataFrame) -> DataFrame:
    return nearest.groupBy("distance").agg(F.count("*").alias("items"))


def clean_candidates(cold: DataFrame, train: DataFrame, cold_hashes: DataFrame, train_hashes: DataFrame) -> DataFrame:
    """Cold items whose hash no train item has."""
    seen = cold_hashes.join(train_hashes.select("h").distinct(), "h", "left_semi").select("item")
    return cold.select("item").join(seen, "item", "left_anti")


def boundary_audit(nearest: DataFrame, within: tuple[int, ...] = (0, 2, 5)) -> DataFrame:
    """(items, within_0, within_2, within_5): how many items have a train hash as near."""
    return nearest.agg(F.count("*").alias("items"), *[F.count_if(F.col("distance") <= d).alias(f"within_{d}") for d in within])


def nearest_examples(nearest: DataFrame, n: int = 100) -> DataFrame:
    """The n items nearest to a train hash (the report's fixed number), ties by item."""
    return nearest.orderBy("distance", "item").limit(n)
