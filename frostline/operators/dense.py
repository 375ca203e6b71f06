"""Dense vectors: profiles, and block products of users with candidates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1024


def profiles(history: DataFrame, features: DataFrame) -> DataFrame:
    """(uid, profile): unit sum of the vectors of a history; a zero sum stays zero."""
    counted = history.groupBy("uid", "item").agg(F.count("*").alias("n"))
    parts = counted.join(features, "item").select("uid", "n", F.posexplode("embedding").alias("pos", "x"))
    summed = parts.groupBy("uid", "pos").agg(F.sum(F.col("n") * F.col("x").cast("double")).alias("x"))
    whole = summed.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    return whole.select("uid", F.transform("v", lambda e: F.when(F.col("size") == 0, F.lit(0.0)).otherwise(e["x"] / F.col("size"))).alias("profile"))


def _blocks(df: DataFrame, key: str, vector: str, spread: int) -> DataFrame:
    """(ids, matrix): rows of up to BLOCK vectors as one binary matrix each."""

    def pack(batches):
        ids, rows = [], []

        def out():
            return pa.RecordBatch.from_pydict({"ids": [np.array(ids, "<i8").tobytes()], "matrix": [np.array(rows, "<f8").tobytes()]})

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i), rows.append(v)
                if len(ids) == BLOCK:
                    yield out()
                    ids, rows = [], []
        if ids:
            yield out()

    return df.select(key, F.col(vector).cast("array<double>")).repartition(spread, key).mapInArrow(pack, "ids binary, matrix binary")


def scores(profile: DataFrame, features: DataFrame, candidates: DataFrame) -> DataFrame:
    """(uid, item, score) of every user with every candidate, block by block as matrix products."""
    spread = int(profile.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    users = _blocks(profile, "uid", "profile", spread)
    pool = _blocks(features.join(candidates, "item", "left_semi"), "item", "embedding", max(1, spread // 4))
    pairs = users.crossJoin(pool.toDF("ids2", "matrix2"))  # of blocks: the stated users against the whole pool

    def multiply(batches):
        for batch in batches:
            for a, x, b, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = np.frombuffer(a, "<i8"), np.frombuffer(b, "<i8")
                s = np.frombuffer(x).reshape(len(a), -1) @ np.frombuffer(y).reshape(len(b), -1).T
                yield pa.RecordBatch.from_pydict({"uid": np.repeat(a, len(b)), "item": np.tile(b, len(a)), "score": s.ravel()})

    return pairs.mapInArrow(multiply, "uid long, item long, score double").withColumn("score", F.round("score", 9))


def most_similar_pairs(features: DataFrame, among: DataFrame, n: int) -> DataFrame:
    """(item_a, item_b, similarity) of the n most similar pairs of the stated items, by cosine.

    Blocks of the items meet each other; a pair of blocks yields its n best pairs.
    """
    spread = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = features.join(among, "item", "left_semi")
    left, right = _blocks(some, "item", "embedding", max(1, spread // 4)), _blocks(some, "item", "embedding", spread)

    def unit(x: np.ndarray) -> np.ndarray:
        size = np.sqrt((x * x).sum(1, keepdims=True))
        return np.where(size > 0, x / np.where(size > 0, size, 1), 0)

    def best(batches):
        for batch in batches:
            for a, x, b, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = np.frombuffer(a, "<i8"), np.frombuffer(b, "<i8")
                s = np.round(unit(np.frombuffer(x).reshape(len(a), -1)) @ unit(np.frombuffer(y).reshape(len(b), -1)).T, 9)
                i, j = np.nonzero(a[:, None] < b[None])
                order = np.lexsort((b[j], a[i], -s[i, j]))[:n]
                yield pa.RecordBatch.from_pydict({"item_a": a[i[order]], "item_b": b[j[order]], "similarity": s[i[order], j[order]]})

    pairs = left.crossJoin(right.toDF("ids2", "matrix2")).mapInArrow(best, "item_a long, item_b long, similarity double")
    return pairs.orderBy(F.desc("similarity"), "item_a", "item_b").limit(n)
