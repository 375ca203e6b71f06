"""Corpus pipeline: language, near-duplicates, personal data, mixture, token ids.

Every stage takes what its predecessor kept and, but for the last, returns the columns of documents. Null and empty
texts have no language and go in the first stage; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frostline.llm import bpe, langid, minhash, mixing, pii
from frostline.llm.common import cut, map_slices, texts_of

#: Shares of the mixture; toxic text gets none, and good text is never thinned (see mix_documents).
MIXTURE = {"good": 0.8, "plain": 0.2, "toxic": 0.0}


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language and texts whose best language has under half of the words."""
    return langid.accept(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: that of least id, null ids last, the first read among equal ids.

    Rows are told apart by their place, so null and repeated ids are rows like others. docs must be read alike each
    time, as files and checkpoints are.
    """
    placed = docs.withColumn("_place", F.monotonically_increasing_id())
    found = minhash.near_duplicates(placed, id_col="_place").select(F.col("doc_id").alias("_place"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_place")
    stay = placed.select("_place", "doc_id").join(found, "_place").groupBy("component_id").agg(F.min(order).alias("least")).select(F.col("least._place").alias("_place"))
    return placed.join(stay, "_place", "left_semi").select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind."""
    return pii.redact_documents(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go or repeat by rates that meet MIXTURE."""
    return mixing.mix_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), MIXTURE)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, copy, n_tokens, ids, round_trip): ids of the text, and whether decoding them gives the text again.

    copy tells the rows that the mixture repeats apart: 1, 2, ... of one id and ids.
    """

    def run(keys, texts):
        v = bpe.vocabulary()
        ids = [bpe.np.frombuffer(x, "<u4").astype("i4") for x in v.encode(texts)]
        back = [v.decode(x.tolist()) == t.encode("utf-8", "surrogatepass") for x, t in zip(ids, texts, strict=True)]
        return {"doc_id": keys, "n_tokens": list(map(len, ids)), "ids": ids, "round_trip": back}

    found = map_slices(texts_of(docs), run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")
    alike = Window.partitionBy("doc_id", F.xxhash64("ids")).orderBy("n_tokens")
    return found.select("doc_id", F.row_number().over(alike).alias("copy"), "n_tokens", "ids", "round_trip")


STAGES = [("language", languages), ("near duplicates", near_duplicates), ("personal data", personal_data), ("mixture", mixture), ("token ids", token_ids)]

#: Trained models and hashing are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
