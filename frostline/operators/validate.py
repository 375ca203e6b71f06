"""Checks as tables of violations, and comparisons of metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def endpoint_differences(actual: DataFrame, expected: DataFrame, keys: list[str], tolerance: float = 1e-12) -> DataFrame:
    """(*keys, metric, actual, expected) where two metric tables differ by more than the tolerance, or one lacks a row."""
    names = [c for c in actual.columns if c not in keys]

    def tall(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias(name)) for c in names])).alias("m")).select(*keys, "m.*")

    both = tall(actual, "actual").join(tall(expected, "expected"), [*keys, "metric"], "full_outer")
    return both.where(F.col("actual").isNull() | F.col("expected").isNull() | (F.abs(F.col("actual") - F.col("expected")) > tolerance))


def vector_faults(features: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(rows, repeated, not_finite, not_unit)."""
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return features.agg(F.count("*").alias("rows"), (F.count("*") - F.countDistinct("item")).alias("repeated"), F.count_if(odd).alias("not_finite"), F.count_if(~odd & (F.abs(size - 1) > tolerance)).alias("not_unit"))


def expect_counts(df: DataFrame, **expected: int) -> None:
    """Raises unless rows, and distinct values of the named columns, are as many as expected."""
    row = df.agg(F.count("*").alias("rows"), *[F.countDistinct(c).alias(c) for c in expected if c != "rows"]).head().asDict()
    wrong = {k: (row[k], n) for k, n in expected.items() if row[k] != n}
    if wrong:
        raise ValueError(f"counts differ: {wrong}")


def set_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(only_a, only_b, both) of two tables' keys."""
    marked = a.select(key).distinct().withColumn("a", F.lit(True)).join(b.select(key).distinct().withColumn("b", F.lit(True)), key, "full_outer")
    return marked.agg(F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"))
