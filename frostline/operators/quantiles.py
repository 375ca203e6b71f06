"""Exact order statistics and distribution measures that don't sort everything in one task."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_index(n: int, p: float) -> int:
    """Index round((n - 1) * p), halves to even."""
    return int(Decimal((n - 1) * p).quantize(Decimal(1), ROUND_HALF_EVEN))


def values_at(df: DataFrame, column: str, indexes: list[int], n: int | None = None) -> list:
    """The values at indexes of the sorted column (None beyond its ends): a sketch brackets each, and only the brackets
    are sorted."""
    n = df.count() if n is None else n
    inside = [i for i in indexes if 0 <= i < n]
    if not inside:
        return [None] * len(indexes)
    x = F.col(column)
    marks = [min(1.0, max(0.0, (i + 0.5) / n + d)) for i in inside for d in (-0.01, 0.01)]
    ends = df.select(F.percentile_approx(column, marks, 10_000)).head()[0]
    brackets = list(zip(ends[::2], ends[1::2], strict=True))
    counts = df.agg(*[c for low, high in brackets for c in (F.count_if(x < low), F.count_if(x.between(low, high)))]).head()
    found = []
    for i, (low, high), below, within in zip(inside, brackets, counts[::2], counts[1::2], strict=True):
        if below <= i < below + within:
            part, at = df.where(x.between(low, high)), i - below
        elif i < below:
            part, at = df.where(x < low), i
        else:
            part, at = df.where(x > high), i - below - within
        found.append((part.select(F.lit(i).alias("i"), column).orderBy(column).offset(at).limit(1)))
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionAll(f)
    by_index = dict(map(tuple, rows.distinct().collect()))  # a row an index
    return [by_index.get(i) for i in indexes]


def value_at(df: DataFrame, column: str, index: int, n: int | None = None):
    return values_at(df, column, [index], n)[0]


def histogram(df: DataFrame, column: str) -> DataFrame:
    """(value, n, upto, total): distinct values with counts and running counts; as many rows as distinct values."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    # values are activity counts, whose number of distinct ones is small against the rows
    order = Window.orderBy("value")
    return counts.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(Window.partitionBy()))


def at_index(index: Column) -> Column:
    """Over a histogram: the value at a 0-based index of the sorted multiset."""
    return F.min(F.when(F.col("upto") > index, F.col("value")))


def summary(df: DataFrame, column: str) -> DataFrame:
    """(min, median, p90, max): the median averages the middle pair, p90 is at the nearest index, halves to even."""
    h = histogram(df, column)
    n = F.col("total")
    return h.agg(
        F.min("value").alias("min"),
        ((at_index(F.floor((n - 1) / 2)) + at_index(F.floor(n / 2))) / F.lit(2.0)).alias("median"),
        at_index(F.bround((n - 1) * F.lit(0.9)).cast("long")).alias("p90"),
        F.max("value").alias("max"),
    )


def nearest_rank(df: DataFrame, column: str, percents: tuple[int, ...] = (25, 50, 75, 90, 95, 99)) -> DataFrame:
    """The ceil(p * n)-th smallest for each percentage."""
    h = histogram(df, column)
    return h.agg(*[at_index(F.ceil(F.col("total") * p / 100) - 1).alias(f"p{p}") for p in percents])


def gini(df: DataFrame, column: str) -> DataFrame:
    """(gini): 0 for no rows or a zero sum. Ranks of equal values add up per distinct value."""
    h = histogram(df, column)
    n, x = F.col("n").cast("double"), F.col("value").cast("double")
    first = F.col("upto") - F.col("n") + 1
    ranks = n * (first + F.col("upto")) / F.lit(2.0)
    t, m = F.sum(x * n), F.max("total").cast("double")
    return h.agg(F.when(F.coalesce(t, F.lit(0.0)) == 0, F.lit(0.0)).otherwise(2 * F.sum(ranks * x) / (m * t) - (m + 1) / m).alias("gini"))


def head_share(df: DataFrame, column: str, percents: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """(percent, share): part of the sum that the ceil(percent * n) largest rows hold."""
    h = histogram(df, column)
    above = F.col("total") - F.col("upto")  # rows of larger values
    rows = h.select("*", F.explode(F.array(*map(F.lit, percents))).alias("percent"))
    heads = F.ceil(F.col("total") * F.col("percent") / 100)
    taken = F.greatest(F.lit(0), F.least(F.col("n"), heads - above))
    return rows.groupBy("percent").agg((F.sum(taken * F.col("value")) / F.sum(F.col("n") * F.col("value"))).alias("share"))


def _bounds(df: DataFrame, key: str, buckets: int) -> list:
    found = df.select(F.percentile_approx(key, [i / buckets for i in range(1, buckets)], 50 * buckets)).head()[0]
    return sorted(set(found or []))


def bucket(key: str, bounds: list) -> Column:
    """How many of the ascending bounds are at most key."""
    marks = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<long>")
    return F.size(F.filter(marks, lambda b: b <= F.col(key)))


def indexed(df: DataFrame, key: str, *ties: str, buckets: int = 64) -> DataFrame:
    """Adds `position`, the 0-based index in the order of (key, *ties), by ranges of key rather than one global sort."""
    bounds = _bounds(df, key, buckets)
    rows = df.withColumn("_bucket", bucket(key, bounds))
    counts = dict(rows.groupBy("_bucket").count().collect())  # at most `buckets` rows
    before, at = [], 0
    for b in range(len(bounds) + 1):
        before.append(at)
        at += counts.get(b, 0)
    inner = F.row_number().over(Window.partitionBy("_bucket").orderBy(key, *ties)) - 1
    return rows.withColumn("position", inner + F.element_at(F.array(*[F.lit(x).cast("long") for x in before]), F.col("_bucket") + 1)).drop("_bucket")


def count_upto(points: DataFrame, point: str, asked: DataFrame, at: str, buckets: int = 64) -> DataFrame:
    """asked with `available`: how many points are at most the row's `at`, by ranges and a running count in each."""
    bounds = _bounds(points, point, buckets)
    counts = dict(points.groupBy(bucket(point, bounds)).count().collect())
    before, n = [], 0
    for b in range(len(bounds) + 1):
        before.append(n)
        n += counts.get(b, 0)
    both = asked.withColumn("_x", F.col(at)).withColumn("_one", F.lit(0)).unionByName(points.select(F.col(point).alias("_x"), F.lit(1).alias("_one")), allowMissingColumns=True)
    both = both.withColumn("_bucket", bucket("_x", bounds))
    upto = F.sum("_one").over(Window.partitionBy("_bucket").orderBy("_x").rangeBetween(Window.unboundedPreceding, 0))
    counted = both.withColumn("available", upto + F.element_at(F.array(*[F.lit(x).cast("long") for x in before]), F.col("_bucket") + 1))
    return counted.where("_one = 0").drop("_x", "_one", "_bucket")
