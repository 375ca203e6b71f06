"""Operator 1: document fingerprints by consistent weighted sampling, in DataFrame functions only.

Terms are the lower-cased words of a text, weights their counts. For term and coordinate two hashes give r and c, two
Gamma(2, 1) draws, and b, a uniform one; with t = floor(ln w / r + b) the term's value is ln c - r * (t - b + 1), and
the coordinate's sample is the (term, t) of least value, named by a third hash. Two texts agree on a coordinate with a
probability equal to their generalised Jaccard similarity, the sum of smaller over the sum of larger weights.

Documents are dealt once, by ranges of id; texts, counts and samples of a document then stay in its partition.
Defined results: a null or empty text, or one of white space, has the fingerprint EMPTY in every coordinate and agrees
with its like only; rows of one id follow each other in text order; null ids come first, but the last document is
followed by the least id that is not null; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import marks_of, quantile_bounds, shuffle_partitions, texts_of, with_bucket

WIDTH = 32
EMPTY = "ffffffff"


def _unit(h: Column, shift: int, bits: int) -> Column:
    """A uniform in (0, 1) from some bits of a hash."""
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("double") + F.lit(0.5)) * F.lit(2.0**-bits)


def sample(term: Column, log_weight: Column, k: int) -> Column:
    """Coordinate k of one term: its value as the high half, a hash of (term, t) as the low half of a long."""
    h = F.xxhash64(term, F.lit(k))
    g = F.xxhash64(h)
    r = -F.log(_unit(h, 0, 21) * _unit(h, 43, 21))
    b = _unit(h, 21, 22)
    log_c = F.log(-F.log(_unit(g, 0, 32) * _unit(g, 32, 32)))
    t = F.floor(log_weight / r + b)
    value = log_c - r * (t - b + F.lit(1.0))  # within -2000 .. 2000 for any count, so this keeps its order:
    high = F.floor((value + F.lit(2000.0)) * F.lit(float(1 << 19)))
    return F.shiftleft(high, 32).bitwiseOR(F.shiftrightunsigned(F.xxhash64(g, t), 32))


def fingerprints(texts: DataFrame, keys: list[str], bodies: list[str], width: int = WIDTH) -> DataFrame:
    """(*keys, body_0, ...): a fingerprint of each body column by key, null where a body has no words.

    A term of one weight in several bodies is sampled once. Rows dealt by one of keys aren't dealt anew.
    """
    every = F.filter(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(c).alias("body")) for i, c in enumerate(bodies)]), lambda s: s["body"].isNotNull())
    words = texts.select(*keys, F.inline(every)).select(*keys, "kind", F.explode(F.split(F.lower("body"), r"\s+")).alias("word")).where("word != ''")
    counts = [F.count(F.when(F.col("kind") == i, 1)).alias(f"n_{i}") for i in range(len(bodies))]
    counted = words.groupBy(*keys, F.xxhash64("word").alias("term")).agg(*counts)
    # a row for each weight of the term, with the bodies that have it as bits
    weights = F.array_distinct(F.filter(F.array(*[f"n_{i}" for i in range(len(bodies))]), lambda n: n > 0))
    rows = counted.select("*", F.explode(weights).alias("w"))
    mask = sum((F.when(F.col(f"n_{i}") == F.col("w"), F.lit(1 << i)).otherwise(F.lit(0)) for i in range(len(bodies))), F.lit(0))
    rows = rows.select(*keys, mask.alias("mask"), "term", F.log(F.col("w").cast("double")).alias("lw"))
    names = [f"sample_{k}" for k in range(width)]
    least = rows.groupBy(*keys, "mask").agg(*[F.min(sample(F.col("term"), F.col("lw"), k)).alias(n) for k, n in enumerate(names)])
    owned = lambda i: F.col("mask").bitwiseAND(F.lit(1 << i)) > 0
    by_body = least.groupBy(*keys).agg(*[F.min(F.when(owned(i), F.col(n))).alias(f"{n}_{i}") for i in range(len(bodies)) for n in names])
    return by_body.select(*keys, *[F.when(F.col(f"sample_0_{i}").isNotNull(), written([F.col(f"{n}_{i}") for n in names])).alias(f"{c}_print") for i, c in enumerate(bodies)])


def written(samples: list[Column]) -> Column:
    """The fingerprint string: eight hex digits a coordinate."""
    return F.lower(F.concat(*[F.lpad(F.hex(s.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0") for s in samples]))


def likeness(a: str, b: str, width: int = WIDTH) -> Column:
    """The share of equal coordinates of two fingerprint strings."""
    same = [(F.substring(a, 8 * i + 1, 8) == F.substring(b, 8 * i + 1, 8)).cast("int") for i in range(width)]
    total = same[0]
    for s in same[1:]:
        total = total + s
    return total / F.lit(float(width))


def fingerprint_documents(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    texts = texts_of(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()).repartition(shuffle_partitions(docs.sparkSession), "row")
    found = fingerprints(texts, ["row"], ["text"], width)
    return texts.select("doc_id", "row").join(found, "row", "left").select("doc_id", F.coalesce("text_print", F.lit(EMPTY * width)).alias("fingerprint"))


def report(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The columns of op1: each document, its edited text and its successor."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    texts = texts_of(docs)
    bounds = quantile_bounds(texts, "doc_id", 4 * parts)
    # a document that opens a range also closes the range before; the first document of all closes the last one
    first = texts.agg(F.min("doc_id")).head()[0]
    texts = with_bucket(texts, "doc_id", bounds, "own")
    is_open = (F.col("own") > 0) & (F.get(marks_of(bounds), F.col("own") - 1) == F.col("doc_id")) if bounds else F.lit(False)
    last = len(bounds)
    copies = F.array_compact(F.array(
        F.struct(F.col("own").alias("bucket"), F.lit(0).alias("guest")),
        F.when(is_open, F.struct((F.col("own") - 1).alias("bucket"), F.lit(1).alias("guest"))),
        F.when(F.col("doc_id") == F.lit(first), F.struct(F.lit(last).alias("bucket"), F.lit(2).alias("guest"))) if first is not None else F.lit(None),
    ))
    dealt = texts.select("doc_id", "text", F.inline(copies)).repartition(parts, "bucket")
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text")
    pairs = dealt.withColumn("following", F.lead("text").over(order)).withColumn("row", F.row_number().over(order))
    cut = F.floor(F.length("text") / 4).cast("int")
    edited = F.when(F.col("guest") == 0, F.concat(F.substring("text", F.lit(1), F.length("text") - cut), F.substring(F.coalesce("following", F.lit("")), F.lit(1), cut)))
    both = pairs.select("bucket", "row", "doc_id", "guest", "text", edited.alias("edited"))
    keys = ["bucket", "row"]
    prints = fingerprints(both, keys, ["text", "edited"], width)
    facts = both.select(*keys, "doc_id", "guest", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    none = EMPTY * width
    joined = facts.join(prints, keys, "left").select(*keys, "doc_id", "guest", "n_chars", "edited_sha256", F.coalesce("text_print", F.lit(none)).alias("fingerprint"), F.coalesce("edited_print", F.lit(none)).alias("edited_fingerprint"))
    follow = joined.withColumn("next_fingerprint", F.lead("fingerprint").over(Window.partitionBy("bucket").orderBy("row")))
    return follow.where("guest = 0").select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint", width).alias("near_edited"), likeness("fingerprint", "next_fingerprint", width).alias("near_next"))
