"""What is in an image archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jpeg import jpeg_dimensions


def stats(images: DataFrame) -> DataFrame:
    """(members, bytes, packed, ratio, unreadable, portrait, landscape, square)."""
    d = images.select("size", "packed", jpeg_dimensions("content").alias("d")).select("size", "packed", "d.width", "d.height")
    return d.agg(F.count("*").alias("members"), F.sum("size").alias("bytes"), F.sum("packed").alias("packed"), F.round(F.sum("packed") / F.sum("size"), 6).alias("ratio"), F.count_if(F.col("width").isNull()).alias("unreadable"), F.count_if(F.col("height") > F.col("width")).alias("portrait"), F.count_if(F.col("height") < F.col("width")).alias("landscape"), F.count_if(F.col("height") == F.col("width")).alias("square"))


def common_sizes(images: DataFrame, n: int = 20) -> DataFrame:
    d = images.select(jpeg_dimensions("content").alias("d")).select("d.width", "d.height").where("width is not null")
    return d.groupBy("width", "height").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width", "height").limit(n)


def extensions(images: DataFrame) -> DataFrame:
    return images.groupBy(F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1)).alias("extension")).agg(F.count("*").alias("n"))


def duplicates(images: DataFrame) -> DataFrame:
    """(digest, n, items): members of equal checksum and size whose content is equal too."""
    suspects = images.groupBy("crc", "size").agg(F.count("*").alias("k")).where("k > 1").select("crc", "size")
    rows = images.join(suspects, ["crc", "size"], "left_semi").select("item", F.sha2("content", 256).alias("digest"))
    return rows.groupBy("digest").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("item")).alias("items")).where("n > 1").orderBy(F.desc("n"), "digest")


def names(images: DataFrame) -> DataFrame:
    """(name, item, suffix): the stem as a number and the suffix in lower case; a name that leaves its folder is an error."""
    unsafe = F.col("name").rlike(r"^[/\\]|(^|[/\\])\.\.([/\\]|$)")
    safe = F.when(unsafe, F.raise_error(F.concat(F.lit("unsafe member name: "), "name"))).otherwise(F.col("name"))
    stem = F.regexp_extract(safe, r"([^/\\]*)\.[A-Za-z0-9]+$", 1)
    return images.select("name", stem.try_cast("long").alias("item"), F.lower(F.regexp_extract(safe, r"\.([A-Za-z0-9]+)$", 1)).alias("suffix"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, digest) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("digest"))
