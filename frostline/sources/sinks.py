"""Writers for splits, reports, vectors and charts."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import xml_escaped


MOST_BARS = 50


@functools.cache
def _own_folder() -> str:
    """A folder of this process, removed when it ends."""
    root = tempfile.mkdtemp(prefix="frostline-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster shares, or in a local one where there is only one machine."""
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _own_folder()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def gzip_csv(df: DataFrame, path: str, *order: str) -> None:
    """Gzip CSV with a header, rows in the given order."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def fingerprint(df: DataFrame) -> DataFrame:
    """(rows, bytes, checksum) that any order of the rows gives; repeated rows count, nulls are empty fields."""
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    head = F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length(line) + 1), F.lit(0)).alias("bytes"), F.coalesce(F.sum(head), F.lit(0)).alias("checksum"))


def manifest(parts: dict[str, DataFrame]) -> DataFrame:
    """(part, rows, bytes, checksum) of named tables, as lines of CSV."""
    frames = [fingerprint(df).select(F.lit(name).alias("part"), "*") for name, df in parts.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def pair_set(df: DataFrame, path: str, about: DataFrame) -> None:
    """Parquet of training pairs in path/pairs, and one row about them as JSON in path/about."""
    df.write.mode("overwrite").parquet(f"{path}/pairs")
    json_report(about, f"{path}/about")


def hash_csv(df: DataFrame, path: str) -> None:
    """CSV of (item, dhash), sixteen hex digits of h."""
    df.select("item", F.lpad(F.hex("h"), 16, "0").alias("dhash")).write.mode("overwrite").option("header", True).csv(path)


def grid_csv(df: DataFrame, path: str, cells: int) -> None:
    """CSV of item and the `cells` numbers of values."""
    df.select("item", *[F.get("values", F.lit(i)).alias(f"c{i}") for i in range(cells)]).write.mode("overwrite").option("header", True).csv(path)


def json_report(df: DataFrame, path: str) -> None:
    """One JSON object a row."""
    df.coalesce(1).write.mode("overwrite").json(path)


def features(df: DataFrame, path: str, tolerance: float = 1e-6) -> None:
    """Parquet of (item, embedding), after checks that ids are unique and vectors finite and of unit length."""
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    bad = df.agg((F.count("*") - F.countDistinct("item")).alias("repeated"), F.count_if(F.isnan(size) | size.isNull() | (F.abs(size - 1) > tolerance)).alias("unfit")).head()
    if bad.repeated or bad.unfit:
        raise ValueError(f"{bad.repeated} repeated items, {bad.unfit} vectors that are not of unit length")
    df.select("item", "embedding").write.mode("overwrite").parquet(path)


def vector_csv(df: DataFrame, path: str) -> None:
    """CSV of item and components with nine significant digits."""
    text = F.array_join(F.transform("embedding", lambda x: F.format_string("%.9g", x.cast("double"))), ",")
    df.select(F.concat_ws(",", F.col("item").cast("string"), text).alias("value")).write.mode("overwrite").text(path)


def bar_chart(df: DataFrame, label: str, value: str, title: str) -> str:
    """An SVG of a small table's bars; only the chart's few rows come to the driver."""
    rows = df.select(xml_escaped(F.col(label).cast("string")).alias("l"), F.col(value).cast("double").alias("v")).limit(MOST_BARS + 1).collect()
    if len(rows) > MOST_BARS:
        raise ValueError(f"a chart has at most {MOST_BARS} bars")
    top = max((r.v for r in rows), default=0.0) or 1.0
    bars = "".join(f'<text x="8" y="{44 + 28 * i}">{r.l}</text><rect x="140" y="{30 + 28 * i}" width="{320 * r.v / top:.1f}" height="18" fill="#47c"/><text x="{148 + 320 * r.v / top:.1f}" y="{44 + 28 * i}">{r.v:g}</text>' for i, r in enumerate(rows))
    name = title.replace("&", "&amp;").replace("<", "&lt;")
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="560" height="{48 + 28 * len(rows)}" font-family="sans-serif" font-size="13"><text x="8" y="18">{name}</text>{bars}</svg>'


def demo(samples: DataFrame, path: str) -> None:
    """Nested rows as JSON text."""
    samples.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
