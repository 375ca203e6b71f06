"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from itertools import islice
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents, and bytes of their texts, handled at a time inside a Python worker; bounds memory, never drops rows.
SLICE, SLICE_BYTES = 256, 1 << 20
#: Bytes that all memos of a worker hold together, about, before room is made.
MEMO_BYTES = 48 << 20
#: Narrow rows of a checkpoint that go in one file.
FILE_ROWS = 100_000
#: What a dict entry of two small objects takes besides their contents.
ENTRY = 200


class Memo(dict):
    """A dict of what a worker has worked out, bounded by bytes.

    Workers outlive a stage: when the worker's memos are full, those of other operators are emptied, and a full memo
    keeps its oldest third, for what is frequent was met early.
    """

    all: ClassVar[weakref.WeakSet] = weakref.WeakSet()

    def __init__(self, most: int = MEMO_BYTES):
        self.most, self.held = most, 0
        Memo.all.add(self)

    __hash__ = object.__hash__

    def make_room(self) -> int | None:
        """How many of the oldest entries are left, where room had to be made."""
        others = [m for m in Memo.all if m is not self]
        if self.held + sum(m.held for m in others) <= self.most:
            return None
        for m in others:
            m.clear()
            m.held = 0
        if self.held <= self.most:
            return None
        kept = dict(islice(self.items(), len(self) // 3))
        self.clear()
        self.update(kept)
        self.held //= 3
        return len(kept)

    def learn(self, keys: list, values: list, each: int | None = None) -> None:
        """each: bytes a value takes, by default its length."""
        self.update(zip(keys, values, strict=True))
        self.held += sum(map(len, keys)) + (sum(map(len, values)) if each is None else each * len(keys)) + ENTRY * len(keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoints(spark: SparkSession) -> None:
    """Make reliable checkpoints possible: the folder the cluster names, else (tests, on one machine) one of our own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not named:
            named = tempfile.mkdtemp(prefix="frostline-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Materialise df in the shared checkpoint folder and cut its lineage there.

    Given the number of narrow rows that df has about, it is written in no more files than they need.
    """
    checkpoints(df.sparkSession)
    return (df if rows is None else df.repartition(-(-max(1, rows) // FILE_ROWS))).checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just (doc_id, text), whatever else df carries; a null text counts as empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def slices(batch: pa.RecordBatch, column: int, rows: int = SLICE, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of a batch of at most `rows` rows and `most` bytes in a column of texts; a longer text is a run of its own."""
    n = batch.num_rows
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False) if pa.types.is_string(batch.schema.field(column).type) else np.zeros(n, np.int64)
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < n:
        full = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
        end = min(n, at + rows, max(at + 1, full))
        yield batch.slice(at, end - at)
        at = end


def map_slices(df: DataFrame, fn: Callable[[list, list], dict], schema: str, size: int = SLICE) -> DataFrame:
    """Run fn(ids, texts) -> column lists over slices of (doc_id, text) rows, without a shuffle."""
    fields = df.sparkSession.createDataFrame([], schema).schema
    target = arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, size):
                out = fn(part.column(0).to_pylist(), part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def arrow_schema(fields) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(fields)


def quantile_bounds(df: DataFrame, key: str, buckets: int) -> list:
    """At most `buckets` ascending lower bounds that are values of key; the list's size does not grow with the rows."""
    marks = [i / buckets for i in range(1, buckets)]
    found = df.select(F.percentile_approx(key, marks, 20 * buckets)).head()[0] if marks else None
    return sorted(set(found or []))


def marks_of(bounds: list) -> Column:
    """Ascending whole numbers as one array literal, however many."""
    return F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")


def with_bucket(df: DataFrame, key: str, bounds: list, name: str) -> DataFrame:
    """df with the index of the range that key falls in: how many bounds are at most key (null: 0).

    A binary search, one projection a step; without lambdas, whose variables would keep equal exchanges from being reused.
    """
    marks, n = marks_of(bounds), len(bounds)
    out, at = df.withColumn(name, F.lit(0)), F.col(name)
    for i in range(n.bit_length() - 1, -1, -1):
        onward = at + F.lit(1 << i)
        out = out.withColumn(name, F.when((onward <= n) & (F.get(marks, onward - 1) <= F.col(key)), onward).otherwise(at))
    return out


#: A key that holds more than one in SHARE of a table's rows is hot, if it holds more than HOT_ROWS.
SHARE, HOT_ROWS, MOST_SALTS = 1000, 1000, 64


def hot_keys(counts: DataFrame, n: str, total: int, least: int = HOT_ROWS) -> list[tuple]:
    """counts' keys that are hot, each with the salts to spread it over: fewer than SHARE, whatever the table's size."""
    share = max(least, -(-total // SHARE))
    if total <= share:
        return []
    salts = F.least(F.lit(MOST_SALTS), F.ceil(F.col(n) / share)).cast("int")
    return list(map(tuple, counts.where(F.col(n) > share).withColumn("_salts", salts).drop(n).collect()))


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], hot: list[tuple], by: str) -> DataFrame:
    """left joined with right on keys. left's rows of a hot key go to one of its salts by a hash of `by`, right's to all."""
    if not hot:
        return left.join(right, keys)
    schema = ", ".join(f"`{k}` {left.schema[k].dataType.simpleString()}" for k in keys)
    few = F.broadcast(left.sparkSession.createDataFrame(hot, f"{schema}, _salts int"))  # fewer than SHARE rows
    one = left.join(few, keys).withColumn("_salt", F.pmod(F.xxhash64(by), F.col("_salts")).cast("int")).drop("_salts")
    every = right.join(few, keys).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    warm = one.join(every, [*keys, "_salt"]).drop("_salt")
    return left.join(few, keys, "left_anti").join(right, keys).unionByName(warm)
