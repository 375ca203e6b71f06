"""Operator 4: token-id shards with a minimal perfect hash index.

A shard holds the raw ids of consecutive documents (16 or 32 bits each) and an index: a minimal perfect hash from
document key to slot, and per slot a fingerprint of the key, its place, the offset and the length. A lookup in a shard
evaluates one hash, checks one fingerprint and the key itself and slices the payload, so its time doesn't depend on
the shard. Shards are rows of Parquet files below the shared folder: Spark commits them, so a lost executor leaves no
half-written shard. Every shard row has its least and greatest key, so that lookup() over all files opens only the
shards whose statistics admit the key: those of one row group, as documents lie in key order.

Defined results: a null or empty text is just the end id; documents of one id are told apart by their ordinal; a null
id sorts first and has the key NULL_KEY (a row of that very id counts as one more of its ordinals); other columns are ignored; an empty table gives no shards.
"""

from __future__ import annotations

import functools
import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .coding import SegmentCoder
from .common import arrow_schema, quantile_bounds, shared_path, shuffle_partitions, slices, texts_of, with_bucket
from .hashing import spans

END_ID = 0
#: Ids in a shard before the next one begins; a longer document has a shard of its own.
SHARD_IDS = 250_000
#: Bytes of known segments and their ids: what is forgotten is encoded again, and this operator's workers hold little else.
KNOWN_BYTES = 64 << 20
#: Segments that the library encodes in one run.
RUN = 64
NULL_KEY = -(2**63)
#: Salts from here on belong to the displacements.
TRIES = 16
SHARDS = "bucket int, seq int, low long, high long, before long, n_docs long, n_tokens long, width int, keys binary, nulls binary, ordinals binary, seeds binary, slots binary, payload binary"
SLOT = np.dtype([("mark", "<u4"), ("place", "<u4"), ("offset", "<u8"), ("length", "<u8")])
# Fixed value: the letter that stands for a space in byte-level vocabularies.
SPACE = "Ġ"

GOLD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray, salt) -> np.ndarray:
    """A 64-bit finaliser over key and salt (a number, or one a key)."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + (salt.astype(np.uint64) * np.uint64(GOLD) if isinstance(salt, np.ndarray) else np.uint64(salt * GOLD % 2**64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def mix_one(x: int, salt: int) -> int:
    """mix() of plain numbers."""
    z = (x + salt * GOLD) & (2**64 - 1)
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
    return z ^ (z >> 31)


def key_hashes(keys: np.ndarray, ordinals: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(keys.astype(np.int64).view(np.uint64), 1) + mix(ordinals.astype(np.uint64), 2) * (ordinals > 0).astype(np.uint64)


def build_hash(hashes: np.ndarray) -> np.ndarray:
    """Seeds of a minimal perfect hash over distinct hashes: per group a displacement, or -1 - slot for a group of one."""
    n = len(hashes)
    groups = max(1, n // 3)
    group = (mix(hashes, 3) % np.uint64(groups)).astype(np.int64)
    plain = hashes.tolist()
    members: dict[int, list[int]] = {}
    for i, g in enumerate(group.tolist()):
        members.setdefault(g, []).append(i)
    seeds, taken = np.zeros(groups, np.int64), bytearray(n)
    order = sorted(members.values(), key=len, reverse=True)
    at = 0
    while at < len(order) and len(order[at]) > 1:
        own, d = order[at], 0
        while True:
            spot = {mix_one(plain[i], TRIES + d) % n for i in own}
            if len(spot) == len(own) and not any(map(taken.__getitem__, spot)):
                break
            d += 1
        for s in spot:
            taken[s] = 1
        seeds[group[own[0]]] = d
        at += 1
    free = (s for s in range(n) if not taken[s])
    for own in order[at:]:
        seeds[group[own[0]]] = -1 - next(free)
    return seeds


def slots_of(hashes: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    d = seeds[(mix(hashes, 3) % np.uint64(len(seeds))).astype(np.int64)]
    tried = (mix(hashes, TRIES + np.maximum(d, 0)) % np.uint64(n)).astype(np.int64)
    return np.where(d < 0, -1 - d, tried)


def marks_of(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes, 6) >> np.uint64(32)).astype(np.uint32)


class Shard:
    """One shard row, opened for reading."""

    def __init__(self, row: dict):
        self.n, self.width = row["n_docs"], row["width"]
        self.keys, self.nulls, self.ordinals = (np.frombuffer(row[c], t) for c, t in (("keys", "<i8"), ("nulls", "?"), ("ordinals", "<i8")))
        self.seeds, self.slots, self.payload = np.frombuffer(row["seeds"], "<i8"), np.frombuffer(row["slots"], SLOT), row["payload"]

    def find(self, keys: np.ndarray, ordinals: np.ndarray) -> np.ndarray:
        """Slot of each key, or -1 where the fingerprint, or the key at the slot's place, says that the shard hasn't got it."""
        if not self.n:
            return np.full(len(keys), -1)
        h = key_hashes(keys, ordinals)
        slot = slots_of(h, self.seeds, self.n)
        place = self.slots["place"][slot].astype(np.int64)
        there = (self.slots["mark"][slot] == marks_of(h)) & (self.keys[place] == keys) & (self.ordinals[place] == ordinals)
        return np.where(there, slot, -1)

    def ids(self, slot: int) -> np.ndarray:
        at = int(self.slots["offset"][slot]) * self.width
        return np.frombuffer(self.payload, f"<u{self.width}", int(self.slots["length"][slot]), at)

    def get(self, key: int | None, ordinal: int = 0) -> np.ndarray | None:
        slot = int(self.find(np.array([NULL_KEY if key is None else key]), np.array([ordinal]))[0])
        return None if slot < 0 else self.ids(slot)


def pack(docs: list[tuple], width: int) -> dict:
    """A shard row from (key or None, ordinal, payload of `width` byte ids) in order."""
    keys = np.array([NULL_KEY if k is None else k for k, _, _ in docs], "<i8")
    ordinals = np.array([o for _, o, _ in docs], "<i8")
    lens = np.array([len(p) // width for _, _, p in docs], np.int64)
    h = key_hashes(keys, ordinals)
    seeds = build_hash(h)
    slots = np.zeros(len(docs), SLOT)
    at = slots_of(h, seeds, len(docs))
    slots["mark"][at], slots["place"][at], slots["offset"][at], slots["length"][at] = marks_of(h), np.arange(len(docs)), np.cumsum(lens) - lens, lens
    return {
        "low": int(keys.min()), "high": int(keys.max()),
        "n_docs": len(docs), "n_tokens": int(lens.sum()), "width": width, "keys": keys.tobytes(), "nulls": np.array([k is None for k, _, _ in docs]).tobytes(),
        "ordinals": ordinals.tobytes(), "seeds": seeds.astype("<i8").tobytes(), "slots": slots.tobytes(), "payload": b"".join(p for _, _, p in docs),
    }


class LibraryEncoder:
    """The tokenizers library over whole texts, with a memo of segments between safe boundaries.

    A byte-level token that begins with a space stands for a space of the text. Segments without spaces inside are
    therefore encoded many to a run, and each such token opens the next segment.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.kind = np.dtype("<u2" if max(vocab.values()) < 2**16 else "<u4")
        self.width = self.kind.itemsize
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        self.opens[[i for t, i in vocab.items() if t.startswith(SPACE)]] = True
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.coder = SegmentCoder(self._learn, self.kind, KNOWN_BYTES)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), self.kind), np.fromiter(map(len, found), np.int64, len(found))

    def _runs(self, segs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each segment with a space before it; none is empty or has a space inside."""
        ids, _ = self._whole([" " + " ".join(segs[i : i + RUN]) for i in range(0, len(segs), RUN)])
        at = np.flatnonzero(self.opens[ids])
        if len(at) != len(segs):
            raise ValueError("the vocabulary has tokens with spaces inside")
        return ids, np.diff(np.append(at, len(ids)))

    def _learn(self, before: str, segs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        odd = [i for i, s in enumerate(segs) if not s or " " in s] if before else range(len(segs))
        if not before or odd:
            ids, n = np.zeros(0, self.kind), np.zeros(len(segs), np.int64)
            plain = sorted(set(range(len(segs))).difference(odd))
            parts = [self._runs([segs[i] for i in plain]), self._whole([before + segs[i] for i in odd])]
            order = np.array([*plain, *odd], np.int64)
            n[order] = sizes = np.concatenate([p[1] for p in parts])
            ids = np.concatenate([p[0] for p in parts])
            back = np.empty(len(segs), np.int64)
            back[order] = np.cumsum(sizes) - sizes
            return ids[spans(back, n)], n
        return self._runs(segs)

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]  # their tokens may join spaces
        out = self.coder.encode_each(["" if i in whole else t for i, t in enumerate(texts)] if whole else texts)
        for i in whole:
            out[i] = self._whole([texts[i]])[0].tobytes()
        return out


@functools.lru_cache(2)
def encoder(path: str | None = None) -> LibraryEncoder:
    import public_tokenizers as P

    return LibraryEncoder(path or P.path("byte_bpe_50k.json"))


def write_shards(docs: DataFrame, path: str, tokenizer: str | None = None, shard_ids: int = SHARD_IDS, id_col="doc_id", text_col="text") -> None:
    """Encodes docs in ascending id order and writes the shards as Parquet to path."""
    texts = texts_of(docs, id_col, text_col)
    parts = shuffle_partitions(docs.sparkSession)
    bounds = quantile_bounds(texts, "doc_id", 2 * parts)
    dealt = with_bucket(texts, "doc_id", bounds, "bucket").repartition(parts, "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "text")
    schema = arrow_schema(docs.sparkSession.createDataFrame([], SHARDS).schema)

    def run(batches):
        enc = encoder(tokenizer)
        end = np.array([END_ID], f"<u{enc.width}").tobytes()
        bucket, seq, before, held, ids, last, repeats = None, 0, 0, [], 0, None, 0

        def shard():
            row = pack(held, enc.width) | {"bucket": bucket, "seq": seq, "before": before}
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)

        for batch in batches:
            for part in slices(batch, 1, 512):
                for key, b, payload in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), enc.encode(part.column(1).to_pylist()), strict=True):
                    if held and (b != bucket or ids >= shard_ids):
                        yield shard()
                        seq, before = (seq + 1, before + ids) if b == bucket else (0, 0)
                        held, ids = [], 0
                    named = NULL_KEY if key is None else key
                    if named != last:
                        last, repeats = named, 0
                    bucket = b
                    held.append((key, repeats, payload + end))
                    repeats += 1
                    ids += len(payload) // enc.width + 1
        if held:
            yield shard()

    dealt.mapInArrow(run, SHARDS).write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shard rows with `start`: the ids in all shards before them. A shard knows those of its own bucket."""
    shards = spark.read.schema(SHARDS).parquet(path)
    sizes = dict(shards.groupBy("bucket").agg(F.sum("n_tokens")).collect())  # a row a bucket: bounded by the buckets' number
    before, at = [], 0
    for b in range(max(sizes, default=-1) + 1):
        before.append(at)
        at += sizes.get(b, 0)
    start = F.element_at(F.array(*[F.lit(x).cast("long") for x in before or [0]]), F.col("bucket") + 1) + F.col("before")
    return shards.withColumn("start", start)


def lookup(spark: SparkSession, path: str, key: int | None, ordinal: int = 0) -> np.ndarray | None:
    """The ids of one document of the whole output, or None: statistics leave the shards that may have the key."""
    at = NULL_KEY if key is None else key
    for row in spark.read.schema(SHARDS).parquet(path).where((F.col("low") <= at) & (F.col("high") >= at)).toLocalIterator():
        found = Shard(row.asDict()).get(key, ordinal)
        if found is not None:
            return found
    return None


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) by a keyed lookup of every key that the shards name."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    target = arrow_schema(shards.sparkSession.createDataFrame([], schema).schema)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                shard = Shard(row)
                slot = shard.find(shard.keys, shard.ordinals)
                if (slot < 0).any():
                    raise ValueError("a key of the shard is not in its index")
                found = shard.slots[slot]
                crc = [zlib.crc32(shard.ids(s).astype("<u4").tobytes()) for s in slot.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(shard.keys, mask=shard.nulls), pa.array(row["start"] + found["offset"].astype(np.int64)), pa.array(found["length"].astype(np.int64)), pa.array(crc, pa.int64())], schema=target)

    return shards.mapInArrow(run, schema)


def report(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The columns of op4, from shard files written in the shared folder and read back."""
    path = shared_path(docs.sparkSession, "token-shards")
    write_shards(docs, path, tokenizer)
    return read_documents(read_shards(docs.sparkSession, path))
