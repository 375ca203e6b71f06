"""Text scores by blocks of users: an item's terms move once to each block whose histories hold it.

A history's vectors are many times its rows, so that moving them to each of its users takes far more disk than the
tables have. Here whole users are dealt to blocks of BLOCK_ROWS rows of history or more (`block_count`). A block gets its
rows, the terms of its distinct items as packed numbers and counts, and all inverse frequencies; it sums the vectors of
some users at a time, and only the asked scores leave it. Orders of the whole pool are formed there too (`pool_ranks`): users times
candidates is far more than the tables have, so that only the first ranks and those of positives leave a block.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from hashlib import md5
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..config import PROTOCOL

#: Rows of history of a block, about; a user's history is never divided.
BLOCK_ROWS = 250_000
#: A block may have so many times BLOCK_ROWS while its items have at most BLOCK_NUMBERS terms or components.
BLOCK_TIMES, BLOCK_NUMBERS = 4, 20_000_000
#: Rows of scores of a block, about.
BLOCK_OUT = 4_000_000
#: Sums of users that are held at a time, as numbers.
CELLS = 4_000_000
#: Counts of terms that get their numbers in a part, about.
PART_ROWS = 1_000_000
#: Rows in which the inverse frequencies travel.
PARTS = 64
NONE = np.zeros(0, np.int64)


def numbered(idf: DataFrame) -> DataFrame:
    """(term, tid, idf): terms get numbers that are nearly dense, by parts and not in one task."""
    part = F.pmod(F.xxhash64("term"), F.lit(PARTS))
    place = F.row_number().over(Window.partitionBy("part").orderBy("term")) - 1
    return idf.withColumn("part", part).select("term", (place * PARTS + F.col("part")).cast("int").alias("tid"), "idf")


def counted(history: DataFrame) -> DataFrame:
    """(uid, item, n): how often each item occurs in a user's history."""
    return history if "n" in history.columns else history.groupBy("uid", "item").agg(F.count("*").alias("n")).persist()


def block_count(rows: int, items: int, numbers: int, cores: int) -> int:
    """How many blocks users are dealt to, for so many rows of history and items with so many numbers in all.

    What a block needs of the items moves to it, so that fewer blocks move less. They are as large as memory allows: a
    block has at most as many items as rows. There are no fewer than cores unless blocks of BLOCK_ROWS are fewer.
    """
    most = BLOCK_ROWS * BLOCK_TIMES
    if numbers > BLOCK_NUMBERS:
        most = min(most, max(BLOCK_ROWS, BLOCK_NUMBERS * items // numbers))
    return max(1, -(-rows // most), min(-(-rows // BLOCK_ROWS), cores))


def squeezed(x: np.ndarray) -> bytes:
    """Small numbers, each kind of their bytes together and compressed."""
    return pa.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def loosened(raw: bytes, n: int) -> np.ndarray:
    flat = np.frombuffer(pa.decompress(raw, 4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


#: What packed words look like beside their key.
WORDED = "n int, size int, words binary, v binary"


def worded(titles: DataFrame, items: DataFrame) -> DataFrame:
    """(item, trained, n, size, words, v): the words of items that have some and their counts, packed.

    items has (item, trained); titles may repeat an item. Texts are counted and packed where they are read, so that
    neither they nor their counts move, but packed words, once.
    """
    told = titles.select(F.col("item").cast("long").alias("item"), F.lower("title").alias("title")).mapInArrow(_count_words, f"item long, {WORDED}")
    lists = told.join(items, "item").groupBy("item", "trained").agg(F.collect_list(F.struct("n", "size", "words", "v")).alias("l"))
    return lists.mapInArrow(_add_words, f"item long, trained boolean, {WORDED}")


def frequency(packed: DataFrame) -> DataFrame:
    """(term, df) over the trained items of worded: each of its partitions counts and packs its words before they move."""
    parts = max(PARTS, -(-(packed.agg(F.sum("n")).head()[0] or 0) // PART_ROWS))

    def count(batches):
        df: Counter = Counter()
        for batch in batches:
            for r in batch.to_pylist():
                df.update(_words(r))
                if len(df) > PART_ROWS // 4:  # bounds memory; sums come after
                    yield told(df)
                    df = Counter()
        yield told(df)

    def told(df: Counter) -> pa.RecordBatch:
        dealt: dict[int, dict[str, int]] = {}
        for word, n in df.items():
            dealt.setdefault(crc32(word.encode()) % parts, {})[word] = n
        return _rows_of([_packed_counts(part, some) for part, some in dealt.items()], ["part", "n", "size", "words", "v"])

    def add(table: pa.Table) -> pa.Table:
        df = _sum_of(table.select(["n", "size", "words", "v"]).to_pylist())
        return pa.table({"term": pa.array(list(df), pa.string()), "df": pa.array(list(df.values()), pa.int64())})

    rows = packed.where("trained").select("n", "size", "words").mapInArrow(count, f"part long, {WORDED}")
    return rows.groupBy("part").applyInArrow(add, "term string, df long")


def _rows_of(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"trained": pa.bool_(), "n": pa.int32(), "size": pa.int32(), "words": pa.binary(), "v": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds.get(c, pa.int64())) for i, c in enumerate(names)], names)


def _packed(key, words: list[str], numbers: np.ndarray) -> tuple:
    """(key, n, size, words, v); words have only letters and digits."""
    raw = "\n".join(words).encode()
    return key, len(words), len(raw), pa.compress(raw, codec="zstd", asbytes=True), squeezed(numbers)


def _packed_counts(key, counts: dict[str, int]) -> tuple:
    words = sorted(counts)  # for compression
    return _packed(key, words, np.fromiter(map(counts.__getitem__, words), np.int64, len(words)))


def _sum_of(rows: list[dict]) -> Counter:
    total: Counter = Counter()
    for r in rows:
        total.update(dict(zip(_words(r), loosened(r["v"], r["n"]).tolist(), strict=True)))
    return total


def _count_words(batches):
    words = re.compile("[a-z0-9]+")
    for batch in batches:
        found = ((key, Counter(words.findall(text.as_py() or ""))) for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        yield _rows_of([_packed_counts(key, c) for key, c in found if c], ["item", "n", "size", "words", "v"])


def _add_words(batches):
    for batch in batches:
        rows = []
        for key, trained, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            one = parts[0]
            if len(parts) > 1:
                one = dict(zip(("n", "size", "words", "v"), _packed_counts(key, _sum_of(parts))[1:], strict=True))
            rows.append((key, trained, one["n"], one["size"], one["words"], one["v"]))
        yield _rows_of(rows, ["item", "trained", "n", "size", "words", "v"])


def packs(counts: DataFrame, terms: DataFrame) -> DataFrame:
    """(item, n, v): how many known terms an item has, and their numbers and counts packed. counts may be worded.

    An item's words move once, compressed, to a part of about PART_ROWS counts, and all words with their numbers once to
    each part: a join by term would move every count by its term and back to its item.
    """
    if "words" in counts.columns:
        parts = max(1, -(-(counts.agg(F.sum("n")).head()[0] or 0) // PART_ROWS))
        told = counts.withColumnRenamed("item", "key")
    else:
        parts = max(1, -(-counts.count() // PART_ROWS))
        lists = counts.groupBy("item").agg(F.collect_list(F.struct("term", F.col("tf").cast("long").alias("tf"))).alias("l"))
        told = lists.mapInArrow(_pack_words("item", "tf"), f"key long, {WORDED}")
    told = told.select(F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part"), "key", "n", "size", "words", "v")
    named = terms.groupBy(F.pmod("tid", F.lit(PARTS)).cast("long").alias("piece")).agg(F.collect_list(F.struct("term", F.col("tid").cast("long").alias("tid"))).alias("l"))
    vocabulary = named.mapInArrow(_pack_words("piece", "tid"), f"key long, {WORDED}")
    vocabulary = vocabulary.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("b"), "n", "size", "words", "v")

    def number(left: pa.Table, right: pa.Table) -> pa.Table:
        known: dict[str, int] = {}
        for r in right.select(["n", "size", "words", "v"]).to_pylist():
            known.update(zip(_words(r), loosened(r["v"], r["n"]).tolist(), strict=True))
        items, sizes, out = [], [], []
        for batch in left.to_batches(256):
            for r in batch.to_pylist():
                tids = np.array([known.get(w, -1) for w in _words(r)], np.int64)
                at = np.flatnonzero(tids >= 0)
                if len(at):
                    at = at[np.argsort(tids[at])]
                    items.append(r["key"]), sizes.append(len(at))
                    out.append(squeezed(np.concatenate([np.diff(tids[at], prepend=0), loosened(r["v"], r["n"])[at]])))
        return pa.Table.from_arrays([pa.array(items, pa.int64()), pa.array(sizes, pa.int32()), pa.array(out, pa.binary())], ["item", "n", "v"])

    return told.groupBy("part").cogroup(vocabulary.groupBy("b")).applyInArrow(number, "item long, n int, v binary")


def _pack_words(key: str, number: str) -> Callable:
    """From (key, l of (term, number)) to (key, n, size, words, v)."""

    def pack(batches):
        for batch in batches:
            lists = batch.column(1)
            ends, flat = lists.offsets.to_numpy(), lists.values
            words, numbers = flat.field("term"), flat.field(number).to_numpy()
            spans = zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)
            yield _rows_of([_packed(at, words.slice(lo, hi - lo).to_pylist(), numbers[lo:hi]) for at, lo, hi in spans], ["key", "n", "size", "words", "v"])

    return pack


def _words(row: dict) -> list[str]:
    return pa.decompress(row["words"], row["size"], codec="zstd", asbytes=True).decode().split("\n") if row["n"] else []


class Vectors:
    """Unit vectors of items: terms and weights of item i are at ends[i] to ends[i + 1]."""

    def __init__(self, items: np.ndarray, sizes: np.ndarray, raws: list[bytes], idf: np.ndarray):
        order = np.argsort(items)
        self.items, sizes = items[order], sizes[order].astype(np.int64)
        self.ends = np.concatenate([[0], np.cumsum(sizes)])
        self.terms, self.weights = np.zeros(self.ends[-1], np.int32), np.zeros(self.ends[-1])
        for i, lo, hi in zip(order.tolist(), self.ends[:-1].tolist(), self.ends[1:].tolist(), strict=True):
            x = loosened(raws[i], 2 * (hi - lo))
            t = np.cumsum(x[: hi - lo])
            w = (np.log(x[hi - lo :]) + 1) * idf[t]
            self.terms[lo:hi], self.weights[lo:hi] = t, w / np.sqrt((w * w).sum())

    def places(self, items: np.ndarray) -> np.ndarray:
        """Where items are, and -1 for those that have no known terms."""
        if not len(self.items):
            return np.full(len(items), -1)
        at = np.minimum(np.searchsorted(self.items, items), len(self.items) - 1)
        return np.where(self.items[at] == items, at, -1)

    def sums(self, user: np.ndarray, place: np.ndarray, n: np.ndarray, users: int, width: int) -> np.ndarray:
        """Sums of n times the vectors at `place` by users numbered from 0, a column each."""
        lo, size = self.ends[place], self.ends[place + 1] - self.ends[place]
        at = np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)
        return np.bincount(self.terms[at] * np.int64(users) + np.repeat(user, size), np.repeat(n, size) * self.weights[at], width * users).reshape(width, users)


def matrix(vectors: list[list[float | None]], width: int = 0) -> np.ndarray:
    """Rows of one width, zeros where a vector is shorter or has nulls."""
    width = max([width, *map(len, vectors)])
    return np.array([[0.0 if e is None else e for e in v] + [0.0] * (width - len(v)) for v in vectors]).reshape(len(vectors), width)


def dense_rows(lists: pa.Array) -> np.ndarray:
    """matrix() of an Arrow array of vectors, without a Python number for each component where all have one width."""
    flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy()) if len(lists) else NONE
    if len(sizes) and not flat.null_count and not lists.null_count and (sizes == sizes[0]).all():
        return flat.to_numpy(zero_copy_only=False).reshape(len(sizes), -1)
    return matrix(lists.to_pylist())


def _blocks_of(rows: DataFrame, items: DataFrame, numbers) -> int:
    """block_count of a counted history and of items with so many numbers each; few rows need no count of the items."""
    total = rows.count()
    if total <= BLOCK_ROWS:
        return 1
    size, all_ = items.agg(F.count("*"), F.coalesce(F.sum(F.greatest(numbers, F.lit(0))), F.lit(0))).head()
    return block_count(total, size, all_, rows.sparkSession.sparkContext.defaultParallelism)


def by_blocks(history: DataFrame, counts: DataFrame, idf: DataFrame, asked: DataFrame, schema: str, answer: Callable, pool: DataFrame | None = None, per_user: int = 0, out: int = 0) -> DataFrame:
    """What `answer` makes of each of a block's groups of users, as rows of schema.

    history has (uid, item), repeats counting as often as they occur, or (uid, item, n) without repeats; counts and idf
    may be what packs and numbered make of them, so that several passes share these; asked has (uid, item, *more) with long columns or
    arrays, a null item asking for a user as such; pool has items that every block gets, and may have vectors of them
    as `x`. per_user is how many numbers answer holds for each user, out how many rows all answers have. answer(uids,
    columns of asked with uids as places in uids, sums of the users' vectors, their lengths, Vectors, pool's items and
    the (items, matrix) of x) returns arrays.
    """
    rows = counted(history)
    terms = idf if "tid" in idf.columns else numbered(idf).persist()
    counts = counts if "v" in counts.columns else packs(counts, terms)
    blocks = max(_blocks_of(rows, counts, F.col("n")), -(-out // BLOCK_OUT))
    block = F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int").alias("block")
    more = [c for c in asked.columns if c not in ("uid", "item")]
    wanted = asked.select(block, "uid", "item", F.lit(0).cast("long").alias("n"), *more)
    past = rows.select(block, "uid", "item", "n", *[F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in more])
    told = past.unionByName(wanted)
    needed = told.where(F.col("item").isNotNull()).select("block", "item").distinct()
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    if pool is not None:
        needed = needed.unionByName(pool.select("item").distinct().select(every, "item")).distinct()
        x = F.col("x").cast("array<double>") if "x" in pool.columns else F.lit(None).cast("array<double>")
    moved = needed.join(counts, "item").select("block", "item", "n", "v", F.lit(None).cast("binary").alias("idf"))
    listed = terms.groupBy(F.pmod("tid", F.lit(PARTS)).alias("part")).agg(F.collect_list(F.struct("tid", "idf")).alias("l"))
    packed = listed.mapInArrow(_pack_idf, "n int, v binary, idf binary").select(every, F.lit(None).cast("long").alias("item"), "n", "v", "idf")
    asked_pool = None if pool is None else pool.select(every, F.lit(None).cast("long").alias("item"), F.lit(-1).alias("n"), F.lit(None).cast("binary").alias("v"), F.lit(None).cast("binary").alias("idf"), F.col("item").alias("candidate"), x.alias("x"))
    right = moved.unionByName(packed).withColumn("candidate", F.lit(None).cast("long")).withColumn("x", F.lit(None).cast("array<double>"))
    right = right if asked_pool is None else right.unionByName(asked_pool)
    right = right.toDF("b", "item", "size", "v", "idf", "candidate", "x")
    kinds = to_arrow_schema(history.sparkSession.createDataFrame([], schema).schema)

    def asked_of(values: pa.ChunkedArray, asks: np.ndarray):
        return values.filter(pa.array(asks)).to_pylist() if pa.types.is_list(values.type) else values.fill_null(-1).to_numpy()[asks]

    def score(left: pa.Table, other: pa.Table) -> pa.Table:
        column = lambda t, c, none=-1: t.column(c).fill_null(none).to_numpy()
        pieces = other.filter(other.column("idf").is_valid())
        tids = [loosened(v, n) for v, n in zip(pieces.column("v").to_pylist(), pieces.column("size").to_pylist(), strict=True)]
        width = max([0, *(int(t.max()) for t in tids)]) + 1
        known = np.zeros(width)
        for t, raw in zip(tids, pieces.column("idf").to_pylist(), strict=True):
            known[t] = np.frombuffer(raw, "<f8")
        offered = other.filter(other.column("candidate").is_valid())
        seen = offered.filter(offered.column("x").is_valid()).sort_by("candidate")
        candidates = np.unique(column(offered, "candidate")), (column(seen, "candidate"), matrix(seen.column("x").to_pylist()))
        own = other.filter(other.column("item").is_valid())
        vectors = Vectors(column(own, "item"), column(own, "size"), own.column("v").to_pylist(), known)
        left = left.take(pa.array(np.argsort(column(left, "uid"), kind="stable")))
        uid, item, n, present = column(left, "uid"), column(left, "item"), column(left, "n"), left.column("item").is_valid().to_numpy()
        place = np.where(present, vectors.places(item), -1)
        uids, firsts = np.unique(uid, return_index=True)
        firsts, step, found = np.append(firsts, len(uid)), max(1, CELLS // (width + per_user)), []
        for at in range(0, len(uids), step):
            some = uids[at : at + step]
            lo, hi = firsts[at], firsts[min(at + step, len(uids))]
            who = np.searchsorted(some, uid[lo:hi])
            is_past = (n[lo:hi] > 0) & (place[lo:hi] >= 0)
            sums = vectors.sums(who[is_past], place[lo:hi][is_past], n[lo:hi][is_past], len(some), width)
            asks = n[lo:hi] == 0
            columns = {"user": who[asks], "item": item[lo:hi][asks], "present": present[lo:hi][asks], "place": place[lo:hi][asks]} | {c: asked_of(left.slice(lo, hi - lo).column(c), asks) for c in more}
            found.append(answer(some, columns, sums, np.sqrt(np.einsum("tu,tu->u", sums, sums)), vectors, candidates))
        found = zip(*found, strict=True) if found else [[] for _ in kinds]
        return pa.Table.from_arrays([pa.array(np.concatenate(c) if len(c) else NONE, f.type) for c, f in zip(found, kinds, strict=True)], schema=kinds)

    return told.groupBy("block").cogroup(right.groupBy("b")).applyInArrow(score, schema)


def _pack_idf(batches):
    for batch in batches:
        rows = batch.column(1).to_pylist()
        yield pa.RecordBatch.from_pydict({
            "n": pa.array([len(r) for r in rows], pa.int32()),
            "v": [squeezed(np.array([x["tid"] for x in r])) for r in rows],
            "idf": [np.array([x["idf"] for x in r], "<f8").tobytes() for r in rows],
        })


def pair_scores(history: DataFrame, counts: DataFrame, idf: DataFrame, asked: DataFrame) -> DataFrame:
    """(uid, item, text): cosines of the sums of histories with the asked items; 0 where either has no known terms."""

    def answer(uids, asks, sums, lengths, vectors, _):
        score = np.zeros(len(asks["user"]))
        for i, (u, p) in enumerate(zip(asks["user"].tolist(), asks["place"].tolist(), strict=True)):
            if p >= 0 and lengths[u] > 0:
                own = slice(vectors.ends[p], vectors.ends[p + 1])
                score[i] = (sums[vectors.terms[own], u] * vectors.weights[own]).sum() / lengths[u]
        return uids[asks["user"]], asks["item"], score

    return by_blocks(history, counts, idf, asked.select("uid", "item"), "uid long, item long, text double", answer)


def cosines(sums: np.ndarray, lengths: np.ndarray, vectors: Vectors, pool: np.ndarray) -> np.ndarray:
    """A row a user: cosines of the sums with the pool's items."""
    score = np.zeros((len(pool), len(lengths)))
    for i, p in enumerate(vectors.places(pool).tolist()):
        if p >= 0:
            own = slice(vectors.ends[p], vectors.ends[p + 1])
            score[i] = vectors.weights[own] @ sums.take(vectors.terms[own], 0)
    return (score / np.where(lengths > 0, lengths, 1)).T


def pool_scores(history: DataFrame, counts: DataFrame, idf: DataFrame, users: DataFrame, candidates: DataFrame) -> DataFrame:
    """(uid, item, score): cosines of the sums of histories with all candidates; 0 where either has no known terms. The
    full pool is the query itself."""
    n = candidates.count()

    def answer(uids, asks, sums, lengths, vectors, pool):
        some, (pool, _) = np.unique(asks["user"]), pool
        score = cosines(sums, lengths, vectors, pool)[some]
        return np.repeat(uids[some], len(pool)), np.tile(pool, len(some)), score.ravel()

    asked = users.select("uid", F.lit(None).cast("long").alias("item"))
    found = by_blocks(history, counts, idf, asked, "uid long, item long, score double", answer, candidates, n, n * users.count())
    return found.withColumn("score", F.round("score", 9))


def contributions(history: DataFrame, counts: DataFrame, idf: DataFrame, asked: DataFrame, limit: int = 3) -> DataFrame:
    """(uid, item, place, term, contribution), as explain.contributions gives them: only the greatest contributions of a
    pair and those equal to the last of them leave a block, and get their words and places then."""

    def answer(uids, asks, sums, lengths, vectors, _):
        pairs = zip(asks["user"].tolist(), asks["item"].tolist(), asks["place"].tolist(), strict=True)
        return greatest(((u, i, p) for u, i, p in pairs if p >= 0), uids, sums, lengths, vectors, limit)

    return named_parts(by_blocks(history, counts, idf, asked.select("uid", "item"), PARTS_SCHEMA, answer), idf, limit)


def top_contributions(history: DataFrame, counts: DataFrame, idf: DataFrame, users: DataFrame, candidates: DataFrame, top: int = 3, limit: int = 3) -> DataFrame:
    """contributions of the first `top` candidates by text of each user, but for scores of 0: ranks and contributions are
    formed in one pass, so that items move to blocks once."""
    n = candidates.count()

    def answer(uids, asks, sums, lengths, vectors, pool):
        some, pool = np.unique(asks["user"]), pool[0]
        text, places = np.round(cosines(sums, lengths, vectors, pool), 9), vectors.places(pool)
        best = ((u, placed(text[u], pool, int(uids[u]), NONE, top)[0]) for u in some.tolist())
        return greatest(((u, pool[p], places[p]) for u, at in best for p in at.tolist() if text[u, p] > 0), uids, sums, lengths, vectors, limit)

    asked = users.select("uid", F.lit(None).cast("long").alias("item"))
    return named_parts(by_blocks(history, counts, idf, asked, PARTS_SCHEMA, answer, candidates, n), idf, limit)


PARTS_SCHEMA = "uid long, item long, tid int, contribution double"


def greatest(pairs, uids: np.ndarray, sums: np.ndarray, lengths: np.ndarray, vectors: Vectors, limit: int) -> list[np.ndarray]:
    """Of (user, item, its place in vectors): the greatest contributions and those equal to the last of them."""
    found = []
    for u, i, p in pairs:
        if not lengths[u] > 0:
            continue
        own = slice(vectors.ends[p], vectors.ends[p + 1])
        profile = sums[vectors.terms[own], u]
        part = np.round(profile / lengths[u] * vectors.weights[own], 9)
        part = np.where(profile > 0, part, -1)
        keep = np.flatnonzero((part >= np.partition(part, -limit)[-limit] if len(part) > limit else True) & (part >= 0))
        found.append((np.full(len(keep), uids[u]), np.full(len(keep), i), vectors.terms[own][keep], part[keep]))
    return [np.concatenate(c) for c in zip(*found, strict=True)] if found else [NONE, NONE, NONE, np.zeros(0)]


def named_parts(parts: DataFrame, idf: DataFrame, limit: int) -> DataFrame:
    rows = parts.join((idf if "tid" in idf.columns else numbered(idf)).select("tid", "term"), "tid")
    place = F.row_number().over(Window.partitionBy("uid", "item").orderBy(F.desc("contribution"), "term")).cast("long")
    return rows.withColumn("place", place).where(F.col("place") <= limit).select("uid", "item", "place", "term", F.round("contribution", 6).alias("contribution"))


def ordered(key: np.ndarray, items: np.ndarray, uid: int, at: np.ndarray, seed: int = PROTOCOL.seed) -> np.ndarray:
    """Places `at` by falling key, ties in the order of rank.ranked. Hashes are made for ties only."""
    at = at[np.argsort(-key[at], kind="stable")]
    starts = np.flatnonzero(np.append(True, key[at][1:] != key[at][:-1])) if len(at) else NONE
    ends = np.append(starts[1:], len(at))
    several = ends - starts > 1
    for lo, hi in zip(starts[several].tolist(), ends[several].tolist(), strict=True):
        names = items[at[lo:hi]].tolist()
        keyed = sorted((md5(f"{seed}:{uid}:{i}".encode()).digest(), i, p) for i, p in zip(names, at[lo:hi].tolist(), strict=True))
        at[lo:hi] = [p for _, _, p in keyed]
    return at


def placed(key: np.ndarray, items: np.ndarray, uid: int, mine: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and 1-based ranks of the first `top` by falling key, and of the items `mine`; items ascend."""
    n = len(key)
    head = NONE if not top else np.arange(n) if top >= n else np.flatnonzero(key >= np.partition(key, n - top)[n - top])
    best = ordered(key, items, uid, head)[:top]
    at, ranks, shown = best.tolist(), list(range(1, len(best) + 1)), set(best.tolist())
    spans = zip(np.searchsorted(items, mine).tolist(), np.searchsorted(items, mine, "right").tolist(), strict=True)
    rest = np.array([p for lo, hi in spans for p in range(lo, hi) if p not in shown], np.int64)
    above, same = (key > key[rest, None]).sum(1).tolist(), (key == key[rest, None]).sum(1).tolist()
    runs: dict[float, list[int]] = {}
    for p, more, n in zip(rest.tolist(), above, same, strict=True):
        k = float(key[p])
        if n > 1 and k not in runs:
            runs[k] = ordered(key, items, uid, np.flatnonzero(key == k)).tolist()
        at.append(p), ranks.append(more + 1 + (runs[k].index(p) if n > 1 else 0))
    return np.array(at, np.int64), np.array(ranks, np.int64)


#: What pool_ranks can order by: `fused` is a row a weight, `learned` needs statistics.
KINDS = ("text", "visual", "fused", "learned")


def pool_ranks(history: DataFrame, counts: DataFrame, idf: DataFrame, positives: DataFrame, candidates: DataFrame, kinds: tuple[str, ...], top: int, features: DataFrame | None = None, stats: dict[str, float | None] | None = None) -> DataFrame:
    """(kind, weight, uid, item, score, rank): each user's orders of all candidates, as rank.ranked and
    fusion.rank_fusion give them; of these the first `top` ranks, and all ranks of positives.

    All kinds are formed in one pass over the blocks. Kinds but text need features (item, embedding), and order only
    candidates that have vectors, for users whose history has some. stats has mean_* and std_* of fusion.learned_scores.
    """
    kinds = tuple(kinds)
    seen = kinds != ("text",)
    n = candidates.count()
    none = F.lit(None).cast("array<double>").alias("profile")
    users = positives.select("uid").distinct()
    asked = users.join(dense_profiles(history, features), "uid", "left").select("uid", F.lit(None).cast("long").alias("item"), "profile") if seen else users.select("uid", F.lit(None).cast("long").alias("item"), none)
    pool = candidates.join(features.select("item", F.col("embedding").alias("x")), "item", "left") if seen else candidates
    schema = "kind int, weight double, uid long, item long, score double, rank long"

    def answer(uids, asks, sums, lengths, vectors, pool):
        pool, (seen, x) = pool
        text = np.round(cosines(sums, lengths, vectors, pool), 9) + 0.0
        shown = [p or [] for p in asks["profile"]]
        profiles = matrix(shown, x.shape[1])
        looks = profiles @ np.pad(x, ((0, 0), (0, profiles.shape[1] - x.shape[1]))).T
        mine: dict[int, list[int]] = {}
        for u, i in zip(asks["user"][asks["present"]].tolist(), asks["item"][asks["present"]].tolist(), strict=True):
            mine.setdefault(u, []).append(i)
        found = []
        for row, (u, there) in enumerate(zip(asks["user"].tolist(), asks["present"].tolist(), strict=True)):
            if there:
                continue
            uid, own = int(uids[u]), np.array(mine.get(u, []), np.int64)

            def add(kind, items, score, weight=np.nan, key=None, top=top, uid=uid, own=own):
                at, rank = placed(score if key is None else key, items, uid, own, top)
                some = len(at)
                found.append((np.full(some, KINDS.index(kind)), np.full(some, weight), np.full(some, uid), items[at], score[at], rank))

            if "text" in kinds:
                add("text", pool, text[u])
            if not shown[row]:
                continue
            visual = np.round(looks[row], 9) + 0.0
            key = np.where(np.isnan(visual), np.inf, visual)
            if "visual" in kinds:
                add("visual", seen, visual, key=key)
            both = text[u][np.searchsorted(pool, seen)]
            if "fused" in kinds:
                rt, rv = np.zeros(len(pool)), np.zeros(len(seen))
                rt[ordered(text[u], pool, uid, np.arange(len(pool)))] = np.arange(len(pool))
                rv[ordered(key, seen, uid, np.arange(len(seen)))] = np.arange(len(seen))
                rt = rt[np.searchsorted(pool, seen)]
                for w in PROTOCOL.fusion_weights:
                    add("fused", seen, -np.round(w * rt + (1 - w) * rv, 9), w)
            if "learned" in kinds:
                terms = {"text": both, "visual": visual, "product": both * visual}
                known = all(v is not None for v in stats.values())
                score = sum((w * (terms[c] - stats[f"mean_{c}"]) / stats[f"std_{c}"] for c, w in zip(terms, PROTOCOL.learned, strict=True)), np.zeros(len(seen))) if known else np.full(len(seen), np.nan)
                score = np.round(score, 9) + 0.0
                add("learned", seen, score, key=np.where(np.isnan(score), np.inf, score))
        return [np.concatenate(c) for c in zip(*found, strict=True)] if found else [NONE, np.zeros(0), NONE, NONE, np.zeros(0), NONE]

    return by_blocks(history, counts, idf, asked.unionByName(positives.select("uid", "item", none)), schema, answer, pool, n)


def dense_profiles(history: DataFrame, features: DataFrame) -> DataFrame:
    """(uid, profile): unit sum of the vectors of a history; a zero sum stays zero. A block's vectors move to it once."""
    rows = counted(history)
    blocks = _blocks_of(rows, features, F.size("embedding"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int"))
    moved = rows.select("block", "item").distinct().join(features.select("item", F.col("embedding").alias("x")), "item").select("block", "item", "x").toDF("b", "item", "x")
    schema = pa.schema([("uid", pa.int64()), ("profile", pa.list_(pa.float64()))])

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.filter(right.column("x").is_valid())
        x = dense_rows(right.column("x").combine_chunks())
        width = x.shape[1]
        items = right.column("item").to_numpy()
        by = np.argsort(items, kind="stable")
        item, n = left.column("item").to_numpy(), left.column("n").to_numpy()
        lo, hi = np.searchsorted(items[by], item), np.searchsorted(items[by], item, "right")  # a repeated item counts as often as it has vectors
        again = hi - lo
        at = by[np.arange(again.sum()) + np.repeat(lo - (np.cumsum(again) - again), again)]
        uid, weight = np.repeat(left.column("uid").to_numpy(), again), np.repeat(n, again)
        order = np.argsort(uid, kind="stable")
        uids, firsts = np.unique(uid[order], return_index=True)
        sums = np.zeros((len(uids), width))
        for i in range(width):  # a column at a time, so that the histories' vectors are never held at once
            sums[:, i] = np.add.reduceat((weight * x[at, i].astype(float))[order], firsts) if len(uids) else 0
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        return pa.Table.from_pydict({"uid": uids, "profile": list(sums / np.where(size > 0, size, 1))}, schema=schema)

    return rows.groupBy("block").cogroup(moved.groupBy("b")).applyInArrow(add, "uid long, profile array<double>")
