"""Operator 3: near-duplicates by circulant MinHash, banding and exact Jaccard verification.

A document's set is its distinct word shingles (64-bit hashes of lower-cased words; two different shingles of a pair
agree by chance with odds of about 2**-64 each). Circulant MinHash: one permutation places the shingles on a circle of
SPAN places, a second one values the places, and coordinate k of the signature is the least value when that second
permutation is shifted by k places. Bands of the signature propose candidates; the full sets decide.

No group is expanded into all its pairs: equal sets collapse into one class first; in a band's bucket every class is
compared with the bucket's smallest one, its head. Where members of a head's buckets are then in different components,
blocks of them are compared by matrix products, which yield connections, never lists of pairs; pairs of blocks that lie
in one component are skipped, since they can't change the answer. Classes, buckets and heads of many rows are joined by
salts.

Rows are told apart by their place, so documents must be read alike each time, as files and checkpoints are. Defined
results: null or empty texts and texts without words have no shingles and link with nothing; fewer words than a shingle
form one shingle; repeated rows of one id are documents of their own; a component is named by the least of its ids that
isn't null, and `kept` says whether the row's id is that name (nulls are equal here); other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, cut, hot_keys, map_slices, shuffle_partitions, spread_join, texts_of
from .components import components
from .hashing import scramble, span_hashes

SPAN = 1 << 20
ROWS, BANDS = 5, 25
WIDTH = ROWS * BANDS
#: Members and bytes of a block, columns of a product, tasks that a group is spread over.
BLOCK, BLOCK_BYTES, COLUMNS, SALTS = 256, 4 << 20, 4096, 8

# Bytes that part words, and the lower-casing of A-Z.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@functools.lru_cache(1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240)
    place, value = rng.permutation(SPAN).astype(np.uint32), rng.permutation(SPAN).astype(np.uint32)
    return place, np.lib.stride_tricks.sliding_window_view(np.concatenate([value, value[: WIDTH - 1]]), WIDTH)


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    tape = LOWER[np.frombuffer(b"\n".join([*raw, b""]), np.uint8)]
    solid = ~BLANK[tape]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8)))
    starts, lens = edge[::2], edge[1::2] - edge[::2]
    h = span_hashes(tape, starts, lens)
    bounds = np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raw]))
    out, lo = [], 0
    with np.errstate(over="ignore"):
        salts = [np.uint64(2 * i + 1) * np.uint64(0xA24BAED4963EE407) for i in range(words)]
        for hi in bounds.tolist():
            n = hi - lo
            if n >= words:
                out.append(np.unique(scramble(sum(h[lo + i : hi - words + 1 + i] * salts[i] for i in range(words)))))
            else:
                own = scramble(np.array([sum((h[lo + i] * salts[i] for i in range(n)), np.uint64(n))], np.uint64))
                out.append(own if n else h[:0])
            lo = hi
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """WIDTH coordinates by circulant MinHash."""
    place, value = _permutations()
    at = place[(shingles & np.uint64(SPAN - 1)).astype(np.int64)]
    best = np.full(WIDTH, SPAN, np.uint32)
    for lo in range(0, len(at), 4096):
        np.minimum(best, value[at[lo : lo + 4096]].min(0), out=best)
    return best


def band_keys(sig: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = np.arange(1, BANDS + 1, dtype=np.uint64)
        for column in sig.reshape(BANDS, ROWS).T:
            key = scramble(key * np.uint64(0xD6E8FEB86659FD93) + column.astype(np.uint64))
        return key.view(np.int64)


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(row, n_shingles, h1, h2, bands) of (row, text): the set's size, its 128-bit digest and its bands."""

    def run(rows, texts):
        sets = shingle_sets(texts, words)
        digest = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets]
        return {"row": rows, "n_shingles": list(map(len, sets)), "h1": [int(d[0]) for d in digest], "h2": [int(d[1]) for d in digest], "bands": [band_keys(signature(s)) if len(s) else [] for s in sets]}

    return map_slices(docs, run, "row long, n_shingles long, h1 long, h2 long, bands array<long>")


def sets_of(docs: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """(node, set): the sorted shingle hashes of the rows named."""

    def sets(keys, texts):
        return {"node": keys, "set": [s.tobytes() for s in shingle_sets(texts, words)]}

    return map_slices(docs.join(rows, "row", "left_semi"), sets, "node long, set binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int, hot: list[tuple] = ()) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union. `hot` has the a of many pairs."""
    joined = spread_join(pairs, sets.toDF("a", "left"), ["a"], hot, "b").join(sets.toDF("b", "right"), "b")

    def judge(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = 0
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    at = np.searchsorted(y, x)
                    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.select("a", "b", "left", "right").mapInArrow(judge, "a long, b long")


def common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of x with every set of y, by products of indicator matrices."""
    shared = np.intersect1d(np.concatenate(x), np.concatenate(y))
    out = np.zeros((len(x), len(y)), np.float32)

    def places(sets):
        row = np.repeat(np.arange(len(sets)), list(map(len, sets)))
        flat = np.concatenate(sets)
        at = np.minimum(np.searchsorted(shared, flat), max(0, len(shared) - 1))
        hit = shared[at] == flat if len(shared) else np.zeros(len(flat), bool)
        return row[hit], at[hit]

    (rx, cx), (ry, cy) = places(x), places(y)
    for lo in range(0, len(shared), COLUMNS):
        left, right = np.zeros((len(x), COLUMNS), np.float32), np.zeros((len(y), COLUMNS), np.float32)
        own = (cx >= lo) & (cx < lo + COLUMNS)
        left[rx[own], cx[own] - lo] = 1
        own = (cy >= lo) & (cy < lo + COLUMNS)
        right[ry[own], cy[own] - lo] = 1
        out += left @ right.T
    return out.astype(np.int64)


BLOCKS = "head long, block string, component_low long, component_high long, ids binary, components binary, sizes binary, sets binary"


def across(members: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect what the links between different components of a group connect.

    members has (head, b, component, set). A group's members come in blocks; pairs of blocks are compared in full, and
    only connections come out: for each linked member the smallest one that it is connected to within the two blocks.
    """
    parts = shuffle_partitions(members.sparkSession)
    schema = arrow_schema(members.sparkSession.createDataFrame([], BLOCKS).schema)

    def gather(batches):
        key, held, size = None, [], 0

        def block():
            ids, comps, sets = zip(*held, strict=True)
            row = (key[0], f"{key[1]}:{min(ids)}", min(comps), max(comps), np.array(ids, "<i8").tobytes(), np.array(comps, "<i8").tobytes(), np.array([len(s) // 8 for s in sets], "<i8").tobytes(), b"".join(sets))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for head, salt, b, comp, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and ((head, salt) != key or len(held) >= BLOCK or size >= BLOCK_BYTES):
                    yield block()
                    held, size = [], 0
                key = (head, salt)
                held.append((b, comp, data))
                size += len(data)
        if held:
            yield block()

    salted = members.select("head", F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("salt"), "b", "component", "set")
    blocks = cut(salted.repartition(parts, "head", "salt").sortWithinPartitions("head", "salt", "component", "b").mapInArrow(gather, BLOCKS))
    # a block meets those of its group in SALTS tasks: one side keeps its salt, the other goes to all
    spread = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = blocks.select(*[F.col(c).alias(c if c == "head" else f"{c}_l") for c in blocks.columns]).withColumn("salt", F.pmod(F.xxhash64("block_l"), F.lit(SALTS)).cast("int"))
    apart = (F.col("component_low") != F.col("component_high")) | (F.col("component_low_l") != F.col("component_high_l")) | (F.col("component_low") != F.col("component_low_l"))
    pairs = left.join(spread, ["head", "salt"]).drop("salt").where((F.col("block_l") <= F.col("block")) & apart)

    def compare(batches):
        target = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            for x in zip(*(batch.column(c).to_pylist() for n in ("_l", "") for c in (f"ids{n}", f"components{n}", f"sizes{n}", f"sets{n}")), strict=True):
                (ia, ca, na, sa), (ib, cb, nb, sb) = ([np.frombuffer(v, np.int64 if k < 3 else np.uint64) for k, v in enumerate(part)] for part in (x[:4], x[4:]))
                both = common(np.split(sa, np.cumsum(na)[:-1]), np.split(sb, np.cumsum(nb)[:-1]))
                hit = (100 * both >= percent * (na[:, None] + nb[None] - both)) & (ca[:, None] != cb[None])
                if not hit.any():
                    continue
                far, own, other = np.iinfo(np.int64).max, ia.copy(), ib.copy()
                while True:  # labels run along the links until they rest
                    new = np.minimum(own, np.where(hit, other[None], far).min(1))
                    onward = np.minimum(other, np.where(hit, new[:, None], far).min(0))
                    if (new == own).all() and (onward == other).all():
                        break
                    own, other = new, onward
                some, too = hit.any(1), hit.any(0)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ia[some], ib[too]])), pa.array(np.concatenate([own[some], other[too]]))], schema=target)

    return pairs.drop("head", "block", "block_l").mapInArrow(compare, "a long, b long")


def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): the smallest id reachable over links of Jaccard >= percent / 100."""
    docs = texts_of(documents, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    prints = cut(fingerprints(docs.select("row", "text"), words))
    some = prints.where("n_shingles > 0")
    total = some.count()
    # a class of equal sets is named by its least row
    classes = cut(some.groupBy("h1", "h2").agg(F.min("row").alias("node"), F.count("*").alias("n"), F.any_value("bands").alias("bands")), total)
    entries = classes.select(F.col("node").alias("b"), F.explode("bands").alias("band"))
    shared = cut(entries.groupBy("band").agg(F.count("*").alias("n"), F.min("b").alias("head")).where("n > 1"), total)
    groups = cut(spread_join(entries, shared.drop("n"), ["band"], hot_keys(shared.select("band", "n"), "n", BANDS * total), "b").select("head", "b").distinct(), total)
    stars = groups.where("head != b").select(F.col("head").alias("a"), "b")
    hot = hot_keys(stars.groupBy("a").agg(F.count("*").alias("n")), "n", stars.count())
    sets = cut(sets_of(docs.select("row", "text"), groups.select(F.col("b").alias("row")).distinct(), words))
    links = cut(verified(stars, sets, percent, hot), total)
    found = components(links, rows=total)
    # two classes that share a bucket share its head; groups of a head whose members are still apart are compared inside
    placed = cut(groups.join(found.withColumnRenamed("id", "b"), "b", "left").select("head", "b", F.coalesce("component", "b").alias("component")), total)
    apart = placed.groupBy("head").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("n")).where("least < most and n > 2").select("head")
    rest = spread_join(placed, apart, ["head"], hot, "b").join(sets.withColumnRenamed("node", "b"), "b").select("head", "b", "component", "set")
    more = cut(across(rest, percent), total)
    if not more.isEmpty():
        found = components(links.union(more), rows=total)
    named = classes.join(found.withColumnRenamed("id", "node"), "node", "left").select("h1", "h2", "n", F.coalesce("component", "node").alias("component"))
    hot = hot_keys(classes.select("h1", "h2", "n"), "n", total)
    parted = spread_join(some.select("row", "h1", "h2"), named.drop("n"), ["h1", "h2"], hot, "row").select("row", "component")
    ids = docs.select("row", "doc_id").join(prints.select("row", "n_shingles"), "row").join(parted, "row", "left")
    ids = cut(ids.withColumn("component", F.coalesce("component", "row")), total)
    # rows without a partner name themselves
    least = ids.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    out = spread_join(ids, least.drop("n"), ["component"], hot_keys(least.select("component", "n"), "n", total), "row")
    return out.select("doc_id", "n_shingles", "component_id").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def report(documents: DataFrame) -> DataFrame:
    """The columns of op3: four-word shingles, Jaccard of at least 0.8."""
    return near_duplicates(documents, words=4, percent=80)
