"""Operator 2: embedding near-duplicates by an inverted multi-index.

Each half of a unit vector has a codebook of its own; a vector lies in the cell of its two nearest codes, so that small
codebooks span a large grid. A query visits cells by ascending lower bound of the distance to anything in them: for a
half x with nearest code c, nothing in the region of code e is nearer than (|x - e|^2 - |x - c|^2) / (2 |c - e|). A
multi-sequence traversal merges both halves' ascending bounds. It stops where the root of their squares' sum passes the
distance of the least cosine, beyond which no link lies, or after as many cells as the target recall takes: vectors of
the sample are turned by the angle of the least cosine in random directions, and `recall` of the pairs must meet within
that many cells. Those are the farthest links there are; nearer ones are met more often, and each link has two vectors
to be met from. With recall=1 there is no such limit, and all links are found. Candidates are verified in double
precision; README has recalls against brute force.

Equal vectors of a label collapse first, with their number. A cell's vectors come in blocks, in the precision of the
table, and pairs of blocks are compared by matrix products, so no cell meets in one task and no list of its pairs is
made: a pair of blocks yields counts, and for each linked vector the smallest vector it is connected to within the two
blocks. A link that is met from one side only counts for both: stored vectors know the cells that they visit themselves.

Codebooks are fitted on at most SAMPLE vectors (a documented bound); every vector is indexed and queried.
Defined results: a null label, and a vector that is null, zero, empty or has null or non-finite parts, links with
nothing; vectors of different lengths don't link; rows of one id count as several vectors; a null id with a fit vector
is a vector like others, and names no component unless nothing else does; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, cut, hot_keys, shuffle_partitions, spread_join
from .components import components

LEAST = 0.98
SAMPLE = 20_000
BLOCK = 512
#: Share of pairs of the least cosine that meet; of so many turned vectors.
RECALL, TURNED = 0.9995, 20_000
#: Slack on bounds and for rounding.
SLACK = 1e-7


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    codes = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = ((codes**2).sum(1) - 2 * x @ codes.T).argmin(1)
        for c in range(len(codes)):
            own = x[near == c]
            if len(own):
                codes[c] = own.mean(0)
    return np.unique(codes, axis=0)


class Codebook:
    """Codes of one half, and lower bounds of distances to their regions."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.gaps = np.sqrt(((codes[:, None] - codes[None]) ** 2).sum(2))

    def squares(self, x: np.ndarray) -> np.ndarray:
        return (x**2).sum(1)[:, None] - 2 * x @ self.codes.T + (self.codes**2).sum(1)

    def bounds(self, square: np.ndarray) -> np.ndarray:
        """Squared lower bound per row and code: 0 for the nearest code."""
        near = square.argmin(1)
        gap = self.gaps[near]
        with np.errstate(divide="ignore", invalid="ignore"):
            low = (square - square.min(1)[:, None]) / (2 * gap)
        return np.where(gap > 0, np.maximum(low, 0), 0) ** 2


class Grid:
    """The product of two codebooks, and how many cells a query visits at most."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.books = Codebook(first), Codebook(second)
        self.most = len(first) * len(second)

    def look(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cell of each unit vector, and the squared bounds of its halves."""
        half = x.shape[1] // 2
        squares = [book.squares(part) for book, part in zip(self.books, (x[:, :half], x[:, half:]), strict=True)]
        own = squares[0].argmin(1) * len(self.books[1].codes) + squares[1].argmin(1)
        return own, *(book.bounds(s) for book, s in zip(self.books, squares, strict=True))

    def visits(self, first: np.ndarray, second: np.ndarray, reach: float) -> list[int]:
        """Cells by ascending sum of two bounds, as far as reach and most: a heap of the frontier of the sorted product."""
        a, b = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
        heap, out, width = [(first[a[0]] + second[b[0]], 0, 0)], [], len(b)
        while heap and heap[0][0] <= reach and len(out) < self.most:
            _, i, j = heapq.heappop(heap)
            out.append(a[i] * width + b[j])
            if j + 1 < width:
                heapq.heappush(heap, (first[a[i]] + second[b[j + 1]], i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (first[a[i + 1]] + second[b[0]], i + 1, 0))
        return out

    def settle(self, sample: np.ndarray, least: float, recall: float, reach: float, seed: int = 9) -> None:
        """Sets most so that `recall` of the sample's vectors, turned to the cosine `least`, lie in a visited cell."""
        rng = np.random.default_rng(seed)
        x = sample[rng.integers(0, len(sample), TURNED)]
        way = rng.normal(size=x.shape)
        way -= (way * x).sum(1, keepdims=True) * x
        size = np.sqrt((way * way).sum(1, keepdims=True))
        way = np.where(size > 1e-9, way / np.maximum(size, 1e-9), 0)
        there, *_ = self.look(least * x + (1 - least**2) ** 0.5 * way)
        own, *bounds = self.look(x)
        places = np.zeros(len(x), np.int64)
        for i in np.flatnonzero(own != there).tolist():
            cells = self.visits(bounds[0][i], bounds[1][i], reach)
            places[i] = cells.index(there[i]) if there[i] in cells else len(cells)
        self.most = int(np.quantile(places, recall, method="higher")) + 1


def normalised(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision, scaled first so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


ENTRIES = "cell string, role int, ids binary, counts binary, cells binary, vectors binary"
FOUND = "id long, n long, partner long"


def link(vectors: DataFrame, least: float = LEAST, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    spark = vectors.sparkSession
    # vectors travel in the table's own precision
    small = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind, sql = (np.dtype("<f4"), "array<float>") if small else (np.dtype("<f8"), "array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    fit = F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0)
    # equal vectors of a label: one representative with their number, under a number of its own
    # (-0.0 + 0.0 is 0.0, so equal values have equal hashes)
    same = ["label", "h1", "h2"]
    hashed = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("fit", F.coalesce(fit, F.lit(False)))
    hashed = hashed.withColumn("h1", F.when(F.col("fit"), F.xxhash64("v"))).withColumn("h2", F.when(F.col("fit"), F.xxhash64(F.lit(1), "v")))
    keyed = hashed.where("fit")
    # equal hashes and equal vectors: any_value takes one of them
    reps = keyed.groupBy(*same).agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.any_value(F.col("v").cast(sql)).alias("v"))
    reps = cut(reps.withColumn("rep", F.monotonically_increasing_id()))
    groups = reps.drop("v")
    total = reps.count()
    reach = 2 - 2 * least + SLACK
    sent = spark.sparkContext.broadcast(_grids(reps, total, sample, least, recall, reach))  # codes of at most `sample` vectors' codebooks
    schema = arrow_schema(spark.createDataFrame([], ENTRIES).schema)

    def block(cell, role, parts):
        values = (cell, role, *(b"".join(p) for p in zip(*parts, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, schema, strict=True)], schema=schema)

    def places(batches):
        """Per batch and cell the vectors that lie in it (role 0, with the cells that each visits) and that visit it
        (role 1, with the cell that each lies in)."""
        for batch in batches:
            lens, flat = pc.list_value_length(batch.column("v")).to_numpy(), batch.column("v").flatten().to_numpy().astype(kind)
            starts, ids, n = np.cumsum(lens) - lens, batch.column("rep").to_numpy(), batch.column("n").to_numpy()
            labels = batch.column("label").to_pylist()
            for size in np.unique(lens).tolist():
                rows_, grid = np.flatnonzero(lens == size), sent.value[size]
                raw = flat[starts[rows_][:, None] + np.arange(size)]
                own, *bounds = grid.look(normalised(raw.astype(np.float64)))
                seen = [grid.visits(f, g, reach) for f, g in zip(*bounds, strict=True)]
                stored: dict[tuple, list[int]] = {}
                asked: dict[tuple, list[int]] = {}
                for i, (r, home) in enumerate(zip(rows_.tolist(), own.tolist(), strict=True)):
                    stored.setdefault((labels[r], home), []).append(i)
                    for cell in seen[i]:
                        asked.setdefault((labels[r], cell), []).append(i)
                table = np.full((len(rows_), grid.most), -1, "<i4")
                for i, cells in enumerate(seen):
                    table[i, : len(cells)] = cells
                for role, found, known in ((0, stored, table), (1, asked, own.astype("<i4"))):
                    for (label, cell), own_ in found.items():
                        for lo in range(0, len(own_), BLOCK):
                            i = own_[lo : lo + BLOCK]
                            yield block(f"{size}:{cell}:{label}", role, [(ids[rows_[i]].astype("<i8").tobytes(), n[rows_[i]].astype("<i8").tobytes(), known[i].tobytes(), raw[i].tobytes())])

    def gather(batches):
        """Blocks of one cell and role, which follow each other, joined to about BLOCK vectors."""
        key, held, size = None, [], 0
        for batch in batches:
            for cell, role, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and ((cell, role) != key or size + len(parts[0]) > 8 * BLOCK):
                    yield block(*key, held)
                    held, size = [], 0
                key, size = (cell, role), size + len(parts[0])
                held.append(parts)
        if held:
            yield block(*key, held)

    parts = shuffle_partitions(spark)
    small_blocks = reps.repartition(parts, "rep").mapInArrow(places, ENTRIES)
    # a cell's queries are dealt to two tasks or more if it is hot: equal ranges of their first ids stay together
    ordered = small_blocks.withColumn("deal", F.pmod(F.xxhash64("ids"), F.lit(8))).repartition(parts, "cell", "role", "deal").sortWithinPartitions("cell", "role").drop("deal")
    blocks = cut(ordered.mapInArrow(gather, ENTRIES))
    queries = blocks.where("role = 1").select("cell", "ids", "counts", "cells", "vectors")
    stored = blocks.where("role = 0").select("cell", *[F.col(c).alias(f"{c}2") for c in ("ids", "counts", "cells", "vectors")])
    sizes = queries.groupBy("cell").agg(F.count("*").alias("blocks"))
    hot = hot_keys(sizes, "blocks", queries.count(), least=16)
    pairs = spread_join(queries, stored, ["cell"], hot, "ids")
    found_schema = arrow_schema(spark.createDataFrame([], FOUND).schema)

    def compare(batches):
        names = [f"{c}{side}" for side in ("", "2") for c in ("ids", "counts", "cells", "vectors")]
        for batch in batches:
            for i in range(batch.num_rows):
                cell, *bodies = (batch.column(c)[i].as_py() for c in ("cell", *names))
                (ids, counts, homes, v), (ids2, counts2, seen, v2) = bodies[:4], bodies[4:]
                ids, counts, ids2, counts2 = (np.frombuffer(x, "<i8") for x in (ids, counts, ids2, counts2))
                homes, seen = np.frombuffer(homes, "<i4"), np.frombuffer(seen, "<i4").reshape(len(ids2), -1)
                a, b = (normalised(np.frombuffer(x, kind).reshape(k, -1).astype(np.float64)) for x, k in ((v, len(ids)), (v2, len(ids2))))
                hit = (a @ b.T >= least) & (ids[:, None] != ids2[None])
                if not hit.any():
                    continue
                far = np.iinfo(np.int64).max
                own, other = ids.copy(), ids2.copy()
                while True:  # labels run along the links of the two blocks until they rest
                    new = np.minimum(own, np.where(hit, other[None], far).min(1))
                    onward = np.minimum(other, np.where(hit, new[:, None], far).min(0))
                    if (new == own).all() and (onward == other).all():
                        break
                    own, other = new, onward
                some, too = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
                # a link counts here for the stored vector too, unless that vector meets the query in the query's cell
                mutual = np.zeros_like(hit)
                for home in np.unique(homes[some]).tolist():
                    mutual[np.ix_(homes == home, (seen == home).any(1))] = True
                n = np.concatenate([hit[some] @ counts2, (hit & ~mutual)[:, too].T @ counts])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[some], ids2[too]])), pa.array(n), pa.array(np.concatenate([own[some], other[too]]))], schema=found_schema)

    found = cut(pairs.mapInArrow(compare, FOUND), total)
    comps = components(found.select(F.col("id").alias("a"), F.col("partner").alias("b")), rows=total)
    counts = found.groupBy("id").agg(F.sum("n").alias("others"))
    # only here representatives become ids again: a component is named by its least vec_id
    placed = groups.join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(comps.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = placed.join(named, "component").select(*same, "n", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    few = hot_keys(groups.select(*same, "n"), "n", rows.count())
    lone = hashed.where("not fit").select("vec_id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    out = spread_join(keyed.select("vec_id", *same), linked.drop("n"), same, few, "vec_id").select("vec_id", "n_links", "component_id").unionByName(lone)
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _grids(reps: DataFrame, total: int, sample: int, least: float, recall: float, reach: float) -> dict[int, Grid]:
    """A grid for each length of vector, with codes enough for cells of some four blocks."""
    share = min(1.0, 1.2 * sample / max(1, total))
    taken = reps.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v")
    by_size: dict[int, list] = {r.n: [] for r in reps.select(F.size("v").alias("n")).distinct().collect()}
    for r in taken.collect():
        by_size[len(r.v)].append(r.v)
    grids = {}
    for n, vs in by_size.items():
        x = normalised(np.array(vs[:sample])) if vs else np.ones((1, n)) / n**0.5
        k = int(np.clip(round((total / (4 * BLOCK)) ** 0.5), 4, sample // 16))
        grids[n] = Grid(kmeans(x[:, : n // 2], k), kmeans(x[:, n // 2 :], k))
        if recall < 1:
            grids[n].settle(x, least, recall, reach)
    return grids


def report(vectors: DataFrame) -> DataFrame:
    """The columns of op2."""
    return link(vectors)
