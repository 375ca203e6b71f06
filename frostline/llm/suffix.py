"""Operator 6: removal of repeated substrings by threshold-bounded interval expansion on Burrows-Wheeler transforms.

The corpus is too large for one transform, so equal strings are brought together first. Every window of LEAST bytes
belongs to the bucket of its minimizer, the least hash of the GRAM-byte strings in it; equal windows have equal
minimizers. Neighbouring windows of one minimizer form a segment. Segments whose minimizer occurs in one document only
can't repeat and stay where they are; of the others, equal segments of a part travel once, with the smallest document.
A minimizer of more than HOT segments, such as one in a line that all documents share, isn't one bucket: its windows are
keyed by the bytes around it that they have in common, all but CLASS - 1 of their own, which again equal windows share.
A bucket's distinct segments that share a window, by its hash, get a suffix array, and breadth-first backward extension over its Burrows-Wheeler rows
settles where neighbouring suffixes share 0, 1, 2, ... bytes, stopping at LEAST: what is unsettled then shares LEAST
bytes. The smallest document of each such class goes back to the parts, where documents lose the covered bytes.

Defined results: null or empty texts and texts under LEAST bytes lose nothing; rows of one id never remove each
other's bytes; a null id counts as smaller than all others; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, shuffle_partitions, texts_of
from .hashing import SpanTable, scramble, spans

LEAST = 50
GRAM = 16
#: Bytes of text whose windows are hashed at a time.
PIECE = 1 << 19
#: Rounds that a bucket is settled in, by minimizer, so that its suffix arrays stay small.
ROUNDS = 16
#: Segments of a minimizer from which on its windows get finer keys, in classes of CLASS neighbouring windows.
HOT, CLASS = 1024, 5
#: Segments of a minimizer in one part from which on the part says how many there are.
FEW = 4
#: Bytes of text of a part, about.
PART_BYTES = 8 << 20
NO_ID = -(2**63)
_letters = scramble(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def grams(tape: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Scrambled hashes of all n-byte strings, put together from those of powers of two."""
    h, size, whole, have = _letters[tape], 1, None, 0
    with np.errstate(over="ignore"):
        while True:
            if n & size:
                whole = h if whole is None else whole[: len(whole) - size] * np.uint64(pow(0xD6E8FEB86659FD93, size, 2**64)) + h[have:]
                have += size
            if have == n:
                return scramble(whole)
            h = h[:-size] * np.uint64(pow(0xD6E8FEB86659FD93, size, 2**64)) + h[size:]
            size *= 2


def minimizers(h: np.ndarray, least: int) -> np.ndarray:
    """For every window of `least` bytes the least hash of its grams."""
    width, have = least - GRAM + 1, 1
    while have * 2 <= width:
        h, have = np.minimum(h[:-have], h[have:]), have * 2
    return np.minimum(h[: len(h) - (width - have)], h[width - have :]) if width > have else h


def refine(at: np.ndarray, m: np.ndarray, h: np.ndarray, least: int) -> np.ndarray:
    """Keys of the windows `at`, of minimizers m: a hash of what the windows of one class have in common.

    The class of a window is where in it its minimizer first stands, by CLASS bytes.
    """
    offset, todo = np.zeros(len(at), np.int64), np.arange(len(at))
    while len(todo):  # the first gram of the window that is its minimizer
        todo = todo[h[at[todo] + offset[todo]] != m[todo]]
        offset[todo] += 1
    kind = offset // CLASS
    start = at + offset - kind * CLASS  # of the bytes that all windows of the class have
    shared = least - CLASS + 1
    key = scramble(m + kind.astype(np.uint64))
    with np.errstate(over="ignore"):
        for lo in [*range(0, shared - GRAM, GRAM), shared - GRAM]:
            key = scramble(key * np.uint64(0x9E3779B97F4A7C15) + h[start + lo])
    return key


def short(m: np.ndarray, buckets: int) -> np.ndarray:
    """The 32 bits that name a minimizer within its bucket m % buckets: now and then two, which only makes candidates."""
    return (m >> np.uint64(32)).astype(np.uint32)


def named(m: np.ndarray, buckets: int) -> np.ndarray:
    return ((m % np.uint64(buckets)) << np.uint64(32)) | short(m, buckets)


def segments(raws: list[bytes], least: int, repeated: np.ndarray | None = None, hot: np.ndarray | None = None, buckets: int = 1) -> tuple[np.ndarray, ...]:
    """Runs of windows with one key: key, document index, first window, windows. The key is the minimizer; given the
    names of repeated minimizers, there are only segments of those, and the hot ones have finer keys."""
    pieces = [(d, lo, r[lo : lo + PIECE + least - 1]) for d, r in enumerate(raws) for lo in range(0, max(0, len(r) - least + 1), PIECE)]
    found, at = [], 0
    while at < len(pieces):
        end, size = at, 0
        while end < len(pieces) and (end == at or size + len(pieces[end][2]) <= PIECE):
            size += len(pieces[end][2])
            end += 1
        part, at = pieces[at:end], end
        tape = np.frombuffer(b"".join(p for _, _, p in part), np.uint8)
        lens = np.array([len(p) for _, _, p in part])
        base = np.cumsum(lens) - lens
        h = grams(tape)
        m = minimizers(h, least)
        valid = np.ones(len(m), bool)
        for e in (base[1:]).tolist():
            valid[e - least + 1 : e] = False
        change = m[1:] != m[:-1]
        first = np.flatnonzero(valid & np.concatenate([[True], change | ~valid[:-1]]))
        last = np.flatnonzero(valid & np.concatenate([change | ~valid[1:], [True]]))
        key = m[first]
        if repeated is not None:
            name = named(key, buckets)
            warm = member(name, hot)
            keep = member(name, repeated) & ~warm
            rest = spans(first[warm], (last - first + 1)[warm])
            if len(rest):  # windows of hot minimizers, in runs of their finer keys
                fine = refine(rest, m[rest], h, least)
                new = (fine[1:] != fine[:-1]) | (rest[1:] != rest[:-1] + 1)
                opens, ends = np.flatnonzero(np.concatenate([[True], new])), np.flatnonzero(np.concatenate([new, [True]]))
                first, last, key = (np.concatenate([x[keep], y]) for x, y in ((first, rest[opens]), (last, rest[ends]), (key, fine[opens])))
            else:
                first, last, key = first[keep], last[keep], key[keep]
        owner = np.searchsorted(base, first, "right") - 1
        docs, los = np.array([d for d, _, _ in part]), np.array([lo for _, lo, _ in part])
        found.append((key, docs[owner], first - base[owner] + los[owner], last - first + 1))
    kinds = (np.uint64, np.int64, np.int64, np.int64)
    return tuple(np.concatenate([np.zeros(0, k), *[f[i] for f in found]]) for i, k in enumerate(kinds))


def member(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse, ordered by at least `depth` bytes, by doubling from eight."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : n + i]
    have = 8
    while True:
        order = np.argsort(key)
        seen = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[False], seen[1:] != seen[:-1]])).astype(np.uint64)
        if have >= depth:
            inverse = np.empty(n, np.int64)
            inverse[order] = np.arange(n)
            return order, inverse
        onward = np.zeros(n, np.uint64)
        onward[: max(0, n - have)] = rank[have:] + np.uint64(1)
        key, have = (rank << np.uint64(32)) | onward, have * 2


def repeat_classes(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array, and for each of its rows the number of its class of suffixes that share `least` bytes.

    Row psi[j] is the row that backward extension by the letter of row j starts from. Rows j - 1 and j share
    value + 1 bytes just if their letters agree and their rows psi lie in one interval of value bytes.
    """
    n = len(text)
    order, inverse = suffix_order(text, least + 1)
    psi = inverse[np.minimum(order + 1, n - 1)]
    letters = text[order]
    edge = np.concatenate([[True], letters[1:] != letters[:-1]])  # settled: neighbours share no byte
    ends = np.flatnonzero(order == n - 1)[0]
    edge[ends] = True  # the last suffix has no row after it, and stands alone
    if ends + 1 < n:
        edge[ends + 1] = True
    left = np.flatnonzero(~edge)
    for _ in range(1, least):
        if not len(left):
            break
        interval = np.cumsum(edge, dtype=np.int32)
        settled = interval[psi[left - 1]] != interval[psi[left]]
        edge[left[settled]] = True
        left = left[~settled]
    return order, np.cumsum(edge) - 1


def earliest(text: np.ndarray, lens: np.ndarray, docs: np.ndarray, least: int) -> np.ndarray:
    """For every window of every segment, one after another, the smallest document with a segment that has it too."""
    base = np.cumsum(lens) - lens
    order, cls = repeat_classes(np.concatenate([text, np.zeros(least, np.uint8)]), least)  # no window reaches the end
    real = order < len(text)
    order, cls = order[real], np.cumsum(np.concatenate([[False], np.diff(cls[real]) > 0]))
    seg_of = np.repeat(np.arange(len(lens)), lens)
    inside = np.arange(len(text)) - base[seg_of] <= lens[seg_of] - least
    value = np.where(inside[order], docs[seg_of[order]], np.iinfo(np.int64).max)
    starts = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
    least_doc = np.minimum.reduceat(value, starts)
    by_place = np.empty(len(text), np.int64)
    by_place[order] = least_doc[cls]
    return by_place[inside]


def repeating(text: np.ndarray, lens: np.ndarray, least: int) -> np.ndarray:
    """Which of the segments, one after another, hold a window whose hash occurs again."""
    ends = np.cumsum(lens)
    inside = np.arange(len(text)) + least <= np.repeat(ends, lens)
    h, owner = grams(text, least)[inside[: len(text) - least + 1]], np.repeat(np.arange(len(lens)), lens - least + 1)
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    found = np.zeros(len(lens), bool)
    found[owner[order[1:][same]]] = found[owner[order[:-1][same]]] = True
    return found


def settled(text: np.ndarray, lens: np.ndarray, docs: np.ndarray, least: int) -> np.ndarray:
    """earliest(), for which only segments that share a window with another or with themselves need a transform.

    Segments meet by GRAM bytes, which repeat the more the larger the corpus is; most of them share no window.
    """
    again, n = repeating(text, lens, least), lens - least + 1
    found = np.repeat(docs, n)
    if again.any():
        found[np.repeat(again, n)] = earliest(text[np.repeat(again, lens)], lens[again], docs[again], least)
    return found


class Part:
    """The candidate segments of one part's documents, equal ones once, in an order that any rerun finds again."""

    def __init__(self, ids: np.ndarray, raws: list[bytes], repeated: np.ndarray, hot: np.ndarray, buckets: int, least: int):
        m, self.doc, self.start, self.count = segments(raws, least, repeated, hot, buckets)
        tape = np.frombuffer(b"".join(raws), np.uint8)
        base = np.cumsum([0, *map(len, raws)])
        self.table = SpanTable()
        which, _ = self.table.numbers(tape, base[self.doc] + self.start, self.count + least - 1)
        n = self.table.n
        key, tie = np.zeros(n, np.uint64), self.table.hashes[:n]
        key[which] = m  # equal segments have equal keys
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((tie, key, bucket))
        if ((key[order][1:] == key[order][:-1]) & (tie[order][1:] == tie[order][:-1])).any():
            order = np.array(sorted(range(n), key=lambda i: (bucket[i], key[i], self.table.bytes_of(np.array([i])).tobytes())))
        self.order = order
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        self.which = back[which]
        self.bucket = bucket[order]
        self.round = (key[order] // np.uint64(buckets) % np.uint64(ROUNDS)).astype(np.uint8)
        self.least_doc = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(self.least_doc, self.which, ids[self.doc])


def _docs(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    ids = np.array([NO_ID if i is None else i for i in table.column("doc_id").to_pylist()], np.int64)
    return ids, table.column("text").cast(pa.binary()).to_pylist()


HASHES = "bucket int, part int, every binary, several binary, many binary"
REPEATED = "part int, hashes binary, hot binary"
SEGMENTS = "bucket int, part int, rounds binary, sizes binary, docs binary, bytes binary"
FOUND = "part int, bucket int, pieces binary, counts binary, docs binary"


def remove_repeats(documents: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", want_text: bool = False, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row; kept holds the remaining bytes."""
    spark = documents.sparkSession
    texts = texts_of(documents, id_col, text_col)
    # parts and buckets are loaded whole, so that their number follows the texts' bytes
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    buckets = max(shuffle_partitions(spark), -(-size // (2 * PART_BYTES)))
    parts = 2 * buckets
    docs = texts.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")).repartition(parts, "part")
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if want_text else "")
    schemas = {s: arrow_schema(spark.createDataFrame([], s).schema) for s in (HASHES, REPEATED, SEGMENTS, FOUND, result)}

    def rows(schema: str, found: list[tuple]) -> pa.Table:
        columns = list(zip(*found, strict=True)) if found else [[] for _ in schemas[schema]]
        return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schemas[schema], strict=True)], schema=schemas[schema])

    def hashes(table: pa.Table) -> pa.Table:
        ids, raws = _docs(table)
        m, doc, *_ = segments(raws, least)
        if not len(m):
            return rows(HASHES, [])
        order = np.argsort(m)
        m, own = m[order], ids[doc[order]]
        starts = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
        counts = np.diff(np.append(starts, len(m)))
        m, several = m[starts], np.minimum.reduceat(own, starts) != np.maximum.reduceat(own, starts)
        bucket = (m % np.uint64(buckets)).astype(np.uint32)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        part, m, out = table.column("part")[0].as_py(), short(m, buckets), []
        for b in range(buckets):
            own = order[cuts[b] : cuts[b + 1]]
            if len(own):
                some = own[counts[own] >= FEW]
                out.append((b, part, m[own].tobytes(), m[own[several[own]]].tobytes(), np.stack([m[some], counts[some].astype(np.uint32)], 1).tobytes()))
        return rows(HASHES, out)

    def repeated(table: pa.Table) -> pa.Table:
        read = lambda c: [np.frombuffer(x, np.uint32) for x in table.column(c).to_pylist()]
        every, bucket = read("every"), np.uint64(table.column("bucket")[0].as_py() << 32)
        value, n = np.unique(np.concatenate(every), return_counts=True)
        again = np.union1d(value[n > 1], np.concatenate(read("several")))
        many = np.concatenate(read("many")).reshape(-1, 2)
        # a part says how many segments a minimizer has if they are FEW or more
        np.add.at(n, np.searchsorted(value, many[:, 0]), many[:, 1].astype(n.dtype))
        hot_ = np.intersect1d(again, value[n > hot])
        name = lambda x, known: (x[member(x, known)].astype(np.uint64) | bucket).tobytes()
        return rows(REPEATED, [(p, name(x, again), name(x, hot_)) for p, x in zip(table.column("part").to_pylist(), every, strict=True)])

    def joined(table: pa.Table, column: str) -> np.ndarray:
        return np.sort(np.frombuffer(b"".join(x for x in table.column(column).to_pylist() if x is not None), np.uint64))

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return rows(SEGMENTS, [])
        ids, raws = _docs(left)
        p, part = Part(ids, raws, joined(right, "hashes"), joined(right, "hot"), buckets, least), left.column("part")[0].as_py()
        cuts, out = np.searchsorted(p.bucket, np.arange(buckets + 1)), []
        for b in range(buckets):
            own = slice(cuts[b], cuts[b + 1])
            if cuts[b] < cuts[b + 1]:
                segs = p.order[own]
                out.append((b, part, p.round[own].tobytes(), p.table.lens[segs].astype("<i4").tobytes(), p.least_doc[own].tobytes(), p.table.bytes_of(segs).tobytes()))
        return rows(SEGMENTS, out)

    def settle(table: pa.Table) -> pa.Table:
        read = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), t)
        lens = read("sizes", "<i4").astype(np.int64)
        known = SpanTable()
        which, _ = known.numbers(read("bytes", np.uint8), np.cumsum(lens) - lens, lens)
        docs_, turns = np.full(known.n, np.iinfo(np.int64).max), np.zeros(known.n, np.uint8)
        np.minimum.at(docs_, which, read("docs", np.int64))
        turns[which] = read("rounds", np.uint8)
        # the answer of a segment: runs of windows with one smallest document
        pieces, at, counts, firsts, used = np.zeros(known.n, np.int64), np.zeros(known.n, np.int64), [], [], 0
        for turn in range(ROUNDS):  # equal windows have equal keys, and so a round in common
            own = np.flatnonzero(turns == turn)
            if not len(own):
                continue
            v = settled(known.bytes_of(own), known.lens[own].astype(np.int64), docs_[own], least)
            n = known.lens[own] - least + 1
            opens = np.concatenate([[True], v[1:] != v[:-1]])
            opens[np.cumsum(n) - n] = True
            edge = np.flatnonzero(opens)
            pieces[own] = np.add.reduceat(opens.astype(np.int64), np.cumsum(n) - n)
            at[own] = used + np.cumsum(pieces[own]) - pieces[own]
            used += len(edge)
            counts.append(np.diff(np.append(edge, len(v))).astype("<i4"))
            firsts.append(v[edge])
        counts, firsts = np.concatenate(counts), np.concatenate(firsts)
        out, bucket, n = [], table.column("bucket")[0].as_py(), pieces[which]
        ends = np.cumsum([len(x) // 4 for x in table.column("sizes").to_pylist()]).tolist()
        for part, lo, hi in zip(table.column("part").to_pylist(), [0, *ends], ends, strict=False):
            run = spans(at[which[lo:hi]], n[lo:hi])
            out.append((part, bucket, n[lo:hi].astype("<i4").tobytes(), counts[run].tobytes(), firsts[run].tobytes()))
        return rows(FOUND, out)

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return rows(result, [])
        ids, raws = _docs(left)
        found = sorted(zip(*(right.column(c).to_pylist() for c in ("bucket", "pieces", "counts", "docs")), strict=True), key=lambda r: r[0])
        join = lambda i, t: np.frombuffer(b"".join(r[i] for r in found if r[i] is not None), t)
        p = Part(ids, raws, joined(right, "hashes"), joined(right, "hot"), buckets, least)
        pieces, counts, firsts = join(1, "<i4").astype(np.int64), join(2, "<i4").astype(np.int64), join(3, np.int64)
        if len(pieces) != p.table.n:
            raise ValueError("answers do not match the segments asked about")
        base = np.cumsum([0, *map(len, raws)])
        n = pieces[p.which]  # answers of every occurrence
        at = np.repeat((np.cumsum(pieces) - pieces)[p.which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        offset = np.cumsum(counts) - counts
        offset -= np.repeat(offset[np.cumsum(pieces) - pieces], pieces) if len(pieces) else 0
        owner = np.repeat(np.arange(len(n)), n)
        gone = firsts[at] < ids[p.doc[owner]]
        at, owner = at[gone], owner[gone]
        a = base[p.doc[owner]] + p.start[owner] + offset[at]
        b = a + counts[at] + least - 1
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        if len(a):
            reach = np.maximum.accumulate(b)
            fresh = np.concatenate([[True], (a[1:] > reach[:-1]) | np.isin(a[1:], base)])  # a span ends with its document
            starts = np.flatnonzero(fresh)
            a, b = a[starts], reach[np.append(starts[1:], len(fresh)) - 1]
        cuts, out = np.searchsorted(a, base), []
        for i, raw in enumerate(raws):
            kept, at_, lost = [], 0, 0
            for s, e in zip((a[cuts[i] : cuts[i + 1]] - base[i]).tolist(), (b[cuts[i] : cuts[i + 1]] - base[i]).tolist(), strict=True):
                kept.append(raw[at_:s])
                lost, at_ = lost + e - s, e
            kept = b"".join([*kept, raw[at_:]])
            out.append((None if ids[i] == NO_ID else int(ids[i]), len(raw), lost, int(cuts[i + 1] - cuts[i]), hashlib.sha256(kept).hexdigest(), *([kept] if want_text else [])))
        return rows(result, out)

    again = docs.groupBy("part").applyInArrow(hashes, HASHES).groupBy("bucket").applyInArrow(repeated, REPEATED)
    asked = docs.groupBy("part").cogroup(again.groupBy("part")).applyInArrow(send, SEGMENTS)
    answered = asked.groupBy("bucket").applyInArrow(settle, FOUND)
    both = answered.unionByName(again.withColumn("bucket", F.lit(-1)), allowMissingColumns=True)
    return docs.groupBy("part").cogroup(both.groupBy("part")).applyInArrow(remove, result)


def report(documents: DataFrame) -> DataFrame:
    return remove_repeats(documents)
