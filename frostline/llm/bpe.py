"""Operator 5: byte-level BPE encoding and decoding by length-bucketed padded matrices.

Pieces of text become rows of a padded id matrix, bucketed by length. Each round looks every row's adjacent pairs up
in a hash table, merges the leftmost pair of least rank in every row at once, compacts the rows and retires those
without a pair left. Defined results: a null or empty text has no ids; repeated rows give repeated results; text is
never cut. A round takes time in proportion to the row, so that one piece takes quadratic time in a matrix: pieces over
LONG bytes (no white space, no change between letters, digits and marks) go through an equivalent heap.
"""

from __future__ import annotations

import base64
import contextlib
import functools
import hashlib
import heapq
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from .coding import SegmentCoder
from .common import map_slices, texts_of
from .hashing import spans

LONG = 8192
NONE = np.int32(2**31 - 1)


class PairTable:
    """Open-addressed numpy hash table from a pair of ids to (rank, merged id)."""

    def __init__(self, left, right, rank, merged):
        bits = max(10, int(np.ceil(np.log2(max(1, len(left)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.rank = np.full(1 << bits, NONE)
        self.merged = np.full(1 << bits, NONE)
        keys = (np.asarray(left, np.uint64) << np.uint64(32)) | np.asarray(right, np.uint64)
        todo, slot = np.arange(len(keys)), self._home(keys)
        while len(todo):  # all keys still without a place try their slot; the first of each slot gets it
            free = self.keys[slot] == np.uint64(2**64 - 1)
            _, first = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[first]
            at, who = slot[won], todo[won]
            self.keys[at], self.rank[at], self.merged[at] = keys[who], np.asarray(rank)[who], np.asarray(merged)[who]
            left_over = np.ones(len(todo), bool)
            left_over[won] = False
            todo, slot = todo[left_over], (slot[left_over] + 1) & self.mask

    def _home(self, keys):
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left, right):
        """Slots of the pairs; a pair that is not there gets an empty slot, whose rank is NONE."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = self._home(keys)
        there = self.keys[slot]
        open_ = np.flatnonzero((there != keys) & (there != np.uint64(2**64 - 1)))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            there = self.keys[slot[open_]]
            open_ = open_[(there != keys[open_]) & (there != np.uint64(2**64 - 1))]
        return slot


def merge_rows(flat: np.ndarray, lens: np.ndarray, pairs: PairTable, long: int = LONG) -> tuple[np.ndarray, np.ndarray]:
    """Merges rows to the end. Rows lie one after another in flat; so do the results, with their lengths."""
    starts = np.cumsum(lens) - lens
    order = np.argsort(lens, kind="stable")
    sizes = lens[order]
    done, done_lens, at = [], np.zeros(len(lens), np.int64), 0
    while at < len(order):
        n = int(sizes[at])
        if n < 2 or n > long:
            end = int(np.searchsorted(sizes, 1, "right")) if n < 2 else at + 1
            i = order[at]
            part = flat[spans(starts[order[at:end]], sizes[at:end])] if n < 2 else merge_heap(flat[starts[i] : starts[i] + n], pairs)
            done_lens[order[at:end]] = sizes[at:end] if n < 2 else len(part)
        else:
            widest = min(long, n + n // 4)
            end = min(int(np.searchsorted(sizes, widest, "right")), at + max(1, 2_000_000 // widest))
            part, done_lens[order[at:end]] = _merge_bucket(flat[spans(starts[order[at:end]], sizes[at:end])], sizes[at:end], pairs)
        done.append(part.astype(np.int32))
        at = end
    together = np.concatenate(done) if done else np.zeros(0, np.int32)
    by_order = done_lens[order]
    back = np.zeros(len(lens), np.int64)
    back[order] = np.cumsum(by_order) - by_order
    return together[spans(back, done_lens)], done_lens


def _merge_bucket(flat: np.ndarray, size: np.ndarray, pairs: PairTable) -> tuple[np.ndarray, np.ndarray]:
    width, who = int(size.max()), np.arange(len(size))
    ids = np.zeros((len(size), width), np.int32)
    ids[np.arange(width) < size[:, None]] = flat
    size, result, result_size = size.copy(), ids.copy(), size.copy()
    slots = pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(who), width - 1)
    rank, merged = pairs.rank[slots], pairs.merged[slots]
    rank[np.arange(width - 1) >= size[:, None] - 1] = NONE
    while len(who):
        p = rank.argmin(1)
        live = rank[np.arange(len(who)), p] != NONE
        if not live.all():
            gone = ~live
            result[who[gone], : ids.shape[1]], result_size[who[gone]] = ids[gone], size[gone]
            who, ids, rank, merged, size, p = who[live], ids[live], rank[live], merged[live], size[live], p[live]
            if not len(who):
                break
        every = np.arange(len(who))
        made = merged[every, p]
        # compaction: column p + 1 of ids and column p of the pair arrays go
        keep = np.arange(ids.shape[1]) != (p + 1)[:, None]
        ids = ids[keep].reshape(len(who), -1)
        ids[every, p] = made
        size = size - 1
        if ids.shape[1] < 2:
            result[who, :1], result_size[who] = ids, size
            break
        keep = keep[:, 1:]
        rank, merged = rank[keep].reshape(len(who), -1), merged[keep].reshape(len(who), -1)
        for q in (p - 1, p):  # the pairs that the new id belongs to
            inside = (q >= 0) & (q < rank.shape[1])
            ok = np.flatnonzero(inside & (q < size - 1))
            s = pairs.find(ids[ok, q[ok]], ids[ok, q[ok] + 1])
            rank[ok, q[ok]], merged[ok, q[ok]] = pairs.rank[s], pairs.merged[s]
            past = np.flatnonzero(inside & (q >= size - 1))
            rank[past, q[past]] = NONE
    return result[np.arange(width) < result_size[:, None]], result_size


def merge_heap(row: np.ndarray, pairs: PairTable) -> np.ndarray:
    """The same merges for one long row in O(n log n), by a heap of (rank, position) over a linked list."""
    ids, n = row.astype(np.int64), len(row)
    nxt, prv, dead = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
    slots = pairs.find(ids[:-1], ids[1:])
    heap = [(int(r), i, int(ids[i]), int(ids[i + 1])) for i, r in enumerate(pairs.rank[slots]) if r != NONE]
    heapq.heapify(heap)
    ids = ids.tolist()

    def push(i: int, j: int) -> None:
        s = pairs.find(np.array([ids[i]]), np.array([ids[j]]))[0]
        if pairs.rank[s] != NONE:
            heapq.heappush(heap, (int(pairs.rank[s]), i, ids[i], ids[j]))

    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = nxt[i]
        if dead[i] or j >= n or ids[i] != a or ids[j] != b:
            continue
        ids[i] = int(pairs.merged[pairs.find(np.array([a]), np.array([b]))[0]])
        dead[j] = 1
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
            push(i, nxt[i])
        if prv[i] >= 0:
            push(prv[i], i)
    return np.array([x for x, d in zip(ids, dead, strict=True) if not d], np.int32)


class RankBPE:
    """A rank file's vocabulary: encodes segments, decodes ids."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, r in self.ranks.items():
            self.bytes_of[r] = token
        self.known = {}  # texts of single tokens, which are not merged anew
        for token, r in self.ranks.items():
            with contextlib.suppress(UnicodeDecodeError):
                self.known[token.decode()] = r.to_bytes(4, "little")
        self.decimal = [str(i).encode() for i in range(len(self.bytes_of))]
        self.first = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        left, right, rank = [], [], []
        for token, r in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        self.pairs = PairTable(left, right, np.array(rank, np.int32), np.array(rank, np.int32))
        self.coder = SegmentCoder(self._learn, "<u4")

    def _learn(self, before: str, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of before + segment, for every segment, and how many."""
        pieces = [[before + s] if s.isascii() and s.isalpha() else self.pattern.findall(before + s) for s in new]
        rest = [p for p in {*chain.from_iterable(pieces)} if p not in self.known]
        raw = [p.encode("utf-8", "surrogatepass") for p in rest]
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        flat, lens = merge_rows(self.first[np.frombuffer(b"".join(raw), np.uint8)], lens, self.pairs)
        data, ends = flat.astype("<u4").tobytes(), (np.cumsum(lens) * 4).tolist()
        whole = dict(zip(rest, [data[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
        find = lambda p: whole[p] if p in whole else self.known[p]
        found = [find(ps[0]) if len(ps) == 1 else b"".join(map(find, ps)) for ps in pieces]
        return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each whole text."""
        return self.coder.encode_each(texts)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.lru_cache(4)
def vocabulary(path: str | None = None, pattern: str | None = None) -> RankBPE:
    """Loaded once a worker; the default is the public 50k byte vocabulary."""
    import public_tokenizers as P

    return RankBPE(path or P.path("byte_bpe_50k.tiktoken"), pattern or P.PATTERN)


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids array<int> of every whole text."""

    def run(ids, texts):
        found = [np.frombuffer(x, "<u4").astype(np.int32) for x in vocabulary(path, pattern).encode(texts)]
        return {"doc_id": ids, "n_tokens": [len(x) for x in found], "ids": found}

    return map_slices(texts_of(docs, id_col, text_col), run, "doc_id long, n_tokens long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); bytes that are no UTF-8 become replacement characters, null ids a null text."""

    def run(keys, ids):
        v = vocabulary(path, pattern)
        return {"doc_id": keys, "text": [None if x is None else v.decode(x).decode("utf-8", "replace") for x in ids]}

    return map_slices(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The digest columns of op5: encodes each whole text, then decodes the ids it got."""

    def run(keys, texts):
        v = vocabulary(path)
        out = {"doc_id": keys, "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for ids in v.encode(texts):
            numbers = np.frombuffer(ids, "<u4").tolist()
            out["n_tokens"].append(len(numbers))
            out["ids_sha256"].append(hashlib.sha256(b" ".join(map(v.decimal.__getitem__, numbers))).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(v.decode(numbers)).hexdigest())
        return out

    return map_slices(texts_of(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", 1024)
