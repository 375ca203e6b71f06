"""Operator 10: token counts by compiled finite-state transducers.

The tokenizer is compiled into two deterministic transducers. The lexical one reads character classes; a transition
says whether a pretoken opens at this character or at the one before. Texts are cut into chunks of STEPS characters:
all chunks run in step from every state at once, the chunks' state maps compose by a parallel prefix scan, and the
entry states it yields give each chunk's true run.

The word transducer reads a pretoken's bytes, its last byte as a letter of its own, and every transition is annotated
with the tokens that it emits: how many more the prefix read so far has than the one before. A list of tokens is what
the merges make of its text just if that holds for each pair of neighbours. So the last token of a prefix is the only
token at its end that fits the last token of the prefix before it, and a state needs to know the last tokens of as many
prefixes as the longest token that may still be open is long, with their counts relative to the last one. There are
finitely many such states; the reachable ones, and their transitions, are compiled on first use, and all are dropped
when there are more than STATES. Each pretoken starts anew, so its map sends any state to the first one and adds its
count: the scan over those maps is a running sum, whose differences at the texts' bounds are the texts' counts.

Defined results: a null or empty text has 0 bytes and 0 tokens; whole texts count, of any length; repeated rows, also of
one id, give repeated results; a null id stays null; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame

from .bpe import PairTable, merge_rows
from .common import map_slices, texts_of

STEPS = 512
LIMIT = 2048
#: Compiled word states of a worker before it starts anew.
STATES = 400_000
#: Symbols of pretokens that are read in step; the rest of longer ones is read one by one.
IN_STEP = 48
SYMBOLS = 512
GOLD = 0x9E3779B97F4A7C15

# Unicode's White_Space, and the classes and states of the lexical transducer.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACE, LETTER, NUMBER, MARK, APOSTROPHE, ENDS, R, V, L, E = range(10)
OPEN, WORD, MARKS, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(7)
HERE, BEFORE = 1, 2
LETTERS = (LETTER, ENDS, R, V, L, E)


def lexical() -> tuple[np.ndarray, np.ndarray]:
    """next[state, class] and out[state, class] for contractions, letter runs, single numbers and runs of marks."""
    go, out = np.zeros((7, 10), np.uint8), np.zeros((7, 10), np.uint8)

    def opened(state: int, extra: int = 0) -> None:
        for c in LETTERS:
            go[state, c], out[state, c] = WORD, HERE | extra
        go[state, NUMBER], out[state, NUMBER] = OPEN, HERE | extra
        go[state, MARK], out[state, MARK] = MARKS, HERE | extra
        go[state, APOSTROPHE], out[state, APOSTROPHE] = QUOTE, HERE | extra
        go[state, SPACE], out[state, SPACE] = OPEN, extra

    for s in range(7):
        opened(s)
    for c in LETTERS:
        out[WORD, c] = 0
    for c in (MARK, APOSTROPHE):  # a run of marks goes on
        for s in (MARKS, QUOTE):
            go[s, c], out[s, c] = MARKS, 0
    go[QUOTE, ENDS], out[QUOTE, ENDS] = OPEN, 0
    for c, s in ((R, QUOTE_R), (V, QUOTE_V), (L, QUOTE_L)):
        go[QUOTE, c], out[QUOTE, c] = s, 0
    for s, last in ((QUOTE_R, E), (QUOTE_V, E), (QUOTE_L, L)):
        opened(s, BEFORE)
        for c in LETTERS:
            out[s, c] = BEFORE
        go[s, last], out[s, last] = OPEN, 0
    return go, out


def entry_states(maps: np.ndarray) -> np.ndarray:
    """State before each chunk, from state OPEN before the first: maps[chunk, state], composed by a prefix scan."""
    scan, gap = maps.copy(), 1
    while gap < len(scan):
        scan[gap:] = np.take_along_axis(scan[gap:], scan[:-gap], 1)
        gap *= 2
    return np.concatenate([[OPEN], scan[:-1, OPEN]]).astype(np.uint8)


class Transitions:
    """A growing open-addressed table from (state, symbol) to (state, emitted tokens)."""

    def __init__(self, bits: int = 16):
        self.bits, self.n = bits, 0
        self.keys, self.goes = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        self.emits = np.zeros(1 << bits, np.int16)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or the free one where it would go."""
        slot = ((keys.astype(np.uint64) * np.uint64(GOLD)) >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.keys[slot]
        wrong = np.flatnonzero((there != keys) & (there >= 0))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[wrong]]
            wrong = wrong[(there != keys[wrong]) & (there >= 0)]
        return slot

    def find_one(self, key: int) -> int:
        slot, mask = (key * GOLD & (2**64 - 1)) >> (64 - self.bits), (1 << self.bits) - 1
        while (there := self.keys[slot]) != key and there >= 0:
            slot = (slot + 1) & mask
        return slot

    def add(self, keys: list[int], goes: list[int], emits: list[int]) -> None:
        if 2 * (self.n + len(keys)) > len(self.keys):
            held = self.keys >= 0
            old = [x[held].tolist() for x in (self.keys, self.goes, self.emits)]
            self.__init__((2 * (self.n + len(keys))).bit_length() + 1)
            self.add(*old)
        for key, go, emit in zip(keys, goes, emits, strict=True):
            slot = self.find_one(key)
            self.keys[slot], self.goes[slot], self.emits[slot] = key, go, emit
        self.n += len(keys)


class Words:
    """The word transducer of a vocabulary: symbols 0 to 255 are bytes, 256 to 511 bytes that end the pretoken."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str, special: set[str]):
        pairs = [(m.split(" ") if isinstance(m, str) else m) for m in merges]
        self.merges = {(vocab[a], vocab[b]): (i, vocab[a + b]) for i, (a, b) in enumerate(pairs)}
        shown = byte_letters()
        self.base = [vocab[c] for c in shown] + [vocab[c + suffix] for c in shown]
        byte = {c: i for i, c in enumerate(shown)}
        self.symbols: dict[int, list[int]] = {}
        for token, i in vocab.items():
            body = token.removesuffix(suffix) if len(token) > len(suffix) else token
            if token not in special and all(c in byte for c in body):
                self.symbols[i] = [byte[c] for c in body]
                self.symbols[i][-1] += 256 * (body != token)
        self._trie(pairs, vocab)
        self.forget()

    def _trie(self, pairs: list, vocab: dict[str, int]) -> None:
        """The automaton of all tokens that merges make: per node its depth, its token and the next node of a shorter one."""
        table = PairTable([vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs], np.arange(len(pairs), dtype=np.int32), np.array([vocab[a + b] for a, b in pairs], np.int32))
        ids = list(self.symbols)
        flat = np.array([self.base[x] for i in ids for x in self.symbols[i]], np.int32)
        made, n = merge_rows(flat, np.array([len(self.symbols[i]) for i in ids]), table)
        first = np.cumsum(n) - n
        self.child, self.depth, self.token = {}, [0], [-1]
        for i in (i for i, k, at in zip(ids, n.tolist(), first.tolist(), strict=True) if k == 1 and made[at] == i):
            node = 0
            for x in self.symbols[i]:
                onward = self.child.get(node * SYMBOLS + x)
                if onward is None:
                    onward = self.child[node * SYMBOLS + x] = len(self.depth)
                    self.depth.append(self.depth[node] + 1)
                    self.token.append(-1)
                node = onward
            self.token[node] = i
        self.fail, self.shorter = [0] * len(self.depth), [0] * len(self.depth)
        for edge, node in sorted(self.child.items(), key=lambda e: self.depth[e[1]]):
            parent, x = divmod(edge, SYMBOLS)
            other = self._onward(self.fail[parent], x) if parent else 0
            self.fail[node] = other
            self.shorter[node] = other if self.token[other] >= 0 else self.shorter[other]

    def _onward(self, node: int, x: int) -> int:
        while (found := self.child.get(node * SYMBOLS + x)) is None:
            if not node:
                return 0
            node = self.fail[node]
        return found

    def forget(self) -> None:
        """Drops all compiled states but the first: nothing read, and no token before it."""
        self.table, self.fits = Transitions(), {}
        self.state_of: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self._state((0, (-1,), (0,)))

    def _state(self, state: tuple) -> int:
        n = self.state_of.setdefault(state, len(self.states))
        if n == len(self.states):
            self.states.append(state)
        return n

    def _fit(self, a: int, b: int) -> bool:
        """Whether the merges of the two tokens' text are the two tokens."""
        known = self.fits.get((a, b))
        if known is None:
            row = [self.base[x] for t in (a, b) for x in self.symbols[t]]
            while len(row) > 1:
                found = [(*m, j) for j in range(len(row) - 1) if (m := self.merges.get((row[j], row[j + 1])))]
                if not found:
                    break
                _, made, j = min(found, key=lambda f: (f[0], f[2]))
                row[j : j + 2] = [made]
            known = self.fits[a, b] = row == [a, b]
        return known

    def _compile(self, key: int) -> tuple[int, int]:
        """A transition: the state it leads to and the tokens that it emits."""
        state, x = divmod(key, SYMBOLS)
        node, lasts, counts = self.states[state]  # of the prefixes from the open part's start to the end
        node = self._onward(node, x)
        at = node if self.token[node] >= 0 else self.shorter[node]
        while True:
            before = len(lasts) - self.depth[at]
            if lasts[before] < 0 or self._fit(lasts[before], self.token[at]):
                break
            at = self.shorter[at]
        emit, keep = counts[before] + 1, len(lasts) - self.depth[node]
        if x >= 256:  # the pretoken ends
            return 0, emit
        return self._state((node, (*lasts[keep:], self.token[at]), (*[c - emit for c in counts[keep:]], 0))), emit

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        slot = self.table.find(keys)
        fresh = self.table.keys[slot] < 0
        if fresh.any():
            new = np.unique(keys[fresh]).tolist()
            self.table.add(new, *map(list, zip(*map(self._compile, new), strict=True)))
            slot = self.table.find(keys)
        return slot

    def run(self, symbols: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Tokens of pretokens that lie one after another in symbols."""
        if len(self.states) > STATES:
            self.forget()
        order = np.argsort(-lens, kind="stable")
        starts, sizes = (np.cumsum(lens) - lens)[order], lens[order]
        state, total = np.zeros(len(lens), np.int64), np.zeros(len(lens), np.int64)
        for step in range(min(IN_STEP, int(sizes[0]))):
            n = int(np.searchsorted(-sizes, -step, "left"))
            slot = self._slots(state[:n] * SYMBOLS + symbols[starts[:n] + step])
            state[:n] = self.table.goes[slot]
            total[:n] += self.table.emits[slot]
        for i in range(int(np.searchsorted(-sizes, -IN_STEP, "left"))):
            now, count = int(state[i]), 0
            for x in symbols[starts[i] + IN_STEP : starts[i] + sizes[i]].tolist():
                key = now * SYMBOLS + x
                slot = self.table.find_one(key)
                if self.table.keys[slot] < 0:
                    go, emit = self._compile(key)
                    self.table.add([key], [go], [emit])
                    slot = self.table.find_one(key)
                now, count = int(self.table.goes[slot]), count + int(self.table.emits[slot])
            total[i] += count
        out = np.empty_like(total)
        out[order] = total
        return out


class Counter:
    """The compiled transducers of one vocabulary of word BPE with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = [t["content"] for t in spec["added_tokens"]]
        self.words = Words(spec["model"]["vocab"], spec["model"]["merges"], spec["model"]["end_of_word_suffix"], set(special))
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.hint = special[0][:2] if special else ""
        every = [chr(c) if not 0xD800 <= c < 0xE000 else "�" for c in range(0x110000)]
        self.lower = np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in every], np.uint32)
        kind = {"L": LETTER, "N": NUMBER}
        self.kind = np.array([kind.get(unicodedata.category(c)[0], MARK) for c in every], np.uint8)
        self.kind[WHITE] = SPACE
        for c, k in (("'", APOSTROPHE), ("s", ENDS), ("t", ENDS), ("m", ENDS), ("d", ENDS), ("r", R), ("v", V), ("l", L), ("e", E)):
            self.kind[ord(c)] = k
        self.go, self.out = lexical()

    def _normal(self, text: str) -> tuple[str, int]:
        """The normalised text, special strings cut out as white space, and how many there were."""
        found = 0
        if self.special and self.hint in text:
            parts = self.special.split(text)
            text, found = None, len(parts) - 1
        else:
            parts = [text]
        parts = [p if p.isascii() else unicodedata.normalize("NFC", p).replace("İ", "i̇") for p in parts]
        return "\n".join(parts), found

    def _starts(self, kinds: np.ndarray) -> np.ndarray:
        """Where pretokens open."""
        n = len(kinds)
        chunks = -(-n // STEPS)
        tape = np.zeros(chunks * STEPS, np.uint8)
        tape[:n] = kinds
        tape = np.ascontiguousarray(tape.reshape(chunks, STEPS).T)  # a row a step
        go, out = self.go.ravel(), self.out.ravel()
        state = np.repeat(np.arange(7, dtype=np.uint8)[:, None], chunks, 1)
        for row in tape:
            state = go[state * np.uint8(10) + row]
        state = entry_states(np.ascontiguousarray(state.T))
        said = np.empty_like(tape)
        for i, row in enumerate(tape):
            at = state * np.uint8(10) + row
            said[i], state = out[at], go[at]
        said = said.T.ravel()[:n]
        opens = (said & HERE).astype(bool)
        opens[:-1] |= (said[1:] & BEFORE).astype(bool)
        return np.flatnonzero(opens)

    def count(self, texts: list[str]) -> list[int]:
        normal = [self._normal(t) for t in texts]
        cps = np.frombuffer("\n".join([t for t, _ in normal] + [""]).encode("utf-32-le", "surrogatepass"), "<u4")
        cps = self.lower[cps]
        kinds = self.kind[cps]
        starts = self._starts(kinds)
        total = np.array([n for _, n in normal], np.int64)
        if not len(starts):
            return total.tolist()
        solid = kinds != SPACE
        upto = np.cumsum(solid)
        edge = np.append(starts, len(cps))
        lens = upto[edge[1:] - 1] - upto[edge[:-1]] + 1
        flat = cps[solid]  # every character that is no space is in a pretoken
        wide = 1 + (flat >= 0x80).astype(np.int64) + (flat >= 0x800) + (flat >= 0x10000)
        symbols = np.frombuffer(flat.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8).astype(np.int64)
        size = np.add.reduceat(wide, np.cumsum(lens) - lens)
        symbols[np.cumsum(size) - 1] += 256
        scan = np.concatenate([[0], np.cumsum(self.words.run(symbols, size))])
        bounds = np.searchsorted(starts, np.cumsum([0, *[len(t) + 1 for t, _ in normal]]))
        return (total + np.diff(scan[bounds])).tolist()


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


@functools.lru_cache(2)
def counter(path: str | None = None) -> Counter:
    import public_tokenizers as P

    return Counter(path or P.path("word_bpe_49k.json"))


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text."""

    def run(ids, texts):
        n = counter(path).count(texts)
        return {"doc_id": ids, "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_slices(texts_of(docs, id_col, text_col), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", 512)
