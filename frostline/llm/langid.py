"""Operator 7: language identification by a linear-chain conditional random field over words.

Every word has a label. Features: the word itself (lexicon), its prefixes and suffixes of one to three letters and its
letter trigrams, hashed into FEATURES weights a label; transitions between neighbours are learned too, so code-switched
text is labelled word by word. Forward-backward gives each word's posterior; a document's language is the label of
greatest expected share, its score that share.

Training takes at most `bound` labelled documents (a documented parameter) by least hash of text and label, equal texts
once, and cuts their whole texts into stretches of words; some stretches are glued from two documents so that switches
occur. Prediction covers whole texts. A word is a run of letters (Unicode category L); numbers, marks and the like are
not part of the chain. Defined results: a null text or one without letters is `und` with score 0; without labelled rows
every text is `und`; of labels of equal share the first in alphabetical order is taken; repeated rows, also of one id,
give repeated results; a null id isn't held out; other columns are ignored, accept() keeps them.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, map_slices, slices, texts_of

FEATURES = 1 << 16
#: Labelled documents that a model is fitted on, at most.
BOUND = 1000
STRETCH = 40
#: Words of a piece of a chain; all pieces run in step.
PIECE = 48
UND = "und"
RUN = re.compile(r"[^\W\d_]+")


class Model(NamedTuple):
    labels: tuple[str, ...]
    weights: np.ndarray  # FEATURES x labels
    moves: np.ndarray  # labels x labels, log potentials
    first: np.ndarray


def features(word: str) -> list[int]:
    """Hashed lexicon, affix and trigram features of a lower-cased word."""
    marked = f"<{word}>"
    found = ["w" + word]
    for n in range(1, 4):
        found += ["p" + word[:n], "s" + word[-n:]]
    found += ["g" + marked[i : i + 3] for i in range(len(marked) - 2)]
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) & (FEATURES - 1) for f in found]


def words_of(texts: list[str]) -> list[list[str]]:
    """The runs of letters of each lower-cased text. Numbers such as ½, ² and Ⅷ match the pattern but are no letters."""
    words = [RUN.findall(t.lower()) for t in texts]
    odd = {w for w in set().union(*words) if not w.isalpha()}
    if odd:
        letters = lambda w: "".join(c if c.isalpha() else " " for c in w).split()
        words = [[x for w in ws for x in (letters(w) if w in odd else (w,))] for ws in words]
    return words


def forward_backward(scores: np.ndarray, lens: np.ndarray, moves: np.ndarray, first: np.ndarray, want_moves: bool = False):
    """Posteriors [row, step, label] of padded rows of log potentials; with want_moves also the expected transitions."""
    n, steps, k = scores.shape
    local = np.exp(scores - scores.max(2, keepdims=True))
    trans, start = np.exp(moves), np.exp(first)
    ahead, scale = np.empty_like(local), np.empty((n, steps))
    now = start * local[:, 0]
    for t in range(steps):
        if t:
            now = (ahead[:, t - 1] @ trans) * local[:, t]
        scale[:, t] = now.sum(1)
        ahead[:, t] = now / scale[:, t, None]
    back = np.ones((n, k))
    post, pairs = np.empty_like(local), np.zeros((k, k))
    for t in range(steps - 1, -1, -1):
        last = (t >= lens - 1)[:, None]
        back = np.where(last, 1.0, back)
        post[:, t] = ahead[:, t] * back
        if t:
            onward = local[:, t] * back / scale[:, t, None]
            if want_moves:
                inside = np.flatnonzero(t < lens)
                pairs += (ahead[inside, t - 1].T @ onward[inside]) * trans
            back = onward @ trans.T
    return (post, pairs) if want_moves else post


def chain_posteriors(scores: np.ndarray, lens: np.ndarray, moves: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Posteriors [word, label] of whole chains that lie one after another in scores.

    Chains are cut into pieces of PIECE words. All pieces run in step from every label at once, which gives each piece's
    matrix; the matrices of a chain, multiplied up from both ends, give the pieces' entries for the true runs.
    """
    k, trans, start = scores.shape[1], np.exp(moves), np.exp(first)
    pieces = -(-lens // PIECE)
    ends = np.cumsum(pieces)
    owner = np.repeat(np.arange(len(lens)), pieces)
    nth = np.arange(len(owner)) - np.repeat(ends - pieces, pieces)
    size = np.minimum(PIECE, lens[owner] - nth * PIECE)
    inside = np.arange(PIECE) < size[:, None]
    local = np.ones((len(owner), PIECE, k))
    local[inside] = np.exp(scores - scores.max(1, keepdims=True))
    local = np.ascontiguousarray(local.transpose(1, 0, 2))  # a row a step
    opens = nth == 0  # whatever came before, a chain begins with the labels' own weights
    unit = lambda x: x / x.sum(-1, keepdims=True)
    # matrices of the pieces
    matrix = np.broadcast_to(np.eye(k), (len(owner), k, k)).copy()
    for t in range(PIECE):
        own = slice(None) if t == 0 else np.flatnonzero(inside[:, t])
        onward = matrix[own] @ trans
        if t == 0:
            onward[opens] = start
        onward *= local[t][own][:, None]
        matrix[own] = onward / onward.sum((1, 2), keepdims=True)
    # entries from both ends
    ahead, back = np.full((len(owner), k), 1.0 / k), np.ones((len(owner), k))
    for j in range(1, int(pieces.max(initial=0))):
        own = np.flatnonzero(nth == j) if j < 8 else (ends - pieces)[pieces > j] + j
        ahead[own] = unit(np.einsum("na,nab->nb", ahead[own - 1], matrix[own - 1]))
        own = (ends - 1 - j)[pieces > j]
        back[own] = unit(np.einsum("nab,nb->na", matrix[own + 1], back[own + 1]))
    # the true runs
    post = np.empty((PIECE, len(owner), k))
    for t in range(PIECE):
        onward = ahead @ trans
        if t == 0:
            onward[opens] = start
        ahead = np.where(inside[:, t, None], unit(onward * local[t]), ahead)
        post[t] = ahead
    for t in range(PIECE - 1, -1, -1):
        post[t] = unit(post[t] * back)
        back = np.where(inside[:, t, None], unit((local[t] * back) @ trans.T), back)
    return post.transpose(1, 0, 2)[inside]


def fit(texts: list[str], langs: list[str], rounds: int = 3, rate: float = 0.1, seed: int = 7) -> Model:
    """Maximises the conditional likelihood by AdaGrad over batches of stretches."""
    labels = tuple(sorted(set(langs)))
    k, rng = len(labels), np.random.default_rng(seed)
    known: dict[str, np.ndarray] = {}
    stretches = []
    for words, lang in zip(words_of(texts), langs, strict=True):
        y = labels.index(lang)
        for lo in range(0, len(words), STRETCH):
            stretches.append((words[lo : lo + STRETCH], [y] * len(words[lo : lo + STRETCH])))
    stretches = [stretches[i] for i in rng.permutation(len(stretches))]
    for i in range(0, len(stretches) - 1, 5):  # a fifth: switch from one document to another within the stretch
        (w1, y1), (w2, y2) = stretches[i], stretches[i + 1]
        stretches.append((w1[: STRETCH // 2] + w2[: STRETCH // 2], y1[: STRETCH // 2] + y2[: STRETCH // 2]))
    weights, moves, first = np.zeros((FEATURES, k)), np.zeros((k, k)), np.zeros(k)
    g_w, g_m = np.full((FEATURES, k), 1e-2), np.full((k, k), 1e-2)
    for _ in range(rounds):
        order = rng.permutation(len(stretches))
        for lo in range(0, len(order), 64):
            batch = [stretches[i] for i in order[lo : lo + 64] if stretches[i][0]]
            if not batch:
                continue
            lens = np.array([len(w) for w, _ in batch])
            for w, _ in batch:
                for x in w:
                    if x not in known:
                        known[x] = np.array(features(x))
            lists = [known[x] for w, _ in batch for x in w]
            sizes = np.array(list(map(len, lists)))
            flat = np.concatenate(lists)
            emit = np.add.reduceat(weights[flat], np.cumsum(sizes) - sizes, axis=0)
            mask = np.arange(lens.max()) < lens[:, None]
            scores = np.zeros((*mask.shape, k))
            scores[mask] = emit
            post, pairs = forward_backward(scores, lens, moves, first, True)
            y = np.concatenate([np.array(ys) for _, ys in batch])
            gold = np.eye(k)[y]
            wrong = (gold - post[mask]) / len(batch)
            spread = np.repeat(wrong, sizes, axis=0)
            grad = np.stack([np.bincount(flat, spread[:, j], FEATURES) for j in range(k)], 1)
            touched = np.unique(flat)
            step = grad[touched] - 1e-5 * weights[touched]
            g_w[touched] += step**2
            weights[touched] += rate * step / np.sqrt(g_w[touched])
            seen = np.zeros((k, k))
            for _, ys in batch:
                np.add.at(seen, (ys[:-1], ys[1:]), 1)
            step = (seen - pairs) / len(batch) - 1e-3 * moves
            g_m += step**2
            moves = moves + rate * step / np.sqrt(g_m)
    return Model(labels, weights.astype(np.float32), moves, first)


class Labeller:
    def __init__(self, model: Model):
        self.model, self.memo = model, Memo()
        self.table = np.zeros((0, len(model.labels)), np.float32)

    def _emissions(self, words: list[str]) -> None:
        """Log potentials of new words, many at once."""
        rows = [self.table]
        for lo in range(0, len(words), 20_000):
            lists = list(map(features, words[lo : lo + 20_000]))
            sizes = np.array(list(map(len, lists)))
            rows.append(np.add.reduceat(self.model.weights[np.fromiter(chain.from_iterable(lists), np.int64)], np.cumsum(sizes) - sizes, axis=0))
        at = len(self.table)
        self.table = np.concatenate(rows)
        self.memo.learn(words, range(at, at + len(words)), 32 + 4 * self.table.shape[1])

    def posteriors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The posteriors of all texts' words, [word, label], and how many words each has."""
        self.memo.make_room()
        self.table = self.table[: len(self.memo)]
        words = words_of(texts)
        new = [*set().union(*words).difference(self.memo)]
        if new:
            self._emissions(new)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        rows = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(words)), np.int64, int(lens.sum()))
        return chain_posteriors(self.table[rows].astype(np.float64), lens, self.model.moves, self.model.first), lens

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        if not self.model.labels:
            return [(UND, 0.0)] * len(texts)
        post, lens = self.posteriors(texts)
        some = np.flatnonzero(lens)
        found: list = [(UND, 0.0)] * len(texts)
        if len(some):
            share = np.add.reduceat(post, (np.cumsum(lens) - lens)[some], axis=0) / lens[some, None]
            best = share.argmax(1)
            score = np.clip(share[np.arange(len(some)), best], 0.0, 1.0).tolist()
            for i, b, x in zip(some.tolist(), best.tolist(), score, strict=True):
                found[i] = (self.model.labels[b], x)
        return found


def train(labelled: DataFrame, bound: int = BOUND, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits on at most bound rows of labelled that have text and language; the same rows on every run."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    rows = rows.withColumn("h", F.xxhash64("lang", "text"))
    total = rows.count()
    share = min(1.0, 1.3 * bound / max(1, total))  # a hash threshold, so that about bound rows of any table leave the executors
    picked = rows.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))).dropDuplicates(["h"])
    sample = sorted(picked.select("h", "text", "lang").collect())[:bound]
    if not sample:
        return Model((), np.zeros((FEATURES, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    return fit([r.text for r in sample], [r.lang for r in sample])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x labels floats, whatever the corpus

    def run(ids, texts):
        found = labeller(shipped).predict(texts)
        return {"doc_id": ids, "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

    return map_slices(texts_of(docs, id_col, text_col), run, "doc_id long, lang_pred string, score double", 1024)


_open: dict = {}


def labeller(shipped) -> Labeller:
    """One labeller a worker and model."""
    if shipped.value is not _open.get("model"):
        _open.update(model=shipped.value, labeller=Labeller(shipped.value))
    return _open["labeller"]


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


def report(docs: DataFrame) -> DataFrame:
    """The columns of op7: learned only from rows that are not held out."""
    model = train(docs.where(~F.coalesce(held_out(), F.lit(False))))
    found = identify(docs, model)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def accept(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs, as they are, whose text has a language with a score of at least `least`."""
    names, shipped = docs.columns, docs.sparkSession.sparkContext.broadcast(model)
    at = names.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, at, 1024):
                found = labeller(shipped).predict([t or "" for t in part.column(at).to_pylist()])
                yield part.filter(pa.array([lang != UND and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
