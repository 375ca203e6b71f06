"""Operator 8: mixing sources to target weights with soft domain membership.

A classifier fitted on a labelled table predicts each document's posterior over domains. Nonnegative rates r are then
fitted so that the expected domain token totals, the sum over documents of r * tokens * posterior, match the targets:
the least squares of the totals' errors, plus RIDGE times the squares of rates less 1 weighed by tokens, which makes the
rates unique. Projected gradient with lazy projection: a document's gradient is its posterior times the domains'
errors, so the steps so far add up to one number a domain, the pressures u, and projection makes the rate
max(0, 1 - posterior * u). A step is one distributed sum of the totals and the posteriors' second moments over the
documents whose rates are free; it is scaled by the inverse of the latter and halved where it doesn't descend. It ends
when the gradient is below TOLERANCE of the tokens, which a few steps reach; if they don't, fit_rates raises.

Domains come from the labels: `toxic`, or else `good` or `plain` by quality. The fit takes at most `bound` labelled
rows (a documented parameter), by least hash, with their whole texts; prediction and fitting of rates cover all rows.
Defined results: a null or empty text has no tokens and rate 1, for it weighs nothing; null labels and labels of
unknown documents are ignored; several labels of a document count as several; without labels every document is `plain`;
repeated rows get one rate each, that of their own text; a domain without expected tokens can't be raised; other
columns are ignored by op8 and kept by mix_documents, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_slices, texts_of
from .hashing import span_hashes

DOMAINS = ("good", "plain", "toxic")
#: Shares of the expected tokens after mixing.
TARGETS = {"good": 0.6, "plain": 0.4, "toxic": 0.0}
FEATURES = 1 << 15
#: Labelled rows that the classifier is fitted on, at most.
BOUND = 6000
RIDGE, MIX_RIDGE, TOLERANCE, STEPS = 1e-5, 1e-3, 1e-9, 200
SCALE = 4.0


class Classifier(NamedTuple):
    weights: np.ndarray  # FEATURES + 1 x domains


def slot(word: str) -> int:
    """The feature of a lower-cased word, or of a share's stair."""
    tape = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint8)
    return int(span_hashes(tape, np.zeros(1, np.int64), np.array([len(tape)]))[0] % FEATURES)


#: Shares that become features, each a stair of ten steps, so that a linear model can bend.
SHARES = ("letters", "marks", "capitals", "distinct", "long", "short")
STAIRS = np.array([[slot(f"#{name}{step}") for step in range(1, 11)] for name in SHARES])
# what a character is: of a word, of a run of marks, a letter, a capital, a small letter
IN_WORD, IN_MARKS, LETTER, CAPITAL, SMALL = 1, 2, 4, 8, 16


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]])]


class Signals:
    """Words and features of texts, many texts at a time: words are runs of word characters, or of marks."""

    def __init__(self):
        every = [chr(c) for c in range(0x110000)]
        self.lower = np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in every], "<u4")
        word = lambda c: c.isalnum() or c == "_"
        self.kind = np.array([word(c) * IN_WORD + (not word(c) and not c.isspace()) * IN_MARKS + c.isalpha() * LETTER + c.isupper() * CAPITAL + c.islower() * SMALL for c in every], np.uint8)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text; and all features as (text, slot) pairs, sorted and distinct: presence of lower-cased
        words, and stairs of the shares of letters, marks, capitals and distinct words and of the length."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        tape = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        kind = self.kind[tape]
        run = kind & (IN_WORD | IN_MARKS)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], run, [0]]).astype(np.int8)))
        edge = np.concatenate([[0], edge]) if not len(edge) or edge[0] else edge
        starts, lens = edge[:-1], np.diff(edge)
        solid = run[starts] > 0 if len(tape) else np.zeros(0, bool)
        starts, lens = starts[solid], lens[solid]
        owner = np.searchsorted(np.cumsum(sizes), starts, "right")
        n = np.bincount(owner, minlength=len(texts))
        some = np.flatnonzero(n)
        size = n[some]
        share = np.zeros((len(some), len(SHARES)))
        if len(some):
            seen = np.concatenate([np.zeros((1, 3), np.int32), np.cumsum(np.stack([kind & LETTER > 0, kind & CAPITAL > 0, kind & SMALL > 0], 1), axis=0, dtype=np.int32)])
            letters, capitals, small = (seen[starts + lens] - seen[starts]).T
            marks = run[starts] == IN_MARKS
            marks |= tape[starts] == ord("_")
            each = np.stack([letters == lens, marks, (capitals > 0) & (small == 0) & (lens > 1)], 1)
            share[:, :3] = np.add.reduceat(each.astype(np.int32), (np.cumsum(n) - n)[some], axis=0) / size[:, None]
        word = span_hashes(tape.view(np.uint8), 4 * starts, 4 * lens)
        share[:, 3] = np.bincount(distinct((owner.astype(np.uint64) << np.uint64(44)) | (word >> np.uint64(20))) >> np.uint64(44), minlength=len(n))[some] / size
        share[:, 4], share[:, 5] = np.minimum(1.0, size / 1000), size < 30
        slots = (span_hashes(self.lower[tape].view(np.uint8), 4 * starts, 4 * lens) % np.uint64(FEATURES)).astype(np.int64)
        row, which, step = np.nonzero(share[:, :, None] >= np.arange(1, 11) / 10)
        keys = distinct(np.concatenate([owner * FEATURES + slots, some[row] * FEATURES + STAIRS[which, step]]))
        return n, keys // FEATURES, keys % FEATURES


_signals: list[Signals] = []


def signals(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signals of a worker's one instance."""
    if not _signals:
        _signals.append(Signals())
    return _signals[0](texts)


def fit_classifier(rows: list[tuple[np.ndarray, int]], domains: int, rounds: int = 12, seed: int = 3) -> Classifier:
    """Multinomial logistic regression by AdaGrad on (features, domain) rows; those without features are left out."""
    rng = np.random.default_rng(seed)
    data = [(np.append(f.astype(np.int64), FEATURES), y) for f, y in rows if len(f)]
    # each feature counts by its log odds between a domain and the rest, so that rare noise weighs little
    there = np.ones((FEATURES + 1, domains))
    for f, y in data:
        there[f, y] += 1
    size = np.array([sum(y == d for _, y in data) for d in range(domains)]) + 2.0
    rest, rest_size = there.sum(1, keepdims=True) - there - domains + 2, size.sum() - size
    odds = np.log(there / size) - np.log(rest / rest_size)
    odds[(there.sum(1) - domains) < 3] = 0
    odds[FEATURES] = 1
    weights, g = np.zeros((FEATURES + 1, domains)), np.full((FEATURES + 1, domains), 1e-1)
    for _ in range(rounds):
        order = rng.permutation(len(data))
        for lo in range(0, len(order), 32):
            part = [data[i] for i in order[lo : lo + 32]]
            sizes = np.array([len(f) for f, _ in part])
            flat = np.concatenate([f for f, _ in part])
            score = np.add.reduceat(weights[flat] * odds[flat], np.cumsum(sizes) - sizes, axis=0) / SCALE
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            wrong = (np.eye(domains)[[y for _, y in part]] - p) / SCALE
            spread = np.repeat(wrong, sizes, axis=0) * odds[flat]
            touched, where = np.unique(flat, return_inverse=True)
            step = np.stack([np.bincount(where, spread[:, j], len(touched)) for j in range(domains)], 1) - 1e-4 * weights[touched]
            g[touched] += step**2
            weights[touched] += 0.5 * step / np.sqrt(g[touched])
    return Classifier(weights * odds)


def posteriors(model: Classifier, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and its posterior over the domains."""
    n, owner, slots = signals(texts)
    score = np.tile(model.weights[FEATURES], (len(n), 1))
    for d in range(score.shape[1]):
        score[:, d] += np.bincount(owner, model.weights[slots, d], len(n))
    p = np.exp((score - score.max(1, keepdims=True)) / SCALE)
    return n, p / p.sum(1, keepdims=True)


def train(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> Classifier:
    """From labels (doc_id, quality, toxic) joined to their documents' texts; the features come to the driver, not texts."""
    known = labels.where("doc_id is not null and toxic is not null and (toxic = 1 or quality is not null)").select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("toxic") == 1, 2).otherwise(F.when(F.col("quality") == 1, 0).otherwise(1)).alias("domain"))
    share = min(1.0, 1.2 * bound / max(1, known.count()))
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = texts_of(docs).join(picked, "doc_id").select(F.struct("doc_id", "domain").alias("key"), "text")

    def run(keys, texts):
        n, owner, slots = signals(texts)
        found = np.split(slots.astype("<u2"), np.cumsum(np.bincount(owner, minlength=len(n)))[:-1])
        return {"doc_id": [k["doc_id"] for k in keys], "domain": [k["domain"] for k in keys], "slots": [f.tobytes() for f in found]}

    found = map_slices(texts, run, "doc_id long, domain int, slots binary")
    rows = found.orderBy(F.xxhash64("doc_id", "domain"), "doc_id", "domain", "slots").limit(bound).collect()  # at most bound rows of at most FEATURES slots
    rows = [(np.frombuffer(r.slots, "<u2"), r.domain) for r in rows]
    if not any(len(f) for f, _ in rows):
        weights = np.zeros((FEATURES + 1, len(DOMAINS)))
        weights[FEATURES, 1] = 50.0
        return Classifier(weights)
    return fit_classifier(rows, len(DOMAINS))


def memberships(docs: DataFrame, model: Classifier, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, tokens, p_<domain>...) of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x domains floats, whatever the corpus

    def run(ids, texts):
        n, p = posteriors(shipped.value, texts)
        return {"doc_id": ids, "tokens": n} | {f"p_{d}": p[:, i] for i, d in enumerate(DOMAINS)}

    return map_slices(texts_of(docs, id_col), run, "doc_id long, tokens long, " + ", ".join(f"p_{d} double" for d in DOMAINS), 1024)


def rate(pressures: list[float]) -> Column:
    """A document's rate under the domains' pressures."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - sum((F.col(f"p_{d}") * F.lit(float(u)) for d, u in zip(DOMAINS, pressures, strict=True)), F.lit(0.0)))


def fit_rates(members: DataFrame, targets: dict[str, float] | None = None, total: float | None = None, ridge: float = RIDGE) -> tuple[Column, dict]:
    """The rate column over members, and what it reaches.

    targets are shares; total is the tokens to reach, by default as many as come in.
    """
    goal = targets or TARGETS
    k = len(DOMAINS)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    p = [F.col(f"p_{d}") for d in DOMAINS]
    tokens = float(members.agg(F.coalesce(F.sum("tokens"), F.lit(0))).head()[0])
    if tokens == 0:
        return F.lit(1.0), {"steps": 0, "gradient": 0.0, "reached": {}}
    want = np.array([goal.get(d, 0.0) for d in DOMAINS]) * (total or tokens) / tokens

    def look(u: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Under pressures u: the convex function that the steps descend, its gradient, the totals and the free moments."""
        r = rate(u.tolist())
        t = F.col("tokens").cast("double")
        free = F.when(F.col("r") > 0, t).otherwise(F.lit(0.0))
        sums = [F.sum(t * F.col("r") * F.col("r")), *[F.sum(t * F.col("r") * x) for x in p], *[F.sum(free * p[i] * p[j]) for i, j in pairs]]
        got = np.array(members.select("tokens", *p, r.alias("r")).agg(*sums).head(), float) / tokens
        moment = np.zeros((k, k))
        for (i, j), x in zip(pairs, got[1 + k :], strict=True):
            moment[i, j] = moment[j, i] = x
        value = got[0] / 2 + want @ u + ridge * u @ u / 2
        return value, want + ridge * u - got[1 : 1 + k], got[1 : 1 + k], moment

    u = np.zeros(k)
    value, slope, reached, moment = look(u)
    steps = 1
    while np.abs(slope).max() > TOLERANCE:
        way = -np.linalg.solve(moment + ridge * np.eye(k), slope)
        size = 1.0
        while True:
            tried = look(u + size * way)
            steps += 1
            if tried[0] <= value + 1e-4 * size * (slope @ way) or np.abs(tried[1]).max() <= TOLERANCE:
                break
            size /= 2
            if steps > STEPS:
                raise ArithmeticError(f"the rates are not settled after {steps} sums: gradient {np.abs(slope).max()}")
        u = u + size * way
        value, slope, reached, moment = tried
    named = lambda x: dict(zip(DOMAINS, x.tolist(), strict=True))
    return rate(u.tolist()), {"steps": steps, "gradient": float(np.abs(slope).max()), "pressures": named(u), "reached": named(reached), "wanted": named(want)}


def copies(r: Column, key: str = "doc_id") -> Column:
    """Whole copies for a rate: its floor, and one more for a share of the keys equal to the rest, by hash."""
    u = F.pmod(F.xxhash64(F.lit("mix"), key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(r) + (u < r - F.floor(r)).cast("long")).cast("long")


def mix_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, keep: str = "good", at_least: float = 1.1, ridge: float = MIX_RIDGE) -> DataFrame:
    """Rows of docs, as often as their rates say. The total is set so that the domain `keep` grows by the factor at_least;
    the ridge is large enough for the rates of that domain's documents to stay over 1 though all have a little of others.

    Rows are told apart by their place, so docs must be read alike each time, as files and checkpoints are.
    """
    goal = targets or TARGETS
    names = docs.columns
    row = "_row" + "_" * max(map(len, names))  # longer than any column's name
    placed = docs.withColumn(row, F.monotonically_increasing_id())
    members = cut(memberships(placed, train(docs, labels), row))
    held = members.agg(F.sum(F.col("tokens") * F.col(f"p_{keep}"))).head()[0] or 0.0
    r, _ = fit_rates(members, goal, total=at_least * held / goal[keep] if held else None, ridge=ridge)
    counts = members.select(F.col("doc_id").alias(row), F.when(F.col("tokens") == 0, 1).otherwise(copies(r)).cast("int").alias(f"{row}n")).where(F.col(f"{row}n") > 0)
    joined = placed.join(counts, row).withColumn(f"{row}c", F.explode(F.sequence(F.lit(1), F.col(f"{row}n"))))
    return joined.select(*[F.col(f"`{c}`") for c in names])


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op8: (doc_id, tokens, p_<domain>..., rate, copies, off_target) of every document.

    off_target, the same in all rows, is the greatest distance of a domain's expected share from its target.
    """
    members = cut(memberships(docs, train(docs, labels)))
    r, info = fit_rates(members)
    off = max((abs(info["reached"][d] - info["wanted"][d]) for d in info["reached"]), default=0.0)
    return members.withColumn("rate", r).withColumn("off_target", F.lit(off)).withColumn("copies", F.when(F.col("tokens") == 0, 1).otherwise(copies(F.col("rate"))).cast("long"))
