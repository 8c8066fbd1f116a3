"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts and an unlabelled sample of the corpus train a linear classifier in numpy.  Features
are byte n-grams that may cross word edges, hashed, so that a stem teaches its unseen forms; a text's value of
one is its count over the square root of the text's words, so that chance hits in long texts weigh no
more than in short ones.  Gradient steps lower
  prior * E_pos[l(z)] + max(0, E_unl[l(-z)] - prior * E_pos[l(-z)])
with the logistic loss; where the second part falls below zero, the step raises it instead.

The class prior is estimated on the corpus, never taken from the labels' share: two halves of the sample score
each other, and the prior is the least share of unlabelled over positive texts above a threshold.  The same
halves choose the shrinkage and the score that counts as 0.5, by the estimated risk of a wrong verdict.
Labels of non-toxic texts are not used at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwarden.llm.runtime import bound_batches, materialize, plain_words, text_of

BITS = 20
SIZES = (4, 5, 6, 7)
DAMP = 16
_BLOCK = 1 << 20
SHRINKS = (1e-5, 1e-4, 1e-3)


def grams(text: str) -> tuple[Iterator[np.ndarray], int]:
    """(hashed n-grams of the whole text in blocks of bounded size, number of words)."""
    words = plain_words(text)
    joined = b" " + b" ".join(words) + b" "

    def blocks() -> Iterator[np.ndarray]:
        most = max(SIZES)
        for at in range(0, len(joined), _BLOCK):
            part = np.frombuffer(joined[at : at + _BLOCK + most - 1], np.uint8).astype(np.uint32)
            h = part
            for k in range(2, most + 1):
                if len(part) < k:
                    break
                h = h[:-1] * np.uint32(0x01000193) ^ part[k - 1 :]
                if k in SIZES:
                    x = h[:_BLOCK] * np.uint32(0x9E3779B1)
                    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA77)
                    yield (x >> np.uint32(32 - BITS)).astype(np.int32)

    return blocks(), len(words)


@dataclass
class Model:
    """weights of all buckets (zero for those not chosen) and a bias."""

    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        found, n = grams(text)
        z = sum(float(self.weights[x].sum(dtype=np.float64)) for x in found) / np.sqrt(n + DAMP) + self.bias
        return float(_logistic(z))


def _logistic(v):
    return 1 / (1 + np.exp(-np.clip(v, -40, 40)))


def fold(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 5


class Rows:
    """Sparse rows: feature, row and value of each entry."""

    def __init__(self, feature: np.ndarray, row: np.ndarray, value: np.ndarray, n: int):
        self.feature, self.row, self.value, self.n = feature, row, value, n

    def pick(self, chosen: np.ndarray, columns: np.ndarray, width: int) -> Rows:
        """The chosen rows (a mask), with only the given columns, in their order."""
        slot, place = np.full(width, -1), np.cumsum(chosen) - 1
        slot[columns] = np.arange(len(columns))
        keep = chosen[self.row] & (slot[self.feature] >= 0)
        return Rows(slot[self.feature[keep]], place[self.row[keep]], self.value[keep], int(chosen.sum()))

    def score(self, w: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(self.row, w[self.feature] * self.value, self.n) + b

    def pull(self, per_row: np.ndarray, width: int) -> np.ndarray:
        return np.r_[np.bincount(self.feature, per_row[self.row] * self.value, width), per_row.sum()] / self.n


def train(pos: Rows, unl: Rows, width: int, prior: float, shrink: float, rounds: int = 120, step: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam steps on the non-negative risk."""
    w, b = np.zeros(width), float(np.log(prior / (1 - prior)))
    mean, square = np.zeros(width + 1), np.zeros(width + 1)
    for turn in range(1, rounds + 1):
        zp, zu = pos.score(w, b), unl.score(w, b)
        sp, su = _logistic(zp), _logistic(zu)
        rest = unl.pull(su, width) - prior * pos.pull(sp, width)  # of what must not fall below zero
        risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        grad = -rest if risk < 0 else rest - prior * pos.pull(1 - sp, width)
        grad[:-1] += shrink * w
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        move = step * (mean / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.999**turn)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def corpus_prior(pos: np.ndarray, unl: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled, from held-back scores: at the threshold where the bound on it is
    least, the share of unlabelled texts above over that of positives."""
    t = np.sort(pos)[::-1]
    above_p = np.arange(1, len(t) + 1) / len(t)
    above_u = 1 - np.searchsorted(np.sort(unl), t) / len(unl)
    error = np.sqrt(np.log(4 / delta) / 2) * (len(unl) ** -0.5 + len(pos) ** -0.5)
    best = np.argmin((above_u + error) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 1 / (1 + len(unl)), 0.5))


def _cut(pos: np.ndarray, unl: np.ndarray, prior: float) -> tuple[float, float]:
    """(least estimated share of wrong verdicts, the score above which a text is taken for toxic)."""
    t = np.unique(np.r_[pos, unl])
    if len(t) < 2:
        return prior, float(t[-1]) + 1.0
    t = (t[1:] + t[:-1]) / 2
    above_p = 1 - np.searchsorted(np.sort(pos), t) / len(pos)
    above_u = 1 - np.searchsorted(np.sort(unl), t) / len(unl)
    risk = prior * (1 - above_p) + np.maximum(0, above_u - prior * above_p)
    good = t[risk <= risk.min() + 1e-9]
    return round(float(risk.min()), 6), float((good[0] + good[-1]) / 2)


def learn(pos: Rows, unl: Rows, pos_half: np.ndarray, unl_half: np.ndarray, columns: list[np.ndarray], width: int) -> tuple[np.ndarray, float, float]:
    """(weights of columns[2], bias, prior): columns are the features chosen on either half and on all."""
    every = lambda x: np.ones(x.n, bool)
    parts = [[x.pick(half == (f ^ other), columns[f], width) for other in (0, 1) for x, half in ((pos, pos_half), (unl, unl_half))] for f in (0, 1)]
    held_p, held_u = np.zeros(pos.n), np.zeros(unl.n)

    def crossed(prior: float, shrink: float) -> None:
        for f, (p, u, other_p, other_u) in enumerate(parts):
            w, b = train(p, u, len(columns[f]), prior, shrink) if p.n and u.n else (np.zeros(len(columns[f])), 0.0)
            held_p[pos_half != f], held_u[unl_half != f] = other_p.score(w, b), other_u.score(w, b)

    crossed(0.5, 1e-3)
    prior = corpus_prior(held_p, held_u)
    best = None
    for shrink in SHRINKS:
        crossed(prior, shrink)
        risk, cut = _cut(held_p, held_u, prior)
        if best is None or risk < best[0]:
            best = (risk, shrink, cut)
    w, b = train(pos.pick(every(pos), columns[2], width), unl.pick(every(unl), columns[2], width), len(columns[2]), prior, best[1])
    return w, b - best[2], prior


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most_pos: int = 4000, most_unl: int = 8000, most: int = 2048, least_z: float = 4.0, least_docs: int = 3) -> Model:
    """Learn from rows whose fold isn't 0: about most_pos confirmed positives and most_unl unlabelled documents
    at most, those of the smallest hashes of the key.  The sample is written once; what reaches the driver is each
    sampled row's counts of the `most` features chosen on it (and an eighth as many that speak against).

    Null keys and labels teach nothing; texts that repeat count once; a key labelled twice is positive if either
    label is.  Without a positive or an unlabelled text, and for an empty table, the model gives every text 0.05.
    """
    spark = df.sparkSession
    bound_batches(spark)
    known = labels.where(F.col(key).isNotNull() & (F.col(label) == 1) & (fold(F.col(key)) != 0)).select(F.col(key).alias("k")).distinct()
    positive = known.orderBy(F.xxhash64("k"), "k").limit(most_pos).withColumn("p", F.lit(1))
    docs = df.where(F.col(key).isNotNull() & (fold(F.col(key)) != 0)).select(F.col(key).alias("k"), text_of(text).alias("t"))
    rate = min(1.0, 1.25 * most_unl / max(1, df.count()))  # four fifths of the rows are in these folds
    drawn = F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int(rate * (1 << 30))
    both = docs.join(F.broadcast(positive), "k", "left")  # most_pos rows
    rows = both.withColumn("u", drawn.cast("int")).where("p = 1 or u = 1").select("k", "t", F.coalesce("p", F.lit(0)).alias("p"), "u")
    rows = rows.groupBy(F.xxhash64("t").alias("h")).agg(F.max_by(F.struct("k", "t"), "k").alias("x"), F.max("p").alias("p"), F.max("u").alias("u"))
    sample = materialize(rows.select("x.k", "x.t", "p", "u", F.pmod(F.xxhash64("h"), F.lit(2)).cast("int").alias("half")), "tox-sample")
    n = {(r["half"], s): r[s] for r in sample.groupBy("half").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).collect() for s in "pu"}
    n = {s: [n.get((0, s), 0), n.get((1, s), 0)] for s in "pu"}
    nothing = Model(np.zeros(1 << BITS, np.float32), float(np.log(0.05 / 0.95)))
    if not sum(n["p"]) or not sum(n["u"]):
        return nothing

    def present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((4, 1 << BITS), np.int32)
        for batch in batches:
            for t, p, u, half in zip(batch["t"], batch["p"], batch["u"], batch["half"], strict=True):
                found = np.unique(np.concatenate([np.zeros(0, np.int32), *map(np.unique, grams(t)[0])]))
                if p:
                    seen[half, found] += 1
                if u:
                    seen[2 + half, found] += 1
        some = np.flatnonzero(seen.any(axis=0))
        for at in range(0, len(some), 50_000):
            part = some[at : at + 50_000]
            yield pd.DataFrame({"b": part, **{c: seen[i, part] for i, c in enumerate(("p0", "p1", "u0", "u1"))}})

    dealt = sample.repartition(8, "k")  # each partition gives a row for each bucket at most
    counts = dealt.mapInPandas(present, "b int, p0 int, p1 int, u0 int, u1 int").groupBy("b").agg(*(F.sum(c).alias(c) for c in ("p0", "p1", "u0", "u1")))
    counts = materialize(counts, "tox-counts")

    def chosen(p: Column, u: Column, n_p: int, n_u: int) -> list[int]:
        if not n_p or not n_u:
            return []
        pooled = (p + u + 1) / (n_p + n_u + 2)
        z = (p / n_p - u / n_u) / F.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u))
        ranked = counts.select("b", z.alias("z"), p.alias("p"))
        for_ = ranked.where((F.col("z") > least_z) & (F.col("p") >= least_docs)).orderBy(F.desc("z"), "b").limit(most)
        against = ranked.where(F.col("z") < -least_z).orderBy("z", "b").limit(most // 8)
        return [r["b"] for r in for_.union(against).select("b").collect()]

    c = F.col
    picked = [chosen(c(f"p{f}"), c(f"u{f}"), n["p"][f], n["u"][f]) for f in (0, 1)] + [chosen(c("p0") + c("p1"), c("u0") + c("u1"), sum(n["p"]), sum(n["u"]))]
    if not picked[2]:
        return nothing
    used = sorted({b for x in picked for b in x})
    slot = {b: i for i, b in enumerate(used)}
    table = np.full(1 << BITS, -1, np.int32)
    table[used] = np.arange(len(used))
    shared = spark.sparkContext.broadcast(table)

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots = shared.value
        for batch in batches:
            out = []
            for t in batch["t"]:
                blocks, words = grams(t)
                count = np.zeros(len(used), np.int64)
                for x in blocks:
                    s = slots[x]
                    count += np.bincount(s[s >= 0], minlength=len(used))
                at = np.flatnonzero(count)
                out.append((at.astype(np.int32).tobytes(), (count[at] / np.sqrt(words + DAMP)).astype(np.float32).tobytes()))
            yield pd.DataFrame({**{x: batch[x] for x in ("k", "p", "u", "half")}, "at": [a for a, _ in out], "value": [v for _, v in out]})

    kind = sample.schema["k"].dataType.simpleString()
    found = sample.mapInPandas(entries, f"k {kind}, p int, u int, half int, at binary, value binary").orderBy(F.xxhash64("k"), "k").toPandas()

    def packed(part: pd.DataFrame) -> Rows:
        at, value = [np.frombuffer(x, np.int32) for x in part["at"]], [np.frombuffer(x, np.float32) for x in part["value"]]
        return Rows(np.concatenate(at).astype(np.int64), np.repeat(np.arange(len(part)), [len(x) for x in at]), np.concatenate(value).astype(float), len(part))

    pos, unl = found[found["p"] == 1], found[found["u"] == 1]
    columns = [np.array([slot[b] for b in x], np.int64) for x in picked]
    w, bias, _ = learn(packed(pos), packed(unl), pos["half"].to_numpy(), unl["half"].to_numpy(), columns, len(used))
    weights = np.zeros(1 << BITS, np.float32)
    weights[np.array(picked[2])] = w
    return Model(weights, float(bias))


def score(df: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """df with `out`, the probability that the whole text is toxic.  Null texts count as empty; those and
    texts without a known n-gram get the score of the bias.  Repeated rows score alike; an empty table stays
    empty; a column named `out` is replaced; nothing but the text enters the score."""
    spark = df.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # 2 ** BITS weights whatever the input's size

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return df.withColumn(out, scores(text_of(text)))
