"""Toxicity by a factorisation machine over hashed terms.

The score of a document is b + sum(w_i) + sum over pairs of <v_i, v_j> over the distinct terms that it
holds, so that terms that are harmless alone can count together. Terms are words hashed to BUCKETS
buckets. The fit is over those that tell toxic from other labelled documents alone, by the difference of
their shares, or in a pair, by the difference of the covariances of any two terms; the others carry weight 0.

Defined results: null and empty texts hold no term and score b; without labelled rows of both kinds no
document is toxic. A term counts once however often it is repeated, copies score alike, and columns
other than doc_id and text aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lakemill.llm import kernel
from lakemill.llm.frames import TRAIN_ROWS, by_chunk, labelled, lists

BUCKETS, FACTORS = 1 << 20, 4
#: Documents that a term is in at least, and toxic ones if it is looked at in pairs; standard errors that a difference has to exceed.
LEAST, PAIRED, ALONE, TOGETHER = 4, 10, 5.0, 12.0
EPOCHS, RATE, DECAY = 150, 0.05, 2e-4


def terms(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term buckets of every document and their offsets; only those marked in ``wanted``, if given."""
    w = kernel.words(texts)
    n = len(w.first) - 1
    bucket = (w.hashes & np.uint64(BUCKETS - 1)).astype(np.int64)
    doc = np.repeat(np.arange(n), np.diff(w.first))
    if wanted is not None:
        hit = wanted[bucket]
        bucket, doc = bucket[hit], doc[hit]
    both = np.unique(doc * BUCKETS + bucket)
    return (both & (BUCKETS - 1)).astype(np.int32), np.searchsorted(both, np.arange(n + 1) * BUCKETS)


@dataclass
class Machine:
    """Weights of the chosen terms by place; ``place`` gives a bucket's place, or -1."""

    chosen: np.ndarray
    w: np.ndarray
    v: np.ndarray
    base: float
    threshold: float

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        place = np.full(BUCKETS, -1, np.int32)
        place[self.chosen] = np.arange(len(self.chosen))
        return place, place >= 0

    def score(self, at: np.ndarray, first: np.ndarray) -> np.ndarray:
        n = len(first) - 1
        doc = np.repeat(np.arange(n), np.diff(first))
        out = self.base + np.bincount(doc, self.w[at], n)
        for f in range(self.v.shape[1]):
            x = self.v[at, f]
            out += 0.5 * (np.bincount(doc, x, n) ** 2 - np.bincount(doc, x * x, n))
        return out


def paired(buckets: np.ndarray, doc: np.ndarray, terms: np.ndarray, y: np.ndarray, step: int = 1024, wide: int = 768) -> np.ndarray:
    """Which of the terms occur with some other otherwise in toxic documents than in the rest, each one's own share apart."""
    place = np.full(BUCKETS, -1)
    place[terms] = np.arange(len(terms))
    at = place[buckets]
    doc, at = doc[at >= 0], at[at >= 0]
    told = np.zeros(len(terms), bool)
    used = np.unique(doc)
    toxic = y[used] == 1
    sides = [used[toxic], used[~toxic]]
    share = [np.bincount(at[y[doc] == k], minlength=len(terms)) / max(len(d), 1) for k, d in ((1, sides[0]), (0, sides[1]))]
    row = np.searchsorted(used, doc)
    edge = np.searchsorted(row, np.arange(0, len(used) + step, step))
    for a in range(0, len(terms), wide):
        here = min(wide, len(terms) - a)
        both = [np.zeros((here, len(terms)), np.float32) for _ in sides]
        for i, (p, q) in enumerate(zip(edge, edge[1:], strict=False)):
            x = np.zeros((min(step, len(used) - i * step), len(terms)), np.float32)
            x[row[p:q] - i * step, at[p:q]] = 1
            for k, side in ((0, toxic), (1, ~toxic)):
                own = x[side[i * step : i * step + step]]
                both[k] += own[:, a : a + here].T @ own
        differ, error = np.zeros_like(both[0]), np.full(both[0].shape, 1e-12, np.float32)
        for k, sign in ((0, 1), (1, -1)):
            n, p, q = max(len(sides[k]), 1), share[k][a : a + here, None].astype(np.float32), share[k][None].astype(np.float32)
            differ += sign * (both[k] / n - p * q)
            error += (p * (1 - p) + 1 / n) * (q * (1 - q) + 1 / n) / n
        far = np.abs(differ) > TOGETHER * np.sqrt(error)
        far[np.arange(here), a + np.arange(here)] = False
        told[a : a + here] |= far.any(axis=1)
    return told


def fit(buckets: np.ndarray, first: np.ndarray, y: np.ndarray) -> Machine:
    """Fits on four fifths of the rows; the threshold is the middle of those with the best F1 on the rest."""
    none = Machine(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)), -50.0, np.inf)
    if len(y) < 20 or y.min() == y.max():
        return none
    n = len(y)
    doc = np.repeat(np.arange(n), np.diff(first))
    held = np.arange(n) % 5 == 4
    train = ~held[doc]
    pos, neg = (np.bincount(buckets[train & (y[doc] == k)], minlength=BUCKETS) for k in (1, 0))
    np_, nn = max((~held & (y == 1)).sum(), 1), max((~held & (y == 0)).sum(), 1)
    share = (pos + neg + 1) / (np_ + nn + 2)
    z = (pos / np_ - neg / nn) / np.sqrt(share * (1 - share) * (1 / np_ + 1 / nn))
    z[pos + neg < LEAST] = 0
    told = np.abs(z) > ALONE
    common = np.flatnonzero((pos >= PAIRED) & (neg >= PAIRED))
    told[common[paired(buckets[train], doc[train], common, y)]] = True
    chosen = np.flatnonzero(told)
    if not len(chosen):
        return none
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    at = place[buckets]
    row, at = doc[at >= 0], at[at >= 0]
    rng = np.random.default_rng(7)
    m = Machine(chosen, np.zeros(len(chosen)), rng.normal(0, 0.05, (len(chosen), FACTORS)), float(np.log(np_ / nn)), 0.0)
    r, a = row[~held[row]], at[~held[row]]
    weight = np.where(y == 1, (np_ + nn) / (2 * np_), (np_ + nn) / (2 * nn)) * ~held
    state = [np.zeros_like(m.w), np.zeros_like(m.w), np.zeros_like(m.v), np.zeros_like(m.v)]
    for t in range(1, EPOCHS + 1):
        sums = np.stack([np.bincount(r, m.v[a, f], n) for f in range(FACTORS)], axis=1)
        squares = np.bincount(r, (m.v[a] ** 2).sum(1), n)
        s = m.base + np.bincount(r, m.w[a], n) + 0.5 * ((sums**2).sum(1) - squares)
        g = weight * (1 / (1 + np.exp(-np.clip(s, -50, 50))) - y) / (np_ + nn)
        gw = np.bincount(a, g[r], len(m.w)) + DECAY * m.w
        gv = np.stack([np.bincount(a, g[r] * (sums[r, f] - m.v[a, f]), len(m.w)) for f in range(FACTORS)], axis=1) + DECAY * m.v
        m.base -= RATE * float(g.sum())
        for x, d, i in ((m.w, gw, 0), (m.v, gv, 2)):
            state[i] = 0.9 * state[i] + 0.1 * d
            state[i + 1] = 0.999 * state[i + 1] + 0.001 * d * d
            x -= RATE * (state[i] / (1 - 0.9**t)) / (np.sqrt(state[i + 1] / (1 - 0.999**t)) + 1e-8)
    first_of = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
    s, truth = m.score(at, first_of)[held], y[held]
    grid = np.unique(s)
    grid = (grid[1:] + grid[:-1]) / 2 if len(grid) > 1 else grid
    order = np.sort(s[truth == 1])
    every = np.sort(s)
    tp = len(order) - np.searchsorted(order, grid)
    f1 = 2 * tp / np.maximum(len(every) - np.searchsorted(every, grid) + len(order), 1)
    best = grid[f1 >= f1.max() - 1e-12]
    m.threshold = float(best[len(best) // 2])
    return m


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> Machine:
    """Fits on at most ``bound`` labelled documents."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        b, first = terms(batch.column("text"))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), lists(b, first, pa.int32())], ["doc_id", "y", "terms"])

    rows = by_chunk(labelled(docs, labels, "toxic", bound).select("doc_id", "y", "text"), run, "doc_id bigint, y int, terms array<int>").toArrow().sort_by("doc_id")
    if not rows.num_rows:
        return fit(np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64))
    chosen = rows["terms"].combine_chunks()
    sizes = chosen.value_lengths().to_numpy()
    return fit(chosen.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)]), rows["y"].to_numpy())


def score(docs: DataFrame, model: Machine) -> DataFrame:
    """(doc_id, score, toxic) of every document: the log odds, and the decision."""

    def run(batch: pa.RecordBatch, kept: list = []) -> pa.RecordBatch:  # noqa: B006
        if not kept:
            kept.append(model.table())
        place, wanted = kept[0]
        b, first = terms(batch.column("text"), wanted)
        s = model.score(place[b], first)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array(s >= model.threshold)], ["doc_id", "score", "toxic"])

    return by_chunk(docs.select("doc_id", "text"), run, "doc_id bigint, score double, toxic boolean")
