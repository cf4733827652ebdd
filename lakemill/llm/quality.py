"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting fits shallow trees to one feature at a time, then to pairs of features; every tree is
added to a lookup table over the feature's bins, so that a score is a sum of table entries.

Defined results: null and empty texts have features of 0 and are scored like any other; without
labelled rows of both kinds every document is kept with score 1. Repeated rows score alike, and other
columns pass through unread.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lakemill.llm import kernel
from lakemill.llm.frames import TRAIN_ROWS, by_chunk, labelled, lists

FEATURES = (
    "words", "word_bytes", "symbols", "upper", "digits", "distinct", "top_word", "echo", "lines", "stops",
    "doubled", "wide", "bars", "grams", "repeated_lines", "sentence_words",
)
BINS, ROUNDS, PAIRS, PAIR_ROUNDS, RATE = 32, 60, 8, 25, 0.25
#: Share of the good held-out documents that the threshold has to keep.
KEEP_RECALL = 0.995


def _sums(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return np.diff(total[off])


def _per_doc(keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every document the number of distinct keys and the count of the most frequent one."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    distinct, top = np.zeros(n), np.zeros(n)
    if len(keys):
        both = np.sort(kernel.mix(keys ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(20) | doc.astype(np.uint64) << np.uint64(44))
        new = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        count, owner = np.diff(np.append(new, len(both))), (both[new] >> np.uint64(44)).astype(np.int64)
        distinct = np.bincount(owner, minlength=n).astype(float)
        np.maximum.at(top, owner, count)
    return distinct, top


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text."""
    raw, off = kernel.buffers(texts)
    w = kernel.words(texts)
    n = len(off) - 1
    size, words = np.maximum(np.diff(off), 1.0), np.diff(w.first).astype(float)
    some = np.maximum(words, 1.0)
    kind = _KIND[raw]
    at = lambda bit: _sums((kind & bit) > 0, off)
    letters = np.maximum(at(1) + at(2), 1.0)
    symbol = (kind & 8) > 0
    doubled = np.zeros(len(raw), bool)
    doubled[1:] = symbol[1:] & (raw[1:] == raw[:-1])
    length = (w.end - w.start).astype(float)
    total = np.concatenate([[0.0], np.cumsum(length)])
    distinct, top = _per_doc(w.hashes, w.first)
    grams, gfirst = kernel.grams(w, 3)
    gdistinct, _ = _per_doc(grams, gfirst)
    same = np.zeros(len(w.hashes), bool)
    same[1:] = w.hashes[1:] == w.hashes[:-1]
    s, e, lfirst = kernel.runs(raw != 10, off)
    fwd, inv = kernel._POWERS.get(len(raw))
    run = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw + np.uint64(1)) * fwd[: len(raw)], out=run[1:])
    ldistinct, _ = _per_doc(kernel.mix((run[e] - run[s]) * inv[s] + (e - s).astype(np.uint64)), lfirst)
    lines = np.maximum(np.diff(lfirst), 1)
    ends = np.maximum(at(16), 1)
    out = np.empty((n, len(FEATURES)))
    for j, x in enumerate((
        np.log1p(words), np.diff(total[w.first]) / some, at(8) / size, at(2) / letters, at(4) / size, distinct / some, top / some,
        _sums(same, w.first) / some, lines / some, at(16) / some, _sums(doubled, off) / size, at(32) / size, _sums(raw == 124, off) / some,
        gdistinct / np.maximum(np.diff(gfirst), 1), ldistinct / lines, np.minimum(words / ends, 1000),
    )):
        out[:, j] = x
    return out


_KIND = np.zeros(256, np.uint8)
_KIND[97:123] |= 1
_KIND[65:91] |= 2
_KIND[48:58] |= 4
_KIND[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,'\"-"]] |= 8
_KIND[[ord(c) for c in ".!?"]] |= 16
_KIND[128:] |= 32


@dataclass
class Additive:
    """Lookup tables over bins; ``score`` gives log odds."""

    edges: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    tables: np.ndarray | None = None
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: np.ndarray | None = None
    base: float = 0.0
    threshold: float = -np.inf

    def bins(self, x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if self.tables is None:
            return out
        fine, wide = self.bins(x, self.edges), self.bins(x, self.coarse)
        for j, t in enumerate(self.tables):
            out += t[fine[:, j]]
        for (a, b), g in zip(self.pairs, self.grids, strict=True):
            out += g[wide[:, a], wide[:, b]]
        return out


def _tree(g: np.ndarray, h: np.ndarray, depth: int, least: float = 8.0) -> np.ndarray:
    """Steps of a shallow regression tree over ordered bins with gradient sums g and curvature sums h."""
    out = np.zeros(len(g))

    def grow(a: int, b: int, d: int) -> None:
        gs, hs = np.cumsum(g[a:b]), np.cumsum(h[a:b])
        if d and b - a > 1:
            gl, hl, gr, hr = gs[:-1], hs[:-1], gs[-1] - gs[:-1], hs[-1] - hs[:-1]
            gain = np.where((hl * 4 >= least) & (hr * 4 >= least), gl**2 / (hl + 1) + gr**2 / (hr + 1), -1)
            k = int(np.argmax(gain))
            if gain[k] > gs[-1] ** 2 / (hs[-1] + 1) + 1e-9:
                grow(a, a + k + 1, d - 1)
                grow(a + k + 1, b, d - 1)
                return
        out[a:b] = gs[-1] / (hs[-1] + 1)

    grow(0, len(g), depth)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One split on the first feature and one on the second inside each half, at the best places."""
    def best(gg: np.ndarray, hh: np.ndarray) -> tuple[float, int]:
        gs, hs = np.cumsum(gg), np.cumsum(hh)
        gain = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1)
        k = int(np.argmax(gain))
        return float(gain[k]), k + 1

    top = (-1.0, 0, 0, 0)
    for cut in range(1, g.shape[0]):
        (ga, ka), (gb, kb) = (best(x.sum(0), y.sum(0)) for x, y in ((g[:cut], h[:cut]), (g[cut:], h[cut:])))
        if ga + gb > top[0]:
            top = (ga + gb, cut, ka, kb)
    _, cut, ka, kb = top
    out = np.zeros(g.shape)
    for rows, k in ((slice(0, cut), ka), (slice(cut, None), kb)):
        for cols in (slice(0, k), slice(k, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + 1)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Boosts on four fifths of the rows; the threshold keeps KEEP_RECALL of the good rest."""
    m = Additive()
    if len(y) < 20 or y.min() == y.max():
        m.base, m.threshold = 50.0, -np.inf
        return m
    held = np.arange(len(y)) % 5 == 4
    xt, yt = x[~held], y[~held].astype(float)
    cut = lambda k: [np.unique(np.quantile(xt[:, j], np.linspace(0, 1, k + 1)[1:-1])) for j in range(x.shape[1])]
    m.edges, m.coarse = cut(BINS), cut(8)
    fine, wide = m.bins(xt, m.edges), m.bins(xt, m.coarse)
    p = np.clip(yt.mean(), 1e-3, 1 - 1e-3)
    m.base = float(np.log(p / (1 - p)))
    m.tables = np.zeros((x.shape[1], BINS))
    f = np.full(len(yt), m.base)
    slope = lambda: (lambda q: (yt - q, np.maximum(q * (1 - q), 1e-6)))(1 / (1 + np.exp(-f)))
    for _ in range(ROUNDS):
        for j in range(x.shape[1]):
            g, h = slope()
            step = RATE * _tree(np.bincount(fine[:, j], g, BINS), np.bincount(fine[:, j], h, BINS), 2)
            m.tables[j] += step
            f += step[fine[:, j]]
    g, h = slope()
    cells = {(a, b): wide[:, a] * 8 + wide[:, b] for a, b in combinations(range(x.shape[1]), 2)}
    gain = {k: float((np.bincount(c, g, 64) ** 2 / (np.bincount(c, h, 64) + 1)).sum()) for k, c in cells.items()}
    m.pairs = sorted(gain, key=lambda k: (-gain[k], k))[:PAIRS]
    m.grids = np.zeros((len(m.pairs), 8, 8))
    for _ in range(PAIR_ROUNDS):
        for i, k in enumerate(m.pairs):
            g, h = slope()
            step = RATE * _grid_tree(np.bincount(cells[k], g, 64).reshape(8, 8), np.bincount(cells[k], h, 64).reshape(8, 8))
            m.grids[i] += step
            f += step.ravel()[cells[k]]
    good = np.sort(m.score(x[held & (y == 1)]))
    m.threshold = min(float(good[int(len(good) * (1 - KEEP_RECALL))]), 0.0) if len(good) else -np.inf
    return m


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> Additive:
    """Fits on at most ``bound`` labelled documents."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(batch.column("text"))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), lists(x.ravel(), np.arange(len(x) + 1) * x.shape[1], pa.float64())], ["doc_id", "y", "x"])

    rows = by_chunk(labelled(docs, labels, "quality", bound).select("doc_id", "y", "text"), run, "doc_id bigint, y int, x array<double>").toArrow()
    rows = rows.sort_by("doc_id")
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)) if rows.num_rows else np.zeros((0, len(FEATURES)))
    return fit(x, rows["y"].to_numpy())


def score(docs: DataFrame, model: Additive) -> DataFrame:
    """(doc_id, score, keep) of every document: the probability that it is good, and the decision."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = model.score(features(batch.column("text")))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-s))), pa.array(s >= model.threshold)], ["doc_id", "score", "keep"])

    return by_chunk(docs.select("doc_id", "text"), run, "doc_id bigint, score double, keep boolean")


def keep(docs: DataFrame, model: Additive) -> DataFrame:
    """The documents that the model keeps, with all their columns; no shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(model.score(features(batch.column("text"))) >= model.threshold))

    return by_chunk(docs, run, docs.schema)
