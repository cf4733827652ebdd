"""Benchmark decontamination by an FM-index per training shard.

The test phrases are all runs of PHRASE words of the benchmark's texts. A shard (a few MB of documents
of one partition) is written as a sequence over the benchmark's words; stretches between words that no
phrase holds are cut at a break, and those shorter than the shortest phrase can't hold one and stay
out of the index. The index keeps the Burrows-Wheeler transform in a wavelet matrix and every 16th
suffix position. All phrases are searched backward side by side, occurrences are located by walking
to a sampled position, and overlapping or adjoining occurrences merge into one removal span.

Words are runs of letters, digits and marks of the lower-cased text. Defined results: null and empty
texts have no spans and stay as they are; benchmark items of fewer than PHRASE words count whole, those
of fewer than SHORTEST words, and null ones, not at all; without phrases nothing is removed. Repeated
rows are treated alike. A text whose words are all removed stays, without them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm import kernel
from lakemill.llm.chars import ragged
from lakemill.llm.frames import by_chunk, with_text

PHRASE, SHORTEST = 8, 5
SHARD_BYTES, SAMPLE = 2 << 20, 16
#: The benchmark's phrases go to every worker; its texts divide into parts of about this size, which a worker reads one at a time.
BENCHMARK_BYTES = 16 << 20


def suffixes(seq: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling. Every 0 ends the suffixes before it: zeros differ by place."""
    n = len(seq)
    zero = seq == 0
    zeros = int(zero.sum())
    rank = seq.astype(np.int64) + zeros
    rank[zero] = np.arange(zeros)
    k = 1
    order = np.argsort(rank, kind="stable")
    while True:
        ordered = rank[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1 or k >= 2 * n:
            return order
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        rank = key
        k *= 2


class Wavelet:
    """Wavelet matrix: how often a symbol occurs before a place, for many of both at once."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        self.levels = []
        x = symbols
        for bit in reversed(range(max(1, int(size - 1).bit_length()))):
            ones = (x >> bit) & 1
            before = np.concatenate([[0], np.cumsum(ones)]).astype(np.int64)
            self.levels.append((bit, before, len(x) - int(before[-1])))
            x = np.concatenate([x[ones == 0], x[ones == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros(len(place), np.int64), place.astype(np.int64)
        for bit, before, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            a, b = before[lo], before[hi]
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo


class FMIndex:
    """Index of a sequence of symbols 1 .. size - 1 with breaks of 0; the last symbol has to be a break."""

    def __init__(self, seq: np.ndarray, size: int) -> None:
        order = suffixes(seq)
        self.bwt = seq[order - 1]
        self.less = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=size))])[:-1]
        self.ranks = Wavelet(self.bwt, size)
        kept = (order % SAMPLE == 0) | (self.bwt == 0)  # starts of stretches too: a walk never crosses a break
        self.kept = kept
        self.places = order[kept]
        self.nth = np.cumsum(kept) - 1

    def search(self, phrases: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row bounds of every phrase; phrases are rows padded on the left."""
        wide = phrases.shape[1]
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.bwt), np.int64)
        for j in reversed(range(wide)):
            live = np.flatnonzero((wide - j <= length) & (hi > lo))
            c = phrases[live, j]
            lo[live], hi[live] = (self.less[c] + self.ranks.rank(c, x[live]) for x in (lo, hi))
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.int64)
        left, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(left):
            done = self.kept[at]
            out[left[done]] = self.places[self.nth[at[done]]] + steps
            left, at = left[~done], at[~done]
            c = self.bwt[at]
            at = self.less[c] + self.ranks.rank(c, at)
            steps += 1
        return out


@dataclass
class Phrases:
    """Distinct test phrases over a vocabulary of word hashes; symbol i + 1 is the word of the i-th hash."""

    vocabulary: np.ndarray
    rows: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Phrases:
        w = kernel.words(texts)
        vocabulary = np.unique(w.hashes)
        symbols = np.searchsorted(vocabulary, w.hashes).astype(np.int32) + 1
        count, first = np.diff(w.first), w.first[:-1]
        rows = [symbols[ragged(first[count >= PHRASE], count[count >= PHRASE] - PHRASE + 1)[:, None] + np.arange(PHRASE)]] if (count >= PHRASE).any() else []
        for n in range(SHORTEST, PHRASE):
            rows.append(np.zeros(((count == n).sum(), PHRASE), np.int32))
            rows[-1][:, PHRASE - n :] = symbols[first[count == n][:, None] + np.arange(n)]
        rows = np.concatenate(rows)
        order = np.lexsort(rows.T[::-1])
        rows = rows[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        rows = rows[new]
        return cls(vocabulary, rows, (rows > 0).sum(axis=1))

    def places(self, w: kernel.Words) -> tuple[np.ndarray, np.ndarray]:
        """First word and word after the last of every occurrence, counted over all words of the shard."""
        none = np.zeros(0, np.int64)
        if not len(self.rows):
            return none, none
        n = len(w.hashes)
        quick = np.zeros(1 << 16, bool)
        quick[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
        symbol = np.zeros(n, np.int64)
        maybe = np.flatnonzero(quick[(w.hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, w.hashes[maybe]), len(self.vocabulary) - 1)
        symbol[maybe] = np.where(self.vocabulary[at] == w.hashes[maybe], at + 1, 0)
        s, e, _ = kernel.runs(symbol > 0, w.first) if n else (none, none, none)
        long = e - s >= self.length.min()
        s, e = s[long], e[long]
        if not len(s):
            return none, none
        size = e - s + 1  # with a break after each stretch
        begin = np.cumsum(size) - size
        place = np.arange(int(size.sum())) + np.repeat(s - begin, size)
        seq = symbol[np.minimum(place, n - 1)]
        seq[begin + size - 1] = 0
        here = np.zeros(len(self.vocabulary) + 1, bool)
        here[seq] = here[0] = True
        asked = np.flatnonzero(here[self.rows].all(axis=1))
        if not len(asked):
            return none, none
        index = FMIndex(seq, len(self.vocabulary) + 1)
        lo, hi = index.search(self.rows[asked], self.length[asked])
        count = np.maximum(hi - lo, 0)
        rows = np.arange(int(count.sum())) + np.repeat(lo - (np.cumsum(count) - count), count)
        start = place[index.locate(rows)]
        return start, start + np.repeat(self.length[asked], count)


class Shared:
    """The benchmark's phrases on all workers, in parts of bounded size."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame) -> None:
        texts = benchmark.select("text").where("text IS NOT NULL")
        parts = max(1, -(-(texts.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0) // BENCHMARK_BYTES))
        part = lambda i: texts.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == i) if parts > 1 else texts
        self.parts = [docs.sparkSession.sparkContext.broadcast(Phrases.of(part(i).toArrow()["text"].combine_chunks())) for i in range(parts)]

    def spans(self, w: kernel.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, first word and word after the last of every merged span, words counted over all of the shard."""
        found = []
        for part in self.parts:
            found.append(part.value.places(w))
            if len(self.parts) > 1:
                del part._value  # a worker keeps one part at a time
        start, stop = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((stop, start))
        start, stop = start[order], stop[order]
        doc = np.searchsorted(w.first, start, side="right") - 1
        reach = np.maximum.accumulate(stop)
        new = np.ones(len(start), bool)
        new[1:] = (start[1:] > reach[:-1]) | (doc[1:] != doc[:-1])
        head = np.flatnonzero(new)
        last = np.append(head[1:], len(start)) - 1 if len(head) else head
        return doc[head], start[head], reach[last]


def spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, first_word, last_word) of every removal span, counted from 0; no shuffle."""
    shared = Shared(docs, benchmark)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = kernel.words(batch.column("text"))
        doc, a, b = shared.spans(w)
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), pa.array(a - w.first[doc], pa.int64()), pa.array(b - 1 - w.first[doc], pa.int64())], ["doc_id", "first_word", "last_word"])

    return by_chunk(docs.select("doc_id", "text"), run, "doc_id bigint, first_word bigint, last_word bigint", limit=SHARD_BYTES)


def cut(texts: pa.Array, w: kernel.Words, doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Array:
    """The texts without the spans of words a .. b - 1.

    The words' places are in the normalised text, which has a character for each of the original.
    """
    before = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
    begin = before[w.docs]
    out: list = [None] * len(texts)
    hit = np.unique(doc)
    for d, text in zip(hit.tolist(), texts.take(pa.array(hit)).to_pylist(), strict=True):
        mine, kept, done = doc == d, [], 0
        for i, j in zip((before[w.start[a[mine]]] - begin[d]).tolist(), (before[w.end[b[mine] - 1]] - begin[d]).tolist(), strict=True):
            kept.append(text[done:i])
            done = j
        out[d] = "".join([*kept, text[done:]])
    changed = np.zeros(len(texts), bool)
    changed[hit] = True
    return pc.if_else(pa.array(changed), pa.array(out, texts.type), texts)


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without their removal spans, with all their columns; no shuffle."""
    shared = Shared(docs, benchmark)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = kernel.words(batch.column("text"))
        doc, a, b = shared.spans(w)
        return with_text(batch, cut(batch.column("text"), w, doc, a, b)) if len(doc) else batch

    return by_chunk(docs, run, docs.schema, limit=SHARD_BYTES)


SPANS_SQL = rf"""
WITH items AS (SELECT regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}\p{{M}}]+') AS ws FROM benchmark WHERE text IS NOT NULL),
phrases AS (
  SELECT DISTINCT least(len(ws), {PHRASE}) AS n, array_to_string(ws[i : i + {PHRASE - 1}], ' ') AS phrase
  FROM items, unnest(range(1, greatest(len(ws) - {PHRASE}, 0) + 2)) AS t(i) WHERE len(ws) >= {SHORTEST}),
docs AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}\p{{M}}]+') AS ws FROM documents WHERE text IS NOT NULL),
hits AS (
  SELECT DISTINCT r, doc_id, i - 1 AS a, i - 1 + n AS b
  FROM (SELECT r, doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS phrase
        FROM docs, (SELECT DISTINCT n FROM phrases) AS l, unnest(range(1, greatest(len(ws) - n + 2, 1))) AS t(i)) AS g
  JOIN phrases USING (n, phrase)),
marked AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY r ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM hits),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY r ORDER BY a, b) AS span FROM marked)
SELECT doc_id, min(a)::BIGINT AS first_word, (max(b) - 1)::BIGINT AS last_word FROM numbered GROUP BY r, doc_id, span
"""
