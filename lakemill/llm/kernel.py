"""Vectorised text kernel shared by the training-data operators.

A word is a maximal run of letters, digits and combining marks of the lower-cased text, the same set
that the SQL expression ``regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}]+')`` gives. Words are found and hashed
for a whole Arrow chunk at once on its byte buffer, without a Python object per word.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_SQL = r"[\p{L}\p{N}\p{M}]+"
CHUNK_BYTES = 1 << 20
_B = 0x9E3779B97F4A7C15 | 1
_INV = pow(_B, -1, 1 << 64)
_U = np.uint64


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser, applied to every element."""
    x = x ^ _U((seed * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    def __init__(self) -> None:
        self.fwd = self.inv = np.ones(0, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.fwd) < n + 1:
            size = max(n + 1, CHUNK_BYTES + 1)
            for name, base in (("fwd", _B), ("inv", _INV)):
                steps = np.full(size, base, _U)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.fwd, self.inv


_POWERS = _Powers()


@functools.cache
def _byte_table() -> np.ndarray:
    t = np.zeros(256, bool)
    for lo, hi in ((48, 57), (97, 122), (65, 90), (128, 255)):
        t[lo : hi + 1] = True
    return t


@dataclass
class Words:
    """Words of a chunk: hashes, byte places in ``data``, and where each document's words begin."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # len(docs) + 1 offsets into the arrays above
    data: np.ndarray
    docs: np.ndarray  # byte offsets of the documents in data


def split(batch: pa.RecordBatch | pa.Table, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` bytes of text each, one document at least; no row is left out."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // limit
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array without nulls, rebased to 0."""
    texts = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.large_string())])
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def runs(inside: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and per-document first index of the maximal runs of True that don't cross documents."""
    n = len(inside)
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edge = docs[:-1][docs[:-1] < n]
    starts[edge] = inside[edge]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = docs[1:]
    last = last[last > 0] - 1
    ends[last] = inside[last]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, docs)


def normalised(texts: pa.Array) -> pa.Array:
    """Lower case, with every non-ASCII character that is no letter, digit or mark made a space."""
    return pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), pattern=r"[^\x00-\x7F\p{L}\p{N}\p{M}]", replacement=" ")


def words(texts: pa.Array) -> Words:
    data, docs = buffers(normalised(texts))
    s, e, first = runs(_byte_table()[data], docs)
    fwd, inv = _POWERS.get(len(data))
    total = np.zeros(len(data) + 1, _U)
    np.cumsum((data + _U(1)) * fwd[: len(data)], out=total[1:])
    return Words(mix((total[e] - total[s]) * inv[s] + (e - s).astype(_U)), s, e, first, data, docs)


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of every document and their offsets; fewer words than n: one gram of them all."""
    count = np.diff(w.first)
    h = w.hashes
    if n == 1:
        return h, w.first
    size = max(len(h) - n + 1, 0)
    acc = np.zeros(size, _U)
    for k in range(n):
        acc = (acc + h[k : k + size]) * _U(0x9FB21C651E98DF25)
        acc ^= acc >> _U(32)
    per = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    first = np.concatenate([[0], np.cumsum(per)])
    doc = np.repeat(np.arange(len(count)), per)
    at = w.first[:-1][doc] + np.arange(first[-1]) - first[:-1][doc]
    out = np.empty(first[-1], _U)
    whole = count[doc] >= n
    out[whole] = acc[at[whole]]
    for i in np.flatnonzero(~whole):
        x = _U(0)
        for v in h[w.first[doc[i]] : w.first[doc[i] + 1]].tolist():
            x = mix(np.array([int(x) + v & 0xFFFFFFFFFFFFFFFF], _U), 7)[0]
        out[i] = x
    return out, first


def word_hash(token: str) -> int:
    """The hash that ``words`` gives this one word."""
    return int(words(pa.array([token])).hashes[0])
