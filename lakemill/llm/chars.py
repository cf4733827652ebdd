"""Code points of a chunk of texts and their classes, for the tokenising operators."""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from lakemill.llm import kernel

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def classes() -> np.ndarray:
    """OTHER, LETTER, NUMBER or SPACE for every code point."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x32400):  # no letter or number lies beyond, but for the last planes' marks
        k = unicodedata.category(chr(c))[0]
        if k in "LN":
            out[c] = LETTER if k == "L" else NUMBER
    out[_SPACES] = SPACE
    return out


@dataclass
class Points:
    """Code points of all texts in a row; ``first`` holds where each text begins, ``byte`` each point's byte place."""

    codes: np.ndarray
    first: np.ndarray
    byte: np.ndarray
    data: np.ndarray


def points(texts: pa.Array) -> Points:
    data, off = kernel.buffers(texts)
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return Points(codes, np.searchsorted(starts, off), np.append(starts, len(data)), data)


def slice_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte slices [start, end)."""
    fwd, inv = kernel._POWERS.get(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * fwd[: len(data)], out=total[1:])
    return kernel.mix((total[end] - total[start]) * inv[start] + (end - start).astype(np.uint64))


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of byte slices the places of one of each kind, and for every slice which kind it is."""
    _, at, which = np.unique(slice_hashes(data, start, end), return_index=True, return_inverse=True)
    return at, which


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[i] .. start[i] + length[i] - 1 for every i, one after the other."""
    stop = np.cumsum(length)
    if not len(stop):
        return np.zeros(0, np.int64)
    return np.arange(stop[-1]) + np.repeat(start - (stop - length), length)
