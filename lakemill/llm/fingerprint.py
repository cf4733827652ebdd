"""Document fingerprints by order MinHash.

Each of SKETCHES hash functions picks, from the k-mers of words numbered by their occurrence, the
TUPLE with the smallest hashes; those are put back in text order and hashed together. Equal entries
of two signatures thus ask for the same k-mers in the same order, which edits and moves both break.

Defined results: a text with fewer words than K has one k-mer of them all; null and empty texts have
signatures of zeros. A text with fewer k-mers than TUPLE uses those it has. Repeated rows have equal
signatures; columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lakemill.llm import kernel
from lakemill.llm.frames import by_chunk, lists

K, TUPLE, SKETCHES = 3, 3, 16
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def numbered(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The keys hashed with how often each occurred before in its document."""
    seen = np.zeros(len(keys), np.uint64)
    both = kernel.mix(keys ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(both, kind="stable")
    ordered = both[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    if not new.all():
        begin = np.flatnonzero(new)
        rank = np.arange(len(keys)) - np.repeat(begin, np.diff(np.append(begin, len(keys))))
        seen[order] = rank
    return kernel.mix(keys + seen * np.uint64(0xC2B2AE3D27D4EB4F), 11)


def signatures(texts: pa.Array, k: int = K, size: int = TUPLE, sketches: int = SKETCHES) -> np.ndarray:
    """One row of ``sketches`` hashes per text."""
    grams, first = kernel.grams(kernel.words(texts), k)
    out = np.zeros((len(texts), sketches), np.int64)
    some = np.flatnonzero(np.diff(first))
    if not len(some):
        return out
    begin, length = first[some], np.diff(first)[some]
    doc = np.repeat(np.arange(len(some)), length)
    base = numbered(grams, doc)
    for i in range(sketches):
        value = kernel.mix(base, 100 + i)
        value[value == _FULL] -= np.uint64(1)
        places = np.full((len(some), size), len(value))
        for j in range(size):
            low = np.minimum.reduceat(value, begin)
            at = np.flatnonzero(value == low[doc])
            owner = doc[at]
            keep = np.concatenate([[True], owner[1:] != owner[:-1]]) & (low[owner] != _FULL)
            places[owner[keep], j] = at[keep]
            value[at[keep]] = _FULL
        places.sort(axis=1)
        chosen = np.append(base, np.uint64(0))[places]
        sig = np.zeros(len(some), np.uint64)
        for j in range(size):
            sig = kernel.mix(sig * np.uint64(0x9FB21C651E98DF25) + chosen[:, j], j + 1)
        out[some, i] = sig.view(np.int64)
    return out


def fingerprints(docs: DataFrame, k: int = K, size: int = TUPLE, sketches: int = SKETCHES) -> DataFrame:
    """(doc_id, signature) of every document; no shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = signatures(batch.column("text"), k, size, sketches)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), lists(x.ravel(), np.arange(len(x) + 1) * sketches, pa.int64())], ["doc_id", "signature"])

    return by_chunk(docs.select("doc_id", "text"), run, "doc_id bigint, signature array<bigint>")


def signatures_sql(k: int = K, size: int = TUPLE, sketches: int = SKETCHES) -> str:
    """The same in SQL, over numbers of 128 bits modulo 2 ** 64."""
    word, full = "::UHUGEINT", "18446744073709551616::UHUGEINT"

    def mix(x: str, seed: str) -> str:
        begin = f"xor({x}, (({seed}){word} * {0xD1342543DE82EF95}{word} + {0x2545F4914F6CDD1D}{word}) % {full})"
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            begin = f"list_transform([{begin}], lambda m{shift}: (xor(m{shift}, m{shift} // {1 << shift}{word}) * {factor}{word}) % {full})[1]"
        return f"list_transform([{begin}], lambda m: xor(m, m // {1 << 31}{word}))[1]"

    fold = f"list_transform([((acc + x) % {full} * {0x9FB21C651E98DF25}{word}) % {full}], lambda f: xor(f, f // {1 << 32}{word}))[1]"
    sign = "0::UHUGEINT"
    for j in range(size):
        sign = f"list_transform([{sign}], lambda s{j}: {mix(f'((s{j} * {0x9FB21C651E98DF25}{word} + coalesce(chosen[{j + 1}].b, 0{word})) % {full})', str(j + 1))})[1]"
    return rf"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}\p{{M}}]+') AS ws FROM documents),
kinds AS (SELECT DISTINCT unnest(ws) AS w FROM texts),
hashed AS (SELECT w, {mix(f"((list_reduce(list_reverse(list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda x: ('0x' || x)::INTEGER{word} + 1{word})), lambda acc, x: (acc * {kernel._B}{word} + x) % {full}, 0{word}) + strlen(w){word}) % {full})", '0')} AS h FROM kinds),
places AS (SELECT r, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM texts),
lists AS (SELECT r, list(h ORDER BY i) AS hs FROM places JOIN hashed USING (w) GROUP BY r),
grams AS (
  SELECT r, i, list_reduce(hs[i : i + {k - 1}], lambda acc, x: {fold}, 0{word}) AS g FROM lists, unnest(range(1, greatest(len(hs) - {k} + 2, 1))) AS t(i) WHERE len(hs) >= {k}
  UNION ALL
  SELECT r, 1, list_reduce(hs, lambda acc, x: {mix(f'((acc + x) % {full})', '7')}, 0{word}) FROM lists WHERE len(hs) < {k}),
based AS (SELECT r, i, {mix(f"((g + (row_number() OVER (PARTITION BY r, g ORDER BY i) - 1){word} * {0xC2B2AE3D27D4EB4F}{word}) % {full})", '11')} AS b FROM grams),
ranked AS (SELECT r, k, list_sort(list_transform(min({{'v': v, 'i': i, 'b': b}}, {size}), lambda x: {{'i': x.i, 'b': x.b}})) AS chosen FROM (SELECT r, i, b, k, {mix('b', '100 + k')} AS v FROM based, range(0, {sketches}) AS t(k)) GROUP BY r, k),
signs AS (SELECT r, k, {sign} AS s FROM ranked)
SELECT doc_id, coalesce((SELECT list((CASE WHEN s >= 9223372036854775808{word} THEN s::HUGEINT - 18446744073709551616::HUGEINT ELSE s::HUGEINT END)::BIGINT ORDER BY k) FROM signs WHERE signs.r = texts.r), list_transform(range(0, {sketches}), lambda x: 0::BIGINT)) AS signature FROM texts
"""
