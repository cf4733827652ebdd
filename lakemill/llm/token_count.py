"""Token counts by a linear longest-match automaton.

Greedy longest-match pieces of a word are counted without building them. The vocabulary is a trie with
failure links: a link from a node leads to the node of what is left when the longest pieces that cover
the node's string from its start are popped, and holds how many pieces that are. Reading a character
follows links, adding their counts, until the node has a child for it. All distinct words of a chunk
move through the automaton side by side; the few longest go on one by one, so that a word costs its own
length alone however long it is.

A word is a run of characters other than white space, read with the word mark (byte 0x20) before it.
Defined results: null text has a null count, an empty or blank text 0; a word with a part that no piece
matches counts as one unknown token. Repeated rows count alike; other columns aren't read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lakemill.llm.bpe import VOCABULARY, ranks
from lakemill.llm.chars import SPACE, classes, distinct, points
from lakemill.llm.frames import by_chunk

MARK = 0x20
#: Words that are still being read, below which they go on one by one.
ABREAST = 48
_DEAD = -1


class Automaton:
    """``keys``/``child``: sorted (node, byte) edges and where they lead; ``fail``, ``popped``: the links."""

    def __init__(self, pieces: Iterable[bytes]) -> None:
        kids: list[dict[int, int]] = [{}]
        parent, byte, final, depth = [0], [0], [False], [0]
        for piece in pieces:
            at = 0
            for c in piece:
                to = kids[at].get(c)
                if to is None:
                    to = kids[at][c] = len(kids)
                    kids.append({})
                    parent.append(at)
                    byte.append(c)
                    final.append(False)
                    depth.append(depth[at] + 1)
                at = to
            if at:
                final[at] = True
        fail, popped = [_DEAD] * len(kids), [0] * len(kids)
        for node in sorted(range(1, len(kids)), key=depth.__getitem__):
            if final[node]:
                fail[node], popped[node] = 0, 1
                continue
            z, n = fail[parent[node]], popped[parent[node]]
            while z != _DEAD and byte[node] not in kids[z]:
                n += popped[z]
                z = fail[z]
            if z != _DEAD:
                fail[node], popped[node] = kids[z][byte[node]], n
        self.fail, self.popped = np.array(fail), np.array(popped)
        key = np.array([i * 256 + c for i, k in enumerate(kids) for c in k] or [-1])
        to = np.array([t for k in kids for t in k.values()] or [_DEAD])
        order = np.argsort(key)
        self.keys, self.child = key[order], to[order]
        self.edges: dict[int, int] = {}

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = node * 256 + byte
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.child[at], _DEAD)

    def read(self, node: np.ndarray, byte: np.ndarray, count: np.ndarray) -> np.ndarray:
        """One byte for every word: the new nodes; ``count`` grows by what was popped."""
        to = self.step(node, byte)
        left = np.flatnonzero((to == _DEAD) & (node != _DEAD))
        at = node[left]
        while len(left):
            count[left] += self.popped[at]
            at = self.fail[at]
            alive = at != _DEAD
            left, at = left[alive], at[alive]
            got = self.step(at, byte[left])
            done = got != _DEAD
            to[left[done]] = got[done]
            left, at = left[~done], at[~done]
        return to

    def rest(self, node: int, count: int, data: bytes) -> tuple[int, int]:
        """The node and the count after all bytes of one word's rest."""
        if not self.edges:
            self.edges = dict(zip(self.keys.tolist(), self.child.tolist(), strict=True))
            self.links = list(zip(self.fail.tolist(), self.popped.tolist(), strict=True))
        edges, links = self.edges, self.links
        if node == _DEAD:
            return node, count
        for c in data:
            to = edges.get(node * 256 + c)
            while to is None:
                node, n = links[node]
                count += n
                if node == _DEAD:
                    return node, count
                to = edges.get(node * 256 + c)
            node = to
        return node, count

    def lengths(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Pieces of the word mark followed by each byte slice; 1 where no cover exists."""
        order = np.argsort(start - end, kind="stable")  # longest first: those still reading are a prefix
        s, size = start[order], (end - start)[order]
        count = np.zeros(len(s), np.int64)
        node = self.read(np.zeros(len(s), np.int64), np.full(len(s), MARK), count)
        active = len(s)
        for i in range(int(size[0]) if len(size) else 0):
            active = int(np.searchsorted(-size, -i, side="left"))
            if active < ABREAST:
                for k in range(active):
                    node[k], count[k] = self.rest(int(node[k]), int(count[k]), data[s[k] + i : s[k] + size[k]].tobytes())
                break
            node[:active] = self.read(node[:active], data[s[:active] + i].astype(np.int64), count[:active])
        ok = node != _DEAD
        while True:  # what is left in the automaton at the end of the word
            more = np.flatnonzero(ok & (node > 0))
            if not len(more):
                break
            count[more] += self.popped[node[more]]
            node[more] = self.fail[node[more]]
            ok = node != _DEAD
        out = np.empty(len(s), np.int64)
        out[order] = np.where(ok, count, 1)
        return out


@functools.lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    return Automaton(ranks(path))


def spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, word bounds and each text's offset among the words."""
    p = points(texts)
    inside = classes()[p.codes] != SPACE
    if not len(inside):
        return p.data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    from lakemill.llm.kernel import runs

    s, e, first = runs(inside, p.first)
    return p.data, p.byte[s], p.byte[e], first


def count(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every document; no shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text")
        data, s, e, first = spans(texts)
        total = np.zeros(len(s) + 1, np.int64)
        if len(s):
            at, which = distinct(data, s, e)
            np.cumsum(automaton(path).lengths(data, s[at], e[at])[which], out=total[1:])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(total[first]), mask=texts.is_null().to_numpy(zero_copy_only=False))], ["doc_id", "n_tokens"])

    return by_chunk(docs.select("doc_id", "text"), run, "doc_id bigint, n_tokens bigint")


#: The same by a recursion over all distinct words at once: of every word the longest piece at its place, until none is left.
COUNTS_SQL = rf"""
WITH RECURSIVE pieces AS (SELECT hex(from_base64(piece)) AS p, octet_length(from_base64(piece)) AS n FROM read_csv('{VOCABULARY}', delim = ' ', header = false, quote = '', escape = '', columns = {{'piece': 'VARCHAR', 'rank': 'BIGINT'}})),
texts AS (SELECT row_number() OVER () AS r, doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws FROM documents),
words AS (SELECT r, unnest(ws) AS w FROM texts),
kinds AS (SELECT DISTINCT w, '20' || hex(encode(w)) AS h, strlen(w) + 1 AS size FROM words),
steps AS (
  SELECT w, h, size, 0::BIGINT AS place, 0 AS k FROM kinds
  UNION ALL
  SELECT w, h, size, place + max(pieces.n), k + 1 FROM (SELECT w, h, size, place, k, unnest(range(1, least(size - place, (SELECT max(n) FROM pieces)) + 1)) AS n FROM steps WHERE place < size) AS s
  JOIN pieces ON pieces.n = s.n AND pieces.p = substr(s.h, 2 * s.place::INTEGER + 1, 2 * s.n::INTEGER) GROUP BY w, h, size, place, k),
counts AS (SELECT w, max(k) AS k FROM steps WHERE place = size GROUP BY w)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce((SELECT sum(k) FROM words JOIN counts USING (w) WHERE words.r = texts.r), 0)::BIGINT END AS n_tokens FROM texts
"""
