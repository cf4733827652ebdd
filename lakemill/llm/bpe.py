"""Byte-level BPE encoding and decoding.

The vocabulary of a rank file becomes a sentencepiece BPE model without any training: its message is
written byte by byte, with every piece spelt in the printable alphabet of the 256 bytes, scored by its
negative rank, and an identity normaliser. A text is cut into pre-tokens by the usual pattern, distinct
pre-tokens of a chunk are encoded once, and decoding looks up the bytes of each id.

Defined results: a null text has null ids, an empty text an empty list; ids are those of the rank file.
Repeated rows get equal ids; columns other than doc_id and text aren't read. Decoding null gives null,
an id outside the vocabulary raises, and bytes that aren't UTF-8 decode with replacement characters.
"""

from __future__ import annotations

import base64
import functools
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from lakemill.llm.chars import LETTER, NUMBER, OTHER, SPACE, classes, distinct, points, ragged
from lakemill.llm.frames import by_chunk

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@functools.cache
def byte_letters() -> list[str]:
    """A printable character for every byte: itself where it prints, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {}, 256
    for b in range(256):
        out[b] = chr(b) if b in plain else chr(spare)
        spare += b not in plain
    return [out[b] for b in range(256)]


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _sub(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose id r + 1 is the piece of rank r; id 0 is the unknown piece."""
    letters = byte_letters()
    out = [_sub(1, _sub(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + b"\x18\x02")]
    for piece, rank in sorted(ranks.items(), key=lambda x: x[1]):
        out.append(_sub(1, _sub(1, "".join(letters[b] for b in piece).encode()) + b"\x15" + struct.pack("<f", -float(rank))))
    out.append(_sub(2, b"\x18\x02" + b"\x20" + _varint(len(ranks) + 1)))  # model type BPE, size
    out.append(_sub(3, _sub(1, b"identity") + b"\x18\x00\x20\x00\x28\x00"))  # no prefix, white space as it is
    return b"".join(out)


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """The model of one vocabulary, and the bytes of every id."""

    def __init__(self, path: str) -> None:
        table = ranks(path)
        self.order = np.array(sorted(table.values()))
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(table))
        by = {r: p for p, r in table.items()}
        pieces = [by.get(i, b"") for i in range(int(self.order[-1]) + 1)]
        self.size = np.array([len(p) for p in pieces])
        self.start = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.letters = np.array([ord(c) for c in byte_letters()], np.uint32)

    def encode_slices(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the byte slices, one after the other, and how many each has."""
        size = end - start
        text = self.letters[data[ragged(start, size)]].tobytes().decode("utf-32-le")
        cut = np.concatenate([[0], np.cumsum(size)]).tolist()
        ids = self.model.encode([text[a:b] for a, b in zip(cut, cut[1:], strict=False)], num_threads=1)
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int64, int(count.sum()))
        return self.order[flat - 1].astype(np.int32), count

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the offsets of each text's."""
        start, end, first = pretokens(texts)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        data = points_data(texts)
        at, which = distinct(data, start, end)
        ids, count = self.encode_slices(data, start[at], end[at])
        begin = np.cumsum(count) - count
        flat = ids[ragged(begin[which], count[which])]
        total = np.concatenate([[0], np.cumsum(count[which])])
        return flat, total[first]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the id lists that the offsets bound, and the byte offsets."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size)):
            raise ValueError("an id is outside the vocabulary")
        size = self.size[ids]
        return self.bytes[ragged(self.start[ids], size)], np.concatenate([[0], np.cumsum(size)])[first]


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def points_data(texts: pa.Array) -> np.ndarray:
    from lakemill.llm.kernel import buffers

    return buffers(texts)[0]


def pretokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte bounds of the pre-tokens of the usual pattern, and each text's offset among them.

    Runs of letters, of numbers and of other signs are pre-tokens, with one space (U+0020) before them;
    of white space before something all but the last character is one, and 's 't 're 've 'm 'll 'd that
    begin where a pre-token would are cut off.
    """
    p = points(texts)
    n = len(p.codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    kind = classes()[p.codes]
    edge = np.zeros(n + 1, bool)
    edge[p.first] = True
    run = edge.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    start = run[:n].copy()
    space = kind == SPACE
    follows = np.zeros(n, bool)  # a white-space character after which something else comes in the same text
    follows[:-1] = space[:-1] & ~space[1:] & ~edge[1:n]
    start[follows] = True
    glued = np.flatnonzero(follows & (p.codes == 32))
    start[glued + 1] = False
    codes = np.concatenate([p.codes, np.zeros(3, np.uint32)])
    tail = np.concatenate([edge, np.ones(3, bool)])
    mark = np.flatnonzero(start & (p.codes == 39))
    mark = mark[(mark + 1 < n) & ~tail[mark + 1]]
    a, b = codes[mark + 1], codes[mark + 2]
    one = np.isin(a, [ord(c) for c in "stmd"])
    two = ~tail[mark + 2] & np.isin(a * np.uint32(1 << 16) + b, [ord(x) * 65536 + ord(y) for x, y in ("re", "ve", "ll")])
    start[mark[one] + 1] = False
    start[mark[two] + 1] = False
    for at in (mark[one] + 2, mark[two] + 3):
        at = at[at < n]
        start[at[(kind[at] == LETTER) | edge[at]]] = True
    s = np.flatnonzero(start)
    return p.byte[s], p.byte[np.append(s[1:], n)], np.searchsorted(s, p.first)


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, token_ids) of every document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text")
        ids, first = codec(path).encode(texts)
        gone = texts.is_null()
        out = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids), mask=gone if texts.null_count else None)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(first).astype(np.int32), mask=gone.to_numpy(zero_copy_only=False)), out], ["doc_id", "n_tokens", "token_ids"])

    return by_chunk(docs.select("doc_id", "text"), run, "doc_id bigint, n_tokens int, token_ids array<int>")


def decode(ids: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, token_ids)."""

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                x = part.column("token_ids")
                sizes = pc.fill_null(x.value_lengths(), 0).to_numpy(zero_copy_only=False)
                first = np.concatenate([[0], np.cumsum(sizes)])
                data, off = codec(path).decode(x.flatten().to_numpy(zero_copy_only=False), first)
                whole = data.tobytes()
                texts = [whole[i:j].decode("utf-8", "replace") if ok else None for i, j, ok in zip(off, off[1:], x.is_valid().to_pylist(), strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "token_ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, token_ids, exact): the ids, and whether decoding them gives the text's bytes back; null for null."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text")
        ids, first = codec(path).encode(texts)
        data, off = codec(path).decode(ids, first)
        raw, at = points_data(texts), np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))])
        same = np.diff(off) == np.diff(at)
        if np.array_equal(off, at):
            differ = np.concatenate([[0], np.cumsum(data != raw)])
            same &= np.diff(differ[at]) == 0
        else:
            same = np.array([bool(s) and np.array_equal(data[off[i] : off[i + 1]], raw[at[i] : at[i + 1]]) for i, s in enumerate(same)])
        gone = texts.is_null().to_numpy(zero_copy_only=False)
        out = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids), mask=pa.array(gone) if gone.any() else None)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(first).astype(np.int32), mask=gone), out, pa.array(same, mask=gone)], ["doc_id", "n_tokens", "token_ids", "exact"])

    return by_chunk(docs.select("doc_id", "text"), run, "doc_id bigint, n_tokens int, token_ids array<int>, exact boolean")


#: The same by a recursion over all distinct pre-tokens at once: of every one the pair of the lowest rank is merged, until none is left.
#: A mark before the last of several white-space characters stands for the pattern's look ahead; texts with U+0001 or white space beyond ASCII would differ.
ROUND_TRIP_SQL = rf"""
WITH RECURSIVE pieces AS (SELECT hex(from_base64(piece)) AS p, rank FROM read_csv('{VOCABULARY}', delim = ' ', header = false, quote = '', escape = '', columns = {{'piece': 'VARCHAR', 'rank': 'INTEGER'}})),
texts AS (SELECT row_number() OVER () AS r, doc_id, text, regexp_extract_all(regexp_replace(text, '(\s+)(\s)(\S)', '\1' || chr(1) || '\2\3', 'g'),
  '''(?:[stmd]|re|ve|ll)| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}\x01]+|\s+') AS ws FROM documents),
words AS (SELECT r, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM texts),
kinds AS (SELECT DISTINCT w, regexp_extract_all(hex(encode(w)), '..') AS ps FROM words),
steps AS (
  SELECT w, ps, 0 AS k FROM kinds
  UNION ALL
  SELECT w, ps[1 : spot - 1] || [ps[spot] || ps[spot + 1]] || ps[spot + 2 : len(ps)], k + 1 FROM (
    SELECT w, ps, k, arg_min(i, rank * 1000000::BIGINT + i) AS spot FROM (SELECT w, ps, k, unnest(range(1, len(ps))) AS i FROM steps) AS s JOIN pieces ON pieces.p = s.ps[s.i] || s.ps[s.i + 1] GROUP BY w, ps, k)),
ended AS (SELECT w, arg_max(ps, k) AS ps FROM steps GROUP BY w),
ids AS (SELECT w, list(rank ORDER BY i) AS ids FROM (SELECT w, generate_subscripts(ps, 1) AS i, unnest(ps) AS p FROM ended) JOIN pieces USING (p) GROUP BY w),
found AS (SELECT r, flatten(list(ids ORDER BY i)) AS ids FROM words JOIN ids USING (w) GROUP BY r)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(len(ids), 0)::INTEGER END AS n_tokens, CASE WHEN text IS NOT NULL THEN coalesce(ids, []) END AS token_ids, CASE WHEN text IS NOT NULL THEN true END AS exact FROM texts LEFT JOIN found USING (r)
"""
