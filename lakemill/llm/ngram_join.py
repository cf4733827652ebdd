"""N-gram Jaccard join with several global token orders.

All pairs of documents whose sets of word trigrams have a Jaccard similarity of at least THRESHOLD,
exactly, up to collisions of 44-bit hashes inside a bucket. A pair that similar shares a token among the
first |x| - ceil(t|x|) + 1 of either document under *every* global token order. Three orders are used,
all by rising document frequency, in which tokens of one document only come first, but with steps of
frequency of different width and with different hashes inside a step. The first order feeds an
inverted index of prefixes; a pair that it gives has to pass the second and the third before it is verified.

1. Tokens go to buckets by hash, packed, some MB of documents ("chunk") per row; a bucket counts in how
   many documents each occurs and answers the chunks for tokens of two or more. A token of several
   documents of a chunk is one entry with their number.
2. A chunk knows by then how many of a document's tokens no other has. Those fill its prefix first;
   documents whose prefix they fill can have no partner.
3. The other documents' prefixes go to buckets again. Where two share a token they become a candidate,
   if their sizes allow it and no smaller token of both, as far as those travel along, gives it already.
   The documents of a token that more than TILE have in their prefixes divide into parts, and meet in a
   tile for each two of them.
4. Candidates meet the token lists of their documents in pairs of blocks. A document's block is chosen by
   the smallest hash of its shared tokens, so that similar ones mostly share theirs and a list travels
   once or a few times rather than once per partner; a block of more than BLOCK documents or BLOCK_BYTES of
   lists divides by their hashes, so that a task's lists stay bounded. There the other orders filter and the
   rest is verified. Links are summed up and joined into classes where they are found, so that what leaves
   a block grows with its documents, not with its pairs.

Documents of equal sets are one document until the end. Nothing is capped: no bucket, partner or candidate.

Defined results: null and empty texts and those without a word have no partner, nor have rows without
doc_id; a text of fewer than three words has one token, all its words. Rows of one doc_id with different
texts are compared apart: the document is in the class of the smallest id among theirs and has the most
links of any of them; a repeated row is a copy and counts as a link. Rows that repeat a doc_id stay or go
together. Other columns aren't read. The input's partitions must come out the same when computed again,
as files and checkpoints do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm import kernel
from lakemill.llm.chars import ragged
from lakemill.llm.frames import fixed, shuffle_width

GRAM, THRESHOLD = 3, 0.5
CHUNK_TEXT, CHUNK_DOCS = 8 << 20, 60_000
#: Documents of a chunk from which a token is one entry. Documents of a token's prefixes, and sets or bytes of token lists of
#: a block, from which they divide. Pairs that a task holds before it gives them out.
MANY, TILE, BLOCK, BLOCK_BYTES, PAIRS = 4, 2000, 2000, 32 << 20, 2_000_000
AHEAD = 4
#: Ids of documents to drop are broadcast up to this size, and joined by a shuffle beyond it.
BROADCAST_BYTES = 64 << 20
#: Bits of a token beside its bucket; shuffle partitions for whose number buckets are made at most (a token's bucket has 20 bits); slots of tokens that divide.
REST, WIDEST, SLOTS = 44, 1 << 19, 1 << 20
_MULTI = 0xFFFF
_LOW = np.uint64((1 << REST) - 1)
_U = np.uint64


def _pack(rest: np.ndarray) -> bytes:
    return np.ascontiguousarray(rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _bounds(keys: np.ndarray, size: int) -> np.ndarray:
    return np.searchsorted(keys, np.arange(size + 1))


def token_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes per document and each one's document, by document."""
    grams, first = kernel.grams(kernel.words(texts), n)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.argsort(grams)
    doc, grams = doc[order], grams[order]
    order = np.argsort(doc.astype(np.uint16) if len(first) < 65536 else doc, kind="stable")
    doc, grams = doc[order], grams[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    return grams[new], doc[new]


def _needed(size: np.ndarray, t: float) -> np.ndarray:
    """ceil(t * size) with room for the rounding of t * size."""
    return np.ceil(size * t - 1e-9).astype(np.int64)


_PACKED = "bucket int, chunk bigint, head boolean, at int, a binary, b binary, c binary, d binary"
_KINDS = (pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
_NAMES = [x.split()[0] for x in _PACKED.split(", ")]


def _packed(chunk: int, ids: np.ndarray, grams: np.ndarray, owners: np.ndarray, size: np.ndarray, buckets: int) -> pa.RecordBatch:
    """The rows of a chunk: one per bucket with its tokens, and a head with what stays with the chunk.

    A token of MANY documents of the chunk or more is one entry with their number, whatever that is; which
    documents they are goes into the head. So a bucket gets a few entries per chunk at most for any token.
    """
    sets = np.zeros(len(size), _U)
    some = np.flatnonzero(size)
    if len(grams):
        begin = np.cumsum(size) - size
        sets[some] = np.add.reduceat(kernel.mix(grams, 21), begin[some])
    sets = kernel.mix(sets + size.astype(_U), 22)
    order = np.argsort(grams, kind="stable")
    g, d = grams[order], owners[order]
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(g)))
    group = np.cumsum(new) - 1
    many = (count >= MANY)[group]
    kept = np.flatnonzero(new | ~many)
    bucket = (kernel.mix(g[kept], 5) % _U(buckets)).astype(np.int64)
    kept = kept[np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.uint32), kind="stable")]
    bucket = np.sort(bucket)
    owner = np.where(many[kept], _MULTI, d[kept]).astype(np.uint16)
    multi = group[kept[owner == _MULTI]]
    before = np.concatenate([[0], np.cumsum(owner == _MULTI)])
    number = count[multi].astype(np.uint16)
    edge = _bounds(bucket, buckets)
    used = np.flatnonzero(np.diff(edge))
    rest = g[kept] & _LOW
    rows = [(int(chunk % buckets), chunk, True, len(multi), ids.astype("<i8").tobytes(), sets.tobytes(), size.astype("<i4").tobytes(), number.tobytes() + d[ragged(begin[multi], count[multi])].astype(np.uint16).tobytes())]
    for k in used.tolist():
        i, j = edge[k], edge[k + 1]
        rows.append((k, chunk, False, int(before[i]), _pack(rest[i:j]), owner[i:j].tobytes(), number[before[i] : before[j]].tobytes(), b""))
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)


def _send(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, weight = TaskContext.get().partitionId(), 0, [[], [], [], []], [0, 0]
        for batch in batches:
            for piece in kernel.split(batch):
                for a in range(0, piece.num_rows, CHUNK_DOCS):
                    x = piece.slice(a, CHUNK_DOCS)
                    if weight[0] and (weight[0] + x.nbytes > CHUNK_TEXT or weight[1] + x.num_rows > CHUNK_DOCS):
                        yield _packed(part << 24 | seq, *(np.concatenate(h) for h in held), buckets)
                        seq, held, weight = seq + 1, [[], [], [], []], [0, 0]
                    g, d = token_sets(x.column("text"), n)
                    held[0].append(x.column("doc_id").to_numpy())
                    held[1].append(g)
                    held[2].append((d + weight[1]).astype(np.uint16))
                    held[3].append(np.bincount(d, minlength=x.num_rows))
                    weight = [weight[0] + x.nbytes, weight[1] + x.num_rows]
        if weight[1]:
            yield _packed(part << 24 | seq, *(np.concatenate(h) for h in held), buckets)

    return docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, _PACKED)


def _answer(table: pa.Table) -> pa.Table:
    """The rows of a bucket: for each chunk its tokens of two documents or more, with codes of their frequency."""
    head = table["head"].to_numpy()
    rows = np.flatnonzero(~head)
    kept = table.filter(table["head"])
    out = kept.set_column(0, "bucket", pa.array(np.full(kept.num_rows, -1, np.int32)))
    if not len(rows):
        return out
    bucket = table["bucket"][int(rows[0])].as_py()
    chunk, at = table["chunk"].to_numpy()[rows], table["at"].to_numpy()[rows]
    tokens = [_unpack(table["a"][int(i)].as_py()) for i in rows]
    owner = np.concatenate([np.frombuffer(table["b"][int(i)].as_py(), np.uint16) for i in rows])
    part = np.repeat(np.arange(len(rows)), [len(t) for t in tokens])
    tokens = np.concatenate(tokens)
    number = np.ones(len(tokens), np.int64)
    number[owner == _MULTI] = np.concatenate([np.frombuffer(table["c"][int(i)].as_py(), np.uint16) for i in rows])
    order = np.argsort(tokens)
    ordered = tokens[order]
    begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    df = np.add.reduceat(number[order], begin)
    codes = np.empty(len(tokens), np.uint8)
    codes[order] = np.repeat(_code(df), np.diff(np.append(begin, len(ordered))))
    shared = codes > 1
    tokens, owner, part, codes = tokens[shared], owner[shared], part[shared], codes[shared]
    edge = _bounds(part, len(rows))
    live = np.flatnonzero(np.diff(edge))
    cut = [slice(edge[i], edge[i + 1]) for i in live]
    sent = pa.table({
        "bucket": pa.array(np.full(len(live), bucket, np.int32)), "chunk": pa.array(chunk[live]), "head": pa.array(np.zeros(len(live), bool)), "at": pa.array(at[live]),
        "a": pa.array([_pack(tokens[s]) for s in cut], pa.binary()), "b": pa.array([owner[s].tobytes() for s in cut], pa.binary()), "c": pa.array([codes[s].tobytes() for s in cut], pa.binary()), "d": pa.array([b""] * len(live), pa.binary()),
    })
    return pa.concat_tables([out, sent])


def _code(df: np.ndarray) -> np.ndarray:
    """Document frequencies as a byte: exact below 64, then eight steps per power of two."""
    return np.minimum(np.where(df < 64, df, 64 + np.rint(8 * np.log2(np.maximum(df, 1) / 64))), 255).astype(np.uint8)


_FREQUENT = int(_code(np.array([TILE]))[0])


_LIVE = "set_id bigint, size int, lone int, home int, doc_ids array<bigint>, tokens binary, codes binary"


def _documents(t: float, blocks: int):  # noqa: ANN202
    def run(table: pa.Table) -> pa.Table:
        """The rows of a chunk: its sets whose prefix holds tokens of others, with those tokens."""
        head = table["head"].to_numpy()
        at = int(np.flatnonzero(head)[0])
        ids, sets, size = (np.frombuffer(table[c][at].as_py(), k) for c, k in (("a", "<i8"), ("b", _U), ("c", "<i4")))
        rows = np.flatnonzero(~head)
        empty = pa.table({"set_id": pa.array([], pa.int64()), "size": pa.array([], pa.int32()), "lone": pa.array([], pa.int32()), "home": pa.array([], pa.int32()), "doc_ids": pa.array([], pa.list_(pa.int64())), "tokens": pa.array([], pa.binary()), "codes": pa.array([], pa.binary())})
        if not len(rows):
            return empty
        bucket = table["bucket"].to_numpy()[rows]
        parts = [_unpack(table["a"][int(i)].as_py()) for i in rows]
        token = np.concatenate([x | _U(int(b)) << _U(REST) for x, b in zip(parts, bucket, strict=True)])
        owner = np.concatenate([np.frombuffer(table["b"][int(i)].as_py(), np.uint16) for i in rows])
        code = np.concatenate([np.frombuffer(table["c"][int(i)].as_py(), np.uint8) for i in rows])
        # entries of many documents stand for one each; all of those come back, in the order in which they were sent
        multi = owner == _MULTI
        places = np.frombuffer(table["d"][at].as_py(), np.uint16)
        number, places = places[: table["at"][at].as_py()].astype(np.int64), places[table["at"][at].as_py() :]
        in_row = np.add.reduceat(multi, np.cumsum([0, *map(len, parts)])[:-1]).astype(np.int64)
        which = ragged(table["at"].to_numpy()[rows].astype(np.int64), in_row)
        times = np.ones(len(owner), np.int64)
        times[multi] = number[which]
        token, code, multi, owner = np.repeat(token, times), np.repeat(code, times), np.repeat(multi, times), np.repeat(owner, times)
        owner[multi] = places[ragged((np.cumsum(number) - number)[which], number[which])]
        order = np.argsort(token)
        order = order[np.argsort(owner[order], kind="stable")]
        token, owner, code = token[order], owner[order], code[order]
        edge = _bounds(owner, len(ids))
        shared = np.diff(edge)
        lone = size - shared
        live = np.flatnonzero((size > 0) & (size - _needed(size, t) + 1 > lone))
        groups: dict[int, list[int]] = {}
        for i in live.tolist():
            groups.setdefault(int(sets[i]), []).append(i)
        one = [g[0] for g in groups.values()]
        home = [int(kernel.mix(token[edge[i] : edge[i + 1]], 51).min() % _U(blocks)) for i in one]
        return pa.table({
            "set_id": pa.array(sets[one].view(np.int64)), "size": pa.array(size[one]), "lone": pa.array(lone[one].astype(np.int32)), "home": pa.array(home, pa.int32()),
            "doc_ids": pa.array([sorted(int(ids[i]) for i in g) for g in groups.values()], pa.list_(pa.int64())),
            "tokens": pa.array([token[edge[i] : edge[i + 1]].tobytes() for i in one], pa.binary()), "codes": pa.array([code[edge[i] : edge[i + 1]].tobytes() for i in one], pa.binary()),
        }) if one else empty

    return run


#: Widths of the steps of frequency, and seeds of the hashes inside a step, of the orders.
ORDERS = ((1, 31), (8, 32), (24, 33))


def prefix_codes(tokens: np.ndarray, codes: np.ndarray, size: int, lone: int, t: float, order: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The shared tokens in the document's prefix under an order, first ones first, and their codes."""
    take = size - int(_needed(np.array(size), t)) + 1 - lone
    hashed = kernel.mix(tokens, order[1])
    first = np.lexsort((hashed, codes // order[0]))[: max(take, 0)]
    return tokens[first], codes[first]


def prefix(tokens: np.ndarray, codes: np.ndarray, size: int, lone: int, t: float, order: tuple[int, int]) -> np.ndarray:
    return prefix_codes(tokens, codes, size, lone, t, order)[0]


def _divided(home: np.ndarray, sets: np.ndarray, crowded: dict[int, int]) -> np.ndarray:
    """Blocks from homes: those of crowded homes divide into as many parts as the dict says."""
    out = home.astype(np.int64)
    for h in np.unique(home).tolist():
        if h in crowded:
            mine = home == h
            out[mine] |= ((sets[mine].view(_U) % _U(crowded[h])).astype(np.int64) + 1) << 32
    return out


def _heads(batch: pa.RecordBatch, t: float, order: tuple[int, int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The prefix of every set under an order, and the codes of its tokens."""
    size, lone = batch.column("size").to_numpy(), batch.column("lone").to_numpy()
    return [prefix_codes(np.frombuffer(a.as_py(), _U), np.frombuffer(c.as_py(), np.uint8), int(s), int(n), t, order) for a, c, s, n in zip(batch.column("tokens"), batch.column("codes"), size, lone, strict=True)]


def _slot(token: np.ndarray) -> np.ndarray:
    return (kernel.mix(token, 61) % _U(SLOTS)).astype(np.int64)


def _divisions(live: DataFrame, t: float) -> np.ndarray | None:
    """Into how many parts the documents of a token divide, by slots of a hash of the token.

    Only tokens that TILE documents or more hold can have as many in whose prefixes they are, so others
    aren't counted; sets are counted once however many copies they have. There are SLOTS numbers whatever the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, CHUNK_DOCS) for b in batches for k in range(0, b.num_rows, CHUNK_DOCS)):
            heads = [h[c >= _FREQUENT] for h, c in _heads(batch, t, ORDERS[0])]
            count = np.array([len(h) for h in heads], np.int64)
            if count.sum():
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(heads).view(np.int64)), pa.array(np.repeat(batch.column("set_id").to_numpy(), count))], ["token", "set_id"])

    found = live.select("set_id", "size", "lone", "tokens", "codes").mapInArrow(run, "token bigint, set_id bigint")
    parts = found.groupBy("token").agg(F.approx_count_distinct("set_id", 0.03).alias("n")).where(F.col("n") > TILE)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_slot(b.column("token").to_numpy().view(_U))), pa.array(-(-b.column("n").to_numpy() // TILE))], ["slot", "k"])

    out = None
    for r in parts.mapInArrow(slots, "slot bigint, k bigint").groupBy("slot").agg(F.max("k").alias("k")).toLocalIterator():
        out = np.ones(SLOTS, np.int32) if out is None else out
        out[r["slot"]] = r["k"]
    return out


def _tiles(token: np.ndarray, k: np.ndarray, doc: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Entries of tiles, (group, token, document, side): the documents of a token of k parts meet in a tile for each two parts."""
    if (k == 1).all():
        return token, token, doc, np.zeros(len(token), np.uint8)
    again = np.repeat(np.arange(len(token)), k)
    other = ragged(np.zeros(len(token), np.int64), k)
    k, token, doc = k[again], token[again], doc[again]
    own = (kernel.mix(sets.view(_U), 62)[doc] % k.astype(_U)).astype(np.int64)
    cell = (np.minimum(own, other) << 32 | np.maximum(own, other)).astype(_U)
    group = np.where(k > 1, kernel.mix(token ^ kernel.mix(cell, 63), 64), token)
    return group, token, doc, np.where(own == other, 0, np.where(own < other, 1, 2)).astype(np.uint8)


_INDEX = {"group": _U, "token": _U, "place": np.uint16, "side": np.uint8, "sets": np.int64, "sizes": np.int32, "homes": np.int64, "low": _U}


def _index(live: DataFrame, t: float, buckets: int, crowded: dict[int, int], divisions: np.ndarray | None) -> DataFrame:
    shared = live.sparkSession.sparkContext.broadcast((crowded, divisions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowded, divisions = shared.value
        for batch in (b.slice(k, CHUNK_DOCS) for b in batches for k in range(0, b.num_rows, CHUNK_DOCS)):
            sets, size, home = (batch.column(c).to_numpy() for c in ("set_id", "size", "home"))
            home = _divided(home, sets, crowded)
            heads = _heads(batch, t, ORDERS[0])
            if not heads:
                continue
            low = np.full((len(heads), AHEAD), 0xFFFFFFFFFFFFFFFF, _U)
            for i, (h, _) in enumerate(heads):
                first = np.sort(kernel.mix(h, 41))[:AHEAD]
                low[i, : len(first)] = first
            token, code = (np.concatenate(x) for x in zip(*heads, strict=True))
            parts = np.ones(len(token), np.int64) if divisions is None else np.where(code >= _FREQUENT, divisions[_slot(token)], 1)
            group, token, doc, side = _tiles(kernel.mix(token, 41), parts, np.repeat(np.arange(len(heads)), [len(h) for h, _ in heads]), sets)
            b = (group % _U(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            b, group, token, doc, side = b[order], group[order], token[order], doc[order], side[order]
            edge = _bounds(b, buckets)
            used = np.flatnonzero(np.diff(edge))
            out = {c: [] for c in _INDEX}
            for i, j in zip(edge[used].tolist(), edge[used + 1].tolist(), strict=True):
                who, place = np.unique(doc[i:j], return_inverse=True)
                tiled = (group[i:j] != token[i:j]).any()
                for c, x in (("group", group[i:j] if tiled else group[:0]), ("token", token[i:j]), ("place", place), ("side", side[i:j] if tiled else side[:0]), ("sets", sets[who]), ("sizes", size[who]), ("homes", home[who]), ("low", low[who])):
                    out[c].append(x.astype(_INDEX[c]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(x, pa.binary()) for x in out.values())], ["bucket", *out])

    return live.mapInArrow(run, "bucket int, " + ", ".join(f"{c} binary" for c in _INDEX))


_KEYED = "p bigint, q bigint, a binary, b binary"


def _emitted(a: np.ndarray, b: np.ndarray, sets: np.ndarray, homes: np.ndarray) -> pa.RecordBatch:
    """Pairs by the blocks of their two sets, the smaller block first; one row for each two blocks."""
    swap = homes[a] > homes[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    order = np.lexsort((homes[b], homes[a]))
    a, b = a[order], b[order]
    p, q = homes[a], homes[b]
    begin = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (q[1:] != q[:-1])])) if len(a) else np.zeros(0, np.int64)
    stop = np.append(begin[1:], len(a))
    cut = lambda x: pa.array([sets[x[i:j]].tobytes() for i, j in zip(begin.tolist(), stop.tolist(), strict=False)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(p[begin]), pa.array(q[begin]), cut(a), cut(b)], ["p", "q", "a", "b"])


def _pairs(t: float):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a bucket: pairs of sets that share a token of their prefixes, some millions at a time."""
        cols = {c: [] for c in _INDEX}
        for batch in batches:
            for c, kind in _INDEX.items():
                cols[c] += [np.frombuffer(x.as_py(), kind) for x in batch.column(c)]
        shift = np.cumsum([0, *map(len, cols["sets"])])[:-1]
        doc = np.concatenate([p.astype(np.int64) + s for p, s in zip(cols["place"], shift, strict=True)])
        cols["group"] = [g if len(g) else x for g, x in zip(cols["group"], cols["token"], strict=True)]
        cols["side"] = [g if len(g) else np.zeros(len(x), np.uint8) for g, x in zip(cols["side"], cols["token"], strict=True)]
        group, token, side, sets, sizes, homes, low = (np.concatenate(cols.pop(c)) for c in ("group", "token", "side", "sets", "sizes", "homes", "low"))
        low = low.reshape(-1, AHEAD)
        distinct, first, same = np.unique(sets, return_index=True, return_inverse=True)  # equal sets of several chunks are one
        sizes, homes, low = sizes[first], homes[first], low[first]
        order = np.lexsort((same[doc], group))
        group, token, side, doc = group[order], token[order], side[order], same[doc][order]
        new = np.ones(len(token), bool)
        new[1:] = (group[1:] != group[:-1]) | (doc[1:] != doc[:-1])
        group, token, side, doc = group[new], token[new], side[new], doc[new]
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
        count = np.diff(np.append(begin, len(group)))
        found, held = [], 0
        # pairs of a row with those after it in its group, some rows at a time
        after = np.repeat(begin + count, count) - np.arange(len(group)) - 1
        a = 0
        total = np.cumsum(after)
        while a < len(group):
            z = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + 1_000_000)))
            x = np.repeat(np.arange(a, z), after[a:z])
            y = ragged(np.arange(a, z) + 1, after[a:z])
            ok = (side[x] == 0) | (side[x] != side[y])
            x, y = x[ok], y[ok]
            u, v = doc[x], doc[y]
            ok = np.minimum(sizes[u], sizes[v]) >= t * np.maximum(sizes[u], sizes[v]) - 1e-9
            x, u, v = x[ok], u[ok], v[ok]
            for i in range(AHEAD):
                for j in range(AHEAD):
                    ok = ~((low[u, i] == low[v, j]) & (low[u, i] < token[x]))
                    x, u, v = x[ok], u[ok], v[ok]
            found.append(np.unique(u * len(distinct) + v))
            held += len(found[-1])
            a = z
            if held > PAIRS or a == len(group):
                pairs = np.unique(np.concatenate(found))
                found, held = [], 0
                if len(pairs):
                    yield _emitted(pairs // len(distinct), pairs % len(distinct), distinct, homes)

    return run


def _asked(keyed: DataFrame) -> DataFrame:
    """(r, s, set_id): the sets whose token lists two blocks need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, s, a, b in zip(*(batch.column(c) for c in ("p", "q", "a", "b")), strict=True):
                ids = np.unique(np.frombuffer(a.as_py() + b.as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), r.as_py())), pa.array(np.full(len(ids), s.as_py())), pa.array(ids)], ["r", "s", "set_id"])

    return keyed.mapInArrow(run, "r bigint, s bigint, set_id bigint").distinct()


def _similar(t: float, ids: np.ndarray, size: np.ndarray, lone: np.ndarray, tokens: list[np.ndarray], codes: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each set of a those of b that the other orders let through and that are similar enough, and how similar."""
    heads = [[prefix(x, c, int(s), int(n), t, o) for x, c, s, n in zip(tokens, codes, size, lone, strict=True)] for o in ORDERS[1:]]
    known, number = np.unique(np.concatenate(tokens), return_inverse=True)
    cut = np.cumsum([0, *map(len, tokens)])
    rows = [number[i:j] for i, j in zip(cut, cut[1:], strict=False)]
    heads = [[np.searchsorted(known, h) for h in hs] for hs in heads]
    pairs = np.unique(a * len(ids) + b)
    a, b = pairs // len(ids), pairs % len(ids)
    mark = np.zeros(len(known), bool)
    begin = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    for i, j in zip(begin, np.append(begin[1:], len(a)), strict=True):
        x, ys = int(a[i]), b[i:j]
        for hs in heads:
            mark[hs[x]] = True
            ys = ys[_hits(mark, hs, ys) > 0]
            mark[hs[x]] = False
        mark[rows[x]] = True
        both = _hits(mark, rows, ys)
        mark[rows[x]] = False
        jaccard = both / (size[x] + size[ys] - both)
        ok = jaccard >= t - 1e-9
        yield x, ys[ok], jaccard[ok]


_LINKS = "set_id bigint, root bigint, links bigint"
_FOUND = "a bigint, b bigint, jaccard double"


def _verified(t: float, each: bool):  # noqa: ANN202
    def run(pairs: pa.Table, lists: pa.Table) -> pa.Table:
        """Of two blocks, with ``each`` every pair of similar sets; else, of each set that has any, the number of rows of
        similar sets here and one set for all those that pairs of these blocks link."""
        found = []
        ids = lists["set_id"].to_numpy() if lists.num_rows else np.zeros(0, np.int64)
        copies = lists["copies"].to_numpy() if lists.num_rows else np.zeros(0, np.int64)
        if pairs.num_rows and lists.num_rows:
            sort = np.argsort(ids)
            a, b = (sort[np.searchsorted(ids[sort], np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in pairs[c]]))] for c in ("a", "b"))
            tokens, codes = ([np.frombuffer(x.as_py(), k) for x in lists[c]] for c, k in (("tokens", _U), ("codes", np.uint8)))
            found = _similar(t, ids, lists["size"].to_numpy(), lists["lone"].to_numpy(), tokens, codes, a, b)
        if each:
            found = [(np.full(len(y), ids[x]), ids[y], j) for x, y, j in found]
            a, b, j = (np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in range(3))
            return pa.table({"a": pa.array(a), "b": pa.array(b), "jaccard": pa.array(j.astype(np.float64))})
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for x, ys, _ in found:
            links[x] += copies[ys].sum()
            links[ys] += copies[x]
            tops = np.unique(_top(root, np.append(ys, x)))
            root[tops] = tops[0]
        some = np.flatnonzero(links)
        return pa.table({"set_id": pa.array(ids[some]), "root": pa.array(ids[_top(root, some)]), "links": pa.array(links[some])})

    return run


def _top(root: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The roots of the trees that hold these places."""
    at = root[which]
    while (root[at] != at).any():
        at = root[at]
    root[which] = at
    return at


def _hits(mark: np.ndarray, rows: list[np.ndarray], which: np.ndarray) -> np.ndarray:
    """How many entries of each chosen row are marked."""
    if not len(which):
        return np.zeros(0, np.int64)
    size = np.array([len(rows[i]) for i in which])
    total = np.concatenate([[0], np.cumsum(mark[np.concatenate([rows[i] for i in which])])])
    stop = np.cumsum(size)
    return total[stop] - total[stop - size]


def similar_sets(docs: DataFrame, t: float = THRESHOLD, n: int = GRAM, each: bool = False) -> tuple[DataFrame, DataFrame]:
    """(chunk rows of set_id, doc_ids) of the documents that can have partners, and of their sets what ``_verified`` gives."""
    width = min(shuffle_width(docs.sparkSession), WIDEST)
    live = fixed(_send(docs, n, 2 * width).groupBy("bucket").applyInArrow(lambda x: _answer(x), _PACKED).groupBy("chunk").applyInArrow(_documents(t, 4 * width), _LIVE))
    # one entry per block of more sets or bytes than one task should hold
    homes = live.groupBy("home").agg(F.count("*").alias("n"), F.sum(F.octet_length("tokens")).alias("bytes"))
    parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).alias("k")
    crowded = {r["home"]: r["k"] for r in homes.select("home", parts).where("k > 1").toLocalIterator()}
    keyed = fixed(_index(live, t, max(4, width // 4), crowded, _divisions(live, t)).groupBy("bucket").applyInArrow(_pairs(t), _KEYED))
    lists = live.groupBy("set_id").agg(*(F.first(c).alias(c) for c in ("size", "lone", "tokens", "codes")), F.sum(F.size("doc_ids")).alias("copies"))
    sent = _asked(keyed).join(lists, "set_id")
    return live.select("set_id", "doc_ids"), keyed.groupBy("p", "q").cogroup(sent.groupBy("r", "s")).applyInArrow(_verified(t, each), _FOUND if each else _LINKS)


def pairs(docs: DataFrame, t: float = THRESHOLD, n: int = GRAM) -> DataFrame:
    """(doc_id_a, doc_id_b, jaccard) of every pair of similar documents, the smaller id first; as many rows as there are pairs."""
    live, found = similar_sets(docs, t, n, each=True)
    members = live.select("set_id", F.explode("doc_ids").alias("doc_id")).distinct()
    left, right = members.toDF("a", "doc_id_a"), members.toDF("b", "doc_id_b")
    near = found.join(left, "a").join(right, "b").select(
        F.least("doc_id_a", "doc_id_b").alias("doc_id_a"), F.greatest("doc_id_a", "doc_id_b").alias("doc_id_b"), "jaccard"
    )
    copies = left.join(right.withColumnRenamed("b", "a"), "a").select("doc_id_a", "doc_id_b", F.lit(1.0).alias("jaccard"))
    return near.unionByName(copies).where("doc_id_a < doc_id_b").groupBy("doc_id_a", "doc_id_b").agg(F.max("jaccard").alias("jaccard"))


def classes(docs: DataFrame, t: float = THRESHOLD, n: int = GRAM) -> DataFrame:
    """(doc_id, class_id, links) of every document that is similar to another.

    A class is what links join, directly or over others; its id is the smallest doc_id in it. ``links`` is the number of
    rows that the document is similar to, copies among them. A document without a row is a class of its own.
    """
    live, found = similar_sets(docs, t, n)
    found = fixed(found)
    tops = components(found.select(F.col("set_id").alias("a"), F.col("root").alias("b")))
    near = found.groupBy("set_id").agg(F.sum("links").alias("near")).join(tops.toDF("set_id", "root"), "set_id", "left")
    # rows of a chunk, not of a document, meet the links of their set; a set of very many copies is a skewed key that AQE divides
    sets = live.withColumn("own", F.size("doc_ids"))
    copies = sets.groupBy("set_id").agg(F.sum("own").alias("copies")).join(near, "set_id", "left")
    copies = copies.select("set_id", F.coalesce("root", "set_id").alias("root"), (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links")).where("links > 0")
    joined = fixed(sets.select("set_id", "doc_ids").join(copies, "set_id").select("root", "links", "doc_ids"))
    least = joined.groupBy("root").agg(F.min(F.array_min("doc_ids")).alias("class_id"))
    rows = joined.join(least, "root").select(F.explode("doc_ids").alias("doc_id"), "class_id", "links")
    return rows.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("links").alias("links"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) is linked with.

    Large-star and small-star steps by turns, each written out, until the edges no longer change; the number
    of steps grows with the logarithm of the longest chain. A node's neighbours are never gathered: their
    minimum is aggregated and joined back, so that a hub is a skewed key of a join and no array.
    """

    def star(links: DataFrame) -> DataFrame:
        """(u, v, m): links with the smallest node among u and its neighbours."""
        least = links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return links.join(least, "u")

    now = fixed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        large = star(now.union(now.select("v", "u"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = star(large.distinct())
        small = fixed(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        state = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return small.select(F.col("u").alias("node"), F.col("v").alias("root"))
        now, before = small, state


def deduplicate(docs: DataFrame, t: float = THRESHOLD, n: int = GRAM) -> DataFrame:
    """The documents without those of each class that don't have its id, with all their columns; rows without doc_id stay."""
    gone = fixed(classes(docs, t, n).where("doc_id <> class_id").select("doc_id"))
    if gone.count() * 16 <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


_SETS_SQL = rf"""
texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}\p{{M}}]+') AS ws FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
grams AS (
  SELECT DISTINCT r, doc_id, array_to_string(ws[i : i + {GRAM - 1}], ' ') AS g
  FROM texts, unnest(range(1, greatest(len(ws) - {GRAM}, 0) + 2)) AS t(i) WHERE len(ws) > 0),
sizes AS (SELECT r, count(*) AS n FROM grams GROUP BY r),
common AS (SELECT x.r AS a, y.r AS b, min(x.doc_id) AS doc_a, min(y.doc_id) AS doc_b, count(*) AS k FROM grams x JOIN grams y ON x.g = y.g AND x.r <> y.r GROUP BY ALL),
alike AS (SELECT a, b, doc_a, doc_b, k / (p.n + q.n - k)::DOUBLE AS jaccard FROM common JOIN sizes p ON p.r = a JOIN sizes q ON q.r = b WHERE k / (p.n + q.n - k)::DOUBLE >= {THRESHOLD})
"""
PAIRS_SQL = f"WITH {_SETS_SQL} SELECT doc_a AS doc_id_a, doc_b AS doc_id_b, max(jaccard) AS jaccard FROM alike WHERE doc_a < doc_b GROUP BY ALL"
CLASSES_SQL = f"""WITH RECURSIVE {_SETS_SQL},
reach AS (SELECT a AS r, a AS other FROM alike UNION SELECT reach.r, alike.b FROM reach JOIN alike ON alike.a = reach.other),
owner AS (SELECT DISTINCT a AS r, doc_a AS doc_id FROM alike),
least AS (SELECT reach.r, min(owner.doc_id) AS class_id FROM reach JOIN owner ON owner.r = reach.other GROUP BY reach.r)
SELECT doc_id, min(class_id) AS class_id, max(n) AS links FROM owner JOIN least USING (r) JOIN (SELECT a AS r, count(*) AS n FROM alike GROUP BY a) USING (r) GROUP BY doc_id
"""
