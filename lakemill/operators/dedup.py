"""Deduplication: exact, fuzzy, by lines, by substrings, across runs, and decontamination.

Rows have no order of their own in Spark, so "first" is by an id column that the caller names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakemill.functions import kernels
from lakemill.functions.text import by_arrow, col, content_hash, normalized
from lakemill.operators.components import connected_components
from lakemill.operators.store import stored
from lakemill.sources import exists


def exact_dedup(df: DataFrame, id_column: str, column: str = "text", normalize: bool = True, keep_hash: bool = False) -> DataFrame:
    """The row with the smallest id for each text; rows of null text go, rows that repeat an id with its text stay.

    Hashes and ids alone are shuffled to find the rows that go, which are usually few, so that the texts can stay where they are.
    """
    hashed = df.where(col(column).isNotNull()).withColumn("content_hash", content_hash(col(column), normalize))
    ids = stored(hashed.select(F.unhex("content_hash").alias("h"), col(id_column).alias("__id"), F.xxhash64(col(column)).alias("__x")))
    least = ids.groupBy("h").agg(F.min("__id").alias("first"), F.max("__id").alias("last")).where("first <> last").select("h", "first")
    gone = ids.join(least, "h").where("__id <> first").select("__id", "__x").distinct()
    first = hashed.join(gone, (F.col("__id") == col(id_column)) & (F.col("__x") == F.xxhash64(col(column))), "left_anti")
    return first if keep_hash else first.drop("content_hash")


# MinHash

PRIME = (1 << 61) - 1
#: Texts of a band of which all pairs are compared, and next ones that each meets in a larger one.
CROWD, NEIGHBOURS = 64, 4
#: Hashes of a benchmark's n-grams that go to all workers at most (80 MB).
KNOWN = 10_000_000


def optimal_lsh_bands(threshold: float, num_hashes: int, fp_weight: float = 0.5, fn_weight: float = 0.5) -> tuple[int, int]:
    """Bands and rows that make the areas of false positives below and false negatives above the threshold least."""
    best = None
    for bands in range(1, num_hashes + 1):
        rows = num_hashes // bands
        caught = lambda s, b=bands, r=rows: 1 - (1 - s**r) ** b
        low, high = np.linspace(0, threshold, 65), np.linspace(threshold, 1, 65)
        cost = fp_weight * np.trapezoid(caught(low), low) + fn_weight * np.trapezoid(1 - caught(high), high)
        if best is None or cost < best[0] - 1e-12:
            best = (cost, bands, rows)
    return best[1], best[2]


def recall_lsh_bands(threshold: float, num_hashes: int, recall: float = 0.9) -> tuple[int, int]:
    """Bands and rows of the longest rows that put a pair at the threshold in a common band with probability ``recall``."""
    for rows in range(num_hashes, 0, -1):
        bands = num_hashes // rows
        if 1 - (1 - threshold**rows) ** bands >= recall:
            return bands, rows
    return num_hashes, 1


@functools.cache
def _coefficients(num_hashes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """a in [1, p - 1] and b in [0, p) by turns from a splitmix64 stream."""
    full, out = (1 << 64) - 1, []
    state = (seed ^ 0x9E3779B97F4A7C15) & full
    for _ in range(2 * num_hashes):
        state = (state + 0x9E3779B97F4A7C15) & full
        z = ((state ^ (state >> 30)) * 0xBF58476D1CE4E5B9) & full
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & full
        out.append(z ^ (z >> 31))
    return np.array([z % (PRIME - 1) + 1 for z in out[::2]], np.uint64), np.array([z % PRIME for z in out[1::2]], np.uint64)


def signatures(h: np.ndarray, first: np.ndarray, num_hashes: int, seed: int) -> np.ndarray:
    """Minima of (a x + b) mod 2^61 - 1, without loss of bits, over the hashes x of every text; zeros of none."""
    u, p = np.uint64, np.uint64(PRIME)
    a, b = (c[:, None] for c in _coefficients(num_hashes, seed))
    low, high = (1 << 31) - 1, 31
    a0, a1 = a & u(low), a >> u(high)
    x = h % p
    out = np.zeros((len(first) - 1, num_hashes), u)
    some = np.flatnonzero(np.diff(first))
    # whole texts, some thousand hashes at a time
    edges = [0, *(np.flatnonzero(np.diff(first[some] // 2048)) + 1).tolist(), len(some)]
    for i, j in zip(edges, edges[1:], strict=False):
        if i == j:
            continue
        part = x[first[some[i]] : first[some[j - 1] + 1]]
        x0, x1 = part & u(low), part >> u(high)
        # products of halves by powers of 2^31; 2^61 is 1
        mid = a0 * x1
        mid += a1 * x0
        total = a0 * x0
        total += (a1 << u(1)) * x1
        total += mid >> u(30)
        mid &= u((1 << 30) - 1)
        mid <<= u(31)
        total += mid
        total += b
        np.right_shift(total, u(61), out=mid)
        total &= p
        total += mid
        np.subtract(total, p, out=mid)
        np.minimum(total, mid, out=total)  # what lies below p wraps to the far end
        out[some[i:j]] = np.minimum.reduceat(total, first[some[i:j]] - first[some[i]], axis=1).T
    return out


def _lists(flat: np.ndarray, first: np.ndarray, gone: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(flat.astype(np.int64)), mask=gone if gone.true_count else None)


def minhash_signatures(df: DataFrame, column: str = "text", num_hashes: int = 128, ngram: int = 2, seed: int = 1, out_column: str = "minhash") -> DataFrame:
    """Signatures of word n-grams over their FNV-1a hashes; zeros for a text without words, null for null."""

    def run(texts: pa.Array) -> pa.Array:
        h, first = kernels.gram_sets(texts, ngram)
        return _lists(signatures(h, first, num_hashes, seed).ravel(), np.arange(len(first)) * num_hashes, texts.is_null())

    return df.withColumn(out_column, by_arrow(run, "array<bigint>", col(column)))


def signature_similarity(a: Column, b: Column) -> Column:
    """Share of equal entries."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def lsh_band_keys(signature: Column, bands: int, rows: int) -> Column:
    """A key per band: its number and a hash of its entries; entries beyond the last full band aren't used."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(F.slice(signature, i * rows + 1, F.lit(rows))).alias("key")))


def fuzzy_pairs(df: DataFrame, id_column: str, column: str = "text", num_hashes: int = 128, ngram: int = 2, bands: int | None = None, threshold: float = 0.7, seed: int = 1) -> DataFrame:
    """(a, b): pairs of ids whose texts agree in a band of their signatures and whose sets of n-grams have a Jaccard similarity of at least ``threshold``.

    Texts of equal sets collapse to their smallest id before pairs are made. In a band of up to CROWD texts all pairs are
    compared; a larger one is put in the order of the next band's keys, and each text meets the first and its NEIGHBOURS next ones,
    so that the work grows with the texts; a link between others of such a band is lost unless another band gives it.
    Sets are compared by 64-bit hashes.
    """
    b, rows = (bands, num_hashes // bands) if bands else recall_lsh_bands(threshold, num_hashes)

    def keys(texts: pa.Array) -> pa.Array:
        h, first = kernels.gram_sets(texts, ngram)
        some = np.flatnonzero(np.diff(first))
        whole = np.zeros(len(first) - 1, np.uint64)
        if len(some):
            whole[some] = np.add.reduceat(kernels.mixed(h ^ np.uint64(0x5851F42D4C957F2D)), first[some])
        whole = kernels.mixed(whole + np.diff(first).astype(np.uint64))
        sig = kernels.quick_signatures(h, first, b * rows, seed).reshape(-1, rows)
        key = np.zeros(len(sig), np.uint64)
        for k in range(rows):
            key = kernels.mixed(key * np.uint64(31) + sig[:, k])
        flat = np.concatenate([whole[:, None], key.reshape(-1, b)], axis=1)
        empty = np.ones(len(whole), bool)
        empty[some] = False
        return _lists(flat.ravel(), np.arange(len(first)) * (b + 1), pa.array(empty))

    def sets(texts: pa.Array) -> pa.Array:
        h, first = kernels.gram_sets(texts, ngram)
        return _lists(h, first, texts.is_null())

    texts = df.select(col(id_column).alias("id"), col(column).alias("text")).where("id IS NOT NULL")
    signed = stored(texts.select("id", by_arrow(keys, "array<bigint>", F.col("text")).alias("k")).where("k IS NOT NULL"))
    whole = F.col("k")[0]
    leaders = stored(signed.groupBy(whole.alias("whole")).agg(F.min("id").alias("id"), F.first("k").alias("k"), F.count("*").alias("n")))
    equal = signed.join(leaders.where("n > 1").select(F.col("id").alias("a"), F.col("whole").alias("__w")), F.col("__w") == whole).select("a", F.col("id").alias("b")).where("a <> b")
    keyed = leaders.select("id", "k", F.posexplode(F.slice("k", 2, b)).alias("band", "key")).select("id", "band", "key", F.col("k")[(F.col("band") + 1) % b + 1].alias("next"))
    crowds = keyed.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    keyed = stored(keyed.join(crowds, ["band", "key"]))
    few = keyed.where(F.col("n") <= CROWD)
    near = few.selectExpr("id AS a", "band", "key").join(few.selectExpr("id AS b", "band", "key"), ["band", "key"]).where("a < b").select("a", "b")
    # all of a crowd meet its first; slices of some thousand by the next band's key are sorted by it
    many = keyed.where(F.col("n") > CROWD)
    heads = many.groupBy("band", "key").agg(F.min("id").alias("a"))
    stars = many.select("band", "key", F.col("id").alias("b")).join(heads, ["band", "key"]).where("a <> b").select("a", "b")
    order = Window.partitionBy("band", "key", F.pmod("next", F.ceil(F.col("n") / 4096))).orderBy("next", "id")
    chain = many.select("id", F.array(*(F.lead("id", k).over(order) for k in range(1, NEIGHBOURS + 1))).alias("bs")).select(F.col("id").alias("a"), F.explode("bs").alias("b")).where("b IS NOT NULL")
    ordered = stars.unionByName(chain).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    near = stored(near.unionByName(ordered).distinct())
    held = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    grams = stored(texts.join(held, "id", "left_semi").dropDuplicates(["id"]).select("id", by_arrow(sets, "array<bigint>", F.col("text")).alias("g")))

    def jaccard(x: pa.Array, y: pa.Array) -> pa.Array:
        """Of lists of distinct numbers, for all pairs of a batch at once: numbers that occur twice in a pair are shared."""
        size = [z.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for z in (x, y)]
        row = np.concatenate([np.repeat(np.arange(len(x)), n) for n in size])
        value = np.concatenate([z.flatten().to_numpy(zero_copy_only=False) for z in (x, y)])
        order = np.lexsort((value, row))
        row, value = row[order], value[order]
        both = np.bincount(row[1:][(row[1:] == row[:-1]) & (value[1:] == value[:-1])], minlength=len(x)) if len(row) else np.zeros(len(x))
        return pa.array(both / np.maximum(size[0] + size[1] - both, 1))

    similar = near.join(grams.toDF("a", "ga"), "a").join(grams.toDF("b", "gb"), "b").where(F.arrow_udf(jaccard, "double")("ga", "gb") >= threshold)
    return similar.select("a", "b").unionByName(equal)


def keep_representatives(df: DataFrame, id_column: str, pairs: DataFrame, keep_cluster: bool = False, cluster_column: str = "cluster_id") -> DataFrame:
    """The row of the smallest id of each group that pairs link; with ``keep_cluster`` all rows and their group."""
    found = connected_components(pairs)
    out = df.join(found, df[id_column] == found["node"], "left").withColumn(cluster_column, F.coalesce("component", col(id_column))).drop("node", "component")
    return out if keep_cluster else out.where(col(id_column) == F.col(cluster_column)).drop(cluster_column)


def fuzzy_dedup(df: DataFrame, id_column: str, column: str = "text", num_hashes: int = 128, ngram: int = 2, bands: int | None = None, threshold: float = 0.7, seed: int = 1, keep_cluster: bool = False) -> DataFrame:
    """Near duplicates by MinHash; texts without words are left alone."""
    return keep_representatives(df, id_column, fuzzy_pairs(df, id_column, column, num_hashes, ngram, bands, threshold, seed), keep_cluster)


# lines


def corpus_line_dedup(df: DataFrame, id_column: str, column: str = "text", out_column: str | None = None, min_docs: int = 2, normalize: bool = True) -> DataFrame:
    """Without the lines that ``min_docs`` documents or more have; blank lines and the form of the others stay."""
    key = (lambda x: F.trim(F.lower(F.regexp_replace(x, r"(?U)\s+", " ")))) if normalize else (lambda x: x)
    lines = df.select(col(id_column).alias("id"), F.explode(F.array_distinct(F.transform(F.split(col(column), r"\R"), lambda x: F.xxhash64(key(x))))).alias("h"))
    blank = F.xxhash64(F.lit(""))
    common = lines.where(F.col("h") != blank).groupBy("h").agg(F.count_distinct("id").alias("n")).where(F.col("n") >= min_docs).select("h")
    own = lines.join(common, "h", "left_semi").groupBy("id").agg(F.collect_set("h").alias("__gone"))
    joined = df.join(own.withColumnRenamed("id", "__id"), F.col("__id").eqNullSafe(col(id_column)), "left")
    kept = F.array_join(F.filter(F.split(col(column), r"\R"), lambda x: ~F.array_contains("__gone", F.xxhash64(key(x)))), "\n")
    return joined.withColumn(out_column or column, F.when(F.col("__gone").isNull(), col(column)).otherwise(kept)).drop("__gone", "__id")


# substrings


def _windows(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of k tokens between white space of every text, and offsets."""
    codes, first = kernels.points(texts)
    s, e, wfirst = kernels.runs((kernels.classes()[codes] & kernels.SPACE) == 0, first)
    words = kernels.slices(codes, s, e)
    count = np.maximum(np.diff(wfirst) - k + 1, 0)
    hfirst = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(hfirst[-1]) + np.repeat(wfirst[:-1] - hfirst[:-1], count)
    return kernels.slices(words, at, at + k), hfirst


def _anchored(texts: pa.Array, k: int) -> tuple[np.ndarray, ...]:
    """Hashes of the windows of every text, offsets, and the runs of windows of one anchor: first window, length and anchor of each.

    A window's anchor is the smallest hash of the runs of k // 2 + 1 tokens in it, so that equal windows have equal anchors.
    """
    h, first = _windows(texts, k)
    inner, ifirst = _windows(texts, k // 2 + 1)
    inner = kernels.mixed(inner)
    reach, span = 1, k - k // 2  # minima of 1, 2, 4 ... and at last of all places of a window
    low = inner
    while reach < span:
        step = min(reach, span - reach)
        low = np.minimum(low[: len(low) - step], low[step:]) if len(low) > step else low[:0]
        reach += step
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    low = low[ifirst[text] + np.arange(len(h)) - first[text]] if len(h) else low[:0]
    new = np.ones(len(h), bool)
    new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    return h, first, text, head, np.diff(np.append(head, len(h))), low[head]


def substring_dedup(df: DataFrame, id_column: str, column: str = "text", out_column: str | None = None, k: int = 50) -> DataFrame:
    """Without the tokens of every window of k tokens that an earlier document or place has.

    The first (id, place) of a window stays; texts that lose nothing, shorter ones and nulls stay as they are. Windows go by
    anchors, of which a text has one for about k / 4 tokens: anchors are counted first, and only the windows of those that
    occur again are compared, packed by anchor, and then one by one.
    """
    rows = df.select(col(id_column).alias("id"), col(column).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, _, _, head, size, anchor in kernels.chunked(batch.column("text"), lambda t: _anchored(t, k)):
                run = np.repeat(np.arange(len(head)), size)
                order = np.lexsort((h, run))
                twice = np.zeros(len(head), bool)
                twice[run[order][1:][(run[order][1:] == run[order][:-1]) & (h[order][1:] == h[order][:-1])]] = True
                known, at = np.unique(anchor, return_inverse=True)
                if len(known):
                    yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(np.bincount(at, 1 + twice).astype(np.int64))], ["anchor", "n"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for h, first, text, head, size, anchor in kernels.chunked(batch.column("text"), lambda t: _anchored(t, k)):
                if len(head):
                    cut = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(head), [None, pa.py_buffer(np.append(head, len(h)).astype(np.int64) * 8), pa.py_buffer(h)])
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), batch.column("id").take(pa.array(at + text[head])), pa.array((head - first[text[head]]).astype(np.int32)), cut.cast(pa.binary())], ["anchor", "id", "pos", "hashes"])
                at += len(first) - 1

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [np.frombuffer(x.as_py(), np.int64) for x in batch.column("hashes")]
            size = np.array([len(x) for x in h], np.int64)
            if size.sum():
                which = np.repeat(np.arange(len(h)), size)
                pos = batch.column("pos").to_numpy()[which] + np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(which)), pa.array(pos.astype(np.int32)), pa.array(np.concatenate(h))], ["id", "pos", "h"])

    kind = rows.schema["id"].dataType.simpleString()
    common = rows.select("text").mapInArrow(counted, "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    likely = rows.mapInArrow(packed, f"anchor bigint, id {kind}, pos int, hashes binary").join(common, "anchor", "left_semi")
    windows = stored(likely.select("id", "pos", "hashes").mapInArrow(apart, f"id {kind}, pos int, h bigint"))
    again = windows.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("id", "pos")).alias("first")).where("n > 1").select("h", "first")
    later = windows.join(again, "h").where(F.struct("id", "pos") > F.col("first")).groupBy(F.col("id").alias("__id")).agg(F.sort_array(F.collect_list("pos")).alias("__gone"))

    def rebuild(texts: pa.Array, gone: pa.Array) -> pa.Array:
        out = []
        for t, g in zip(texts.to_pylist(), gone, strict=True):
            if t is not None and g.is_valid:
                words = t.split()
                g = g.values.to_numpy()
                drop = np.bincount(g, minlength=len(words) + 1) - np.bincount(np.minimum(g + k, len(words)), minlength=len(words) + 1)
                keep = np.cumsum(drop)[: len(words)] == 0
                t = " ".join(w for w, x in zip(words, keep.tolist(), strict=True) if x)
            out.append(t)
        return pa.array(out, pa.string())

    joined = df.join(later, F.col("__id") == col(id_column), "left")
    kept = F.when(F.col("__gone").isNull(), col(column)).otherwise(F.arrow_udf(rebuild, "string")(F.when(F.col("__gone").isNotNull(), col(column)), "__gone"))
    return joined.withColumn(out_column or column, kept).drop("__gone", "__id")


# across runs


class HashIndex:
    """Hashes of the texts of earlier runs, as Parquet files at a path."""

    def __init__(self, spark, path: str, normalize: bool = True) -> None:  # noqa: ANN001
        self.spark, self.path, self.normalize = spark, path, normalize

    def load(self) -> DataFrame:
        if exists(self.spark, self.path):
            return self.spark.read.parquet(self.path)
        return self.spark.createDataFrame([], "content_hash string")

    def contains(self, df: DataFrame, column: str = "text") -> DataFrame:
        """The rows with a column known."""
        hashed = df.withColumn("content_hash", content_hash(col(column), self.normalize))
        return hashed.join(self.load().distinct().withColumn("known", F.lit(True)), "content_hash", "left").withColumn("known", F.coalesce("known", F.lit(False))).drop("content_hash")

    def add(self, df: DataFrame, column: str = "text") -> None:
        df.where(col(column).isNotNull()).select(content_hash(col(column), self.normalize).alias("content_hash")).distinct().write.mode("append").parquet(self.path)


def incremental_dedup(df: DataFrame, index_path: str, id_column: str, column: str = "text", normalize: bool = True) -> DataFrame:
    """The first row of each text that no earlier run had; the index learns them."""
    index = HashIndex(df.sparkSession, index_path, normalize)
    fresh = stored(exact_dedup(df, id_column, column, normalize, keep_hash=True).join(index.load(), "content_hash", "left_anti"))
    fresh.select("content_hash").write.mode("append").parquet(index_path)
    return fresh.select(*df.columns)


# decontamination by coverage


def contamination(df: DataFrame, benchmark: DataFrame, id_column: str, item_column: str, column: str = "text", ngram: int = 8) -> DataFrame:
    """(id, coverage): the largest share of an item's n-grams, repeats counted, that each document holds, where there is any."""
    items = benchmark.select(col(item_column).alias("item"), F.explode(_grams(col(column), ngram)).alias("g")).groupBy("item", "g").agg(F.count("*").alias("n"))
    items = stored(items)
    total = items.groupBy("item").agg(F.sum("n").alias("total"))
    known = _known(items)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for h, first in kernels.chunked(batch.column("text"), lambda t: kernels.gram_sets(t, ngram)):
                text = np.repeat(np.arange(len(first) - 1), np.diff(first))
                if known is not None:
                    table = known.value
                    where = np.minimum(np.searchsorted(table, h), max(len(table) - 1, 0))
                    hit = table[where] == h if len(table) else np.zeros(len(h), bool)
                    h, text = h[hit], text[hit]
                if len(h):
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at + text)), pa.array(h.view(np.int64))], ["id", "g"])
                at += len(first) - 1

    rows = df.select(col(id_column).alias("id"), col(column).alias("text")).where("text IS NOT NULL")
    grams = rows.mapInArrow(hits, f"id {rows.schema['id'].dataType.simpleString()}, g bigint").distinct()
    shared = grams.join(items, "g").groupBy("id", "item").agg(F.sum("n").alias("n")).join(total, "item")
    return shared.groupBy("id").agg(F.max(F.col("n") / F.col("total")).alias("coverage"))


def _grams(x: Column, ngram: int) -> Column:
    """FNV-1a hashes of word n-grams, repeats among them."""

    def run(texts: pa.Array) -> pa.Array:
        return _lists(*kernels.gram_hashes(texts, ngram), texts.is_null())

    return by_arrow(run, "array<bigint>", x)


def _known(items: DataFrame):  # noqa: ANN202
    """The hashes of all items in order, for all workers to look up, if they are few enough; else None, and the join finds them."""
    few = items.select("g").distinct()
    if few.count() > KNOWN:
        return None
    found = few.toArrow()["g"].combine_chunks()
    return items.sparkSession.sparkContext.broadcast(np.sort(np.asarray(found).astype(np.int64).view(np.uint64)))


def contamination_ratio(df: DataFrame, benchmark: DataFrame, column: str = "text", ngram: int = 8, out_column: str = "contamination") -> DataFrame:
    """The share of each text's n-grams, repeats counted, that the benchmark has; 0 for a text without any and for null."""
    known = _known(benchmark.select(F.explode(_grams(col(column), ngram)).alias("g")))
    if known is None:
        raise ValueError(f"the benchmark has more than {KNOWN} n-grams")

    def run(texts: pa.Array) -> pa.Array:
        h, first = kernels.gram_hashes(texts, ngram)
        table = known.value
        hit = table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h if len(table) else np.zeros(len(h), bool)
        n = np.diff(first)
        return pa.array(np.diff(np.concatenate([[0], np.cumsum(hit)])[first]) / np.maximum(n, 1))

    return df.withColumn(out_column, by_arrow(run, "double", F.coalesce(col(column), F.lit(""))))


def decontaminate(df: DataFrame, benchmark: DataFrame, id_column: str, item_column: str, column: str = "text", ngram: int = 8, threshold: float = 0.2, reason_column: str | None = None) -> DataFrame:
    """Documents that cover at most ``threshold`` of every item; with ``reason_column`` all, with the coverage that is too high."""
    bad = contamination(df, benchmark, id_column, item_column, column, ngram).where(F.col("coverage") > threshold)
    if not reason_column:
        return df.join(bad.select(F.col("id").alias(id_column)), id_column, "left_anti").select(*(col(c) for c in df.columns))
    named = bad.select(F.col("id").alias("__id"), F.concat(F.lit("contaminated:"), F.format_number("coverage", 3)).alias(reason_column))
    return df.join(named, F.col("__id") == col(id_column), "left").drop("__id")


def duplicate_rate(df: DataFrame, column: str = "text") -> Column:
    return 1 - F.try_divide(F.count_distinct(normalized(col(column))), F.count(col(column)))


def profile(df: DataFrame, column: str = "text", langs: str | None = None) -> DataFrame:
    """One row: rows, approximate distinct texts, share of duplicates, percentiles of length by index, languages."""
    # the exact percentiles are those of counts by length, which stay few however many rows there are
    by_length = df.where(col(column).isNotNull()).groupBy(F.length(col(column)).alias("len")).agg(F.count("*").alias("n"))
    run = by_length.withColumn("upto", F.sum("n").over(Window.orderBy("len")))
    total = F.max("upto")
    cuts = run.agg(total.alias("m"), F.collect_list(F.struct("upto", "len")).alias("steps"))
    pick = lambda q: F.filter(F.array_sort("steps"), lambda s: s["upto"] > F.least(F.floor(F.lit(q) * F.col("m")), F.col("m") - 1))[0]["len"]
    cuts = cuts.select(*(pick(q).alias(f"length_p{int(100 * q)}") for q in (0.05, 0.25, 0.5, 0.75, 0.95)))
    sums = df.agg(F.count("*").alias("rows"), F.approx_count_distinct(F.xxhash64(normalized(col(column))), 0.01).alias("approx_distinct"), duplicate_rate(df, column).alias("dup_rate"))
    out = sums.crossJoin(cuts)
    if langs:
        out = out.crossJoin(df.groupBy(col(langs).alias("k")).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("languages")))
    return out


def global_shuffle(df: DataFrame, id_column: str, seed: int = 0) -> DataFrame:
    """All rows in the order of a seeded hash of their ids."""
    return df.orderBy(F.xxhash64(col(id_column), F.lit(seed)), col(id_column))

