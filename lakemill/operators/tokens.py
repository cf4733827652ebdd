"""Tokenising by bytes, packing into sequences, and shards for training."""

from __future__ import annotations

import io
import json
import tarfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakemill.functions.text import by_arrow, col
from lakemill.operators.store import stored

EOS = 256


def byte_lists(texts: pa.Array, end: int | None) -> pa.Array:
    """The bytes of every text as a list, and the end mark; no Python object per text."""
    texts = pa.concat_arrays([texts.cast(pa.large_string())])
    if not len(texts):
        return pa.array([], pa.list_(pa.int32()))
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]].astype(np.int32) if raw is not None else np.zeros(0, np.int32)
    off = off - off[0]
    if end is not None:
        data, off = np.insert(data, off[1:], end), off + np.arange(len(off))
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(data))


def split_lists(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose lists hold about ``limit`` values together, one row at least."""
    if not batch.num_rows:
        return
    part = np.cumsum(pc.fill_null(batch.column(column).value_lengths(), 0).to_numpy().astype(np.int64)) // limit
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        yield batch.slice(a, b - a)


def tokenize(df: DataFrame, column: str = "text", out_column: str = "input_ids", tokenizer: str | Callable[[str], list[int]] = "bytes", add_eos: bool = True, eos_id: int | None = None, n_tokens_column: str = "n_tokens") -> DataFrame:
    """Ids of bytes, or what a function gives, and an end mark; null text counts as empty."""
    x = F.coalesce(col(column), F.lit(""))
    if tokenizer == "bytes":
        end = (EOS if eos_id is None else eos_id) if add_eos else None

        out = by_arrow(lambda texts: byte_lists(texts, end), "array<int>", x)
    else:
        if add_eos and eos_id is None:
            raise ValueError("a tokenizer of one's own needs an eos_id")
        own = F.udf(lambda t: list(tokenizer(t)), "array<int>", useArrow=True)(x)
        out = F.concat(own, F.array(F.lit(eos_id))) if add_eos else own
    return df.withColumn(out_column, out).withColumn(n_tokens_column, F.size(out_column))


def pack_sequences(df: DataFrame, order_column: str, id_column: str = "input_ids", seq_len: int = 1024, drop_remainder: bool = True, pad_id: int = 0) -> DataFrame:
    """(seq, input_ids, doc_ids): documents one after the other by ``order_column``, cut into windows of seq_len.

    Where each slice of the order begins comes from the sums per slice. A task cuts its slice into windows by itself; only
    the pieces at both ends of a slice are shuffled. The last window is dropped, or filled with pad_id and document -1.
    """
    docs = df.select(col(order_column).alias("o"), col(id_column).alias("ids")).where("size(ids) > 0")
    ranged = stored(docs.repartitionByRange("o").sortWithinPartitions("o").select("ids", F.spark_partition_id().alias("p")))
    per = ranged.groupBy("p").agg(F.sum(F.size("ids").cast("bigint")).alias("n"), F.count("*").alias("d")).orderBy("p").collect()  # a row per partition
    starts, at, doc = {}, 0, 0
    for r in per:
        starts[r["p"]] = (at, doc)
        at, doc = at + r["n"], doc + r["d"]
    element = ranged.schema["ids"].dataType.elementType.simpleString()

    def cut(whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Whole windows, or the pieces of others, of a slice."""

        def rows(at: int, ids: np.ndarray, docs: np.ndarray, size: int) -> pa.RecordBatch:
            n = len(ids) // size
            first = pa.array(np.arange(n + 1) * size, pa.int32())
            seq = at // seq_len + np.arange(n)
            return pa.RecordBatch.from_arrays([pa.array(seq), pa.array(at + np.arange(n) * size), pa.ListArray.from_arrays(first, pa.array(ids)), pa.ListArray.from_arrays(first, pa.array(docs))], ["seq", "at", "input_ids", "doc_ids"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = None
            for batch in (part for b in batches for part in split_lists(b, "ids")):
                if at is None:
                    at, doc = starts[batch.column("p")[0].as_py()]
                    kept, owner = None, None
                lists = batch.column("ids")
                size = lists.value_lengths().to_numpy()
                ids, docs = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(doc + np.arange(len(size)), size)
                doc += len(size)
                if kept is not None:
                    ids, docs = np.concatenate([kept, ids]), np.concatenate([owner, docs])
                head = min(-at % seq_len, len(ids))
                if head and not whole:
                    yield rows(at, ids[:head], docs[:head], head)
                at, ids, docs = at + head, ids[head:], docs[head:]
                full = len(ids) // seq_len * seq_len
                if full and whole:
                    yield rows(at, ids[:full], docs[:full], seq_len)
                at, kept, owner = at + full, ids[full:], docs[full:]
            if at is not None and len(kept) and not whole:
                yield rows(at, kept, owner, len(kept))

        return run

    kind = f"seq bigint, at bigint, input_ids array<{element}>, doc_ids array<bigint>"
    pieces = ranged.mapInArrow(cut(False), kind).groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("at", "input_ids", "doc_ids"))).alias("x"))
    joined = pieces.select("seq", *(F.flatten(f"x.{c}").alias(c) for c in ("input_ids", "doc_ids")))
    if drop_remainder:
        joined = joined.where(F.size("input_ids") == seq_len)
    else:
        fill = lambda c, v: F.concat(c, F.array_repeat(F.lit(v), F.lit(seq_len) - F.size(c)))
        joined = joined.select("seq", fill("input_ids", pad_id).cast(f"array<{element}>").alias("input_ids"), fill("doc_ids", -1).cast("array<bigint>").alias("doc_ids"))
    return ranged.mapInArrow(cut(True), kind).drop("at").unionByName(joined)


# shards


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A file at any URL that Hadoop can write."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        for i in range(0, len(data), 1 << 20):
            out.write(bytearray(data[i : i + (1 << 20)]))
    finally:
        out.close()


def numbered(df: DataFrame, order_column: str, rows_per_shard: int) -> DataFrame:
    """The rows with __shard and __row, by the order: positions from counts per slice of it."""
    ranged = df.repartitionByRange(order_column).withColumn("__p", F.spark_partition_id())
    ranged = stored(ranged)
    w = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("__p").count().select("__p", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("__b"))
    at = F.col("__b") + F.row_number().over(Window.partitionBy("__p").orderBy(order_column)) - 1
    return ranged.join(F.broadcast(before), "__p").withColumn("__row", at).withColumn("__shard", F.floor(at / rows_per_shard).cast("int")).drop("__p", "__b")


def _write_groups(df: DataFrame, keys: str, body: Callable[[pa.Table, int], list[tuple[str, bytes]]], folder: str) -> list[tuple]:
    """Files of each shard, each written by the task that holds the shard to a folder that executors share; (name, rows, bytes)."""
    local = folder.removeprefix("file://")
    if "://" in local:
        raise ValueError("shards of own formats are written to mounted folders; write Parquet for other stores")

    def run(t: pa.Table) -> pa.Table:
        import os

        os.makedirs(local, exist_ok=True)
        shard = t["__shard"][0].as_py()
        out = []
        for name, data in body(t.sort_by("__row"), shard):
            part = os.path.join(local, f".{name}.{os.getpid()}")
            with open(part, "wb") as f:
                f.write(data)
            os.replace(part, os.path.join(local, name))  # whole or not at all, also when a task runs twice
            out.append((name, t.num_rows, len(data)))
        return pa.table({"name": pa.array([o[0] for o in out]), "rows": pa.array([o[1] for o in out], pa.int64()), "bytes": pa.array([o[2] for o in out], pa.int64())})

    return sorted(tuple(r) for r in df.groupBy(keys).applyInArrow(run, "name string, rows bigint, bytes bigint").collect())


def write_sharded_parquet(df: DataFrame, folder: str, order_column: str, rows_per_shard: int = 100_000, prefix: str = "shard") -> list[tuple]:
    """prefix-00000.parquet and so on, rows_per_shard rows each."""
    import pyarrow.parquet as pq

    def body(t: pa.Table, shard: int) -> list[tuple[str, bytes]]:
        sink = io.BytesIO()
        pq.write_table(t.drop(["__shard", "__row"]), sink)
        return [(f"{prefix}-{shard:05d}.parquet", sink.getvalue())]

    return _write_groups(numbered(df, order_column, rows_per_shard), "__shard", body, folder)


def write_webdataset(df: DataFrame, folder: str, key_column: str, rows_per_shard: int = 10_000, text_columns: list[str] | None = None, binary_columns: dict[str, str] | None = None) -> list[tuple]:
    """Tar shards: of each row its texts as .txt, its binaries by their extensions, the rest as .json."""
    texts, binaries = text_columns or [], binary_columns or {}

    def body(t: pa.Table, shard: int) -> list[tuple[str, bytes]]:
        sink = io.BytesIO()
        with tarfile.open(fileobj=sink, mode="w") as tar:
            for row in t.drop(["__shard", "__row"]).to_pylist():
                key = str(row[key_column])
                members = [(f"{key}.{'txt' if len(texts) == 1 else c + '.txt'}", (row[c] or "").encode()) for c in texts]
                members += [(f"{key}.{e}", row[c] or b"") for c, e in binaries.items()]
                members.append((f"{key}.json", json.dumps({k: v for k, v in row.items() if k not in texts and k not in binaries}, default=str, sort_keys=True).encode()))
                for name, data in members:
                    info = tarfile.TarInfo(name)
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))
        return [(f"shard-{shard:05d}.tar", sink.getvalue())]

    return _write_groups(numbered(df, key_column, rows_per_shard), "__shard", body, folder)


def write_mds(df: DataFrame, folder: str, order_column: str, rows_per_shard: int = 50_000, prefix: str = "shard") -> dict:
    """Parquet shards and an index.json that lists them."""
    files = write_sharded_parquet(df, folder, order_column, rows_per_shard, prefix)
    index = {"version": 1, "format": "parquet", "columns": dict(df.dtypes), "shards": [{"name": n, "rows": r, "bytes": b} for n, r, b in files], "rows": sum(r for _, r, _ in files)}
    write_bytes(df.sparkSession, f"{folder}/index.json", json.dumps(index, indent=1).encode())
    return index


SLICE_TOKENS = 1 << 24


def sliced(df: DataFrame, order_column: str, column: str, rows_per_shard: int) -> tuple[DataFrame, dict[int, int], dict[tuple[int, int], int]]:
    """(p, ids) in slices of the order of some SLICE_TOKENS, sorted, each in one task; the first row of each slice, and in which token of a shard its part of the shard begins.

    Places come from the keys and lengths alone, so that the lists are shuffled once and never stored.
    """
    keys = stored(df.select(col(order_column).alias("o"), F.coalesce(F.size(col(column)), F.lit(0)).alias("n")).withColumn("n", F.greatest("n", F.lit(0)).cast("bigint")))
    total = keys.agg(F.sum(F.col("n") + 16)).first()[0] or 0
    count = -(-total // SLICE_TOKENS) or 1
    ranged = keys.select("o").repartitionByRange(count, "o").withColumn("p", F.spark_partition_id())
    bounds = [r["o"] for r in ranged.groupBy("p").agg(F.min("o").alias("o")).orderBy("p").collect()[1:] if r["o"] is not None] if count > 1 else []  # a row per slice
    limits = F.array(*(F.lit(b) for b in bounds))
    at = lambda o: F.size(F.filter(limits, lambda b: b <= o)) if bounds else F.lit(0)
    first, row = {}, 0
    for r in keys.groupBy(at(F.col("o")).alias("p")).count().orderBy("p").collect():
        first[r["p"]] = row
        row += r["count"]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, row = -1, 0
        for b in batches:
            size, slices = b.column("n").to_numpy(), b.column("p").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(slices)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if slices[i] != p:
                    p = int(slices[i])
                    row = first[p]
                shards = (row + np.arange(j - i)) // rows_per_shard
                each, where = np.unique(shards, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(each), p)), pa.array(each), pa.array(np.add.reduceat(size[i:j], where))], ["p", "shard", "n"])
                row += j - i

    narrow = keys.withColumn("p", at(F.col("o"))).repartition("p").sortWithinPartitions("p", "o", "n")
    begins: dict[tuple[int, int], int] = {}
    now, token = None, 0
    for r in narrow.mapInArrow(parts, "p bigint, shard bigint, n bigint").groupBy("shard", "p").agg(F.sum("n").alias("n")).orderBy("shard", "p").collect():  # a row per slice and shard
        if r["shard"] != now:
            now, token = r["shard"], 0
        begins[r["p"], r["shard"]] = token
        token += r["n"]
    x = df.select(col(order_column).alias("o"), col(column).alias("ids"))
    size = F.greatest(F.coalesce(F.size("ids"), F.lit(0)), F.lit(0))
    return x.withColumn("p", at(F.col("o"))).withColumn("n", size).repartition(count, "p").sortWithinPartitions("p", "o", "n").select("p", "ids"), first, begins


def _write_flat(df: DataFrame, folder: str, order_column: str, column: str, dtype: str, rows_per_shard: int, name: str) -> list[tuple]:
    """Flat .bin files and .idx.json files: each task writes its slice where it belongs in the shards' files, which then get their names."""
    local = folder.removeprefix("file://")
    if "://" in local:
        raise ValueError("shards of own formats are written to mounted folders; write Parquet for other stores")
    frame, first, begins = sliced(df, order_column, column, rows_per_shard)
    kind, run_id = np.dtype(dtype).newbyteorder("<"), uuid.uuid4().hex
    part = lambda shard: f"{local}/.{name}-{shard:05d}.bin.{run_id}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.makedirs(local, exist_ok=True)
        p, row, token = -1, 0, {}
        for b in batches:
            for b in split_lists(b, "ids"):
                lists, slices = b.column("ids"), b.column("p").to_numpy()
                ends = np.concatenate([[0], np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy().astype(np.int64))])
                ids = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
                i = 0
                while i < len(slices):
                    if slices[i] != p:
                        p = int(slices[i])
                        row = first[p]
                    shard, inside = divmod(row, rows_per_shard)
                    j = min(i + rows_per_shard - inside, int(np.searchsorted(slices, p, "right")))
                    at = token.pop((p, shard), begins[p, shard])
                    with open(os.open(part(shard), os.O_CREAT | os.O_WRONLY, 0o644), "wb") as f:
                        f.seek(at * kind.itemsize)
                        f.write(ids[ends[i] : ends[j]].tobytes())
                    token[p, shard] = at + int(ends[j] - ends[i])
                    where = at + ends[i + 1 : j + 1] - ends[i]
                    yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([inside]), pa.array([where], pa.list_(pa.int64()))], ["shard", "row", "ends"])
                    row += j - i
                    i = j

    def finish(t: pa.Table) -> pa.Table:
        import os

        shard = t["shard"][0].as_py()
        ends = t.sort_by("row")["ends"].combine_chunks().flatten().to_pylist()
        tokens = ends[-1] if ends else 0
        index = json.dumps({"dtype": dtype, "tokens": tokens, "documents": len(ends), "ends": ends}).encode()
        own, to = f"{local}/.{name}-{shard:05d}.idx.json.{os.getpid()}", f"{local}/{name}-{shard:05d}"
        if os.path.exists(part(shard)):  # else this task has run before
            os.replace(part(shard), f"{to}.bin")
        with open(own, "wb") as f:
            f.write(index)
        os.replace(own, f"{to}.idx.json")
        return pa.table({"name": [f"{name}-{shard:05d}.bin", f"{name}-{shard:05d}.idx.json"], "rows": pa.array([len(ends)] * 2, pa.int64()), "bytes": pa.array([tokens * kind.itemsize, len(index)], pa.int64())})

    placed = stored(frame.mapInArrow(write, "shard bigint, row bigint, ends array<bigint>"))
    placed.count()  # all slices are written before a file gets its name
    return sorted(tuple(r) for r in placed.groupBy("shard").applyInArrow(finish, "name string, rows bigint, bytes bigint").collect())


def write_token_shards(df: DataFrame, folder: str, order_column: str, column: str = "input_ids", dtype: str = "int32", rows_per_shard: int = 100_000) -> list[tuple]:
    """Flat little-endian .bin files and .idx.json files with where documents end."""
    return _write_flat(df, folder, order_column, column, dtype, rows_per_shard, "tokens")


def write_shuffled_shards(df: DataFrame, folder: str, key_column: str, column: str = "input_ids", n_shards: int = 8, dtype: str = "int32", seed: int = 0) -> list[tuple]:
    """n shards of documents in the order of a seeded hash of their keys."""
    hashed = df.select(F.xxhash64(col(key_column), F.lit(seed)).alias("__h"), col(column))
    return _write_flat(hashed, folder, "__h", column, dtype, -(-df.count() // n_shards) or 1, "shuffled")


def read_token_shard(path: str) -> list[np.ndarray]:
    """The documents of one .bin file."""
    with open(path.removesuffix(".bin") + ".idx.json") as f:
        index = json.load(f)
    ids = np.fromfile(path, np.dtype(index["dtype"]).newbyteorder("<"))
    return np.split(ids, index["ends"][:-1]) if index["ends"] else []

