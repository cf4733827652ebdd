"""Reading tables and moving them through Arrow, shared by the training-data operators."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemill.llm import kernel

#: Labelled rows that a classifier is fitted on at most.
TRAIN_ROWS = 12_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    """The cluster's shuffle partition count, which its administrator lets grow with the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def by_chunk(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: T.StructType | str, text: str = "text", limit: int = kernel.CHUNK_BYTES) -> DataFrame:
    """``fn`` over slices of about ``limit`` bytes of the column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.split(batch, text, limit):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """The batch with the column of that name replaced, its type kept."""
    i = batch.schema.get_field_index(name)
    return batch.set_column(i, batch.schema.field(i), values.cast(batch.schema.field(i).type))


def with_text(batch: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
    """The batch with new texts and, where there is such a column, their lengths in n_chars."""
    batch = with_column(batch, "text", texts)
    if "n_chars" in batch.schema.names:
        batch = with_column(batch, "n_chars", pc.utf8_length(texts))
    return batch


def lists(flat: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array of the slices of ``flat`` that the offsets ``first`` bound."""
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(flat, kind))


def labelled(docs: DataFrame, labels: DataFrame, label: str, bound: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, y): at most ``bound`` labelled documents in the order of a hash of their ids.

    Rows without id, text or label are left out; of several labels of a document the highest counts, of several
    texts the first in order. The broadcast side and the result have ``bound`` rows at most whatever the input.
    """
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )
    found = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def fixed(df: DataFrame) -> DataFrame:
    """The rows of a result that later steps read more than once, computed once.

    With a checkpoint folder, which all executors share, they are written there; without one, as in
    tests, they are cached with the lineage kept, so a lost block is computed again.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    out = df.checkpoint()
    # the shuffle files behind a checkpoint go once nothing refers to them, which a collection finds out
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out
