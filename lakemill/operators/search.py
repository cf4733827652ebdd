"""Full-text and hybrid retrieval."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.functions import kernels
from lakemill.functions.text import by_arrow, col
from lakemill.operators.store import stored
from lakemill.operators.vectors import knn

K1, B = 1.2, 0.75


def tokenize(x: Column) -> Column:
    """Words of letters, digits and underscores, in lower case."""
    return F.regexp_extract_all(F.lower(x), F.lit(r"(?U)(\w+)"), 1)


def query_terms(query: str) -> list[str]:
    """Distinct terms of a query in their order."""
    import re

    return list(dict.fromkeys(re.findall(r"\w+", query.lower())))


def idf(n_docs: Column | float, df: Column | float) -> Column:
    n, d = (x if isinstance(x, Column) else F.lit(float(x)) for x in (n_docs, df))
    return F.greatest(F.lit(0.0), F.ln(1 + (n - d + 0.5) / (d + 0.5)))


def bm25(df: DataFrame, query: str, id_column: str, column: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """(id, score) of the documents that hold a term of the query, by corpus-wide statistics.

    One pass counts the query's terms and lengths per document, some numbers each, which statistics and scores
    read; the statistics of a query are one row of as many numbers as it has terms.
    """
    terms = query_terms(query)
    if not terms:
        return df.select(col(id_column), F.lit(0.0).alias("score")).limit(0)

    def run(texts: pa.Array) -> pa.Array:
        found = kernels.term_counts(texts, terms)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32()), pa.array(found.ravel().astype(np.int32)))

    counted = stored(df.select(col(id_column), by_arrow(run, "array<int>", F.coalesce(col(column), F.lit(""))).alias("__c")))
    length, times = F.col("__c")[0], [F.col("__c")[i + 1] for i in range(len(terms))]
    stats = counted.agg(F.count("*").alias("__n"), F.avg(length).alias("__avg"), *(F.count_if(x > 0).alias(f"__d{i}") for i, x in enumerate(times))).first()
    n, avg = stats["__n"], stats["__avg"] or 1.0
    score = F.lit(0.0)
    for i, x in enumerate(times):
        d = stats[f"__d{i}"]
        weight = max(0.0, math.log(1 + (n - d + 0.5) / (d + 0.5)))
        tf = x.cast("double")
        score = score + F.lit(weight) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.lit(float(avg))))
    return counted.where(F.greatest(*times, F.lit(0)) > 0).select(col(id_column), score.alias("score"))


def full_text_search(df: DataFrame, query: str, id_column: str, column: str = "text", k: int = 10, columns: list[str] | None = None) -> DataFrame:
    """The k best by BM25; equal scores go by id."""
    best = bm25(df, query, id_column, column).orderBy(F.desc("score"), col(id_column)).limit(k)
    return best.join(df.select(id_column, *columns), id_column) if columns else best


def rrf(*rankings: DataFrame, id_column: str, k: int = 10, rrf_k: int = 60) -> DataFrame:
    """(id, score): rankings of (id, rank from 1) joined by the sums of 1 / (rrf_k + rank)."""
    both = rankings[0]
    for r in rankings[1:]:
        both = both.unionByName(r)
    return both.groupBy(id_column).agg(F.sum(1 / (F.lit(rrf_k) + F.col("rank"))).alias("score")).orderBy(F.desc("score"), col(id_column)).limit(k)


def hybrid_search(df: DataFrame, text_query: str, vector_query: list[float], id_column: str, text_column: str = "text", vector_column: str = "embedding", k: int = 10, rrf_k: int = 60, metric: str = "cosine") -> DataFrame:
    """The 2k best of the text and of the vector search, joined by reciprocal ranks."""
    from pyspark.sql import Window

    text = full_text_search(df, text_query, id_column, text_column, 2 * k).select(id_column, F.row_number().over(Window.orderBy(F.desc("score"), col(id_column))).alias("rank"))
    near = knn(df, vector_column, vector_query, 2 * k, metric, id_column).select(id_column, F.row_number().over(Window.orderBy("_distance", col(id_column))).alias("rank"))
    return rrf(text, near, id_column=id_column, k=k, rrf_k=rrf_k)


#: Tokens that are counted at once.
TOKENS = 1 << 20


def postings(df: DataFrame, id_column: str, column: str = "text") -> DataFrame:
    """(term, id, tf, length): an inverted index, to be written by term. Each row's words are counted where they are read; a row has its own postings, so ids are unique."""
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(b.column("w").is_valid())
            ends = np.cumsum(pc.list_value_length(b.column("w")).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < b.num_rows:
                # as many rows as hold TOKENS, one at least
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + TOKENS, "right")))
                rows = b.slice(lo, hi - lo)
                length = pc.list_value_length(rows.column("w")).to_numpy(zero_copy_only=False).astype(np.int64)
                words = rows.column("w").flatten().dictionary_encode()
                row = np.repeat(np.arange(len(rows)), length)
                # by term, then row: lines of one term lie together
                key, tf = np.unique(words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(rows) + row, return_counts=True)
                at = key % len(rows)
                yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(key // len(rows))), rows.column("id").take(pa.array(at)), pa.array(tf.astype(np.int64)), pa.array(length[at].astype(np.int32))], ["term", "id", "tf", "length"])
                lo = hi

    found = df.select(col(id_column).alias("id"), tokenize(col(column)).alias("w")).mapInArrow(run, f"term string, id {kind}, tf bigint, length int")
    return found.select("term", F.col("id").alias(id_column), "tf", "length")


class TextIndex:
    """Postings at a path, in folders by a hash of the term, of which a search reads those of its terms."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets

    @classmethod
    def build(cls, df: DataFrame, path: str, id_column: str, column: str = "text", buckets: int = 64) -> TextIndex:
        rows = postings(df, id_column, column).withColumnRenamed(id_column, "id").withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)))
        rows.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        df.select(F.size(tokenize(F.coalesce(col(column), F.lit("")))).alias("n")).agg(F.count("*").alias("docs"), F.avg("n").alias("length")).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
        return cls(df.sparkSession, path, buckets)

    def search(self, query: str, k: int = 10) -> DataFrame:
        terms = query_terms(query)
        n, avg = self.spark.read.parquet(f"{self.path}/stats").first()
        which = self.spark.createDataFrame([(t,) for t in terms] or [("",)], "t string").select(F.pmod(F.xxhash64("t"), F.lit(self.buckets))).distinct()
        rows = self.spark.read.parquet(f"{self.path}/postings").where(F.col("bucket").isin([r[0] for r in which.collect()]) & F.col("term").isin(terms))
        weight = rows.groupBy("term").agg(idf(float(n), F.count("*").cast("double")).alias("w"))
        tf = F.col("tf").cast("double")
        part = F.col("w") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.lit(float(avg or 1))))
        return rows.join(F.broadcast(weight), "term").groupBy("id").agg(F.sum(part).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def search_then_sql(spark: SparkSession, sql: str, candidates: dict[str, DataFrame]) -> DataFrame:
    """SQL over retrieved candidates by the names that they get for this statement."""
    import re

    text = sql.replace("{", "{{").replace("}", "}}")
    for name in candidates:
        text = re.sub(rf"(?<![\w.`]){re.escape(name)}(?!\w)", "{" + name + "}", text)
    return spark.sql(text, **candidates)


def register_search(df: DataFrame, name: str, column: str, query: list[float], k: int = 100, id_column: str | None = None) -> None:
    knn(df, column, query, k, id_column=id_column).createOrReplaceTempView(name)


def register_fts(df: DataFrame, name: str, query: str, id_column: str, column: str = "text", k: int = 100) -> None:
    full_text_search(df, query, id_column, column, k).createOrReplaceTempView(name)


def hybrid_analytical(df: DataFrame, sql: str, id_column: str, vector_query: list[float] | None = None, text_query: str | None = None, vector_column: str = "embedding", text_column: str = "text", k: int = 500, name: str = "hits", metric: str = "cosine") -> DataFrame:
    """SQL over the rows that a vector search, a text search or both retrieve, under ``name``; with their score."""
    if vector_query is not None and text_query is not None:
        found = hybrid_search(df, text_query, vector_query, id_column, text_column, vector_column, k, metric=metric)
    elif text_query is not None:
        found = full_text_search(df, text_query, id_column, text_column, k)
    elif vector_query is not None:
        found = knn(df, vector_column, vector_query, k, metric, id_column).select(id_column, (1 - F.col("_distance")).alias("score"))
    else:
        raise ValueError("a vector, a text or both have to be asked for")
    return search_then_sql(df.sparkSession, sql, {name: df.join(found, id_column)})
