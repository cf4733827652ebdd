"""The corpus pipeline: quality, near duplicates, decontamination, secrets, byte-level BPE.

Each stage reads what its predecessor wrote as Parquet. All but the last return the columns of documents,
further columns among them, whatever their names.

Defined results: an empty table gives no rows. A null text has the features of an empty one for the
classifier, no near duplicate, no passage and no secret, and null ids; an empty text an empty list of ids.
Rows without doc_id are never near duplicates; rows that repeat a doc_id stay or go together there. Texts
are read whole, however long.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lakemill.llm import bpe, decontaminate, ngram_join, quality, secrets
from lakemill.llm.frames import table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it is fitted on labelled documents of the input table, and without labels of both kinds keeps all."""
    return quality.keep(docs, quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays, that with the smallest id."""
    return ngram_join.deduplicate(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; a text that was nothing else stays, without its words."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return secrets.redact(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    return bpe.round_trip(docs)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", remove_benchmark),
    ("secrets", redact_secrets),
    ("byte_bpe", tokenise),
]

#: SQL has no expression for the classifier, the network and the byte-pair merges.
ORACLE_SQL = None


def _shared(spark: SparkSession) -> str:
    """The folder that all executors share; where none is set, on one machine alone, the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir")
    return folder


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's files go once the next one is written; those that the result reads stay in the shared folder."""
    folder = f"{_shared(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            _delete(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
