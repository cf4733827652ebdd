"""Pipelines of stages over Arrow tables, and over relations by shards.

A stage is a function from table to table; over a DataFrame it runs batch by batch in the tasks, with the rows of
``batch_size`` at a time. ``cpus`` and ``gpus`` become a resource profile of the step where the cluster knows such.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.functions import text as tx
from lakemill.operators import media
from lakemill.relation import Relation


class ArrowStage:
    """Base of stages: ``process`` of a table, or ``apply`` of a DataFrame where Spark has the operator itself."""

    def __init__(self, cpus: float = 1.0, gpus: float = 0.0, batch_size: int = 1024) -> None:
        self.cpus, self.gpus, self.batch_size = cpus, gpus, batch_size

    def process(self, table: pa.Table) -> pa.Table:
        raise NotImplementedError

    def schema(self, df: DataFrame) -> Any:
        """The schema of what ``process`` gives; by default that of the input."""
        return df.schema

    def apply(self, df: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(0, b.num_rows, self.batch_size):
                    yield from self.process(pa.Table.from_batches([b.slice(i, self.batch_size)])).combine_chunks().to_batches()

        return df.mapInArrow(run, self.schema(df), profile=self.profile(df.sparkSession))

    def profile(self, spark: SparkSession) -> Any:
        """A resource profile, where more than a core is asked for and the cluster can give it."""
        if (self.cpus, self.gpus) == (1.0, 0.0) or spark.sparkContext.master.startswith("local"):
            return None
        wanted = TaskResourceRequests().cpus(max(1, int(self.cpus)))
        return ResourceProfileBuilder().require(wanted.resource("gpu", self.gpus) if self.gpus else wanted).build


class MapBatchesStage(ArrowStage):
    def __init__(self, fn: Callable[[pa.Table], pa.Table], schema: str | None = None, **settings: Any) -> None:
        super().__init__(**settings)
        self.fn, self.ddl = fn, schema

    def process(self, table: pa.Table) -> pa.Table:
        return self.fn(table)

    def schema(self, df: DataFrame) -> Any:
        return self.ddl or df.schema


class LoadFilesStage(ArrowStage):
    """The bytes of the files that a column names."""

    def __init__(self, path_column: str = "path", out_column: str = "data", **settings: Any) -> None:
        super().__init__(**settings)
        self.path_column, self.out_column = path_column, out_column

    def apply(self, df: DataFrame) -> DataFrame:
        return media.url_download(df, self.path_column, self.out_column)


class DecodeStage(ArrowStage):
    """Images, sounds, documents or videos from bytes."""

    def __init__(self, kind: str, column: str = "data", cpus: float = 1.0, gpus: float = 0.0, **decoder: Any) -> None:
        super().__init__(cpus, gpus)
        by = {"image": media.decode_images, "audio": media.decode_audio, "document": media.decode_documents, "video": media.explode_video}
        if kind not in by:
            raise ValueError(f"unknown kind {kind!r}; known are {', '.join(by)}")
        self.fn, self.column, self.decoder = by[kind], column, decoder

    def apply(self, df: DataFrame) -> DataFrame:
        return self.fn(df, self.column, **self.decoder)


class _Step(ArrowStage):
    fn: Callable[..., DataFrame]

    def __init__(self, cpus: float = 1.0, **settings: Any) -> None:
        super().__init__(cpus)
        self.settings = settings

    def apply(self, df: DataFrame) -> DataFrame:
        return type(self).fn(df, **self.settings)


class ChunkStage(_Step):
    fn = staticmethod(tx.chunk_text)


class QualityFilterStage(_Step):
    fn = staticmethod(tx.quality_filter)


class ContentHashStage(_Step):
    fn = staticmethod(tx.add_content_hash)


def relation_to_shards(source: Relation | DataFrame, num_shards: int | None = None, rows_per_shard: int | None = None) -> list[DataFrame]:
    """The rows divided by a hash of all columns into as many DataFrames."""
    df = source.frame if isinstance(source, Relation) else source
    n = num_shards or (-(-df.count() // rows_per_shard) if rows_per_shard else df.rdd.getNumPartitions()) or 1
    part = F.pmod(F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in df.columns)), F.lit(n))
    return [df.where(part == i) for i in range(n)]


class RelationPipeline:
    """Stages over a relation, lazily; all of it at once, or shard by shard."""

    def __init__(self, source: Relation | DataFrame, num_shards: int | None = None, rows_per_shard: int | None = None) -> None:
        self.source, self.stages = source.frame if isinstance(source, Relation) else source, []
        self.num_shards, self.rows_per_shard = num_shards, rows_per_shard

    from_source = classmethod(lambda cls, source, **settings: cls(source, **settings))

    def add(self, stage: ArrowStage) -> RelationPipeline:
        self.stages.append(stage)
        return self

    def load_files(self, path_column: str = "path", out_column: str = "data") -> RelationPipeline:
        return self.add(LoadFilesStage(path_column, out_column))

    def decode(self, kind: str, column: str = "data", **decoder: Any) -> RelationPipeline:
        return self.add(DecodeStage(kind, column, **decoder))

    def map_batches(self, fn: Callable[[pa.Table], pa.Table], schema: str | None = None, **settings: Any) -> RelationPipeline:
        return self.add(MapBatchesStage(fn, schema, **settings))

    def chunk(self, **settings: Any) -> RelationPipeline:
        return self.add(ChunkStage(**settings))

    def quality_filter(self, **settings: Any) -> RelationPipeline:
        return self.add(QualityFilterStage(**settings))

    def content_hash(self, **settings: Any) -> RelationPipeline:
        return self.add(ContentHashStage(**settings))

    def _through(self, df: DataFrame) -> DataFrame:
        for s in self.stages:
            df = s.apply(df)
        return df

    def to_relation(self) -> Relation:
        return Relation(self._through(self.source))

    def run(self) -> pa.Table:
        return self.to_relation().to_arrow()

    def run_streaming(self) -> Iterator[pa.Table]:
        """The result of one shard after the other; one at a time is on the driver."""
        for shard in relation_to_shards(self.source, self.num_shards, self.rows_per_shard):
            yield self._through(shard).toArrow()

    def write_streaming(self, path: str, fmt: str = "parquet") -> int:
        """Each shard as a folder of its own, written before the next begins; how many there are."""
        shards = relation_to_shards(self.source, self.num_shards, self.rows_per_shard)
        for i, shard in enumerate(shards):
            self._through(shard).write.format(fmt).mode("overwrite").save(f"{path}/shard={i:05d}")
        return len(shards)


class Pipeline:
    """Stages over a table in this process, in order."""

    def __init__(self, input_data: pa.Table, stages: list[ArrowStage]) -> None:
        self.input_data, self.stages = input_data, stages

    def run(self) -> pa.Table:
        table = self.input_data
        for s in self.stages:
            parts = [s.process(table.slice(i, s.batch_size)) for i in range(0, table.num_rows, s.batch_size)]
            table = pa.concat_tables(parts) if parts else s.process(table)
        return table


def streaming_transform(relation: Relation, sql: str = "SELECT * FROM part", batch_size: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Batches of a statement over the relation under the name ``part``, as they are needed."""
    return (b for b in relation.query("part", sql).record_batch_stream(batch_size) if b.num_rows)
