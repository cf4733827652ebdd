"""Readers that Spark doesn't have by itself, and thin ones over those it has."""

from __future__ import annotations

import gzip
import io
import os
import re
from collections.abc import Callable, Iterator
from typing import Any, BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from lakemill.dialect import spark_type
from lakemill.operators.store import scratch

_CSV = {
    "sep": "sep", "delimiter": "sep", "delim": "sep", "header": "header", "quotechar": "quote", "quote": "quote", "escapechar": "escape", "escape": "escape", "na_values": "nullValue", "nullstr": "nullValue",
    "encoding": "encoding", "date_format": "dateFormat", "dateformat": "dateFormat", "timestamp_format": "timestampFormat", "timestampformat": "timestampFormat", "comment": "comment", "lineterminator": "lineSep", "new_line": "lineSep",
    "max_line_size": "maxCharsPerColumn", "compression": None, "parallel": None, "sample_size": None, "all_varchar": None, "auto_detect": None, "ignore_errors": None, "normalize_names": None, "filename": None, "null_padding": None, "multiline": None,
    "hive_partitioning": None, "union_by_name": None, "decimal": None, "skiprows": None, "skip": None, "dtype": None, "dtypes": None, "names": None, "columns": None,
}
EXTENSIONS = {
    "image": (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".webp", ".ppm"), "audio": (".wav", ".mp3", ".flac", ".ogg", ".m4a"),
    "video": (".mp4", ".mov", ".avi", ".mkv", ".webm"), "document": (".pdf", ".txt", ".md", ".html", ".docx"),
}


def read_csv(spark: SparkSession, path: Any, **options: Any) -> DataFrame:
    """CSV files by path, list or glob, or a file-like object, which is written to a file first.

    Names of options are those of pandas or of the SQL reader. ``skiprows`` leaves out the first lines of
    every file; ``dtype`` is a list of types in order or a dict by name; ``names`` gives the columns.
    """
    if unknown := options.keys() - _CSV.keys():
        raise ValueError(f"unknown CSV options: {sorted(unknown)}")
    if hasattr(path, "read"):
        data = path.read()
        data = data.encode() if isinstance(data, str) else data
        path = scratch(spark, "upload") + ".csv"
        fs, p = _path(spark, path)
        out = fs.create(p, True)
        try:
            for i in range(0, len(data), 1 << 20):
                out.write(bytearray(data[i : i + (1 << 20)]))
        finally:
            out.close()
    header = options.get("header", True)
    settings = {"header": bool(header), "inferSchema": not options.get("all_varchar", False), "multiLine": options.get("multiline", True), "quote": '"', "escape": '"', "nanValue": "nan", "mode": "DROPMALFORMED" if options.get("ignore_errors") else "FAILFAST" if options.get("null_padding") is False else "PERMISSIVE"}
    settings |= {_CSV[k]: v for k, v in options.items() if _CSV[k] and not isinstance(v, bool) and k != "header"}
    skip = int(options.get("skiprows", options.get("skip", 0)) or 0)
    names, kinds = options.get("names", options.get("columns")), options.get("dtype", options.get("dtypes"))
    if skip:
        lines = spark.read.text(path, wholetext=True)
        cut = lines.select(F.array_join(F.slice(F.split("value", r"\r?\n"), skip + 1, 1 << 30), "\n").alias("v"))
        rows = cut.select(F.explode(F.filter(F.split("v", "\n"), lambda x: x != "")).alias("value"))
        # Spark's reader of strings leaves out every line that equals the first, the header, if there is one
        df = spark.read.options(**{k: v for k, v in settings.items() if k != "multiLine"}).csv(rows.rdd.map(lambda r: r[0]))
    else:
        df = spark.read.options(**settings).csv(path)
    if not header and not names:
        df = df.toDF(*(f"column{i}" for i in range(len(df.columns))))
    if names:
        df = df.toDF(*list(names)[: len(df.columns)], *df.columns[len(names) :])
    if kinds:
        by = kinds if isinstance(kinds, dict) else dict(zip(df.columns, kinds, strict=False))
        df = df.select(*(F.col(f"`{c}`").cast(spark_type(by[c])).alias(c) if c in by else F.col(f"`{c}`") for c in df.columns))
    if options.get("normalize_names"):
        df = df.toDF(*(re.sub(r"\W+", "_", c).strip("_").lower() for c in df.columns))
    return df.withColumn("filename", F.input_file_name()) if options.get("filename") else df


def read_hive(spark: SparkSession, path: str, hive_partitioning: bool = True, union_by_name: bool = False) -> DataFrame:
    """Parquet under key=value folders; the keys are columns by which whole folders are left out."""
    reader = spark.read.option("mergeSchema", str(union_by_name).lower())
    base = re.split(r"/(?=[^/]*[*?\[{])", path)[0] if re.search(r"[*?\[{]", path) else path
    if hive_partitioning:
        return reader.option("basePath", base).parquet(path)
    return reader.option("recursiveFileLookup", "true").parquet(base)


def read_any(spark: SparkSession, url: str, fmt: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Parquet, CSV or JSON from any URL that Hadoop can read; .gz, .bz2 and .zst are unpacked."""
    kind = fmt or next((k for k in ("parquet", "csv", "json", "orc") if re.search(rf"\.{k}(\.(gz|bz2|zst))?$", url)), "parquet")
    reader = spark.read.option("header", True).option("inferSchema", True) if kind == "csv" else spark.read
    df = reader.format(kind).load(url)
    return df.select(*columns) if columns else df


def _path(spark: SparkSession, url: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(url)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def glob(spark: SparkSession, url: str) -> list[str]:
    fs, p = _path(spark, url)
    return sorted(s.getPath().toString() for s in fs.globStatus(p) or [])


def exists(spark: SparkSession, url: str) -> bool:
    fs, p = _path(spark, url)
    return fs.exists(p)


def read_bytes(spark: SparkSession, url: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(url).select("content").first()[0])


def detect_format(spark: SparkSession, path: str) -> str:
    """versioned, iceberg, hive, parquet, csv, json or unknown, by what lies at a path."""
    if exists(spark, f"{path}/_manifest"):
        return "versioned"
    if exists(spark, f"{path}/metadata") and exists(spark, f"{path}/data"):
        return "iceberg"
    names = [os.path.basename(p) for p in glob(spark, f"{path}/*")] or [os.path.basename(path)]
    if any("=" in n for n in names):
        return "hive"
    for kind in ("parquet", "csv", "json"):
        if any(re.search(rf"\.{kind}(\.(gz|bz2|zst))?$", n) for n in names):
            return kind
    return "unknown"


def list_files(spark: SparkSession, inputs: str | list[str], exts: tuple[str, ...] | None = None, content: bool = False) -> DataFrame:
    """(path, length, modified) of files by folder, glob or list; with their bytes on demand."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(inputs)
    if exts:
        df = df.where(F.lower("path").rlike("(" + "|".join(re.escape(e) for e in exts) + ")$"))
    return df.select("path", "length", F.col("modificationTime").alias("modified"), *(["content"] if content else []))


def media_files(spark: SparkSession, kind: str, inputs: str | list[str], content: bool = True) -> DataFrame:
    """Image, audio, video or document files."""
    return list_files(spark, inputs, EXTENSIONS[kind], content)


# WARC


def warc_records(file: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of a WARC file, its members packed by gzip or not; one record is in memory at a time."""
    file = io.BufferedReader(file) if not isinstance(file, (io.BufferedReader, io.BytesIO)) else file
    head = file.read(2)
    file.seek(0)
    if head == b"\x1f\x8b":
        file = gzip.GzipFile(fileobj=file)
    while line := file.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := file.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        yield fields, file.read(int(fields.get("content-length", 0)))


_WARC = "path string, record_id string, type string, url string, date string, content_type string, content binary"


def read_warc(spark: SparkSession, url: str, record_type: str | None = "response", text: bool = False, limit: int | None = None) -> DataFrame:
    """(path, record_id, type, url, date, content_type, content) of the records of WARC files; a task per file.

    Of HTTP responses the body is the content and its own header gives the type. With ``text`` the content is
    plain text from HTML. Files on a folder that executors mount are read record by record; those of other
    stores come as Spark reads them, whole. ``limit`` is the number of records of a file that are read at most.
    """
    schema = to_arrow_schema(T.StructType.fromDDL(_WARC))

    def records(path: str, content: bytes | None) -> Iterator[dict]:
        with open(path.removeprefix("file:"), "rb") if content is None else io.BytesIO(content) as file:
            n = 0
            for head, body in warc_records(file):
                kind = head.get("warc-type")
                if record_type and kind != record_type:
                    continue
                content_type = head.get("content-type")
                if body[:5] == b"HTTP/" and b"\r\n\r\n" in body:
                    http, body = body.split(b"\r\n\r\n", 1)
                    m = re.search(rb"(?im)^content-type:\s*([^\r\n]+)", http)
                    content_type = m[1].decode("latin-1").strip() if m else None
                yield {"path": path, "record_id": head.get("warc-record-id"), "type": kind, "url": head.get("warc-target-uri"), "date": head.get("warc-date"), "content_type": content_type, "content": body}
                n += 1
                if n == limit:
                    return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = batch.column("content") if "content" in batch.schema.names else [None] * batch.num_rows
            for path, content in zip(batch.column("path").to_pylist(), contents, strict=True):
                rows, size = [], 0
                for r in records(path, None if content is None else content.as_py()):
                    rows.append(r)
                    size += len(r["content"])
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = list_files(spark, url)
    mounted = url.startswith("/") or url.startswith("file:")
    files = files.select("path").repartition(max(1, len(files.inputFiles()))) if mounted else spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(url).select("path", "content")
    out = files.mapInArrow(run, _WARC)
    if not text:
        return out
    from lakemill.functions.text import html_to_text

    return html_to_text(out.withColumn("content", F.decode("content", "UTF-8")), "content", "text").drop("content")


# generators as sources


class _Task(InputPartition):
    def __init__(self, fn: Callable[[], Iterator[Any]]) -> None:
        self.fn = fn


def generator_source(name: str, schema: str, tasks: list[Callable[[], Iterator[Any]]]) -> type[DataSource]:
    """A data source whose partitions are callables that give Arrow batches or rows; register it by ``spark.dataSource.register``."""
    kind = schema

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [_Task(t) for t in tasks]

        def read(self, partition: _Task) -> Iterator[Any]:
            for x in partition.fn():
                yield from x.to_batches() if isinstance(x, pa.Table) else [x]

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return kind

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return Reader()

    return Source


def read_generators(spark: SparkSession, schema: str, tasks: list[Callable[[], Iterator[Any]]], name: str = "lakemill_generators") -> DataFrame:
    spark.dataSource.register(generator_source(name, schema, tasks))
    return spark.read.format(name).load()
