"""Queries of scans, sinks, changes to tables, versions, functions, media and streams: what goes through each has to come back.

Tables are written whole to a folder of their own beside the checkpoints and read by the operator that the query is named for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill import connection as cn
from lakemill import expressions as ex
from lakemill import sources, streaming
from lakemill.connection import Connection
from lakemill.functions import ai, udf
from lakemill.functions import text as tx
from lakemill.operators import dedup, media, search, tokens, vectors
from lakemill.operators.store import scratch, stored
from lakemill.plans import stages
from lakemill.plans.catalog import Catalog, Flow, Metrics, dataset_lineage, pipeline_signature
from lakemill.plans.curation import _BM25, _COS, _D, _NORM, _QSQL, Q, docs, emb, greedy_sql
from lakemill.plans.registry import query
from lakemill.relation import Relation
from lakemill.sources.versioned import Dataset


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"


def passes(name: str, sql: str = _ORDERS) -> Callable[[Callable], Callable]:
    """Registers a function (spark, sf_dir, folder) that gives a table back."""

    def add(fn: Callable[[SparkSession, str, str], DataFrame]) -> Callable:
        query(name, sql)(lambda spark, sf_dir: fn(spark, sf_dir, scratch(spark, name)))
        return fn

    return add


# scans


@passes("read_csv")
def read_csv(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    Relation(orders(spark, sf_dir)).to_csv(at)
    return Connection(spark).read_csv(at, dtype={"o_orderkey": "BIGINT", "o_custkey": "BIGINT"}).frame


@passes("csv_options")
def csv_options(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    orders(spark, sf_dir).withColumn("o_orderstatus", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus"))).write.csv(at, sep="|", quote="'", escape="'", nullValue="none", header=False)
    back = Connection(spark).read_csv(at, sep="|", quotechar="'", na_values="none", header=False, names=["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"], dtype=["BIGINT", "BIGINT", "VARCHAR", "DOUBLE", "VARCHAR"])
    return back.frame.withColumn("o_orderstatus", F.coalesce("o_orderstatus", F.lit("F")))


@passes("from_csv_auto")
def from_csv_auto(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    cn.write_csv(Connection(spark), orders(spark, sf_dir), at)
    out = Connection(spark).from_csv_auto(at).frame
    return out.select(F.col("o_orderkey").cast("bigint"), F.col("o_custkey").cast("bigint"), "o_orderstatus", "o_totalprice", "o_orderpriority")


@passes("read_json")
def read_json(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    orders(spark, sf_dir).write.json(at)
    return Connection(spark).read_json(at).frame


@passes("read_parquet")
def read_parquet(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    Relation(orders(spark, sf_dir)).to_parquet(at)
    return Connection(spark).read_parquet(at).frame


@passes("from_parquet")
def from_parquet(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    Relation(orders(spark, sf_dir).where("o_orderstatus = 'F'")).write_parquet(f"{at}/a")
    Relation(orders(spark, sf_dir).where("o_orderstatus <> 'F'")).write_parquet(f"{at}/b")
    return Connection(spark).from_parquet([f"{at}/a", f"{at}/b"]).frame


@passes("read_hive")
def read_hive(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    Relation(orders(spark, sf_dir)).to_parquet(at, partition_by=["o_orderstatus"])
    return Connection(spark).read_hive(f"{at}/*").frame


@passes("read_hive_union", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS o_totalprice FROM orders")
def read_hive_union(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    """Folders whose files have other columns, joined by name."""
    o = orders(spark, sf_dir)
    o.where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_totalprice").write.parquet(f"{at}/s=1")
    o.where("o_orderstatus <> 'F'").select("o_custkey", "o_orderkey").write.parquet(f"{at}/s=2")
    return sources.read_hive(spark, at, union_by_name=True).drop("s").select("o_orderkey", "o_custkey", "o_totalprice")


@passes("distributed_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000")
def distributed_scan(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    return Connection(spark).read_parquet(f"{sf_dir}/orders.parquet").filter("o_totalprice > 100000").project("o_orderkey, o_totalprice").frame


@passes("from_arrow", "SELECT * FROM nation")
def from_arrow(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    return Connection(spark).from_arrow(table(spark, sf_dir, "nation").toArrow()).frame


@passes("from_df", "SELECT * FROM region")
def from_df(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    return Connection(spark).from_df(table(spark, sf_dir, "region").toPandas()).frame


@passes("df_scan", "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0")
def df_scan(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").toArrow()  # found by the statement below
    assert suppliers.num_rows >= 0
    return Connection(spark).sql("SELECT s_suppkey, s_name FROM suppliers WHERE s_acctbal > 0").frame


@passes("register")
def register(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    con = Connection(spark).register("lakemill_orders", orders(spark, sf_dir))
    out = con.sql("SELECT * FROM lakemill_orders").frame
    con.unregister("lakemill_orders")
    return out


@query("unregister", "SELECT false AS there")
def unregister(spark: SparkSession, sf_dir: str) -> DataFrame:
    Connection(spark).register("lakemill_gone", orders(spark, sf_dir)).unregister("lakemill_gone")
    return spark.range(1).select(F.lit(spark.catalog.tableExists("lakemill_gone")).alias("there"))


@passes("to_table")
def to_table(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    name = f"t_{at[-12:]}"
    Relation(orders(spark, sf_dir)).to_table(name)
    return Connection(spark).table(name).frame


@passes("to_view")
def to_view(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    Relation(orders(spark, sf_dir)).create_view(f"v_{at[-12:]}")
    return Connection(spark).view(f"v_{at[-12:]}").frame


@query("table_function_sql", "SELECT i AS id FROM range(3, 90, 4) AS t(i)")
def table_function_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Connection(spark).table_function("range", [3, 90, 4]).frame


@passes("read_any_packed")
def read_any_packed(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    orders(spark, sf_dir).write.csv(at, header=True, compression="gzip")
    out = sources.read_any(spark, at, "csv")
    return out.select(F.col("o_orderkey").cast("bigint"), F.col("o_custkey").cast("bigint"), "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("glob_and_exists", "SELECT 1 AS files, true AS there, false AS other")
def glob_and_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, there, other = len(sources.glob(spark, f"{sf_dir}/regio?.parquet")), sources.exists(spark, f"{sf_dir}/nation.parquet"), sources.exists(spark, f"{sf_dir}/none.parquet")
    return spark.range(1).select(F.lit(n).alias("files"), F.lit(there).alias("there"), F.lit(other).alias("other"))


@passes("read_bytes", "SELECT 'PAR1' AS head, 3000000 AS size")
def read_bytes(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    """Three megabytes that ``write_bytes`` wrote."""
    tokens.write_bytes(spark, f"{at}/x.bin", b"PAR1" + b"\x00\xff" * 1_499_998)
    data = sources.read_bytes(spark, f"{at}/x.bin")
    return spark.range(1).select(F.lit(data[:4].decode()).alias("head"), F.lit(len(data)).alias("size"))


@query("detect_format", "SELECT * FROM (VALUES ('csv', 'csv'), ('hive', 'hive'), ('json', 'json'), ('parquet', 'parquet'), ('versioned', 'versioned')) AS t(written, found)")
def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, at = table(spark, sf_dir, "nation"), scratch(spark, "detect")
    n.write.csv(f"{at}/csv")
    n.write.json(f"{at}/json")
    n.write.parquet(f"{at}/parquet")
    n.write.partitionBy("n_regionkey").parquet(f"{at}/hive")
    Dataset(spark, f"{at}/versioned").write(n)
    return spark.createDataFrame([(k, sources.detect_format(spark, f"{at}/{k}")) for k in ("csv", "hive", "json", "parquet", "versioned")], "written string, found string")


@passes("read_warc", "SELECT url, html AS content, 'text/html' AS content_type FROM pages")
def read_warc(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    """All pages as responses of WARC files, with a request record before each that isn't read."""
    body = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"), F.col("html"))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: request\r\nContent-Length: 3\r\n\r\nGET\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.col("url"), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    table(spark, sf_dir, "pages").select(F.concat(head, body).alias("value")).write.option("lineSep", "\r\n\r\n").text(at)
    return sources.read_warc(spark, at).select("url", F.decode("content", "UTF-8").alias("content"), "content_type")


@query("read_generators", "SELECT i % 4 AS task, i AS v FROM range(0, 4000) AS t(i)")
def read_generators(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rows(k: int) -> Iterator[pa.Table]:
        yield pa.table({"task": pa.array([k] * 1000, pa.int64()), "v": pa.array(range(k, 4000, 4), pa.int64())})

    return sources.read_generators(spark, "task bigint, v bigint", [partial(rows, k) for k in range(4)])


@passes("list_files", "SELECT 3 AS images, 4 AS files")
def list_files(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    for name in ("a.png", "b/c.PNG", "d.jpg", "e.txt"):
        tokens.write_bytes(spark, f"{at}/{name}", b"x")
    return spark.range(1).select(F.lit(sources.media_files(spark, "image", at).count()).alias("images"), F.lit(sources.list_files(spark, at).count()).alias("files"))


@query("media_files", "SELECT * FROM (VALUES ('image', 1), ('audio', 2), ('video', 1), ('document', 3)) AS t(kind, files)")
def media_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark, "media")
    for name in ("a.webp", "b.wav", "c.flac", "d.mp4", "e.pdf", "f.md", "g.html", "h.bin"):
        tokens.write_bytes(spark, f"{at}/{name}", b"x")
    return spark.createDataFrame([(k, sources.media_files(spark, k, at, content=False).count()) for k in sources.EXTENSIONS], "kind string, files int")


# sinks and changes


@passes("insert_into", f"{_ORDERS} UNION ALL {_ORDERS}")
def insert_into(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    name, o = f"t_{at[-12:]}", Relation(orders(spark, sf_dir))
    o.create(name)
    o.insert_into(name)
    return spark.table(name)


@passes("insert_values", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 90, 'O''Brien' UNION ALL SELECT 91, NULL")
def insert_values(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    name, con = f"t_{at[-12:]}", Connection(spark)
    Relation(table(spark, sf_dir, "region")).create(name)
    con.insert(name, [90, "O'Brien"])
    con.insert(name, [91, None])
    return spark.table(name)


@passes("update_rows", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM orders")
def update_rows(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    name = f"t_{at[-12:]}"
    Relation(orders(spark, sf_dir)).create(name)
    Connection(spark).update(name, {"o_orderstatus": "X", "o_totalprice": ex.ColumnExpression("o_totalprice") * 2}, "o_orderstatus = 'F'")
    return spark.table(name)


def _shards(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    tokens.write_sharded_parquet(orders(spark, sf_dir), at, "o_orderkey", 4000)
    return spark.read.parquet(at)


passes("write_sharded_parquet")(_shards)


@passes("sharded_sizes", "SELECT printf('shard-%05d.parquet', k // 4000) AS name, count(*) AS rows, min(o_orderkey) AS low, max(o_orderkey) AS high FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders) GROUP BY k // 4000")
def sharded_sizes(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    tokens.write_sharded_parquet(orders(spark, sf_dir), at, "o_orderkey", 4000)
    return spark.read.parquet(at).groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name")).agg(F.count("*").alias("rows"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))


@passes("write_mds", "SELECT (SELECT count(*) FROM orders) AS rows, (SELECT ceil(count(*) / 5000) FROM orders)::BIGINT AS shards, (SELECT count(*) FROM orders) AS listed")
def write_mds(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    tokens.write_mds(orders(spark, sf_dir), at, "o_orderkey", 5000)
    index = spark.read.json(f"{at}/index.json", multiLine=True)
    return index.select("rows", F.size("shards").cast("bigint").alias("shards"), F.aggregate(F.col("shards.rows"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("listed"))


@passes("write_webdataset", "SELECT doc_id, text, lang, source FROM documents")
def write_webdataset(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    """Tar shards of all documents, read again member by member."""
    tokens.write_webdataset(docs(spark, sf_dir), at, "doc_id", 300, text_columns=["text"])

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import tarfile

        for batch in batches:
            for data in batch.column("content"):
                with tarfile.open(fileobj=io.BytesIO(data.as_py())) as tar:
                    got = [(m.name, tar.extractfile(m).read().decode()) for m in tar]
                yield pa.RecordBatch.from_pydict({"name": [n for n, _ in got], "data": [d for _, d in got]})

    m = sources.list_files(spark, at, (".tar",), content=True).select("content").mapInArrow(members, "name string, data string")
    m = m.select(F.split("name", r"\.")[0].cast("bigint").alias("doc_id"), F.split("name", r"\.")[1].alias("kind"), "data")
    info = m.where("kind = 'json'").select("doc_id", F.get_json_object("data", "$.lang").alias("lang"), F.get_json_object("data", "$.source").alias("source"))
    return m.where("kind = 'txt'").select("doc_id", F.col("data").alias("text")).join(info, "doc_id").select("doc_id", "text", "lang", "source")


def _token_rows(spark: SparkSession, at: str) -> DataFrame:
    """(n, md5) of every document of token shards, read back by tasks, some million tokens of a shard at a time."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for batch in batches:
            for path, index in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                ends = np.array(json.loads(index)["ends"], np.int64)
                cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] + 1, 1 << 22))).tolist() if len(ends) else [0]
                for a, b in zip(cuts, [*cuts[1:], len(ends)], strict=True):
                    yield pa.RecordBatch.from_pydict({"path": [path], "first": [int(ends[a - 1]) if a else 0], "ends": pa.array([ends[a:b]], pa.list_(pa.int64()))})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        import re

        for batch in batches:
            for path, first, ends in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), batch.column("ends"), strict=True):
                ends = ends.values.to_numpy()
                if not len(ends):
                    continue
                ids = np.fromfile(re.sub("^file:/+", "/", path).removesuffix(".idx.json") + ".bin", "<i4", int(ends[-1]) - first, offset=4 * first)
                if len(ids) != ends[-1] - first:
                    raise ValueError(f"{path}: the shard is shorter than its index says")
                parts = np.split(ids, ends[:-1] - first)
                yield pa.RecordBatch.from_pydict({"n": [len(p) for p in parts], "h": [hashlib.md5(bytes(p[:-1].astype(np.uint8))).hexdigest() for p in parts]})

    indexes = sources.list_files(spark, f"{at}/*.idx.json", content=True).select("path", "content")  # a filter by ending would read the others too
    return indexes.mapInArrow(pieces, "path string, first bigint, ends array<bigint>").repartition(spark.sparkContext.defaultParallelism * 4).mapInArrow(read, "n bigint, h string")


_TOKEN_ROWS = "SELECT strlen(text) + 1 AS n, md5(text) AS h FROM documents"


@passes("write_token_shards", _TOKEN_ROWS)
def write_token_shards(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    tokens.write_token_shards(tokens.tokenize(docs(spark, sf_dir)), at, "doc_id", rows_per_shard=300)
    return _token_rows(spark, at)


@passes("write_shuffled_shards", _TOKEN_ROWS)
def write_shuffled_shards(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    tokens.write_shuffled_shards(tokens.tokenize(docs(spark, sf_dir)), at, "doc_id", n_shards=5)
    return _token_rows(spark, at)


# relations


def rel(spark: SparkSession, sf_dir: str, name: str = "orders") -> Relation:
    return Relation(table(spark, sf_dir, name))


_SIMPLE: dict[str, tuple[Callable[[Relation], Relation], str]] = {
    "where": (lambda r: r.where("o_totalprice > 200000 AND o_orderstatus <> 'F'"), f"{_ORDERS} WHERE o_totalprice > 200000 AND o_orderstatus <> 'F'"),
    "select": (lambda r: r.select("o_orderkey, o_totalprice * 2 AS twice", "upper(o_orderpriority) AS p"), "SELECT o_orderkey, o_totalprice * 2 AS twice, upper(o_orderpriority) AS p FROM orders"),
    "select_dtypes": (lambda r: r.select_dtypes(["BIGINT", "DOUBLE"]), "SELECT o_orderkey, o_custkey, o_totalprice FROM orders"),
    "select_types": (lambda r: r.select_types(["VARCHAR"]), "SELECT o_orderstatus, o_orderpriority FROM orders"),
    "set_alias": (lambda r: r.set_alias("x").filter("x.o_custkey > 100").project("x.o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_custkey > 100"),
    "with_column": (lambda r: r.with_column("tax", "o_totalprice * 0.5"), "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, o_totalprice * 0.5 AS tax FROM orders"),
    "query_view": (lambda r: r.query("mine", "SELECT o_custkey, count(*) AS n FROM mine GROUP BY o_custkey"), "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey"),
    "sort": (lambda r: r.sort("o_totalprice DESC, o_orderkey").limit(50), f"{_ORDERS} ORDER BY o_totalprice DESC, o_orderkey LIMIT 50"),
    "limit_offset": (lambda r: r.order("o_orderkey").limit(40, 1000), f"{_ORDERS} ORDER BY o_orderkey LIMIT 40 OFFSET 1000"),
    "repartition": (lambda r: r.repartition(5, "o_custkey"), _ORDERS), "local_exchange": (lambda r: r.local_exchange(2), _ORDERS),
    "explode": (lambda r: r.project("o_orderkey, split(o_orderpriority, '-') AS part").explode("part"), "SELECT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS part FROM orders"),
    "rank_dense": (lambda r: r.rank_dense("PARTITION BY o_orderstatus ORDER BY o_orderpriority", "o_orderkey, o_orderstatus").project("o_orderkey, o_orderstatus, `dense_rank()` AS v"), "SELECT o_orderkey, o_orderstatus, dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS v FROM orders"),
    "isnull": (lambda r: r.project("o_orderkey, nullif(o_orderstatus, 'F') AS s").filter(ex.ColumnExpression("s").isnull()).project("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'"),
    "isnotnull": (lambda r: r.project("o_orderkey, nullif(o_orderstatus, 'F') AS s").filter(ex.ColumnExpression("s").isnotnull()).project("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'"),
    "star": (lambda r: r.project(ex.StarExpression()), _ORDERS), "star_text": (lambda r: r.project("*"), _ORDERS),
    "order_asc": (lambda r: r.project("o_orderkey, nullif(o_orderstatus, 'F') AS s").order(ex.ColumnExpression("s").asc()).limit(3).project("count(*) OVER () AS n, s IS NULL AS gone"), "SELECT 3::BIGINT AS n, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') < i AS gone FROM range(1, 4) AS t(i)"),
    "order_nulls_first": (lambda r: r.project("o_orderkey, nullif(o_orderstatus, 'F') AS s").order(ex.ColumnExpression("s").nulls_first()).limit(20).project("s"), "SELECT nullif(o_orderstatus, 'F') AS s FROM orders ORDER BY s NULLS FIRST LIMIT 20"),
    "order_nulls_last": (lambda r: r.project("o_orderkey, nullif(o_orderstatus, 'F') AS s").order(ex.ColumnExpression("s").nulls_last()).limit(20).project("s"), "SELECT nullif(o_orderstatus, 'F') AS s FROM orders ORDER BY s NULLS LAST LIMIT 20"),
    "order_desc": (lambda r: r.project("o_totalprice").order(ex.ColumnExpression("o_totalprice").desc()).limit(20), "SELECT o_totalprice FROM orders ORDER BY o_totalprice DESC LIMIT 20"),
    "flat_map": (lambda r: r.project("o_orderkey").flat_map(lambda b: pa.Table.from_batches([b, b])), "SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM orders"),
    "map_batches_small": (lambda r: r.project("o_orderkey").map_batches(lambda b: pa.RecordBatch.from_pydict({"most": [b.num_rows]}), "most bigint", batch_size=100).query("x", "SELECT max(most) AS most, sum(most) AS n FROM x"), "SELECT 100 AS most, count(*)::BIGINT AS n FROM orders"),
    "transform_step": (lambda r: r.transform(lambda d, n: d.where(F.col("o_custkey") > n), 50), f"{_ORDERS} WHERE o_custkey > 50"),
    "execute_once": (lambda r: r.execute(), _ORDERS),
}
for _name, (_call, _sql) in _SIMPLE.items():

    def _simple(spark: SparkSession, sf_dir: str, call: Callable = _call) -> DataFrame:
        return call(Relation(orders(spark, sf_dir))).frame

    query(f"relation_{_name}", _sql)(_simple)


def facts(name: str, sql: str) -> Callable[[Callable], Callable]:
    """Registers a function that gives a dict of single values, as one row."""

    def add(fn: Callable[[SparkSession, str], dict]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return spark.range(1).select(*(F.lit(v).alias(k) for k, v in fn(spark, sf_dir).items()))

        query(name, sql)(run)
        return fn

    return add


@facts("plans", "SELECT true AS scanned, true AS pushed, true AS tree, true AS json, 1 AS stages")
def plans(spark: SparkSession, sf_dir: str) -> dict:
    r = Relation(orders(spark, sf_dir)).filter("o_totalprice > 100").aggregate("o_custkey, count(*) AS n", "o_custkey")
    text = r.explain()
    return {"scanned": "parquet" in text, "pushed": "GreaterThan(o_totalprice,100.0)" in text.split("PushedFilters", 1)[-1].split("\n")[0], "tree": "Aggregate" in r.plan_tree(), "json": len(r.plan_json()) > 2, "stages": r.stages()}


@facts("shapes", "SELECT (SELECT count(*) FROM orders) AS rows, 5 AS columns, 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderpriority' AS names, 'bigint,bigint,string,double,string' AS types, 3 AS parts")
def shapes(spark: SparkSession, sf_dir: str) -> dict:
    r = Relation(orders(spark, sf_dir))
    rows, columns = r.shape
    assert rows == r.num_rows() == len(r)
    return {"rows": rows, "columns": columns, "names": ",".join(r.columns), "types": ",".join(r.types), "parts": r.repartition(3).num_partitions()}


@facts("fetching", "SELECT count(*) AS all_rows, min(n_nationkey)::BIGINT AS first_key, 3 AS many, count(*) AS frame, count(*) AS arrow, count(*) AS numpy, count(*) AS streamed, count(*) AS read, 7 AS chunk FROM nation")
def fetching(spark: SparkSession, sf_dir: str) -> dict:
    r = Relation(table(spark, sf_dir, "nation").orderBy("n_nationkey"))
    first = r.fetchone()[0]
    return {
        "all_rows": len(r.fetchall()), "first_key": int(first), "many": len(r.fetchmany(3)), "frame": len(r.df()), "arrow": r.to_arrow().num_rows, "numpy": len(r.fetchnumpy()["n_name"]),
        "streamed": sum(b.num_rows for b in r.record_batch_stream(10)), "read": r.to_arrow_reader().read_all().num_rows, "chunk": len(r.fetch_df_chunk(7)),
    }


@passes("fetched_rows", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def fetched_rows(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    """Rows that came through the cursor, batch by batch."""
    batches = [b for b in Relation(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")).fetch_record_batch(7) if b.num_rows]
    return Connection(spark).from_arrow(pa.Table.from_batches(batches)).frame


@passes("executemany", "SELECT i AS a, 'n' || i AS b FROM range(1, 5) AS t(i)")
def executemany(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    con, name = Connection(spark), f"t_{at[-12:]}"
    con.execute_batch(f"CREATE TABLE {name} (a BIGINT, b STRING) USING parquet; INSERT INTO {name} VALUES (1, 'n1')")
    con.executemany(f"INSERT INTO {name} VALUES (?, ?)", [[i, f"n{i}"] for i in (2, 3, 4)])
    return con.sql(f"SELECT * FROM {name}").frame


@facts("cursors", "SELECT 2::BIGINT AS one, 5 AS all_rows, 25::BIGINT AS bound, true AS fresh")
def cursors(spark: SparkSession, sf_dir: str) -> dict:
    con = cn.connect()
    one = con.execute("SELECT cast(1 + 1 AS bigint)").fetchone()[0]
    rows = len(con.execute("SELECT * FROM range(5)").fetchall())
    bound = con.sql("SELECT cast(? * ? AS bigint) AS v", [5, 5]).fetchone()[0]
    fresh = con.duplicate().fetchall() == [] and con.cursor() is not con
    con.close()
    return {"one": one, "all_rows": rows, "bound": bound, "fresh": fresh}


@facts("type_names", "SELECT 'array<int>' AS list, 'array<double>' AS fixed, 'struct<a:bigint,b:string>' AS struct, 'map<string,int>' AS map, 'bigint' AS plain")
def type_names(spark: SparkSession, sf_dir: str) -> dict:
    c = Connection
    kind = lambda t: spark.sql(f"SELECT cast(NULL AS {t}) AS x").dtypes[0][1]
    return {"list": kind(c.list_type("INTEGER")), "fixed": kind(c.array_type("DOUBLE", 3)), "struct": kind(c.struct_type({"a": "BIGINT", "b": "VARCHAR"})), "map": kind(c.map_type("VARCHAR", "INTEGER")), "plain": kind(c.sqltype("BIGINT"))}


_MODULE = {
    "project_df": (lambda c, d: cn.project_df(c, d, "o_orderkey, o_totalprice + 1 AS v"), "SELECT o_orderkey, o_totalprice + 1 AS v FROM orders"), "filter_df": (lambda c, d: cn.filter_df(c, d, "o_custkey > 40"), f"{_ORDERS} WHERE o_custkey > 40"),
    "order_df": (lambda c, d: cn.order_df(c, d, "o_orderkey DESC").limit(9), f"{_ORDERS} ORDER BY o_orderkey DESC LIMIT 9"), "distinct_df": (lambda c, d: cn.distinct_df(c, d.select("o_orderstatus")), "SELECT DISTINCT o_orderstatus FROM orders"),
    "alias_df": (lambda c, d: cn.alias_df(c, d, "z").project("z.o_orderkey"), "SELECT o_orderkey FROM orders"),
}
for _name, (_call, _sql) in _MODULE.items():
    query(_name, _sql)(lambda spark, sf_dir, call=_call: call(Connection(spark), orders(spark, sf_dir)).frame)


@query("sample_rows_within", "SELECT true AS near, 500::BIGINT AS exact")
def sample_rows_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = Relation(table(spark, sf_dir, "lineitem"))
    n, part, exact = o.num_rows(), o.sample("20%", 3).num_rows(), o.sample("reservoir(500)").num_rows()
    return spark.range(1).select(F.lit(abs(part - 0.2 * n) < 6 * (0.16 * n) ** 0.5).alias("near"), F.lit(exact).cast("bigint").alias("exact"))


@query("approximate_distinct", "SELECT true AS near")
def approximate_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = dedup.profile(docs(spark, sf_dir)).select("approx_distinct").crossJoin(docs(spark, sf_dir).agg(F.count_distinct(tx.normalized(F.col("text"))).alias("n")))
    return p.select((F.abs(F.col("approx_distinct") / F.col("n") - 1) < 0.05).alias("near"))


# functions of one's own


@query("function_removed", "SELECT true AS gone")
def function_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    con = Connection(spark)
    con.create_function("lakemill_once", lambda x: x, ["BIGINT"], "BIGINT")
    con.remove_function("lakemill_once")
    return spark.range(1).select(F.lit(not spark.catalog.functionExists("lakemill_once")).alias("gone"))


@query("function_nulls", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL WHEN o_orderstatus = 'O' THEN NULL ELSE length(o_orderstatus) END AS plain, CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END AS special FROM orders")
def function_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    def picky(s: str) -> int:
        if s == "O":
            raise ValueError(s)
        return len(s)

    con = Connection(spark)
    con.create_function("lakemill_picky", picky, ["VARCHAR"], "INTEGER", exception_handling="return_null")
    con.create_function("lakemill_special", lambda s: -1 if s is None else len(s), ["VARCHAR"], "INTEGER", null_handling="special")
    return Relation(orders(spark, sf_dir)).project("o_orderkey, nullif(o_orderstatus, 'F') AS s").project("o_orderkey, lakemill_picky(s) AS plain, lakemill_special(s) AS special").frame


@query("udf_func", "SELECT o_orderkey, o_custkey * 3 AS v FROM orders")
def udf_func(spark: SparkSession, sf_dir: str) -> DataFrame:
    thrice = udf.func(lambda x: 3 * x, return_dtype="BIGINT")
    return orders(spark, sf_dir).select("o_orderkey", thrice("o_custkey").alias("v"))


@query("udf_cls", "SELECT o_orderkey, o_custkey + 10 AS v FROM orders")
def udf_cls(spark: SparkSession, sf_dir: str) -> DataFrame:
    class Add:
        def __init__(self, n: int) -> None:
            self.n = n

        def __call__(self, x: int) -> int:
            return x + self.n

    return orders(spark, sf_dir).select("o_orderkey", udf.cls(Add, return_dtype="BIGINT")(10)(F.col("o_custkey")).alias("v"))


@query("udf_cls_batch", "SELECT o_orderkey FROM orders WHERE o_totalprice > 150000")
def udf_cls_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    class Above:
        def __init__(self, least: float) -> None:
            self.least = least

        def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
            import pyarrow.compute as pc

            return batch.filter(pc.greater(batch.column("o_totalprice"), self.least)).select(["o_orderkey"])

    return udf.cls_batch(Above, schema="o_orderkey bigint", batch_size=500)(150000.0)(orders(spark, sf_dir))


# models and language models, by functions that stand in for them


@query("model_filter", "SELECT doc_id FROM documents WHERE length(text) < 500")
def model_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.model_filter(docs(spark, sf_dir), lambda ts: [float(len(t)) for t in ts], threshold=500, keep="<").select("doc_id")


@query("model_setup", "SELECT doc_id, length(text) * 2.0::DOUBLE AS model_score FROM documents")
def model_setup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.model_score(docs(spark, sf_dir), lambda m, ts: [m * len(t) for t in ts], setup=lambda: 2.0).select("doc_id", "model_score")


@query("embed_text", "SELECT doc_id, length(text)::DOUBLE AS a, strlen(text)::DOUBLE AS b FROM documents")
def embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ai.embed_text(docs(spark, sf_dir), "text", lambda ts: [[float(len(t)), float(len(t.encode()))] for t in ts])
    return e.select("doc_id", F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"))


@query("classify_text", "SELECT doc_id, CASE WHEN length(text) < 200 THEN 'short' WHEN length(text) < 1000 THEN 'long' END AS label FROM documents")
def classify_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    def model(asked: list[str]) -> list[str]:
        n = [len(a) - len("Labels: short, long\nText: \nLabel:") for a in asked]
        return ["short" if x < 200 else "long" if x < 1000 else "neither" for x in n]

    return ai.classify_text(docs(spark, sf_dir), "text", ["short", "long"], model).select("doc_id", "label")


@query("prompt_text", "SELECT doc_id, 'Be brief.' || chr(10) || chr(10) || substr(text, 1, 20) AS response FROM documents")
def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ai.prompt(docs(spark, sf_dir), "text", lambda ts: [t[: 20 + len("Be brief.\n\n")] for t in ts], "Be brief.").select("doc_id", "response")


@query("extract_json", "SELECT doc_id, length(text)::INTEGER AS n, lang AS l FROM documents")
def extract_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    import json

    asked = docs(spark, sf_dir).withColumn("q", F.concat(F.coalesce("lang", F.lit("")), F.lit("\t"), F.col("text")))
    out = tx.extract(asked, "q", "n int, l string", lambda ts: ["Sure: " + json.dumps({"n": len(t.split("\t", 1)[1]), "l": t.split("\t", 1)[0]}) for t in ts])
    return out.select("doc_id", "n", "l")


@facts("retries", "SELECT 3 AS calls, 'ok' AS value, true AS none, '1,2' AS waits, true AS message")
def retries(spark: SparkSession, sf_dir: str) -> dict:
    calls, waits = [], []

    def flaky() -> str:
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return "ok"

    value = ai.retry(flaky, 5, sleep=waits.append)

    def broken() -> None:
        raise ValueError

    none = ai.retry(broken, 1, "null", sleep=lambda s: None)
    return {"calls": len(calls), "value": value, "none": none is None, "waits": ",".join(map(str, waits)), "message": '{"a": "int"}' in ai.build_system_message({"a": "int"})}


# flows, catalogs, lineage, metrics


@query("curation_flow", f"SELECT * FROM (SELECT 0 AS step, 'input' AS name, count(*) AS rows FROM documents UNION ALL SELECT 1, 'short', count(*) FROM documents WHERE strlen(text) >= 300 UNION ALL SELECT 2, 'copies', count(DISTINCT {_NORM}) FROM documents WHERE strlen(text) >= 300)")
def curation_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Flow(docs(spark, sf_dir)).step("short", tx.token_length_filter, min_tokens=300).step("copies", dedup.exact_dedup, "doc_id")
    f.df.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(i, n, r) for i, (n, r) in enumerate(f.funnel())], "step int, name string, rows bigint")


@query("catalog", "SELECT 'nations' AS table_name, * FROM (VALUES (1, 'n_nationkey', 'int'), (2, 'n_name', 'string'), (3, 'n_regionkey', 'int')) AS t(ordinal_position, column_name, data_type)")
def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark, "catalog")
    table(spark, sf_dir, "nation").write.parquet(f"{at}/nations")
    c = Catalog(spark)
    assert c.discover(at) == ["nations"] and c.validate() == {} and c.describe("nations")["format"] == "parquet"
    return c.information_schema()


@facts("catalog_stats", "SELECT count(*) AS rows, 0 AS nulls FROM customer")
def catalog_stats(spark: SparkSession, sf_dir: str) -> dict:
    c = Catalog(spark)
    c.register("customers", f"{sf_dir}/customer.parquet", "parquet")
    s = c.stats("customers")
    return {"rows": s["rows"], "nulls": sum(s["nulls"].values())}


@facts("lineage", "SELECT true AS equal, true AS other, 'run' AS label, 7 AS version")
def lineage(spark: SparkSession, sf_dir: str) -> dict:
    a, b, c = (pipeline_signature(x) for x in ({"a": 1, "b": 2}, {"b": 2, "a": 1}, {"a": 2}))
    d = dataset_lineage({"a": 1, "b": 2}, ["x"], 7, "run")
    return {"equal": a == b == d["signature"], "other": a != c, "label": d["label"], "version": d["output_version"]}


@facts("metrics", "SELECT 2 AS queries, 1 AS errors, 10 AS rows_in, 4 AS rows_out, 0.4::DOUBLE AS keep_rate, true AS text, 3 AS listed")
def metrics(spark: SparkSession, sf_dir: str) -> dict:
    m = Metrics()
    with m.query("good"):
        pass
    try:
        with m.query("bad"):
            raise ValueError
    except ValueError:
        pass
    m.curate("step", 10, 4)
    s = m.summary()
    return {**{k: s[k] for k in ("queries", "errors", "rows_in", "rows_out", "keep_rate")}, "text": "lakemill_rows_out 4" in m.prometheus_text(), "listed": len(m.audit_list()) if len(m.snapshot()) == 3 else 0}


# versioned datasets


def _versions(spark: SparkSession, sf_dir: str, at: str) -> Dataset:
    d, o = Dataset(spark, at), orders(spark, sf_dir)
    d.write(o.where("o_orderstatus = 'F'"))
    d.write(o.where("o_orderstatus <> 'F'"), "append")
    return d


_CHANGES: dict[str, tuple[Callable[[Dataset], DataFrame], str]] = {
    "write": (lambda d: d.read(), _ORDERS), "read_version": (lambda d: d.read(1), f"{_ORDERS} WHERE o_orderstatus = 'F'"), "read_filtered": (lambda d: d.read(None, ["o_orderkey"], "o_totalprice > 90000"), "SELECT o_orderkey FROM orders WHERE o_totalprice > 90000"),
    "overwrite": (lambda d: [d.write(d.read(1).limit(0), "overwrite"), d.read()][1], f"{_ORDERS} WHERE false"), "restore": (lambda d: [d.restore(1), d.read()][1], f"{_ORDERS} WHERE o_orderstatus = 'F'"),
    "tag": (lambda d: [d.create_tag("old", 1), d.write(d.read(), "append"), d.read("old")][2], f"{_ORDERS} WHERE o_orderstatus = 'F'"), "branch": (lambda d: [b := d.create_branch("dev", 1), b.write(b.read(), "append"), b.read()][2], f"{_ORDERS} WHERE o_orderstatus = 'F' UNION ALL {_ORDERS} WHERE o_orderstatus = 'F'"),
    "branch_apart": (lambda d: [d.create_branch("dev").delete("true"), d.checkout("main").read()][1], _ORDERS), "clone": (lambda d: d.shallow_clone(d.path + "-clone", 2).read(), _ORDERS),
    "merge": (lambda d: [d.merge_insert(d.read().where("o_custkey % 2 = 0").withColumn("o_orderstatus", F.lit("M")), ["o_orderkey"]), d.read()][1], "SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 2 = 0 THEN 'M' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderpriority FROM orders"),
    "delete": (lambda d: [d.delete("o_totalprice > 100000"), d.read()][1], f"{_ORDERS} WHERE o_totalprice <= 100000"), "add_columns": (lambda d: [d.add_columns({"half": "o_totalprice / 2"}), d.read(columns=["o_orderkey", "half"])][1], "SELECT o_orderkey, o_totalprice / 2 AS half FROM orders"),
    "compact": (lambda d: [d.compact(1), d.read()][1], _ORDERS), "scalar_index": (lambda d: [d.create_scalar_index("o_custkey"), d.read(where="o_custkey = 7")][1], f"{_ORDERS} WHERE o_custkey = 7"),
    "take": (lambda d: d.take([1, 2, 3, 77, 500], "o_orderkey", ["o_orderkey", "o_totalprice"]), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 2, 3, 77, 500)"),
    "sample": (lambda d: d.sample(100).groupBy().agg(F.count_distinct("o_orderkey").alias("n")), "SELECT 100::BIGINT AS n"), "cleanup": (lambda d: [d.compact(1), d.cleanup_old_versions(), d.read()][2], _ORDERS),
    "fragments": (lambda d: [d.commit_fragments([d.write_fragment(d.read(1)), d.write_fragment(d.read(1))]), d.read()][1], f"{_ORDERS} WHERE o_orderstatus = 'F' UNION ALL {_ORDERS} WHERE o_orderstatus = 'F'"),
    "list_versions": (lambda d: d.spark.createDataFrame([(v["version"], v["operation"]) for v in d.versions()], "version int, operation string"), "SELECT * FROM (VALUES (1, 'create'), (2, 'append')) AS t(version, operation)"),
    "tags": (lambda d: [d.create_tag("a"), d.create_tag("b", 1), d.delete_tag("a"), d.spark.createDataFrame([(k, v, d.epoch()) for k, v in d.tags().items()], "tag string, version int, epoch int")][3], "SELECT 'b' AS tag, 1 AS version, 2 AS epoch"),
    "branches": (lambda d: [d.create_branch("dev"), d.spark.createDataFrame([(b,) for b in d.branches()], "branch string")][1], "SELECT unnest(['dev', 'main']) AS branch"),
}
for _name, (_call, _sql) in _CHANGES.items():
    passes(f"versioned_{_name}", _sql)(lambda spark, sf_dir, at, call=_call: call(_versions(spark, sf_dir, at)))


@passes("write_versioned")
def write_versioned(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    Relation(orders(spark, sf_dir)).write_versioned(at)
    return Connection(spark).read_versioned(at).frame


# vectors and text, over what was written


_NEAREST = f"SELECT vec_id, round(1 - list_cosine_similarity({_D}, {_QSQL}), 5) AS d FROM embeddings ORDER BY 1 - list_cosine_similarity({_D}, {_QSQL}), vec_id LIMIT 10"


def _near(df: DataFrame) -> DataFrame:
    return df.select("vec_id", F.round("_distance", 5).alias("d"))


@passes("vector_index", _NEAREST)
def vector_index(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    """All clusters of an inverted file."""
    return _near(vectors.VectorIndex.build(emb(spark, sf_dir), at, "embedding", "vec_id", 8).search(Q, 10))


@passes("vector_index_appended", _NEAREST)
def vector_index_appended(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    e = emb(spark, sf_dir)
    index = vectors.VectorIndex.build(e.where("vec_id % 3 > 0"), at, "embedding", "vec_id", 8)
    index.append(e.where("vec_id % 3 = 0"))
    return _near(index.search(Q, 10))


@passes("dataset_vector_search", _NEAREST)
def dataset_vector_search(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    d = Dataset(spark, at)
    d.write(emb(spark, sf_dir))
    d.create_vector_index("embedding", "vec_id", 8, "cosine")
    assert d.list_indices() == ["embedding"]
    return _near(d.vector_search("embedding", Q, 10))


@query("vector_search_exact", _NEAREST)
def vector_search_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(vectors.VectorSearch(emb(spark, sf_dir), "embedding", "vec_id").search(Q, 10))


@passes("recall_at_k", "SELECT 1.0::DOUBLE AS whole, true AS part, 0.5::DOUBLE AS half")
def recall_at_k(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    s = vectors.VectorSearch(emb(spark, sf_dir), "embedding", "vec_id").build_index(at, 8)
    return spark.range(1).select(F.lit(s.recall_vs_exact(Q, 10)).alias("whole"), F.lit(s.recall_vs_exact(Q, 10, 4) >= 0.3).alias("part"), F.lit(vectors.recall_at_k([1, 2, 3, 4], [1, 2, 8, 9])).alias("half"))


@query("register_search", f"SELECT label, count(*) AS n FROM (SELECT label FROM embeddings ORDER BY 1 - list_cosine_similarity({_D}, {_QSQL}), vec_id LIMIT 40) GROUP BY label")
def register_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    search.register_search(emb(spark, sf_dir), "lakemill_hits", "embedding", Q, 40, "vec_id")
    return spark.sql("SELECT label, count(*) AS n FROM lakemill_hits GROUP BY label")


@query("register_fts", _BM25 + " SELECT doc_id, round(score, 6) AS score FROM score ORDER BY score DESC, doc_id LIMIT 25")
def register_fts(spark: SparkSession, sf_dir: str) -> DataFrame:
    search.register_fts(docs(spark, sf_dir), "lakemill_texts", "stupid the license", "doc_id", k=25)
    return spark.sql("SELECT doc_id, round(score, 6) AS score FROM lakemill_texts")


@query("semantic_clusters", f"""
WITH RECURSIVE alike AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND {_COS} >= 0.5),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, alike.b FROM reach JOIN alike ON alike.a = reach.b) SELECT a AS node, min(b) AS component FROM reach GROUP BY a""")
def semantic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.semantic_clusters(emb(spark, sf_dir), "vec_id", threshold=0.5).select("node", "component")


# across runs


@passes("incremental_dedup", f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {_NORM}")
def incremental_dedup(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    """Two halves by id, one after the other: what both give together is the first of each text."""
    d = docs(spark, sf_dir)
    middle = d.agg(F.expr("percentile(doc_id, 0.5)")).first()[0]
    first = stored(dedup.incremental_dedup(d.where(F.col("doc_id") <= middle), at, "doc_id").select("doc_id"))
    return first.union(dedup.incremental_dedup(d.where(F.col("doc_id") > middle), at, "doc_id").select("doc_id"))


@passes("hash_index", f"SELECT doc_id, {_NORM} IN (SELECT {_NORM} FROM documents WHERE lang = 'en') AS known FROM documents")
def hash_index(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    index, d = dedup.HashIndex(spark, at), docs(spark, sf_dir)
    index.add(d.where("lang = 'en'"))
    return index.contains(d).select("doc_id", "known")


@query("optimal_lsh_bands", "SELECT * FROM (VALUES (0.5, true), (0.7, true), (0.8, true), (0.9, true)) AS t(threshold, least)")
def optimal_lsh_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether no other number of bands has less false positives and negatives together, by a finer sum."""

    def cost(b: int, t: float) -> float:
        s, r = np.linspace(0, 1, 4001), 128 // b
        caught = 1 - (1 - s**r) ** b
        return float(caught[s <= t].sum() + (1 - caught[s > t]).sum()) / 4001

    rows = []
    for t in (0.5, 0.7, 0.8, 0.9):
        b, _ = dedup.optimal_lsh_bands(t, 128)
        rows.append((t, cost(b, t) <= min(cost(x, t) for x in range(1, 129)) + 2e-3))
    return spark.createDataFrame(rows, "threshold double, least boolean").withColumn("threshold", F.col("threshold").cast("decimal(2,1)"))


# media, made here from the keys of nations


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.udf("binary", useArrow=True)
    def paint(i: int) -> bytes:
        y, x = np.mgrid[0:24, 0:32]
        return media.encode_png(np.stack([(x * 7 + i * 31) % 256, (y * 9 + i * 17) % 256, (x * y + i) % 256], axis=-1).astype(np.uint8))

    return table(spark, sf_dir, "nation").select("n_nationkey", paint("n_nationkey").alias("image"))


def _sizes(df: DataFrame) -> DataFrame:
    return df.select("n_nationkey", *(F.col(f"t.{c}").alias(c) for c in ("height", "width", "channels")), F.length("t.data").alias("size"))


_IMAGES = {
    "image_decode": (lambda d: _sizes(media.decode_images(d, out_column="t")), (24, 32, 3)), "image_resize": (lambda d: _sizes(media.image("image").resize(16, 12).append(d, "t")), (12, 16, 3)), "image_crop": (lambda d: _sizes(media.image("image").crop(2, 3, 10, 5).append(d, "t")), (5, 10, 3)),
    "image_to_mode": (lambda d: _sizes(media.image("image").to_mode("L").append(d, "t")), (24, 32, 1)), "image_chain": (lambda d: _sizes(Relation(d).with_column("t", media.image("image").crop(0, 0, 20, 20).resize(8, 8).to_mode("RGBA")).frame), (8, 8, 4)),
    "image_encode": (lambda d: _sizes(media.decode_images(d.select("n_nationkey", media.image("image").resize(9, 7).encode().alias("image")), out_column="t")), (7, 9, 3)),
    "image_decode_sized": (lambda d: _sizes(media.decode_images(d, out_column="t", size=(6, 4), mode="L")), (4, 6, 1)),
}
for _name, (_call, (_h, _w, _c)) in _IMAGES.items():
    query(_name, f"SELECT n_nationkey, {_h} AS height, {_w} AS width, {_c} AS channels, {_h * _w * _c} AS size FROM nation")(lambda spark, sf_dir, call=_call: call(pictures(spark, sf_dir)))


@query("image_pixels", "SELECT n_nationkey, ((5 * 7 + n_nationkey * 31) % 256)::INTEGER AS red, ((3 * 9 + n_nationkey * 17) % 256)::INTEGER AS green, ((5 * 3 + n_nationkey) % 256)::INTEGER AS blue FROM nation")
def image_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the pixel in row 3 and column 5."""
    byte = lambda k: F.conv(F.hex(F.substring(F.col("t.data"), (3 * 32 + 5) * 3 + k, 1)), 16, 10).cast("int")
    return media.decode_images(pictures(spark, sf_dir), out_column="t").select("n_nationkey", byte(1).alias("red"), byte(2).alias("green"), byte(3).alias("blue"))


@query("image_hashes", "SELECT n_nationkey, 16 AS a, 16 AS d, 16 AS p, 0 AS self FROM nation")
def image_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = pictures(spark, sf_dir)
    for kind in ("ahash", "dhash", "phash"):
        x = media.add_image_hash(x, out_column=kind, kind=kind)
    again = media.add_image_hash(x, out_column="again", kind="phash")
    return again.select("n_nationkey", F.length("ahash").alias("a"), F.length("dhash").alias("d"), F.length("phash").alias("p"), media.hamming_hex(F.col("phash"), F.col("again")).cast("int").alias("self"))


@query("hamming_hex", "SELECT i::BIGINT AS id, bit_count(xor(i * 2654435761, i * 40503))::INTEGER AS d FROM range(0, 1000) AS t(i)")
def hamming_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1000).select("id", media.hamming_hex(F.lpad(F.lower(F.hex(F.col("id") * 2654435761)), 16, "0"), F.lpad(F.lower(F.hex(F.col("id") * 40503)), 16, "0")).cast("int").alias("d"))


@query("image_dedup", "SELECT n_nationkey AS id, n_nationkey AS cluster_id FROM nation UNION ALL SELECT n_nationkey + 100, n_nationkey FROM nation")
def image_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures twice each; their hashes differ otherwise by more than the distance of 0."""
    p = pictures(spark, sf_dir).select(F.col("n_nationkey").alias("id"), "image")
    return media.image_dedup(p.union(p.select(F.col("id") + 100, "image")), "id", kind="phash", max_distance=0, keep_cluster=True).select("id", "cluster_id")


@query("image_quality_filter", "SELECT n_nationkey FROM nation")
def image_quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pictures(spark, sf_dir)
    kept = media.image_quality_filter(p, min_width=32, min_height=24, min_aspect=1.3, max_aspect=1.4)
    return kept.select("n_nationkey").unionByName(media.image_quality_filter(p, min_width=33).select("n_nationkey"))


@query("decode_audio", "SELECT n_nationkey, 8000 AS sample_rate, 100 + n_nationkey AS num_frames, 1 AS num_channels, 0.25::DOUBLE AS first FROM nation")
def decode_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.udf("binary", useArrow=True)
    def tone(i: int) -> bytes:
        import io
        import wave

        sink = io.BytesIO()
        with wave.open(sink, "wb") as w:
            w.setnchannels(2)
            w.setsampwidth(2)
            w.setframerate(8000)
            w.writeframes(np.array([[16384, 0]] * (100 + i), "<i2").tobytes())
        return sink.getvalue()

    s = media.decode_audio(table(spark, sf_dir, "nation").select("n_nationkey", tone("n_nationkey").alias("audio")))
    return s.select("n_nationkey", "sound.sample_rate", "sound.num_frames", "sound.num_channels", F.col("sound.samples")[0].alias("first"))


@query("decode_documents", "SELECT n_nationkey, unnest([0, 1]) AS page_index, unnest([n_name, 'page two of ' || n_name]) AS text FROM nation")
def decode_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "nation").select("n_nationkey", F.encode(F.concat("n_name", F.lit("\f"), F.lit("page two of "), F.col("n_name"), F.lit("\fthree")), "UTF-8").alias("document"))
    return media.decode_documents(d, max_pages=2).select("n_nationkey", "page_index", "text")


@query("explode_video", "SELECT n_nationkey, unnest([0, 1, 2]) AS frame_index FROM nation")
def explode_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second of ten frames, three at most, by a decoder of one's own."""
    v = table(spark, sf_dir, "nation").select("n_nationkey", F.lit(b"10").alias("video"))
    return media.explode_video(v, "video", lambda d: [np.full((4, 4, 3), i, np.uint8) for i in range(int(d))], 3, 2).select("n_nationkey", "frame_index")


@query("tensors", "SELECT 2 AS rows, 2 AS columns, 10.0::DOUBLE AS total")
def tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(1).select(media.tensor([[1, 2], [3, 4]], [2, 2]).alias("t")).collect()
    x = media.tensor_to_numpy([r["t"] for r in rows])[0]
    return spark.range(1).select(F.lit(x.shape[0]).alias("rows"), F.lit(x.shape[1]).alias("columns"), F.lit(float(x.sum())).alias("total"))


@passes("url_download", "SELECT 5 AS size, true AS gone")
def url_download(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    tokens.write_bytes(spark, f"{at}/x.bin", b"12345")
    u = spark.createDataFrame([(at if "://" in at else f"file://{at}",)], "u string").select(F.concat(F.regexp_replace("u", "^file:/+", "file:///"), F.lit("/x.bin")).alias("u"), F.lit(None).cast("string").alias("n"))
    return media.url_download(media.url_download(u, "u", "a"), "n", "b").select(F.length("a").alias("size"), F.col("b").isNull().alias("gone"))


# streams, run to their end


def _stream(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    e.repartitionByRange(4, "ts").write.parquet(f"{at}/in")
    return streaming.read_stream(spark, f"{at}/in", "event_id bigint, ts timestamp, user_id bigint, event_type string, value double", files_per_trigger=1)


@passes("stream_write", "SELECT event_id, user_id, event_type, value FROM events")
def stream_write(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    streaming.write_stream(_stream(spark, sf_dir, at), f"{at}/out", f"{at}/cp").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("event_id", "user_id", "event_type", "value")


@passes("stream_each_batch", "SELECT event_id, value * 2 AS twice FROM events")
def stream_each_batch(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    streaming.each_batch(_stream(spark, sf_dir, at), lambda d, i: d.select("event_id", (F.col("value") * 2).alias("twice")).write.mode("overwrite").parquet(f"{at}/out/batch={i}"), f"{at}/cp").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("event_id", "twice")


@passes("stream_deduplicated", "SELECT DISTINCT event_id, user_id FROM events")
def stream_deduplicated(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    """Every event arrives twice."""
    s = _stream(spark, sf_dir, at)
    streaming.write_stream(streaming.deduplicated(s.unionByName(s), "ts", ["event_id"], "400 days"), f"{at}/out", f"{at}/cp").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("event_id", "user_id")


@passes("stream_running_counts", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def stream_running_counts(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    counts = streaming.running_counts(_stream(spark, sf_dir, at), "user_id")
    counts.writeStream.outputMode("update").foreachBatch(lambda d, i: d.write.mode("overwrite").parquet(f"{at}/out/batch={i}")).option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("user_id").agg(F.max("n").alias("n"))


@passes("stream_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    """Windows by the hour with a watermark, the last state of each."""
    w = streaming.windowed_counts(_stream(spark, sf_dir, at), "ts", ["event_type"], "1 hour", late="400 days")
    w.writeStream.outputMode("update").foreachBatch(lambda d, i: d.write.mode("overwrite").parquet(f"{at}/out/batch={i}")).option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type").agg(F.max("n").alias("n"))


@query("window_sliding", "SELECT w AS window_start, user_id, count(*) AS n FROM (SELECT user_id, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY ALL")
def window_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = streaming.windowed_counts(table(spark, sf_dir, "events"), "ts", ["user_id"], "2 hours", "1 hour")
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "user_id", "n")


# stages, transactions, codes, resident vectors


@query("pipeline_stages", f"SELECT doc_id, sha256({_NORM}) AS content_hash FROM documents WHERE doc_id IN (SELECT doc_id FROM documents WHERE length(text) > 300 AND len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) BETWEEN 60 AND 100000)")
def pipeline_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function over batches, a quality filter and a hash."""
    import pyarrow.compute as pc

    off = {"min_mean_word_len": 0, "max_mean_word_len": 1e9, "max_symbol_ratio": 2, "min_alpha_word_ratio": -1, "max_dup_line_ratio": 2, "max_top_word_ratio": 2, "max_digit_ratio": 2, "min_stopword_ratio": -1, "max_dup_ngram_ratio": 2}
    p = stages.RelationPipeline.from_source(docs(spark, sf_dir)).map_batches(lambda t: t.filter(pc.greater(pc.utf8_length(t["text"]), 300)), batch_size=100).quality_filter(min_words=60, **off).content_hash()
    return p.to_relation().frame.select("doc_id", "content_hash")


@query("pipeline_chunks", "SELECT doc_id, i::INTEGER AS chunk_index, substr(text, i * 1024 + 1, 1024) AS chunk FROM documents, unnest(range(0, greatest(ceil((length(text) - 1024) / 1024.0), 0)::BIGINT + 1)) AS t(i) WHERE length(text) > 0")
def pipeline_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.RelationPipeline(docs(spark, sf_dir)).chunk(recursive=False).to_relation().frame.select("doc_id", "chunk_index", "chunk")


@passes("pipeline_write_streaming", "SELECT o_orderkey, o_custkey * 2 AS twice FROM orders")
def pipeline_write_streaming(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    """Four shards, each written before the next."""
    import pyarrow.compute as pc

    p = stages.RelationPipeline(orders(spark, sf_dir), num_shards=4).map_batches(lambda t: pa.table({"o_orderkey": t["o_orderkey"], "twice": pc.multiply(t["o_custkey"], 2)}), "o_orderkey bigint, twice bigint")
    assert p.write_streaming(at) == 4
    return spark.read.parquet(at).select("o_orderkey", "twice")


@facts("pipeline_run_streaming", "SELECT 3 AS tables, count(*) AS rows, sum(n_nationkey)::BIGINT AS total FROM nation")
def pipeline_run_streaming(spark: SparkSession, sf_dir: str) -> dict:
    parts = list(stages.RelationPipeline(table(spark, sf_dir, "nation"), num_shards=3).run_streaming())
    return {"tables": len(parts), "rows": sum(p.num_rows for p in parts), "total": int(sum(sum(p["n_nationkey"].to_pylist()) for p in parts))}


@facts("pipeline_local", "SELECT 25::BIGINT AS rows, (SELECT sum(n_nationkey + 1) FROM nation)::BIGINT AS total, (SELECT count(*) FROM nation WHERE n_regionkey = 1) AS streamed")
def pipeline_local(spark: SparkSession, sf_dir: str) -> dict:
    import pyarrow.compute as pc

    add = stages.MapBatchesStage(lambda t: t.set_column(0, "n_nationkey", pc.add(t["n_nationkey"], 1)), batch_size=4)
    out = stages.Pipeline(table(spark, sf_dir, "nation").toArrow(), [add]).run()
    got = stages.streaming_transform(Relation(table(spark, sf_dir, "nation")), "SELECT * FROM part WHERE n_regionkey = 1", 2)
    return {"rows": out.num_rows, "total": int(sum(out["n_nationkey"].to_pylist())), "streamed": sum(b.num_rows for b in got)}


@passes("pipeline_files", "SELECT 24 AS height, 32 AS width, 3::BIGINT AS files")
def pipeline_files(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    """Files that are named in a column, loaded and decoded."""
    picture = media.image_array([np.zeros((24, 32, 3), np.uint8)])[0].as_py()
    for i in range(3):
        tokens.write_bytes(spark, f"{at}/{i}.png", picture)
    paths = sources.list_files(spark, at, (".png",)).select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"))
    out = stages.RelationPipeline(paths).load_files().decode("image", out_column="t").to_relation().frame
    return out.groupBy("t.height", "t.width").agg(F.count("*").alias("files"))


@passes("transaction_rollback", "SELECT r_regionkey, r_name FROM region")
def transaction_rollback(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    name, con = f"t_{at[-12:]}", Connection(spark)
    Relation(table(spark, sf_dir, "region").select("r_regionkey", "r_name")).create(name)
    con.begin()
    con.insert(name, [99, "gone"])
    con.update(name, {"r_name": "x"}, "r_regionkey = 0")
    con.execute(f"CREATE TABLE {name}_new AS SELECT 1 AS a")
    con.rollback()
    assert not spark.catalog.tableExists(f"{name}_new")
    return spark.table(name)


@passes("transaction_commit", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'stays'")
def transaction_commit(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    name, con = f"t_{at[-12:]}", Connection(spark)
    Relation(table(spark, sf_dir, "region").select("r_regionkey", "r_name")).create(name)
    con.begin().execute(f"INSERT INTO {name} VALUES (99, 'stays')")
    con.commit()
    return spark.table(name)


@query("knn_rerank", _NEAREST)
def knn_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(vectors.knn_rerank(vectors.quantised(emb(spark, sf_dir)), "embedding", Q, 10, 4, "cosine", "vec_id"))


@query("knn_resident", _NEAREST)
def knn_resident(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = emb(spark, sf_dir)
    return _near(vectors.ResidentVectors([e.where(f"vec_id % 3 = {i}") for i in range(3)], "embedding", "vec_id").search(Q, 10))


@query("knn_routed", f"SELECT vec_id, round(1 - list_cosine_similarity({_D}, {_QSQL}), 5) AS d FROM embeddings WHERE label = (SELECT label FROM (SELECT label, {', '.join(f'avg(embedding[{i + 1}]::DOUBLE) AS c{i}' for i in range(64))} FROM embeddings GROUP BY label) ORDER BY 1 - list_cosine_similarity([{', '.join(f'c{i}' for i in range(64))}], {_QSQL}) LIMIT 1) ORDER BY 1 - list_cosine_similarity({_D}, {_QSQL}), vec_id LIMIT 10")
def knn_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards by label, of which the one with the nearest centroid is searched."""
    e = emb(spark, sf_dir)
    labels = [r[0] for r in e.select("label").distinct().orderBy("label").collect()]
    return _near(vectors.ResidentVectors([e.where(F.col("label") == x) for x in labels], "embedding", "vec_id").search(Q, 10, 1))


@query("hybrid_analytical", _BM25 + " SELECT lang, count(*) AS n, round(sum(score), 6) AS total FROM (SELECT doc_id, score FROM score ORDER BY score DESC, doc_id LIMIT 50) JOIN documents USING (doc_id) GROUP BY lang")
def hybrid_analytical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hybrid_analytical(docs(spark, sf_dir), "SELECT lang, count(*) AS n, round(sum(score), 6) AS total FROM hits GROUP BY lang", "doc_id", text_query="stupid the license", k=50)


@query("semantic_dedup_greedy", greedy_sql(0.5))
def semantic_dedup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.semantic_dedup(emb(spark, sf_dir), "vec_id", threshold=0.5, keep_cluster=True).select("vec_id", "semantic_cluster")


@facts("token_metrics", "SELECT 2 AS keys, 12 AS input, 5 AS output, 17 AS total")
def token_metrics(spark: SparkSession, sf_dir: str) -> dict:
    m = ai.TokenMetrics(spark)
    m.record("chat", "small", "own", 10, 5)
    m.record("embed", "small", "own", 2)
    t = m.totals()
    return {"keys": len(t), "input": sum(x[0] for x in t.values()), "output": sum(x[1] for x in t.values()), "total": sum(x[2] for x in t.values())}


@facts("metrics_served", "SELECT true AS text, 1 AS records, true AS cleared, 'curate:ok' AS kinds")
def metrics_served(spark: SparkSession, sf_dir: str) -> dict:
    import json
    from urllib.request import urlopen

    m = Metrics()
    m.curate("step", 8, 2)
    server = m.serve()
    at = f"http://127.0.0.1:{server.server_address[1]}"
    text, records = urlopen(f"{at}/metrics").read().decode(), json.loads(urlopen(f"{at}/records").read())  # noqa: S310
    server.shutdown()
    kinds = ",".join(m.audit_stats())
    first = m.audit_get(0)
    m.audit_clear()
    return {"text": "lakemill_rows_in 8" in text, "records": len(records), "cleared": m.snapshot() == [] and first["rows_out"] == 2, "kinds": kinds}
