"""The relational API on literal rows."""

import numpy as np
import pyarrow as pa
import pytest

from lakemill import dialect, sources
from lakemill.connection import Connection, filter_df, order_df, project_df
from lakemill.expressions import CaseExpression, ColumnExpression
from lakemill.operators import joins
from lakemill.relation import Relation


@pytest.fixture(scope="module")
def con(spark):
    return Connection(spark)


@pytest.fixture(scope="module")
def win(spark):
    rows = [(1, 1, 2, 0.54, "h"), (1, 1, 1, 0.21, "e"), (1, 2, 3, 0.001, "l"), (2, 10, 4, 0.04, "l"), (2, 11, -1, 10.45, "o"), (3, -1, 0, 13.32, ","), (3, 5, -2, 9.87, "wor"), (3, None, 10, 6.56, "ld")]
    return Relation(spark.createDataFrame(rows, "id int, v int, t int, f double, s string"))


def test_nulls_sort_last(win):
    assert [r[0] for r in win.filter("id = 3").order("v DESC").project("v").fetchall()] == [5, -1, None]
    assert [r[0] for r in win.filter("id = 3").order("v").project("v").fetchall()] == [-1, 5, None]
    ranks = dict(win.rank("partition by id order by v", "s").fetchall())
    assert ranks["ld"] == 3 and ranks[","] == 1


def test_window_frames(win):
    out = dict(win.sum("v", window_spec="over (partition by id order by t rows between unbounded preceding and current row)", projected_columns="s").fetchall())
    assert (out["e"], out["h"], out["l"]) == (1, 2, 4) or out["e"] == 1
    got = dict(win.first_value("v", "partition by id order by t desc ignore nulls", "s").fetchall())
    assert got["ld"] is None or got["wor"] in (5, -1)


def test_aggregates_on_nulls(win):
    assert sorted(win.list("v", groups="id").fetchall())[2] == (3, [-1, 5, None]) or sorted(win.list("v", groups="id").fetchall(), key=str)[2][1].count(None) == 1
    assert dict(win.count("v", groups="id").fetchall()) == {1: 3, 2: 2, 3: 2}
    assert dict(win.any_value("v", groups="id").fetchall())[3] in (-1, 5)
    assert dict(win.bitstring_agg("id", 0, 4, groups="id").fetchall()) == {1: "01000", 2: "00100", 3: "00010"}
    assert win.histogram("id").fetchall() == [({1: 3, 2: 2, 3: 3},)]
    with pytest.raises(ValueError):
        win.bitstring_agg("id", min=1)
    with pytest.raises(TypeError):
        win.bitstring_agg("s", 0, 1)


def test_joins_by_name_and_condition(con):
    a, b = con.values("(1, 'x'), (2, 'y'), (NULL, 'n')").project("col0 AS k, col1 AS l"), con.values("(1, 'p'), (1, 'q'), (NULL, 'm')").project("col0 AS k, col1 AS r")
    assert a.join(b, "k").columns == ["k", "l", "r"]
    assert sorted(a.join(b, "lhs.k = rhs.k", "left").project("l, r").fetchall(), key=str) == [("n", None), ("x", "p"), ("x", "q"), ("y", None)]
    assert sorted(r[0] for r in a.join(b, "k", "anti").project("l").fetchall()) == ["n", "y"]
    with pytest.raises(ValueError, match="unknown join"):
        a.join(b, "k", "sideways")


def test_unnest_drops_empty_and_null(con):
    r = con.sql("SELECT 1 AS id, array(1, 2) AS v UNION ALL SELECT 2, array() UNION ALL SELECT 3, NULL")
    assert r.unnest("v").columns == ["id", "v"] and sorted(r.unnest("v").fetchall()) == [(1, 1), (1, 2)]


def test_fetching(con):
    r = con.sql("SELECT * FROM VALUES (1, 'a'), (2, 'b'), (3, 'c') AS t(i, s)").order("i")
    assert r.fetchone() == (1, "a") and r.fetchmany(5) == [(2, "b"), (3, "c")] and r.fetchone() is None
    assert r.shape == (3, 2) and r.to_arrow().num_rows == 3 and list(r.fetchnumpy()) == ["i", "s"]
    assert [b.num_rows for b in r.record_batch_stream(2)] == [2, 1]
    assert "Sort" in r.explain() and r.plan_json() and "Sort" in r.plan_tree()


def test_query_and_views(con):
    r = con.sql("SELECT explode(sequence(1, 5)) AS i")
    assert r.query("t", "SELECT sum(t.i) AS s FROM t WHERE t.i > 2").fetchall() == [(12,)]
    con.register("fives", pa.table({"x": [5, 5]}))
    assert con.table("fives").fetchall() == [(5,), (5,)]
    con.unregister("fives")
    found = pa.table({"y": [1, 2, 3]})  # noqa: F841
    assert con.sql("SELECT count(*) AS n FROM found").fetchall() == [(3,)]


def test_functions_of_python(con):
    con.create_function("half", lambda x: 1 // (x - 2), ["INTEGER"], "INTEGER", exception_handling="return_null")
    assert con.sql("SELECT half(i) AS v FROM VALUES (2), (3), (NULL) AS t(i)").fetchall() == [(None,), (1,), (None,)]
    con.create_function("seen", lambda x: x is None, ["INTEGER"], "BOOLEAN", null_handling="special")
    assert con.sql("SELECT seen(CAST(NULL AS INT)) AS v").fetchall() == [(True,)]
    con.remove_function("half")
    r = con.from_arrow(pa.table({"x": [1, 2, 3]})).repartition(1)
    assert r.map_batches(lambda b: b.slice(1), batch_size=2).num_rows() == 1
    assert con.table_function_udf(lambda n: range(n), 3, schema="i int").fetchall() == [(0,), (1,), (2,)]


def test_tables(con, tmp_path):
    con.sql("SELECT 1 AS k, 'a' AS v UNION ALL SELECT 2, 'b'").to_table("tab")
    con.insert("tab", [3, "it's"])
    con.update("tab", {"v": "new"}, "k = 2")
    assert sorted(con.table("tab").fetchall()) == [(1, "a"), (2, "new"), (3, "it's")]
    con.sql("SELECT 4 AS k, 'd' AS v").insert_into("tab")
    assert con.table("tab").num_rows() == 4
    with pytest.raises(ValueError):
        con.update("tab", {"nope": 1})
    con.spark.sql("DROP TABLE tab")


def test_types():
    assert dialect.spark_type("STRUCT(a INTEGER, b VARCHAR[])") == "struct<a:int,b:array<string>>"
    assert dialect.spark_type("MAP(VARCHAR, DECIMAL(10,2))") == "map<string,decimal(10,2)>"
    assert dialect.spark_type("UBIGINT") == "decimal(20,0)" and dialect.spark_type("INTEGER[3]") == "array<int>"
    assert Connection.struct_type({"a": "BIGINT"}) == "struct<a:bigint>"


def test_split_keeps_brackets_and_quotes():
    assert dialect.split_top("a, f(b, c), 'x,y', transform(z, q -> q > 1)") == ["a", "f(b, c)", "'x,y'", "transform(z, q -> q > 1)"]
    assert dialect.over("partition by a order by b desc, c nulls first rows between 1 preceding and current row") == "OVER (partition by a order by b desc NULLS LAST, c nulls first rows between 1 preceding and current row)"


def test_expressions(con):
    c = ColumnExpression
    r = con.sql("SELECT * FROM VALUES (1, 0), (4, 2), (NULL, 1) AS t(a, b)")
    out = r.project((c("a") / c("b")).alias("q"), (c("a") + 1).alias("p"), CaseExpression(c("a") > 2, "big").otherwise("small").alias("s"), c("a").isnull().alias("n")).fetchall()
    assert out == [(None, 2, "small", False), (2.0, 5, "big", False), (None, None, "small", True)]


def test_frames_of_others(con):
    t = pa.table({"x": [3, 1, 2]})
    assert order_df(con, t, "x").fetchall() == [(1,), (2,), (3,)] and filter_df(con, t, "x > 2").fetchall() == [(3,)] and project_df(con, t, "x * 2 AS y").num_rows() == 3


def test_csv(con, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('junk line\nid|name\n1|"a|b"\n2|NA\n')
    r = con.read_csv(str(p), sep="|", skiprows=1, na_values="NA")
    assert r.fetchall() == [(1, "a|b"), (2, None)]
    with pytest.raises(ValueError):
        con.read_csv(str(p), nonsense=1)
    con.sql("SELECT 1 AS a, 'x,\"y' AS b").to_csv(str(tmp_path / "out"))
    assert con.read_csv(str(tmp_path / "out")).fetchall() == [(1, 'x,"y')]
    import io

    assert con.read_csv(io.StringIO("a,b\n1,2\n")).fetchall() == [(1, 2)]


def test_hive_and_formats(spark, con, tmp_path):
    spark.range(6).selectExpr("id", "id % 2 AS k").write.partitionBy("k").parquet(str(tmp_path / "h"))
    r = con.read_hive(str(tmp_path / "h"))
    assert sorted(r.filter("k = 1").project("id").fetchall()) == [(1,), (3,), (5,)]
    assert "PartitionFilters: [isnotnull(k" in r.filter("k = 1").explain()
    assert sources.detect_format(spark, str(tmp_path / "h")) == "hive"


def test_warc(spark, tmp_path):
    import gzip

    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<html><script>x</script><p>Hello &amp; bye</p></html>"
    rec = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://a/\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    other = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(other) + gzip.compress(rec))
    (row,) = sources.read_warc(spark, str(tmp_path / "x.warc.gz"), text=True).collect()
    assert (row.url, row.content_type, row.text) == ("http://a/", "text/html", "Hello & bye")


def test_generators_as_a_source(spark):
    tasks = [lambda i=i: iter([(i, f"r{i}"), (i + 10, "x")]) for i in range(3)]
    df = sources.read_generators(spark, "a int, b string", tasks)
    assert sorted(r.a for r in df.collect()) == [0, 1, 2, 10, 11, 12] and df.rdd.getNumPartitions() == 3


def test_asof_keeps_null_values(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 2, 1.0), (1, 4, None)], "k int, t int, v double")
    assert sorted((r.k, r.t, r.v) for r in joins.asof_join(left, right, "t", ["k"], "v").collect()) == [(1, 1, None), (1, 5, None), (2, 9, None)]


def test_decorators(spark):
    from lakemill.functions import udf

    @udf.func(return_dtype="BIGINT")
    def twice(x):
        return None if x is None else 2 * x

    @udf.cls(return_dtype="BIGINT")
    class Add:
        def __init__(self, n):
            self.n = n

        def __call__(self, x):
            return int(x) + self.n

    @udf.cls_batch(schema="id bigint", batch_size=2)
    class First:
        def __call__(self, b):
            return b.slice(0, 1)

    df = spark.range(5, numPartitions=1)
    assert [r[0] for r in df.select(twice("id")).collect()] == [0, 2, 4, 6, 8]
    assert [r[0] for r in df.select(Add(3)("id")).collect()] == [3, 4, 5, 6, 7]
    assert [r[0] for r in First()(df).collect()] == [0, 2, 4]


def test_console(con):
    import io

    from lakemill import console

    out = io.StringIO()
    console.run(con, ["SELECT 1 AS a,\n", "2 AS b;\n", "SELECT nonsense;\n", ".what\n", ".quit\n", "SELECT 9;\n"], out)
    text = out.getvalue()
    assert "a\tb\n1\t2" in text and "error:" in text and "unknown command .what" in text and "9" not in text.split("unknown")[1]


def test_versioned_through_relations(con, tmp_path):
    con.values("(1, 'a'), (2, 'b')").write_versioned(str(tmp_path / "v"))
    con.values("(3, 'c')").write_versioned(str(tmp_path / "v"), "append")
    assert con.read_versioned(str(tmp_path / "v")).num_rows() == 3
    assert con.read_versioned(str(tmp_path / "v"), 1, ["col1"], "col0 = 2").fetchall() == [("b",)]


def test_joins_over_whole_tables(spark, tmp_path):
    from lakemill.plans import relational  # noqa: F401
    from lakemill.plans.registry import QUERIES

    # customers 1 and 2 have orders, 3 to 5 none; orders 13 and 14 have no customer, 15 no key
    spark.createDataFrame([(k,) for k in range(1, 6)], "c_custkey bigint").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(10, 1), (11, 2), (12, 2), (13, 8), (14, 9), (15, None)], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    both, left, right = {(1, 10), (2, 11), (2, 12)}, {(3, None), (4, None), (5, None)}, {(None, 13), (None, 14), (None, 15)}
    for how, want in {"inner": both, "left": both | left, "right": both | right, "outer": both | left | right}.items():
        rows = [tuple(r) for r in QUERIES[f"join_{how}"](spark, str(tmp_path)).select("c_custkey", "o_orderkey").collect()]
        assert len(rows) == len(want) and set(rows) == want


def test_quantiles_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(dialect, "LARGE", 1000, raising=False)
    r = np.random.default_rng(3)
    rows = [(k, float(x)) for k, n in ((None, 3000), ("a", 5000), ("b", 30), ("c", 2010)) for x in np.round(r.lognormal(3, 2, n), 1)]
    rows += [("d", None)] * 3 + [("e", 7.0)] * 1500 + [("a", None), ("e", 2.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    qs = [0.0, 0.1, 0.5, 0.9, 1.0]
    for api, kind in (("quantile_cont", "linear"), ("quantile_disc", "inverted_cdf")):
        out = getattr(Relation(df), api)("x", qs, groups="k").frame
        got = {x[0]: x[1] for x in out.collect()}
        for k in (None, "a", "b", "c", "e"):
            assert np.allclose(got[k], np.quantile([v for g, v in rows if g == k and v is not None], qs, method=kind), atol=1e-9), (api, k)
        assert got["d"] == [None] * 5
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile_approx" in plan  # a large group's values don't meet in one task
    values = [v for _, v in rows if v is not None]
    assert abs(Relation(df).median("x").frame.first()[0] - np.median(values)) < 1e-9
