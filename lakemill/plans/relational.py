"""Queries of the relational operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.connection import Connection
from lakemill.expressions import CaseExpression, CoalesceOperator, ColumnExpression, ConstantExpression, FunctionExpression, SQLExpression
from lakemill.operators import joins
from lakemill.plans.registry import query
from lakemill.relation import Relation


def rel(spark: SparkSession, sf_dir: str, name: str) -> Relation:
    return Relation(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _named(r: Relation, *names: str) -> DataFrame:
    return r.frame.toDF(*names)


# aggregates: name, call over a relation of lineitem, SQL; numbers are rounded on both sides

_DOUBLES = {
    "sum": "sum", "avg": "avg", "mean": "avg", "min": "min", "max": "max", "stddev_samp": "stddev_samp", "stddev": "stddev_samp", "std": "stddev_samp", "var_samp": "var_samp", "variance": "var_samp", "var": "var_samp",
    "stddev_pop": "stddev_pop", "std_pop": "stddev_pop", "var_pop": "var_pop", "median": "median", "fsum": "fsum", "favg": "favg", "geomean": "geomean",
}
for _api, _sql in _DOUBLES.items():

    def _double(spark: SparkSession, sf_dir: str, api: str = _api) -> DataFrame:
        out = _named(getattr(rel(spark, sf_dir, "lineitem"), api)("l_quantity", groups="l_returnflag, l_linestatus"), "l_returnflag", "l_linestatus", "v")
        return out.withColumn("v", F.round(F.col("v").cast("double"), 6))

    query(f"agg_{_api}", f"SELECT l_returnflag, l_linestatus, round({_sql}(l_quantity)::DOUBLE, 6) AS v FROM lineitem GROUP BY ALL")(_double)

_INTS = {"bit_and": "bit_and(l_linenumber + 8)", "bit_or": "bit_or(l_linenumber)", "bit_xor": "bit_xor(l_linenumber)", "count": "count(l_linenumber)"}
for _api, _sql in _INTS.items():

    def _integer(spark: SparkSession, sf_dir: str, api: str = _api) -> DataFrame:
        out = _named(getattr(rel(spark, sf_dir, "lineitem"), api)("l_linenumber + 8" if api == "bit_and" else "l_linenumber", groups="l_returnflag"), "l_returnflag", "v")
        return out.withColumn("v", F.col("v").cast("bigint"))

    query(f"agg_{_api}", f"SELECT l_returnflag, ({_sql})::BIGINT AS v FROM lineitem GROUP BY ALL")(_integer)

for _api in ("bool_and", "bool_or"):

    def _boolean(spark: SparkSession, sf_dir: str, api: str = _api) -> DataFrame:
        return _named(getattr(rel(spark, sf_dir, "lineitem"), api)("l_quantity > 1", groups="l_suppkey"), "l_suppkey", "v")

    query(f"agg_{_api}", f"SELECT l_suppkey, {_api}(l_quantity > 1) AS v FROM lineitem GROUP BY ALL")(_boolean)

_CALLS: dict[str, tuple[Callable[[Relation], Relation], str]] = {
    "any_value": (lambda r: r.any_value("c_nationkey", groups="c_nationkey"), "any_value(c_nationkey)"),
    "arg_max": (lambda r: r.arg_max("c_custkey", "struct(c_acctbal, c_custkey)", groups="c_nationkey"), "arg_max(c_custkey, (c_acctbal, c_custkey))"),
    "arg_min": (lambda r: r.arg_min("c_custkey", "struct(c_acctbal, c_custkey)", groups="c_nationkey"), "arg_min(c_custkey, (c_acctbal, c_custkey))"),
    "first": (lambda r: r.first("c_name", "c_custkey", groups="c_nationkey"), "first(c_name ORDER BY c_custkey)"),
    "last": (lambda r: r.last("c_name", "c_custkey", groups="c_nationkey"), "last(c_name ORDER BY c_custkey)"),
}
for _api, (_call, _sql) in _CALLS.items():

    def _simple(spark: SparkSession, sf_dir: str, call: Callable[[Relation], Relation] = _call) -> DataFrame:
        return _named(call(rel(spark, sf_dir, "customer")), "c_nationkey", "v")

    query(f"agg_{_api}", f"SELECT c_nationkey, {_sql} AS v FROM customer GROUP BY c_nationkey")(_simple)


@query("agg_product", "SELECT l_suppkey, round(product(1 + l_tax / 100), 6) AS v FROM lineitem GROUP BY ALL")
def agg_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(rel(spark, sf_dir, "lineitem").product("1 + l_tax / 100", groups="l_suppkey"), "l_suppkey", "v").withColumn("v", F.round("v", 6))


@query("agg_list", "SELECT c_mktsegment, list_sort(list(c_nationkey)) AS v FROM customer GROUP BY ALL")
def agg_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(rel(spark, sf_dir, "customer").list("c_nationkey", groups="c_mktsegment"), "c_mktsegment", "v").withColumn("v", F.sort_array("v"))


@query("agg_string_agg", "SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS v FROM nation GROUP BY ALL")
def agg_string_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _named(rel(spark, sf_dir, "nation").string_agg("n_name", ";", groups="n_regionkey"), "n_regionkey", "v")
    return out.withColumn("v", F.array_join(F.sort_array(F.split("v", ";")), ";"))


@query("agg_mode", "SELECT c_mktsegment, min(c_nationkey) AS v FROM (SELECT c_mktsegment, c_nationkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY count(*) DESC) AS r FROM customer GROUP BY c_mktsegment, c_nationkey) WHERE r = 1 GROUP BY c_mktsegment")
def agg_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(rel(spark, sf_dir, "customer").mode("c_nationkey", groups="c_mktsegment"), "c_mktsegment", "v")


for _api in ("quantile_cont", "quantile_disc"):

    def _quantile(spark: SparkSession, sf_dir: str, api: str = _api) -> DataFrame:
        return _named(getattr(rel(spark, sf_dir, "lineitem"), api)("l_extendedprice", [0.1, 0.5, 0.9], groups="l_returnflag"), "l_returnflag", "v").withColumn("v", F.transform("v", lambda x: F.round(x.cast("double"), 4)))

    query(f"agg_{_api}", f"SELECT l_returnflag, list_transform({_api}(l_extendedprice, [0.1, 0.5, 0.9]), lambda x: round(x, 4)) AS v FROM lineitem GROUP BY ALL")(_quantile)


@query("agg_quantile", "SELECT l_suppkey, quantile_disc(l_quantity, 0.25) AS v FROM lineitem GROUP BY ALL")
def agg_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(rel(spark, sf_dir, "lineitem").quantile("l_quantity", 0.25, groups="l_suppkey"), "l_suppkey", "v")


@query("agg_bitstring", "SELECT l_returnflag, bitstring_agg(l_linenumber, 1, 10)::VARCHAR AS v FROM lineitem GROUP BY ALL")
def agg_bitstring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(rel(spark, sf_dir, "lineitem").bitstring_agg("l_linenumber", 1, 10, groups="l_returnflag"), "l_returnflag", "v")


@query("agg_histogram", "SELECT c_mktsegment, k AS nation, n FROM (SELECT c_mktsegment, c_nationkey AS k, count(*) AS n FROM customer GROUP BY ALL)")
def agg_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _named(rel(spark, sf_dir, "customer").histogram("c_nationkey", groups="c_mktsegment"), "c_mktsegment", "h")
    return out.select("c_mktsegment", F.explode("h").alias("nation", "n"))


@query("agg_value_counts", "SELECT o_orderstatus, o_orderpriority, count(o_orderpriority) AS n FROM orders GROUP BY ALL")
def agg_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(rel(spark, sf_dir, "orders").value_counts("o_orderpriority", groups="o_orderstatus"), "o_orderstatus", "o_orderpriority", "n")


@query("agg_udaf", "SELECT c_nationkey, round(max(c_acctbal) - min(c_acctbal), 4) AS spread FROM customer GROUP BY ALL")
def agg_udaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    def spread(t):  # noqa: ANN001, ANN202
        x = t["c_acctbal"].to_numpy()
        return round(float(x.max() - x.min()), 4)

    return rel(spark, sf_dir, "customer").aggregate_udf(spread, ["c_acctbal"], ["c_nationkey"], "spread").frame


@query("aggregate_group_by_all", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def aggregate_group_by_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel(spark, sf_dir, "orders").aggregate("o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total").frame


@query("aggregate_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, count(DISTINCT l_partkey) AS p FROM lineitem GROUP BY ALL")
def aggregate_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel(spark, sf_dir, "lineitem").aggregate("count(DISTINCT l_suppkey) AS s, count(DISTINCT l_partkey) AS p", "l_returnflag").frame


for _kind in ("ROLLUP", "CUBE", "GROUPING SETS"):
    _keys = "((o_orderstatus, o_orderpriority), (o_orderstatus), ())" if _kind == "GROUPING SETS" else "(o_orderstatus, o_orderpriority)"
    _text = f"SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {{}} GROUP BY {_kind} {_keys}"

    def _sets(spark: SparkSession, sf_dir: str, text: str = _text) -> DataFrame:
        return rel(spark, sf_dir, "orders").query("o", text.format("o")).frame

    query(f"aggregate_{_kind.lower().replace(' ', '_')}", _text.format("orders"))(_sets)

# windows: name, call, SQL of the value; over orders of a customer by date and key

_SPEC = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
_FRAME = f"{_SPEC} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW"
_WINDOWS: dict[str, tuple[Callable[[Relation], Relation], str]] = {
    "row_number": (lambda r: r.row_number(_SPEC, "o_orderkey"), f"row_number() OVER ({_SPEC})"), "rank": (lambda r: r.rank("PARTITION BY o_custkey ORDER BY o_orderpriority", "o_orderkey"), "rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority)"),
    "dense_rank": (lambda r: r.dense_rank("PARTITION BY o_custkey ORDER BY o_orderpriority", "o_orderkey"), "dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority)"),
    "percent_rank": (lambda r: r.percent_rank(_SPEC, "o_orderkey"), f"round(percent_rank() OVER ({_SPEC}), 9)"), "cume_dist": (lambda r: r.cume_dist(_SPEC, "o_orderkey"), f"round(cume_dist() OVER ({_SPEC}), 9)"),
    "n_tile": (lambda r: r.n_tile(_SPEC, 3, "o_orderkey"), f"ntile(3) OVER ({_SPEC})"), "first_value": (lambda r: r.first_value("o_totalprice", _SPEC, "o_orderkey"), f"first_value(o_totalprice) OVER ({_SPEC})"),
    "last_value": (lambda r: r.last_value("o_totalprice", _FRAME, "o_orderkey"), f"last_value(o_totalprice) OVER ({_FRAME})"), "nth_value": (lambda r: r.nth_value("o_totalprice", _SPEC, 2, "o_orderkey"), f"nth_value(o_totalprice, 2) OVER ({_SPEC})"),
    "lag": (lambda r: r.lag("o_totalprice", _SPEC, 1, "NULL", "o_orderkey"), f"lag(o_totalprice, 1) OVER ({_SPEC})"), "lead": (lambda r: r.lead("o_orderkey", _SPEC, 2, "-1", "o_orderkey"), f"lead(o_orderkey, 2, -1) OVER ({_SPEC})"),
    "sum": (lambda r: r.sum("o_orderkey", window_spec=_FRAME, projected_columns="o_orderkey"), f"(sum(o_orderkey) OVER ({_FRAME}))::BIGINT"), "median": (lambda r: r.median("o_totalprice", window_spec=_FRAME, projected_columns="o_orderkey"), f"round(median(o_totalprice) OVER ({_FRAME}), 6)"),
    "quantile_disc": (lambda r: r.quantile_disc("o_totalprice", 0.75, window_spec=_FRAME, projected_columns="o_orderkey"), f"quantile_disc(o_totalprice, 0.75) OVER ({_FRAME})"),
    "list": (lambda r: r.list("o_orderkey", window_spec=_FRAME, projected_columns="o_orderkey"), f"list(o_orderkey) OVER ({_FRAME})"), "generic": (lambda r: r.generic_window_function("count", "o_totalprice", _FRAME, "o_orderkey"), f"count(o_totalprice) OVER ({_FRAME})"),
}
for _api, (_call, _sql) in _WINDOWS.items():

    def _window(spark: SparkSession, sf_dir: str, call: Callable[[Relation], Relation] = _call, api: str = _api) -> DataFrame:
        out = _named(call(rel(spark, sf_dir, "orders")), "o_orderkey", "v")
        return out.withColumn("v", F.round("v", 9 if api in ("percent_rank", "cume_dist") else 6)) if api in ("percent_rank", "cume_dist", "median") else out

    query(f"window_{_api}", f"SELECT o_orderkey, {_sql} AS v FROM orders")(_window)

# joins

_JOIN_SQL = "SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, c_custkey AS k FROM customer) AS l {} JOIN (SELECT o_orderkey, o_custkey AS k FROM orders) AS r USING (k)"
for _how, _sql in {"inner": "INNER", "left": "LEFT", "right": "RIGHT", "outer": "FULL"}.items():

    def _join(spark: SparkSession, sf_dir: str, how: str = _how) -> DataFrame:
        left, right = rel(spark, sf_dir, "customer").project("c_custkey, c_custkey AS k"), rel(spark, sf_dir, "orders").project("o_orderkey, o_custkey AS k")
        return left.join(right, "k", how).project("c_custkey, o_orderkey").frame

    query(f"join_{_how}", _JOIN_SQL.format(_sql))(_join)


@query("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel(spark, sf_dir, "customer").join(rel(spark, sf_dir, "orders").filter("o_totalprice > 100000"), "lhs.c_custkey = rhs.o_custkey", "semi").project("c_custkey").frame


@query("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel(spark, sf_dir, "customer").join(rel(spark, sf_dir, "orders"), "lhs.c_custkey = rhs.o_custkey", "anti").project("c_custkey").frame


@query("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel(spark, sf_dir, "region").cross(rel(spark, sf_dir, "nation")).project("r_name, n_name").frame


@query("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND length(a.n_name) = length(b.n_name)")
def join_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = rel(spark, sf_dir, "nation")
    return n.join(n, "lhs.n_regionkey < rhs.n_regionkey AND length(lhs.n_name) = length(rhs.n_name)").project("lhs.n_nationkey AS a, rhs.n_nationkey AS b").frame


@query("join_asof", "SELECT e.event_id, p.value AS last_view FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL) p ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type = 'purchase'")
def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    views = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return joins.asof_join(bought, views, "ts", ["user_id"], "value", "last_view").select("event_id", "last_view")


@query("join_range", "SELECT p_partkey, b.lo FROM part JOIN (SELECT i * 100.0 + 900 AS lo, i * 100.0 + 1050 AS hi FROM range(0, 10) AS t(i)) b ON p_retailprice >= b.lo AND p_retailprice < b.hi")
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = spark.range(10).select((F.col("id") * 100.0 + 900).alias("lo"), (F.col("id") * 100.0 + 1050).alias("hi"))
    return joins.range_join(spark.read.parquet(f"{sf_dir}/part.parquet"), bands, "p_retailprice", "lo", "hi", 150.0).select("p_partkey", F.col("lo").cast("decimal(38,1)").cast("double").alias("lo"))


@query("join_salted", "SELECT l_suppkey, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL")
def join_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return joins.salted_join(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey"), s, "l_suppkey", hot=100).groupBy("l_suppkey").agg(F.count("*").alias("n"))


# sets, order, reshaping

_SETS = {"union_all": "UNION ALL", "distinct_union": "UNION", "intersect": "INTERSECT", "except_": "EXCEPT"}
for _api, _sql in _SETS.items():

    def _set(spark: SparkSession, sf_dir: str, api: str = _api) -> DataFrame:
        return getattr(rel(spark, sf_dir, "customer").project("c_nationkey AS k"), api)(rel(spark, sf_dir, "supplier").filter("s_nationkey > 5").project("s_nationkey AS k")).frame

    query(f"set_{_api.rstrip('_')}", f"SELECT c_nationkey AS k FROM customer {_sql} SELECT s_nationkey AS k FROM supplier WHERE s_nationkey > 5")(_set)


@query("distinct", "SELECT DISTINCT l_shipdate, l_returnflag FROM lineitem")
def distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel(spark, sf_dir, "lineitem").project("l_shipdate, l_returnflag").distinct().frame


@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel(spark, sf_dir, "orders").order("o_totalprice DESC, o_orderkey").limit(25, 5).project("o_orderkey, o_totalprice").frame


@query("order", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal NULLS LAST, c_custkey")
def order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel(spark, sf_dir, "customer").order("c_acctbal, c_custkey").project("c_custkey, c_acctbal").frame


@query("unnest", "SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents")
def unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel(spark, sf_dir, "documents").project("doc_id, split(text, ' ') AS word").unnest("word").frame


@query("unnest_recursive", "SELECT conv_id, unnest(flatten(list_transform(string_split(text, chr(10)), lambda x: string_split(x, ' ')))) AS word FROM conversations")
def unnest_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel(spark, sf_dir, "conversations").project("conv_id, transform(split(text, '\\n'), x -> split(x, ' ')) AS word").unnest("word", recursive=True).frame


@query("pivot", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY ALL")
def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return p.select("o_orderpriority", *(F.coalesce(c, F.lit(0)).alias(c.lower()) for c in "FOP"))


@query("unpivot", "SELECT l_orderkey, l_linenumber, c AS name, v FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME c VALUE v)")
def unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "name", "v")


@query("sample_reservoir")
def sample_reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel(spark, sf_dir, "orders").sample("reservoir(50)").frame


@query("sample_percent")
def sample_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel(spark, sf_dir, "orders").sample("10%").frame


@query("describe", "SELECT count(*) AS n, min(o_totalprice)::VARCHAR AS lo, max(o_totalprice)::VARCHAR AS hi FROM orders")
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel(spark, sf_dir, "orders").describe().filter("column_name = 'o_totalprice'").project("count AS n, min AS lo, max AS hi").frame


# expressions and scalar functions


@query("expressions", "SELECT o_orderkey, o_totalprice * 2 - 1 AS a, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'part' END AS b, coalesce(NULL, o_orderpriority) AS c, o_orderkey % 7 AS d, o_orderkey BETWEEN 10 AND 20 AS e, o_orderstatus NOT IN ('F', 'P') AS f, upper(o_orderstatus) AS g, (o_orderkey // 3)::BIGINT AS h FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') AND o_custkey IS NOT NULL")
def expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ColumnExpression
    status = c("o_orderstatus")
    return rel(spark, sf_dir, "orders").filter(status.isin("F", "O", "P") & c("o_custkey").isnotnull()).project(
        c("o_orderkey"), (c("o_totalprice") * 2 - 1).alias("a"), CaseExpression(status == "F", "done").when(status == "O", "open").otherwise("part").alias("b"), CoalesceOperator(ConstantExpression(None), c("o_orderpriority")).alias("c"),
        (c("o_orderkey") % 7).alias("d"), c("o_orderkey").between(10, 20).alias("e"), status.isnotin("F", "P").alias("f"), FunctionExpression("upper", status).alias("g"), SQLExpression("o_orderkey div 3").cast("bigint").alias("h"),
    ).frame


@query("string_functions", "SELECT p_partkey, upper(p_name) AS a, length(p_name) AS b, substr(p_name, 2, 4) AS c, replace(p_name, 'a', 'o') AS d, string_split(p_name, ' ')[1] AS e, regexp_extract(p_brand, '([0-9]+)', 1) AS f, lpad(p_size::VARCHAR, 4, '0') AS g, reverse(p_name) AS h, p_type LIKE '%A%' AS i FROM part")
def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel(spark, sf_dir, "part").project("p_partkey, upper(p_name) AS a, cast(length(p_name) AS bigint) AS b, substr(p_name, 2, 4) AS c, replace(p_name, 'a', 'o') AS d, split(p_name, ' ')[0] AS e, regexp_extract(p_brand, '([0-9]+)', 1) AS f, lpad(cast(p_size AS string), 4, '0') AS g, reverse(p_name) AS h, p_type LIKE '%A%' AS i").frame


@query("date_functions", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, date_trunc('month', o_orderdate)::TIMESTAMP AS t, (o_orderdate + INTERVAL 40 DAY)::TIMESTAMP AS p, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS d, dayofweek(o_orderdate) AS w, quarter(o_orderdate) AS q FROM orders")
def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel(spark, sf_dir, "orders").project("o_orderkey, cast(year(o_orderdate) AS bigint) AS y, cast(month(o_orderdate) AS bigint) AS m, date_trunc('month', o_orderdate) AS t, o_orderdate + INTERVAL 40 DAY AS p, cast(datediff(cast(o_orderdate AS date), DATE '1995-01-01') AS bigint) AS d, cast(dayofweek(o_orderdate) - 1 AS bigint) AS w, cast(quarter(o_orderdate) AS bigint) AS q").frame


@query("json_functions", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel(spark, sf_dir, "events").project("event_id, cast(get_json_object(props, '$.k') AS bigint) AS k").frame


@query("list_functions", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))), 6) AS s, len(list_filter(embedding, lambda x: x > 0)) AS n, embedding[1]::DOUBLE AS f FROM embeddings")
def list_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel(spark, sf_dir, "embeddings").project("vec_id, round(aggregate(transform(embedding, x -> abs(cast(x AS double))), 0D, (a, b) -> a + b), 6) AS s, cast(size(filter(embedding, x -> x > 0)) AS bigint) AS n, cast(embedding[0] AS double) AS f").frame


# SQL that passes through

_PASS = {
    "sql_recursive": ("WITH RECURSIVE t(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 10) SELECT cast(n AS bigint) AS n, cast(f AS bigint) AS f FROM t", None),
    "sql_correlated": ("SELECT s_suppkey, s_acctbal FROM supplier s WHERE s_acctbal > (SELECT avg(s_acctbal) FROM supplier t WHERE t.s_nationkey = s.s_nationkey)", None),
    "sql_lateral": ("SELECT n_name, x.k FROM nation, LATERAL (SELECT n_nationkey * 2 AS k) x", None),
    "sql_cte_having": ("WITH big AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 10) SELECT c_custkey, total FROM big JOIN customer ON c_custkey = o_custkey", None),
    "tpch_q1": ("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18, 4))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 4))) AS DOUBLE) AS sum_base_price, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS sum_disc_price, CAST(sum(CAST(l_extendedprice * (1 - l_discount) * (1 + l_tax) AS DECIMAL(20, 6))) AS DOUBLE) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus", None),
    "tpch_q2": ("WITH offers AS (SELECT l_partkey, l_suppkey, min(l_extendedprice / l_quantity) AS cost FROM lineitem GROUP BY l_partkey, l_suppkey) SELECT s_acctbal, s_name, n_name, p_partkey, p_brand FROM part JOIN offers o ON p_partkey = o.l_partkey JOIN supplier ON s_suppkey = o.l_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE p_size < 25 AND p_type LIKE '%O%' AND r_name = 'EUROPE' AND o.cost = (SELECT min(o2.cost) FROM offers o2 JOIN supplier s2 ON s2.s_suppkey = o2.l_suppkey JOIN nation n2 ON s2.s_nationkey = n2.n_nationkey JOIN region r2 ON n2.n_regionkey = r2.r_regionkey WHERE o2.l_partkey = p_partkey AND r2.r_name = 'EUROPE')", None),
    "tpch_q7": ("SELECT supp_nation, cust_nation, l_year, CAST(sum(CAST(volume AS DECIMAL(18, 4))) AS DOUBLE) AS revenue FROM (SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(year(l_shipdate) AS BIGINT) AS l_year, l_extendedprice * (1 - l_discount) AS volume FROM supplier, lineitem, orders, customer, nation n1, nation n2 WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey AND ((n1.n_name = 'NATION_6' AND n2.n_name = 'NATION_7') OR (n1.n_name = 'NATION_7' AND n2.n_name = 'NATION_6')) AND l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31') AS shipping GROUP BY supp_nation, cust_nation, l_year", None),
    "tpch_q8": ("SELECT o_year, round(sum(CASE WHEN nation_name = 'NATION_2' THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share FROM (SELECT CAST(year(o_orderdate) AS BIGINT) AS o_year, l_extendedprice * (1 - l_discount) AS volume, n2.n_name AS nation_name FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey AND o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31' AND p_type = 'ECONOMY') AS all_nations GROUP BY o_year", None),
    "tpch_q9": ("SELECT nation_name, o_year, CAST(sum(CAST(amount AS DECIMAL(18, 4))) AS DOUBLE) AS sum_profit FROM (SELECT n_name AS nation_name, CAST(year(o_orderdate) AS BIGINT) AS o_year, l_extendedprice * (1 - l_discount) - p_retailprice * l_quantity AS amount FROM part, supplier, lineitem, orders, nation WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%ring%') AS profit GROUP BY nation_name, o_year", None),
    "tpch_q11": ("WITH held AS (SELECT l_partkey, CAST(sum(CAST(l_extendedprice * l_quantity AS DECIMAL(18, 4))) AS DOUBLE) AS value FROM lineitem, supplier, nation WHERE l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_7' GROUP BY l_partkey) SELECT l_partkey, value FROM held WHERE value > (SELECT sum(value) * 0.001 FROM held)", None),
    "tpch_q15": ("WITH revenue AS (SELECT l_suppkey AS supplier_no, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS total_revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-04-01' GROUP BY l_suppkey) SELECT s_suppkey, s_name, total_revenue FROM supplier, revenue WHERE s_suppkey = supplier_no AND total_revenue = (SELECT max(total_revenue) FROM revenue)", None),
    "tpch_q16": ("SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM lineitem, part WHERE p_partkey = l_partkey AND p_brand <> 'Brand#12' AND p_type NOT LIKE 'MED%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size", None),
    "tpch_q19": ("SELECT CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS revenue FROM lineitem, part WHERE p_partkey = l_partkey AND ((p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 21 AND p_size BETWEEN 1 AND 15) OR (p_brand = 'Brand#3' AND l_quantity BETWEEN 10 AND 30 AND p_size BETWEEN 1 AND 30) OR (p_brand = 'Brand#4' AND l_quantity BETWEEN 20 AND 40 AND p_size BETWEEN 1 AND 50))", None),
    "tpch_q20": ("SELECT s_name, s_suppkey FROM supplier, nation WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'red%') GROUP BY l_partkey, l_suppkey HAVING sum(l_quantity) > 0.5 * (SELECT avg(l_quantity) FROM lineitem)) AND s_nationkey = n_nationkey AND n_name IN ('NATION_3', 'NATION_4', 'NATION_5')", None),
    "tpch_q21": ("SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders, nation WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_returnflag = 'R' AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey) AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R') AND s_nationkey = n_nationkey AND n_regionkey = 2 GROUP BY s_name", None),
    "tpch_q3": ("SELECT l_orderkey, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1996-03-15' AND l_shipdate > TIMESTAMP '1996-03-15' GROUP BY l_orderkey", None),
    "tpch_q4": ("SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY o_orderpriority", None),
    "tpch_q5": ("SELECT n_name, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name", None),
    "tpch_q6": ("SELECT CAST(sum(CAST(l_extendedprice * l_discount AS DECIMAL(18, 4))) AS DOUBLE) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.03 AND 0.07 AND l_quantity < 24", None),
    "tpch_q10": ("SELECT c_custkey, c_name, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS revenue, n_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name, n_name", None),
    "tpch_q12": ("SELECT l_linestatus, sum(CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 1 ELSE 0 END)::BIGINT AS high, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY l_linestatus", "SELECT l_linestatus, sum(CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 1 ELSE 0 END) AS high, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY l_linestatus"),
    "tpch_q13": ("SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) t GROUP BY c_count", None),
    "tpch_q14": ("SELECT round(100 * sum(CASE WHEN p_type LIKE '%A%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo FROM lineitem JOIN part ON l_partkey = p_partkey", None),
    "tpch_q17": ("SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity < (SELECT 0.5 * avg(l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)", None),
    "tpch_q18": ("SELECT c_name, o_orderkey, o_totalprice, round(sum(l_quantity), 2) AS qty FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 150) GROUP BY c_name, o_orderkey, o_totalprice", None),
    "tpch_q22": ("SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY c_nationkey", None),
}
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
for _name, (_duck, _spark) in _PASS.items():

    def _pass(spark: SparkSession, sf_dir: str, text: str = _spark or _duck) -> DataFrame:
        con = Connection(spark)
        frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if t in text}
        import re

        marked = re.sub(r"(?<![\w.])(" + "|".join(frames) + r")\b(?![\w.])", r"{\1}", text) if frames else text
        return con.spark.sql(marked, **frames)

    query(_name, _duck)(_pass)


@query("udf_scalar", "SELECT o_orderkey, o_orderkey * 2 + 1 AS v FROM orders")
def udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pyarrow.compute as pc

    con = Connection(spark)
    con.create_function("lakemill_twice", lambda x: pc.add(pc.multiply(x, 2), 1), ["BIGINT"], "BIGINT", type="arrow")
    return rel(spark, sf_dir, "orders").project("o_orderkey, lakemill_twice(o_orderkey) AS v").frame


@query("udf_map_batches", "SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000")
def udf_map_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pyarrow.compute as pc

    return rel(spark, sf_dir, "orders").project("o_custkey, o_totalprice").map_batches(lambda b: b.filter(pc.greater(b.column("o_totalprice"), 200000))).frame


@query("udf_map", "SELECT n_nationkey, length(n_name) AS v FROM nation")
def udf_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel(spark, sf_dir, "nation").map(len, "n_name", "v", "BIGINT").project("n_nationkey, v").frame


@query("table_function", "SELECT i AS id, i * i AS sq FROM range(0, 20) AS t(i)")
def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Connection(spark).table_function_udf(lambda n: ((i, i * i) for i in range(n)), 20, schema="id bigint, sq bigint").frame


@query("values", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) AS t(col0, col1)")
def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Connection(spark).values("(1, 'a'), (2, 'b')").frame
