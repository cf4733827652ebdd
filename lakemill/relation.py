"""Relations: the relational API over lazy DataFrames.

Every method gives a new relation and runs nothing; Catalyst plans the whole chain. Aggregates take
``groups`` (or, without them, the projected columns as keys) and become window functions where a
``window_spec`` is given.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemill import dialect
from lakemill.expressions import Expression, column_of

JOINS = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "full": "full", "semi": "left_semi", "anti": "left_anti", "cross": "cross"}
_KEYS = re.compile(r"\s*[A-Za-z_]\w*(\s*,\s*[A-Za-z_]\w*)*\s*")


class Relation:
    def __init__(self, df: DataFrame, name: str = "rel") -> None:
        self.frame, self.alias_name = df, name
        self._rows: Iterator | None = None

    def _new(self, df: DataFrame) -> Relation:
        return Relation(df, self.alias_name)

    # projection, filters, names

    def filter(self, condition: str | Expression | Column) -> Relation:
        return self._new(self.frame.where(column_of(condition)))

    where = filter

    def project(self, *exprs: str | Expression | Column) -> Relation:
        cols = [c for e in exprs for c in (dialect.split_top(e) if isinstance(e, str) else [e])]
        return self._new(self.frame.select(*(F.col("*") if isinstance(c, str) and c == "*" else column_of(c) for c in cols)))

    select = project

    def select_dtypes(self, types: list[str]) -> Relation:
        wanted = {T.DataType.fromDDL(dialect.spark_type(t)).simpleString() for t in types}
        return self._new(self.frame.select([F.col(f"`{f.name}`") for f in self.frame.schema if f.dataType.simpleString() in wanted]))

    select_types = select_dtypes

    def set_alias(self, name: str) -> Relation:
        return Relation(self.frame.alias(name), name)

    def query(self, view_name: str, sql: str) -> Relation:
        """SQL over this relation under a name that holds for this statement alone."""
        pattern = re.compile(rf"(?<![\w.`])`?{re.escape(view_name)}`?(?![\w`])")
        return self._new(self.frame.sparkSession.sql(pattern.sub("{__rel}", sql.replace("{", "{{").replace("}", "}}")), __rel=self.frame))

    def with_column(self, name: str, value: Any) -> Relation:
        """A column appended from an expression, or from a chain of media operations."""
        return self._new(value.append(self.frame, name) if hasattr(value, "append") else self.frame.withColumn(name, column_of(value)))

    # joins and set operations

    def join(self, other: Relation, condition: str | Expression | Column | list[str], how: str = "inner") -> Relation:
        """``condition`` is a list of shared column names (each kept once) or an expression over lhs and rhs."""
        kind = JOINS.get(how.lower())
        if kind is None:
            raise ValueError(f"unknown join type {how!r}; known are {', '.join(JOINS)}")
        if kind == "cross":
            return self.cross(other)
        keys = condition if isinstance(condition, list) else dialect.split_top(condition) if isinstance(condition, str) and _KEYS.fullmatch(condition) else None
        left, right = self.frame.alias("lhs"), other.frame.alias("rhs")
        return self._new(left.join(right, keys if keys else column_of(condition), kind))

    def cross(self, other: Relation) -> Relation:
        return self._new(self.frame.crossJoin(other.frame))

    def union(self, other: Relation) -> Relation:
        return self._new(self.frame.union(other.frame))

    union_all = union

    def distinct_union(self, other: Relation) -> Relation:
        return self._new(self.frame.union(other.frame).distinct())

    def intersect(self, other: Relation) -> Relation:
        return self._new(self.frame.intersect(other.frame))

    def except_(self, other: Relation) -> Relation:
        return self._new(self.frame.subtract(other.frame))

    # order, limits, distinct, reshaping

    def order(self, keys: str | Expression | Column) -> Relation:
        if not isinstance(keys, str):
            return self._new(self.frame.orderBy(column_of(keys)))
        cols = []
        for k in dialect.split_top(keys):
            m = re.fullmatch(r"(.*?)(?:\s+(asc|desc))?(?:\s+nulls\s+(first|last))?", k, re.IGNORECASE | re.DOTALL)
            way, nulls = (m[2] or "asc").lower(), (m[3] or "last").lower()
            cols.append(getattr(F.expr(m[1]), f"{way}_nulls_{nulls}")())
        return self._new(self.frame.orderBy(*cols))

    sort = order

    def limit(self, n: int, offset: int = 0) -> Relation:
        return self._new((self.frame.offset(offset) if offset else self.frame).limit(n))

    def distinct(self, columns: list[str] | None = None) -> Relation:
        return self._new(self.frame.dropDuplicates(columns) if columns else self.frame.distinct())

    def unnest(self, column: str, recursive: bool = False) -> Relation:
        """One row per element, the column last; recursive goes down to elements that are no lists."""
        others = [F.col(f"`{c}`") for c in self.frame.columns if c != column]
        kind, value = self.frame.schema[column].dataType, F.col(f"`{column}`")
        while recursive and isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
            value, kind = F.flatten(F.filter(value, lambda x: x.isNotNull())), kind.elementType
        return self._new(self.frame.select(*others, F.explode(value).alias(column)))

    explode = unnest

    def sample(self, spec: str, seed: int = 0) -> Relation:
        """``10%`` of the rows, each by itself; ``100 ROWS`` or ``reservoir(50)`` exactly so many."""
        if m := re.fullmatch(r"\s*([\d.]+)\s*(?:%|percent)\s*", spec, re.IGNORECASE):
            return self._new(self.frame.sample(float(m[1]) / 100, seed))
        m = re.fullmatch(r"\s*(?:reservoir\s*\(\s*(\d+)(?:\s*rows)?\s*\)|(\d+)(?:\s*rows)?)\s*", spec, re.IGNORECASE)
        if not m:
            raise ValueError(f"unknown sample {spec!r}")
        return self._new(self.frame.orderBy(F.rand(seed)).limit(int(m[1] or m[2])))

    def repartition(self, n: int, *keys: str) -> Relation:
        return self._new(self.frame.repartition(n, *keys))

    def local_exchange(self, n: int) -> Relation:
        return self._new(self.frame.coalesce(n))

    def num_partitions(self) -> int:
        return self.frame.rdd.getNumPartitions()

    # aggregates and windows

    def aggregate(self, aggr_expr: str, group_expr: str = "") -> Relation:
        """Aggregates by keys; without keys by all the expressions that aggregate nothing."""
        exprs, keys = dialect.split_top(aggr_expr), dialect.split_top(group_expr)
        if keys:
            return self._new(self.frame.groupBy(*map(F.expr, keys)).agg(*map(F.expr, exprs)).select(F.col("*")) if not set(keys) & set(exprs) else self._sql(exprs, "GROUP BY " + ", ".join(keys)))
        return self._new(self._sql(exprs, "GROUP BY ALL"))

    def _sql(self, exprs: list[str], tail: str) -> DataFrame:
        text = f"SELECT {', '.join(exprs)} FROM {{__rel}} {tail}".replace("{", "{{").replace("}", "}}").replace("{{__rel}}", "{__rel}")
        return self.frame.sparkSession.sql(text, __rel=self.frame)

    def agg_or_window(self, call: str, name: str, groups: str = "", window_spec: str = "", projected_columns: str = "", windowed: str | None = None) -> Relation:
        if window_spec:
            shown = dialect.split_top(projected_columns)
            value = windowed if windowed is not None else f"{call} {dialect.over(window_spec)}"
            return self._new(self.frame.select(*(F.col("*") if c == "*" else F.expr(c) for c in shown), F.expr(value).alias(name)))
        return self._new(self.frame.groupBy(*map(F.expr, self._keys(groups, projected_columns))).agg(F.expr(call).alias(name)))

    @staticmethod
    def _keys(groups: str, projected_columns: str) -> list[str]:
        return dialect.split_top(re.split(r"\border\s+by\b", groups, flags=re.IGNORECASE)[0].strip().rstrip(",")) or dialect.split_top(projected_columns)

    def _call(self, fn: str, column: str, rest: str = "", groups: str = "", window_spec: str = "", projected_columns: str = "", name: str | None = None) -> Relation:
        x = dialect.quoted(self.frame, column)
        return self.agg_or_window(f"{fn}({x}{rest})", name or f"{fn}({column})", groups, window_spec, projected_columns)

    def count(self, column: str = "*", groups: str = "", window_spec: str = "", projected_columns: str = "") -> Relation:
        x = "*" if column in ("*", None) else dialect.quoted(self.frame, column)
        return self.agg_or_window(f"count({x})", "count_star()" if x == "*" else f"count({column})", groups, window_spec, projected_columns)

    def list(self, column: str, groups: str = "", window_spec: str = "", projected_columns: str = "") -> Relation:
        x = dialect.quoted(self.frame, column)
        windowed = f"transform(collect_list(struct({x} AS v)) {dialect.over(window_spec)}, s -> s.v)" if window_spec else None
        return self.agg_or_window(dialect.list_with_nulls_sql(x), f"list({column})", groups, window_spec, projected_columns, windowed)

    def string_agg(self, column: str, sep: str = ",", groups: str = "", window_spec: str = "", projected_columns: str = "") -> Relation:
        x, mark = dialect.quoted(self.frame, column), sep.replace("'", "\\'")
        windowed = f"nullif(array_join(collect_list(cast({x} AS string)) {dialect.over(window_spec)}, '{mark}'), '')" if window_spec else None
        return self.agg_or_window(f"string_agg(cast({x} AS string), '{mark}')", f"string_agg({column})", groups, window_spec, projected_columns, windowed)

    def product(self, column: str, groups: str = "", window_spec: str = "", projected_columns: str = "") -> Relation:
        value, name = F.product(F.expr(dialect.quoted(self.frame, column))), f"product({column})"
        if not window_spec:
            keys = dialect.split_top(groups) or dialect.split_top(projected_columns)
            return self._new(self.frame.groupBy(*map(F.expr, keys)).agg(value.alias(name)))
        x = dialect.quoted(self.frame, column)
        windowed = f"aggregate(collect_list(cast({x} AS double)) {dialect.over(window_spec)}, 1D, (a, b) -> a * b)"
        return self.agg_or_window("", name, groups, window_spec, projected_columns, windowed)

    def _quantile(self, column: str, q: float | list[float], discrete: bool, groups: str, window_spec: str, projected_columns: str, name: str) -> Relation:
        x = dialect.quoted(self.frame, column)
        fn = "percentile_disc" if discrete else "percentile_cont"
        many = q if isinstance(q, list) else [q]
        if not window_spec and many and isinstance(self.frame.select(F.expr(x)).schema[0].dataType, T.NumericType):
            return self._new(dialect.grouped_quantiles(self.frame, x, many, discrete, self._keys(groups, projected_columns), name, not isinstance(q, list)))
        plain = [f"{fn}({v}) WITHIN GROUP (ORDER BY {x})" for v in many]
        framed = [dialect.framed_quantile_sql(x, v, dialect.over(window_spec), discrete) for v in many] if window_spec else plain
        pack = (lambda v: f"array({', '.join(v)})") if isinstance(q, list) else (lambda v: v[0])
        return self.agg_or_window(pack(plain), name, groups, window_spec, projected_columns, pack(framed))

    def median(self, column: str, groups: str = "", window_spec: str = "", projected_columns: str = "") -> Relation:
        return self._quantile(column, 0.5, False, groups, window_spec, projected_columns, f"median({column})")

    def quantile_cont(self, column: str, q: float | list[float] = 0.5, groups: str = "", window_spec: str = "", projected_columns: str = "") -> Relation:
        return self._quantile(column, q, False, groups, window_spec, projected_columns, f"quantile_cont({column})")

    def quantile_disc(self, column: str, q: float | list[float] = 0.5, groups: str = "", window_spec: str = "", projected_columns: str = "") -> Relation:
        return self._quantile(column, q, True, groups, window_spec, projected_columns, f"quantile_disc({column})")

    quantile = quantile_disc

    def arg_max(self, arg_column: str, value_column: str, groups: str = "", window_spec: str = "", projected_columns: str = "") -> Relation:
        return self._call("max_by", arg_column, f", {dialect.quoted(self.frame, value_column)}", groups, window_spec, projected_columns, f"arg_max({arg_column})")

    def arg_min(self, arg_column: str, value_column: str, groups: str = "", window_spec: str = "", projected_columns: str = "") -> Relation:
        return self._call("min_by", arg_column, f", {dialect.quoted(self.frame, value_column)}", groups, window_spec, projected_columns, f"arg_min({arg_column})")

    def mode(self, column: str, groups: str = "", window_spec: str = "", projected_columns: str = "") -> Relation:
        """The most frequent value; of several the smallest."""
        return self._call("mode", column, ", true", groups, window_spec, projected_columns, f"mode({column})")

    def any_value(self, column: str, groups: str = "", window_spec: str = "", projected_columns: str = "") -> Relation:
        return self._call("any_value", column, ", true", groups, window_spec, projected_columns, f"any_value({column})")

    def first(self, column: str, order: str, groups: str = "", projected_columns: str = "") -> Relation:
        """The value of the first row by ``order``: rows of a table have no order of their own."""
        return self._call("min_by", column, f", {order}", groups, "", projected_columns, f"first({column})")

    def last(self, column: str, order: str, groups: str = "", projected_columns: str = "") -> Relation:
        return self._call("max_by", column, f", {order}", groups, "", projected_columns, f"last({column})")

    def geomean(self, column: str, groups: str = "", projected_columns: str = "") -> Relation:
        x = dialect.quoted(self.frame, column)
        return self.agg_or_window(f"exp(avg(ln({x})))", f"geomean({column})", groups, "", projected_columns)

    def fsum(self, column: str, groups: str = "", window_spec: str = "", projected_columns: str = "") -> Relation:
        """A sum whose rounding doesn't depend on the order: over decimals of 38 digits, 12 behind the point."""
        x = dialect.quoted(self.frame, column)
        windowed = f"cast(sum(cast({x} AS decimal(38,12))) {dialect.over(window_spec)} AS double)" if window_spec else None
        return self.agg_or_window(f"cast(sum(cast({x} AS decimal(38,12))) AS double)", f"fsum({column})", groups, window_spec, projected_columns, windowed)

    def favg(self, column: str, groups: str = "", window_spec: str = "", projected_columns: str = "") -> Relation:
        x = dialect.quoted(self.frame, column)
        w = dialect.over(window_spec) if window_spec else ""
        call = f"cast(sum(cast({x} AS decimal(38,12))) {w} AS double) / nullif(count({x}) {w}, 0)"
        return self.agg_or_window(call, f"favg({column})", groups, window_spec, projected_columns, call)

    def bitstring_agg(self, column: str, min: int | None = None, max: int | None = None, groups: str = "", window_spec: str = "", projected_columns: str = "") -> Relation:  # noqa: A002
        """A string of a 0 or 1 for each integer of [min, max]; without bounds those of the column."""
        if (min is None) != (max is None):
            raise ValueError("bitstring_agg takes both bounds or neither")
        x = dialect.quoted(self.frame, column)
        if not isinstance(self.frame.selectExpr(x).schema[0].dataType, T.IntegralType):
            raise TypeError("bitstring_agg takes integers")
        if min is None:
            min, max = self.frame.selectExpr(f"min({x})", f"max({x})").first()  # noqa: A001
        w = dialect.over(window_spec) if window_spec else ""
        call = f"array_join(transform(sequence({min}L, {max}L), i -> if(array_contains(transform(collect_set({x}) {w}, v -> cast(v AS bigint)), i), '1', '0')), '')"
        return self.agg_or_window(call, f"bitstring_agg({column})", groups, window_spec, projected_columns, call)

    def histogram(self, column: str, groups: str = "", window_spec: str = "", projected_columns: str = "") -> Relation:
        x = dialect.quoted(self.frame, column)
        if window_spec:
            values = f"collect_list({x}) {dialect.over(window_spec)}"
            call = f"map_from_entries(transform(array_sort(array_distinct({values})), v -> struct(v, size(filter({values}, u -> u = v)))))"
            return self.agg_or_window("", f"histogram({column})", groups, window_spec, projected_columns, call)
        return self._new(dialect.histogram(self.frame, x, dialect.split_top(groups) or dialect.split_top(projected_columns)))

    def value_counts(self, column: str, groups: str = "") -> Relation:
        keys = [*dict.fromkeys([*dialect.split_top(groups), column])]
        return self._new(self.frame.groupBy(*map(F.expr, keys)).agg(F.count(F.expr(column)).alias(f"count({column})")))

    def aggregate_udf(self, fn: Callable[[pa.Table], Any], columns: list[str], group_by: list[str] | None = None, result_name: str = "result", schema: str = "double") -> Relation:
        """``fn`` over the Arrow table of each group: a value, or a dict of values where ``schema`` names columns."""
        keys = group_by or []
        fields = [self.frame.schema[k] for k in keys]
        own = T.StructType.fromDDL(schema) if " " in schema else T.StructType.fromDDL(f"`{result_name}` {schema}")
        out = T.StructType([*fields, *own.fields])

        def run(table: pa.Table) -> pa.Table:
            got = fn(table.select(columns))
            row = {k: table[k][0].as_py() for k in keys} | (got if isinstance(got, dict) else {own[0].name: got})
            return pa.Table.from_pylist([row])

        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(out)
        grouped = self.frame.select(*dict.fromkeys([*keys, *columns])).groupBy(*keys)
        return self._new(grouped.applyInArrow(lambda t: run(t).cast(kind), out))

    def window_fn(self, call: str, window_spec: str, projected_columns: str = "", name: str | None = None) -> Relation:
        return self.agg_or_window(call, name or call.split("(")[0] + "()", "", window_spec or "()", projected_columns)

    def row_number(self, window_spec: str, projected_columns: str = "") -> Relation:
        return self.window_fn("row_number()", window_spec, projected_columns)

    def rank(self, window_spec: str, projected_columns: str = "") -> Relation:
        return self.window_fn("rank()", window_spec, projected_columns)

    def dense_rank(self, window_spec: str, projected_columns: str = "") -> Relation:
        return self.window_fn("dense_rank()", window_spec, projected_columns)

    rank_dense = dense_rank

    def percent_rank(self, window_spec: str, projected_columns: str = "") -> Relation:
        return self.window_fn("percent_rank()", window_spec, projected_columns)

    def cume_dist(self, window_spec: str, projected_columns: str = "") -> Relation:
        return self.window_fn("cume_dist()", window_spec, projected_columns)

    def n_tile(self, window_spec: str, num_buckets: int, projected_columns: str = "") -> Relation:
        return self.window_fn(f"ntile({num_buckets})", window_spec, projected_columns)

    def _ordered_value(self, fn: str, column: str, rest: str, window_spec: str, projected_columns: str) -> Relation:
        nulls = ""
        if m := re.search(r"\b(ignore|respect)\s+nulls\b", window_spec, re.IGNORECASE):
            nulls, window_spec = m[0].upper(), window_spec[: m.start()] + window_spec[m.end() :]
        x = dialect.quoted(self.frame, column)
        return self.agg_or_window("", f"{fn}({column})", "", window_spec or "()", projected_columns, f"{fn}({x}{rest}) {nulls} {dialect.over(window_spec)}")

    def first_value(self, column: str, window_spec: str = "", projected_columns: str = "") -> Relation:
        return self._ordered_value("first_value", column, "", window_spec, projected_columns)

    def last_value(self, column: str, window_spec: str = "", projected_columns: str = "") -> Relation:
        return self._ordered_value("last_value", column, "", window_spec, projected_columns)

    def nth_value(self, column: str, window_spec: str, offset: int, projected_columns: str = "") -> Relation:
        return self._ordered_value("nth_value", column, f", {offset}", window_spec, projected_columns)

    def lag(self, column: str, window_spec: str, offset: int = 1, default_value: str = "NULL", projected_columns: str = "") -> Relation:
        return self._ordered_value("lag", column, f", {offset}, {default_value}", window_spec, projected_columns)

    def lead(self, column: str, window_spec: str, offset: int = 1, default_value: str = "NULL", projected_columns: str = "") -> Relation:
        return self._ordered_value("lead", column, f", {offset}, {default_value}", window_spec, projected_columns)

    def generic_window_function(self, function_name: str, function_parameters: str, window_spec: str, projected_columns: str = "") -> Relation:
        return self.window_fn(f"{function_name}({function_parameters})", window_spec, projected_columns)

    def describe(self) -> Relation:
        """Of each column: min, max, about how many distinct, mean, deviation, quartiles, count and share of nulls."""
        parts = []
        for f in self.frame.schema:
            x, numeric = F.col(f"`{f.name}`"), isinstance(f.dataType, T.NumericType)
            number = x.cast("double") if numeric else F.lit(None).cast("double")
            parts.append(F.struct(
                F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("column_type"), F.min(x).cast("string").alias("min"), F.max(x).cast("string").alias("max"),
                F.approx_count_distinct(x).alias("approx_unique"), F.avg(number).alias("avg"), F.stddev(number).alias("std"), *(F.percentile_approx(number, q).alias(n) for q, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))),
                F.count(F.lit(1)).alias("count"), F.round(100 * (1 - F.try_divide(F.count(x), F.count(F.lit(1)))), 2).alias("null_percentage"),
            ))
        return self._new(self.frame.agg(F.array(*parts).alias("r")).select(F.inline("r")))

    # user functions over batches

    def map_batches(self, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType | None = None, batch_size: int | None = None) -> Relation:
        """``fn`` over Arrow batches of at most ``batch_size`` rows; it may change how many there are."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(0, b.num_rows, batch_size or max(b.num_rows, 1)):
                    got = fn(b.slice(i, batch_size or b.num_rows))
                    yield from got.combine_chunks().to_batches() if isinstance(got, pa.Table) else [got]

        return self._new(self.frame.mapInArrow(run, schema or self.frame.schema))

    flat_map = map_batches

    def map(self, fn: Callable[[Any], Any], column: str, output_column: str = "result", return_type: str = "string") -> Relation:
        """A Python function over the values of a column, through Arrow."""
        return self._new(self.frame.withColumn(output_column, F.udf(fn, dialect.spark_type(return_type), useArrow=True)(F.col(f"`{column}`"))))

    def transform(self, fn: Callable[..., DataFrame], *args: Any, **kwargs: Any) -> Relation:
        """A function of the library from DataFrame to DataFrame, as a step of the chain."""
        return self._new(fn(self.frame, *args, **kwargs))

    # looking

    @property
    def columns(self) -> list[str]:
        return self.frame.columns

    @property
    def types(self) -> list[str]:
        return [t for _, t in self.frame.dtypes]

    dtypes = types

    @property
    def shape(self) -> tuple[int, int]:
        return self.frame.count(), len(self.frame.columns)

    def num_rows(self) -> int:
        return self.frame.count()

    __len__ = num_rows

    def show(self, n: int = 20) -> None:
        self.frame.show(n, truncate=False)

    def explain(self, mode: str = "formatted") -> str:
        spark = self.frame.sparkSession
        return spark._jvm.PythonSQLUtils.explainString(self.frame._jdf.queryExecution(), mode)

    def plan_tree(self) -> str:
        return self.frame._jdf.queryExecution().logical().treeString()

    def plan_json(self) -> list[dict]:
        return json.loads(self.frame._jdf.queryExecution().optimizedPlan().toJSON())

    def stages(self) -> int:
        """How many exchanges divide the physical plan."""
        return len(re.findall(r"\bExchange\b", self.frame._jdf.queryExecution().executedPlan().treeString()))

    # results

    def execute(self) -> Relation:
        """Computes the relation once; later steps read the result. The cursor starts again."""
        self.frame = self.frame.persist()
        self.frame.count()
        self._rows = None
        return self

    def fetchall(self) -> list[tuple]:
        return [tuple(r) for r in self.frame.collect()]

    def fetchone(self) -> tuple | None:
        if self._rows is None:
            self._rows = self.frame.toLocalIterator()
        row = next(self._rows, None)
        return None if row is None else tuple(row)

    def fetchmany(self, n: int = 1) -> list[tuple]:
        return [r for _ in range(n) if (r := self.fetchone()) is not None]

    def df(self):  # noqa: ANN201
        return self.frame.toPandas()

    to_df = fetchdf = df

    def to_arrow(self) -> pa.Table:
        return self.frame.toArrow()

    arrow = fetch_arrow_table = to_arrow

    def fetchnumpy(self) -> dict[str, Any]:
        return {c: v.to_numpy(zero_copy_only=False) for c, v in zip(self.frame.columns, self.frame.toArrow().columns, strict=True)}

    def record_batch_stream(self, rows_per_batch: int = 100_000) -> Iterator[pa.RecordBatch]:
        """Batches as they are needed; a partition at a time comes to the driver."""
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, rows = to_arrow_schema(self.frame.schema), []
        for r in self.frame.toLocalIterator(prefetchPartitions=True):
            rows.append(r.asDict(recursive=True))
            if len(rows) >= rows_per_batch:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, schema)

    fetch_record_batch = record_batch_stream

    def to_arrow_reader(self) -> pa.RecordBatchReader:
        table = self.frame.toArrow()
        return table.to_reader()

    def fetch_df_chunk(self, rows: int = 2048):  # noqa: ANN201
        import pandas as pd

        return pd.DataFrame(self.fetchmany(rows), columns=self.frame.columns)

    # writing

    def to_parquet(self, path: str, mode: str = "error", partition_by: list[str] | None = None) -> None:
        self.frame.write.mode(mode).parquet(path, partitionBy=partition_by)

    write_parquet = to_parquet

    def to_csv(self, path: str, sep: str = ",", header: bool = True, mode: str = "error", na_rep: str = "") -> None:
        self.frame.write.mode(mode).csv(path, sep=sep, header=header, nullValue=na_rep, emptyValue='""', quote='"', escape='"')

    write_csv = to_csv

    def pl(self):  # noqa: ANN201
        """A polars frame, where polars is installed."""
        import polars

        return polars.from_arrow(self.frame.toArrow())

    def write_iceberg(self, table: str, mode: str = "append") -> None:
        """One commit to a table of that format; needs its jar and catalog."""
        writer = self.frame.writeTo(table)
        writer.append() if mode == "append" else writer.using("iceberg").createOrReplace()

    def write_versioned(self, path: str, mode: str = "create") -> int:
        """A version of a dataset of the library's own format."""
        from lakemill.sources.versioned import Dataset

        return Dataset(self.frame.sparkSession, path).write(self.frame, mode)

    def to_table(self, name: str) -> None:
        self.frame.write.saveAsTable(name)

    create = to_table

    def to_view(self, name: str, replace: bool = True) -> Relation:
        (self.frame.createOrReplaceTempView if replace else self.frame.createTempView)(name)
        return self._new(self.frame.sparkSession.table(name))

    create_view = to_view

    def insert_into(self, name: str) -> None:
        self.frame.write.insertInto(name)


_AGGREGATES = {
    "sum": "sum", "avg": "avg", "mean": "avg", "min": "min", "max": "max", "stddev_samp": "stddev_samp", "stddev": "stddev_samp", "std": "stddev_samp", "var_samp": "var_samp", "variance": "var_samp",
    "var": "var_samp", "stddev_pop": "stddev_pop", "std_pop": "stddev_pop", "var_pop": "var_pop", "bit_and": "bit_and", "bit_or": "bit_or", "bit_xor": "bit_xor", "bool_and": "bool_and", "bool_or": "bool_or",
}


def _aggregate(api: str, fn: str) -> Callable[..., Relation]:
    def method(self: Relation, column: str, groups: str = "", window_spec: str = "", projected_columns: str = "") -> Relation:
        return self._call(fn, column, "", groups, window_spec, projected_columns, f"{api}({column})")

    method.__name__ = api
    method.__doc__ = f"{fn} of a column, by groups or over a window."
    return method


for _api, _fn in _AGGREGATES.items():
    setattr(Relation, _api, _aggregate(_api, _fn))
