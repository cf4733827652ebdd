"""Connections: SQL, scans, registered objects and user functions over a Spark session."""

from __future__ import annotations

import inspect
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lakemill import dialect, sources
from lakemill.relation import Relation
from lakemill.session import build_session

_CHANGE = re.compile(r"\s*(?:insert\s+(?:into|overwrite)(?:\s+table)?|update|delete\s+from|create\s+(?:or\s+replace\s+)?table(?:\s+if\s+not\s+exists)?|drop\s+table(?:\s+if\s+exists)?|alter\s+table|truncate\s+table|merge\s+into)\s+([`\w.]+)", re.IGNORECASE)
_NAME = re.compile(r"\b(?:from|join)\s+([A-Za-z_]\w*)\b(?!\s*[.(])", re.IGNORECASE)


def connect(database: str | None = None, read_only: bool = False, config: dict[str, str] | None = None) -> Connection:
    """A connection to the running session. ``database`` names a catalog database to use."""
    con = Connection(build_session(**(config or {})), read_only)
    if database and database not in (":memory:", ":default:"):
        con.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
        con.spark.sql(f"USE `{database}`")
    return con


class Connection:
    def __init__(self, spark: SparkSession, read_only: bool = False) -> None:
        self.spark, self.read_only, self._last, self._undo = spark, read_only, None, None

    def _frame(self, x: Any) -> DataFrame:
        if isinstance(x, DataFrame):
            return x
        if isinstance(x, Relation):
            return x.frame
        if isinstance(x, (pa.RecordBatch, pa.RecordBatchReader)):
            x = pa.Table.from_batches([x]) if isinstance(x, pa.RecordBatch) else x.read_all()
        if isinstance(x, (pa.Table, pd.DataFrame)):
            return self.spark.createDataFrame(x)
        if hasattr(x, "to_arrow"):
            return self.spark.createDataFrame(x.to_arrow())
        raise TypeError(f"no table can be made of {type(x).__name__}")

    # SQL

    def sql(self, query: str, params: list | dict | None = None) -> Relation:
        """A lazy relation of a SELECT, changes at once. Variables of the caller that hold tables count as tables."""
        if self.read_only and re.match(r"\s*(insert|update|delete|create|drop|alter|truncate|merge)\b", query, re.IGNORECASE):
            raise PermissionError("the connection is read only")
        self._replace(query, inspect.currentframe().f_back)
        self._keep(query)
        return Relation(self.spark.sql(query, args=params) if params else self.spark.sql(query))

    query = sql

    def _replace(self, query: str, caller: Any) -> None:
        for name in set(_NAME.findall(query)):
            if self.spark.catalog.tableExists(name):
                continue
            frame, depth = caller, 0
            while frame is not None and depth < 3:
                x = frame.f_locals.get(name, frame.f_globals.get(name))
                if isinstance(x, (DataFrame, Relation, pa.Table, pa.RecordBatch, pa.RecordBatchReader, pd.DataFrame)):
                    self._frame(x).createOrReplaceTempView(name)
                    break
                frame, depth = frame.f_back, depth + 1

    def execute(self, query: str, params: list | dict | None = None) -> Connection:
        self._replace(query, inspect.currentframe().f_back)
        self._keep(query)
        self._last = Relation(self.spark.sql(query, args=params) if params else self.spark.sql(query))
        return self

    def executemany(self, query: str, parameters: Iterable[list]) -> Connection:
        for p in parameters:
            self.execute(query, p)
        return self

    def execute_batch(self, text: str) -> None:
        for statement in dialect.split_top(text, ";"):
            self._keep(statement)
            self.spark.sql(statement)

    def fetchall(self) -> list[tuple]:
        return self._last.fetchall() if self._last else []

    def fetchone(self) -> tuple | None:
        return self._last.fetchone() if self._last else None

    def fetchmany(self, n: int = 1) -> list[tuple]:
        return self._last.fetchmany(n) if self._last else []

    def df(self) -> pd.DataFrame:
        return self._last.df()

    @property
    def rowcount(self) -> int:
        """Rows of the last statement's result; -1 before one."""
        return self._last.num_rows() if self._last else -1

    def cursor(self) -> Connection:
        return Connection(self.spark.newSession(), self.read_only)

    duplicate = cursor

    def close(self) -> None:
        self._last = None

    # transactions: what tables held before their first change is kept aside, and put back by a rollback

    def begin(self) -> Connection:
        """Changes by this connection from now on go together; other connections see them at once."""
        if self._undo is not None:
            raise RuntimeError("a transaction has begun already")
        self._undo = {}
        return self

    def _keep(self, query: str) -> None:
        m = _CHANGE.match(query) if self._undo is not None else None
        if not m or (name := m[1].strip("`")) in self._undo:
            return
        if self.spark.catalog.tableExists(name):
            copy = f"{name}__before_{uuid.uuid4().hex[:8]}"
            self.spark.table(name).write.saveAsTable(copy)
            self._undo[name] = copy
        else:
            self._undo[name] = None

    def _end(self) -> dict[str, str | None]:
        if self._undo is None:
            raise RuntimeError("no transaction has begun")
        undo, self._undo = self._undo, None
        return undo

    def commit(self) -> Connection:
        for copy in self._end().values():
            if copy:
                self.spark.sql(f"DROP TABLE {copy}")
        return self

    def rollback(self) -> Connection:
        for name, copy in self._end().items():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            if copy:
                self.spark.sql(f"ALTER TABLE {copy} RENAME TO {name}")
        return self

    # the session

    def enable_profiling(self) -> Connection:
        """Times of Python functions are gathered; ``profile`` shows them."""
        self.spark.conf.set("spark.sql.pyspark.udf.profiler", "perf")
        return self

    def disable_profiling(self) -> Connection:
        self.spark.conf.unset("spark.sql.pyspark.udf.profiler")
        return self

    def load_extension(self, path: str) -> Connection:
        """A jar on the class path of the session."""
        self.spark.sql(f"ADD JAR '{path}'")
        return self

    install_extension = load_extension

    # scans

    def read_csv(self, path: Any, **options: Any) -> Relation:
        return Relation(sources.read_csv(self.spark, path, **options))

    def from_csv_auto(self, path: Any, **options: Any) -> Relation:
        return Relation(sources.read_csv(self.spark, path, **({"header": True} | options)))

    def read_json(self, path: str, **options: Any) -> Relation:
        return Relation(self.spark.read.json(path, **options))

    def read_parquet(self, path: str | list[str]) -> Relation:
        return Relation(self.spark.read.parquet(*([path] if isinstance(path, str) else path)))

    from_parquet = read_parquet

    def read_hive(self, path: str, hive_partitioning: bool = True, union_by_name: bool = False) -> Relation:
        return Relation(sources.read_hive(self.spark, path, hive_partitioning, union_by_name))

    def read_iceberg(self, path: str, snapshot_id: int | None = None, version: str | None = None) -> Relation:
        """Needs the table format's jar on the class path; Spark says so where it is missing. ``version`` is a branch or tag."""
        reader = self.spark.read.format("iceberg")
        reader = reader.option("snapshot-id", snapshot_id) if snapshot_id else reader
        return Relation((reader.option("branch", version) if version else reader).load(path))

    def iceberg_snapshots(self, path: str) -> Relation:
        return Relation(self.spark.read.format("iceberg").load(f"{path}.snapshots"))

    def read_versioned(self, path: str, version: int | str | None = None, columns: list[str] | None = None, filter: str | None = None) -> Relation:  # noqa: A002
        from lakemill.sources.versioned import Dataset

        return Relation(Dataset(self.spark, path).read(version, columns, filter))

    def from_arrow(self, x: Any) -> Relation:
        return Relation(self._frame(x))

    from_df = from_arrow

    def table(self, name: str) -> Relation:
        return Relation(self.spark.table(name), name)

    view = table

    def values(self, *rows: Any) -> Relation:
        """Literal rows: one row, a list of rows, or the text of a VALUES list. Columns are col0, col1, ..."""
        if len(rows) == 1 and isinstance(rows[0], str):
            df = self.spark.sql(f"SELECT * FROM VALUES {rows[0]}")
        else:
            data = rows[0] if len(rows) == 1 and isinstance(rows[0], list) else [rows if not isinstance(rows[0], tuple) else rows[0]] if len(rows) == 1 or not isinstance(rows[0], tuple) else list(rows)
            df = self.spark.createDataFrame([tuple(r) for r in data])
        return Relation(df.toDF(*(f"col{i}" for i in range(len(df.columns)))))

    def table_function(self, name: str, parameters: list | None = None) -> Relation:
        args = ", ".join(repr(p) if isinstance(p, str) else str(p).lower() if isinstance(p, bool) else str(p) for p in parameters or [])
        return Relation(self.spark.sql(f"SELECT * FROM {name}({args})"))

    def table_function_udf(self, fn: Callable[..., Iterable], *args: Any, schema: str) -> Relation:
        """Rows that a Python generator gives, computed by one task."""
        kind = T.StructType.fromDDL(schema)

        arrow, names = to_arrow_schema(kind), kind.names

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _ in batches:
                rows = [r if isinstance(r, dict) else dict(zip(names, r if isinstance(r, (tuple, list)) else (r,), strict=True)) for r in fn(*args)]
                yield pa.RecordBatch.from_pylist(rows, arrow)

        return Relation(self.spark.range(1, numPartitions=1).mapInArrow(run, kind))

    def register(self, name: str, x: Any) -> Connection:
        self._frame(x).createOrReplaceTempView(name)
        return self

    def unregister(self, name: str) -> Connection:
        self.spark.catalog.dropTempView(name)
        return self

    # changes to tables

    def insert(self, table: str, values: list) -> None:
        lit = lambda v: "DEFAULT" if v == "DEFAULT" else "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "\\'") + "'" if isinstance(v, str) else str(v)
        self._keep(f"INSERT INTO {table}")
        self.spark.sql(f"INSERT INTO {table} VALUES ({', '.join(map(lit, values))})")

    def update(self, table: str, set: dict[str, Any], condition: str | None = None) -> None:  # noqa: A002
        """Rewrites a table with the new values in the rows that meet the condition."""
        self._keep(f"UPDATE {table}")
        df = self.spark.table(table)
        when = F.coalesce(F.expr(condition), F.lit(False)) if condition else F.lit(True)
        cols = [F.when(when, v.column if hasattr(v, "column") else F.lit(v)).otherwise(F.col(c)).cast(t).alias(c) if (v := set.get(c, ...)) is not ... else F.col(c) for c, t in df.dtypes]
        if missing := set.keys() - {*df.columns}:
            raise ValueError(f"no such columns: {sorted(missing)}")
        stage = f"{table}__update"
        df.select(cols).write.mode("overwrite").saveAsTable(stage)  # a table can't be read and overwritten at once
        self.spark.table(stage).write.insertInto(table, overwrite=True)
        self.spark.sql(f"DROP TABLE {stage}")

    # user functions

    def create_function(self, name: str, func: Callable, parameters: list[str] | None = None, return_type: str = "string", type: str = "native", exception_handling: str = "default", null_handling: str = "default") -> Connection:  # noqa: A002
        """Registers a scalar function for SQL. ``type='arrow'`` gets whole arrays. By default a null argument gives
        null without a call, ``null_handling='special'`` passes it on; ``exception_handling='return_null'`` turns errors into nulls."""
        kind = dialect.spark_type(return_type)
        forward, special = exception_handling != "return_null", null_handling == "special"
        if type == "arrow":
            from pyspark.sql.functions import arrow_udf

            count = len(parameters) if parameters else len(inspect.signature(func).parameters)

            def whole(*args: pa.Array) -> pa.Array:
                try:
                    return func(*args)
                except Exception:
                    if forward:
                        raise
                    out = []  # row by row, so that an error costs its own row only
                    for i in range(len(args[0])):
                        try:
                            out.append(func(*(a.slice(i, 1) for a in args))[0].as_py())
                        except Exception:  # noqa: BLE001
                            out.append(None)
                    return pa.array(out)

            names = [f"a{i}" for i in range(count)]
            scope = {"whole": whole, "pa": pa}
            exec(f"def typed({', '.join(f'{n}: pa.Array' for n in names)}) -> pa.Array:\n    return whole({', '.join(names)})", scope)
            self.spark.udf.register(name, arrow_udf(scope["typed"], kind))
            return self

        def row(*args: Any) -> Any:
            if not special and any(a is None for a in args):
                return None
            try:
                return func(*args)
            except Exception:
                if forward:
                    raise
                return None

        self.spark.udf.register(name, F.udf(row, kind))
        return self

    def remove_function(self, name: str) -> Connection:
        self.spark.sql(f"DROP TEMPORARY FUNCTION {name}")
        return self

    # type names

    @staticmethod
    def type(name: str) -> str:
        return dialect.spark_type(name)

    sqltype = dtype = type

    @staticmethod
    def list_type(child: str) -> str:
        return f"array<{dialect.spark_type(child)}>"

    @staticmethod
    def array_type(child: str, size: int) -> str:
        return f"array<{dialect.spark_type(child)}>"

    @staticmethod
    def struct_type(fields: dict[str, str] | list[tuple[str, str]]) -> str:
        items = fields.items() if isinstance(fields, dict) else fields
        return "struct<" + ",".join(f"{k}:{dialect.spark_type(v)}" for k, v in items) + ">"

    @staticmethod
    def map_type(key: str, value: str) -> str:
        return f"map<{dialect.spark_type(key)},{dialect.spark_type(value)}>"


def project_df(con: Connection, df: Any, exprs: str) -> Relation:
    return con.from_df(df).project(exprs)


def filter_df(con: Connection, df: Any, condition: str) -> Relation:
    return con.from_df(df).filter(condition)


def order_df(con: Connection, df: Any, keys: str) -> Relation:
    return con.from_df(df).order(keys)


def distinct_df(con: Connection, df: Any) -> Relation:
    return con.from_df(df).distinct()


def alias_df(con: Connection, df: Any, name: str) -> Relation:
    return con.from_df(df).set_alias(name)


def write_csv(con: Connection, df: Any, path: str) -> None:
    con.from_df(df).to_csv(path)
