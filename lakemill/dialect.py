"""Differences between the relational dialect that the library offers and Spark's own.

Nulls sort last whatever the direction, lists keep nulls, quantiles work over window frames, and exact
histograms are maps.
"""

from __future__ import annotations

import re
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_FRAME = re.compile(r"\b(rows|range|groups)\b\s+(between|unbounded|current|\d|interval)", re.IGNORECASE)
_TYPES = {
    "bool": "boolean", "logical": "boolean", "int1": "tinyint", "int2": "smallint", "int4": "int", "int8": "bigint", "integer": "int", "signed": "int", "short": "smallint", "long": "bigint",
    "utinyint": "smallint", "usmallint": "int", "uinteger": "bigint", "ubigint": "decimal(20,0)", "hugeint": "decimal(38,0)", "uhugeint": "decimal(38,0)", "float4": "float", "real": "float",
    "float8": "double", "numeric": "decimal(18,3)", "varchar": "string", "text": "string", "char": "string", "bpchar": "string", "uuid": "string", "bit": "string", "time": "string", "json": "string",
    "blob": "binary", "bytea": "binary", "varbinary": "binary", "datetime": "timestamp_ntz", "timestamp": "timestamp_ntz", "timestamp_s": "timestamp_ntz", "timestamp_ms": "timestamp_ntz", "timestamp_ns": "timestamp_ntz",
    "timestamptz": "timestamp", "timestamp with time zone": "timestamp",
}


def split_top(text: str, sep: str = ",") -> list[str]:
    """Parts of a list that separators outside brackets and quotes divide."""
    out, depth, quote, begin = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == sep and depth == 0:
            out.append(text[begin:i].strip())
            begin = i + 1
    last = text[begin:].strip()
    return [*out, last] if last else out


def spark_type(name: str) -> str:
    """Spark's name of a SQL type: unsigned types widen, T[] and T[n] are arrays, STRUCT and MAP take brackets."""
    text = " ".join(name.strip().split())
    low = text.lower()
    if m := re.fullmatch(r"(.*)\[\d*\]", text):
        return f"array<{spark_type(m[1])}>"
    if low.startswith("struct(") and low.endswith(")"):
        fields = (f.split(None, 1) for f in split_top(text[7:-1]))
        return "struct<" + ",".join(f"{k.strip(chr(34))}:{spark_type(v)}" for k, v in fields) + ">"
    if low.startswith("map(") and low.endswith(")"):
        k, v = split_top(text[4:-1])
        return f"map<{spark_type(k)},{spark_type(v)}>"
    if m := re.fullmatch(r"(?:decimal|numeric)\s*\((.*)\)", low):
        return f"decimal({m[1]})"
    if re.fullmatch(r"(?:varchar|char)\s*\(.*\)", low):
        return "string"
    return _TYPES.get(low, low)


def order_keys(keys: str) -> str:
    """Sort keys with NULLS LAST wherever nothing else is said."""
    return ", ".join(k if re.search(r"\bnulls\s+(first|last)$", k, re.IGNORECASE) else f"{k} NULLS LAST" for k in split_top(keys))


def over(spec: str) -> str:
    """``OVER (...)`` from a window specification, bare or with its OVER, with nulls last."""
    text = spec.strip()
    if m := re.fullmatch(r"over\s*\((.*)\)", text, re.IGNORECASE | re.DOTALL):
        text = m[1].strip()
    if m := re.search(r"\border\s+by\b", text, re.IGNORECASE):
        head, rest = text[: m.end()], text[m.end() :]
        frame = _FRAME.search(rest)
        keys, tail = (rest[: frame.start()], rest[frame.start() :]) if frame else (rest, "")
        text = f"{head} {order_keys(keys.strip())} {tail}".strip()
    return f"OVER ({text})"


def quoted(df: DataFrame, expression: str) -> str:
    """An expression as it is if it names a column or parses; else a quoted column name."""
    if expression in df.columns:
        return "`" + expression.replace("`", "``") + "`"
    try:
        df.sparkSession._jsparkSession.sessionState().sqlParser().parseExpression(expression)
    except Exception as e:  # the parser's error says that this is no expression
        if "ParseException" not in type(e).__name__ and "ParseException" not in str(e):
            raise
        return "`" + expression.replace("`", "``") + "`"
    return expression


def list_with_nulls(x: Column) -> Column:
    """All values as a list, nulls among them."""
    return F.transform(F.collect_list(F.struct(x.alias("v"))), lambda s: s["v"])


def list_with_nulls_sql(x: str) -> str:
    return f"transform(collect_list(struct({x} AS v)), s -> s.v)"


def framed_quantile_sql(x: str, q: float, window: str, discrete: bool = False) -> str:
    """A quantile over any frame, for which Spark has no aggregate: the sorted frame, indexed."""
    values = f"sort_array(collect_list({x}) {window})"
    if discrete:
        return f"try_element_at({values}, cast(greatest(ceil({q} * size({values})), 1) AS int))"
    at = f"({q} * (size({values}) - 1))"
    low, high = f"try_element_at({values}, cast(floor({at}) AS int) + 1)", f"try_element_at({values}, cast(ceil({at}) AS int) + 1)"
    return f"CASE WHEN size({values}) > 0 THEN {low} + ({high} - {low}) * ({at} - floor({at})) END"


#: A group of more values than this has its quantiles by brackets.
LARGE = 1_000_000


def grouped_quantiles(df: DataFrame, x: str, qs: list[float], discrete: bool, keys: list[str], name: str, single: bool) -> DataFrame:
    """Exact quantiles of numbers per group, as an array or a single one, without a task that holds a large group's values.

    A sketch brackets each quantile of a large group; the values between the brackets, about a five-hundredth, are counted and
    ranked exactly, those outside are counted alone. Small groups, and those whose bracket should miss, take Spark's aggregate.
    """
    ks = [f"__k{i}" for i in range(len(keys))]
    base = df.select(*(F.expr(k).alias(n) for k, n in zip(keys, ks, strict=True)), F.expr(x).cast("double").alias("__x"))
    meets = lambda d: reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{d}{k}")) for k in ks], F.lit(True))
    renamed = lambda f, d: f.select(*(F.col(k).alias(f"{d}{k}") for k in ks), *(c for c in f.columns if c not in ks))
    some = base.where("__x IS NOT NULL")
    large = renamed(some.groupBy(*ks).agg(F.count("*").alias("__many")).where(F.col("__many") > LARGE).drop("__many"), "l")
    ends = [p for q in qs for p in (max(q - 1e-3, 0.0), min(q + 1e-3, 1.0))]
    cuts = renamed(some.join(F.broadcast(large), meets("l")).groupBy(*ks).agg(F.percentile_approx("__x", ends, 10_000).alias("__c")).where("__c IS NOT NULL"), "c")
    targets = F.array(*(F.struct(F.lit(i).alias("t"), (F.lit(None).cast("double") if q < 1e-3 else F.col("__c")[2 * i]).alias("lo"), (F.lit(None).cast("double") if q > 1 - 1e-3 else F.col("__c")[2 * i + 1]).alias("hi")) for i, q in enumerate(qs)))
    side = F.when(F.col("__x") < F.col("__t.lo"), 0).when(F.col("__x") > F.col("__t.hi"), 2).otherwise(1)
    parts = some.join(F.broadcast(cuts), meets("c")).withColumn("__t", F.explode(targets)).select(*ks, F.col("__t.t").alias("t"), side.alias("side"), "__x")
    counted = parts.groupBy(*ks, "t", "side", F.when(F.col("side") == 1, F.col("__x")).alias("v")).agg(F.count("*").alias("n"))
    group = Window.partitionBy(*ks, "t")
    ranked = counted.withColumn("to", F.sum("n").over(group.orderBy("side", "v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("of", F.sum("n").over(group))
    q = F.element_at(F.array(*map(F.lit, qs)), F.col("t") + 1)
    exact = F.element_at(F.array(*(F.lit(Decimal(repr(float(v)))).cast("decimal(18,17)") for v in qs)), F.col("t") + 1)
    at = F.greatest(F.ceil(exact * F.col("of").cast("decimal(20,0)")).cast("double"), F.lit(1.0)) - 1 if discrete else q * (F.col("of") - 1)
    ranked = ranked.withColumn("at", at)
    value = lambda r: F.max(F.when((F.col("side") == 1) & (F.col("to") - F.col("n") <= r) & (r < F.col("to")), F.col("v")))
    found = ranked.groupBy(*ks, "t").agg(value(F.floor("at")).alias("a"), value(F.ceil("at")).alias("b"), F.max("at").alias("at"))
    share = F.col("at") - F.floor("at")
    found = found.where("a IS NOT NULL AND b IS NOT NULL").withColumn("v", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((1 - share) * F.col("a") + share * F.col("b")))
    done = found.groupBy(*ks).agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("__d")).where(F.size("__d") == len(qs))
    both = base.join(F.broadcast(renamed(done, "d")), meets("d"), "left").withColumn("__x", F.when(F.col("__d").isNull(), F.col("__x")))
    fn = "percentile_disc" if discrete else "percentile_cont"
    plain = F.array(*(F.expr(f"{fn}({v}) WITHIN GROUP (ORDER BY __x)") for v in qs))
    known = F.first("__d", ignorenulls=True)
    whole = F.when(known.isNotNull(), F.transform(known, lambda d: d["v"])).otherwise(plain)
    out = both.groupBy(*ks).agg((whole[0] if single else whole).alias(name))
    names = df.groupBy(*map(F.expr, keys)).agg(F.lit(0)).columns[:-1]
    return out.toDF(*names, name)


def histogram(df: DataFrame, column: str, groups: list[str]) -> DataFrame:
    """A map from each value to its exact count, per group; nulls aren't values."""
    counted = df.where(F.expr(column).isNotNull()).groupBy(*groups, F.expr(column).alias("__value")).agg(F.count("*").alias("__n"))
    return counted.groupBy(*groups).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__value", "__n")))).alias(f"histogram({column})"))
