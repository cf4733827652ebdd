"""Joins that Spark has no operator for, as compositions of those it has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakemill.operators.store import stored


def asof_join(left: DataFrame, right: DataFrame, time: str, by: list[str], value: str, out_column: str | None = None) -> DataFrame:
    """Every left row with the value of the last right row of its keys at or before its time, or null.

    One shuffle on the keys and one sort: both sides as one, and the last value so far.
    """
    name = out_column or value
    both = left.select("*", F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__v")).unionByName(
        right.select(*by, time, F.lit(0).alias("__side"), F.col(value).alias("__v")), allowMissingColumns=True
    )
    # a struct, so that a null value of the last row isn't passed over
    last = F.last(F.when(F.col("__side") == 0, F.struct("__v")), ignorenulls=True).over(Window.partitionBy(*by).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn(name, last["__v"]).where("__side = 1").drop("__side", "__v")


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Points with the ranges [low, high) that hold them: both go to cells of ``width`` and meet on equal cells."""
    cells = F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))
    return points.withColumn("__cell", F.floor(F.col(point) / width)).join(ranges.where(F.col(low) < F.col(high)).withColumn("__cell", cells), "__cell").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("__cell")


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: int = 1_000_000) -> DataFrame:
    """An inner join for a key with hot values: rows of a value of more than ``hot`` rows on the left spread over parts of
    that many, and the right side's rows of such values alone are repeated for each part.

    Counts are aggregated first; there are at most rows / hot hot values, which is what is broadcast.
    """
    heavy = stored(left.groupBy(F.col(key).alias("__key")).agg(F.ceil(F.count("*") / hot).alias("__parts")).where("__key IS NOT NULL AND __parts > 1"))
    parts = F.coalesce("__parts", F.lit(1).cast("bigint"))
    many = lambda df: df.join(F.broadcast(heavy), F.col(key) == F.col("__key"), "left")
    spread = many(left).withColumn("__salt", F.pmod(F.xxhash64(*left.columns), parts)).drop("__key", "__parts")
    again = many(right).withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).drop("__key", "__parts")
    return spread.join(again, [key, "__salt"]).drop("__salt")
