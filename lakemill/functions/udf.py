"""Decorators that make column functions of Python functions and classes.

A class is built once per worker and partition, so that it may hold a model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemill.dialect import spark_type


def func(fn: Callable | None = None, *, return_dtype: str = "string") -> Callable:
    """A function of values as a function of columns, through Arrow."""
    if fn is None:
        return lambda f: func(f, return_dtype=return_dtype)
    return F.udf(fn, spark_type(return_dtype), useArrow=True)


def cls(kind: type | None = None, *, return_dtype: str = "string") -> Callable:
    """A class with __call__(value) as a function of a column; its arguments are those of the class."""
    if kind is None:
        return lambda k: cls(k, return_dtype=return_dtype)

    def make(*args: Any, **kwargs: Any) -> Callable[[Column], Column]:
        @F.pandas_udf(spark_type(return_dtype))
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            own = kind(*args, **kwargs)
            for b in batches:
                yield b.map(own, na_action="ignore")

        return run

    return make


def cls_batch(kind: type | None = None, *, schema: str | None = None, batch_size: int | None = None) -> Callable:
    """A class with __call__(batch) as a function of DataFrames; batches are Arrow's."""
    if kind is None:
        return lambda k: cls_batch(k, schema=schema, batch_size=batch_size)

    def make(*args: Any, **kwargs: Any) -> Callable[[DataFrame], DataFrame]:
        def apply(df: DataFrame) -> DataFrame:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                own = kind(*args, **kwargs)
                for b in batches:
                    for i in range(0, b.num_rows, batch_size or max(b.num_rows, 1)):
                        yield own(b.slice(i, batch_size or b.num_rows))

            return df.mapInArrow(run, schema or df.schema)

        return apply

    return make
