"""Functions of language models, by a provider: a callable over lists of texts, made once per worker."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.functions.text import col

PROVIDERS: dict[str, Callable[[], Callable[[list[str]], list[Any]]]] = {}


def register_provider(name: str, make: Callable[[], Callable[[list[str]], list[Any]]]) -> None:
    PROVIDERS[name] = make


def retry(fn: Callable[[], Any], max_retries: int = 3, on_error: str = "raise", sleep: Callable[[float], None] = time.sleep) -> Any:
    """Calls again after 1, 2, 4 ... seconds, 30 at most, or what the error's retry_after says; then raises, or gives None."""
    for i in range(max_retries + 1):
        try:
            return fn()
        except Exception as e:
            if i == max_retries:
                if on_error == "raise":
                    raise
                return None
            sleep(getattr(e, "retry_after", None) or min(2**i, 30))


class TokenMetrics:
    """Tokens by protocol, model and provider, summed up over all tasks by accumulators."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.sums = spark, {}

    def counters(self, protocol: str, model: str, provider: str) -> tuple:
        """(input, output, total): what tasks add to."""
        key = (protocol, model, provider)
        return self.sums.setdefault(key, tuple(self.spark.sparkContext.accumulator(0) for _ in range(3)))

    def record(self, protocol: str, model: str, provider: str, input_tokens: int = 0, output_tokens: int = 0, total_tokens: int | None = None) -> None:
        for c, n in zip(self.counters(protocol, model, provider), (input_tokens, output_tokens, input_tokens + output_tokens if total_tokens is None else total_tokens), strict=True):
            c.add(n)

    def totals(self) -> dict[tuple[str, str, str], tuple[int, int, int]]:
        return {k: tuple(c.value for c in v) for k, v in self.sums.items()}


def _make(provider: str | Callable) -> Callable[[], Callable[[list[str]], list[Any]]]:
    if callable(provider):
        return lambda: provider
    if provider not in PROVIDERS:
        raise ValueError(f"no provider {provider!r}; register_provider takes one")
    return PROVIDERS[provider]


def _apply(df: DataFrame, column: str, out: str, kind: str, provider: str | Callable, prepare: Callable[[str], str], max_retries: int, on_error: str) -> DataFrame:
    make = _make(provider)

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            asked = [prepare(t or "") for t in texts]
            got = retry(lambda a=asked: model(a), max_retries, on_error)
            yield pd.Series(got if got is not None else [None] * len(asked))

    return df.withColumn(out, run(col(column)))


def embed_text(df: DataFrame, column: str, provider: str | Callable, output_column: str = "embedding", max_retries: int = 3, on_error: str = "raise") -> DataFrame:
    return _apply(df, column, output_column, "array<float>", provider, lambda t: t, max_retries, on_error)


def classify_text(df: DataFrame, column: str, labels: list[str], provider: str | Callable, output_column: str = "label", max_retries: int = 3, on_error: str = "raise") -> DataFrame:
    """The provider's answer where it is one of the labels, else null."""
    asked = _apply(df, column, output_column, "string", provider, lambda t: f"Labels: {', '.join(labels)}\nText: {t}\nLabel:", max_retries, on_error)
    return asked.withColumn(output_column, F.when(F.col(output_column).isin(labels), F.col(output_column)))


def prompt(df: DataFrame, column: str, provider: str | Callable, system_message: str | None = None, output_column: str = "response", max_retries: int = 3, on_error: str = "raise") -> DataFrame:
    return _apply(df, column, output_column, "string", provider, lambda t: f"{system_message}\n\n{t}" if system_message else t, max_retries, on_error)


def build_system_message(schema: dict[str, str], extra: str | None = None) -> str:
    return "Answer with one JSON object and nothing else. Its fields and types: " + json.dumps(schema) + (f"\n{extra}" if extra else "")
