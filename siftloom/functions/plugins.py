"""Extension points: model calls by backend name, as Arrow-batched functions on the executors.

scalar: rows to values (one model load a worker); group: the rows of a group to one row
each; generator: a row to several. Plans call them by name, so a model is exchanged
without touching a plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BACKENDS: dict[tuple[str, str], Callable] = {}


def register(kind: str, name: str, factory: Callable) -> None:
    if kind not in ("scalar", "group", "generator"):
        raise ValueError(f"no such kind of backend: {kind}")
    BACKENDS[kind, name] = factory


def backend(kind: str, name: str) -> Callable:
    try:
        return BACKENDS[kind, name]
    except KeyError:
        raise ValueError(f"no {kind} backend named {name}") from None


def scalar(name: str, *columns: Column) -> Column:
    """factory() makes a function of Series once a worker process."""
    factory = backend("scalar", name)

    @F.pandas_udf(T.DoubleType())
    def call(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        f = factory()
        for batch in batches:
            yield f(*batch)

    return call(*columns)


def group(df: DataFrame, name: str, keys: list[str], schema: str) -> DataFrame:
    """factory() makes a function of a group's frame that gives one row for each of its rows."""
    factory = backend("group", name)
    return df.groupBy(*keys).applyInPandas(lambda rows: factory()(rows), schema)


def generate(df: DataFrame, name: str, schema: str) -> DataFrame:
    """factory() makes a generator of records from a record."""
    factory = backend("generator", name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = factory()
        for batch in batches:
            made = [out for record in batch.to_dict("records") for out in f(record)]
            if made:
                yield pd.DataFrame(made)

    return df.mapInPandas(run, schema)
