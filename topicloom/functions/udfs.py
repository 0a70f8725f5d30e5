"""User functions for SQL. Built-in expressions are faster wherever they can say the same."""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator, Sequence
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType


class _Words:
    def eval(self, line: str) -> Iterator[tuple[str, int]]:
        for word in re.split(r"\W+", (line or "").lower(), flags=re.ASCII):
            if word:
                yield word, 1


def register_words(spark: SparkSession, name: str = "split_words") -> None:
    """Table function ``line -> (word, frequency)`` for SQL."""
    spark.udtf.register(name, F.udtf(_Words, returnType="word string, frequency int"))


def register_scalar(spark: SparkSession, name: str, fn: Callable[..., pd.Series],
                    returns: str | DataType) -> None:
    """A vectorised scalar function ``fn(*series) -> series``, callable by name in SQL."""
    spark.udf.register(name, F.pandas_udf(fn, returns))


FAN = 16  # partial states of a group that one merge step takes, about
HELD_GROUPS = 20_000  # groups a task holds states of before it hands them on


class Aggregate(Protocol):
    """A user-defined aggregate. States are of bounded size; rows come as a frame of a group's columns."""

    def init(self) -> Any: ...
    def update(self, state: Any, rows: pd.DataFrame) -> Any: ...
    def merge(self, state: Any, other: Any) -> Any: ...
    def finish(self, state: Any) -> tuple: ...


def user_aggregate(df: DataFrame, keys: Sequence[str], columns: Sequence[str], agg: Aggregate,
                   returns: str) -> DataFrame:
    """(keys, columns of ``returns``): a user-defined aggregate of each group.

    Each task turns the rows it reads into one state per group, batch by batch; states are merged in groups of about
    FAN and then to one, so the rows of a group are never gathered and a hot key is worked on by all tasks.
    """
    keys, columns = list(keys), list(columns)
    key_fields = [df.schema[k] for k in keys]
    partial = StructType([*key_fields]).add("state", "binary")

    def frame(states: dict) -> pd.DataFrame:
        out = pd.DataFrame(list(states), columns=keys, dtype=object)
        out["state"] = [pickle.dumps(s) for s in states.values()]
        return out

    def plain(key: tuple) -> tuple:
        return tuple(None if pd.isna(k) else k for k in key)

    def update(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict = {}
        for batch in batches:
            for key, rows in batch.groupby(keys, dropna=False, sort=False) if keys else [((), batch)]:
                key = plain(key)
                states[key] = agg.update(states[key] if key in states else agg.init(), rows[columns])
            if len(states) >= HELD_GROUPS:
                yield frame(states)
                states = {}
        if states:
            yield frame(states)

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        state = agg.init()
        for other in rows["state"]:
            state = agg.merge(state, pickle.loads(other))
        return frame({plain(key[:len(keys)]): state})

    def last(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        merged = merge(key, rows)
        value = agg.finish(pickle.loads(merged["state"][0]))
        return pd.DataFrame([(*plain(key[:len(keys)]), *value)], columns=out.names, dtype=object)

    out = StructType([*key_fields, *StructType.fromDDL(returns).fields])
    states = df.select(*keys, *columns).mapInPandas(update, partial)
    some = states.groupBy(*keys, F.floor(F.spark_partition_id() / FAN)).applyInPandas(merge, partial)
    return some.groupBy(*keys).applyInPandas(last, out)
