"""Catalogue of runnable queries, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.session import tune
from topicloom.sources.topics import stream_files


@dataclass(frozen=True)
class Tables:
    """Access to the tables of one folder."""

    spark: SparkSession
    root: str

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        schema = getattr(self, name).schema
        return stream_files(self.spark, f"{self.root}/{name}.parquet", schema)


Query = Callable[[Tables], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def runnable(fn: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(Tables(tune(spark), sf_dir.rstrip("/")))


def money(value: str | object, digits: int = 2):
    return F.round(F.sum(value), digits)
