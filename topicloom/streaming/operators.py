"""Streaming forms of the joining and counting operators."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.operators.ordered import hot_keys, key_hash
from topicloom.session import PARTITIONS, path_exists

JOIN_SALT = 8  # groups a hot key is spread over where no share was measured
MOST_SALT = 256
SPREAD = "salt int, hot array<long>"


def job_spread(spark: SparkSession, folder: str, df: DataFrame, keys: Sequence[str],
               hot_rows: int | None = None) -> tuple[list[int], int]:
    """Hashes of a job's hot keys and the groups to spread them over, the same at every restart.

    State is laid out by them, so they are measured once, on what the topic holds when the job is
    created, and kept beside its checkpoint. A key that becomes hot later stays in one group.
    """
    path = f"{folder}/spread"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        hot, rows = hot_keys(df, list(keys), hot_rows)
        share = rows / max(1, df.count()) if hot else 0.0
        tasks = int(spark.conf.get(PARTITIONS))
        salt = min(MOST_SALT, max(2, math.ceil(share * tasks)))
        spark.createDataFrame([(salt, hot)], SPREAD).coalesce(1).write.mode("overwrite").parquet(path)
    kept = spark.read.schema(SPREAD).parquet(path).first()
    return list(kept["hot"]), kept["salt"]


def stream_interval_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_ts: str,
                         right_ts: str, within: str, delay: str, spread: Column,
                         hot: Sequence[int] = (), salt: int = JOIN_SALT) -> DataFrame:
    """Inner join of two streams: right events of the same key up to ``within`` after the left one.

    ``hot`` and ``salt`` come from ``job_spread`` and must not change while a checkpoint lives. The state
    of hot keys is spread over ``salt`` groups: left rows go to one of them by
    ``spread``, right rows to all. Watermarks let state older than the interval go. Apart from
    ``by``, column names of the two sides differ.
    """
    is_hot = key_hash(list(by)).isin(list(hot)) if hot else F.lit(False)
    a = left.withWatermark(left_ts, delay).withColumn(
        "__salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(salt)).cast("int")).otherwise(0))
    slots = F.when(is_hot, F.array(*[F.lit(i) for i in range(salt)])).otherwise(
        F.array(F.lit(0)))
    b = right.withWatermark(right_ts, delay).withColumn("__slot", F.explode(slots))
    b = b.withColumnsRenamed({k: f"__r_{k}" for k in by})
    same = [F.col(k) == F.col(f"__r_{k}") for k in by]
    condition = F.col("__salt") == F.col("__slot")
    for part in same:
        condition = condition & part
    condition = condition & (F.col(right_ts) >= F.col(left_ts)) & (
        F.col(right_ts) <= F.col(left_ts) + F.expr(f"interval {within}"))
    return a.join(b, condition, "inner").drop("__salt", "__slot", *[f"__r_{k}" for k in by])


def stream_distinct(stream: DataFrame, columns: Sequence[str], ts: str | None = None,
                    delay: str | None = None, spread: Column | None = None,
                    hot: Sequence[int] = (), salt: int = JOIN_SALT) -> DataFrame:
    """Each combination once. With a watermark, state of old combinations is let go.

    Hot combinations (``job_spread``) are first thinned out in ``salt`` groups chosen by ``spread``, so
    their rows do not all reach one task. Both steps are there without hot combinations as well, so
    that a job has the same state at every start.
    """
    rows = stream.withWatermark(ts, delay) if ts and delay else stream

    def once(df: DataFrame, names: list[str]) -> DataFrame:
        if ts and delay:
            return df.dropDuplicatesWithinWatermark(names)
        return df.select(*names).dropDuplicates(names)

    spread = F.lit(0) if spread is None else spread
    part = F.when(key_hash(list(columns)).isin(list(hot)), F.pmod(F.xxhash64(spread), F.lit(salt)))
    rows = once(rows.withColumn("__salt", F.coalesce(part, F.lit(0))), [*columns, "__salt"])
    return once(rows, list(columns)).select(*columns)
