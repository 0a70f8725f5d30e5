"""Ordered-group operators that stay bounded when one key holds a large share of the rows.

A plain ``Window.partitionBy(key).orderBy(..)`` puts every row of a key into one task. Here a key
counts as hot when it has more than ``hot_rows`` rows (default ``HOT_ROWS``) and more than
1/``MAX_HOT`` of the table.
Rows of hot keys are cut along the order columns into chunks, the window runs per (key, chunk),
and the little that a chunk needs from earlier chunks arrives as extra rows that are dropped
again. Keys that are not hot take the plain window, and without hot keys nothing is added to the
plan at all.

Inputs are read more than once when hot keys exist, so they must be deterministic; write an
expensive or random input with ``session.materialize`` first.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.session import materialize

HOT_ROWS = 2_000_000
MAX_HOT = 10_000
SAMPLES = 200  # sampled rows per hot key, and per chunk

CHUNK, REAL, SEQ = "__chunk", "__real", "__seq"


@dataclass(frozen=True)
class Split:
    """Rows with their chunk number; ``hot`` holds hashes of the hot keys."""

    rows: DataFrame
    keys: list[str]
    hot: list[int]

    def hot_only(self) -> DataFrame:
        return self.rows.where(key_hash(self.keys).isin(self.hot))

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, CHUNK)


def key_hash(keys: list[str]) -> Column:
    # A collision only makes a cold key look hot, which costs time but never changes a result.
    return F.xxhash64(*keys) if keys else F.lit(0).cast("long")


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int | None = None) -> tuple[list[int], int]:
    """Hashes of the hot keys and about how many rows they hold.

    Large tables are sampled, so at most ``SAMPLES * MAX_HOT`` rows are counted and the list stays
    within a small multiple of ``MAX_HOT``. A key missed or listed in error only changes how the
    work is spread, never a result.
    """
    total = df.count()
    limit = max(hot_rows or HOT_ROWS, total // MAX_HOT)
    if total <= limit:
        return [], 0
    share = min(1.0, SAMPLES / limit)
    seen = df.select(key_hash(keys).alias("h"))
    seen = seen if share == 1.0 else seen.sample(share, seed=1)
    counts = seen.groupBy("h").agg(F.count("*").alias("n"))
    enough = limit if share == 1.0 else SAMPLES * 0.75
    found = counts.where(F.col("n") > enough).collect()
    return [row["h"] for row in found], int(sum(row["n"] for row in found) / share)


def split_hot(df: DataFrame, keys: list[str], order: list[str],
              hot_rows: int | None = None) -> Split:
    """Rows with a chunk number that grows with the order columns of any type.

    Spark's own range partitioning cuts the rows of hot keys along all order columns, so equal values
    of one are cut along the next. The cut rows are written once, as a second run could cut elsewhere.
    """
    hot, rows = hot_keys(df, keys, hot_rows)
    if not hot:
        return Split(df.withColumn(CHUNK, F.lit(0).cast("long")), keys, [])
    pieces = max(2, math.ceil(rows / (hot_rows or HOT_ROWS)) * 2)
    is_hot = key_hash(keys).isin(hot)
    cut = df.where(is_hot).repartitionByRange(pieces, *order)
    cut = materialize(cut.withColumn(CHUNK, F.spark_partition_id().cast("long") + 1), "chunks")
    cold = df.where(~is_hot).withColumn(CHUNK, F.lit(0).cast("long"))
    return Split(cold.unionByName(cut), keys, hot)


def over_last_rows(df: DataFrame, keys: list[str], order: list[str], back: int,
                   exprs: dict[str, Callable[[WindowSpec], Column]],
                   seed: DataFrame | None = None, hot_rows: int | None = None) -> DataFrame:
    """Window expressions that look back at most ``back`` rows (lag, ROWS n PRECEDING).

    Each expression gets an ordered window spec and returns a column. ``order`` must be a total
    order within a key. ``seed`` holds up to ``back`` rows per key, with the columns of ``df``,
    that come before every row of ``df``: the state carried between micro-batches.
    """
    split = split_hot(df, keys, order, hot_rows)
    if not split.hot and seed is None:
        spec = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({name: make(spec) for name, make in exprs.items()})

    rows = split.rows.withColumns({SEQ: F.lit(1), REAL: F.lit(True)})
    extra = []
    tails = None
    if seed is not None:
        seeds = seed.select(*df.columns).withColumns({SEQ: F.lit(0), REAL: F.lit(False)})
        is_hot = key_hash(keys).isin(split.hot) if split.hot else F.lit(False)
        extra.append(seeds.where(~is_hot).withColumn(CHUNK, F.lit(0).cast("long")))
        tails = seeds.where(is_hot).withColumn(CHUNK, F.lit(-1).cast("long"))
    if split.hot:
        latest = split.window().orderBy(*[F.col(c).desc() for c in order])
        ends = (
            split.hot_only().withColumns({SEQ: F.lit(1), REAL: F.lit(False)})
            .withColumn("__n", F.row_number().over(latest)).where(F.col("__n") <= back)
            .drop("__n")
        )
        tails = ends if tails is None else ends.unionByName(tails)
        # A chunk's last rows matter to every chunk that starts within the next `back` last rows.
        following = Window.partitionBy(*keys).orderBy(CHUNK, *order).rowsBetween(1, back)
        later = F.array_distinct(F.filter(F.collect_list(CHUNK).over(following),
                                          lambda c: c > F.col(CHUNK)))
        extra.append(
            tails.withColumn("__later", later).withColumn(CHUNK, F.explode("__later"))
            .drop("__later")
        )
    for more in extra:
        rows = rows.unionByName(more)
    spec = split.window().orderBy(SEQ, *order)
    out = rows.withColumns({name: make(spec) for name, make in exprs.items()})
    return out.where(REAL).drop(CHUNK, SEQ, REAL)


def last_rows(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows per key; the row limit is applied before the shuffle as well."""
    spec = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("__n", F.row_number().over(spec)).where(F.col("__n") <= n).drop("__n")


def running_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column],
                 hot_rows: int | None = None) -> DataFrame:
    """Sum of each expression over all rows up to the current one (row numbers: ``lit(1)``)."""
    split = split_hot(df, keys, order, hot_rows)
    if not split.hot:
        spec = (Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)
                .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return df.withColumns({name: F.sum(value).over(spec) for name, value in sums.items()})

    parts = {name: f"__part_{i}" for i, name in enumerate(sums)}
    valued = {parts[name]: value for name, value in sums.items()}
    totals = (
        split.hot_only().withColumns(valued).groupBy(*keys, CHUNK)
        .agg(*[F.sum(p).alias(p) for p in parts.values()])
    )
    before = (Window.partitionBy(*(keys or [F.lit(0)])).orderBy(CHUNK)
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.withColumns({p: F.sum(p).over(before) for p in parts.values()})
    rows = (
        split.rows.withColumns(valued | {SEQ: F.lit(1)})
        .unionByName(offsets.withColumn(SEQ, F.lit(0)), allowMissingColumns=True)
    )
    spec = (split.window().orderBy(SEQ, *order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = rows.withColumns({name: F.sum(parts[name]).over(spec) for name in sums})
    return out.where(F.col(SEQ) == 1).drop(CHUNK, SEQ, *parts.values())


def ranks(df: DataFrame, keys: list[str], by: str, hot_rows: int | None = None) -> DataFrame:
    """Add ``rank`` and ``dense_rank`` by an ascending column.

    Equal values are counted first, so the ordered step works on distinct values only.
    """
    values = df.groupBy(*keys, by).agg(F.count("*").alias("__n"))
    placed = running_sums(values, keys, [by],
                          {"__upto": F.col("__n"), "dense_rank": F.lit(1)}, hot_rows)
    placed = placed.select(
        *[F.col(c).alias(f"__k_{c}") for c in [*keys, by]],
        (F.col("__upto") - F.col("__n") + 1).alias("rank"), F.col("dense_rank").cast("long"))
    same = F.lit(True)
    for c in [*keys, by]:
        same = same & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    return df.join(placed, same).drop(*[f"__k_{c}" for c in [*keys, by]])


def ntiles(df: DataFrame, keys: list[str], order: list[str], n: int, name: str = "ntile",
           hot_rows: int | None = None) -> DataFrame:
    """Number ``n`` groups of (nearly) equal size per key, larger groups first."""
    placed = running_sums(df, keys, order, {"__place": F.lit(1)}, hot_rows)
    sizes = df.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(
        F.count("*").alias("__size"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    small = F.floor(F.col("__size") / n)
    larger = F.col("__size") % n
    before = F.col("__place") - 1
    edge = larger * (small + 1)
    group = F.when(before < edge, F.floor(before / (small + 1))).otherwise(
        larger + F.floor((before - edge) / F.greatest(small, F.lit(1))))
    return (
        placed.join(sizes, same).withColumn(name, (group + 1).cast("int"))
        .drop("__place", "__size", *[f"__k_{k}" for k in keys])
    )


def except_all(left: DataFrame, right: DataFrame, keys: list[str], order: list[str],
               hot_rows: int | None = None) -> DataFrame:
    """Left rows less as many rows of each key as the right side has.

    Rows are numbered and kept where they are; the copies of a hot key are never rebuilt from a
    count in one task.
    """
    return _against_counts(left, right, keys, order, hot_rows, F.col("__place") > F.col("__taken"))


def intersect_all(left: DataFrame, right: DataFrame, keys: list[str], order: list[str],
                  hot_rows: int | None = None) -> DataFrame:
    """As many left rows of each key as the right side has, numbered as in ``except_all``."""
    return _against_counts(left, right, keys, order, hot_rows, F.col("__place") <= F.col("__taken"))


def _against_counts(left: DataFrame, right: DataFrame, keys: list[str], order: list[str],
                    hot_rows: int | None, kept: Column) -> DataFrame:
    numbered = running_sums(left, keys, order, {"__place": F.lit(1)}, hot_rows)
    taken = right.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(
        F.count("*").alias("__taken"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return (
        numbered.join(taken, same, "left").withColumn("__taken", F.coalesce("__taken", F.lit(0)))
        .where(kept)
        .drop("__place", "__taken", *[f"__k_{k}" for k in keys])
    )


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str,
              take: dict[str, str], tie: str | None = None,
              hot_rows: int | None = None) -> DataFrame:
    """Left rows with the latest right row of the same key at or before their time.

    ``take`` maps right columns to output names. Both sides go through one shuffle and one sort;
    nothing is paired up. ``tie`` orders right rows of equal time.
    """
    tied = F.col(tie) if tie else F.lit(0)
    kind = right.schema[tie].dataType if tie else T.IntegerType()
    payload = F.struct(*[F.col(c).alias(n) for c, n in take.items()])
    l_rows = left.select(*by, F.col(left_time).alias("__t"), F.lit(1).alias("__side"),
                         F.lit(None).cast(kind).alias("__tie"),
                         F.struct(*left.columns).alias("__left"))
    r_rows = right.where(F.col(right_time).isNotNull()).select(
        *by, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), tied.alias("__tie"),
        payload.alias("__right"))
    both = l_rows.unionByName(r_rows, allowMissingColumns=True)
    order = ["__t", "__side", "__tie"]
    split = split_hot(both, by, order, hot_rows)
    rows, spec = split.rows, split.window()
    if split.hot:
        ends = split.hot_only().groupBy(*by, CHUNK).agg(
            F.max_by("__right", F.when(F.col("__right").isNotNull(), F.struct("__t", "__tie")))
            .alias("__right"))
        before = (Window.partitionBy(*by).orderBy(CHUNK)
                  .rowsBetween(Window.unboundedPreceding, -1))
        carried = (
            ends.withColumn("__right", F.last("__right", ignorenulls=True).over(before))
            .where(F.col("__right").isNotNull()).withColumn("__side", F.lit(-1))
        )
        rows = rows.unionByName(carried, allowMissingColumns=True)  # null time sorts first
    spec = (spec.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    known = F.lit(True)
    for key in by:
        known = known & F.col(key).isNotNull()  # null keys match nothing, as in any join
    matched = rows.withColumn(
        "__match", F.when(known, F.last("__right", ignorenulls=True).over(spec)))
    return (
        matched.where(F.col("__side") == 1)
        .select("__left.*", *[F.col(f"__match.{n}").alias(n) for n in take.values()])
    )
