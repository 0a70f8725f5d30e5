"""Aggregations: word count, process history, status roll-up, time windows and sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.operators.ordered import over_last_rows, running_sums
from topicloom.session import materialize, maybe_broadcast

GRID = 256  # parts a sketch cuts a group's values into while a quantile is looked for

# Task states.
RUNNING, RUNNING_WITH_ERROR, NONE = "RUNNING", "RWE", "NONE"
UNASSIGNED, FINISHED, FAILED, CANCELED = "UNASSIGNED", "FINISHED", "FAILED", "CANCELED"
STREAMING, LOST, PAUSED = "STREAMING", "LOST", "PAUSED"


def word_count(df: DataFrame, text: str) -> DataFrame:
    """Lower-case words and their number; all but ASCII letters, digits and _ separates words."""
    words = df.select(F.explode(F.split(F.lower(text), r"\W+")).alias("word"))
    return words.where("word <> ''").groupBy("word").agg(F.count("*").alias("frequency"))


def process_history(df: DataFrame, cuid: str, file_name: str, millis: str, status: str,
                    describe: Sequence[str], tiebreak: str, sort: str | None = None,
                    ascending: bool = True) -> DataFrame:
    """One row per (task, file): first descriptive values, lowest status, processing time."""
    first = F.min_by(F.struct(*describe), F.struct(millis, tiebreak))
    grouped = df.groupBy(F.col(cuid).alias("cuid"), F.col(file_name).alias("file_name")).agg(
        first.alias("__first"), F.min(millis).alias("start_time"),
        F.max(millis).alias("end_time"), F.min(status).alias("status"))
    out = grouped.select(
        F.concat(F.col("cuid").cast("string"), "file_name").alias("id"), "cuid", "file_name",
        *[F.col(f"__first.{c}").alias(c) for c in describe], "start_time", "end_time", "status",
        (F.col("end_time") - F.col("start_time")).alias("process_milliseconds"))
    if sort:
        out = out.orderBy(F.col(sort).asc() if ascending else F.col(sort).desc(), "cuid",
                          "file_name")
    return out


def status_rollup(tasks: DataFrame, parts: DataFrame, key: str, state: str,
                  part_key: str, part_state: str) -> DataFrame:
    """Status of a task from its own state and the states of its parts.

    Parts shrink to one row per task before the join, so a task with very many parts is no
    heavier than any other.
    """
    running = F.upper(F.col(part_state)) == RUNNING
    summary = parts.groupBy(F.col(part_key).alias("__task")).agg(
        F.min(F.coalesce(running, F.lit(False))).alias("__all_running"))
    joined = tasks.join(summary, F.col(key) == F.col("__task"), "left")
    status = (
        F.when(F.col(state).isNull(), F.lit(NONE))
        .when(F.upper(F.col(state)) != RUNNING, F.col(state))
        .when(F.coalesce(F.col("__all_running"), F.lit(True)), F.lit(RUNNING))
        .otherwise(F.lit(RUNNING_WITH_ERROR))
    )
    return joined.withColumn("status", status).drop("__task", "__all_running")


def statement_status(state: Column, output: Column) -> Column:
    """Task status of a batch statement from its state and its output status."""
    name = F.upper(state)
    return (
        F.when(name.isNull(), F.lit(NONE))
        .when(name.isin("RUNNING", "CANCELLING"), F.lit(RUNNING))
        .when(name == "WAITING", F.lit(UNASSIGNED))
        .when((name == "AVAILABLE") & (F.lower(output) == "ok"), F.lit(FINISHED))
        .when(name.isin("AVAILABLE", "ERROR"), F.lit(FAILED))
        .when(name == "CANCELLED", F.lit(CANCELED))
        .otherwise(name)
    )


def category(task_type: Column) -> Column:
    return F.split_part(task_type, F.lit("_"), F.lit(1))


def tumble(df: DataFrame, ts: str, width: str, keys: Sequence[str],
           **aggs: Column) -> DataFrame:
    """Aggregates per key and fixed window; works on streams too (add the watermark first)."""
    return (
        df.groupBy(F.window(ts, width).alias("__w"), *keys)
        .agg(*[value.alias(name) for name, value in aggs.items()])
        .select(F.col("__w.start").alias("window_start"), *keys, *aggs)
    )


def slide(df: DataFrame, ts: str, width_s: int, step_s: int, keys: Sequence[str],
          value: str) -> DataFrame:
    """Count and sum per key over sliding windows whose width is a multiple of the step.

    Rows are summed once per step; only those sums are copied into the windows covering them.
    """
    if width_s % step_s:
        raise ValueError("window width must be a multiple of the step")
    steps = width_s // step_s
    panes = tumble(df, ts, f"{step_s} seconds", keys, n=F.count("*"), total=F.sum(value))
    starts = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.col(
        "window_start") - F.make_dt_interval(secs=(i * F.lit(step_s)).cast("decimal(18,6)")))
    return (
        panes.withColumn("window_start", F.explode(starts))
        .groupBy("window_start", *keys)
        .agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    )


def sessions(df: DataFrame, ts: str, gap_s: int, keys: Sequence[str],
             hot_rows: int | None = None) -> DataFrame:
    """Sessions per key: a new one starts after a silence of at least ``gap_s`` seconds.

    Rows in the same slice of width ``gap_s`` are always closer than the gap, so each slice is
    summed first; ordering per key then handles slices, not rows. Slices of a hot key are cut along time into
    chunks: each chunk numbers its own sessions, and only the end of a chunk and its number of sessions
    pass to the next.
    """
    keys = list(keys)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    slices = (
        df.groupBy(*keys, F.floor(at / F.lit(gap_s * 1_000_000)).alias("__slice"))
        .agg(F.min(ts).alias("__from"), F.max(ts).alias("__to"), F.count("*").alias("__rows"))
    )
    marked = over_last_rows(slices, keys, ["__slice"], 1, {"__before": lambda w: F.lag("__to").over(w)},
                            hot_rows=hot_rows)
    silent = F.col("__from") - F.col("__before") >= F.make_dt_interval(secs=F.lit(gap_s))
    marked = marked.withColumn("__new", F.coalesce(silent.cast("int"), F.lit(1)))
    numbered = running_sums(marked, keys, ["__slice"], {"__session": F.col("__new")}, hot_rows)
    return (
        numbered.groupBy(*keys, "__session")
        .agg(F.min("__from").alias("session_start"), F.max("__to").alias("last_seen"),
             F.sum("__rows").alias("n"))
        .drop("__session")
    )


def stream_sessions(stream: DataFrame, ts: str, gap: str, keys: Sequence[str], delay: str) -> DataFrame:
    """Sessions of a stream, each given out once the watermark has passed its end."""
    return (
        stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("__w"), *keys)
        .agg(F.max(ts).alias("last_seen"), F.count("*").alias("n"))
        .select(*keys, F.col("__w.start").alias("session_start"), "last_seen", "n")
    )


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float],
              few: int = 1_000_000) -> DataFrame:
    """(keys, share, value): exact discrete quantiles, the smallest value that at least ``share`` of a group's
    values do not exceed.

    Groups of up to ``few`` values are ranked. In a larger group each quantile is closed in on: a mergeable sketch of the
    values still in question gives two borders around it, the values below, at, between and above them are counted, and
    the part that holds the quantile is looked at next, until at most ``few`` values (or one value) are left. A pass
    keeps about three of GRID parts, so a few passes do, and no task sees a whole group. The sketch only places the
    borders. Nulls and NaN are not counted.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.min("v").alias("low"), F.max("v").alias("high"))
    wanted = sizes.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    place = F.greatest(F.ceil(F.col("share") * F.col("rows")), F.lit(1)).cast("long")
    # ``left`` values lie in [low, high], ``place`` is the quantile's place among them.
    open_ = materialize(wanted.select(*keys, "share", "low", "high", F.col("rows").alias("left"), place.alias("place")),
                        "quantile-ranges")
    done = None

    def within(ranges: DataFrame) -> DataFrame:
        named = ranges.withColumnsRenamed({k: f"__k_{k}" for k in keys})
        same = (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        return rows.join(maybe_broadcast(named), same).drop(*[f"__k_{k}" for k in keys])

    while True:
        small = (F.col("left") <= few) | (F.col("low") == F.col("high"))
        done = open_.where(small) if done is None else done.unionByName(open_.where(small))
        large = open_.where(~small)
        if not large.limit(1).count():
            break
        grid = F.percentile_approx("v", [i / GRID for i in range(GRID + 1)], 20 * GRID)
        near = F.floor(F.col("place") / F.col("left") * GRID).cast("int")
        ranges = within(large).groupBy(*keys, "share", "place", "left", "low", "high").agg(grid.alias("grid")).select(
            *keys, "share", "place", "low", "high", F.get("grid", F.greatest(near - 1, F.lit(0))).alias("lower"),
            F.get("grid", F.least(near + 2, F.lit(GRID))).alias("upper"))
        ranges = materialize(ranges, "quantile-borders")
        v, lower, upper = F.col("v"), F.col("lower"), F.col("upper")
        part = F.when(v < lower, 0).when(v == lower, 1).when(v < upper, 2).when(v == upper, 3).otherwise(4)
        counted = within(ranges).groupBy(*keys, "share", "place", part.alias("part")).agg(
            F.count("*").alias("left"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("left").over(Window.partitionBy(*keys, "share").orderBy("part"))  # five rows at most
        holds = counted.withColumn("upto", upto).where(
            (F.col("place") <= F.col("upto")) & (F.col("place") > F.col("upto") - F.col("left")))
        open_ = materialize(holds.select(*keys, "share", "low", "high", "left", (
            F.col("place") - F.col("upto") + F.col("left")).alias("place")), "quantile-ranges")
    done = materialize(done, "quantile-ranges")
    flat = done.where("low = high").select(*keys, "share", F.col("low").alias(value))
    order = F.row_number().over(Window.partitionBy(*keys, "share").orderBy("v"))
    ranked = within(done.where("low < high")).withColumn("at", order).where("at = place")
    return flat.unionByName(ranked.select(*keys, "share", F.col("v").alias(value)))


def sketches(df: DataFrame, keys: Sequence[str], value: str, lg_k: int = 12) -> DataFrame:
    """A mergeable distinct-count sketch per group, of a fixed size; keep one per day or batch."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(value, lg_k).alias("sketch"))


def merge_sketches(kept: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketches of any union of the groups kept, and the number of distinct values they stand for."""
    merged = kept.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"), F.count("*").alias("parts"))
    return merged.withColumn("distinct", F.hll_sketch_estimate("sketch"))
