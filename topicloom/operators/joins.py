"""Lookup, merge, upsert, lineage, interval and hot-key joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.session import fits_broadcast, materialize, maybe_broadcast


def lookup(df: DataFrame, dim: DataFrame, on: dict[str, str], take: Sequence[str],
           how: str = "left", small: bool | None = None, **limits: int) -> DataFrame:
    """Enrich rows from a table with one row per key; no match yields nulls.

    The table is broadcast only when measured small; a larger one is shuffled and AQE splits hot
    keys. ``on`` maps columns of ``df`` to columns of ``dim``. A caller that looks up again and again, as
    a stream does, measures once and says whether the table is ``small``.
    """
    keyed = dim.select(*[F.col(d).alias(f"__on_{d}") for d in on.values()], *take)
    same = [F.col(c) == F.col(f"__on_{d}") for c, d in on.items()]
    fits = fits_broadcast(keyed, **limits) if small is None else small
    return df.join(F.broadcast(keyed) if fits else keyed, same, how).drop(*[f"__on_{d}" for d in on.values()])


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last version of each key. Partial aggregation keeps a hot key to one row per task."""
    newest = F.max_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*keys).agg(newest.alias("__row")).select("__row.*")


def earliest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    oldest = F.min_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*keys).agg(oldest.alias("__row")).select("__row.*")


def one_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key, the largest by the other columns that can be ordered; rows without a key stay."""
    rest = [c for c in df.columns if c not in keys and _ordered(df.schema[c].dataType)]
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    largest = F.max_by(F.struct(*df.columns), F.struct(*rest) if rest else F.lit(0))
    # Rows without a key match nothing; each keeps a group of its own.
    apart = F.when(~known, F.monotonically_increasing_id()).alias("__apart")
    grouped = df.select("*", apart).groupBy(*keys, "__apart").agg(largest.alias("__row"))
    return grouped.select("__row.*")


def _ordered(kind: T.DataType) -> bool:
    return not isinstance(kind, T.MapType | T.VariantType)


def merge_by_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Combine two topics to one row per key: every key of either side, left values win.

    Of several rows of a key on one side the largest counts, so copies never multiply.
    """
    a, b = one_per_key(left, keys).alias("a"), one_per_key(right, keys).alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    names = list(left.columns) + [c for c in right.columns if c not in left.columns]

    def pick(name: str) -> Column:
        sides = [F.col(f"{side}.{name}") for side, frame in (("a", left), ("b", right))
                 if name in frame.columns]
        return F.coalesce(*sides).alias(name)

    return a.join(b, same, "full_outer").select(*[pick(n) for n in names])


def import_upsert(current: DataFrame, incoming: DataFrame, key: str,
                  overwrite: Sequence[str]) -> DataFrame:
    """Insert unknown keys; for known keys replace only the ``overwrite`` columns.

    Of several rows of a key on one side the largest counts. Incoming values replace current ones
    even when null.
    """
    a, b = one_per_key(current, [key]).alias("a"), one_per_key(incoming, [key]).alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    is_new = F.col(f"a.{key}").isNull()
    untouched = F.col(f"b.{key}").isNull()

    def value(name: str) -> Column:
        if name not in incoming.columns:
            return F.col(f"a.{name}")
        old, new = F.col(f"a.{name}"), F.col(f"b.{name}")
        if name in overwrite:
            return F.when(untouched, old).otherwise(new).alias(name)
        return F.when(is_new, new).otherwise(old).alias(name)

    return joined.select(*[value(n) for n in current.columns])


def matching(df: DataFrame, other: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows whose key exists in the other table (each key of the other side counted once)."""
    return df.join(*_keys_of(other, on), "left_semi")


def not_matching(df: DataFrame, other: DataFrame, on: dict[str, str]) -> DataFrame:
    return df.join(*_keys_of(other, on), "left_anti")


def _keys_of(other: DataFrame, on: dict[str, str]) -> tuple[DataFrame, list[Column]]:
    keys = other.select(*[F.col(d).alias(f"__on_{d}") for d in on.values()]).distinct()
    return keys, [F.col(c) == F.col(f"__on_{d}") for c, d in on.items()]


def topic_lineage(tasks: DataFrame, config: str, topic_keys: Sequence[str],
                  topics: DataFrame, topic: str = "topic") -> DataFrame:
    """(task, topic) pairs: each task with every listed topic its config names exactly."""
    named = F.trim(F.concat_ws(",", *[F.col(config)[k] for k in topic_keys]))
    uses = tasks.withColumn(
        "__name", F.explode(F.array_distinct(F.split(named, r"\s*,\s*"))))
    wanted = topics.select(F.col(topic).alias("__topic")).distinct()
    return (
        uses.join(maybe_broadcast(wanted), F.col("__name") == F.col("__topic"))
        .withColumnRenamed("__name", topic).drop("__topic")
    )


def tasks_naming(tasks: DataFrame, config: str, topic_keys: Sequence[str],
                 text: str) -> DataFrame:
    """Tasks with the text anywhere in one of their topic settings."""
    hit = F.lit(False)
    for key in topic_keys:
        hit = hit | F.coalesce(F.col(config)[key].contains(text), F.lit(False))
    return tasks.where(hit)


def interval_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_micros: Column,
                  right_micros: Column, lower: int, upper: int) -> DataFrame:
    """Pairs of one key with ``lower <= right - left <= upper`` (microseconds).

    Time is cut into slices as wide as the interval, so a left row meets at most two slices and a
    hot key spreads over its slices. Left and right need different column names apart from ``by``.
    """
    width = max(upper - lower, 1)
    low, high = F.col("__at") + lower, F.col("__at") + upper

    def slice_of(c: Column) -> Column:
        return F.floor(c / F.lit(width)).cast("long")

    a = (
        left.withColumn("__at", left_micros)
        .withColumn("__slice", F.explode(F.sequence(slice_of(low), slice_of(high))))
    )
    b = right.withColumn("__seen", right_micros).withColumn("__slice", slice_of(F.col("__seen")))
    return (
        a.join(b, [*by, "__slice"]).where(F.col("__seen").between(low, high))
        .drop("__slice", "__at", "__seen")
    )


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[Column, Column],
                 right_span: tuple[Column, Column], per: Sequence[str] = (),
                 totals: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Pairs of rows whose closed intervals of whole numbers share a point; there is no equal key.

    Bins form a hierarchy: level k has bins 2**k wide. An interval lives at the level where it is at most one bin
    wide, so it touches at most two bins there and on every level above. Two intervals meet at the level of the
    wider one, in the bin that holds the larger of their starts, so each pair is made once and intervals of any
    length meet without a cross join. Intervals that are empty or lack an end match nothing. The two sides
    have different column names. Inputs are read more than once.

    With ``totals`` the result is one row per value of the left columns ``per`` that has a pair, with totals over its
    pairs, and the pairs are never made (see ``_overlap_totals``). ``totals`` maps names to a function of
    TOTALS and a right column ("*" counts pairs).
    """
    if totals is not None:
        return _overlap_totals(left, right, left_span, right_span, per, totals)

    def placed(df: DataFrame, span: tuple[Column, Column], side: str) -> DataFrame:
        low, high = f"__{side}_low", f"__{side}_high"
        known = df.withColumns({low: span[0].cast("long"), high: span[1].cast("long")}).where(
            F.col(low) <= F.col(high))
        # Bits of the length: the least k with 2**k > high - low.
        return known.withColumn(f"__{side}_level", F.length(F.conv(
            (F.col(high) - F.col(low)).cast("string"), 10, 2)) - (F.col(high) == F.col(low)).cast("int"))

    a, b = placed(left, left_span, "l"), placed(right, right_span, "r")

    def levels(df: DataFrame, column: str) -> list[int]:
        return sorted(r[0] for r in df.select(column).distinct().collect())  # 64 at most

    def bins(df: DataFrame, side: str, level: Column) -> DataFrame:
        width = F.expr(f"shiftleft(1L, __{side}_at)")
        at = df.withColumn(f"__{side}_at", level)
        return at.withColumn(f"__{side}_bin", F.explode(F.sequence(
            F.floor(F.col(f"__{side}_low") / width), F.floor(F.col(f"__{side}_high") / width))))

    def above(df: DataFrame, side: str, wider: list[int], own: bool) -> DataFrame:
        level = F.col(f"__{side}_level")
        fits = F.filter(F.array(*[F.lit(k) for k in wider]).cast("array<int>"),
                        lambda k: (k >= level) if own else (k > level))
        return bins(df, side, F.explode(fits))

    l_levels, r_levels = levels(a, "__l_level"), levels(b, "__r_level")
    start = F.greatest("__l_low", "__r_low")
    met = (F.col("__l_at") == F.col("__r_at")) & (F.col("__l_bin") == F.col("__r_bin"))
    share = (F.col("__l_low") <= F.col("__r_high")) & (F.col("__r_low") <= F.col("__l_high"))
    once = F.col("__l_bin") == F.floor(start / F.expr("shiftleft(1L, __l_at)"))
    left_wider = bins(a, "l", F.col("__l_level")).join(above(b, "r", l_levels, own=True), met & share & once)
    right_wider = above(a, "l", r_levels, own=False).join(bins(b, "r", F.col("__r_level")), met & share & once)
    columns = [*left.columns, *right.columns]
    return left_wider.select(*columns).unionByName(right_wider.select(*columns))


# Functions that totals of parts add up with.
TOTALS = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
STEP = 2  # bits from one level of bins to the next in totals of overlaps
NODE_ROWS = 100_000  # totals of the upper levels that are broadcast


def _overlap_totals(left: DataFrame, right: DataFrame, left_span: tuple[Column, Column],
                    right_span: tuple[Column, Column], per: Sequence[str],
                    totals: dict[str, tuple[str, str]]) -> DataFrame:
    """Totals over the right intervals that share a point with the left ones, without pairs.

    A right interval meets a left one if it holds the left one's start or starts inside the left one after that,
    never both. Level k has bins 2**(STEP * k) wide, and a range of whole numbers is a few bins of each level up to
    its length. Right intervals are added up by the bins they consist of: those that hold a start are in the bins
    around it, one a level. Right starts are added up by the bins around them: those inside a left interval
    are in the bins it consists of. So rows grow with the intervals and the levels, not with the pairs. The few
    bins of the upper levels, which every row meets, are broadcast; the others are joined.
    """
    low, high, keyed = F.col("__low"), F.col("__high"), ["__level", "__bin"]

    def known(df: DataFrame, span: tuple[Column, Column], columns: dict[str, str]) -> DataFrame:
        ends = df.withColumns({"__low": span[0].cast("long"), "__high": span[1].cast("long")}).where(low <= high)
        return ends.select("__low", "__high", *[F.col(c).alias(x) for c, x in columns.items()])

    def top(df: DataFrame) -> int:
        """The highest level that has a whole bin within an interval; halves of lengths do not overflow."""
        half = df.agg(F.max(F.shiftright(high, 1) - F.shiftright(low, 1))).first()[0]
        return 0 if half is None else min(int(half + 1).bit_length(), 62) // STEP

    def each_level(df: DataFrame, levels: Sequence[int]) -> DataFrame:
        return df.withColumn("__level", F.explode(F.array(*[F.lit(k) for k in levels])))

    def around(df: DataFrame, levels: Sequence[int], columns: Sequence[str]) -> DataFrame:
        """Bins of the levels that hold the start."""
        return each_level(df, levels).select(*columns, "__level", F.expr(
            f"shiftright(__low, {STEP} * __level)").alias("__bin"))

    def made_of(df: DataFrame, start: str, highest: int, levels: Sequence[int], columns: Sequence[str]) -> DataFrame:
        """Bins of the levels that make up the range from the start to high."""
        def whole(shift: str) -> list[Column]:
            rest = f"(shiftleft(1L, {shift}) - 1L)"
            return [F.expr(f"shiftright({start}, {shift}) + if(({start} & {rest}) != 0, 1L, 0L)"),
                    F.expr(f"shiftright(__high, {shift}) - if((__high & {rest}) != {rest}, 1L, 0L)")]

        at = each_level(df, levels).withColumns(dict(zip(("__first", "__last"), whole(f"{STEP} * __level"))))
        at = at.where("__first <= __last").withColumns(dict(zip(
            ("__inner", "__outer"), whole(f"{STEP} * least(__level + 1, {highest})"))))
        # Where the next level has whole bins too, only the bins in front of and behind those.
        split = f"__level < {highest} AND __inner <= __outer"
        at = at.withColumns({
            "__ahead": F.expr(f"if({split}, shiftleft(__inner, {STEP}) - __first, __last - __first + 1)"),
            "__behind": F.expr(f"if({split}, __last - shiftleft(__outer, {STEP}) - {(1 << STEP) - 1}, 0L)")})
        # There are twice a family less two of them at most.
        counted = at.withColumn("__i", F.explode(F.array(*[F.lit(i) for i in range(2 << STEP)])))
        return counted.where("__i < __ahead + __behind").select(*columns, "__level", F.expr(
            "if(__i < __ahead, __first + __i, __last - (__i - __ahead))").alias("__bin"))

    used = {c: f"__of_{c}" for _, c in totals.values() if c != "*"}
    keys = {c: f"__per_{c}" for c in per}
    a, b = known(left, left_span, keys), known(right, right_span, used)
    tops = {"holds": top(b), "starts": top(a)}
    every = {kind: range(most + 1) for kind, most in tops.items()}
    parts = [getattr(F, how)(F.lit(1) if c == "*" else F.col(used[c])).alias(f"__{name}")
             for name, (how, c) in totals.items()]
    merged = [TOTALS[how](f"__{name}").alias(f"__{name}") for name, (how, _) in totals.items()]
    # Intervals with a further point after their start.
    longer = a.where(low < high).withColumn("__after", low + 1)
    nodes = {
        "holds": made_of(b, "__low", tops["holds"], every["holds"], list(used.values())),
        "starts": around(b, every["starts"], list(used.values())),
    }
    found = []
    for kind, spread in nodes.items():
        summed = materialize(spread.groupBy(*keyed).agg(*parts), "nodes")
        sizes, room, upper = summed.groupBy("__level").count().collect(), NODE_ROWS, []  # 32 rows at most
        for size in sorted(sizes, key=lambda r: r["count"]):
            room -= size["count"]
            upper += [size["__level"]] if room >= 0 else []
        lower = [r["__level"] for r in sizes if r["__level"] not in upper]
        for levels, small in ((upper, True), (lower, False)):
            if levels:
                seekers = around(a, levels, list(keys.values())) if kind == "holds" else made_of(
                    longer, "__after", tops["starts"], levels, list(keys.values()))
                side = summed.where(F.col("__level").isin(levels))
                met = seekers.join(F.broadcast(side) if small else side, keyed)
                found.append(met.groupBy(*keys.values()).agg(*merged))
    named = [F.col(x).alias(c) for c, x in keys.items()] + [F.col(f"__{name}").alias(name) for name in totals]
    if not found:  # no right interval
        return a.join(nodes["starts"].where("false").groupBy(*keyed).agg(*parts), F.lit(False)).select(*named)
    return reduce(DataFrame.unionByName, found).groupBy(*keys.values()).agg(*merged).select(*named)


GRAM = 4  # letters of the longest piece of a name that is looked up


def substring_lineage(tasks: DataFrame, config: str, topic_keys: Sequence[str], topics: DataFrame,
                      topic: str = "topic") -> DataFrame:
    """(task without its config, topic), each pair once: tasks with every listed topic whose name is part of one of
    their settings.

    Each name is looked up by its rarest piece: pieces of GRAM letters (shorter names: the name itself) are counted
    over all settings, and only settings that hold a name's rarest piece are compared with it. Empty names
    match nothing.
    """
    def pieces(text: str, sizes: Column) -> Column:
        """Distinct pieces of each of the sizes."""
        each = F.transform(sizes, lambda k: F.transform(
            F.filter(F.sequence(F.lit(1), F.greatest(F.length(text) - k + 1, F.lit(1))),
                     lambda i: i + k - 1 <= F.length(text)), lambda i: F.substr(F.col(text), i, k)))
        return F.array_distinct(F.flatten(each))

    names = topics.select(F.col(topic).alias("__name")).where("length(__name) > 0").distinct()
    given = tasks.withColumn("__setting", F.explode(F.filter(
        F.array(*[F.col(config)[k] for k in topic_keys]), lambda x: x.isNotNull())))
    settings = given.select("__setting").distinct()
    held = settings.select("__setting", F.explode(pieces(
        "__setting", F.sequence(F.lit(1), F.lit(GRAM)))).alias("__piece"))
    counts = held.groupBy("__piece").agg(F.count("*").alias("__n"))
    size = F.least(F.length("__name"), F.lit(GRAM))
    own = names.select("__name", F.explode(pieces("__name", F.array(size))).alias("__piece"))
    rarest = own.join(counts, "__piece", "left").groupBy("__name").agg(
        F.min_by("__piece", F.struct(F.coalesce("__n", F.lit(0)), "__piece")).alias("__piece"))
    found = held.join(rarest, "__piece").where(F.contains("__setting", "__name")).select("__setting", "__name")
    # A task may name a topic in several settings.
    return (given.drop(config).join(found, "__setting").drop("__setting").withColumnRenamed("__name", topic)
            .distinct())
