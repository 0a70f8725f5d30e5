"""Column functions for configs and JSON carried in text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Config keys that hold topic names.
TOPIC_LIST_KEYS = ("topics", "topic_in")
TOPIC_KEYS = ("topic", "topic_out")
# How nested JSON is quoted, and the doubled quote before or after a word.
QUOTED_JSON = (('"{', "{"), ('}"', "}"), ('\\"', '"'))
DOUBLED_QUOTE = r'""(?=[^",:\]}\s])|(?<=[^",:\[{\s])""'
ALL_TOPIC_KEYS = TOPIC_LIST_KEYS + TOPIC_KEYS


def unescape_json(text: Column) -> Column:
    """Turn JSON that holds JSON as quoted text into nested JSON; empty text becomes ``[]``.

    A doubled quote is undone only where it opens or closes a word, so empty texts stay empty.
    """
    out = text
    for old, new in QUOTED_JSON:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.regexp_replace(out, DOUBLED_QUOTE, '"')
    return F.when(text == "", F.lit("[]")).otherwise(out)


def strip_comments(text: Column) -> Column:
    """Remove ``/* .. */`` that follows white space and ends on its line."""
    return F.regexp_replace(text, r"\s+?/\*.*?\*/", "")


def dots_to_underscores(config: Column) -> Column:
    return F.transform_keys(config, lambda k, v: F.replace(k, F.lit("."), F.lit("_")))


def underscores_to_dots(config: Column) -> Column:
    """Not the inverse where a key had underscores to begin with."""
    return F.transform_keys(config, lambda k, v: F.replace(k, F.lit("_"), F.lit(".")))


def topics_to_string(config: Column, keys: Sequence[str] = TOPIC_LIST_KEYS) -> Column:
    """Topic settings given as JSON arrays become comma-separated text."""
    def flat(key: Column, value: Column) -> Column:
        is_list = key.isin(*keys) & F.startswith(F.ltrim(value), F.lit("["))
        return F.when(is_list, F.array_join(F.from_json(value, "array<string>"), ",")
                      ).otherwise(value)

    return F.transform_values(config, flat)


def with_active_variant(df: DataFrame, config_json: str, name: str, ignored: str,
                        out: str = "config") -> DataFrame:
    """Add the settings as a map with the active one of ``name``, ``name_1``, .. under ``name``.

    Variants holding the ``ignored`` key are dropped, the last other one is used, and the search
    stops at the first missing number. Done in steps so that the JSON is parsed once.
    """
    prefix = f"{name}_"
    settings, variants, found = F.col("__settings"), F.col("__variants"), F.col("__found")

    def variant(entry: Column) -> Column:
        number = F.substring(entry["key"], len(prefix) + 1, 9).try_cast("int")
        number = F.when(entry["key"] == name, 0).when(
            (number > 0) & (entry["key"] == F.concat(F.lit(prefix), number.cast("string"))), number)
        is_ignored = F.array_contains(F.json_object_keys(entry["value"]), ignored)
        return F.struct(number.alias("number"), entry["key"].alias("key"),
                        F.coalesce(is_ignored, F.lit(False)).alias("ignored"))

    def follow(state: Column, v: Column) -> Column:
        is_next = v["number"] == state["next"]
        return F.struct(
            F.when(is_next, state["next"] + 1).otherwise(state["next"]).alias("next"),
            F.when(is_next & ~v["ignored"], v["number"]).otherwise(state["best"]).alias("best"))

    start = F.struct(F.lit(0).alias("next"), F.lit(0).alias("best"))
    steps = (
        df.withColumn("__settings", F.from_json(strip_comments(F.col(config_json)),
                                                "map<string,string>"))
        .withColumn("__variants", F.sort_array(F.filter(
            F.transform(F.map_entries(settings), variant), lambda v: v["number"].isNotNull())))
        .withColumn("__found", F.aggregate("__variants", start, follow))
    )
    gone = F.transform(F.filter(variants, lambda v: v["ignored"] & (v["number"] < F.col(
        "__found")["next"])), lambda v: v["key"])
    active = F.when(found["best"] > 0, F.concat(F.lit(prefix), found["best"].cast("string")))
    steps = steps.withColumns({"__gone": gone, "__active": active})
    moved = F.col("__active").isNotNull()
    rest = F.map_filter(settings, lambda k, v: ~F.array_contains(F.col("__gone"), k) & ~(
        F.col("__active").isNotNull() & ((k == name) | (k == F.col("__active")))))
    chosen = F.create_map(F.lit(name), settings[F.col("__active")])
    return steps.withColumn(out, F.when(moved, F.map_concat(rest, chosen)).otherwise(rest)).drop(
        "__settings", "__variants", "__found", "__gone", "__active")


def choose(a: Column, b: Column, same: Column, other: Column) -> Column:
    """``same`` when both texts are equal regardless of case."""
    return F.when(F.lower(a) == F.lower(b), same).otherwise(other)


def first_known(*values: Column) -> Column:
    return F.coalesce(*values)
