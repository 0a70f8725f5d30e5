"""Jobs over a table of schema subjects: (subject, version, schema_id, schema_json, compatibility)."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.operators.joins import not_matching
from topicloom.operators.ordered import over_last_rows, running_sums
from topicloom.session import materialize

# Subjects with these name parts are internal; the compatibility default.
INTERNAL_NAME_PARTS = ("df_meta", "-value", "-key")
DEFAULT_COMPATIBILITY = "NONE"


def latest_schemas(subjects: DataFrame) -> DataFrame:
    newest = F.max_by(F.struct("version", "schema_id", "schema_json", "compatibility"),
                      F.col("version"))
    return subjects.groupBy("subject").agg(newest.alias("s")).select("subject", "s.*")


def list_subjects(subjects: DataFrame) -> DataFrame:
    """Latest schema per public subject, with the default where no compatibility is set."""
    public = F.lit(True)
    for part in INTERNAL_NAME_PARTS:
        public = public & ~F.contains(F.col("subject"), F.lit(part))
    return latest_schemas(subjects.where(public)).withColumn(
        "compatibility", F.coalesce("compatibility", F.lit(DEFAULT_COMPATIBILITY)))


def schema_of(subjects: DataFrame, subject: str, version: int | str = "latest") -> DataFrame:
    """The schema row of one subject, by version or the latest."""
    rows = subjects.where(F.col("subject") == subject)
    if version == "latest":
        return latest_schemas(rows)
    return rows.where(F.col("version") == int(version))


def latest_schema_id(subjects: DataFrame, subject: str) -> int:
    found = schema_of(subjects, subject).select("schema_id").first()
    if found is None:
        raise LookupError(f"no schema registered for {subject!r}")
    return found["schema_id"]


def register_absent(subjects: DataFrame, candidates: DataFrame,
                    hot_rows: int | None = None) -> DataFrame:
    """Append candidates (subject, schema_json) and their ``-value`` twins that are not there yet.

    New ids follow the highest existing one in subject order.
    """
    both = candidates.select(
        F.explode(F.array("subject", F.concat("subject", F.lit("-value")))).alias("subject"),
        "schema_json")
    once = both.groupBy("subject").agg(F.min("schema_json").alias("schema_json"))
    fresh = not_matching(once, subjects, {"subject": "subject"})
    top = subjects.agg(F.coalesce(F.max("schema_id"), F.lit(0)).alias("m")).first()["m"]
    # A very long list of subjects is numbered in chunks, which reads it more than once: write it first.
    fresh = materialize(fresh, "subjects")
    numbered = running_sums(fresh, [], ["subject"], {"__n": F.lit(1)}, hot_rows)
    added = numbered.select(
        "subject", F.lit(1).cast("long").alias("version"),
        (F.col("__n") + F.lit(top)).cast("long").alias("schema_id"), "schema_json",
        F.lit(None).cast("string").alias("compatibility"))
    return subjects.select(*added.columns).unionByName(added)


def upsert_schemas(subjects: DataFrame, changes: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Add or replace schemas by changes (subject, schema_json, compatibility), in ``order``.

    Each change of a subject becomes its next version. One that repeats the schema before it makes no
    version; the compatibility it brings is set on the version it repeats. Changes of one subject that
    ``order`` does not tell apart are taken in the order of their text.
    """
    tops = latest_schemas(subjects).select("subject", "schema_json", F.col("version").alias("__top"))
    named = changes.select(
        F.coalesce("subject", F.get_json_object("schema_json", "$.name")).alias("subject"),
        "schema_json", "compatibility", *order).withColumn("__step", F.lit(1))
    start = tops.drop("__top").withColumn("__step", F.lit(0))
    steps = materialize(named.unionByName(start, allowMissingColumns=True), "schema-changes")
    chain = ["__step", *order, "schema_json"]
    seen = over_last_rows(steps, ["subject"], chain, 1,
                          {"__before": lambda w: F.lag("schema_json").over(w)})
    is_new = (F.col("__step") == 1) & ~F.col("schema_json").eqNullSafe(F.col("__before"))
    counted = running_sums(seen.withColumn("__new", is_new.cast("int")), ["subject"], chain,
                           {"__n": F.col("__new")})
    versioned = counted.where("__step = 1").join(tops.select("subject", "__top"), "subject", "left")
    top = F.coalesce("__top", F.lit(0))
    given = F.max_by("compatibility", F.when(F.col("compatibility").isNotNull(), F.struct(*chain)))
    found = materialize(
        versioned.groupBy("subject", (top + F.col("__n")).cast("long").alias("version"),
                          (F.col("__n") > 0).alias("__added"))
        .agg(F.min("schema_json").alias("schema_json"), given.alias("compatibility")), "schema-versions")
    repeated = found.where("NOT __added").select(
        "subject", "version", F.col("compatibility").alias("__given"))
    kept = subjects.join(repeated, ["subject", "version"], "left").withColumn(
        "compatibility", F.coalesce("__given", "compatibility"))
    top_id = subjects.agg(F.coalesce(F.max("schema_id"), F.lit(0)).alias("m")).first()["m"]
    fresh = found.where("__added").withColumn("__h", F.xxhash64("subject"))
    numbered = running_sums(fresh, [], ["__h", "subject", "version"], {"__id": F.lit(1)})
    added = numbered.select("subject", "version", (F.col("__id") + F.lit(top_id)).cast("long").alias("schema_id"),
                            "schema_json", "compatibility")
    return kept.select(*added.columns).unionByName(added)


def delete_subjects(subjects: DataFrame, names: DataFrame) -> DataFrame:
    """Drop all versions of the named subjects (column ``subject``)."""
    return not_matching(subjects, names, {"subject": "subject"})


def compat_check(old_json: str, new_json: str, level: str = "BACKWARD") -> list[str]:
    """Reasons why a new record schema breaks a level; empty when it does not."""
    old, new = json.loads(old_json), json.loads(new_json)
    before = {f["name"]: f for f in old.get("fields", [])}
    after = {f["name"]: f for f in new.get("fields", [])}
    problems = [f"type of {n} changed" for n in before.keys() & after.keys()
                if before[n]["type"] != after[n]["type"]]
    if level in ("BACKWARD", "FULL"):
        problems += [f"{n} added without default" for n in after.keys() - before.keys()
                     if "default" not in after[n]]
    if level in ("FORWARD", "FULL"):
        problems += [f"{n} removed without default" for n in before.keys() - after.keys()
                     if "default" not in before[n]]
    return [] if level == "NONE" else sorted(problems)
