"""Analytics over the tables a pipeline keeps about itself: logs, status and config changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.operators.aggregates import LOST, RUNNING, STREAMING, UNASSIGNED
from topicloom.operators.ordered import over_last_rows
from topicloom.operators.transforms import not_equal, search_records

# Fixed value: log level never shown.
HIDDEN_LEVEL = "DEBUG"


def search_logs(logs: DataFrame, level: str, keyword: str | None = None,
                hidden: str = HIDDEN_LEVEL) -> DataFrame:
    """Log records without the hidden level (records lacking a level stay)."""
    return search_records(logs.where(not_equal(level, hidden)), keyword)


def logs_of_task(logs: DataFrame, message: str, task_id: str) -> DataFrame:
    return logs.where(F.col(message).contains(task_id))


def is_status_change(old: Column, new: Column) -> Column:
    """A real change of status; a running task briefly seen unassigned is not one.

    A status that cannot be found counts as lost.
    """
    seen = F.upper(F.coalesce(new, F.lit(LOST)))
    flap = (F.upper(old) == RUNNING) & (seen == UNASSIGNED)
    return (F.upper(old) != seen) & ~flap


def status_changes(df: DataFrame, keys: Sequence[str], order: Sequence[str], status: str,
                   seed: DataFrame | None = None, hot_rows: int | None = None) -> DataFrame:
    """Rows whose status differs from the previous row of the same task."""
    watched = over_last_rows(df, list(keys), list(order), 1,
                             {"old_status": lambda w: F.lag(status).over(w)}, seed, hot_rows)
    new = F.coalesce(F.col(status), F.lit(LOST))
    return (
        watched.where(is_status_change(F.col("old_status"), F.col(status)))
        .withColumn("new_status", new)
    )


def guarded_change(old: Column, new: Column, old_code: Column, new_code: Column) -> Column:
    """A status change that counts only while the task still runs the same code.

    Here a running task that is seen unassigned has changed.
    """
    seen = F.upper(F.coalesce(new, F.lit(LOST)))
    return (F.upper(old) != seen) & (F.lower(old_code) == F.lower(new_code))


def config_text(config: Column) -> Column:
    """Text of a config map that does not depend on key order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(config))))


def config_changes(old: DataFrame, new: DataFrame, key: str, config: str) -> DataFrame:
    """Tasks whose config differs between two tables with one row per task; none at all differs
    from any config."""
    a = old.select(F.col(key), config_text(F.col(config)).alias("old_config"))
    b = new.select(F.col(key), config_text(F.col(config)).alias("new_config"))
    return a.join(b, key).where(~F.col("old_config").eqNullSafe(F.col("new_config")))


def needs_refresh(status: Column) -> Column:
    return F.upper(status).isin(RUNNING, STREAMING, UNASSIGNED, LOST)
