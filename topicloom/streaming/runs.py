"""Starting, resuming and reading streaming jobs.

Every path lies below a shared folder, each batch overwrites its own ``batch_id=`` folder, and
offsets live in the checkpoint, so a job may die at any point and be started again.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from topicloom.operators.joins import latest_per_key
from topicloom.session import numbered, path_exists, read_text, remove_path, write_text
from topicloom.sources.topics import ONCE_THROUGH

COMPACT_EVERY = 20  # batches after which a change log gets a new base

BatchStep = Callable[[DataFrame], DataFrame]


def checkpoint_for(root: str, job: str, config: dict[str, object]) -> str:
    """Checkpoint folder of a job: the same config resumes, a changed one starts anew."""
    text = json.dumps(config, sort_keys=True, default=str)
    return f"{root}/{job}/{hashlib.sha256(text.encode()).hexdigest()[:16]}"


def drain(query: StreamingQuery) -> None:
    """Wait until the available input is processed; raises what the job raised."""
    query.awaitTermination()


def write_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "append",
                  step: BatchStep | None = None, trigger: dict | None = None,
                  log: ChangeLog | None = None) -> StreamingQuery:
    """Write each micro-batch, after an optional batch step, to its own folder.

    Inside the step a batch is an ordinary DataFrame, so AQE and its skew handling apply. A job whose batches
    are changes of a table gives its ``log``, which keeps the number of batches to read small.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        if log:
            log.before_batch(batch_id)
        result = step(batch) if step else batch
        result.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or ONCE_THROUGH)).start()
    )


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    if not path_exists(spark, path):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(path)


@dataclass(frozen=True)
class ChangeLog:
    """The table behind an update-mode job: a sorted base with the newest version of each key, and the batches
    since. ``<path>-base/pointer.json`` says which base counts and which batch it reaches to; it is replaced
    in one step after the new base is complete, so a stop at any point leaves the old or the new state.

    A base is made of batches that are done for good (those before the running one). What an older pointer
    needed is deleted one compaction later, when no reader that started before the swap is left.
    """

    spark: SparkSession
    path: str
    schema: T.StructType
    keys: Sequence[str]
    every: int = COMPACT_EVERY

    def _full(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField("batch_id", T.LongType())])

    def pointer(self) -> dict[str, int]:
        """``upto``: last batch in the base; ``was``: that of the base before it; -1 for none."""
        text = read_text(self.spark, f"{self.path}-base/pointer.json")
        return json.loads(text) if text else {"upto": -1, "was": -1}

    def versions(self, until: int | None = None) -> DataFrame:
        """The base and the batches after it, up to one of them."""
        upto = self.pointer()["upto"]
        newer = [n for n in numbered(self.spark, self.path, "batch_id=")
                 if n > upto and (until is None or n <= until)]
        found = self.spark.createDataFrame([], self._full()) if upto < 0 else (
            self.spark.read.schema(self._full()).parquet(f"{self.path}-base/upto={upto}"))
        if not newer:
            return found
        batches = self.spark.read.schema(self._full()).option("basePath", self.path).parquet(
            *[f"{self.path}/batch_id={n}" for n in newer])
        return batches if upto < 0 else found.unionByName(batches)

    def read(self) -> DataFrame:
        """The newest version of each key."""
        return latest_per_key(self.versions(), self.keys, ["batch_id"]).drop("batch_id")

    def before_batch(self, batch_id: int) -> None:
        if batch_id - 1 - self.pointer()["upto"] >= self.every:
            self.compact(batch_id - 1)

    def compact(self, upto: int) -> None:
        old = self.pointer()
        if upto <= old["upto"]:
            return
        newest = latest_per_key(self.versions(upto), self.keys, ["batch_id"])
        target = f"{self.path}-base/upto={upto}"
        newest.repartitionByRange(*self.keys).sortWithinPartitions(*self.keys).write.mode(
            "overwrite").parquet(target)
        write_text(self.spark, f"{self.path}-base/pointer.json",
                   json.dumps({"upto": upto, "was": old["upto"]}))
        for n in numbered(self.spark, self.path, "batch_id="):
            if n <= old["upto"]:
                remove_path(self.spark, f"{self.path}/batch_id={n}")
        for n in numbered(self.spark, f"{self.path}-base", "upto="):
            if n < old["upto"]:
                remove_path(self.spark, f"{self.path}-base/upto={n}")


def read_latest(spark: SparkSession, path: str, schema: T.StructType,
                keys: Sequence[str]) -> DataFrame:
    """Final table of an update-mode job: the newest version of each key, from base and newer batches."""
    return ChangeLog(spark, path, schema, keys).read()


class DroppedRows(StreamingQueryListener):
    """Counts what stateful operators drop because it comes after the watermark, per job:
    ``spark.streams.addListener(DroppedRows())``."""

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        job = str(event.progress.id)
        more = sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)
        self.dropped[job] = self.dropped.get(job, 0) + more

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def show(stream: DataFrame, checkpoint: str, mode: str = "append", rows: int = 20,
         trigger: dict | None = None) -> StreamingQuery:
    """Print micro-batches to the console, for debugging."""
    return (
        stream.writeStream.format("console").outputMode(mode).option("numRows", rows)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or ONCE_THROUGH)).start()
    )


class StreamTask:
    """A job that can be paused and resumed; an action that fails leaves the status as it was."""

    def __init__(self, start: Callable[[], StreamingQuery]):
        self._start = start
        self._query: StreamingQuery | None = None
        self.status = "UNASSIGNED"

    def _act(self, status: str, action: Callable[[], StreamingQuery | None]) -> None:
        before, self.status = self.status, status
        try:
            self._query = action()
        except Exception:
            self.status = before
            raise

    def resume(self) -> None:
        self._act("RUNNING", self._start)

    def pause(self) -> None:
        def stop() -> None:
            if self._query is None:
                raise RuntimeError("the task is not running")
            self._query.stop()

        self._act("PAUSED", stop)

    def finish(self) -> None:
        if self._query is not None:
            drain(self._query)
        self.status = "FINISHED"


def restart_changed(task_config: dict, running_config: dict) -> bool:
    """Whether a config change calls for a new run; key order does not matter."""
    return json.dumps(task_config, sort_keys=True) != json.dumps(running_config, sort_keys=True)


def as_plain_time(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})
