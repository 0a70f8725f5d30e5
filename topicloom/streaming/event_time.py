"""Row frames on streams in order of event time.

Rows wait in a table of time slices until the watermark has passed their slice; only then are they handed
on, so frames see event order however files arrive. A folder holds, below ``root``:

* ``marks/<n>.json``: what was known when batch n was done, written last and in one step;
* ``waiting/batch_id=<n>/slice=<s>``: rows of batch n that wait, written once and read once;
* ``late/batch_id=<n>``: rows whose slice had been handed on before they came, and rows without a time;
* ``carried/batch_id=<n>/bucket=<b>``: the last rows of every key of a bucket of key hashes. A batch opens and
  rewrites only the buckets of the keys it hands on; the mark says which version of a bucket counts;
* ``rows/batch_id=<n>``: the results.

A batch reads what marks of earlier batches point to and overwrites its own folders, so it may be repeated.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from topicloom.operators.ordered import key_hash, last_rows
from topicloom.session import child_names, numbered, read_text, remove_path, write_text
from topicloom.sources.topics import ONCE_THROUGH

BUCKETS = 64
NOTHING_YET, ALL = -(2**62), 2**62

Apply = Callable[[DataFrame, DataFrame | None], DataFrame]


@dataclass(frozen=True)
class Mark:
    """``newest``: largest event time in microseconds; ``cut``: slices below it were handed on; ``versions``:
    the batch that wrote each bucket last; ``arrived`` and ``late``: rows of all batches so far."""

    batch_id: int
    newest: int
    cut: int
    versions: list[int]
    arrived: int = 0
    late: int = 0


@dataclass(frozen=True)
class EventTimeRows:
    """A row-frame job. ``apply(rows, seed)`` computes rows that are in order of time after all rows before;
    ``seed`` holds the last ``back`` rows of their keys from before."""

    spark: SparkSession
    root: str
    keys: Sequence[str]
    order: Sequence[str]
    ts: str
    delay_s: int
    back: int
    apply: Apply
    slice_s: int | None = None  # the delay if not given
    buckets: int = BUCKETS

    def start(self, stream: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        return (
            stream.writeStream.foreachBatch(self.step).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or ONCE_THROUGH)).start()
        )

    def mark_before(self, batch_id: int) -> Mark:
        done = [n for n in numbered(self.spark, f"{self.root}/marks", "", ".json") if n < batch_id]
        if not done:
            return Mark(-1, NOTHING_YET, NOTHING_YET, [-1] * self.buckets)
        return Mark(**json.loads(read_text(self.spark, f"{self.root}/marks/{done[-1]}.json")))

    def step(self, batch: DataFrame, batch_id: int) -> None:
        before = self.mark_before(batch_id)
        self._forget(before)
        batch = batch.withColumn("slice", self._slice()).persist()
        try:
            is_late = F.col("slice").isNull() | (F.col("slice") < before.cut)
            seen = batch.agg(F.max(F.unix_micros(F.col(self.ts).cast("timestamp"))).alias("newest"),
                             F.count("*").alias("arrived"), F.count_if(is_late).alias("late")).first()
            newest = max(before.newest, NOTHING_YET if seen["newest"] is None else seen["newest"])
            cut = max(before.cut, (newest - self.delay_s * 1_000_000) // self._width())
            if seen["late"]:
                self._write(batch.where(is_late).drop("slice"), "late", batch_id)
            else:
                remove_path(self.spark, f"{self.root}/late/batch_id={batch_id}")
            waits = batch.where(F.col("slice") >= cut)
            self._write(waits, "waiting", batch_id, "slice")
            ready = batch.where(~is_late & (F.col("slice") < cut)).drop("slice")
            versions = self._hand_on(ready, before, batch_id, cut)
            mark = Mark(batch_id, newest, cut, versions, before.arrived + seen["arrived"],
                        before.late + seen["late"])
            write_text(self.spark, f"{self.root}/marks/{batch_id}.json", json.dumps(asdict(mark)))
        finally:
            batch.unpersist()

    def finish(self, schema: T.StructType) -> None:
        """Hand on what still waits, as nothing more is expected. Leaves no mark: if more rows do come, the
        next batch takes the place of this result and nothing of them is late that was not before."""
        before = self.mark_before(ALL)
        self._hand_on(self.spark.createDataFrame([], schema), before, before.batch_id + 1, ALL)

    def results(self, schema: T.StructType) -> DataFrame:
        return self._read("rows", schema).drop("batch_id")

    def late_rows(self, schema: T.StructType) -> DataFrame:
        return self._read("late", schema).drop("batch_id")

    def _width(self) -> int:
        return max(1, self.slice_s or self.delay_s) * 1_000_000

    def _slice(self) -> Column:
        at = F.unix_micros(F.col(self.ts).cast("timestamp"))
        return F.floor(at / F.lit(self._width())).cast("long")

    def _bucket(self) -> Column:
        return F.pmod(key_hash(list(self.keys)), F.lit(self.buckets)).cast("int")

    def _write(self, df: DataFrame, part: str, batch_id: int, *by: str) -> None:
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{self.root}/{part}/batch_id={batch_id}")

    def _read(self, part: str, schema: T.StructType, *by: T.StructField) -> DataFrame:
        full = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType()), *by])
        path = f"{self.root}/{part}"
        if not child_names(self.spark, path):
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).parquet(path)

    def _hand_on(self, ready: DataFrame, before: Mark, batch_id: int, cut: int) -> list[int]:
        waited = self._read("waiting", ready.schema, T.StructField("slice", T.LongType())).where(
            (F.col("slice") >= before.cut) & (F.col("slice") < cut) & (F.col("batch_id") < batch_id))
        ready = ready.unionByName(waited.drop("batch_id", "slice"))
        met = sorted(r["b"] for r in ready.select(self._bucket().alias("b")).distinct().collect())
        seed = self.carried(ready.schema, before, met)
        self._write(self.apply(ready, seed), "rows", batch_id)
        known = ready if seed is None else ready.unionByName(seed)
        last = last_rows(known, list(self.keys), list(self.order), self.back)
        self._write(last.withColumn("bucket", self._bucket()), "carried", batch_id, "bucket")
        touched = set(met)
        return [batch_id if b in touched else old for b, old in enumerate(before.versions)]

    def carried(self, schema: T.StructType, mark: Mark, buckets: Sequence[int]) -> DataFrame | None:
        """Last rows of the keys of some buckets; files of other buckets are not opened."""
        paths = [f"{self.root}/carried/batch_id={mark.versions[b]}/bucket={b}" for b in buckets
                 if mark.versions[b] >= 0]
        return self.spark.read.schema(schema).parquet(*paths) if paths else None

    def _forget(self, mark: Mark) -> None:
        """Drop what no batch can need any more, now that the batch of ``mark`` is done."""
        for n in numbered(self.spark, f"{self.root}/waiting", "batch_id="):
            slices = [s for s in child_names(self.spark, f"{self.root}/waiting/batch_id={n}")
                      if s.startswith("slice=")]
            gone = [s for s in slices if s[6:].lstrip("-").isdigit() and int(s[6:]) < mark.cut]
            for name in gone:
                remove_path(self.spark, f"{self.root}/waiting/batch_id={n}/{name}")
            if n < mark.batch_id and len(gone) == len(slices):
                remove_path(self.spark, f"{self.root}/waiting/batch_id={n}")
        for n in numbered(self.spark, f"{self.root}/carried", "batch_id="):
            if n > mark.batch_id:
                continue
            for name in child_names(self.spark, f"{self.root}/carried/batch_id={n}"):
                if name.startswith("bucket=") and mark.versions[int(name[7:])] != n:
                    remove_path(self.spark, f"{self.root}/carried/batch_id={n}/{name}")
            if n not in mark.versions:
                remove_path(self.spark, f"{self.root}/carried/batch_id={n}")
        for n in numbered(self.spark, f"{self.root}/marks", "", ".json"):
            if n < mark.batch_id:
                remove_path(self.spark, f"{self.root}/marks/{n}.json")
