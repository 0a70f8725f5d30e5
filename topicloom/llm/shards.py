"""Sorted shards of files in the shared folder, committed through temporary names and a manifest.

The cut into shards depends on the keys and sizes alone, not on how the cluster happens to be laid out:
keys fall into at most KEY_RANGES equal ranges, whose sizes are summed, heavy ranges are cut again, and
neighbouring ranges are joined up to SHARD_BYTES. Tasks write files under temporary names and report them; only reported files of tasks
that succeeded are renamed, and readers go by the manifest. A task that is repeated after the loss of an
executor writes new temporary files, and what its lost attempt left is deleted with the temporary folder.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator
from decimal import Decimal

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.session import fresh_dir, materialize

KEY_RANGES = 65_536
DEEPER_RANGES = 1024  # ranges that one range is cut into again
MOST_CELLS = 1 << 20  # ranges cut again at a time, all together
SHARD_BYTES = 64 << 20
NO_KEY = -1  # the cell of rows without a key

MANIFEST = pa.schema([("shard", pa.int64()), ("part", pa.int64()), ("name", pa.string()),
                      ("temporary", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()),
                      ("items", pa.int64())])
MANIFEST_DDL = ("shard long, part long, name string, temporary string, bytes long, records long, "
                "items long")


def place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def with_shard(rows: DataFrame, sizes: DataFrame, key: str, size: str, spread: Column) -> tuple[DataFrame, int]:
    """``rows`` with the shard of their key, from ``sizes`` (key, size); and how many shards there are.

    Ranges above SHARD_BYTES are cut again, level by level, down to single keys, so a few far keys do not put
    all others into one shard. What one key (or the lack of one) has above SHARD_BYTES is dealt over shards of its own by
    ``spread``, a hash of the row.
    """
    spark = rows.sparkSession
    ends = sizes.agg(F.min(key), F.max(key)).first()
    low, high = (ends[0] or 0), (ends[1] or 0)
    step = max(1, -(-(high - low + 1) // KEY_RANGES))
    bases, cuts, tables = [0], {0: (low, step)}, []

    def bounds(cell: int) -> tuple[int, int]:
        base = bases[bisect_right(bases, cell) - 1]
        return cuts[base][0] + (cell - base) * cuts[base][1], cuts[base][1]

    def celled(df: DataFrame) -> DataFrame:
        at = F.expr(f"CAST((CAST({key} AS DECIMAL(20, 0)) - {low}BD) DIV {step} AS LONG)")
        df = df.withColumn("__cell", F.coalesce(at, F.lit(NO_KEY)))
        for table in tables:
            deeper = F.col("__base") + F.expr(f"CAST((CAST({key} AS DECIMAL(20, 0)) - __low) DIV __step AS LONG)")
            df = df.join(F.broadcast(table), "__cell", "left").withColumn(
                "__cell", F.coalesce(deeper, F.col("__cell"))).drop("__base", "__low", "__step")
        return df

    def histogram(least: int) -> dict[int, int]:
        return {r["__cell"]: r["bytes"] or 0 for r in celled(sizes).where(F.col("__cell") >= least)
                .groupBy("__cell").agg(F.sum(size).alias("bytes")).collect()}

    filled, used = histogram(NO_KEY), KEY_RANGES  # KEY_RANGES rows at most
    while heavy := [c for c, n in filled.items() if n > SHARD_BYTES and c != NO_KEY and bounds(c)[1] > 1]:
        parts = max(2, min(DEEPER_RANGES, MOST_CELLS // len(heavy)))
        found = []
        first = used
        for cell in heavy:
            start, width = bounds(cell)
            found.append((cell, used, Decimal(start), Decimal(-(-width // parts))))
            bases.append(used)
            cuts[used] = (start, -(-width // parts))
            used += parts
            del filled[cell]
        tables.append(spark.createDataFrame(
            found, "__cell long, __base long, __low decimal(20, 0), __step decimal(20, 0)"))
        filled |= histogram(first)  # MOST_CELLS rows at most
    shard, held, pairs, many = 0, 0, [], False
    for cell in sorted(filled, key=lambda c: (c != NO_KEY, c if c == NO_KEY else bounds(c)[0])):
        bytes_ = filled[cell]
        if held and held + bytes_ > SHARD_BYTES:
            shard, held = shard + 1, 0
        own = max(1, -(-bytes_ // SHARD_BYTES))
        pairs.append((cell, shard, own))
        shard, held = shard + own - 1, held + bytes_ if own == 1 else SHARD_BYTES
        many = many or own > 1
    table = spark.createDataFrame(pairs or [(0, 0, 1)], "__cell long, shard long, __own long")
    placed = celled(rows).join(F.broadcast(table), "__cell", "left")
    deal = F.col("shard") + F.pmod(spread, F.col("__own")) if many else F.col("shard")
    return placed.withColumn("shard", F.coalesce(deal, F.lit(0))).drop("__cell", "__own"), shard + 1


class ShardWriter:
    """Files of one task: ``add`` whole files, then take the manifest rows."""

    def __init__(self, folder: str):
        self.store, self.path = place(folder)
        self.rows: list[dict] = []
        self.parts: dict[int, int] = {}
        self.store.create_dir(f"{self.path}/_temporary", recursive=True)

    def add(self, shard: int, suffix: str, data: bytes, records: int, items: int) -> None:
        part = self.parts.get(shard, 0)
        self.parts[shard] = part + 1
        temporary = f"_temporary/{uuid.uuid4().hex}"
        with self.store.open_output_stream(f"{self.path}/{temporary}") as out:
            out.write(data)
        self.rows.append({"shard": shard, "part": part, "name": f"{shard:08d}-{part:06d}{suffix}",
                          "temporary": temporary, "bytes": len(data), "records": records, "items": items})

    def manifest(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(self.rows, schema=MANIFEST)


def write_shards(rows: DataFrame, shards: int, order: list[str],
                 writer: Callable[[Iterator, ShardWriter], None], label: str) -> tuple[str, DataFrame]:
    """Sort the rows of each shard, let ``writer`` turn them into files and commit those."""
    folder = fresh_dir(rows.sparkSession, label)

    def run(batches):
        out = ShardWriter(folder)
        writer(batches, out)
        yield out.manifest()

    # One shard in one partition, not two by the chance of a hash.
    dealt = rows.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", *order)
    manifest = materialize(dealt.mapInArrow(run, MANIFEST_DDL), f"{label}-written")

    def rename(batches):
        store, path = place(folder)
        for batch in batches:
            for row in batch.to_pylist():
                source, target = f"{path}/{row['temporary']}", f"{path}/{row['name']}"
                # A repeated task finds the file renamed already.
                if store.get_file_info(source).type != fs.FileType.NotFound:
                    store.move(source, target)
                elif store.get_file_info(target).type == fs.FileType.NotFound:
                    raise FileNotFoundError(target)
            yield batch

    committed = materialize(manifest.mapInArrow(rename, MANIFEST_DDL), f"{label}-manifest")
    store, path = place(folder)
    if store.get_file_info(f"{path}/_temporary").type != fs.FileType.NotFound:
        store.delete_dir(f"{path}/_temporary")
    return folder, committed


def read_shards(folder: str, manifest: DataFrame, reader: Callable, schema: str,
                keep: tuple[str, ...] = ()) -> DataFrame:
    """``reader(row, file)`` yields record batches for every file of the manifest, opened where it is read."""

    def run(batches):
        store, path = place(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{path}/{row['name']}") as file:
                    yield from reader(row, file)

    files = manifest.select("name", *keep)
    return files.repartition(files.sparkSession.sparkContext.defaultParallelism * 4, "name").mapInArrow(run, schema)
