"""Topics: named, append-only tables that can be read as a whole or as a stream.

The ``files`` backend keeps each topic as a Parquet folder under a shared root. The ``kafka``
backend is used when its connector is on the class path.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamReader, StreamingQuery

from topicloom.session import fresh_dir, remove_path

FILES_PER_BATCH = 1000
# A job goes through the input there is and ends, unless it is started with a trigger of its own.
ONCE_THROUGH = {"availableNow": True}
PREVIEW_ROWS = 10  # fixed value: records shown when a topic is previewed


class Topics:
    """Topics below one root folder."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or fresh_dir(spark, "topics")

    def path(self, topic: str) -> str:
        return f"{self.root}/{topic}"

    def append(self, df: DataFrame, topic: str) -> str:
        df.write.mode("append").parquet(self.path(topic))
        return self.path(topic)

    def append_routed(self, df: DataFrame, group: str, route: str = "route") -> None:
        """Write each row to the topic its ``route`` column names: one scan, one write."""
        df.write.mode("append").partitionBy(route).parquet(self.path(group))

    def publish_routed(self, stream: DataFrame, group: str, checkpoint: str,
                       route: str = "route", trigger: dict | None = None) -> StreamingQuery:
        return (
            stream.writeStream.format("parquet").outputMode("append").partitionBy(route)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or ONCE_THROUGH))
            .start(self.path(group))
        )

    def routed(self, group: str, topic: str, route: str = "route") -> DataFrame:
        """One topic of a routed group; other topics' files are not opened."""
        return self.read(group).where(F.col(route) == topic).drop(route)

    def read(self, topic: str, schema: T.StructType | None = None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(self.path(topic))

    def stream(self, topic: str, schema: T.StructType | None = None,
               files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
        schema = schema or self.read(topic).schema
        return stream_files(self.spark, self.path(topic), schema, files_per_batch)

    def register(self, topics: str, streaming: bool = False) -> list[str]:
        """Each topic of a comma list becomes a view of the same name."""
        names = [t.strip() for t in topics.split(",") if t.strip()]
        for name in names:
            (self.stream(name) if streaming else self.read(name)).createOrReplaceTempView(name)
        return names

    def drop(self, topic: str) -> None:
        remove_path(self.spark, self.path(topic))

    def publish(self, stream: DataFrame, topic: str, checkpoint: str,
                trigger: dict | None = None) -> StreamingQuery:
        """Append a stream to a topic; without a trigger until the input seen at start is used up,
        with one such as ``{"processingTime": "10 seconds"}`` until it is stopped."""
        return (
            stream.writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(**(trigger or ONCE_THROUGH))
            .start(self.path(topic))
        )


def stream_files(spark: SparkSession, path: str, schema: T.StructType,
                 files_per_batch: int = FILES_PER_BATCH, fmt: str = "parquet",
                 **options: str) -> DataFrame:
    """A folder of files, or one file, as a stream."""
    # A glob lets the source accept a single file where a folder is usual.
    pattern = path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"
    return (
        spark.readStream.schema(schema).format(fmt).options(**options)
        .option("maxFilesPerTrigger", files_per_batch).load(pattern)
    )


def with_processing_time(df: DataFrame, name: str = "proctime") -> DataFrame:
    return df.withColumn(name, F.current_timestamp())


def with_event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need a zoned timestamp; the session zone is UTC."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def register_views(frames: dict[str, DataFrame]) -> None:
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def replay_since(df: DataFrame, ts: str, back: timedelta) -> DataFrame:
    """Rows of the last stretch before the newest record; the bound reaches the file scan."""
    newest = df.agg(F.max(ts) - F.lit(back)).scalar()
    return df.where(F.col(ts) >= newest)


def topic_preview(df: DataFrame, offset: str, n: int = PREVIEW_ROWS) -> DataFrame:
    """The first records of a topic with their offset and JSON value."""
    value = F.to_json(F.struct(*df.columns))
    return df.orderBy(offset).limit(n).select(F.col(offset).alias("id"), value.alias("value"))


def partition_summary(df: DataFrame, partition: Column, offset: str) -> DataFrame:
    return df.groupBy(partition.alias("partition")).agg(
        F.count("*").alias("records"), F.min(offset).alias("first_offset"),
        F.max(offset).alias("last_offset"))


def message(df: DataFrame, keys: Sequence[str] = (), value: Column | None = None) -> DataFrame:
    """Key and value of each message; the key is the JSON of the key fields."""
    key = F.to_json(F.struct(*keys)).cast("binary") if keys else F.lit(None).cast("binary")
    body = F.to_json(F.struct(*df.columns)).cast("binary") if value is None else value
    return df.select(key.alias("key"), body.alias("value"))


def kafka_options(servers: str, topics: str, start: str = "earliest",
                  since: timedelta | None = None, now_ms: int | None = None) -> dict[str, str]:
    """Source options: from the earliest record, or from a point in time."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topics}
    if since is None:
        return options | {"startingOffsets": start}
    return options | {"startingTimestamp": str(now_ms - int(since.total_seconds() * 1000))}


def kafka_writer(stream: DataFrame, servers: str, topic: str, checkpoint: str,
                 mode: str = "append", trigger: dict | None = None) -> StreamingQuery:
    """Send key and value columns (see ``message``) to a Kafka topic, once through or with a trigger of its own."""
    return (
        stream.writeStream.format("kafka").outputMode(mode)
        .options(**{"kafka.bootstrap.servers": servers, "topic": topic,
                    "checkpointLocation": checkpoint}).trigger(**(trigger or ONCE_THROUGH)).start()
    )


def kafka_reader(spark: SparkSession, options: dict[str, str],
                 streaming: bool = True) -> DataFrame:
    reader: DataStreamReader = spark.readStream if streaming else spark.read
    try:
        return reader.format("kafka").options(**options).load()
    except Exception as error:
        if "kafka" in str(error).lower():
            raise RuntimeError("the Kafka connector is not on the class path; use the files "
                               "backend or add spark-sql-kafka") from error
        raise
