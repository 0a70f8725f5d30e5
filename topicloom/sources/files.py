"""File, JDBC and document sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from topicloom.sources.topics import FILES_PER_BATCH, Topics


def file_to_topic(topics: Topics, location: str, glob: str, topic: str, schema: T.StructType,
                  checkpoint: str, fmt: str = "json", archive: str | None = None,
                  overwrite: bool = True, trigger: dict | None = None) -> StreamingQuery:
    """Send every file that matches the pattern to a topic, each once.

    ``archive`` moves files away once they are done. With ``overwrite`` a file counts as new by its
    whole path, so an equally named one in another folder is sent as well; without, a name that an
    earlier batch has met is passed over. A file rewritten in place is not sent again: give it a new name.
    """
    reader = (
        topics.spark.readStream.schema(schema).format(fmt).option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", FILES_PER_BATCH)
    )
    if not overwrite:
        reader = reader.option("fileNameOnly", "true")
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return topics.publish(reader.load(location), topic, checkpoint, trigger)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def write_lines(df: DataFrame, path: str, column: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def read_schemaed(spark: SparkSession, path: str, fmt: str = "json",
                  **options: str) -> DataFrame:
    """Files whose schema is found from their content (Parquet and ORC carry their own)."""
    if fmt == "csv":
        options = {"header": "true", "inferSchema": "true"} | options
    return spark.read.format(fmt).options(**options).load(path)


def write_schemaed(df: DataFrame, path: str, fmt: str = "json", **options: str) -> None:
    df.write.mode("overwrite").format(fmt).options(**options).save(path)


def read_csv_text(spark: SparkSession, path: str, columns: Sequence[str],
                  sep: str = ",") -> DataFrame:
    """CSV with named columns, all text."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("sep", sep).csv(path)


def write_csv(df: DataFrame, path: str, sep: str = "|") -> None:
    df.write.mode("overwrite").option("sep", sep).csv(path)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], fmt: str = "parquet") -> None:
    """Warehouse-style sink: one folder per value, so readers prune."""
    df.write.mode("overwrite").partitionBy(*by).format(fmt).save(path)


def read_documents(spark: SparkSession, path: str, schema: T.StructType | None = None,
                   fmt: str = "json", **options: str) -> DataFrame:
    """A document collection: JSON lines, or any connector format given by name."""
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write_documents(df: DataFrame, path: str, fmt: str = "json", **options: str) -> None:
    df.write.mode("append").format(fmt).options(**options).save(path)


def flatten_log(df: DataFrame) -> DataFrame:
    """Log documents keep id, time and class one level down."""
    plain = [c for c in df.columns if c not in ("_id", "timestamp", "class")]
    return df.select(F.col("_id.`$oid`").alias("id"), F.col("timestamp.`$date`").alias("timestamp"),
                     F.col("class.className").alias("class_name"), *plain)


def jdbc_options(url: str, table: str, partition_column: str | None = None,
                 lower: object = None, upper: object = None, partitions: int = 8,
                 fetch_size: int = 10_000) -> dict[str, str]:
    """Options of a JDBC read; a partition column splits it over parallel range queries."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size)}
    if partition_column:
        options |= {"partitionColumn": partition_column, "lowerBound": str(lower),
                    "upperBound": str(upper), "numPartitions": str(partitions)}
    return options


def read_jdbc(spark: SparkSession, **settings: object) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(**settings)).load()


def write_jdbc(df: DataFrame, url: str, table: str, batch_size: int = 10_000) -> None:
    (df.write.mode("append").format("jdbc")
     .options(url=url, dbtable=table, batchsize=str(batch_size)).save())


def read_libsvm(spark: SparkSession, path: str, features: int | None = None) -> DataFrame:
    reader = spark.read.format("libsvm")
    return (reader.option("numFeatures", features) if features else reader).load(path)


def file_progress(spark: SparkSession, path: str) -> DataFrame:
    """Files per stage of a hand-over folder, and whether the hand-over is done.

    Only names are read, never file content. Empty files hand over nothing and do not count.
    """
    names = spark.read.format("binaryFile").load(path).select("path")
    kind = F.element_at(F.split("path", r"\."), -1)
    counted = names.agg(*[
        F.count(F.when(kind == k, 1)).alias(k) for k in ("json", "processing", "processed")])
    done = (F.col("json") == 0) & (F.col("processing") == 0)
    return counted.withColumn("done", done)
