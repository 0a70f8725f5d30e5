"""Session settings, shared working folders and size checks."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every query relies on; all can be changed on a running session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs the parent operator one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Streaming state lives off-heap and is checkpointed as change logs.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # One state store per join partition instead of four.
    "spark.sql.streaming.join.stateFormatVersion": "3",
}

PARTITIONS = "spark.sql.shuffle.partitions"

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
MEASURE_FACTOR = 16
UNKNOWN_SIZE = 2**63 - 1  # what Spark plans with where it knows nothing
MARK_BITS = 24  # of the keys of a table that is too large for a broadcast

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "topicloom", cores: int | str = "*", **conf: str) -> SparkSession:
    """Local session for tests and the bench; on a cluster use the session you are given."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", os.environ.get("TOPICLOOM_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    context = spark.sparkContext
    if context.master.startswith("local") and spark.conf.get(PARTITIONS) == "200":
        # The default is far too many for one machine; a cluster keeps what it was given.
        spark.conf.set(PARTITIONS, str(context.defaultParallelism))
    return spark


def workspace(spark: SparkSession) -> str:
    """Shared folder for topics, stream checkpoints and written tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session without that setting
    gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="topicloom-"))
    return spark.sparkContext.getCheckpointDir()


_made: dict[str, list[str]] = {}


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder; nothing is created yet."""
    path = f"{workspace(spark)}/topicloom/{label}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def discard_fresh_dirs(spark: SparkSession) -> None:
    """Delete the folders this application made, once nothing reads them any more."""
    for path in _made.pop(spark.sparkContext.applicationId, []):
        remove_path(spark, path)


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Cut lineage by writing a table into the shared folder and reading it back."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def released_shuffles(spark: SparkSession):
    """Shuffle files of each query that runs in here go when it ends, not when the driver happens to collect
    garbage. For steps that are written and read again: a table that was computed in here is computed anew if
    it is asked once more."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def path_exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath)


def remove_path(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder, none if there is no such folder."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(jpath)] if files.exists(jpath) else []


def numbered(spark: SparkSession, path: str, prefix: str, suffix: str = "") -> list[int]:
    """Numbers of the entries ``<prefix><number><suffix>`` of a folder, in order."""
    inner = [n[len(prefix):len(n) - len(suffix)] for n in child_names(spark, path)
             if n.startswith(prefix) and n.endswith(suffix)]
    return sorted(int(n) for n in inner if n.isdigit())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file in one step: readers see the old text or the new one."""
    fs = spark._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target, made = fs.Path(path), fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = made.getFileSystem(conf).create(made, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    how = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    how[0] = getattr(fs, "Options$Rename").OVERWRITE
    fs.FileContext.getFileContext(made.getFileSystem(conf).getUri(), conf).rename(made, target, how)


def read_text(spark: SparkSession, path: str) -> str | None:
    """Text of a small file, None if there is none."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(jpath):
        return None
    stream = files.open(jpath)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS,
                   max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure a table before broadcasting it.

    A table whose planned size is far beyond the bound is not read at all; any other one is counted
    and its rows are sized where they are, so a wrong estimate cannot lead to a large broadcast.
    """
    planned = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if MEASURE_FACTOR * max_bytes < planned < UNKNOWN_SIZE:
        return False
    size = F.length(F.to_json(F.struct(*df.columns)))
    seen = df.agg(F.count("*").alias("rows"), F.sum(size).alias("bytes")).first()
    return seen["rows"] <= max_rows and (seen["bytes"] or 0) <= max_bytes


def maybe_broadcast(df: DataFrame, **limits: int) -> DataFrame:
    """Hint a broadcast when the table is proven small; otherwise leave a shuffle join to AQE."""
    return F.broadcast(df) if fits_broadcast(df, **limits) else df


def _marked(df: DataFrame, keys: DataFrame, column: str, how: str) -> DataFrame:
    """``df`` with ``__mark``: false only in rows whose value is none of ``keys``.

    One of 2 ** MARK_BITS bits per key is broadcast, however many keys there are.
    """
    kind = keys.schema[column].dataType
    hashed = F.xxhash64(F.col(column).cast(kind))
    word = F.shiftrightunsigned(hashed, 64 - (MARK_BITS - 6))
    place = hashed.bitwiseAND(F.lit(63)).cast("int")
    bits = (keys.select(word.alias("__word"), place.alias("__place")).groupBy("__word")
            .agg(F.expr("bit_or(shiftleft(1L, __place))").alias("__bits")))
    return (df.withColumns({"__word": word, "__place": place}).join(F.broadcast(bits), "__word", how)
            .withColumn("__mark", F.coalesce(F.expr("getbit(__bits, __place) = 1"), F.lit(False)))
            .drop("__word", "__place", "__bits"))


def rows_among(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is one of ``keys``. Only rows that may be are shuffled."""
    if fits_broadcast(keys):
        return df.join(F.broadcast(keys), column, "left_semi")
    return _marked(df, keys, column, "inner").filter("__mark").drop("__mark").join(keys, column, "left_semi")


def rows_not_among(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is none of ``keys``. Only rows that may be are shuffled."""
    if fits_broadcast(keys):
        return df.join(F.broadcast(keys), column, "left_anti")
    marked = _marked(df, keys, column, "left")
    near = marked.filter("__mark").drop("__mark").join(keys, column, "left_anti")
    return marked.filter("NOT __mark").drop("__mark").unionByName(near)
