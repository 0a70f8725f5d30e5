"""Framed topic records: one zero byte, a four-byte schema id, then the body.

Bodies are JSON by default. With the spark-avro package on the class path ``codec="avro"`` uses
Spark's own ``from_avro``/``to_avro``. An unframed record whose first byte happens to be zero cannot
be told from a framed one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.functions.types import avro_to_struct, wire_avro

CORRUPT = "_corrupt_record"
NO_RECORD = "{"  # no JSON, so it is treated like any other corrupt body


def frame_parts(value: Column) -> dict[str, Column]:
    framed = F.substring(value, 1, 1) == F.unhex(F.lit("00"))
    number = F.conv(F.hex(F.substring(value, 2, 4)), 16, 10).cast("long")
    return {
        "framed": framed,
        "schema_id": F.when(framed & (F.octet_length(value) >= 5), number),
        "body": F.when(framed, F.substring(value, 6, 2**31 - 1)).otherwise(value),
    }


def split_frame(df: DataFrame, value: str = "value") -> DataFrame:
    return df.withColumns(frame_parts(F.col(value)))


def _from_avro(body: Column, schema_json: str) -> Column:
    from pyspark.sql.avro.functions import from_avro

    return from_avro(body, schema_json)


def decode_framed(df: DataFrame, schema: T.StructType | str, value: str = "value",
                  codec: str = "json", on_missing: str = "null",
                  on_corrupt: str = "fail") -> DataFrame:
    """Replace the framed column by ``framed``, ``schema_id`` and the record's fields.

    ``schema`` is a Spark struct or Avro JSON. ``on_missing``: a field absent from the body reads as
    null or fails the job. ``on_corrupt``: ``fail`` the job, or ``quarantine`` the text in an extra
    column (see ``quarantine_split``).
    """
    struct = avro_to_struct(schema) if isinstance(schema, str) else schema
    parts = split_frame(df, value).drop(value)
    if codec == "avro":
        if on_missing != "null" or on_corrupt != "fail":
            raise ValueError("Avro bodies know on_missing='null' and on_corrupt='fail' only")
        avro = schema if isinstance(schema, str) else wire_avro(schema)
        return parts.withColumn("__r", _from_avro(F.col("body"), avro)).select(
            *[c for c in parts.columns if c != "body"], "__r.*")

    # An empty body, or a frame cut off in its head, holds no record.
    whole = F.when(~F.col("framed") | F.col("schema_id").isNotNull(), F.col("body"))
    text = F.coalesce(F.nullif(F.trim(whole.cast("string")), F.lit("")), F.lit(NO_RECORD))
    # Fields stay optional here; whether absence is an error is decided by `on_missing`.
    target = T.StructType([T.StructField(f.name, f.dataType, True) for f in struct.fields])
    mode = "FAILFAST"
    if on_corrupt == "quarantine":
        target, mode = target.add(CORRUPT, T.StringType()), "PERMISSIVE"
    record = F.from_json(text, target, {"mode": mode, "columnNameOfCorruptRecord": CORRUPT})
    if on_missing == "fail":
        present = F.from_json(text, "map<string,string>")
        complete = F.lit(True)
        for f in struct.fields:
            complete = complete & F.map_contains_key(present, f.name)
        # A failed check raises; a passed one is null and leaves the record as it is.
        check = F.assert_true(complete, "a record lacks a field of its schema")
        record = F.when(check.isNull(), record)
    return parts.withColumn("__r", record).select(
        *[c for c in parts.columns if c != "body"], "__r.*")


def quarantine_split(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and the corrupt ones of a ``quarantine`` decode."""
    good = decoded.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return good, decoded.where(F.col(CORRUPT).isNotNull())


def encode_framed(df: DataFrame, schema_id: int | Column, columns: list[str] | None = None,
                  codec: str = "json", value: str = "value") -> DataFrame:
    """Add the framed record of the given columns (default: all) as a binary column."""
    names = columns or df.columns
    number = F.lit(schema_id) if isinstance(schema_id, int) else schema_id
    head = F.unhex(F.lpad(F.hex(number.cast("long")), 8, "0"))
    if codec == "avro":
        from pyspark.sql.avro.functions import to_avro

        # The schema a reader is given, see ``decode_framed``.
        body = to_avro(F.struct(*names), wire_avro(df.select(*names).schema))
    else:
        body = F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).cast("binary")
    return df.withColumn(value, F.concat(F.unhex(F.lit("00")), head, body))
