"""Type tables between Avro record schemas and Spark schemas.

Three tables exist on purpose: reading a topic, publishing a continuous query and publishing a
batch result each map types in their own way.
"""

from __future__ import annotations

import json

from pyspark.sql import types as T

# Avro type -> column type when a topic is read. Any other type reads as text.
AVRO_TO_COLUMN = {
    "boolean": T.BooleanType(),
    "string": T.StringType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "bytes": T.BinaryType(),
}

# Column type -> Avro type when a continuous query is published. Any other column
# type keeps its own name.
RESULT_TO_AVRO = {
    "integer": "int", "short": "int", "byte": "bytes",
    "timestamp": "string", "timestamp_ntz": "string", "date": "string", "decimal": "string",
    "interval": "string", "array": "string", "map": "string", "struct": "string",
    "binary": "bytes", "void": "null", "variant": "string", "char": "string", "varchar": "string",
}

# Column type -> Avro type when a batch result is written back. Any other column
# type becomes text, bigint included.
WRITEBACK_TO_AVRO = {
    "void": "null", "byte": "bytes", "boolean": "boolean", "integer": "int", "double": "double",
    "date": "string", "timestamp": "string", "string": "string", "varchar": "string",
    "char": "string", "float": "float", "decimal": "float",
}


def record_fields(schema_json: str) -> list[dict]:
    schema = json.loads(schema_json)
    is_record = isinstance(schema, dict) and schema.get("type") == "record"
    return schema["fields"] if is_record else []


def field_names(schema_json: str) -> list[str]:
    """Field names of a record schema; empty for any other schema."""
    return [field["name"] for field in record_fields(schema_json)]


def avro_to_struct(schema_json: str) -> T.StructType:
    struct = T.StructType()
    for field in record_fields(schema_json):
        kind, nullable = field["type"], False
        if isinstance(kind, list):
            nullable = "null" in kind
            branches = [k for k in kind if k != "null"]
            kind = branches[0] if len(branches) == 1 else "union"
        column = AVRO_TO_COLUMN.get(kind) if isinstance(kind, str) else None
        struct.add(field["name"], column or T.StringType(), nullable)
    return struct


def _family(kind: T.DataType) -> str:
    if isinstance(kind, T.DayTimeIntervalType | T.YearMonthIntervalType):
        return "interval"
    return kind.typeName()


def struct_to_avro(schema: T.StructType, name: str, dialect: str = "result") -> str:
    """Avro record schema (JSON text) of a result; ``dialect`` is ``result`` or ``writeback``."""
    def avro_type(kind: T.DataType) -> str:
        family = _family(kind)
        if dialect == "writeback":
            return WRITEBACK_TO_AVRO.get(family, "string")
        return RESULT_TO_AVRO.get(family, family)

    fields = [{"name": f.name, "type": avro_type(f.dataType)} for f in schema.fields]
    return json.dumps({"type": "record", "name": name, "fields": fields},
                      separators=(",", ":"))


# Column type -> Avro type of a record body that is written and read by the same schema.
WIRE = {
    "boolean": "boolean", "byte": "int", "short": "int", "integer": "int", "long": "long", "float": "float",
    "double": "double", "string": "string", "char": "string", "varchar": "string", "binary": "bytes",
    "date": {"type": "int", "logicalType": "date"},
    "timestamp": {"type": "long", "logicalType": "timestamp-micros"},
    "timestamp_ntz": {"type": "long", "logicalType": "local-timestamp-micros"},
}


def wire_avro(schema: T.StructType, name: str = "record") -> str:
    """One Avro schema (JSON text) for the writer and the reader of a record body; nullable columns are unions."""
    def field_type(kind: T.DataType, at: str) -> object:
        if isinstance(kind, T.DecimalType):
            return {"type": "bytes", "logicalType": "decimal", "precision": kind.precision, "scale": kind.scale}
        if isinstance(kind, T.ArrayType):
            return {"type": "array", "items": optional(kind.elementType, kind.containsNull, at)}
        if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
            return {"type": "map", "values": optional(kind.valueType, kind.valueContainsNull, at)}
        if isinstance(kind, T.StructType):
            return {"type": "record", "name": at, "fields": fields(kind, at)}
        if kind.typeName() not in WIRE:
            raise ValueError(f"{at}: no Avro type for {kind.simpleString()}")
        return WIRE[kind.typeName()]

    def optional(kind: T.DataType, nullable: bool, at: str) -> object:
        return ["null", field_type(kind, at)] if nullable else field_type(kind, at)

    def fields(struct: T.StructType, at: str) -> list[dict]:
        return [{"name": f.name, "type": optional(f.dataType, f.nullable, f"{at}_{f.name}")} for f in struct.fields]

    return json.dumps({"type": "record", "name": name, "fields": fields(schema, name)}, separators=(",", ":"))
