import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.functions import scalars as sc
from topicloom.functions import types as ty
from topicloom.functions.udfs import register_scalar, register_words
from topicloom.operators import operations as ops
from topicloom.operators.scripts import (
    run_script,
    run_script_with_writeback,
    run_stream_sql,
    split_script,
)
from topicloom.sources import frames

AVRO = json.dumps({"type": "record", "name": "r", "fields": [
    {"name": "a", "type": "long"}, {"name": "b", "type": ["null", "string"]}]})


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**31 - 1), st.binary(max_size=20)), min_size=1,
                max_size=20))
def test_frame_header_roundtrip(spark, records):
    wire = [(bytes([0]) + number.to_bytes(4, "big") + body,) for number, body in records]
    df = spark.createDataFrame(wire, "value binary")
    got = [(r["framed"], r["schema_id"], bytes(r["body"])) for r in frames.split_frame(df).collect()]
    assert got == [(True, number, body) for number, body in records]


def test_unframed_and_short_records(spark):
    df = spark.createDataFrame([(b'{"a":1}',), (b"\0\0",)], "value binary")
    rows = frames.split_frame(df).collect()
    assert (rows[0]["framed"], rows[0]["schema_id"], bytes(rows[0]["body"])) == (
        False, None, b'{"a":1}')
    assert rows[1]["framed"] and rows[1]["schema_id"] is None


def test_encode_decode(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a long, b string")
    wire = frames.encode_framed(df, 2**31 - 1).select("value")
    back = frames.decode_framed(wire, AVRO).collect()
    assert [(r["schema_id"], r["a"], r["b"]) for r in back] == [
        (2**31 - 1, 1, "x"), (2**31 - 1, 2, None)]


def test_missing_field_policies(spark):
    null_value = spark.createDataFrame([(b'{"a":1,"b":null}',)], "value binary")
    absent = spark.createDataFrame([(b'{"a":1}',)], "value binary")
    assert frames.decode_framed(absent, AVRO).first()["b"] is None
    assert frames.decode_framed(null_value, AVRO, on_missing="fail").first()["a"] == 1
    with pytest.raises(Exception, match="lacks a field"):
        frames.decode_framed(absent, AVRO, on_missing="fail").collect()


def test_corrupt_record_policies(spark):
    df = spark.createDataFrame([(b'{"a":1}',), (b'{"a":',)], "value binary")
    with pytest.raises(Exception):
        frames.decode_framed(df, AVRO).collect()
    good, bad = frames.quarantine_split(frames.decode_framed(df, AVRO, on_corrupt="quarantine"))
    assert [r["a"] for r in good.collect()] == [1]
    assert [r[frames.CORRUPT] for r in bad.collect()] == ['{"a":']


def test_avro_to_struct():
    fields = [{"name": "b", "type": "boolean"}, {"name": "i", "type": "int"},
              {"name": "y", "type": "bytes"}, {"name": "d", "type": "double"},
              {"name": "f", "type": "float"}, {"name": "u", "type": ["null", "long"]},
              {"name": "m", "type": {"type": "map", "values": "int"}},
              {"name": "w", "type": ["int", "string"]}]
    struct = ty.avro_to_struct(json.dumps({"type": "record", "name": "r", "fields": fields}))
    assert struct.simpleString() == (
        "struct<b:boolean,i:int,y:binary,d:double,f:float,u:bigint,m:string,w:string>")
    assert struct["u"].nullable and not struct["i"].nullable
    assert ty.field_names('"string"') == [] and ty.field_names(AVRO) == ["a", "b"]


def test_struct_to_avro_tables(spark):
    schema = T.StructType.fromDDL(
        "i int, s smallint, t tinyint, l bigint, f float, d double, b boolean, x string, "
        "at timestamp, day date, n decimal(10,2), a array<int>, m map<string,int>")

    def kinds(dialect):
        return {f["name"]: f["type"] for f in json.loads(
            ty.struct_to_avro(schema, "r", dialect))["fields"]}

    assert kinds("result") == {
        "i": "int", "s": "int", "t": "bytes", "l": "long", "f": "float", "d": "double",
        "b": "boolean", "x": "string", "at": "string", "day": "string", "n": "string",
        "a": "string", "m": "string"}
    assert kinds("writeback") == {
        "i": "int", "s": "string", "t": "bytes", "l": "string", "f": "float", "d": "double",
        "b": "boolean", "x": "string", "at": "string", "day": "string", "n": "float",
        "a": "string", "m": "string"}


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v"))).first()[0]


def test_config_text_functions(spark):
    assert one(spark, "", sc.unescape_json) == "[]"
    assert one(spark, r'{"a":"{\"b\":1}"}', sc.unescape_json) == '{"a":{"b":1}}'
    assert one(spark, '{"name":"","b":["",""]}', sc.unescape_json) == '{"name":"","b":["",""]}'
    assert one(spark, '{"schema":"\\"string\\""}', sc.unescape_json) == '{"schema":"string"}'
    assert one(spark, '{"a": /* x */1}/* keep */', sc.strip_comments) == '{"a":1}/* keep */'
    config = {"topics": '["a","b"]', "topic_in": "c", "other": '["x"]'}
    assert one(spark, config, sc.topics_to_string, "map<string,string>") == {
        "topics": "a,b", "topic_in": "c", "other": '["x"]'}
    renamed = one(spark, {"a.b_c": "1"}, sc.dots_to_underscores, "map<string,string>")
    assert renamed == {"a_b_c": "1"}
    assert one(spark, renamed, sc.underscores_to_dots, "map<string,string>") == {"a.b.c": "1"}


@pytest.mark.parametrize("text,want", [
    ('{"c":{"x":1}}', {"c": '{"x":1}'}),
    ('{"c":{"off":1},"c_1":{"x":2}}', {"c": '{"x":2}'}),
    ('{"c":{"x":0},"c_1":{"off":1},"c_2":{"x":2},"n":"v"}', {"c": '{"x":2}', "n": "v"}),
    ('{"c":{"x":0},"c_1":{"x":1},"c_2":{"x":2}}', {"c": '{"x":2}', "c_1": '{"x":1}'}),
    ('{"c":{"x":0},"c_2":{"off":2}}', {"c": '{"x":0}', "c_2": '{"off":2}'}),
    ('{"c_1":{"x":1}}', {"c_1": '{"x":1}'}),
    ('{"c":{"off":1}}', {}),
])
def test_active_variant(spark, text, want):
    df = spark.createDataFrame([(text,)], "v string")
    assert sc.with_active_variant(df, "v", "c", "off", "out").first()["out"] == want


def test_script_splitting():
    assert split_script("select 1; -- x; y\nselect '--a;@b' /* ; */ ;\n ;") == [
        "select 1", "select '--a;@b'"]
    assert split_script('select "a;b", `c;d`') == ['select "a;b", `c;d`']
    assert split_script("select /*+ BROADCAST(t) */ 'it''s;' from t") == [
        "select /*+ BROADCAST(t) */ 'it''s;' from t"]
    assert split_script(" -- nothing\n;") == []


def test_scripts_run(spark):
    out = run_script(spark, "create or replace temp view v as select 'a@b' as x;\n"
                            'select x as "y" from v;\n'.replace('"y"', "y"))
    assert out.first()["y"] == "a@b"
    with pytest.raises(ValueError):
        run_script(spark, "-- only a comment")
    with pytest.raises(ValueError):
        run_stream_sql(spark, "select 1; select 2")
    written, head, path = run_script_with_writeback(
        spark, "select id, cast(id as string) as s from range(50)", preview=7)
    assert (written.count(), head.count()) == (50, 7)
    assert "json" in written.inputFiles()[0]


def test_script_over_catalog_tables(spark):
    out = run_script(spark, "create table if not exists kept using parquet as select 1 as id; "
                            "insert into kept select 2; select count(*) as n from kept")
    assert out.first()["n"] == 2
    spark.sql("drop table kept")


def test_user_functions(spark):
    register_words(spark)
    rows = spark.sql("SELECT word, frequency FROM split_words('Ab, c-ab')").collect()
    assert [tuple(r) for r in rows] == [("ab", 1), ("c", 1), ("ab", 1)]
    register_scalar(spark, "plus", lambda a, b: a + b, "long")
    assert spark.sql("SELECT plus(id, id) AS s FROM range(3)").collect()[2]["s"] == 4


def test_config_changes_ignore_key_order(spark):
    old = spark.createDataFrame([(1, {"a": "1", "b": "2"}), (2, {"a": "1"})],
                                "id long, c map<string,string>")
    new = spark.createDataFrame([(1, {"b": "2", "a": "1"}), (2, {"a": "9"})],
                                "id long, c map<string,string>")
    assert [r["id"] for r in ops.config_changes(old, new, "id", "c").collect()] == [2]


def test_guarded_change(spark):
    rows = [("RUNNING", "FAILED", "x", "X"), ("RUNNING", "FAILED", "x", "y"),
            ("RUNNING", "UNASSIGNED", "x", "x"), ("RUNNING", None, "x", "x")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    got = [r[0] for r in df.select(ops.guarded_change(*[F.col(c) for c in "abcd"])).collect()]
    assert got == [True, False, True, True]


def test_records_cut_short_are_corrupt(spark):
    whole = bytes(5) + b'{"a":1}'
    rows = [(whole,), (b"",), (b"\x00\x01",), (bytes(5),), (b"  ",), (b'{"a":2}',)]
    df = spark.createDataFrame(rows, "value binary")
    decoded = frames.decode_framed(df, T.StructType([T.StructField("a", T.LongType())]),
                                   on_corrupt="quarantine")
    good, bad = frames.quarantine_split(decoded.cache())
    assert sorted(r["a"] for r in good.collect()) == [1, 2] and bad.count() == 4
    for value in (b"", b"\x00\x01", bytes(5)):
        one_bad = spark.createDataFrame([(value,)], "value binary")
        with pytest.raises(Exception, match="(?i)malformed"):
            frames.decode_framed(one_bad, T.StructType([T.StructField("a", T.LongType())])).collect()


def test_avro_refuses_options_that_do_not_apply(spark):
    df = spark.createDataFrame([(bytes(6),)], "value binary")
    for options in ({"on_missing": "fail"}, {"on_corrupt": "quarantine"}):
        with pytest.raises(ValueError):
            frames.decode_framed(df, T.StructType([]), codec="avro", **options)


def test_one_avro_schema_for_writer_and_reader(spark):
    schema = T.StructType.fromDDL("a int NOT NULL, b string, c array<double>, d map<string,long>, e decimal(9,2), "
                                  "f struct<x: timestamp_ntz, y: date>, g tinyint NOT NULL")
    fields = {f["name"]: f["type"] for f in json.loads(ty.wire_avro(schema, "r"))["fields"]}
    assert fields["a"] == "int" and fields["b"] == ["null", "string"] and fields["g"] == "int"
    assert fields["c"] == ["null", {"type": "array", "items": ["null", "double"]}]
    assert fields["d"] == ["null", {"type": "map", "values": ["null", "long"]}]
    assert fields["e"][1] == {"type": "bytes", "logicalType": "decimal", "precision": 9, "scale": 2}
    inner = fields["f"][1]
    assert inner["name"] == "r_f" and [f["type"][1]["logicalType"] for f in inner["fields"]] == [
        "local-timestamp-micros", "date"]
    with pytest.raises(ValueError, match="no Avro type"):
        ty.wire_avro(T.StructType.fromDDL("v variant"))


def test_types_without_an_avro_name_of_their_own():
    schema = T.StructType([T.StructField("n", T.NullType()), T.StructField("v", T.VariantType())])
    kinds = [f["type"] for f in json.loads(ty.struct_to_avro(schema, "r"))["fields"]]
    assert kinds == ["null", "string"]
