import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from topicloom.operators import aggregates as agg
from topicloom.operators import joins as j
from topicloom.operators import transforms as tf
from topicloom.session import fits_broadcast

START = datetime(2024, 1, 1)


def events(n=600, seed=2):
    rng = random.Random(seed)
    return [(i, 7 if rng.random() < 0.4 else rng.randrange(9),
             START + timedelta(seconds=rng.randrange(90_000), microseconds=rng.randrange(10**6)),
             float(rng.randrange(100))) for i in range(n)]


SCHEMA = "id long, user long, ts timestamp_ntz, value double"


def test_sessions_match_plain_python(spark):
    rows = events() + [(10_000, 99, START, 1.0), (10_001, 99, START + timedelta(seconds=600), 1.0),
                       (10_002, 99, START + timedelta(seconds=1199, microseconds=999_999), 1.0)]
    got = {(r["user"], r["session_start"], r["last_seen"], r["n"]) for r in agg.sessions(
        spark.createDataFrame(rows, SCHEMA), "ts", 600, ["user"]).collect()}
    want = set()
    for user in {r[1] for r in rows}:
        times = sorted(r[2] for r in rows if r[1] == user)
        run = [times[0]]
        for at in times[1:]:
            if at - run[-1] >= timedelta(seconds=600):
                want.add((user, run[0], run[-1], len(run)))
                run = []
            run.append(at)
        want.add((user, run[0], run[-1], len(run)))
    assert got == want


def test_slide_matches_plain_python(spark):
    rows = events(300)
    out = agg.slide(spark.createDataFrame(rows, SCHEMA), "ts", 900, 300, ["user"], "value")
    want, total = Counter(), Counter()
    for _, user, ts, value in rows:
        base = ts - timedelta(seconds=(ts - START).total_seconds() % 300)
        base = base.replace(microsecond=0)
        for i in range(3):
            want[(user, base - timedelta(seconds=300 * i))] += 1
            total[(user, base - timedelta(seconds=300 * i))] += value
    assert {(r["user"], r["window_start"]): (r["n"], r["total"]) for r in out.collect()} == {
        k: (want[k], total[k]) for k in want}
    with pytest.raises(ValueError):
        agg.slide(spark.createDataFrame(rows, SCHEMA), "ts", 900, 400, ["user"], "value")


def test_interval_join_matches_plain_python(spark):
    rows = events(400)
    left, right = rows[:200], rows[200:]
    a = spark.createDataFrame([(r[0], r[1], r[2]) for r in left], "a long, user long, t timestamp_ntz")
    b = spark.createDataFrame([(r[0], r[1], r[2]) for r in right], "b long, user long, u timestamp_ntz")

    def micros(c):
        return F.unix_micros(F.col(c).cast("timestamp"))

    out = j.interval_join(a, b, ["user"], micros("t"), micros("u"), -600_000_000, 1_800_000_000)
    want = [(x[0], y[0]) for x in left for y in right if x[1] == y[1]
            and timedelta(minutes=-10) <= y[2] - x[2] <= timedelta(minutes=30)]
    assert sorted((r["a"], r["b"]) for r in out.collect()) == sorted(want)


def test_process_history(spark):
    rows = [(1, "f", 30, "B", "later", 3), (1, "f", 10, "C", "first", 1), (1, "f", 10, "A", "tie", 2),
            (2, "f", 5, "Z", "only", 4)]
    df = spark.createDataFrame(rows, "cuid long, f string, ms long, st string, owner string, off long")
    out = agg.process_history(df, "cuid", "f", "ms", "st", ["owner"], "off",
                              sort="process_milliseconds", ascending=False).collect()
    assert [(r["id"], r["owner"], r["status"], r["process_milliseconds"]) for r in out] == [
        ("1f", "first", "A", 20), ("2f", "only", "Z", 0)]


def test_status_rollup_rules(spark):
    tasks = spark.createDataFrame(
        [(1, "RUNNING"), (2, "running"), (3, "PAUSED"), (4, None), (5, "RUNNING"), (6, "RUNNING")],
        "t long, state string")
    parts = spark.createDataFrame(
        [(1, "RUNNING"), (1, "running"), (2, "FAILED"), (2, "RUNNING"), (3, "RUNNING"),
         (4, "RUNNING"), (6, None)], "p long, ps string")
    out = agg.status_rollup(tasks, parts, "t", "state", "p", "ps")
    assert {r["t"]: r["status"] for r in out.collect()} == {
        1: "RUNNING", 2: "RWE", 3: "PAUSED", 4: "NONE", 5: "RUNNING", 6: "RWE"}


def test_statement_status(spark):
    rows = [("running", None), ("Cancelling", None), ("waiting", None), ("available", "OK"),
            ("available", "error"), ("error", None), ("cancelled", None), ("odd", None), (None, None)]
    df = spark.createDataFrame(rows, "s string, o string")
    got = [r[0] for r in df.select(agg.statement_status(F.col("s"), F.col("o"))).collect()]
    assert got == ["RUNNING", "RUNNING", "UNASSIGNED", "FINISHED", "FAILED", "FAILED", "CANCELED",
                   "ODD", "NONE"]


def test_word_count_splits_on_anything_but_ascii_words(spark):
    df = spark.createDataFrame([("Foo, foo_1 -- été\nBAR",), ("",), (None,)], "t string")
    got = {r["word"]: r["frequency"] for r in agg.word_count(df, "t").collect()}
    assert got == {"foo": 1, "foo_1": 1, "t": 1, "bar": 1}


def test_lookup_bound_decides_the_join(spark):
    facts = spark.createDataFrame([(i, i % 5) for i in range(50)], "id long, k long")
    dim = spark.createDataFrame([(k, f"n{k}") for k in range(4)], "kk long, name string")
    assert fits_broadcast(dim) and not fits_broadcast(dim, max_rows=3)
    assert not fits_broadcast(dim, max_bytes=10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small = j.lookup(facts, dim, {"k": "kk"}, ["name"])
        large = j.lookup(facts, dim, {"k": "kk"}, ["name"], max_rows=3)
        plans = [d._jdf.queryExecution().executedPlan().toString() for d in (small, large)]
        assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" in plans[1]
        assert sorted(small.collect()) == sorted(large.collect())
        assert {r["name"] for r in large.where("k = 4").collect()} == {None}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_merge_and_upsert(spark):
    a = spark.createDataFrame([(1, "a", None), (2, "b", 2)], "k long, x string, y long")
    b = spark.createDataFrame([(2, "B", 20, 1.0), (3, "C", 30, 2.0), (1, "A", 10, 3.0)],
                              "k long, x string, y long, z double")
    assert sorted(map(tuple, j.merge_by_key(a, b, ["k"]).collect())) == [
        (1, "a", 10, 3.0), (2, "b", 2, 1.0), (3, "C", 30, 2.0)]
    old = spark.createDataFrame([(1, "one", "RUNNING"), (2, "two", "RUNNING")],
                                "k long, name string, status string")
    new = spark.createDataFrame([(2, "zwei", "LOST"), (3, "drei", "PAUSED")],
                                "k long, name string, status string")
    assert sorted(map(tuple, j.import_upsert(old, new, "k", ["status"]).collect())) == [
        (1, "one", "RUNNING"), (2, "two", "LOST"), (3, "drei", "PAUSED")]


def test_latest_and_earliest(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, 1, "c")], "k long, t long, v string")
    assert {r["v"] for r in j.latest_per_key(df, ["k"], ["t"]).collect()} == {"b", "c"}
    assert {r["v"] for r in j.earliest_per_key(df, ["k"], ["t"]).collect()} == {"a", "c"}


def test_route_first_match_wins_and_null_is_no_match(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 50)], "id long, v long")
    out = tf.route(df, [("big", "v > 10"), ("any", F.col("v") > 0)], default="rest")
    assert {r["id"]: r["route"] for r in out.collect()} == {1: "any", 2: "rest", 3: "big"}


def test_small_transforms(spark):
    df = spark.createDataFrame([(1, "x", None), (2, None, "10"), (3, "y", "9")],
                               "id long, a string, b string")
    assert [r["id"] for r in tf.sort_as_text(df, "b", tiebreak=["id"]).collect()] == [1, 2, 3]
    assert [r["id"] for r in tf.sort_by(df, "b", False, ["id"]).collect()] == [3, 2, 1]
    assert tf.concat_fields(df, "c", ["a", "b"], "-").select("c").collect()[2][0] == "y-9"
    assert df.where(tf.not_equal("a", "x")).count() == 2
    assert df.where(tf.contains_any(["a", "b"], "1")).count() == 1
    assert df.where(tf.contains_any(["a"], ".*")).count() == 0  # literal text, no pattern
    assert tf.search_records(df, None).count() == 3
    assert tf.search_records(df, '"a":"x"', id=1).count() == 1
    assert tf.copy_to(df, ["t1", "t2"]).count() == 6
    assert tf.preview(df, 2, ["id"]).count() == 2
    arrays = spark.createDataFrame([(1, ["p"]), (2, []), (3, None)], "id long, parts array<string>")
    assert [(r["id"], r["part"]) for r in tf.explode_parts(arrays, "parts").collect()] == [
        (1, "p"), (2, "_e"), (3, "_e")]
    assert tf.explode_parts(arrays, "parts", with_placeholder=False).count() == 1


def test_named_programs(spark):
    tf.register_transform("double", lambda df, column: df.withColumn(column, F.col(column) * 2))
    df = spark.createDataFrame([(2,)], "v long")
    assert tf.run_transform("double", df, column="v").first()["v"] == 4
    with pytest.raises(KeyError):
        tf.run_transform("unknown", df)


def test_lineage(spark):
    tasks = spark.createDataFrame(
        [(1, {"topics": "a, ab", "x": "c"}), (2, {"topic_out": "ab"}), (3, {})],
        "id long, config map<string,string>")
    topics = spark.createDataFrame([("a",), ("c",), ("a",)], "topic string")
    keys = ["topics", "topic_in", "topic", "topic_out"]
    found = j.topic_lineage(tasks, "config", keys, topics).select("id", "topic").collect()
    assert [tuple(r) for r in found] == [(1, "a")]
    assert {r["id"] for r in j.tasks_naming(tasks, "config", keys, "a").collect()} == {1, 2}


def test_explode_records_and_null_parts(spark):
    df = spark.createDataFrame(
        [(1, [("a", "RUNNING"), None]), (2, []), (3, None)],
        "id long, parts array<struct<id:string,state:string>>")
    got = [(r["id"], r["part"] and tuple(r["part"]))
           for r in tf.explode_parts(df, "parts", placeholder="task_e").orderBy("id").collect()]
    assert sorted(got, key=str) == sorted(
        [(1, ("a", "RUNNING")), (1, None), (2, ("task_e", None)), (3, ("task_e", None))], key=str)


def test_copies_of_a_key_never_multiply(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (None, "n"), (None, "n")], "k long, v string")
    b = spark.createDataFrame([(1, "p"), (1, "q"), (3, "r")], "k long, w string")
    got = sorted((tuple(r) for r in j.merge_by_key(a, b, ["k"]).collect()), key=str)
    assert got == sorted([(1, "y", "q"), (2, "z", None), (3, None, "r"), (None, "n", None),
                          (None, "n", None)], key=str)
    got = j.import_upsert(a.dropna(), b.withColumnRenamed("w", "v"), "k", ["v"]).collect()
    assert sorted(tuple(r) for r in got) == [(1, "q"), (2, "z"), (3, "r")]
