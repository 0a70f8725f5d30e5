import os
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from topicloom.operators.aggregates import tumble
from topicloom.operators.models import Models, naive_bayes_pipeline
from topicloom.operators.ordered import hot_keys
from topicloom.session import fresh_dir, materialize, workspace
from topicloom.sources import files
from topicloom.sources import topics as tp
from topicloom.streaming import operators as st
from topicloom.streaming import runs
from topicloom.streaming.stream_back import StreamBack

START = datetime(2024, 1, 1)
SCHEMA = "id long, user long, ts timestamp, kind string, value long"


def rows(n=240, seed=4):
    rng = random.Random(seed)
    return [(i, 7 if rng.random() < 0.4 else rng.randrange(6), START + timedelta(minutes=i),
             rng.choice(["click", "buy"]), rng.randrange(10)) for i in range(n)]


def topic_in_pieces(spark, data, pieces):
    """A topic whose files arrive in the order of the data."""
    topics = tp.Topics(spark)
    path = topics.path("t")
    size = -(-len(data) // pieces)
    seen = set()
    for i in range(pieces):
        spark.createDataFrame(data[i * size:(i + 1) * size], SCHEMA).coalesce(1).write.mode(
            "append").parquet(path)
        for name in sorted(os.listdir(path)):
            if name.endswith(".parquet") and name not in seen:
                seen.add(name)
                stamp = time.time() - 10_000 + i * 100
                os.utime(f"{path}/{name}", (stamp, stamp))
    return topics


def test_shared_folder_comes_from_the_session(spark):
    assert workspace(spark) == spark.conf.get("spark.checkpoint.dir")
    assert fresh_dir(spark, "x") != fresh_dir(spark, "x")
    assert materialize(spark.range(5)).count() == 5


@pytest.mark.parametrize("pieces", [1, 4])
def test_window_sums_equal_batch(spark, pieces):
    topics = topic_in_pieces(spark, rows(), pieces)

    def sums(df):
        return tumble(df, "ts", "1 hour", ["kind"], n=F.count("*"), v=F.sum("value"))

    out = sums(topics.stream("t", files_per_batch=1).withWatermark("ts", "1 hour"))
    path = fresh_dir(spark, "out")
    runs.drain(runs.write_batches(out, path, fresh_dir(spark, "cp"), "update"))
    latest = runs.read_latest(spark, path, out.schema, ["window_start", "kind"])
    assert sorted(latest.collect()) == sorted(sums(topics.read("t")).collect())


def test_restart_resumes_from_the_checkpoint(spark):
    data = rows()
    topics = topic_in_pieces(spark, data[:120], 2)
    path = fresh_dir(spark, "out")
    checkpoint = runs.checkpoint_for(fresh_dir(spark, "jobs"), "count", {"topic": "t", "by": "user"})

    def run():
        counts = topics.stream("t", files_per_batch=1).groupBy("user").agg(F.count("*").alias("n"))
        runs.drain(runs.write_batches(counts, path, checkpoint, "update"))
        return runs.read_latest(spark, path, counts.schema, ["user"])

    assert run().agg(F.sum("n")).first()[0] == 120
    topics.append(spark.createDataFrame(data[120:], SCHEMA), "t")
    assert run().agg(F.sum("n")).first()[0] == 240


def test_late_rows_are_dropped_once_the_watermark_passed(spark):
    data = rows(100)
    late = [(900, 1, START, "click", 1)]  # an hour and a half behind by then
    topics = topic_in_pieces(spark, data[:50] + data[50:], 2)
    stream = topics.stream("t", files_per_batch=1).withWatermark("ts", "10 minutes")
    counts = tumble(stream, "ts", "10 minutes", [], n=F.count("*"))
    path, checkpoint = fresh_dir(spark, "out"), fresh_dir(spark, "cp")
    runs.drain(runs.write_batches(counts, path, checkpoint, "update"))
    topics.append(spark.createDataFrame(late, SCHEMA), "t")
    runs.drain(runs.write_batches(counts, path, checkpoint, "update"))
    latest = runs.read_latest(spark, path, counts.schema, ["window_start"])
    assert latest.agg(F.sum("n")).first()[0] == 100


def test_console_and_processing_time(spark):
    topics = topic_in_pieces(spark, rows(3), 1)
    stream = tp.with_processing_time(topics.stream("t"))
    assert dict(stream.dtypes)["proctime"] == "timestamp"
    shown = runs.show(stream.select("id"), fresh_dir(spark, "cp"))
    runs.drain(shown)
    assert shown.lastProgress["numInputRows"] == 3


def test_config_decides_the_checkpoint():
    a = runs.checkpoint_for("r", "j", {"x": 1, "y": 2})
    assert a == runs.checkpoint_for("r", "j", {"y": 2, "x": 1})
    assert a != runs.checkpoint_for("r", "j", {"x": 1, "y": 3})
    assert runs.restart_changed({"a": 1, "b": 2}, {"a": 1, "b": 3})
    assert not runs.restart_changed({"a": 1, "b": 2}, {"b": 2, "a": 1})


def test_pause_resume_and_failing_action(spark):
    topics = topic_in_pieces(spark, rows(20), 1)
    checkpoint, path = fresh_dir(spark, "cp"), fresh_dir(spark, "out")
    task = runs.StreamTask(lambda: runs.write_batches(topics.stream("t"), path, checkpoint))
    with pytest.raises(RuntimeError):
        task.pause()
    assert task.status == "UNASSIGNED"
    task.resume()
    assert task.status == "RUNNING"
    task.finish()
    task.pause()
    assert task.status == "PAUSED"
    topics.append(spark.createDataFrame(rows(30)[20:], SCHEMA), "t")
    task.resume()
    task.finish()
    assert spark.read.parquet(path).count() == 30


def test_a_running_job_is_paused_and_resumed(spark):
    topics = topic_in_pieces(spark, rows(40)[:20], 4)
    path, checkpoint = fresh_dir(spark, "live"), fresh_dir(spark, "cp")
    queries = []

    def start():
        stream = topics.stream("t", files_per_batch=1)
        queries.append(runs.write_batches(stream, path, checkpoint,
                                          trigger={"processingTime": "200 milliseconds"}))
        return queries[-1]

    def stored():
        return spark.read.schema(SCHEMA).parquet(path).count() if os.path.isdir(path) else 0

    def until(rows_there):
        limit = time.time() + 60
        while stored() < rows_there:
            assert time.time() < limit and queries[-1].exception() is None
            time.sleep(0.2)

    task = runs.StreamTask(start)
    task.resume()
    until(5)
    assert queries[0].isActive
    task.pause()
    assert not queries[0].isActive and task.status == "PAUSED"
    topics.append(spark.createDataFrame(rows(40)[20:], SCHEMA).coalesce(1), "t")
    task.resume()
    until(40)
    task.pause()
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == list(range(40))


def test_file_counts_as_new_by_path_or_by_name(spark, tmp_path):
    for overwrite, want in ((True, 2), (False, 1)):
        topics, checkpoint = tp.Topics(spark), fresh_dir(spark, "cp")
        base = tmp_path / str(overwrite)
        for folder in ("a", "b"):
            (base / folder).mkdir(parents=True)
            (base / folder / "x.json").write_text('{"id": 1}')
            runs.drain(files.file_to_topic(topics, f"{base}/*", "*.json", "t", spark.range(1).schema,
                                           checkpoint, overwrite=overwrite))
        assert topics.read("t").count() == want


@pytest.mark.parametrize("hot_rows", [20, 10**9])
def test_stream_join_with_hot_key(spark, hot_rows):
    data = rows(120)
    topics = topic_in_pieces(spark, data, 3)
    stream = topics.stream("t", files_per_batch=1)
    left = stream.where("kind = 'click'").select("user", F.col("id").alias("a"),
                                                 F.col("ts").alias("ta"))
    right = stream.where("kind = 'buy'").select("user", F.col("id").alias("b"),
                                                F.col("ts").alias("tb"))
    hot, _ = hot_keys(topics.read("t"), ["user"], hot_rows)
    assert bool(hot) == (hot_rows == 20)
    pairs = st.stream_interval_join(left, right, ["user"], "ta", "tb", "30 minutes", "1 hour",
                                    F.col("a"), hot, salt=3)
    runs.drain(topics.publish(pairs, "pairs", fresh_dir(spark, "cp")))
    want = [(x[0], y[0]) for x in data for y in data if x[1] == y[1] and x[3] == "click"
            and y[3] == "buy" and timedelta(0) <= y[2] - x[2] <= timedelta(minutes=30)]
    got = topics.read("pairs").select("a", "b").collect()
    assert sorted(map(tuple, got)) == sorted(want) and want


@pytest.mark.parametrize("first,later", [(10**9, 5), (5, 10**9)])
@pytest.mark.parametrize("what", ["join", "distinct"])
def test_restart_after_a_key_became_hot_or_cool(spark, first, later, what):
    """The job keeps the spread it was created with, so no state is lost and any restart starts."""
    data = rows(160)
    rng = random.Random(3)
    rng.shuffle(data)  # files do not arrive in order of time either
    topics = topic_in_pieces(spark, data[:80], 3)
    job, checkpoint = fresh_dir(spark, "job"), fresh_dir(spark, "cp")

    def run(hot_rows):
        stream = topics.stream("t", files_per_batch=1)
        keys = ["user"] if what == "join" else ["user", "kind"]
        hot, salt = st.job_spread(spark, job, topics.read("t"), keys, hot_rows)
        if what == "join":
            out = st.stream_interval_join(
                stream.where("kind = 'click'").select("user", F.col("id").alias("a"), F.col("ts").alias("ta")),
                stream.where("kind = 'buy'").select("user", F.col("id").alias("b"), F.col("ts").alias("tb")),
                keys, "ta", "tb", "30 minutes", "3 hours", F.col("a"), hot, salt).select("a", "b")
        else:
            out = st.stream_distinct(stream, keys, spread=F.col("id"), hot=hot, salt=salt)
        runs.drain(topics.publish(out, "out", checkpoint))
        return bool(hot)

    was_hot = run(first)
    assert was_hot == (first == 5)
    topics.append(spark.createDataFrame(data[80:], SCHEMA), "t")
    assert run(later) == was_hot
    got = sorted(map(tuple, topics.read("out").collect()))
    if what == "join":
        assert got == sorted((x[0], y[0]) for x in data for y in data if x[1] == y[1] and x[3] == "click"
                             and y[3] == "buy" and timedelta(0) <= y[2] - x[2] <= timedelta(minutes=30))
    else:
        assert got == sorted({(x[1], x[3]) for x in data})


@pytest.mark.parametrize("limits", [{}, {"ts": "ts", "delay": "1 day"}])
@pytest.mark.parametrize("hot_rows", [20, 10**9])
def test_stream_distinct(spark, limits, hot_rows):
    topics = topic_in_pieces(spark, rows(), 3)
    columns = ["user", "kind"]
    hot, _ = hot_keys(topics.read("t"), columns, hot_rows)
    assert bool(hot) == (hot_rows == 20)
    out = st.stream_distinct(topics.stream("t", files_per_batch=1), columns,
                             spread=F.col("id"), hot=hot, salt=3, **limits)
    runs.drain(topics.publish(out, "d", fresh_dir(spark, "cp")))
    assert sorted(topics.read("d").collect()) == sorted(
        topics.read("t").select(*columns).distinct().collect())


def test_stream_back_states(spark):
    job = StreamBack(tp.Topics(spark), "res")
    out = job.run("select id, id * 2 as d from range(10); -- done\n")
    assert out.count() == 10 and job.states == ["UNASSIGNED", "RUNNING", "FINISHED"]
    assert '"name":"res"' in job.schema_json
    failed = StreamBack(tp.Topics(spark), "res")
    with pytest.raises(Exception):
        failed.run("select raise_error('no') as x from range(3)")
    assert failed.state == "FAILED"


def test_model_over_a_stream(spark):
    topics = topic_in_pieces(spark, rows(60), 2)
    models = Models(spark, fresh_dir(spark, "models"))
    table = topics.read("t")
    models.save("kind", naive_bayes_pipeline("kind", ["value"], 100, table))
    scored = models.score(topics.stream("t"), "kind").select("id", "predicted")
    runs.drain(topics.publish(scored, "scored", fresh_dir(spark, "cp")))
    assert topics.read("scored").count() == 60


def test_topics_and_views(spark):
    topics = tp.Topics(spark)
    for name in ("one", "two"):
        topics.append(spark.range(3).withColumn("t", F.lit(name)), name)
    assert topics.register("one, two") == ["one", "two"]
    assert spark.sql("select * from one union all select * from two").count() == 6
    topics.register("one", streaming=True)
    assert spark.table("one").isStreaming
    topics.append_routed(spark.range(4).withColumn("route", F.lit("r")), "group")
    assert topics.routed("group", "r").count() == 4
    plan = topics.routed("group", "r")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(route" in plan
    topics.drop("one")
    with pytest.raises(Exception):
        topics.read("one")


def test_replay_preview_and_messages(spark):
    df = spark.createDataFrame(rows(50), SCHEMA)
    assert tp.replay_since(df, "ts", timedelta(minutes=5)).count() == 6
    head = tp.topic_preview(df.select("id", "kind"), "id").collect()
    assert len(head) == 10 and head[0]["value"].startswith('{"id":0,')
    message = tp.message(df, ["user"]).first()
    assert bytes(message["key"]).startswith(b'{"user":')
    assert tp.message(df).first()["key"] is None


def test_kafka_settings(spark):
    assert tp.kafka_options("h:1", "a,b") == {
        "kafka.bootstrap.servers": "h:1", "subscribe": "a,b", "startingOffsets": "earliest"}
    since = tp.kafka_options("h:1", "a", since=timedelta(minutes=5), now_ms=1_000_000)
    assert since["startingTimestamp"] == "700000"
    with pytest.raises(RuntimeError, match="class path"):
        tp.kafka_reader(spark, tp.kafka_options("h:1", "a"))


def test_jdbc_settings():
    options = files.jdbc_options("jdbc:x", "t", "id", 0, 100, 4)
    assert options["numPartitions"] == "4" and options["upperBound"] == "100"
    assert "partitionColumn" not in files.jdbc_options("jdbc:x", "t")


def test_file_sources_and_sinks(spark):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "id long, s string")
    path = fresh_dir(spark, "csv")
    files.write_csv(df, path)
    assert {r["id"] for r in files.read_csv_text(spark, path, ["id", "s"], "|").collect()} == {
        "1", "2"}
    path = fresh_dir(spark, "text")
    files.write_lines(df, path, "id")
    assert {r["line"] for r in files.read_lines(spark, path).collect()} == {"1", "2"}
    path = fresh_dir(spark, "schemaed")
    files.write_schemaed(df, path, "csv", header="true")
    assert dict(files.read_schemaed(spark, path, "csv").dtypes)["id"] == "int"


def test_file_progress(spark):
    base = fresh_dir(spark, "progress")
    os.makedirs(base)
    for name in ("a.processed", "b.processed", "c.json"):
        with open(f"{base}/{name}", "w") as out:
            out.write("{}")
    row = files.file_progress(spark, base).first()
    assert (row["json"], row["processing"], row["processed"], row["done"]) == (1, 0, 2, False)


def test_archived_files_are_not_read_twice(spark):
    source, topics = fresh_dir(spark, "src"), tp.Topics(spark)
    spark.range(5).write.json(source)
    checkpoint = fresh_dir(spark, "cp")
    schema = spark.range(1).schema
    for _ in range(2):
        runs.drain(files.file_to_topic(topics, source, "*.json", "t", schema, checkpoint))
    assert topics.read("t").count() == 5


def test_flatten_log(spark):
    path = fresh_dir(spark, "logs")
    spark.createDataFrame([(
        '{"_id":{"$oid":"1"},"timestamp":{"$date":"d"},"level":"INFO",'
        '"class":{"className":"C"},"message":"m"}',)], "v string").write.text(path)
    row = files.flatten_log(files.read_documents(spark, path)).first()
    assert (row["id"], row["timestamp"], row["class_name"], row["message"]) == ("1", "d", "C", "m")
