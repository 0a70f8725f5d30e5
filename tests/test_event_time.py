"""Event-time row frames, change logs and late rows on streams whose files come in any order."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from test_topics_streams import SCHEMA, rows, topic_in_pieces

from topicloom.operators.aggregates import tumble
from topicloom.operators.ordered import over_last_rows
from topicloom.session import fresh_dir, numbered, read_text, write_text
from topicloom.streaming import runs
from topicloom.streaming.event_time import EventTimeRows

ROWS = "id long, s long"
DAY = 86_400


def frames(batch, seed):
    return over_last_rows(batch, ["user"], ["ts", "id"], 2, {
        "s": lambda w: F.sum("value").over(w.rowsBetween(-2, 0))}, seed, hot_rows=20).select("id", "s")


def job_for(spark, delay_s, **more):
    return EventTimeRows(spark, fresh_dir(spark, "frames"), ["user"], ["ts", "id"], "ts", delay_s, 2, frames, **more)


def sums(data):
    want, last = {}, {}
    for i, user, _, _, value in sorted(data, key=lambda r: (r[2], r[0])):
        last[user] = (last.get(user, []) + [value])[-3:]
        want[i] = sum(last[user])
    return want


def results(spark, job):
    from topicloom.plans.streams import _schema

    found = job.results(_schema(ROWS)).collect()
    assert len({r["id"] for r in found}) == len(found)
    return {r["id"]: r["s"] for r in found}


def run(spark, job, topics, checkpoint):
    runs.drain(job.start(topics.stream("t", files_per_batch=1), checkpoint))


def test_shuffled_files_one_per_batch(spark):
    data = rows()
    random.Random(2).shuffle(data)
    topics, job = topic_in_pieces(spark, data, 4), job_for(spark, DAY)
    run(spark, job, topics, fresh_dir(spark, "cp"))
    job.finish(topics.read("t").schema)
    assert results(spark, job) == sums(data)
    assert job.late_rows(topics.read("t").schema).count() == 0 and job.mark_before(99).late == 0


@pytest.mark.parametrize("slice_s", [None, 60, 600])
def test_local_disorder_is_waited_for(spark, slice_s):
    """Rows come up to 40 minutes out of order; most are handed on before the end."""
    rng = random.Random(3)
    data = sorted(rows(), key=lambda r: r[2] + timedelta(minutes=rng.randrange(40)))
    topics, job = topic_in_pieces(spark, data, 6), job_for(spark, 2400, slice_s=slice_s)
    run(spark, job, topics, fresh_dir(spark, "cp"))
    before = results(spark, job)
    assert 100 < len(before) < 240
    job.finish(topics.read("t").schema)
    want = sums(data)
    assert results(spark, job) == want and before.items() <= want.items()
    assert len(numbered(spark, f"{job.root}/marks", "", ".json")) <= 2


def test_late_rows_are_counted_and_kept_aside(spark):
    data = rows()
    late = [r for r in data if r[0] % 10 == 3 and r[0] < 150]
    timeless = (999, 1, None, "click", 5)
    in_time = [r for r in data if r not in late]
    topics, job = topic_in_pieces(spark, [*in_time, *late, timeless], 5), job_for(spark, 300)
    run(spark, job, topics, fresh_dir(spark, "cp"))
    schema = topics.read("t").schema
    job.finish(schema)
    aside = {r["id"] for r in job.late_rows(schema).collect()}
    assert aside == {r[0] for r in late} | {999}
    assert results(spark, job) == sums(in_time)
    mark = job.mark_before(99)
    assert (mark.arrived, mark.late) == (241, len(aside))


def test_only_buckets_of_the_keys_of_a_batch_are_opened(spark):
    data = [(i, i % 50, ts, k, v) for i, _, ts, k, v in rows(200)]
    data += [(200 + i, 7, data[-1][2] + timedelta(hours=1, minutes=i), "buy", 1) for i in range(3)]
    topics, job = topic_in_pieces(spark, data[:200], 1), job_for(spark, 0, slice_s=1)
    checkpoint, schema = fresh_dir(spark, "cp"), topics.read("t").schema
    run(spark, job, topics, checkpoint)
    opened = []
    carried = EventTimeRows.carried

    def watched(self, schema, mark, buckets):
        found = carried(self, schema, mark, buckets)
        opened.append({f.split("bucket=")[1].split("/")[0] for f in found.inputFiles()} if found else set())
        return found

    EventTimeRows.carried = watched
    try:
        topics.append(spark.createDataFrame(data[200:], SCHEMA).coalesce(1), "t")
        run(spark, job, topics, checkpoint)
        job.finish(schema)
    finally:
        EventTimeRows.carried = carried
    assert len(opened[0]) <= 2 and len(numbered(spark, f"{job.root}/carried/batch_id=0", "bucket=")) > 10
    assert results(spark, job) == sums(data)


def test_repeated_and_interrupted_batches_change_nothing(spark, monkeypatch):
    data = rows()
    random.Random(5).shuffle(data)
    topics, job = topic_in_pieces(spark, data[:180], 3), job_for(spark, DAY, slice_s=600)
    checkpoint, schema = fresh_dir(spark, "cp"), topics.read("t").schema
    run(spark, job, topics, checkpoint)
    job.finish(schema)
    assert results(spark, job) == sums(data[:180])
    job.finish(schema)
    # A stop before the mark is written: the batch is done again.
    topics.append(spark.createDataFrame(data[180:], SCHEMA).coalesce(1), "t")
    from topicloom.streaming import event_time

    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as patch:
        patch.setattr(event_time, "write_text", stop)
        with pytest.raises(Exception):
            run(spark, job, topics, checkpoint)
    run(spark, job, topics, checkpoint)
    job.finish(schema)
    assert results(spark, job) == sums(data)


def counts(topics):
    return topics.stream("t", files_per_batch=1).groupBy("user").agg(
        F.count("*").alias("n"), F.sum("value").alias("v"))


def test_change_log_reads_base_and_newer_batches_only(spark, monkeypatch):
    topics, path, checkpoint = topic_in_pieces(spark, rows(), 8), fresh_dir(spark, "log"), fresh_dir(spark, "cp")
    log = runs.ChangeLog(spark, path, counts(topics).schema, ["user"], every=3)
    swap = runs.write_text
    stops = iter([True])

    def stop_once(*args):
        if next(stops, False):
            raise RuntimeError("stopped between write and swap")
        swap(*args)

    monkeypatch.setattr(runs, "write_text", stop_once)
    with pytest.raises(Exception):
        runs.drain(runs.write_batches(counts(topics), path, checkpoint, "update", log=log))
    assert log.pointer()["upto"] == -1 and numbered(spark, f"{path}-base", "upto=") == [2]
    half = {r["user"]: r["n"] for r in log.read().collect()}
    assert sum(half.values()) == 90
    runs.drain(runs.write_batches(counts(topics), path, checkpoint, "update", log=log))
    want = sorted(topics.read("t").groupBy("user").agg(F.count("*"), F.sum("value")).collect())
    assert sorted(log.read().collect()) == want
    upto = log.pointer()["upto"]
    assert upto == 5
    files = log.versions().inputFiles()
    assert {f.rsplit("/", 2)[1] for f in files} == {"upto=5", "batch_id=6", "batch_id=7"}
    # Doing the last batch and the compaction again changes nothing.
    log.compact(upto)
    assert sorted(runs.read_latest(spark, path, log.schema, ["user"]).collect()) == want
    log.compact(7)
    assert sorted(log.read().collect()) == want
    assert numbered(spark, path, "batch_id=") == [6, 7]


def test_small_files_are_replaced_in_one_step(spark):
    path = f"{fresh_dir(spark, 'text')}/a.json"
    assert read_text(spark, path) is None
    for text in ("one", "größer"):
        write_text(spark, path, text)
        assert read_text(spark, path) == text


def test_rows_dropped_by_a_watermark_are_counted(spark):
    data = rows()
    late = [r for r in data if r[0] % 6 == 1 and r[0] < 120]
    topics = topic_in_pieces(spark, [r for r in data if r not in late] + late, 5)
    listener = runs.DroppedRows()
    spark.streams.addListener(listener)
    try:
        out = tumble(topics.stream("t", files_per_batch=1).withWatermark("ts", "5 minutes"), "ts", "10 minutes",
                     ["kind"], n=F.count("*"))
        path = fresh_dir(spark, "out")
        job = runs.write_batches(out, path, fresh_dir(spark, "cp"), "update")
        runs.drain(job)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    finally:
        spark.streams.removeListener(listener)
    kept = runs.read_latest(spark, path, out.schema, ["window_start", "kind"]).agg(F.sum("n")).first()[0]
    assert listener.dropped[str(job.id)] > 0
    # Spark drops partial groups of a batch, so the count is one of groups, not more than the rows.
    assert 240 - kept >= listener.dropped[str(job.id)] and kept >= 240 - len(late)
