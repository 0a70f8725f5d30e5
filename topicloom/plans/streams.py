"""Streaming queries: the input table is read as a file stream, the result read back."""

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from topicloom.operators import operations as ops
from topicloom.operators import transforms as tf
from topicloom.operators.aggregates import stream_sessions, tumble
from topicloom.operators.joins import lookup
from topicloom.operators.ordered import over_last_rows
from topicloom.operators.scripts import run_stream_sql
from topicloom.plans.operations import with_status
from topicloom.plans.registry import query
from topicloom.session import fits_broadcast, fresh_dir
from topicloom.sources import frames
from topicloom.sources.topics import Topics, with_event_time
from topicloom.streaming import operators as st
from topicloom.streaming.event_time import EventTimeRows
from topicloom.streaming.runs import (
    ChangeLog,
    as_plain_time,
    drain,
    read_batches,
    read_latest,
    write_batches,
)
from topicloom.streaming.stream_back import StreamBack


def _schema(ddl):
    return StructType.fromDDL(ddl)


def _sink(t, stream):
    topics = Topics(t.spark)
    drain(topics.publish(stream, "out", fresh_dir(t.spark, "checkpoint")))
    return topics.read("out", stream.schema)


def _span_s(df, ts):
    """Delay in seconds under which no row of a bounded table is late, however its files arrive."""
    least, most = df.agg(F.min(ts), F.max(ts)).first()
    return int((most - least).total_seconds()) + 1 if most else 0


def _span(df, ts):
    return f"{_span_s(df, ts)} seconds"


def _latest(t, stream, keys):
    path = fresh_dir(t.spark, "changes")
    drain(write_batches(stream, path, fresh_dir(t.spark, "checkpoint"), "update"))
    return read_latest(t.spark, path, stream.schema, keys)


@query("stream_sql", """
SELECT event_id, user_id, value * 2 AS doubled FROM events WHERE event_type <> 'error'""")
def stream_sql(t):
    t.stream("events").createOrReplaceTempView("events_stream")
    return _sink(t, run_stream_sql(t.spark, """
        SELECT event_id, user_id, value * 2 AS doubled FROM events_stream
        WHERE event_type <> 'error';"""))


@query("stream_union", """
SELECT user_id, event_type FROM events WHERE event_type = 'view'
UNION ALL SELECT user_id, event_type FROM events WHERE event_type <> 'view'""")
def stream_union(t):
    events = t.stream("events").select("user_id", "event_type")
    return _sink(t, tf.union_topics(events.where("event_type = 'view'"),
                                    events.where("event_type <> 'view'")))


@query("stream_router", """
SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN 'alerts' WHEN value > 75 THEN 'large'
       ELSE 'rest' END AS topic FROM events""")
def stream_router(t):
    topics = Topics(t.spark)
    routed = tf.route(t.stream("events"), [("alerts", "event_type = 'error'"),
                                           ("large", "value > 75")], default="rest")
    drain(topics.publish_routed(routed, "out", fresh_dir(t.spark, "checkpoint")))
    return tf.union_topics(*[
        topics.routed("out", name).select("event_id", "user_id", F.lit(name).alias("topic"))
        for name in ("alerts", "large", "rest")])


@query("stream_copy", """
SELECT event_id, topic FROM events, (VALUES ('audit'), ('live')) v(topic)""")
def stream_copy(t):
    events = t.stream("events").select("event_id")
    return _sink(t, tf.copy_to(events, ["audit", "live"]))


@query("framed_stream_sql", """
SELECT true AS framed, CAST(11 AS BIGINT) AS schema_id, event_type, user_id + 1 AS user_id
FROM events WHERE value < 90""")
def framed_stream_sql(t):
    events = t.stream("events").select("event_type", "user_id", "value")
    wire = frames.encode_framed(events, 10, value="message").select("message")
    decoded = frames.decode_framed(wire, events.schema, value="message")
    decoded.createOrReplaceTempView("framed_topic")
    result = run_stream_sql(t.spark, "SELECT event_type, user_id + 1 AS user_id "
                                     "FROM framed_topic WHERE value < 90")
    stored = _sink(t, frames.encode_framed(result, 11).select("value"))
    return frames.decode_framed(stored, result.schema)


@query("stream_tumble", """
SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n,
       round(sum(value), 2) AS total_value FROM events GROUP BY 1, 2""")
def stream_tumble(t):
    events = with_event_time(t.stream("events")).withWatermark("ts", _span(t.events, "ts"))
    windows = tumble(events, "ts", "1 hour", ["event_type"], n=F.count("*"),
                     total_value=F.round(F.sum("value"), 2))
    return as_plain_time(_latest(t, windows, ["window_start", "event_type"]), "window_start")


@query("stream_agg_final", """
SELECT user_id, count(*) AS n, round(sum(value), 2) AS total_value FROM events GROUP BY user_id""")
def stream_agg_final(t):
    changes = t.stream("events").groupBy("user_id").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total_value"))
    return _latest(t, changes, ["user_id"])


@query("stream_session", """
WITH marked AS (
  SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS is_new
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (SELECT user_id, ts, sum(is_new) OVER (PARTITION BY user_id ORDER BY ts
             ROWS UNBOUNDED PRECEDING) AS s FROM marked)
SELECT user_id, min(ts) AS session_start, max(ts) AS last_seen, count(*) AS n
FROM numbered GROUP BY user_id, s""")
def stream_session(t):
    """Sessions by native state; a last row far ahead lets the watermark pass the end of all of them."""
    topics, checkpoint = Topics(t.spark), fresh_dir(t.spark, "checkpoint")
    events = with_event_time(t.events.select("user_id", "ts"))
    span = _span_s(t.events, "ts")
    closing = events.agg(F.lit(None).cast("long").alias("user_id"),
                         (F.max("ts") + F.make_dt_interval(secs=F.lit(span + 7200))).alias("ts"))
    for part in (events, closing):
        topics.append(part, "events")
        found = stream_sessions(topics.stream("events", events.schema), "ts", "30 minutes", ["user_id"],
                                f"{span} seconds")
        drain(topics.publish(found, "sessions", checkpoint))
    out = topics.read("sessions", found.schema).where("user_id IS NOT NULL")
    return as_plain_time(out, "session_start", "last_seen")


@query("stream_compacted_log", """
SELECT user_id, count(*) AS n, round(sum(value), 2) AS total_value FROM events GROUP BY user_id""")
def stream_compacted_log(t):
    """The table comes in four parts; the log of changes gets a new base on the way."""
    topics, checkpoint, path = (Topics(t.spark), fresh_dir(t.spark, "checkpoint"), fresh_dir(t.spark, "changes"))
    events = t.events.select("event_id", "user_id", "value")
    log = ChangeLog(t.spark, path, _schema("user_id long, n long, total_value double"), ["user_id"], every=2)
    for arrival in range(4):
        topics.append(events.where(F.col("event_id") % 4 == arrival), "events")
        changes = topics.stream("events", events.schema, files_per_batch=10**6).groupBy("user_id").agg(
            F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total_value"))
        drain(write_batches(changes, path, checkpoint, "update", log=log))
    return log.read()


@query("stream_distinct", "SELECT DISTINCT user_id, event_type FROM events")
def stream_distinct(t):
    columns = ["user_id", "event_type"]
    hot, salt = st.job_spread(t.spark, fresh_dir(t.spark, "job"), t.events, columns)
    return _sink(t, st.stream_distinct(t.stream("events"), columns, spread=F.col("event_id"),
                                       hot=hot, salt=salt))


@query("stream_interval_join", """
SELECT c.event_id AS click_id, p.event_id AS purchase_id, c.user_id, c.ts AS clicked
FROM events c JOIN events p ON c.user_id = p.user_id
 AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 2 HOURS
WHERE c.event_type = 'click' AND p.event_type = 'purchase'""")
def stream_interval_join(t):
    events = with_event_time(t.stream("events"))
    clicks = events.where("event_type = 'click'").select(
        "user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("clicked"))
    buys = events.where("event_type = 'purchase'").select(
        "user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("bought"))
    sides = t.events.where("event_type IN ('click', 'purchase')")
    hot, salt = st.job_spread(t.spark, fresh_dir(t.spark, "job"), sides, ["user_id"])
    pairs = st.stream_interval_join(clicks, buys, ["user_id"], "clicked", "bought", "2 hours",
                                    _span(t.events, "ts"), spread=F.col("click_id"), hot=hot, salt=salt)
    out = _sink(t, pairs.select("click_id", "purchase_id", "user_id", "clicked"))
    return as_plain_time(out, "clicked")


def _over_rows(t, events, back, apply, out):
    """A whole table as a stream: rows wait for the end of it, as its files may come in any order."""
    job = EventTimeRows(t.spark, fresh_dir(t.spark, "frames"), ["user_id"], ["ts", "event_id"], "ts",
                        _span_s(t.events, "ts"), back, apply)
    drain(job.start(events, fresh_dir(t.spark, "checkpoint")))
    job.finish(events.schema)
    return job.results(_schema(out))


@query("stream_over_rows", """
SELECT event_id, user_id, count(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
       ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent FROM events""")
def stream_over_rows(t):
    events = t.stream("events").select("event_id", "user_id", "ts", "value")

    def count_recent(batch, seed):
        out = over_last_rows(batch, ["user_id"], ["ts", "event_id"], 2,
                             {"recent": lambda w: F.count("value").over(w.rowsBetween(-2, 0))},
                             seed)
        return out.select("event_id", "user_id", "recent")

    return _over_rows(t, events, 2, count_recent, "event_id long, user_id long, recent long")


@query("stream_status_changes", """
WITH s AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'view' THEN 'RUNNING'
             WHEN 'click' THEN 'UNASSIGNED' WHEN 'purchase' THEN 'running'
             WHEN 'error' THEN 'FAILED' END AS status FROM events),
p AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old_status FROM s)
SELECT event_id, old_status, coalesce(status, 'LOST') AS new_status FROM p
WHERE upper(old_status) <> upper(coalesce(status, 'LOST'))
  AND NOT (upper(old_status) = 'RUNNING' AND upper(coalesce(status, 'LOST')) = 'UNASSIGNED')""")
def stream_status_changes(t):
    def changed(batch, seed):
        return ops.status_changes(batch, ["user_id"], ["ts", "event_id"], "status", seed).select(
            "event_id", "old_status", "new_status")

    return _over_rows(t, with_status(t.stream("events")), 1, changed,
                      "event_id long, old_status string, new_status string")


@query("stream_lookup", """
SELECT event_id, user_id, c_name FROM events LEFT JOIN customer ON user_id = c_custkey""")
def stream_lookup(t):
    customers = t.customer
    small = fits_broadcast(customers.select("c_custkey", "c_name"))  # once, not per batch
    path = fresh_dir(t.spark, "enriched")
    drain(write_batches(
        t.stream("events").select("event_id", "user_id"), path, fresh_dir(t.spark, "checkpoint"),
        step=lambda batch: lookup(batch, customers, {"user_id": "c_custkey"}, ["c_name"],
                                  small=small)))
    return read_batches(t.spark, path,
                        _schema("event_id long, user_id long, c_name string")).drop("batch_id")


@query("metadata_sink", """
SELECT CAST(user_id AS VARCHAR) AS cuid, event_type AS file_name, epoch_us(ts) // 1000
       AS current_timemillis, CAST(event_id AS VARCHAR) AS stream_offset FROM events""")
def metadata_sink(t):
    events = t.stream("events")
    meta = events.select(
        F.col("user_id").cast("string").alias("cuid"), F.col("event_type").alias("file_name"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("current_timemillis"),
        F.col("event_id").cast("string").alias("stream_offset"))
    return _sink(t, meta)


@query("stream_back", """
SELECT event_type, count(*) AS n, round(sum(value), 2) AS total_value, 'FINISHED' AS state
FROM events GROUP BY event_type""")
def stream_back(t):
    t.events.createOrReplaceTempView("batch_events")
    job = StreamBack(Topics(t.spark), "results")
    result = job.run("""
        SELECT event_type, count(*) AS n, round(sum(value), 2) AS total_value -- per type
        FROM batch_events GROUP BY event_type;""")
    return result.withColumn("state", F.lit(job.state))


LATE_ARRIVALS, LATE_DELAY_S, LATE_SLICE_S = 4, 2 * 86_400, 3_600


@query("stream_late_rows", """
WITH a AS (SELECT event_id, event_id % 4 AS arrival, epoch_us(ts) AS us FROM events),
m AS (SELECT arrival, max(us) AS newest FROM a GROUP BY arrival),
c AS (SELECT arrival, max(newest) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
             AS seen FROM m)
SELECT event_id, coalesce(us // 3600000000 < (seen - 172800000000) // 3600000000, false) AS late
FROM a JOIN c USING (arrival)""")
def stream_late_rows(t):
    """The table comes in four parts, each from all over the month; the first one passes, and what the others
    bring from before the watermark is late. Kept and late rows together are all rows."""
    topics, checkpoint = Topics(t.spark), fresh_dir(t.spark, "checkpoint")
    events = t.events.select("event_id", "user_id", "ts")
    job = EventTimeRows(t.spark, fresh_dir(t.spark, "frames"), ["user_id"], ["ts", "event_id"], "ts",
                        LATE_DELAY_S, 1, lambda rows, seed: rows.select("event_id"), LATE_SLICE_S)
    for arrival in range(LATE_ARRIVALS):
        topics.append(events.where(F.col("event_id") % LATE_ARRIVALS == arrival), "events")
        # Each start goes on where the last one ended.
        drain(job.start(topics.stream("events", events.schema, files_per_batch=10**6), checkpoint))
    job.finish(events.schema)
    kept = job.results(_schema("event_id long")).withColumn("late", F.lit(False))
    return kept.unionByName(job.late_rows(events.schema).select("event_id", F.lit(True).alias("late")))
