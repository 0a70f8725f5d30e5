"""Topic, file and sink queries."""

from datetime import timedelta

from pyspark.sql import functions as F

from topicloom.plans.registry import query
from topicloom.session import fresh_dir
from topicloom.sources import files
from topicloom.sources import topics as tp
from topicloom.streaming.runs import drain

EVENTS_SQL = "SELECT event_id, ts, user_id, event_type, value, props FROM events"


@query("topic_scan", EVENTS_SQL)
def topic_scan(t):
    tp.register_views({"events_topic": t.events})
    return t.spark.table("events_topic")


@query("topic_roundtrip", EVENTS_SQL)
def topic_roundtrip(t):
    topics = tp.Topics(t.spark)
    topics.append(t.events, "events")
    topics.register("events")
    return t.spark.table("events")


@query("message_keys", """
SELECT '{"user_id":' || user_id || ',"event_type":"' || event_type || '"}' AS key,
       CAST(props->>'k' AS BIGINT) AS k FROM events""")
def message_keys(t):
    messages = tp.message(t.events, ["user_id", "event_type"])
    props = F.get_json_object(F.col("value").cast("string"), "$.props")
    return messages.select(F.col("key").cast("string"),
                           F.get_json_object(props, "$.k").cast("long").alias("k"))


@query("partition_summary", """
SELECT user_id % 4 AS partition, count(*) AS records, min(event_id) AS first_offset,
       max(event_id) AS last_offset FROM events GROUP BY 1""")
def partition_summary(t):
    return tp.partition_summary(t.events, F.col("user_id") % 4, "event_id")


@query("topic_preview", """
SELECT event_id AS id, '{"event_id":' || event_id || ',"user_id":' || user_id ||
       ',"event_type":"' || event_type || '"}' AS value
FROM events ORDER BY event_id LIMIT 10""")
def topic_preview(t):
    return tp.topic_preview(t.events.select("event_id", "user_id", "event_type"), "event_id")


@query("replay_since", """
SELECT event_id, ts, event_type FROM events
WHERE ts >= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def replay_since(t):
    return tp.replay_since(t.events.select("event_id", "ts", "event_type"), "ts",
                           timedelta(days=1))


@query("file_to_topic", EVENTS_SQL)
def file_to_topic(t):
    topics = tp.Topics(t.spark)
    # The table may be one file or a folder of files; the pattern finds both.
    drain(files.file_to_topic(topics, f"{t.root}/events.parque[t]", "*.parquet", "landed",
                              t.events.schema, fresh_dir(t.spark, "checkpoint"), fmt="parquet"))
    return topics.read("landed")


@query("flat_file_lines", """
SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
GROUP BY line""")
def flat_file_lines(t):
    path = fresh_dir(t.spark, "lines")
    files.write_lines(t.documents, path, "text")
    return files.read_lines(t.spark, path).groupBy("line").agg(F.count("*").alias("n"))


@query("csv_project", """
SELECT CAST(event_id AS VARCHAR) AS id, event_type AS name, round(value, 2) AS score,
       props AS comments FROM events""")
def csv_project(t):
    path = fresh_dir(t.spark, "csv")
    files.write_csv(t.events.select("event_id", "event_type", "value", "props"), path)
    text = files.read_csv_text(t.spark, path, ["id", "name", "score", "comments"], sep="|")
    return text.select("id", "name", F.round(F.col("score").cast("double"), 2).alias("score"),
                       "comments")


@query("json_documents", """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def json_documents(t):
    path = fresh_dir(t.spark, "documents")
    files.write_documents(t.customer, path)
    return files.read_documents(t.spark, path, t.customer.schema)


@query("schemaed_file", "SELECT n_name, CAST(n_nationkey AS BIGINT) AS n_nationkey, c_name FROM nation "
       "JOIN customer ON n_nationkey = c_nationkey")
def schemaed_file(t):
    path = fresh_dir(t.spark, "schemaed")
    named = t.nation.join(t.customer, F.col("n_nationkey") == F.col("c_nationkey"))
    files.write_schemaed(named.select("n_name", "n_nationkey", "c_name"), path)
    return files.read_schemaed(t.spark, path)


@query("partitioned_sink", """
SELECT event_type, count(*) AS n, round(sum(value), 2) AS total_value FROM events
WHERE event_type <> 'error' GROUP BY event_type""")
def partitioned_sink(t):
    path = fresh_dir(t.spark, "partitioned")
    files.write_partitioned(t.events, path, ["event_type"])
    kept = t.spark.read.parquet(path).where("event_type <> 'error'")
    return kept.groupBy("event_type").agg(F.count("*").alias("n"),
                                          F.round(F.sum("value"), 2).alias("total_value"))


@query("routed_sink", """
SELECT 'alerts' AS topic, count(*) AS n FROM events WHERE event_type = 'error'
UNION ALL SELECT 'rest', count(*) FROM events WHERE event_type <> 'error'""")
def routed_sink(t):
    topics = tp.Topics(t.spark)
    name = F.when(F.col("event_type") == "error", "alerts").otherwise("rest")
    topics.append_routed(t.events.withColumn("route", name), "out")
    counted = [topics.routed("out", n).groupBy(F.lit(n).alias("topic")).agg(F.count("*").alias("n"))
               for n in ("alerts", "rest")]
    return counted[0].unionByName(counted[1])


@query("file_progress", """
SELECT 'written' AS stage, count(*) > 0 AS pending, count(*) = 0 AS done FROM events
UNION ALL SELECT 'handed over', count(*) < 0, count(*) >= 0 FROM events""")
def file_progress(t):
    waiting, landed = fresh_dir(t.spark, "handover"), fresh_dir(t.spark, "landed")
    files.write_schemaed(t.events, waiting)
    t.spark.read.schema(t.events.schema).json(waiting).write.parquet(landed)
    stages = [files.file_progress(t.spark, path).select(
        F.lit(stage).alias("stage"), (F.col("json") > 0).alias("pending"), "done")
        for stage, path in (("written", waiting), ("handed over", landed))]
    return stages[0].unionByName(stages[1])


@query("log_flatten", """
SELECT CAST(conv_id AS VARCHAR) || '-' || turn AS id, CAST(turn AS VARCHAR) AS timestamp,
       role AS class_name, role AS level, text AS message FROM conversations""")
def log_flatten(t):
    """Log documents as stored (id, time and class nested), then flattened."""
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    nested = t.conversations.select(
        F.struct(key.alias("$oid")).alias("_id"),
        F.struct(F.col("turn").cast("string").alias("$date")).alias("timestamp"),
        F.struct(F.col("role").alias("className")).alias("class"),
        F.col("role").alias("level"), F.col("text").alias("message"))
    path = fresh_dir(t.spark, "logs")
    files.write_documents(nested, path)
    return files.flatten_log(files.read_documents(t.spark, path, nested.schema))
