"""Queries over the tables a pipeline keeps about itself."""

from pyspark.sql import functions as F

from topicloom.operators import aggregates as agg
from topicloom.operators import operations as ops
from topicloom.operators import transforms as tf
from topicloom.operators.models import Models, naive_bayes_pipeline
from topicloom.plans.registry import query
from topicloom.session import fresh_dir


@query("process_history", """
WITH m AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM events)
SELECT CAST(user_id AS VARCHAR) || event_type AS id, user_id AS cuid, event_type AS file_name,
       arg_min(props, (ms, event_id)) AS props, arg_min(value, (ms, event_id)) AS file_size,
       min(ms) AS start_time, max(ms) AS end_time, min(event_type || '_' || (event_id % 3)) AS status,
       max(ms) - min(ms) AS process_milliseconds
FROM m GROUP BY user_id, event_type""")
def process_history(t):
    state = F.concat_ws("_", "event_type", (F.col("event_id") % 3).cast("string"))
    meta = t.events.select(
        "event_id", "user_id", "event_type", "props", F.col("value").alias("file_size"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), state.alias("state"))
    return agg.process_history(meta, "user_id", "event_type", "ms", "state",
                               ["props", "file_size"], "event_id", sort="process_milliseconds")


@query("status_rollup", """
WITH tasks AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'RUNNING' WHEN 'F' THEN 'Running'
                      ELSE nullif('PAUSED', CASE WHEN o_custkey < 100 THEN 'PAUSED' END) END AS state
               FROM orders),
parts AS (SELECT l_orderkey, bool_and(l_linestatus = 'O') AS ok FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN state IS NULL THEN 'NONE' WHEN upper(state) <> 'RUNNING' THEN state
       WHEN coalesce(ok, true) THEN 'RUNNING' ELSE 'RWE' END AS status
FROM tasks LEFT JOIN parts ON o_orderkey = l_orderkey""")
def status_rollup(t):
    state = (F.when(F.col("o_orderstatus") == "O", "RUNNING")
             .when(F.col("o_orderstatus") == "F", "Running")
             .when(F.col("o_custkey") >= 100, "PAUSED"))
    part_state = F.when(F.col("l_linestatus") == "O", "running").otherwise("FAILED")
    tasks = t.orders.select("o_orderkey", state.alias("state"))
    parts = t.lineitem.select("l_orderkey", part_state.alias("part_state"))
    return agg.status_rollup(tasks, parts, "o_orderkey", "state", "l_orderkey",
                             "part_state").drop("state")


@query("state_map", """
SELECT event_id, CASE event_type WHEN 'click' THEN 'RUNNING' WHEN 'signup' THEN 'UNASSIGNED'
       WHEN 'view' THEN CASE WHEN value > 30 THEN 'FINISHED' ELSE 'FAILED' END
       WHEN 'error' THEN 'FAILED'
       ELSE CASE WHEN value > 30 THEN 'CANCELED' ELSE 'OTHER' END END AS status
FROM events""")
def state_map(t):
    kind = F.col("event_type")
    state = (F.when(kind == "click", "cancelling").when(kind == "signup", "waiting")
             .when(kind == "view", "available").when(kind == "error", "error")
             .when(F.col("value") > 30, "cancelled").otherwise("other"))
    output = F.when(F.col("value") > 30, "OK").otherwise("error")
    return t.events.select("event_id", agg.statement_status(state, output).alias("status"))


@query("explode_outer_subtasks", """
SELECT doc_id, coalesce(part, '_e') AS part
FROM documents LEFT JOIN LATERAL (
  SELECT unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[0-9]'))) AS part
) ON true""")
def explode_outer_subtasks(t):
    lines = F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit("[0-9]")))
    return tf.explode_parts(t.documents.select("doc_id", lines.alias("parts")), "parts").select(
        "doc_id", "part")


@query("status_changes", """
WITH s AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'view' THEN 'RUNNING'
             WHEN 'click' THEN 'UNASSIGNED' WHEN 'purchase' THEN 'running'
             WHEN 'error' THEN 'FAILED' END AS status FROM events),
p AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old_status FROM s)
SELECT event_id, user_id, old_status, coalesce(status, 'LOST') AS new_status FROM p
WHERE upper(old_status) <> upper(coalesce(status, 'LOST'))
  AND NOT (upper(old_status) = 'RUNNING' AND upper(coalesce(status, 'LOST')) = 'UNASSIGNED')""")
def status_changes(t):
    out = ops.status_changes(with_status(t.events), ["user_id"], ["ts", "event_id"], "status")
    return out.select("event_id", "user_id", "old_status", "new_status")


def with_status(events):
    kind = F.col("event_type")
    status = (F.when(kind == "view", "RUNNING").when(kind == "click", "UNASSIGNED")
              .when(kind == "purchase", "running").when(kind == "error", "FAILED"))
    return events.select("event_id", "user_id", "ts", status.alias("status"))


@query("guarded_changes", """
SELECT l_orderkey, l_linenumber,
  CASE l_linestatus WHEN 'O' THEN 'RUNNING' ELSE l_linestatus END AS old_status,
  CASE o_orderstatus WHEN 'P' THEN 'UNASSIGNED' WHEN 'O' THEN 'running' ELSE o_orderstatus END AS new_status
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE NOT (l_linestatus = 'O' AND o_orderstatus = 'O') AND NOT (l_linestatus = 'F' AND o_orderstatus = 'F')
  AND l_partkey % 2 = l_suppkey % 2""")
def guarded_changes(t):
    old_code = F.concat(F.lit("CODE"), (F.col("l_partkey") % 2).cast("string"))
    new_code = F.concat(F.lit("code"), (F.col("l_suppkey") % 2).cast("string"))
    seen = F.col("o_orderstatus")
    new = F.when(seen == "P", "UNASSIGNED").when(seen == "O", "running").otherwise(seen)
    old = F.when(F.col("l_linestatus") == "O", "RUNNING").otherwise(F.col("l_linestatus"))
    now = t.orders.select("o_orderkey", new.alias("new_status"))
    both = t.lineitem.join(now, F.col("l_orderkey") == F.col("o_orderkey")).withColumn(
        "old_status", old)
    changed = ops.guarded_change(F.col("old_status"), F.col("new_status"), old_code, new_code)
    return both.where(changed).select("l_orderkey", "l_linenumber", "old_status", "new_status")


@query("config_changes", """
SELECT o_orderkey,
       '{"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}' AS old_config,
       '{"priority":"' || o_orderpriority || '","status":"' ||
         CASE WHEN o_totalprice > 250000 THEN 'X' ELSE o_orderstatus END || '"}' AS new_config
FROM orders WHERE o_totalprice > 250000""")
def config_changes(t):
    old = F.create_map(F.lit("status"), F.col("o_orderstatus"),
                       F.lit("priority"), F.col("o_orderpriority"))
    status = F.when(F.col("o_totalprice") > 250000, "X").otherwise(F.col("o_orderstatus"))
    new = F.create_map(F.lit("priority"), F.col("o_orderpriority"), F.lit("status"), status)
    return ops.config_changes(t.orders.select("o_orderkey", old.alias("config")),
                              t.orders.select("o_orderkey", new.alias("config")),
                              "o_orderkey", "config")


@query("refresh_needed", """
SELECT event_id, event_type FROM events WHERE event_type IN ('view', 'click', 'purchase')""")
def refresh_needed(t):
    kind = F.col("event_type")
    status = (F.when(kind == "view", "running").when(kind == "click", "LOST")
              .when(kind == "purchase", "Streaming").otherwise("FINISHED"))
    return t.events.where(ops.needs_refresh(status)).select("event_id", "event_type")


@query("keyword_search", """
SELECT conv_id, turn, role FROM conversations
WHERE role = 'user' AND contains(CAST(to_json(struct_pack(conv_id := conv_id, turn := turn,
      role := role, text := text)) AS VARCHAR), 'tion')""")
def keyword_search(t):
    return tf.search_records(t.conversations, "tion", role="user").select(
        "conv_id", "turn", "role")


@query("any_col_contains", """
SELECT p_partkey, p_name, p_type FROM part
WHERE contains(p_name, 'ring') OR contains(p_type, 'NOM') OR contains(p_brand, '#12')""")
def any_col_contains(t):
    hit = tf.contains_any(["p_name"], "ring") | tf.contains_any(["p_type"], "NOM") | (
        tf.contains_any(["p_brand"], "#12"))
    return t.part.where(hit).select("p_partkey", "p_name", "p_type")


@query("ne_keep_null", """
SELECT event_id, nullif(event_type, 'signup') AS level FROM events
WHERE nullif(event_type, 'signup') IS DISTINCT FROM 'click'""")
def ne_keep_null(t):
    df = t.events.select("event_id", F.nullif("event_type", F.lit("signup")).alias("level"))
    return df.where(tf.not_equal("level", "click"))


@query("name_pattern", """
SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)^S.*(RING|widget)$')
AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')""")
def name_pattern(t):
    named = t.part.where(tf.name_matches("p_name", "^S.*(RING|widget)$"))
    return named.where(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3")).select(
        "p_partkey", "p_name")


@query("log_search", """
SELECT conv_id, turn, role, text FROM conversations
WHERE role IS DISTINCT FROM 'assistant' AND (contains(text, 'ou') OR contains(role, 'ou'))""")
def log_search(t):
    found = ops.search_logs(t.conversations, "role", "ou", hidden="assistant")
    return tf.sort_by(found, "conv_id", tiebreak=["turn"])


@query("log_by_task", """
SELECT doc_id, lang FROM documents WHERE contains(text, 'ation')""")
def log_by_task(t):
    return ops.logs_of_task(t.documents, "text", "ation").select("doc_id", "lang")


NAIVE_BAYES = """
WITH x AS (SELECT row_number() OVER () AS row, l_orderkey, l_linenumber, l_returnflag AS label, l_quantity AS a,
                  l_extendedprice / 1000 AS b, l_discount AS c, l_tax AS d FROM lineitem),
s AS (SELECT label, count(*) AS n, sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(d) AS d
      FROM x GROUP BY label),
w AS (SELECT label, ln(n + 1.0) - ln((SELECT sum(n) + count(*) FROM s)) AS pi,
             ln(a + 1) - ln(a + b + c + d + 4) AS wa, ln(b + 1) - ln(a + b + c + d + 4) AS wb,
             ln(c + 1) - ln(a + b + c + d + 4) AS wc, ln(d + 1) - ln(a + b + c + d + 4) AS wd
      FROM s)
SELECT l_orderkey, l_linenumber, x.label AS l_returnflag, x.a AS l_quantity,
       arg_max(w.label, pi + x.a * wa + x.b * wb + x.c * wc + x.d * wd) AS predicted
FROM x, w GROUP BY row, l_orderkey, l_linenumber, x.label, x.a"""


@query("ml_nb_score", NAIVE_BAYES)
def ml_nb_score(t):
    # The whole table trains and is scored, as the guided recipe does.
    data = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity",
                             (F.col("l_extendedprice") / 1000).alias("price"),
                             "l_discount", "l_tax")
    model = naive_bayes_pipeline("l_returnflag", ["l_quantity", "price", "l_discount", "l_tax"],
                                 100, data)
    return model.transform(data).select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity",
                                        "predicted")


@query("ml_sql_score", NAIVE_BAYES)
def ml_sql_score(t):
    """The same model, kept under a name and called from SQL."""
    t.lineitem.selectExpr("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice / 1000 AS price",
                          "l_discount", "l_tax").createOrReplaceTempView("model_lines")
    data = t.spark.table("model_lines")
    models = Models(t.spark, fresh_dir(t.spark, "models"))
    models.save("flags", naive_bayes_pipeline("l_returnflag", ["l_quantity", "price", "l_discount", "l_tax"],
                                              100, data), udf="predict_flag")
    models.register("flags")
    return t.spark.sql("""SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity,
                                 predict_flag(l_quantity, price, l_discount, l_tax) AS predicted FROM model_lines""")
