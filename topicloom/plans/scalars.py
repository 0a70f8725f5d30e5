"""One query per family of functions reachable through SQL."""

import numpy as np
from pyspark.sql import functions as F

from topicloom.functions import scalars as sc
from topicloom.functions.udfs import register_scalar, user_aggregate
from topicloom.operators.scripts import run_script
from topicloom.plans.registry import query


@query("cast_ts", """
SELECT event_id, CAST(CAST(ts AS VARCHAR) AS TIMESTAMP) AS source_time,
       TRY_CAST(props AS TIMESTAMP) AS not_a_time FROM events""")
def cast_ts(t):
    return t.events.select(
        "event_id", F.col("ts").cast("string").try_cast("timestamp_ntz").alias("source_time"),
        F.col("props").try_cast("timestamp_ntz").alias("not_a_time"))


@query("fn_string", """
SELECT doc_id, upper(lang) AS code, length(text) AS n, replace(text, chr(10), ' ') AS flat,
       split_part(source, '.', 1) AS head, substring(text, 3, 10) AS piece,
       lpad(lang, 5, '*') AS padded, reverse(source) AS backward,
       array_to_string(string_split(lang, ''), '.') AS dotted, strpos(text, 'e') AS at
FROM documents""")
def fn_string(t):
    return t.documents.select(
        "doc_id", F.upper("lang").alias("code"), F.length("text").cast("long").alias("n"),
        F.replace("text", F.lit("\n"), F.lit(" ")).alias("flat"),
        F.split_part("source", F.lit("."), F.lit(1)).alias("head"),
        F.substring("text", 3, 10).alias("piece"), F.lpad("lang", 5, "*").alias("padded"),
        F.reverse("source").alias("backward"),
        F.array_join(F.filter(F.split("lang", ""), lambda c: c != ""), ".").alias("dotted"),
        F.instr("text", "e").cast("long").alias("at"))


@query("fn_date", """
SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d,
       quarter(o_orderdate) AS q, strftime(o_orderdate, '%Y-%m') AS ym,
       CAST(last_day(o_orderdate) AS VARCHAR) AS month_end,
       CAST(CAST(o_orderdate + INTERVAL 45 DAYS AS DATE) AS VARCHAR) AS due,
       date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS days_left,
       date_trunc('month', o_orderdate) AS month_start
FROM orders""")
def fn_date(t):
    d = F.col("o_orderdate").cast("date")
    return t.orders.select(
        "o_orderkey", F.year(d).cast("long").alias("y"), F.month(d).cast("long").alias("m"),
        F.dayofmonth(d).cast("long").alias("d"), F.quarter(d).cast("long").alias("q"),
        F.date_format(d, "yyyy-MM").alias("ym"), F.last_day(d).cast("string").alias("month_end"),
        F.date_add(d, 45).cast("string").alias("due"),
        F.datediff(F.to_date(F.lit("2000-01-01")), d).cast("long").alias("days_left"),
        F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month_start"))


@query("fn_math", """
SELECT o_orderkey, abs(o_totalprice - 250000) AS distance, CAST(floor(o_totalprice) AS BIGINT) AS low,
       CAST(ceil(o_totalprice) AS BIGINT) AS high, o_orderkey % 7 AS rest, sqrt(o_orderkey) AS root,
       greatest(o_orderkey, o_custkey) AS larger, least(o_orderkey, o_custkey) AS smaller,
       CAST(sign(o_orderkey - o_custkey) AS INTEGER) AS side, o_orderkey // 7 AS whole,
       o_orderkey & o_custkey AS both_bits
FROM orders""")
def fn_math(t):
    key, cust, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    return t.orders.select(
        "o_orderkey", F.abs(price - 250000).alias("distance"), F.floor(price).alias("low"),
        F.ceil(price).alias("high"), (key % 7).alias("rest"), F.sqrt(key).alias("root"),
        F.greatest(key, cust).alias("larger"), F.least(key, cust).alias("smaller"),
        F.signum(key - cust).cast("int").alias("side"), F.expr("o_orderkey div 7").alias("whole"),
        key.bitwiseAND(cust).alias("both_bits"))


@query("fn_array", """
SELECT vec_id, len(embedding) AS n, CAST(list_max(embedding) AS DOUBLE) AS top,
       CAST(embedding[1] AS DOUBLE) AS first,
       list_contains(embedding, embedding[2]) AS holds,
       len(list_filter(embedding, lambda x: x > 0)) AS positive,
       CAST(list_sort(embedding)[1] AS DOUBLE) AS lowest,
       CAST(array_slice(embedding, 2, 3)[2] AS DOUBLE) AS third
FROM embeddings""")
def fn_array(t):
    e = F.col("embedding")
    return t.embeddings.select(
        "vec_id", F.size(e).cast("long").alias("n"), F.array_max(e).cast("double").alias("top"),
        e[0].cast("double").alias("first"), F.array_contains(e, e[1]).alias("holds"),
        F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("positive"),
        F.sort_array(e)[0].cast("double").alias("lowest"),
        F.slice(e, 2, 2)[1].cast("double").alias("third"))


@query("fn_map", """
SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority, CAST(2 AS BIGINT) AS n,
       'priority,status' AS names, o_orderstatus || '!' AS loud
FROM orders""")
def fn_map(t):
    m = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"),
                     F.col("o_orderpriority"))
    loud = F.transform_values(m, lambda k, v: F.concat(v, F.lit("!")))
    return t.orders.select(
        "o_orderkey", m["status"].alias("status"), F.element_at(m, "priority").alias("priority"),
        F.map_keys(m).alias("keys"), loud["status"].alias("loud"),
    ).select("o_orderkey", "status", "priority", F.size("keys").cast("long").alias("n"),
             F.array_join(F.sort_array("keys"), ",").alias("names"), "loud")


@query("fn_json", """
SELECT event_id, CAST(props->>'k' AS BIGINT) AS k, props->>'missing' AS missing,
       json_keys(props)[1] AS first_key
FROM events""")
def fn_json(t):
    return t.events.select(
        "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.get_json_object("props", "$.missing").alias("missing"),
        F.json_object_keys("props")[0].alias("first_key"))


@query("fn_choice", """
SELECT event_id, coalesce(nullif(event_type, 'view'), 'none') AS known,
       CASE WHEN lower(event_type) = lower('CLICK') THEN 1 ELSE -1 END AS direction
FROM events""")
def fn_choice(t):
    return t.events.select(
        "event_id",
        sc.first_known(F.nullif("event_type", F.lit("view")), F.lit("none")).alias("known"),
        sc.choose(F.col("event_type"), F.lit("CLICK"), F.lit(1), F.lit(-1)).alias("direction"))


@query("udf_sql", """
SELECT event_id, value * 1.5 + user_id AS score FROM events WHERE value * 1.5 + user_id > 60""")
def udf_sql(t):
    register_scalar(t.spark, "weigh", lambda value, user: value * 1.5 + user, "double")
    t.events.createOrReplaceTempView("topic_events")
    return t.spark.sql("SELECT event_id, score FROM (SELECT event_id, "
                       "weigh(value, user_id) AS score FROM topic_events) WHERE score > 60")


class Spread:
    """Bitwise sum, least and largest of a column of whole numbers."""

    def init(self):
        return (0, None, None)

    def update(self, state, rows):
        values = rows.iloc[:, 0].dropna().astype("int64")
        if not len(values):
            return state
        return self.merge(state, (int(np.bitwise_xor.reduce(values.to_numpy())), int(values.min()), int(values.max())))

    def merge(self, state, other):
        least = [s[1] for s in (state, other) if s[1] is not None]
        most = [s[2] for s in (state, other) if s[2] is not None]
        return (state[0] ^ other[0], min(least, default=None), max(most, default=None))

    def finish(self, state):
        return (state[0], None if state[1] is None else state[2] - state[1])


@query("udaf_sql", """
SELECT event_type, bit_xor(event_id) AS checksum, max(event_id) - min(event_id) AS spread
FROM events GROUP BY event_type HAVING max(event_id) - min(event_id) > 10""")
def udaf_sql(t):
    """A user-defined aggregate, its result used in SQL."""
    summed = user_aggregate(t.events, ["event_type"], ["event_id"], Spread(), "checksum long, spread long")
    return t.spark.sql("SELECT event_type, checksum, spread FROM {summed} WHERE spread > 10", summed=summed)


@query("sql_script", """
SELECT o_orderpriority, 'a@b;c--d' AS mark, count(*) AS n, round(sum(o_totalprice), 2) AS spent
FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""")
def sql_script(t):
    t.orders.createOrReplaceTempView("script_orders")
    return run_script(t.spark, """
        -- keep settled orders; the next statement reads them
        CREATE OR REPLACE TEMP VIEW settled AS
          SELECT * FROM script_orders WHERE o_orderstatus <> 'P'; -- ends here
        /* one row per priority; with a mark */
        SELECT o_orderpriority, 'a@b;c--d' AS mark, count(*) AS n,
               round(sum(o_totalprice), 2) AS spent
        FROM settled
        GROUP BY o_orderpriority;
        """)
