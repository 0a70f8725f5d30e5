"""Join, lookup, merge and upsert queries."""

from datetime import timedelta

from pyspark.sql import functions as F

from topicloom.functions.scalars import ALL_TOPIC_KEYS
from topicloom.operators import joins as j
from topicloom.operators.ordered import asof_join
from topicloom.plans.registry import query


def _micros(name):
    return F.unix_micros(F.col(name).cast("timestamp"))


@query("join_inner", """
SELECT o_orderkey, o_totalprice, c_name, c_mktsegment
FROM orders JOIN customer ON o_custkey = c_custkey""")
def join_inner(t):
    customers = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    return (
        t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .drop("o_custkey", "c_custkey")
    )


@query("join_left", """
SELECT c_custkey, c_name, count(o_orderkey) AS orders, round(sum(o_totalprice), 2) AS spent
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2""")
def join_left(t):
    # Orders shrink to a row per customer before the join.
    spent = t.orders.groupBy("o_custkey").agg(
        F.count("o_orderkey").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return (
        t.customer.select("c_custkey", "c_name")
        .join(spent, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey")
        .withColumn("orders", F.coalesce("orders", F.lit(0).cast("long")))
    )


@query("join_full", """
SELECT coalesce(k1, k2) AS id, parts, customers
FROM (SELECT p_size AS k1, count(*) AS parts FROM part GROUP BY 1)
FULL JOIN (SELECT c_nationkey AS k2, count(*) AS customers FROM customer GROUP BY 1) ON k1 = k2""")
def join_full(t):
    parts = t.part.groupBy(F.col("p_size").alias("id")).agg(F.count("*").alias("parts"))
    people = t.customer.groupBy(F.col("c_nationkey").alias("id")).agg(
        F.count("*").alias("customers"))
    return parts.join(people, "id", "full_outer")


@query("join_semi", """
SELECT c_custkey, c_name FROM customer
WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""")
def join_semi(t):
    large = t.orders.where("o_totalprice > 400000")
    return j.matching(t.customer.select("c_custkey", "c_name"), large, {"c_custkey": "o_custkey"})


@query("join_anti", """
SELECT c_custkey, c_name FROM customer
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""")
def join_anti(t):
    large = t.orders.where("o_totalprice > 400000")
    return j.not_matching(t.customer.select("c_custkey", "c_name"), large,
                          {"c_custkey": "o_custkey"})


@query("join_range", """
SELECT c.event_id AS click_id, p.event_id AS purchase_id, c.user_id
FROM events c JOIN events p ON c.user_id = p.user_id
 AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 2 HOURS
WHERE c.event_type = 'click' AND p.event_type = 'purchase'""")
def join_range(t):
    clicks = t.events.where("event_type = 'click'").select(
        "user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("clicked"))
    buys = t.events.where("event_type = 'purchase'").select(
        "user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("bought"))
    hours = int(timedelta(hours=2).total_seconds() * 1_000_000)
    pairs = j.interval_join(clicks, buys, ["user_id"], _micros("clicked"), _micros("bought"), 0,
                            hours)
    return pairs.select("click_id", "purchase_id", "user_id")


@query("join_asof", """
SELECT p.event_id, p.user_id, p.ts, v.event_id AS seen_id, v.value AS seen_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v
ON p.user_id = v.user_id AND p.ts >= v.ts""")
def join_asof(t):
    buys = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = t.events.where("event_type = 'view'").select("event_id", "user_id", "ts", "value")
    return asof_join(buys, views, ["user_id"], "ts", "ts",
                     {"event_id": "seen_id", "value": "seen_value"}, tie="event_id")


@query("lookup_broadcast", """
SELECT c_custkey, c_name, n_name, r_name FROM customer
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def lookup_broadcast(t):
    named = j.lookup(t.customer.select("c_custkey", "c_name", "c_nationkey"), t.nation,
                     {"c_nationkey": "n_nationkey"}, ["n_name", "n_regionkey"])
    return j.lookup(named, t.region, {"n_regionkey": "r_regionkey"}, ["r_name"]).select(
        "c_custkey", "c_name", "n_name", "r_name")


@query("lookup_growing", """
SELECT l_orderkey, l_linenumber, l_partkey, p_brand, o_orderstatus FROM lineitem
LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN orders ON l_orderkey = o_orderkey""")
def lookup_growing(t):
    # These tables grow with the data: beyond the measured bound the join shuffles instead.
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    branded = j.lookup(lines, t.part, {"l_partkey": "p_partkey"}, ["p_brand"])
    return j.lookup(branded, t.orders, {"l_orderkey": "o_orderkey"}, ["o_orderstatus"])


@query("merge_by_key", """
WITH sold AS (SELECT l_partkey AS id, max(l_returnflag) AS label, count(*) AS sold
              FROM lineitem GROUP BY 1),
people AS (SELECT c_custkey AS id, c_mktsegment AS label, c_nationkey AS nation FROM customer)
SELECT coalesce(s.id, p.id) AS id, coalesce(s.label, p.label) AS label, sold, nation
FROM sold s FULL JOIN people p ON s.id = p.id""")
def merge_by_key(t):
    sold = t.lineitem.groupBy(F.col("l_partkey").alias("id")).agg(
        F.max("l_returnflag").alias("label"), F.count("*").alias("sold"))
    people = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"),
                               F.col("c_nationkey").alias("nation"))
    return j.merge_by_key(sold, people, ["id"])


@query("upsert_latest", """
SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts,
       arg_max(event_type, (ts, event_id)) AS event_type,
       arg_max(value, (ts, event_id)) AS value
FROM events GROUP BY user_id""")
def upsert_latest(t):
    df = t.events.select("event_id", "ts", "user_id", "event_type", "value")
    return j.latest_per_key(df, ["user_id"], ["ts", "event_id"])


@query("import_upsert", """
SELECT coalesce(p_partkey, c_custkey + 1000) AS id,
       CASE WHEN p_partkey IS NULL THEN c_name ELSE p_name END AS name,
       CASE WHEN c_custkey IS NULL THEN p_brand ELSE c_mktsegment END AS status,
       CASE WHEN c_custkey IS NULL THEN p_type ELSE CAST(c_nationkey AS VARCHAR) END AS config
FROM part FULL JOIN customer ON p_partkey = c_custkey + 1000""")
def import_upsert(t):
    current = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
                            F.col("p_brand").alias("status"), F.col("p_type").alias("config"))
    incoming = t.customer.select(
        (F.col("c_custkey") + 1000).alias("id"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("status"),
        F.col("c_nationkey").cast("string").alias("config"))
    return j.import_upsert(current, incoming, "id", ["status", "config"])


@query("catalog_semi", """
SELECT p_partkey, p_type, p_brand FROM part
WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')
  AND p_type = 'ECONOMY'""")
def catalog_semi(t):
    installed = t.lineitem.where("l_returnflag = 'R'")
    listed = t.part.where("p_type = 'ECONOMY'").select("p_partkey", "p_type", "p_brand")
    return j.matching(listed, installed, {"p_partkey": "l_partkey"})


@query("lineage_topic_tasks", """
WITH uses AS (
  SELECT o_orderkey, unnest(['prio_' || o_orderpriority[1], 'state_' || o_orderstatus,
                             'cust_' || o_custkey]) AS topic FROM orders),
wanted AS (SELECT DISTINCT 'cust_' || user_id AS topic FROM events
           UNION SELECT DISTINCT 'state_' || l_returnflag FROM lineitem
           UNION SELECT DISTINCT 'state_' || l_linestatus FROM lineitem)
SELECT o_orderkey, topic FROM uses JOIN wanted USING (topic)""")
def lineage_topic_tasks(t):
    named = F.create_map(
        F.lit("topics"), F.concat(F.lit("prio_"), F.substring("o_orderpriority", 1, 1),
                                  F.lit(", state_"), "o_orderstatus"),
        F.lit("topic_out"), F.concat(F.lit("cust_"), F.col("o_custkey").cast("string")))
    tasks = t.orders.select("o_orderkey", named.alias("config"))

    def topics(df, prefix, column):
        return df.select(column).distinct().select(
            F.concat(F.lit(prefix), F.col(column).cast("string")).alias("topic"))

    wanted = topics(t.events, "cust_", "user_id").union(
        topics(t.lineitem, "state_", "l_returnflag")).union(
        topics(t.lineitem, "state_", "l_linestatus"))
    return j.topic_lineage(tasks, "config", ALL_TOPIC_KEYS, wanted).select("o_orderkey", "topic")


@query("lineage_by_text", """
SELECT o_orderkey FROM orders
WHERE contains('prio_' || o_orderpriority, 'HIGH') OR contains('cust_' || o_custkey, 'HIGH')""")
def lineage_by_text(t):
    config = F.create_map(F.lit("topics"), F.concat(F.lit("prio_"), "o_orderpriority"),
                          F.lit("topic"), F.concat(F.lit("cust_"),
                                                   F.col("o_custkey").cast("string")))
    tasks = t.orders.select("o_orderkey", config.alias("config"))
    return j.tasks_naming(tasks, "config", ALL_TOPIC_KEYS, "HIGH").select("o_orderkey")


@query("join_overlap", """
WITH a AS (SELECT event_id AS a_id, epoch_us(ts) // 1000000 AS a_from,
                  epoch_us(ts) // 1000000 + CASE WHEN event_id % 500 < 5 THEN 94608000 ELSE event_id % 600 END
                  AS a_to FROM events WHERE event_type = 'error'),
b AS (SELECT event_id AS b_id, epoch_us(ts) // 1000000 AS b_from,
             epoch_us(ts) // 1000000 + CASE WHEN event_id % 501 < 5 THEN 63072000 ELSE event_id % 601 END
             AS b_to FROM events WHERE event_type = 'purchase')
SELECT a_id, count(*) AS n, min(b_id) AS first_id, max(b_id) AS last_id
FROM a JOIN b ON a_from <= b_to AND b_from <= a_to GROUP BY a_id""")
def join_overlap(t):
    """Outages and campaigns, from seconds to years long, that were under way at the same time."""
    def spans(kind, name, every, long, short):
        start = F.unix_seconds(F.col("ts").cast("timestamp"))
        length = F.when(F.col("event_id") % every < 5, long).otherwise(F.col("event_id") % short)
        return t.events.where(F.col("event_type") == kind).select(
            F.col("event_id").alias(f"{name}_id"), start.alias(f"{name}_from"), (start + length).alias(f"{name}_to"))

    outages = spans("error", "a", 500, 94_608_000, 600)
    campaigns = spans("purchase", "b", 501, 63_072_000, 601)
    return j.overlap_join(outages, campaigns, (F.col("a_from"), F.col("a_to")), (F.col("b_from"), F.col("b_to")),
                          per=["a_id"], totals={"n": ("count", "*"), "first_id": ("min", "b_id"),
                                                "last_id": ("max", "b_id")})


@query("lineage_substring", """
WITH tasks AS (SELECT o_orderkey, 'prio_' || o_orderpriority AS a, 'cust_' || o_custkey AS b FROM orders),
topics AS (SELECT DISTINCT 'cust_' || user_id AS topic FROM events UNION SELECT '_' || o_orderpriority[1] FROM orders
           UNION SELECT 'st_1')
SELECT o_orderkey, topic FROM tasks JOIN topics ON contains(a, topic) OR contains(b, topic)""")
def lineage_substring(t):
    config = F.create_map(F.lit("topics"), F.concat(F.lit("prio_"), "o_orderpriority"),
                          F.lit("topic_out"), F.concat(F.lit("cust_"), F.col("o_custkey").cast("string")))
    tasks = t.orders.select("o_orderkey", config.alias("config"))
    topics = (
        t.events.select(F.concat(F.lit("cust_"), F.col("user_id").cast("string")).alias("topic"))
        .union(t.orders.select(F.concat(F.lit("_"), F.substring("o_orderpriority", 1, 1))))
        .union(t.orders.select(F.lit("st_1"))).distinct())
    return j.substring_lineage(tasks.select("o_orderkey", "config"), "config", ALL_TOPIC_KEYS, topics).select(
        "o_orderkey", "topic")
