"""Projection, filter, aggregation, set and sort queries."""

from pyspark.sql import functions as F

from topicloom.operators import transforms as tf
from topicloom.operators.aggregates import category, word_count
from topicloom.operators.ordered import except_all, intersect_all
from topicloom.plans.registry import money, query
from topicloom.sources.topics import register_views


@query("project_arith", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice * (1 - l_discount) AS net,
       l_quantity + l_tax AS total
FROM lineitem""")
def project_arith(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_quantity",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        (F.col("l_quantity") + F.col("l_tax")).alias("total"))


@query("filter_gt", "SELECT event_id, event_type, value FROM events WHERE value > 50")
def filter_gt(t):
    return tf.keep(t.events.select("event_id", "event_type", "value"), "value > 50")


@query("script_select", "SELECT event_type, value AS amount FROM events")
def script_select(t):
    tf.register_transform("pick", lambda df, columns, rename: df.select(*columns)
                          .withColumnsRenamed(rename))
    return tf.run_transform("pick", t.events, columns=["event_type", "value"],
                            rename={"value": "amount"})


@query("expression", """
SELECT event_id, value * 2 AS doubled, upper(event_type) AS kind,
       CASE WHEN value >= 50 THEN 'high' ELSE 'low' END AS band
FROM events""")
def expression(t):
    out = tf.compute(t.events, doubled="value * 2", kind=F.upper("event_type"),
                     band="CASE WHEN value >= 50 THEN 'high' ELSE 'low' END")
    return out.select("event_id", "doubled", "kind", "band")


@query("concat_fields", """
SELECT event_id, concat_ws('-', event_type, CAST(user_id AS VARCHAR), nullif(event_type, 'view'))
       AS joined
FROM events""")
def concat_fields(t):
    df = t.events.withColumn("other", F.nullif("event_type", F.lit("view")))
    return tf.concat_fields(df, "joined", ["event_type", "user_id", "other"], "-").select(
        "event_id", "joined")


@query("tag_rows", """
SELECT event_id, user_id, event_type, 'web' AS origin,
       CASE WHEN value > 80 THEN 'big' WHEN value < 5 THEN 'small' END AS size_tag
FROM events""")
def tag_rows(t):
    size = F.when(F.col("value") > 80, "big").when(F.col("value") < 5, "small")
    return tf.tag(t.events.select("event_id", "user_id", "event_type", "value"), origin="web",
                  size_tag=size).drop("value")


@query("router", """
SELECT event_id, user_id, value,
       CASE WHEN nullif(event_type, 'signup') = 'error' THEN 'alerts'
            WHEN value > 75 THEN 'large'
            WHEN event_type IN ('purchase', 'error') THEN 'sales'
            ELSE 'rest' END AS route
FROM events""")
def router(t):
    kind = F.nullif("event_type", F.lit("signup"))  # an unknown predicate is no match
    routed = tf.route(t.events, [("alerts", kind == "error"), ("large", "value > 75"),
                                 ("sales", F.col("event_type").isin("purchase", "error"))],
                      default="rest")
    return routed.select("event_id", "user_id", "value", "route")


@query("copy_fanout", """
SELECT event_id, event_type, topic FROM events, (VALUES ('audit'), ('live'), ('lake')) v(topic)""")
def copy_fanout(t):
    return tf.copy_to(t.events.select("event_id", "event_type"), ["audit", "live", "lake"])


@query("agg_sum", """
SELECT event_type, round(sum(value), 2) AS total_value FROM events GROUP BY event_type""")
def agg_sum(t):
    return t.events.groupBy("event_type").agg(money("value").alias("total_value"))


@query("agg_having", """
SELECT user_id, round(sum(value), 2) AS total_value FROM events
GROUP BY user_id HAVING sum(value) > 3300""")
def agg_having(t):
    sums = t.events.groupBy("user_id").agg(F.sum("value").alias("s"))
    return sums.where("s > 3300").select("user_id", F.round("s", 2).alias("total_value"))


@query("distinct_rows", "SELECT DISTINCT user_id, event_type FROM events")
def distinct_rows(t):
    return t.events.select("user_id", "event_type").distinct()


@query("category_counts", """
SELECT split_part(kind, '_', 1) AS category, count(*) AS total
FROM (SELECT CASE o_orderstatus WHEN 'O' THEN 'CONNECT_' WHEN 'F' THEN 'TRANSFORM_'
             ELSE 'INTERNAL_' END || o_orderpriority AS kind FROM orders)
GROUP BY 1""")
def category_counts(t):
    kind = F.concat(F.when(F.col("o_orderstatus") == "O", "CONNECT_")
                    .when(F.col("o_orderstatus") == "F", "TRANSFORM_").otherwise("INTERNAL_"),
                    "o_orderpriority")
    return t.orders.groupBy(category(kind).alias("category")).agg(F.count("*").alias("total"))


@query("agg_cube", """
SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS quantity, count(*) AS n
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def agg_cube(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").cast("long").alias("quantity"), F.count("*").alias("n"))


@query("agg_rollup", """
SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS price, count(*) AS n
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def agg_rollup(t):
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(
        money("l_extendedprice").alias("price"), F.count("*").alias("n"))


@query("agg_grouping_sets", """
SELECT event_type, user_id, count(*) AS n FROM events
GROUP BY GROUPING SETS ((event_type), (user_id), ())""")
def agg_grouping_sets(t):
    return t.events.groupingSets([["event_type"], ["user_id"], []], "event_type", "user_id").agg(
        F.count("*").alias("n"))


@query("agg_count_distinct", """
SELECT nullif(event_type, 'view') AS event_type, count(DISTINCT user_id) AS users,
       count(DISTINCT props) AS props
FROM events GROUP BY 1""")
def agg_count_distinct(t):
    # One exchange per distinct column, each summed up before it: lighter than expanding rows.
    events = t.events.withColumn("event_type", F.nullif("event_type", F.lit("view")))
    users = events.select("event_type", "user_id").distinct().groupBy("event_type").agg(
        F.count("user_id").alias("users"))
    props = events.select(F.col("event_type").alias("kind"), "props").distinct().groupBy("kind").agg(
        F.count("props").alias("props"))
    # The group without a type has to meet itself as well.
    return users.join(props, F.col("event_type").eqNullSafe(F.col("kind"))).drop("kind")


@query("agg_approx_distinct", """
SELECT l_returnflag, true AS orders_close, true AS median_close
FROM lineitem GROUP BY l_returnflag""")
def agg_approx_distinct(t):
    """Whether both sketches lie within their bounds of the exact values."""
    found = t.lineitem.groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_orderkey", 0.02).alias("orders"),
        F.percentile_approx("l_extendedprice", 0.5, 1000).alias("median"))
    exact = t.lineitem.select("l_returnflag", "l_orderkey").distinct().groupBy(
        F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("exact"))
    price = F.col("l_extendedprice")
    ranks = t.lineitem.join(found, "l_returnflag").groupBy("l_returnflag").agg(
        F.first("orders").alias("orders"), F.count("*").alias("rows"),
        F.count_if(price <= F.col("median")).alias("below"))
    return ranks.join(exact, F.col("l_returnflag") == F.col("flag")).select(
        "l_returnflag",
        (F.abs(F.col("orders") - F.col("exact")) <= 0.06 * F.col("exact")).alias("orders_close"),
        (F.abs(F.col("below") / F.col("rows") - 0.5) <= 0.002).alias("median_close"))


@query("multi_topic_union", """
SELECT user_id, round(sum(value), 2) AS total_value
FROM (SELECT user_id, value FROM events WHERE event_type IN ('view', 'click', 'signup')
      UNION ALL
      SELECT user_id, value FROM events WHERE event_type NOT IN ('view', 'click', 'signup'))
GROUP BY user_id HAVING sum(value) > 3300""")
def multi_topic_union(t):
    browsing = F.col("event_type").isin("view", "click", "signup")
    register_views({"topic_browse": t.events.where(browsing),
                    "topic_other": t.events.where(~browsing)})
    return t.spark.sql("""
        SELECT user_id, round(sum(value), 2) AS total_value
        FROM (SELECT user_id, value FROM topic_browse
              UNION ALL
              SELECT user_id, value FROM topic_other)
        GROUP BY user_id HAVING sum(value) > 3300""")


@query("union_all", """
SELECT event_id, event_type, value FROM events WHERE event_type = 'view'
UNION ALL
SELECT event_id, event_type, value FROM events WHERE event_type = 'click'""")
def union_all(t):
    df = t.events.select("event_id", "event_type", "value")
    return df.where("event_type = 'view'").unionByName(df.where("event_type = 'click'"))


@query("union_missing", """
SELECT user_id AS id, event_type AS kind, value, CAST(NULL AS VARCHAR) AS name FROM events
UNION ALL
SELECT c_custkey, c_mktsegment, NULL, c_name FROM customer""")
def union_missing(t):
    events = t.events.select(F.col("user_id").alias("id"), F.col("event_type").alias("kind"),
                             "value")
    customers = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                                  F.col("c_mktsegment").alias("kind"))
    return tf.union_topics(events, customers)


@query("set_intersect", """
SELECT l_orderkey AS k FROM lineitem INTERSECT SELECT o_orderkey FROM orders
WHERE o_orderstatus = 'F'""")
def set_intersect(t):
    finished = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"))
    # Distinct per task first, so a hot key reaches the join once per task.
    return t.lineitem.select(F.col("l_orderkey").alias("k")).distinct().intersect(
        finished.distinct())


@query("set_intersect_all", """
SELECT user_id AS k FROM events INTERSECT ALL SELECT o_custkey FROM orders""")
def set_intersect_all(t):
    left = t.events.select(F.col("user_id").alias("k"), "event_id")
    return intersect_all(left, t.orders.select(F.col("o_custkey").alias("k")), ["k"],
                         ["event_id"]).select("k")


@query("set_except", """
SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem
WHERE l_returnflag = 'R'""")
def set_except(t):
    returned = t.lineitem.where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("k")).distinct()
    return t.orders.select(F.col("o_orderkey").alias("k")).distinct().subtract(returned)


@query("set_except_all", """
SELECT user_id AS k FROM events EXCEPT ALL SELECT o_custkey FROM orders""")
def set_except_all(t):
    left = t.events.select(F.col("user_id").alias("k"), "event_id")
    return except_all(left, t.orders.select(F.col("o_custkey").alias("k")), ["k"],
                      ["event_id"]).select("k")


@query("sort_page", """
SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders
ORDER BY o_orderpriority DESC, o_orderkey""")
def sort_page(t):
    return tf.sort_by(t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority"),
                      "o_orderpriority", ascending=False, tiebreak=["o_orderkey"])


@query("sort_as_string", """
SELECT o_orderkey, o_custkey FROM orders ORDER BY CAST(o_custkey AS VARCHAR), o_orderkey""")
def sort_as_string(t):
    return tf.sort_as_text(t.orders.select("o_orderkey", "o_custkey"), "o_custkey",
                           tiebreak=["o_orderkey"])


@query("topk_preview", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""")
def topk_preview(t):
    ranked = tf.sort_by(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice",
                        ascending=False, tiebreak=["o_orderkey"])
    return tf.preview(ranked)


@query("word_count", """
SELECT word, count(*) AS frequency
FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z0-9_]+')) AS word FROM documents)
WHERE word <> '' GROUP BY word""")
def words(t):
    return word_count(t.documents, "text")
