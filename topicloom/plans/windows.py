"""Row-frame, ranking and time-window queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from topicloom.operators.aggregates import (
    merge_sketches,
    quantiles,
    sessions,
    sketches,
    slide,
    tumble,
)
from topicloom.operators.ordered import ntiles, over_last_rows, ranks, running_sums
from topicloom.plans.registry import query


@query("over_rows", """
SELECT event_id, user_id, count(value) OVER w AS recent,
       round(sum(value) OVER w, 4) AS recent_value
FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def over_rows(t):
    out = over_last_rows(
        t.events.select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts", "event_id"], 2,
        {"recent": lambda w: F.count("value").over(w.rowsBetween(-2, 0)),
         "recent_value": lambda w: F.round(F.sum("value").over(w.rowsBetween(-2, 0)), 4)})
    return out.select("event_id", "user_id", "recent", "recent_value")


@query("win_lag", """
SELECT event_id, lag(value) OVER w AS previous, lag(event_type, 2, 'none') OVER w AS before_that,
       epoch_us(ts) - epoch_us(lag(ts) OVER w) AS silence
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def win_lag(t):
    df = t.events.select("event_id", "user_id", "ts", "event_type", "value",
                         F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    out = over_last_rows(df, ["user_id"], ["ts", "event_id"], 2, {
        "previous": lambda w: F.lag("value").over(w),
        "before_that": lambda w: F.coalesce(F.lag("event_type", 2).over(w), F.lit("none")),
        "silence": lambda w: F.col("us") - F.lag("us").over(w)})
    return out.select("event_id", "previous", "before_that", "silence")


@query("win_rank", """
SELECT event_id, event_type, value,
       row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS row_number,
       rank() OVER (PARTITION BY event_type ORDER BY value) AS rank,
       dense_rank() OVER (PARTITION BY event_type ORDER BY value) AS dense_rank
FROM events""")
def win_rank(t):
    df = t.events.select("event_id", "event_type", "value")
    numbered = running_sums(df, ["event_type"], ["value", "event_id"],
                            {"row_number": F.lit(1).cast("long")})
    return ranks(numbered, ["event_type"], "value")


@query("win_ntile", """
SELECT o_orderkey, CAST(ntile(7) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey)
       AS INTEGER) AS seventh
FROM orders""")
def win_ntile(t):
    df = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
    return ntiles(df, ["o_orderpriority"], ["o_totalprice", "o_orderkey"], 7, "seventh").select(
        "o_orderkey", "seventh")


@query("win_lead", """
SELECT event_id, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type
FROM events""")
def win_lead(t):
    # The next row is the previous one in reverse order.
    df = t.events.select("event_id", "user_id", "event_type",
                         (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("back"),
                         (-F.col("event_id")).alias("back_id"))
    out = over_last_rows(df, ["user_id"], ["back", "back_id"], 1,
                         {"next_type": lambda w: F.lag("event_type").over(w)})
    return out.select("event_id", "next_type")


@query("win_first_last", """
SELECT event_id, first_value(value) OVER w AS first_value, last_value(value) OVER w AS last_value
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id
                         ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def win_first_last(t):
    # One row per key is enough to know both ends.
    at = F.struct("ts", "event_id")
    ends = t.events.groupBy(F.col("user_id").alias("k")).agg(
        F.min_by("value", at).alias("first_value"), F.max_by("value", at).alias("last_value"))
    return (
        t.events.select("event_id", "user_id")
        .join(ends, F.col("user_id").eqNullSafe(F.col("k"))).drop("user_id", "k")
    )


@query("win_running", """
SELECT o_orderkey, o_custkey,
       round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS spent
FROM orders""")
def win_running(t):
    df = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    out = running_sums(df, ["o_custkey"], ["o_orderdate", "o_orderkey"],
                       {"spent": F.col("o_totalprice")})
    return out.select("o_orderkey", "o_custkey", F.round("spent", 2).alias("spent"))


@query("win_range", """
WITH hourly AS (SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS n
                FROM events GROUP BY ALL)
SELECT user_id, hour, n, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY hour
       RANGE BETWEEN INTERVAL 23 HOURS PRECEDING AND CURRENT ROW) AS BIGINT) AS last_day
FROM hourly""")
def win_range(t):
    # Hours are summed before the ordered step: a key has at most one row per hour there.
    hourly = tumble(t.events, "ts", "1 hour", ["user_id"], n=F.count("*"))
    number = F.unix_seconds(F.col("window_start").cast("timestamp")) / 3600
    day = Window.partitionBy("user_id").orderBy("h").rangeBetween(-23, 0)
    return (
        hourly.withColumn("h", number.cast("long")).withColumn("last_day", F.sum("n").over(day))
        .select("user_id", F.col("window_start").alias("hour"), "n", "last_day")
    )


@query("tumble_sum", """
SELECT date_trunc('minute', ts) AS window_start, event_type, count(*) AS n,
       round(sum(value), 2) AS total_value
FROM events GROUP BY 1, 2""")
def tumble_sum(t):
    return tumble(t.events, "ts", "1 minute", ["event_type"], n=F.count("*"),
                  total_value=F.round(F.sum("value"), 2))


@query("slide_sum", """
SELECT time_bucket(INTERVAL 15 MINUTES, ts) - i * INTERVAL 15 MINUTES AS window_start,
       event_type, count(*) AS n, round(sum(value), 2) AS total
FROM events, (SELECT unnest([0, 1, 2, 3]) AS i) GROUP BY 1, 2""")
def slide_sum(t):
    return slide(t.events, "ts", 3600, 900, ["event_type"], "value").withColumn(
        "total", F.round("total", 2)).withColumn("n", F.col("n").cast("long"))


@query("session_count", """
WITH marked AS (
  SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS is_new
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (SELECT user_id, ts, sum(is_new) OVER (PARTITION BY user_id ORDER BY ts
             ROWS UNBOUNDED PRECEDING) AS s FROM marked)
SELECT user_id, min(ts) AS session_start, max(ts) AS last_seen, count(*) AS n
FROM numbered GROUP BY user_id, s""")
def session_count(t):
    return sessions(t.events, "ts", 1800, ["user_id"])


@query("agg_percentile", """
SELECT l_returnflag, share, CASE share WHEN 0.1 THEN p[1] WHEN 0.5 THEN p[2] WHEN 0.99 THEN p[3] ELSE p[4] END
       AS l_extendedprice
FROM (SELECT l_returnflag, quantile_disc(l_extendedprice, [0.1, 0.5, 0.99, 1.0]) AS p FROM lineitem
      GROUP BY l_returnflag), (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.99::DOUBLE), (1.0::DOUBLE)) s(share)""")
def agg_percentile(t):
    """Exact quantiles; groups of over 500 values are searched by counting."""
    return quantiles(t.lineitem, ["l_returnflag"], "l_extendedprice", [0.1, 0.5, 0.99, 1.0], few=500)


@query("sketch_rollup", """
SELECT event_type, date_trunc('week', ts) AS week, count(DISTINCT date_trunc('day', ts)) AS days, true AS close
FROM events GROUP BY ALL
UNION ALL
SELECT event_type, NULL, count(DISTINCT date_trunc('day', ts)), true FROM events GROUP BY event_type""")
def sketch_rollup(t):
    """Sketches kept per day, merged per week and over all days: whether each lies within its bound."""
    events = t.events.withColumns({"day": F.date_trunc("day", F.col("ts").cast("timestamp")),
                                   "week": F.date_trunc("week", F.col("ts").cast("timestamp"))})
    daily = sketches(events, ["event_type", "week", "day"], "event_id")
    weekly = merge_sketches(daily, ["event_type", "week"])
    whole = merge_sketches(weekly.select("event_type", "sketch", F.col("parts").alias("days")), ["event_type"])
    exact = events.groupBy("event_type", "week").agg(
        F.countDistinct("event_id").alias("exact"), F.countDistinct("day").alias("days"))
    # Events have one day each, so exact counts of disjoint weeks add up.
    both = weekly.select("event_type", "week", "distinct").join(exact, ["event_type", "week"]).unionByName(
        whole.select("event_type", F.lit(None).cast("timestamp").alias("week"), "distinct").join(
            exact.groupBy("event_type").agg(F.sum("exact").alias("exact"), F.sum("days").alias("days")), "event_type"))
    near = F.abs(F.col("distinct") - F.col("exact")) <= 0.065 * F.col("exact")  # four standard errors
    return both.select("event_type", F.col("week").cast("timestamp_ntz").alias("week"), "days", near.alias("close"))
