"""Schema-subject queries. The subjects are derived from the events: one per user and type, each
event being a version of it."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.functions.types import record_fields, struct_to_avro
from topicloom.operators import subjects as sub
from topicloom.plans.registry import query

SUBJECTS_SQL = """
WITH subjects AS (
  SELECT 's' || user_id || '_' || event_type || CASE event_type WHEN 'error' THEN '-value'
           WHEN 'signup' THEN '-key' WHEN 'purchase' THEN '.df_meta' ELSE '' END AS subject,
         event_id AS version, event_id + 1 AS schema_id,
         '{"type":"record","name":"' || event_type || '","fields":[{"name":"' ||
           CASE WHEN value > 50 THEN 'large' ELSE 'small' END || '","type":"long"}]}' AS schema_json,
         CASE WHEN value > 80 THEN 'FULL' END AS compatibility
  FROM events)
"""


def subjects_of(events):
    suffix = (F.when(F.col("event_type") == "error", "-value")
              .when(F.col("event_type") == "signup", "-key")
              .when(F.col("event_type") == "purchase", ".df_meta").otherwise(""))
    field = F.when(F.col("value") > 50, "large").otherwise("small")
    return events.select(
        F.concat(F.lit("s"), F.col("user_id").cast("string"), F.lit("_"), "event_type",
                 suffix).alias("subject"),
        F.col("event_id").alias("version"), (F.col("event_id") + 1).alias("schema_id"),
        F.concat(F.lit('{"type":"record","name":"'), "event_type",
                 F.lit('","fields":[{"name":"'), field,
                 F.lit('","type":"long"}]}')).alias("schema_json"),
        F.when(F.col("value") > 80, "FULL").alias("compatibility"))


@query("latest_schema", SUBJECTS_SQL + """
SELECT subject, max(version) AS version, arg_max(schema_id, version) AS schema_id,
       arg_max(schema_json, version) AS schema_json,
       CASE WHEN max(version) = max(version) FILTER (compatibility IS NOT NULL) THEN 'FULL'
            ELSE 'NONE' END AS compatibility
FROM subjects WHERE subject NOT LIKE '%-value%' AND subject NOT LIKE '%-key%'
  AND subject NOT LIKE '%df\\_meta%' ESCAPE '\\'
GROUP BY subject""")
def latest_schema(t):
    return sub.list_subjects(subjects_of(t.events))


@query("register_absent", SUBJECTS_SQL + """,
wanted AS (SELECT DISTINCT unnest(['s' || o_custkey || '_view', 's' || o_custkey || '_view-value'])
             AS subject, 'v' AS schema_json FROM orders),
absent AS (SELECT *, (SELECT max(schema_id) FROM subjects) + row_number() OVER (ORDER BY subject) AS schema_id
           FROM wanted WHERE subject NOT IN (SELECT subject FROM subjects))
SELECT subject, count(*) AS versions, min(schema_json) AS schema_json, max(schema_id)::BIGINT AS schema_id FROM (
  SELECT subject, schema_json, schema_id FROM subjects
  UNION ALL SELECT subject, schema_json, schema_id FROM absent)
GROUP BY subject""")
def register_absent(t):
    name = F.concat(F.lit("s"), F.col("o_custkey").cast("string"), F.lit("_view"))
    wanted = t.orders.select(name.alias("subject"), F.lit("v").alias("schema_json"))
    known = sub.register_absent(subjects_of(t.events), wanted)
    return known.groupBy("subject").agg(F.count("*").alias("versions"), F.min("schema_json").alias("schema_json"),
                                        F.max("schema_id").alias("schema_id"))


@query("upsert_schema", SUBJECTS_SQL + """,
changes AS (SELECT 's' || c_custkey || '_click' AS subject, c_mktsegment AS schema_json, 1 AS step FROM customer
            UNION ALL SELECT 's' || c_custkey || '_click', 'new ' || c_mktsegment, 2 FROM customer
            WHERE c_custkey % 2 = 0),
after AS (SELECT subject, version, schema_id, schema_json FROM subjects UNION ALL
          SELECT c.subject, coalesce((SELECT max(version) FROM subjects s WHERE s.subject = c.subject), 0) + step,
                 NULL, schema_json FROM changes c)
SELECT subject, max(version) AS version, arg_max(schema_json, version) AS schema_json, count(*) AS versions,
       count(schema_id) < count(*) AS has_new_id
FROM after GROUP BY subject""")
def upsert_schema(t):
    once = t.customer.select(
        F.concat(F.lit("s"), F.col("c_custkey").cast("string"), F.lit("_click")).alias("subject"),
        F.col("c_mktsegment").alias("schema_json"), F.lit("BACKWARD").alias("compatibility"),
        F.lit(1).alias("step"))
    # The same schema again is no version; every second subject gets another one after it.
    again = once.withColumn("step", F.lit(2))
    more = again.join(t.customer.where("c_custkey % 2 = 0").select(
        F.concat(F.lit("s"), F.col("c_custkey").cast("string"), F.lit("_click")).alias("subject")),
        "subject", "left_semi").withColumn("schema_json", F.concat(F.lit("new "), "schema_json")).withColumn(
        "step", F.lit(3))
    known = subjects_of(t.events)
    top = known.agg(F.max("schema_id")).first()[0]
    after = sub.upsert_schemas(known, once.union(again).unionByName(more), ["step"])
    latest = F.max_by(F.struct("version", "schema_json"), "version").alias("l")
    # New ids follow hash order, which SQL cannot restate, but they lie above all others.
    return after.groupBy("subject").agg(
        latest, F.count("*").alias("versions"), (F.max("schema_id") > F.lit(top)).alias("has_new_id")).select(
        "subject", "l.version", "l.schema_json", "versions", "has_new_id")


@query("delete_subjects", SUBJECTS_SQL + """
SELECT subject, version, schema_id FROM subjects
WHERE subject NOT IN (SELECT 's' || c_custkey || '_view' FROM customer WHERE c_mktsegment = 'BUILDING')""")
def delete_subjects(t):
    gone = t.customer.where("c_mktsegment = 'BUILDING'").select(
        F.concat(F.lit("s"), F.col("c_custkey").cast("string"), F.lit("_view")).alias("subject"))
    return sub.delete_subjects(subjects_of(t.events), gone).select(
        "subject", "version", "schema_id")


@query("schema_of_result", """
SELECT event_type, key AS field,
       CASE json_type(props, '$.' || key) WHEN 'UBIGINT' THEN 'long' WHEN 'BIGINT' THEN 'long'
            WHEN 'DOUBLE' THEN 'double' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'string' END AS avro_type,
       CASE json_type(props, '$.' || key) WHEN 'DOUBLE' THEN 'double' WHEN 'BOOLEAN' THEN 'boolean'
            ELSE 'string' END AS writeback_type, count(*) AS records
FROM (SELECT event_type, props, unnest(json_keys(props)) AS key FROM events) GROUP BY 1, 2, 3, 4""")
def schema_of_result(t):
    """Field types met in the JSON records of each topic, named as Avro types."""
    t.events.createOrReplaceTempView("topic_events")
    fields = t.spark.sql("""
        SELECT event_type, key AS field, schema_of_variant(item) AS found
        FROM topic_events, LATERAL variant_explode(parse_json(props)) AS f(pos, key, item)""")
    # JSON value types as column types; their Avro names come from the type tables.
    columns = {"BIGINT": T.LongType(), "DECIMAL": T.DoubleType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType(),
               "OTHER": T.StringType()}
    struct = T.StructType([T.StructField(name, kind) for name, kind in columns.items()])
    found = F.regexp_extract("found", "^[A-Z]+", 0)
    found = F.when(found.isin(*columns), found).otherwise("OTHER")

    def named(dialect):
        kinds = {f["name"]: f["type"] for f in record_fields(struct_to_avro(struct, "met", dialect))}
        return F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[found]

    return fields.groupBy("event_type", "field", named("result").alias("avro_type"),
                          named("writeback").alias("writeback_type")).agg(F.count("*").alias("records"))
