"""Payloads of events and nested results of orders, as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.operators import payloads
from lapwing.sources.tables import table

C = F.col


def event_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Each event's props merged into a payload with a nested object, in canonical form: hash, stripped form, key tests and values."""
    e = table(spark, d, "events")
    tags = F.array(F.col("event_type"), F.lit(None).cast("string"))
    user = F.struct(F.when(C("user_id") % 3 > 0, C("user_id")).alias("id"), tags.alias("tags"), F.lit('a "b\\', ).alias("note"))
    made = F.to_json(F.struct(C("event_type").alias("type"), user.alias("user"), F.when(C("value") > 5, F.round(C("value") * 100).cast("long")).alias("cents"), F.lit(7).alias("k")), {"ignoreNullFields": "false"})
    rows = e.select("event_id", payloads.merged(made, C("props")).alias("payload"))
    return rows.select("event_id", "payload", payloads.digest(C("payload")).alias("digest"), payloads.strip_nulls(C("payload")).alias("stripped"), payloads.has_key(C("payload"), "cents").alias("has_cents"), payloads.text_at(C("payload"), "$.user.tags[0]").alias("tag"), payloads.text_at(C("payload"), "$.cents").alias("cents"))


def nested_orders(spark: SparkSession, d: str) -> DataFrame:
    """Each customer with its finished orders as a JSON array, the latest first; [] for those without."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus", F.struct(C("o_orderkey").alias("order"), F.to_date("o_orderdate").alias("day"), C("o_orderpriority").alias("priority")).alias("o"))
    each = o.groupBy("o_custkey").agg(payloads.nested(C("o"), where=C("o_orderstatus") == "F", order=["-day", "order"]).alias("orders"))
    return table(spark, d, "customer").select("c_custkey").join(each, C("c_custkey") == C("o_custkey"), "left").select("c_custkey", F.coalesce("orders", F.lit("[]")).alias("orders"))


def versions(spark: SparkSession, d: str) -> DataFrame:
    """A log of what each user's events said, after three deliveries: the first half of January, everything, and everything again."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts", F.concat(F.lit('{"type": "'), "event_type", F.lit('", "props": '), "props", F.lit("}")).alias("payload"))
    early = payloads.append_versions(None, e.where("ts < '2024-01-16'"), "user_id", "payload", "event_id")
    later = payloads.append_versions(early, e, "user_id", "payload", "event_id")
    log = early.unionByName(later)
    return log.unionByName(payloads.append_versions(log, e, "user_id", "payload", "event_id")).select("user_id", "hash", "payload", "event_id")


QUERIES = {"X42_X43_event_payloads": event_payloads, "A8_A9_nested_orders": nested_orders, "S16_R9_versions": versions}

ORACLE_SQL = {
    "X42_X43_event_payloads": r"""
        WITH e AS (SELECT event_id, event_type AS t, props->>'$.k' AS k, CASE WHEN user_id % 3 > 0 THEN user_id END AS u, CASE WHEN value > 5 THEN round(value * 100)::BIGINT END AS c FROM events),
        p AS (SELECT *, '{"cents":' || coalesce(c::VARCHAR, 'null') || ',"k":' || k || ',"type":"' || t || '","user":{"id":' || coalesce(u::VARCHAR, 'null') || ',"note":"a \"b\\","tags":["' || t || '",null]}}' AS payload FROM e)
        SELECT event_id, payload, sha256(payload) AS digest,
               '{' || CASE WHEN c IS NULL THEN '' ELSE '"cents":' || c || ',' END || '"k":' || k || ',"type":"' || t || '","user":{' || CASE WHEN u IS NULL THEN '' ELSE '"id":' || u || ',' END || '"note":"a \"b\\","tags":["' || t || '",null]}}' AS stripped,
               true AS has_cents, t AS tag, c::VARCHAR AS cents FROM p""",
    "A8_A9_nested_orders": """
        SELECT c_custkey, coalesce(to_json(list({'order': o_orderkey, 'day': o_orderdate::DATE, 'priority': o_orderpriority} ORDER BY o_orderdate::DATE DESC, o_orderkey) FILTER (o_orderstatus = 'F'))::VARCHAR, '[]') AS orders
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
    "S16_R9_versions": """
        WITH p AS (SELECT user_id, event_id, '{"props":{"k":' || (props->>'$.k') || '},"type":"' || event_type || '"}' AS payload FROM events)
        SELECT user_id, sha256(payload) AS hash, payload, min(event_id) AS event_id FROM p GROUP BY user_id, payload""",
}
