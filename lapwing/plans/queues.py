"""Positions of orders: group numbers, pages with a total, and jobs claimed by suppliers; a queue of customers patched by probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.operators import probes, ranks
from lapwing.sources.tables import table

C = F.col


def order_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every order with the number of its customer and priority, where low ones have no priority."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"))
    return ranks.group_numbers(o, ["o_custkey", "priority"])


def page_with_total(spark: SparkSession, d: str) -> DataFrame:
    """Orders 101 to 150 by date, newest first, with their positions and the number of all."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    return ranks.page(o, [F.desc("day"), C("o_orderkey")], 100, 50)


def claimed_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders as jobs by priority, attempts, date and key, claimed by suppliers on 1 January 1998: finished ones are leased until 30 days after their date, those in progress are done."""
    o = table(spark, d, "orders")
    state = F.when(C("o_orderstatus") == "O", "open").when(C("o_orderstatus") == "F", "leased").otherwise("done")
    day = F.to_date("o_orderdate")
    jobs = o.select(C("o_orderkey").alias("job"), "o_orderpriority", day.alias("day"), state.alias("state"), (C("o_custkey") % 7).cast("int").alias("attempts"), F.when(state == "leased", F.date_add(day, 30)).alias("until"), F.when(state == "leased", C("o_custkey") % 10).alias("worker"))
    workers = table(spark, d, "supplier").select(C("s_suppkey").alias("worker"), (C("s_nationkey") % 4).alias("slots"))
    return ranks.claim(jobs, workers, F.lit("1998-01-01").cast("date"), 7, order=[C("o_orderpriority"), C("attempts"), C("day"), C("job")]).select("job", "state", "attempts", "until", "worker", "token")


def probed_customers(spark: SparkSession, d: str) -> DataFrame:
    """Customers as meets of a recovery queue, orders as runs whose scope names their customer and the next: every state after all runs, and whether it changed."""
    c = table(spark, d, "customer")
    k = C("c_custkey")
    queue = c.select(
        k.alias("meet"), F.when(C("c_mktsegment") == "BUILDING", "complete").when(C("c_mktsegment") == "MACHINERY", "partial").otherwise("queued").alias("status"), F.lit("unknown").alias("relay_coverage"), F.lit(True).alias("needs_relays"),
        (C("c_acctbal") > 4000).alias("needs_individual"), (C("c_nationkey") % 2).cast("long").alias("n_relay_facts"), F.when(C("c_nationkey") == 7, k).alias("n_quarantined"), F.lit("timeout").alias("last_error"), F.lit(None).cast("long").alias("run_id"),
    )
    seen, relays = F.floor(C("o_totalprice") / 1000), F.floor(C("o_totalprice")) % 3
    scope = F.concat(F.lit('{"relays_only": '), F.when(C("o_orderpriority") == "1-URGENT", "false").otherwise("true"), F.lit(', "source_observation_count": '), seen.cast("string"), F.lit(', "source_relay_observation_count": '), relays.cast("string"), F.lit(', "meet_ids": ['), C("o_custkey").cast("string"), F.lit(", "), (C("o_custkey") + 1).cast("string"), F.lit("]}"))
    runs = table(spark, d, "orders").select(C("o_orderkey").alias("run_id"), F.to_date("o_orderdate").alias("at"), F.when(C("o_orderstatus") == "F", "apply").otherwise("dry_run").alias("mode"), F.lit("succeeded").alias("status"), scope.alias("scope"))
    return probes.apply_probes(queue, runs).select("meet", "after.*", "changed")


QUERIES = {"M11_probed_customers": probed_customers, "W7_order_groups": order_groups, "T3_page_with_total": page_with_total, "T9_R6_claimed_orders": claimed_orders}

ORACLE_SQL = {
    "W7_order_groups": "SELECT o_orderkey, o_custkey, nullif(o_orderpriority, '5-LOW') AS priority, dense_rank() OVER (ORDER BY o_custkey NULLS FIRST, nullif(o_orderpriority, '5-LOW') NULLS FIRST) AS group_no FROM orders",
    "T3_page_with_total": """
        SELECT * FROM (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS day, row_number() OVER (ORDER BY o_orderdate::DATE DESC, o_orderkey) AS position, count(*) OVER () AS total FROM orders) WHERE position BETWEEN 101 AND 150""",
    "T9_R6_claimed_orders": """
        WITH j AS (SELECT o_orderkey AS job, o_orderpriority AS p, o_orderdate::DATE AS day, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'leased' ELSE 'done' END AS s, (o_custkey % 7)::INT AS attempts, o_custkey % 10 AS w FROM orders),
        f AS (SELECT *, CASE WHEN s = 'leased' AND day + 30 >= DATE '1998-01-01' THEN 'leased' WHEN s IN ('leased', 'open') THEN CASE WHEN attempts >= 5 THEN 'failed' ELSE 'open' END ELSE s END AS state FROM j),
        q AS (SELECT job, row_number() OVER (ORDER BY p, attempts, day, job) AS turn FROM f WHERE state = 'open'),
        k AS (SELECT s_suppkey AS worker, row_number() OVER (ORDER BY slot, s_suppkey) AS turn FROM (SELECT s_suppkey, unnest(range(1, s_nationkey % 4 + 1)) AS slot FROM supplier)),
        t AS (SELECT job, worker FROM q JOIN k USING (turn))
        SELECT f.job, CASE WHEN t.job IS NOT NULL THEN 'leased' ELSE state END AS state, attempts + (t.job IS NOT NULL)::INT AS attempts, CASE WHEN t.job IS NOT NULL THEN DATE '1998-01-08' WHEN state = 'leased' THEN day + 30 END AS until,
               coalesce(t.worker, CASE WHEN state = 'leased' THEN w END) AS worker, CASE WHEN t.job IS NOT NULL THEN sha256(f.job || '|' || (attempts + 1) || '|' || t.worker) END AS token FROM f LEFT JOIN t ON t.job = f.job""",
    "M11_probed_customers": """
        WITH q AS (SELECT c_custkey AS meet, CASE c_mktsegment WHEN 'BUILDING' THEN 'complete' WHEN 'MACHINERY' THEN 'partial' ELSE 'queued' END AS status, c_acctbal > 4000 AS i, c_nationkey % 2 AS facts, CASE WHEN c_nationkey = 7 THEN c_custkey END AS held FROM customer),
        r AS (SELECT o_orderkey AS run_id, unnest([o_custkey, o_custkey + 1]) AS meet, floor(o_totalprice)::BIGINT % 3 AS relays, o_orderdate::DATE AS day FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority <> '1-URGENT' AND floor(o_totalprice / 1000) > 0),
        m AS (SELECT r.*, row_number() OVER (PARTITION BY meet ORDER BY day, run_id) AS n, relays = 0 AND coalesce(held, 0) = 0 AND NOT i AS closes FROM r JOIN q USING (meet) WHERE status <> 'complete'),
        a AS (SELECT m.* FROM m WHERE NOT EXISTS (SELECT 1 FROM m x WHERE x.meet = m.meet AND x.closes AND x.n < m.n)),
        l AS (SELECT meet, arg_max(relays, n) AS r, arg_max(run_id, n) AS last_run, min(relays) AS least, bool_or(closes) AS closed FROM a GROUP BY meet)
        SELECT q.meet, CASE WHEN last_run IS NULL THEN status WHEN held > 0 THEN 'partial' WHEN closed THEN 'complete' ELSE status END AS status, CASE WHEN last_run IS NULL THEN 'unknown' WHEN r > 0 THEN 'present' ELSE 'absent' END AS relay_coverage,
               CASE WHEN last_run IS NULL THEN true ELSE r > 0 AND facts = 0 END AS needs_relays, CASE WHEN last_run IS NULL THEN 'timeout' WHEN held > 0 THEN 'source_observations_quarantined=' || held WHEN least = 0 THEN NULL ELSE 'timeout' END AS last_error, last_run AS run_id, last_run IS NOT NULL AS changed
        FROM q LEFT JOIN l USING (meet)""",
}
