"""Leaderboards on the star schema: who performed best in a date window, scored by a quadratic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lapwing.sources.tables import table

#: Coefficients a, b, c of the score a*x^2 + b*x + c by market segment; x in thousands.
COEFFICIENTS = [
    ("AUTOMOBILE", 0.011, 1.9, 3.0),
    ("BUILDING", 0.012, 1.8, 2.0),
    ("FURNITURE", 0.010, 2.0, 1.0),
    ("HOUSEHOLD", 0.013, 1.7, 4.0),
    ("MACHINERY", 0.009, 2.1, 5.0),
]


def top_performances(spark: SparkSession, sf_dir: str, start: str = "1996-01-01", end: str = "1997-12-31", k: int = 50) -> DataFrame:
    """Best-scored order of each customer in a window of dates; the top k of these."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderdate").cast("date").between(start, end))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    scores = spark.createDataFrame(COEFFICIENTS, "c_mktsegment string, a double, b double, c double")
    x = F.col("o_totalprice") / 1000.0
    scored = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(F.broadcast(scores), "c_mktsegment", "left")
        .withColumn("points", F.greatest(F.lit(0), F.round(F.col("a") * x * x + F.col("b") * x + F.col("c")).cast("int")))
        .where("points > 0")
    )
    best = scored.withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("points"), "o_orderkey"))).where("n = 1")
    named = best.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return named.orderBy(F.desc("points"), "o_orderkey").limit(k).select("o_orderkey", "o_custkey", "c_name", "n_name", "r_name", "c_mktsegment", "o_totalprice", "points")


_SCORES = ", ".join(f"('{s}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for s, a, b, c in COEFFICIENTS)

QUERIES = {"W2_top_performances": top_performances}
ORACLE_SQL = {
    "W2_top_performances": f"""
        WITH s(seg, a, b, c) AS (VALUES {_SCORES}),
        scored AS (
          SELECT o.*, cu.c_name, cu.c_nationkey, cu.c_mktsegment,
                 greatest(0, round(a * (o_totalprice / 1000.0) * (o_totalprice / 1000.0) + b * (o_totalprice / 1000.0) + c)::INT) AS points
          FROM orders o JOIN customer cu ON o_custkey = c_custkey LEFT JOIN s ON seg = c_mktsegment
          WHERE o_orderdate::DATE BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY points DESC, o_orderkey) AS n FROM scored WHERE points > 0)
        SELECT o_orderkey, o_custkey, c_name, n_name, r_name, c_mktsegment, o_totalprice, points
        FROM ranked LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
        WHERE n = 1 ORDER BY points DESC, o_orderkey LIMIT 50"""
}
