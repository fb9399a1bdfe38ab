"""Greedy reconciliation of tied groups and outcomes of the unmatched sides."""

import random

from pyspark.sql import functions as F

from lapwing.operators import matching
from lapwing.plans import relations


def brute(pairs):
    used, out = set(), []
    for s, f, o in sorted(pairs):
        if ("f", f) not in used and ("o", o) not in used:
            used |= {("f", f), ("o", o)}
            out.append((f, o, -s))
    return sorted(out)


def test_ties_of_any_size(spark):
    """70 sources and 75 locals that all tie (over 64 rounds of one pair each before), and small groups with ties of every shape."""
    rng = random.Random(4)
    one = [(i, 0, 0) for i in range(70)] + [(100 + i, 1 + i % 6, rng.randrange(3)) for i in range(60)]
    two = [(i, 0, 0) for i in range(75)] + [(100 + i, 1 + i % 6, rng.randrange(3)) for i in range(60)]
    a, b = spark.createDataFrame(one, "f long, k int, x int"), spark.createDataFrame(two, "o long, k int, y int")
    got = matching.reconcile(a, b, ["k"], 3 - F.abs(F.col("x") - F.col("y")), "f", "o").collect()
    want = brute([(abs(x - y) - 3, f, o) for f, k, x in one for o, m, y in two if k == m])
    assert sorted(map(tuple, got)) == want


def test_outcomes_cover_every_order(spark, sf):
    rows = relations.order_outcomes(spark, sf).collect()
    orders = {r.o_orderkey: r.o_orderstatus for r in spark.read.parquet(f"{sf}/orders.parquet").collect() if r.o_orderstatus in "FO"}
    seen = sorted([r.f_order for r in rows if r.f_order is not None] + [r.o_order for r in rows if r.o_order is not None])
    assert seen == sorted(orders)
    assert all(r.outcome == ("missing" if r.o_order is None else "extra" if r.f_order is None else "matched") for r in rows)
    assert {"matched", "missing"} <= {r.outcome for r in rows}
