"""Queries against their SQL on the driver's tables, and operators against literals and brute force."""

import datetime
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lapwing.functions import marks
from lapwing.operators import decisions, dedup, intervals, matching, upsert
from lapwing.plans import catalog, relations

TABLES = "region nation customer supplier part orders lineitem events pages documents benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert {c: KINDS[k] for c, k in got.dtypes} == dict(zip(want.columns, map(str, want.types)))
    order = sorted(got.columns)
    at = [want.columns.index(c) for c in order]
    assert sorted([tuple(r[c] for c in order) for r in got.collect()], key=repr) == sorted([tuple(r[i] for i in at) for r in want.fetchall()], key=repr)


def day(text):
    return datetime.date.fromisoformat(text)


def test_marks(spark):
    rows = ["10.24  (2.0)", "10.35a", "1:05:37.73", "1:00:06.1", "5.08m", "24-01.50", "15' 6.75\"", "0:00.0", "8420", "DNS", "6.88", "6.88m", None, ""]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(rows)], "i int, m string")
    out = df.select("i", marks.parse_mark(F.col("m")).alias("p"), marks.mark_key(F.col("m")).alias("k"), marks.is_status_code(F.col("m")).alias("s")).orderBy("i").collect()
    assert [r.p.seconds for r in out] == [10.24, 10.35, 3937.73, 3606.1, None, None, None, None, None, None, 6.88, None, None, None]
    assert [r.p.meters for r in out] == [None] * 4 + [5.08, 7.353, 4.743] + [None] * 4 + [6.88, None, None]
    assert out[10].k == "6.88" and out[11].k == "6.88m" and out[1].k == "10.35"
    assert [r.s for r in out][9] is True and out[12].s is None


def test_rounds_seasons_and_clock(spark):
    df = spark.createDataFrame([("Heat 2",), ("h#3",), ("Prelims",), ("Semi-Finals",), ("FINAL",), ("Flight A",), (None,)], "r string")
    assert [tuple(r.n) for r in df.select(marks.normal_round(F.col("r")).alias("n")).collect()] == [
        ("Preliminaries", 2), ("Preliminaries", 3), ("Preliminaries", None), ("Semifinals", None), ("Finals", None), ("Flight A", None), (None, None)
    ]
    one = spark.createDataFrame([(day("2025-12-06"), 3723.4567, "José  O'Neil")], "d date, s double, n string")
    d = F.col("d")
    got = one.select(marks.season_label(d), marks.season_academic(d), marks.season_start(d, 8), marks.season_environment(d), marks.clock(F.col("s")), marks.name_key(F.col("n")), marks.competition_week(d)).first()
    assert tuple(got)[:6] == ("2026 Indoor", "2025-26", day("2025-08-01"), "indoor", "62:03.46", "jose o neil")
    assert tuple(got[6]) == (day("2025-12-04"), day("2025-12-08"))


def test_keys(spark):
    df = spark.createDataFrame([("time", "6.88", 6.88, None, None), ("distance", "6.88m", None, 6.88, None), ("points", "812", None, None, 812.0), ("time", "DNS", None, None, None), ("time", None, None, None, None)], "m string, r string, s double, t double, p double")
    got = [r[0] for r in df.select(marks.stable_mark_key(*[F.col(c) for c in "mrstp"])).collect()]
    assert got == ["seconds:6.880", "meters:6.880", "points:812.000", "raw:dns", None]
    assert df.select(marks.all_or_nothing_key(F.col("m"), F.col("s"))).collect()[1][0] is None


def test_split_duplicates_keeps_every_row_once(spark):
    df = spark.createDataFrame([(1, None, 5), (1, None, 7), (2, "x", 1), (2, "y", 1)], "k int, c string, v int")
    keep, gone = dedup.split_duplicates(df, ["k", "c"], [F.desc("v")])
    assert sorted(keep.collect(), key=str) == sorted([(1, None, 7), (2, "x", 1), (2, "y", 1)], key=str) and gone.collect() == [(1, None, 5)]
    assert dedup.extra_rows(df.limit(0), ["k"]).first() == (0, 0)


def test_overlapping_against_brute_force(spark):
    rng = random.Random(3)
    base = day("2020-01-01")
    span = lambda: (lambda a: (base + datetime.timedelta(a), base + datetime.timedelta(a + rng.randrange(90))))(rng.randrange(400))
    left, right = [(i, rng.randrange(3), *span()) for i in range(60)], [(i, rng.randrange(3), *span()) for i in range(60)]
    a, b = spark.createDataFrame(left, "a int, k int, af date, at date"), spark.createDataFrame(right, "b int, k int, bf date, bt date")
    got = intervals.overlapping(a, b, ("af", "at"), ("bf", "bt"), 2, keys=["k"]).select("a", "b").collect()
    want = [(x[0], y[0]) for x in left for y in right if x[1] == y[1] and (y[2] - x[3]).days <= 2 and (x[2] - y[3]).days <= 2]
    assert sorted(map(tuple, got)) == sorted(want)


def test_reconcile_is_the_greedy_matching(spark, sf):
    found = relations.reconciled_orders(spark, sf).collect()
    rows = [r for r in spark.read.parquet(f"{sf}/orders.parquet").collect()]
    pairs = []
    for f in (r for r in rows if r.o_orderstatus == "F"):
        for o in (r for r in rows if r.o_orderstatus == "O" and r.o_custkey == f.o_custkey):
            gap = abs((f.o_orderdate.date() - o.o_orderdate.date()).days)
            if gap <= 90:
                pairs.append((-(91 - gap + 10 * (f.o_orderpriority == o.o_orderpriority)), f.o_orderkey, o.o_orderkey))
    used, want = set(), []
    for s, f, o in sorted(pairs):
        if ("f", f) not in used and ("o", o) not in used:
            used |= {("f", f), ("o", o)}
            want.append((f, o, -s))
    assert sorted(map(tuple, found)) == sorted(want) and want


def test_components_of_chains_and_cycles(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 200)]
    got = {r.node: r.root for r in matching.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 102: 100, 200: 200}
    assert matching.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_decisions(spark):
    schema = "{} actor int, event int, mark double, place int, meet int, day date"
    d = day("2024-05-10")
    obs = spark.createDataFrame([(1, 1, 1, 9.0, 1, 5, d), (2, 1, 1, 9.0, 2, 5, d), (3, 1, 1, 8.0, 1, 5, d), (4, 2, 1, 9.0, None, 5, d), (5, 3, 1, 9.0, 1, 5, d), (6, 1, 1, 9.0, 1, None, d)], schema.format("id int,"))
    facts = spark.createDataFrame([(1, 1, 9.0, 1, 5, d), (2, 1, 9.0, None, None, day("2024-05-15")), (3, 1, 9.0, 1, None, day("2024-05-15")), (3, 1, 9.0, 2, None, day("2024-05-12")), (1, 1, 8.0, 1, None, day("2024-05-18"))], schema.format(""))
    got = {r.id: (r.decision, r.reason) for r in decisions.decide(obs, facts, "id").collect()}
    assert got == {
        1: ("skip_duplicate", "same performance"), 2: ("quarantine", "place differs"), 3: ("insert", "new"), 4: ("claim", "one history row"), 5: ("quarantine", "several history rows"), 6: ("quarantine", "incomplete")
    }


def test_state_functions(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    q = spark.createDataFrame([("a", "leased", 1, 0, "2024-01-01"), ("b", "pending", 2, 0, None), ("c", "leased", 0, 0, "2024-01-03"), ("d", "pending", 0, 9, None)], "scope_key string, status string, priority int, attempts int, until string")
    q = q.select("*", F.col("until").cast("timestamp").alias("leased_until"), F.lit(None).cast("timestamp").alias("next_attempt_at"))
    free = upsert.expire_leases(q, now)
    assert {r.scope_key: r.status for r in free.collect()} == {"a": "pending", "b": "pending", "c": "leased", "d": "pending"}
    assert [r.scope_key for r in upsert.next_job(free, now, 3).collect()] == ["a"]
    v = spark.createDataFrame([(1, "x"), (1, "y")], "id int, hash string")
    assert [tuple(r) for r in upsert.append_versions(v, spark.createDataFrame([(1, "y"), (1, "z"), (1, "z")], "id int, hash string"), ["id", "hash"]).collect()] == [(1, "z")]
    misses = upsert.count_misses(spark.createDataFrame([("a", 3)], "k string, seen_count long"), spark.createDataFrame([("a",), ("b",)], "k string"), "k")
    assert {r.k: r.seen_count for r in misses.collect()} == {"a": 4, "b": 1}
