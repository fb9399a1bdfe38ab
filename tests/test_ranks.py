"""Positions, group numbers, pages and claims against plain Python."""

import collections
import datetime
import random

from pyspark.sql import functions as F

from lapwing.operators import ranks

DAY = datetime.date(2024, 5, 1)


def test_ranked_and_groups(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 1, 1, 1, 1, 2, 3]), rng.choice([None, "a", "b"])) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, x int, y string").repartition(7)
    got = {r.id: r["rank"] for r in ranks.ranked(df, [F.asc_nulls_first("x"), F.desc_nulls_last("y"), F.col("id")]).collect()}
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is None, [-ord(c) for c in r[2] or ""], r[0]))
    assert got == {r[0]: i for i, r in enumerate(want, 1)}
    keys = sorted({r[1:] for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    numbers = {k: i for i, k in enumerate(keys, 1)}
    groups = ranks.group_numbers(df, ["x", "y"]).collect()
    assert len(groups) == 500 and all(r.group_no == numbers[r.x, r.y] for r in groups)
    assert ranks.ranked(df.limit(0), [F.col("id")]).count() == 0 == ranks.group_numbers(df.limit(0), ["x"]).count()


def test_pages_cover_all(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(23)], "id int, x int")
    order = [F.desc("x"), F.col("id")]
    seen = [r for o in range(0, 30, 10) for r in sorted(ranks.page(df, order, o, 10).collect(), key=lambda r: r.position)]
    assert [r.id for r in seen] == [i for x in (2, 1, 0) for i in range(23) if i % 3 == x] and {r.total for r in seen} == {23}
    assert ranks.page(df.limit(0), order, 0, 10).count() == 0


def test_claims(spark):
    late, soon = DAY - datetime.timedelta(1), DAY + datetime.timedelta(1)
    rows = [(1, "open", 0, None, None, 2), (2, "open", 5, None, None, 1), (3, "leased", 1, late, 7, 3), (4, "leased", 5, late, 7, 1), (5, "leased", 1, soon, 8, 1), (6, "done", 1, None, None, 1), (7, "open", 2, None, None, 4), (8, "open", 0, None, None, 5)]
    jobs = spark.createDataFrame(rows, "job long, state string, attempts int, until date, worker long, priority int")
    workers = spark.createDataFrame([(20, 2), (10, 1), (30, 0), (40, None)], "worker long, slots int")
    got = {r.job: (r.state, r.attempts, r.until, r.worker) for r in ranks.claim(jobs, workers, F.lit(DAY), 7, order=[F.col("priority"), F.col("attempts"), F.col("job")]).collect()}
    until = DAY + datetime.timedelta(7)
    assert got == {1: ("leased", 1, until, 10), 2: ("failed", 5, None, None), 3: ("leased", 2, until, 20), 4: ("failed", 5, None, None), 5: ("leased", 1, soon, 8), 6: ("done", 1, None, None), 7: ("leased", 3, until, 20), 8: ("open", 0, None, None)}
    again = ranks.claim(spark.createDataFrame([(k, *v, 1) for k, v in got.items()], jobs.schema), workers, F.lit(DAY), 7, order=[F.col("priority"), F.col("attempts"), F.col("job")])
    tokens = [r.token for r in again.where("token IS NOT NULL").collect()]
    assert len(tokens) == len(set(tokens)) == 1
    assert max(collections.Counter(r.job for r in again.collect()).values()) == 1
