"""Positions in one order of all rows, without one task for all: ranks, group numbers, pages with a total, and jobs handed to workers.

Rows are dealt into ranges of the order; only the number of rows of each range, a row a partition, is summed up in one place. A row's position is that sum plus its place in its range.
The order must be full (end it with an id), so that a value that many rows share is split over ranges like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lapwing.operators.matching import _checkpoints

C = F.col


def ranked(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """df with the position of each row, from 1."""
    _checkpoints(df.sparkSession)
    dealt = df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()).checkpoint()
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__size"))
    before = F.sum("__size").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))  # a row a partition
    offsets = sizes.select("__range", F.coalesce(before, F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.withColumn("__own", own).join(F.broadcast(offsets), "__range").withColumn(name, C("__before") + C("__own")).drop("__range", "__own", "__before")


def group_numbers(df: DataFrame, keys: Sequence[str], name: str = "group_no") -> DataFrame:
    """df with the dense rank of its keys, nulls first and equal to one another: a number for each distinct combination."""
    numbers = ranked(df.select(*keys).distinct(), [F.asc_nulls_first(k) for k in keys], name).select(*[C(k).alias(f"__{k}") for k in keys], name)
    same = F.lit(True)
    for k in keys:
        same = same & C(k).eqNullSafe(C(f"__{k}"))
    return df.join(numbers, same).drop(*[f"__{k}" for k in keys])


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """Rows offset + 1 to offset + limit of the order, with position and the exact total of all rows."""
    at = ranked(df, order, "position")
    total = at.agg(F.count(F.lit(1)).alias("total"))
    return at.where((C("position") > offset) & (C("position") <= offset + limit)).crossJoin(F.broadcast(total))  # one row


def claim(jobs: DataFrame, workers: DataFrame, now: Column, lease_days: int, *, order: Sequence[Column], most_attempts: int = 5) -> DataFrame:
    """jobs (job, state, attempts, until, worker, ...) after a claim: each free slot of workers (worker, slots) gets one open job, the first in order to the first slots.

    A lease whose time is over goes back to open, or to failed after most_attempts. Open are jobs of state open whose attempts are fewer. A claimed job is leased until lease_days from now, with
    one attempt more and a token of its own. Slots are dealt round by round, so no worker gets a second job before each has one. Null slots count as none.
    """
    stale = (C("state") == "leased") & (C("until") < now)
    spent = C("attempts") >= most_attempts
    freed = jobs.withColumn("state", F.when(stale, F.when(spent, "failed").otherwise("open")).when((C("state") == "open") & spent, "failed").otherwise(C("state")))
    freed = freed.withColumn("worker", F.when(C("state") == "leased", C("worker"))).withColumn("until", F.when(C("state") == "leased", C("until")))
    queue = ranked(freed.where("state = 'open'"), order, "__turn").select(C("job").alias("__job"), "__turn")
    slots = workers.where("slots > 0").select(C("worker").alias("__worker"), F.explode(F.sequence(F.lit(1), C("slots").cast("int"))).alias("__slot"))
    taken = queue.join(ranked(slots, [C("__slot"), C("__worker")], "__turn"), "__turn").select("__job", "__worker")
    out = freed.join(taken, C("job") == C("__job"), "left")
    won = C("__worker").isNotNull()
    return out.select(
        *[C(c) for c in jobs.columns if c not in ("state", "attempts", "until", "worker")],
        F.when(won, "leased").otherwise(C("state")).alias("state"), (C("attempts") + won.cast("int")).alias("attempts"), F.when(won, F.date_add(now, lease_days)).otherwise(C("until")).alias("until"),
        F.coalesce("__worker", "worker").alias("worker"), F.when(won, F.sha2(F.concat_ws("|", "job", (C("attempts") + 1).cast("string"), "__worker"), 256)).alias("token"),
    )
