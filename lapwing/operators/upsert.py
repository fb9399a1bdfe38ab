"""State that is carried forward: column-wise upserts, appended versions, counters, set differences, leases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old with the values of new that aren't null, and the new keys. Keys must be unique in each; columns are those of old."""
    rest = [c for c in old.columns if c not in keys]
    fresh = new.select(*keys, *[F.col(c).alias(f"__{c}") for c in rest])
    return old.join(fresh, list(keys), "full_outer").select(*keys, *[F.coalesce(f"__{c}", c).alias(c) for c in rest])


def append_versions(history: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of new whose keys (an id and a content hash) history doesn't hold yet, each once."""
    return new.dropDuplicates(list(keys)).join(history.select(*keys), list(keys), "left_anti")


def count_misses(before: DataFrame, misses: DataFrame, key: str) -> DataFrame:
    """key, seen_count: earlier counts plus new ones."""
    now = misses.groupBy(key).agg(F.count(F.lit(1)).alias("seen_count"))
    return before.select(key, "seen_count").unionByName(now).groupBy(key).agg(F.sum("seen_count").alias("seen_count"))


def change_set(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """key, change (added, removed, updated, unchanged), changed: names of the columns that differ."""
    a = old.select(F.col(key), F.struct(*columns).alias("__old"))
    b = new.select(F.col(key), F.struct(*columns).alias("__new"))
    fields = F.filter(F.array(*[F.when(~F.col(f"__old.{c}").eqNullSafe(F.col(f"__new.{c}")), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.size(fields) > 0, "updated").otherwise("unchanged")
    both = F.col("__old").isNotNull() & F.col("__new").isNotNull()
    return a.join(b, key, "full_outer").select(key, change.alias("change"), F.when(both, F.array_join(fields, ",")).alias("changed"))


def move_or_delete(rows: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with action: delete where the target holds their key already (null-safe), else move."""
    there = target.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct().withColumn("__there", F.lit(True))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    out = rows.join(there, same, "left").withColumn("action", F.when(F.col("__there"), "delete").otherwise("move"))
    return out.drop("__there", *[f"__{k}" for k in keys])


def expire_leases(queue: DataFrame, now) -> DataFrame:
    """Jobs whose lease has run out become pending again."""
    stale = (F.col("status") == "leased") & (F.col("leased_until") < now)
    return queue.withColumn("status", F.when(stale, "pending").otherwise(F.col("status"))).withColumn("leased_until", F.when(~stale, F.col("leased_until")))


def next_job(queue: DataFrame, now, most_attempts: int) -> DataFrame:
    """The job to lease next: by priority, attempts and key. One row at most."""
    free = queue.where((F.col("status") == "pending") & (F.col("attempts") < most_attempts) & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now)))
    return free.orderBy("priority", "attempts", "scope_key").limit(1)


def latest_of(df: DataFrame, keys: Sequence[str], final: str, at: str, tie: str) -> DataFrame:
    """One row for each key: a final one before a live one, then the latest."""
    w = Window.partitionBy(*keys).orderBy(F.desc(final), F.desc(at), F.desc(tie))
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
