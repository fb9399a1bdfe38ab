"""Identity resolution: tiers of exact keys, unique matches only, fuzzy scores, contested claims, one-to-one reconciliation, components."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lapwing.operators import intervals


def unique_lookup(df: DataFrame, key: Column, value: str) -> DataFrame:
    """key, value: keys that lead to one value only."""
    found = df.select(key.alias("key"), F.col(value).alias("value")).where("key IS NOT NULL").groupBy("key")
    return found.agg(F.min("value").alias("value"), F.countDistinct("value").alias("n")).where("n = 1").drop("n")


def resolve_by_tiers(rows: DataFrame, tiers: Sequence[tuple[str, Column, DataFrame]]) -> DataFrame:
    """rows with resolved and method. Each tier: name, key of the row, lookup(key, value); the first tier that knows the key wins."""
    out, picks = rows, []
    for i, (name, key, lookup) in enumerate(tiers):
        known = lookup.select(F.col("key").alias(f"__k{i}"), F.col("value").alias(f"__v{i}"))
        out = out.withColumn(f"__q{i}", key)
        out = out.join(known, F.col(f"__q{i}") == F.col(f"__k{i}"), "left")
        picks.append((name, F.col(f"__v{i}")))
    method = F.coalesce(*[F.when(v.isNotNull(), F.lit(name)) for name, v in picks])
    out = out.withColumn("resolved", F.coalesce(*[v for _, v in picks])).withColumn("method", method)
    return out.drop(*[f"__{x}{i}" for i in range(len(picks)) for x in "qkv"])


def best_unique(pairs: DataFrame, key: str, score: Column, least: float | None = None) -> DataFrame:
    """The best-scored pair of each key, if no other pair scores as well."""
    w = Window.partitionBy(key)
    scored = pairs.withColumn("score", score)
    scored = scored.where(F.col("score") >= least) if least is not None else scored
    top = scored.withColumn("__top", F.max("score").over(w)).where("score = __top").withColumn("__n", F.count(F.lit(1)).over(w))
    return top.where("__n = 1").drop("__top", "__n")


def one_claimant(df: DataFrame, target: str) -> DataFrame:
    """Rows whose target no other row claims."""
    return df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(target))).where("__n = 1").drop("__n")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def tokens(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda x: x != ""))


def token_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token arrays."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def reconcile(source: DataFrame, local: DataFrame, key: Sequence[str], score: Column, source_id: str, local_id: str, days: tuple[str, str, int] | None = None) -> DataFrame:
    """Greedy one-to-one matching within equal keys: source_id, local_id, score; the best-scored pairs first, ties to smaller ids.

    days: date columns of source and local and the days within which they must lie; candidates are then joined by blocks of days.
    Each round takes every pair that is the best of both its sides; a round's table is cut off its lineage. As in the greedy order a
    pair that is best for both sides is always taken, rounds give the greedy result. Where all of some sources tie with all of some locals, and with
    nothing else, at the best score of each, the greedy order takes them rank by rank, and one round takes them all. Rounds end when no candidate is left.
    """
    _checkpoints(source.sparkSession)
    met = intervals.overlapping(source, local, (days[0],) * 2, (days[1],) * 2, days[2], keys=list(key)) if days else source.join(local, list(key))
    left, found, n = met.select(source_id, local_id, score.alias("score")).where("score > 0").checkpoint(), None, 0
    order = [F.desc("score"), F.col(source_id), F.col(local_id)]
    while True:
        by_s, by_l = Window.partitionBy(source_id), Window.partitionBy(local_id)
        best = left.withColumn("__s", F.row_number().over(by_s.orderBy(*order))).withColumn("__l", F.row_number().over(by_l.orderBy(*order)))
        best = best.withColumn("__ts", F.max("score").over(by_s) == F.col("score")).withColumn("__tl", F.max("score").over(by_l) == F.col("score"))
        best = best.where("__ts OR __tl")
        # what a side ties with at its best score, as a hash of the set
        best = best.withColumn("__hs", F.struct(*_set_hash(local_id, "__ts", by_s))).withColumn("__hl", F.struct(*_set_hash(source_id, "__tl", by_l)))
        same_l = (F.min(F.when(F.col("__ts"), F.col("__hl"))).over(by_s) == F.max(F.when(F.col("__ts"), F.col("__hl"))).over(by_s)) & F.min(F.when(F.col("__ts"), F.col("__tl"))).over(by_s)
        same_s = (F.min(F.when(F.col("__tl"), F.col("__hs"))).over(by_l) == F.max(F.when(F.col("__tl"), F.col("__hs"))).over(by_l)) & F.min(F.when(F.col("__tl"), F.col("__ts"))).over(by_l)
        closed = F.col("__ts") & F.col("__tl") & F.col("__cs") & F.col("__cl") & (F.col("__s") == F.col("__l"))
        taken = best.withColumn("__cs", same_l).withColumn("__cl", same_s).where(closed | (F.col("__s") + F.col("__l") == 2)).select(source_id, local_id, "score").checkpoint()
        found, n = (taken if found is None else found.unionByName(taken)), n + 1
        found = found if n % 16 else found.checkpoint()
        left = left.join(taken.select(source_id), source_id, "left_anti").join(taken.select(local_id), local_id, "left_anti").checkpoint()
        if left.isEmpty():
            return found


def _set_hash(member: str, of: str, over) -> list[Column]:
    """Size and two hashes of the set of members where of holds."""
    held = lambda x: F.when(F.col(of), x)
    return [F.count(held(F.lit(1))).over(over).alias("c"), F.bit_xor(held(F.xxhash64(member))).over(over).alias("x"), F.bit_xor(held(F.xxhash64(F.lit("b"), member))).over(over).alias("y")]


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node that each node of edges(a, b) reaches. Labels spread along edges and then jump to their label's label, so
    the number of rounds follows the logarithm of the longest chain in practice."""
    _checkpoints(edges.sparkSession)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")).checkpoint()
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        spread = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        ahead = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = spread.join(ahead, "root").select("node", "old", F.least("root", "next").alias("root")).checkpoint()
        if new.where("old <> root").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")


def _checkpoints(spark) -> None:
    """Checkpoints go to the folder that the cluster names; to one of our own only where none is named and all runs on this machine (tests)."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="lapwing-"))
