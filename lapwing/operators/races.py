"""Head-to-head of athletes: the races that two of them ran together, and who won."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

#: Fixed value: athletes whose keys lie in one stretch of so many whole numbers share a block.
STRETCH = 32


def plain_round(raw: Column) -> Column:
    """Final, Prelim (heats among them), or the round as it is written; empty for none."""
    r = F.lower(F.trim(raw))
    return F.when(raw.isNull(), "").when(r.isin("f", "final", "finals"), "Final").when(r.isin("p", "preliminary", "preliminaries") | F.startswith(r, F.lit("heat")), "Prelim").otherwise(raw)


def dated_or_alone(results: DataFrame) -> DataFrame:
    """results with meet in single spaces, without those that have no meet, or no day where the athlete has the same mark at that meet with one."""
    named = results.where("meet IS NOT NULL AND meet != ''").withColumn("meet", F.trim(F.regexp_replace("meet", r"\s+", " ")))
    dated = F.max(F.col("day").isNotNull()).over(Window.partitionBy("athlete", "meet", "mark"))
    return named.withColumn("__dated", dated).where("day IS NOT NULL OR NOT __dated").drop("__dated")


def blocks(pairs: DataFrame, results: DataFrame) -> Callable[[str], Column]:
    """Block of the athlete in a column: a stretch of whole numbers where pairs and results have such keys, else the key itself. Never null for a whole number: a filter of nulls of one side only would keep the two sides from reading results once."""
    whole = all(isinstance(df.schema[c].dataType, IntegralType) for df, c in ((pairs, "b"), (results, "athlete")))
    return lambda c: F.coalesce(F.floor(F.col(c) / STRETCH), F.lit(0)) if whole else F.col(c)


def common_races(pairs: DataFrame, results: DataFrame) -> DataFrame:
    """a, b, meet, day, round, place_a, place_b: the races of each of pairs (a, b), from results (id, athlete, meet, day, round, place, mark).

    A result of b meets those of a at the same meet and day; results without a day only meet one another. Of these it takes the one with the same round as written
    (the last by id), else the first of the same plain round, else the first final, else the first. Results that lead to one meet, day and
    plain round are one race: the first by id of b stands for it, and it counts if both have a place above zero.

    A result of a goes once to each block of its partners, with the list of them (`STRETCH` at most), not once to each partner.
    """
    rows, block = dated_or_alone(results.where("athlete IS NOT NULL")).withColumn("round", F.coalesce("round", F.lit(""))), blocks(pairs, results)
    own = lambda side: rows.select(*[F.col(x).alias(f"{side}_{x}") for x in ("id", "athlete", "meet", "day", "round", "place")])
    plain = lambda side: plain_round(F.col(f"{side}_round")).alias(f"{side}_plain")
    partners = pairs.groupBy("a", block("b").alias("to_block")).agg(F.collect_set("b").alias("partners"))
    of_a = partners.join(own("a"), F.col("a") == F.col("a_athlete")).drop("a_athlete")
    of_b = own("b").select("*", block("b_athlete").alias("b_block"), F.col("b_athlete").cast(pairs.schema["b"].dataType).alias("b"))
    same = (F.col("to_block") == F.col("b_block")) & (F.col("a_meet") == F.col("b_meet")) & F.col("a_day").eqNullSafe(F.col("b_day"))
    met = of_a.join(of_b, same & F.array_contains("partners", F.col("b"))).select("*", plain("a"), plain("b"))
    exact = F.col("a_day").isNotNull() & (F.col("a_round") == F.col("b_round"))
    rank = F.when(exact, 0).when(F.col("a_plain") == F.col("b_plain"), 1).when(F.col("a_plain") == "Final", 2).otherwise(3)
    order = F.struct(rank.alias("rank"), F.when(exact, -F.col("a_id")).otherwise(F.col("a_id")).alias("at"))
    kept = F.struct("a_meet", "a_day", F.coalesce(F.nullif("a_plain", F.lit("")), F.col("b_plain")).alias("round"), "a_place", "b_place")
    taken = met.groupBy("a", "b", "b_id").agg(F.min_by(kept, order).alias("r"))
    one = taken.groupBy("a", "b", F.col("r.a_meet").alias("meet"), F.col("r.a_day").alias("day"), F.col("r.round").alias("round")).agg(F.min_by(F.struct("r.a_place", "r.b_place"), "b_id").alias("p"))
    return one.select("a", "b", "meet", "day", "round", F.col("p.a_place").alias("place_a"), F.col("p.b_place").alias("place_b")).where("place_a > 0 AND place_b > 0")


def head_to_head(pairs: DataFrame, results: DataFrame) -> DataFrame:
    """a, b, races, wins, losses, ties of every pair, zeros where the two never met."""
    met = common_races(pairs.select("a", "b").distinct(), results).groupBy("a", "b").agg(F.count(F.lit(1)).alias("races"), F.count_if(F.col("place_a") < F.col("place_b")).alias("wins"), F.count_if(F.col("place_a") > F.col("place_b")).alias("losses"), F.count_if(F.col("place_a") == F.col("place_b")).alias("ties"))
    counts = [F.coalesce(x, F.lit(0)).alias(x) for x in ("races", "wins", "losses", "ties")]
    return pairs.select("a", "b").distinct().join(met, ["a", "b"], "left").select("a", "b", *counts)
