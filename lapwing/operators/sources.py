"""Rows of a source against what is known: team ids by source key, name or prefix; the state of a meet after an import; repeats among relay legs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapwing.operators import matching

C = F.col


def school_key(name: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9\s]", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def teams_by_source(rows: DataFrame, teams: DataFrame) -> DataFrame:
    """rows (name, gender, source_key, state, ...) with resolved (a team_id) and method, from teams (team_id, name, gender, source_key, state).

    Of one gender, the first that leads to one team: the source key within its state, the source key, the name as written, the plain name, the plain name as the first words of a longer one.
    Rows without a gender, and keys or names that lead to several teams, find none there.
    """
    key = lambda *parts: F.when(C("gender").isNotNull(), F.concat_ws("|", *parts, "gender"))
    source = F.nullif(F.trim(C("source_key").cast("string")), F.lit(""))
    stated = F.when(source.isNotNull() & C("state").isNotNull(), key(F.upper("state"), source))
    sourced = F.when(source.isNotNull(), key(source))
    plain = F.nullif(school_key(C("name")), F.lit(""))
    written, named = F.when(plain.isNotNull(), key(F.lower("name"))), F.when(plain.isNotNull(), key(plain))
    words = F.split(school_key(C("name")), " ")
    heads = teams.withColumn("__head", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda n: F.array_join(F.slice(words, 1, n), " ")))).where(C("__head") != school_key(C("name")))
    known = [(name, k, matching.unique_lookup(teams, k, "team_id")) for name, k in (("state_key", stated), ("key", sourced), ("name", written), ("plain_name", named))]
    known.append(("prefix", named, matching.unique_lookup(heads, key("__head"), "team_id")))
    return matching.resolve_by_tiers(rows, known)


def environment_of(label: Column) -> Column:
    """indoor, outdoor or xc by the first word of a season's label, else null."""
    s = F.lower(label)
    return F.when(F.startswith(s, F.lit("indoor")), "indoor").when(F.startswith(s, F.lit("outdoor")), "outdoor").when(F.startswith(s, F.lit("xc")), "xc")


def import_status(observed: Column, represented: Column, quarantined: Column) -> tuple[Column, Column]:
    """Status and error of a meet by how many rows its source had, how many are represented and how many are held."""
    status = F.when(observed == 0, "no_results_at_source").when(quarantined > 0, "partial").when(represented > 0, "imported").otherwise("pending")
    error = F.when(observed == 0, None).when(quarantined > 0, F.concat(F.lit("quarantined_observations="), quarantined.cast("string"))).when(represented > 0, None).otherwise("source rows without a canonical one")
    return status, error


def leg_repeats(legs: DataFrame) -> DataFrame:
    """section, key, groups, extra_rows, with_source_id, with_name of legs (parent, athlete, leg, source_id, name) that repeat an athlete within a parent.

    by_slots: by the number of distinct slots; exact: the same slot too; by_pair: by the slots, in order. Rows without parent or athlete are left out, for exact those without a slot as well.
    """
    rows = legs.where("parent IS NOT NULL AND athlete IS NOT NULL")
    held = lambda c: F.count_if(C(c).isNotNull() & (F.trim(C(c).cast("string")) != ""))
    same = rows.groupBy("parent", "athlete").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("leg").alias("slots"), held("source_id").alias("s"), held("name").alias("m"), F.array_join(F.array_sort(F.collect_set("leg")).cast("array<string>"), ",").alias("pair")).where("n > 1")
    sums = [F.count(F.lit(1)).alias("groups"), F.sum(C("n") - 1).alias("extra_rows")]
    none = F.lit(None).cast("long")
    by_slots = same.groupBy(C("slots").cast("string").alias("key")).agg(*sums, F.sum("s").alias("with_source_id"), F.sum("m").alias("with_name")).withColumn("section", F.lit("by_slots"))
    by_pair = same.groupBy(C("pair").alias("key")).agg(*sums).withColumn("with_source_id", none).withColumn("with_name", none).withColumn("section", F.lit("by_pair"))
    exact = rows.where("leg IS NOT NULL").groupBy("parent", "athlete", "leg").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    exact = exact.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(C("n") - 1), F.lit(0)).alias("extra_rows")).withColumn("key", F.lit("")).withColumn("with_source_id", none).withColumn("with_name", none).withColumn("section", F.lit("exact"))
    return by_slots.unionByName(by_pair).unionByName(exact).select("section", "key", "groups", "extra_rows", "with_source_id", "with_name")
