"""Plans that a person signs off: what is ready, what is held and why. Guards stand in order; the first one that meets gives the reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_reason(guards: Sequence[tuple[Column, str]]) -> Column:
    """The reason of the first guard that is true; null if none is. A null guard doesn't hold."""
    return F.coalesce(*[F.when(guard, F.lit(reason)) for guard, reason in guards])


def roster_plan(rows: DataFrame, athletes: DataFrame, teams: DataFrame, members: DataFrame, evidence: DataFrame) -> DataFrame:
    """source_key, plan (ready, held, replayed), reason, athlete and team of each roster row's source key.

    rows: source_key, hash, outside_id, school, gender, season; repeated keys must agree. athletes: outside_id, athlete, athlete_gender; teams: school, gender, team, kind;
    members: school, first_season, last_season (null: open); evidence: source_key, known_athlete, known_hash.
    """
    n = F.count(F.lit(1))
    one = rows.groupBy("source_key").agg(F.min("hash").alias("hash"), F.max("hash").alias("__hash"), *[F.min_by(c, "hash").alias(c) for c in ("outside_id", "school", "gender", "season")])
    a = athletes.where("outside_id IS NOT NULL").groupBy("outside_id").agg(n.alias("__athletes"), F.min("athlete").alias("athlete"), F.min("athlete_gender").alias("__gender"))
    t = teams.groupBy("school", "gender").agg(n.alias("__teams"), F.min("team").alias("team"), F.min("kind").alias("__kind"))
    e = evidence.groupBy("source_key").agg(n.alias("__known"), F.min("known_athlete").alias("__min"), F.max("known_athlete").alias("__max"), F.min("known_hash").alias("__known_hash"))
    covered = one.select("source_key", "school", "season").join(members, "school").where("season >= first_season AND (last_season IS NULL OR season <= last_season)")
    m = covered.select("source_key").distinct().withColumn("__member", F.lit(True))
    out = one.join(a, "outside_id", "left").join(t, ["school", "gender"], "left").join(m, "source_key", "left").join(e, "source_key", "left")
    known = F.col("__known") >= 1
    held = first_reason([
        (F.col("hash") != F.col("__hash"), "conflicting_rows_for_source_key"),
        (F.col("__athletes").isNull(), "canonical_athlete_missing"),
        (F.col("__athletes") > 1, "ambiguous_outside_id"),
        (F.col("__gender") != F.col("gender"), "athlete_gender_conflict"),
        (F.col("__teams").isNull(), "canonical_team_missing"),
        (F.col("__teams") > 1, "ambiguous_canonical_team"),
        (~F.col("__kind").eqNullSafe("collegiate"), "school_not_collegiate"),
        (F.col("__member").isNull(), "collegiate_membership_not_verified_for_season"),
        ((F.col("__known") > 1) | (known & ~(F.col("__min").eqNullSafe(F.col("athlete")) & F.col("__max").eqNullSafe(F.col("athlete")))), "existing_evidence_identity_conflict"),
        (known & ~F.col("__known_hash").eqNullSafe(F.col("hash")), "source_payload_changed"),
    ])
    plan = F.when(held.isNotNull(), "held").when(known, "replayed").otherwise("ready")
    return out.select("source_key", plan.alias("plan"), F.coalesce(held, F.when(known, "exact_replay")).alias("reason"), "athlete", "team")


def refresh_queue(meets: DataFrame, individual: DataFrame, relay: DataFrame, open_cases: DataFrame, prior: DataFrame) -> DataFrame:
    """What each meet still needs: coverage, needs_individual, needs_relays, priority and status.

    meets: meet, source_known; individual, relay and open_cases: one row per fact or case, with meet (counted before the join); prior: meet, relay_coverage ("absent": the
    meet had no relays).
    """
    count = lambda df, name: df.where("meet IS NOT NULL").groupBy("meet").agg(F.count(F.lit(1)).alias(name))
    out = meets
    for df, name in ((individual, "n_individual"), (relay, "n_relay"), (open_cases, "n_open")):
        out = out.join(count(df, name), "meet", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    out = out.join(prior.select("meet", "relay_coverage"), "meet", "left").withColumn("relay_coverage", F.coalesce("relay_coverage", F.lit("unknown")))
    no_individual, no_relay = F.col("n_individual") == 0, F.col("n_relay") == 0
    out = out.withColumn("coverage", F.when(no_individual & no_relay, "empty").when(no_individual, "relay_only").when(no_relay, "individual_only").otherwise("covered"))
    out = out.withColumn("needs_individual", no_individual).withColumn("needs_relays", no_relay & (F.col("relay_coverage") != "absent"))
    priority = F.when(F.col("coverage") == "empty", 10).when(F.col("coverage") == "relay_only", 20).when(F.col("coverage") == "individual_only", 30).otherwise(100)
    status = F.when(F.col("n_open") > 0, "partial").when(~F.col("needs_individual") & ~F.col("needs_relays"), "complete").when(~F.coalesce("source_known", F.lit(False)), "blocked").otherwise("queued")
    return out.select("meet", "coverage", "needs_individual", "needs_relays", "n_individual", "n_relay", "n_open", priority.alias("priority"), status.alias("status"))


def merge_plan(decisions: DataFrame, people: DataFrame, results: DataFrame, result_key: Sequence[str]) -> DataFrame:
    """old, target, action (merge, hold), reason, and, for merges, how many results move and how many go as doubles of the target's.

    decisions: old, target; people: person, gender, name, profile; results: person and the columns of the result key, where null meets null.
    """
    p = lambda side: people.select(F.col("person").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("gender", "name", "profile")], F.lit(True).alias(f"{side}_found"))
    owners = people.where("profile IS NOT NULL").groupBy(F.col("profile").alias("old_profile")).agg(F.count(F.lit(1)).alias("__owners"))
    both = decisions.join(p("old"), "old", "left").join(p("target"), "target", "left").join(owners, "old_profile", "left")
    held = first_reason([
        (F.col("old_found").isNull() | F.col("target_found").isNull(), "athlete_not_found"),
        (F.col("old") == F.col("target"), "same_athlete"),
        (~F.col("old_gender").eqNullSafe(F.col("target_gender")), "gender_mismatch"),
        (~F.col("old_name").eqNullSafe(F.col("target_name")), "name_mismatch"),
        (F.col("target_profile") != F.coalesce("old_profile", F.lit("")), "target_has_different_profile_url"),
        (F.col("__owners") > F.when(F.col("target_profile") == F.col("old_profile"), 2).otherwise(1), "profile_url_has_other_owner"),
    ])
    plan = both.withColumn("reason", held)
    whole = results.withColumn("__key", F.struct(*result_key)).select("person", "__key")
    going = plan.where("reason IS NULL").select("old", "target").join(whole.withColumnRenamed("person", "old"), "old")
    there = whole.select(F.col("person").alias("target"), F.to_json("__key").alias("__text")).distinct().withColumn("__double", F.lit(True))
    n = going.withColumn("__text", F.to_json("__key")).join(there, ["target", "__text"], "left").groupBy("old", "target").agg(F.count_if(F.col("__double").isNull()).alias("n_move"), F.count("__double").alias("n_delete"))
    merge = F.col("reason").isNull()
    count = lambda c: F.when(merge, F.coalesce(c, F.lit(0).cast("long"))).alias(c)
    return plan.join(n, ["old", "target"], "left").select("old", "target", F.when(merge, "merge").otherwise("hold").alias("action"), F.coalesce("reason", F.lit("reviewed_duplicate_identity")).alias("reason"), count("n_move"), count("n_delete"))


def consistent_groups(cases: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """key, n, the fields' least values and conflicts: the names, by comma, of fields with several values in one group. Nulls agree with all."""
    spread = [F.when(F.min(c) != F.max(c), F.lit(c)) for c in fields]
    return cases.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in fields], F.concat_ws(",", *spread).alias("conflicts"))


def empty_twins(people: DataFrame, name: str, facts: DataFrame, others: Sequence[DataFrame]) -> DataFrame:
    """People without any reference (person column of facts and others) whose name another person with facts bears."""
    empty = people
    for df in (facts, *others):
        empty = empty.join(df.select("person").where("person IS NOT NULL").distinct(), "person", "left_anti")
    bearers = people.join(facts.select("person"), "person", "left_semi").select(name).distinct()
    return empty.join(bearers, name, "left_semi")
