"""Commit of runs and reconciliation of meets: events as observations, facts and results of two sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.operators import commits, reconciliation
from lapwing.sources.tables import table

C = F.col


def _marked(spark: SparkSession, d: str) -> DataFrame:
    """Events as performances: user, type, week as the meet and the value as the mark; the number k in props says what else is known."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.select(
        C("event_id").alias("id"), F.lit("individual_result").alias("entity"), F.weekofyear("ts").cast("long").alias("meet"), C("user_id").alias("actor"), C("event_type").alias("event"), F.lit("time").alias("measure"),
        F.floor(C("value") / 4).cast("string").alias("mark"), F.nullif(C("k") % 3, F.lit(0)).alias("place"), F.lit(None).cast("string").alias("round"), F.when(C("k") > 70, C("k") % 2).cast("long").alias("team"),
        F.to_date("ts").alias("day"), F.lit(None).cast("string").alias("lineup"), "k",
    ).withColumn("mark_key", F.concat(F.lit("raw:"), C("mark")))


def event_run(spark: SparkSession, d: str) -> DataFrame:
    """Events with k of 40 and more as a run, committed against the others as facts, of which some have no meet yet."""
    rows = _marked(spark, d)
    facts = rows.where("k < 40").withColumn("meet", F.when(C("k") >= 8, C("meet"))).drop("k")
    run = rows.where("k >= 40").select(
        "*", F.when(C("k") == 98, "quarantine").alias("prior"), F.when(C("k").isin(95, 96), C("id") + 1).alias("linked"), (C("k") == 96).alias("corrected"), (C("k") != 97).alias("snapshot"), F.when(C("k") == 94, 1).otherwise(0).alias("errors"),
    ).drop("k")
    return commits.commit_run(run, facts)


def meet_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Events with k under 50 as a source's results, the others as local ones; the type in a week is a meet, the user a team. Every row of both sides once, with its outcome."""
    e = _marked(spark, d).withColumn("meet", F.concat_ws(" ", "event", C("meet").cast("string"))).withColumn("round", F.when(C("k") % 7 > 3, "Finals").when(C("k") % 7 > 1, "Preliminaries"))
    sources = e.where("k < 50").select(C("id").alias("key"), "meet", F.when(C("k") % 11 > 0, C("actor")).alias("team"), "mark", "place", "round", "lineup", C("id").alias("ordinal"))
    locals_ = e.where("k >= 50").select("id", "meet", C("actor").alias("team"), (C("k") % 13 > 0).alias("valid"), "mark", "place", "round", "lineup")
    kind = F.when(F.endswith("meet", F.lit("4")), "combined_child").otherwise("canonical")
    meets = e.select("meet").distinct().select("meet", kind.alias("kind"), F.when(F.startswith("meet", F.lit("error 2")), "not_contested").otherwise("present").alias("snapshot"))
    return reconciliation.reconcile_meets(meets, sources, locals_)[0]


QUERIES = {"M6_M23_J41_event_run": event_run, "J39_meet_outcomes": meet_outcomes}

ORACLE_SQL = {
    "M6_M23_J41_event_run": """
        WITH e AS (SELECT event_id AS id, weekofyear(ts) AS meet, user_id AS actor, event_type AS event, floor(value / 4)::BIGINT AS mark, json_extract(props, '$.k')::INT AS k, ts::DATE AS day FROM events),
        x AS (SELECT *, nullif(k % 3, 0) AS place, CASE WHEN k > 70 THEN k % 2 END AS team FROM e),
        f AS (SELECT id, CASE WHEN k >= 8 THEN meet END AS meet, actor, event, mark, place, team, day FROM x WHERE k < 40),
        o AS (SELECT *, CASE k WHEN 94 THEN 'validation_failed' WHEN 95 THEN 'source_record_already_linked' WHEN 96 THEN 'source_correction_required' WHEN 97 THEN 'missing_source_snapshot' WHEN 98 THEN 'preclassified' END AS held FROM x WHERE k >= 40),
        h AS (SELECT o.id, count(*) AS n, min(f.id) AS one FROM o JOIN f USING (actor, event, mark) WHERE f.meet IS NULL AND abs(date_diff('day', o.day, f.day)) <= 7 GROUP BY o.id),
        s AS (SELECT o.id, count(*) AS n, count(DISTINCT coalesce(f.place, 0)) AS places, arg_min(struct_pack(id := f.id, place := f.place, team := f.team), f.id) AS best FROM o JOIN f USING (actor, event, mark, meet) GROUP BY o.id),
        a AS (SELECT o.*, h.n AS past, h.one, s.n, s.places, s.best,
                     min(CASE WHEN held IS NULL AND s.n IS NULL AND h.n IS NULL THEN o.id END) OVER (PARTITION BY actor, event, mark, meet) AS first
              FROM o LEFT JOIN h ON h.id = o.id LEFT JOIN s ON s.id = o.id),
        b AS (SELECT a.*, CASE WHEN a.n = 1 OR a.places = 1 THEN a.best WHEN a.n IS NULL AND a.id > a.first THEN struct_pack(id := a.first, place := y.place, team := y.team) END AS other, a.n IS NULL AND a.id > a.first AS fresh FROM a LEFT JOIN x y ON y.id = a.first),
        r AS (SELECT *, CASE WHEN held IS NOT NULL THEN held WHEN other IS NOT NULL THEN CASE WHEN other.place IS DISTINCT FROM place THEN 'same_performance_place_conflict' WHEN team <> other.team THEN 'represented_team_conflict'
                          WHEN team IS NOT NULL AND other.team IS NULL THEN 'team_enrichment_required' ELSE 'same_performance_same_place' END
                        WHEN n > 1 THEN 'multiple_matching_performances' WHEN past = 1 THEN 'unlinked_history_exact_match' WHEN past > 1 THEN 'multiple_history_matches' ELSE 'no_existing_match' END AS reason FROM b)
        SELECT id, CASE WHEN reason IN ('source_record_already_linked', 'same_performance_same_place') THEN 'skip_duplicate' WHEN reason = 'no_existing_match' THEN 'insert' WHEN reason = 'unlinked_history_exact_match' THEN 'claim' ELSE 'quarantine' END AS decision, reason,
               (CASE reason WHEN 'validation_failed' THEN 0 WHEN 'source_correction_required' THEN 0 WHEN 'source_record_already_linked' THEN 1 WHEN 'same_performance_same_place' THEN 1 WHEN 'no_existing_match' THEN 1 WHEN 'same_performance_place_conflict' THEN 0.75
                 WHEN 'represented_team_conflict' THEN 0.95 WHEN 'team_enrichment_required' THEN 0.9 WHEN 'multiple_matching_performances' THEN 0.5 WHEN 'multiple_history_matches' THEN 0.5 WHEN 'unlinked_history_exact_match' THEN 0.98 END)::DOUBLE AS confidence,
               CASE WHEN reason = 'source_record_already_linked' THEN id + 1 WHEN held IS NOT NULL THEN NULL WHEN other IS NOT NULL THEN other.id WHEN reason = 'unlinked_history_exact_match' THEN one END AS matched,
               coalesce(held IS NULL AND other IS NOT NULL AND fresh, false) AS matched_in_run FROM r""",
}
