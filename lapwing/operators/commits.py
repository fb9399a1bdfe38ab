"""Commit of a run of observations against the facts known so far, where a row sees what earlier rows of the run have inserted.

Rows are decided in the order of their ids, but not one by one. Only an insert changes what later rows see, and only rows of the same bucket: entity, actor, event, meet and mark (all
status codes of a meet together). So each round decides every open row against the facts of that moment; in each bucket the rows up to its
first insert are final, and that insert joins the facts. What comes after it is decided again in the next round. There are as many rounds as some
bucket has inserts, plus one; a performance is inserted again in its bucket only for another known round, so buckets take a few.

Facts are reduced to distinct (bucket, place, round, team, day, code, lineup) before they meet the rows, so a performance that is stored many times, or reported
many times, costs its distinct forms. Rounds are cut by checkpoints.

Columns of observations: id (unique), entity (individual_result or relay_result), meet, actor (athlete or team), event, measure, mark, mark_key, place, round, team, day, lineup (ordered
legs of a relay or null), prior (what is decided already: quarantine, or null), linked (fact that an earlier run linked to this source record), corrected (whether its fields differ from
that fact), snapshot (whether its source version is known), errors (number of them). Facts: id, entity, meet, actor, event, measure, mark, mark_key, place, round, team, day, lineup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapwing.functions import marks
from lapwing.operators.matching import _checkpoints

C = F.col
#: Confidence of each reason.
CONFIDENCE = {
    "source_record_already_linked": 1.0, "missing_source_snapshot": None, "source_correction_required": 0.0, "validation_failed": 0.0, "same_relay_lineup_status": 0.99, "same_performance_same_place": 1.0,
    "same_status_code_same_performance": 0.99, "conflicting_status_codes": 0.8, "represented_team_conflict": 0.95, "team_enrichment_required": 0.9, "same_performance_place_conflict": 0.75,
    "multiple_matching_performances": 0.5, "unlinked_history_exact_match": 0.98, "multiple_history_matches": 0.5, "status_code_requires_source_identity": 0.9, "no_existing_match": 1.0,
}
SKIPS = ["source_record_already_linked", "same_relay_lineup_status", "same_performance_same_place", "same_status_code_same_performance"]
INSERTS = ["status_code_requires_source_identity", "no_existing_match"]


def _bucketed(rows: DataFrame) -> DataFrame:
    """rows with what their decision looks at: bucket (null: nothing can match), status, canon and raw of the round."""
    relay = C("entity") == "relay_result"
    status = F.coalesce(marks.is_status_code(C("mark")), F.lit(False))
    scope = F.when(relay & status, F.lit("any")).otherwise(C("meet").cast("string"))  # codes of one lineup meet across meets
    key = F.when(status, F.lit("status")).otherwise(F.concat_ws("|", C("measure"), C("mark_key")))
    whole = C("actor").isNotNull() & C("event").isNotNull() & scope.isNotNull() & (status | C("mark_key").isNotNull())
    bucket = F.when(whole, F.concat_ws("|", "entity", C("actor").cast("string"), C("event").cast("string"), scope, key))
    raw = F.nullif(F.trim("round"), F.lit(""))
    return rows.withColumn("relay", relay).withColumn("status", status).withColumn("canon", marks.normal_round(C("round"))["canonical"]).withColumn("raw", raw).withColumn("bucket", bucket)


def _forms(facts: DataFrame) -> DataFrame:
    """Distinct forms of bucketed facts with the first of them: the stored before those of this run, then by id."""
    form = ["bucket", "meet", "measure", "mark_key", "code", "place", "canon", "raw", "team", "day", "lineup"]
    held = facts.where("bucket IS NOT NULL").withColumn("code", F.when(C("status"), F.lower("mark"))).withColumn("day", F.when(C("status"), C("day")))
    return held.groupBy(*form).agg(F.min(F.struct("fresh", "id")).alias("first"), F.count(F.lit(1)).alias("n"))


def _decided(open_: DataFrame, forms: DataFrame) -> DataFrame:
    """open_ rows with reason, matched and fresh (whether matched is a row of this run)."""
    f = forms.select(*[C(x).alias(f"f_{x}") for x in forms.columns])
    met = open_.join(f, C("bucket") == C("f_bucket"))
    here = C("meet") == C("f_meet")
    distinct_rounds = F.coalesce(C("canon") != C("f_canon"), F.lit(False))
    same_place = C("place").eqNullSafe(C("f_place"))
    both_codes = C("status") & C("f_code").isNotNull()
    lineup = C("relay") & both_codes & F.coalesce(C("lineup") == C("f_lineup"), F.lit(False))
    identity = ~C("relay") & both_codes & here & F.coalesce(C("day") == C("f_day"), F.lit(False)) & ~distinct_rounds & same_place
    performed = here & (C("measure") == C("f_measure")) & F.coalesce(C("mark_key") == C("f_mark_key"), F.lit(False))
    team = F.when(C("relay"), None).when(C("team").isNotNull() & C("f_team").isNotNull() & (C("team") != C("f_team")), "represented_team_conflict").when(C("team").isNotNull() & C("f_team").isNull(), "team_enrichment_required")
    same_code = F.when(C("f_code") == F.lower("mark"), "same_status_code_same_performance").otherwise("conflicting_status_codes")
    kind = (
        F.when(lineup, "same_relay_lineup_status")
        .when(identity, F.coalesce(team, same_code))
        .when(performed & same_place, F.coalesce(team, F.lit("same_performance_same_place")))
        .when(performed & ~distinct_rounds, "same_performance_place_conflict")
    )
    wanted = F.when(C("f_canon") == C("canon"), 100).otherwise(0) + F.when(C("f_raw") == C("raw"), 10).otherwise(0) + F.when(C("f_raw") == C("f_canon"), 2).otherwise(0)
    known = F.when(C("f_canon") == "Finals", 3).when(C("f_canon") == "Preliminaries", 2).when(C("f_canon") == "Semifinals", 1).otherwise(0)
    met = met.withColumn("kind", kind).where("kind IS NOT NULL")
    # facts of the meet that differ in nothing but their round are one performance: its best round stands for it
    unkeyed = F.when(F.coalesce(C("f_mark_key").isNull(), F.lit(False)), F.lit("none")).otherwise(F.concat_ws("|", "f_measure", "f_mark_key", F.coalesce(C("f_place").cast("string"), F.lit(""))))
    found = met.groupBy("id").agg(
        F.sum("f_n").alias("n"),
        F.sum(F.when(here, C("f_n")).otherwise(0)).alias("n_here"),
        F.min(F.when(here, unkeyed)).alias("least"),
        F.max(F.when(here, unkeyed)).alias("most"),
        F.min_by(F.struct("kind", "f_first"), F.struct(F.when(here, 0).otherwise(1).alias("away"), (-(wanted + known)).alias("score"), C("f_first"))).alias("best"),
    )
    out = open_.join(found, "id", "left")
    one = (C("n") == 1) | (C("n_here") > 0) & (C("least") == C("most"))
    history = F.when(C("n_history") == 1, "unlinked_history_exact_match").when(C("n_history") > 1, "multiple_history_matches")
    new = F.when(C("relay") & C("status"), "status_code_requires_source_identity").otherwise("no_existing_match")
    reason = F.when(one, C("best.kind")).when(C("n") > 1, "multiple_matching_performances").otherwise(F.coalesce(history, new))
    matched = F.when(one, C("best.f_first.id")).when(C("n").isNull() & (C("n_history") == 1), C("history"))
    fresh = F.when(one, C("best.f_first.fresh")).otherwise(F.lit(False))
    return out.withColumn("reason", reason).withColumn("matched", matched).withColumn("fresh", fresh).drop("n", "n_here", "least", "most", "best")


def commit_run(observations: DataFrame, facts: DataFrame, *, history_days: int = 7) -> DataFrame:
    """id, decision, reason, confidence, matched (a fact's id, or with matched_in_run the id of an observation inserted before) of every observation.

    Held before any match: no known source version, a decision of quarantine (reason preclassified), corrected fields of a linked record, errors; linked records are replays. A fact without a meet
    is history: the only one of the same actor, event and mark within history_days is claimed, and stays open for other rows of the run, as a second source may report the same performance.
    Individual observations see facts of their meet and history; relays see their meet only, and status codes of relays the same lineup. Null actors, events or marks match nothing.
    """
    _checkpoints(observations.sparkSession)
    linked = C("linked").isNotNull()
    held = (
        F.when(~F.coalesce("snapshot", F.lit(False)), F.when(linked, "source_record_already_linked").otherwise("missing_source_snapshot"))
        .when(C("prior") == "quarantine", "preclassified")
        .when(linked, F.when(F.coalesce("corrected", F.lit(False)), "source_correction_required").otherwise("source_record_already_linked"))
        .when(F.coalesce("errors", F.lit(0)) > 0, "validation_failed")
    )
    rows = _bucketed(observations.withColumn("reason", held))
    settled = rows.where("reason IS NOT NULL").select("id", "reason", F.when(C("reason") == "source_record_already_linked", C("linked")).alias("matched"), F.lit(False).alias("fresh"))
    stored = _bucketed(facts.withColumn("fresh", F.lit(False)))

    past = stored.where("meet IS NULL AND NOT relay AND mark_key IS NOT NULL").groupBy("actor", "event", "measure", "mark_key", "day").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("i"))
    past = past.select(*[C(x).alias(f"p_{x}") for x in past.columns])
    wanting = rows.where("reason IS NULL").drop("reason")
    near = wanting.join(past, (C("actor") == C("p_actor")) & (C("event") == C("p_event")) & (C("measure") == C("p_measure")) & (C("mark_key") == C("p_mark_key"))).where((F.abs(F.datediff("day", "p_day")) <= history_days) & ~C("relay"))
    left = wanting.join(near.groupBy("id").agg(F.sum("p_c").alias("n_history"), F.min("p_i").alias("history")), "id", "left").checkpoint()

    known, outs = _forms(stored).checkpoint(), [settled]
    while True:
        decided = _decided(left, known)
        first = decided.where(C("reason").isin(INSERTS) & C("bucket").isNotNull()).groupBy("bucket").agg(F.min("id").alias("first_id"))
        now = decided.join(first, "bucket", "left").withColumn("final", C("first_id").isNull() | (C("id") <= C("first_id"))).checkpoint()
        outs.append(now.where("final").select("id", "reason", "matched", "fresh"))
        left = now.where("NOT final").select(left.columns)
        if left.isEmpty():
            break
        known = known.unionByName(_forms(now.where(C("final") & C("reason").isin(INSERTS)).withColumn("fresh", F.lit(True)))).checkpoint()
    out = outs[0]
    for x in outs[1:]:
        out = out.unionByName(x)
    decision = F.when(C("reason").isin(SKIPS), "skip_duplicate").when(C("reason").isin(INSERTS), "insert").when(C("reason") == "unlinked_history_exact_match", "claim").otherwise("quarantine")
    confidence = F.create_map(*[F.lit(x) for k, v in CONFIDENCE.items() if v is not None for x in (k, v)])[C("reason")]
    return out.select("id", decision.alias("decision"), "reason", confidence.alias("confidence"), "matched", (C("fresh") & C("matched").isNotNull()).alias("matched_in_run"))
