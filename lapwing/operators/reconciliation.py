"""Reconciliation of a meet's relay results between a source and the database, in stages, with an outcome for every row.

Within one meet, team and mark, sources are taken in their order: each takes the only row left, or the one that scores best alone. That order matters only where a source takes a row, so each
round decides all open sources, and those up to the first that takes one are final. There are as many rounds as some (meet, team, mark) has pairs, plus one.
What is left of a team then decides the rest: the last source and the last row, if only they are left and no other source failed, are a conflict; other sources are missing, other rows extra.

Columns of sources: key (unique), meet, team (null: unresolved), mark (identity of the mark), place, round, lineup, ordinal (order in the meet). Locals: id (unique), meet, team, valid (whether
team and school are known), mark, place, round, lineup. Meets: meet, kind (canonical, preliminary, multi_only, combined_child, combined_child_candidate), snapshot (present, not_contested,
unavailable, or null). Nulls: a mark of null is the identity 'missing', which equals itself; a source without a team is unresolved; a local that isn't valid is invalid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.operators.matching import _checkpoints

C = F.col


def exact_pairs(sources: DataFrame, locals_: DataFrame) -> DataFrame:
    """key, id of the sources that take a row of the same meet, team and mark."""
    _checkpoints(sources.sparkSession)
    group = ["meet", "team", "mark"]
    left = sources.select("key", "ordinal", *group, "place", "round", "lineup").checkpoint()
    rows = locals_.select("id", *group, C("place").alias("l_place"), C("round").alias("l_round"), C("lineup").alias("l_lineup")).checkpoint()
    found = None
    while True:
        score = (
            F.when(C("place").eqNullSafe(C("l_place")), 8).otherwise(0) + F.when(C("round") == C("l_round"), 4).otherwise(0) + F.when(C("round").isNull() | C("l_round").isNull(), 1).otherwise(0)
            + F.when((C("lineup") == C("l_lineup")) & (C("lineup") != ""), 16).otherwise(0)
        )
        # rows that look alike tie with one another: they meet the sources as one form
        forms = rows.groupBy(*group, "l_place", "l_round", "l_lineup").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
        scored = left.join(forms, group).withColumn("score", score)
        best = scored.groupBy("key", "ordinal", *group).agg(F.sum("n").alias("n"), F.max_by(F.struct("id", "n"), F.struct("score", "n", "id")).alias("b"), F.max("score").alias("top"), F.collect_set(F.struct("score", "id")).alias("all"))
        alone = F.size(F.filter("all", lambda x: x["score"] == C("top"))) == 1
        takes = best.where((C("n") == 1) | (C("b.n") == 1) & alone).select("key", "ordinal", *group, C("b.id").alias("id"))
        first = takes.groupBy(*group).agg(F.min(F.struct("ordinal", "key", "id")).alias("f")).select(*group, C("f.ordinal").alias("f_ordinal"), C("f.key").alias("key"), C("f.id").alias("id")).checkpoint()
        if first.isEmpty():
            return found if found is not None else first.select("key", "id")
        pairs = first.select("key", "id")
        found = pairs if found is None else found.unionByName(pairs)
        rows = rows.join(pairs.select("id"), "id", "left_anti").checkpoint()
        after = first.select(*group, "f_ordinal", C("key").alias("f_key"))
        left = left.join(after, group).where(F.struct("ordinal", "key") > F.struct(C("f_ordinal").alias("ordinal"), C("f_key").alias("key"))).drop("f_ordinal", "f_key").checkpoint()


def reconcile_meets(meets: DataFrame, sources: DataFrame, locals_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (meet, key, id, outcome) with every source and every local once (matched and conflict have both), and meets (meet, status, reason, and a count of each outcome).

    Only meets that are contested and have a source are reconciled; in others rows get the outcome not_compared, or extra where the source says that the event was not held.
    """
    named = lambda df: df.withColumn("mark", F.coalesce("mark", F.lit("missing")))
    sources, locals_ = named(sources), named(locals_)
    n = lambda df, name: df.groupBy("meet").agg(F.count(F.lit(1)).alias(name))
    known = meets.join(n(sources, "n_sources"), "meet", "left").join(n(locals_, "n_locals"), "meet", "left").fillna(0, ["n_sources", "n_locals"])
    early = (
        F.when(C("kind") == "combined_child", F.struct(F.lit("child").alias("status"), F.lit("verified_combined_events_child").alias("reason")))
        .when(C("kind") == "combined_child_candidate", F.struct(F.lit("needs_review").alias("status"), F.lit("combined_events_parent_not_verified").alias("reason")))
        .when(C("snapshot").isNull() | (C("snapshot") == "unavailable"), F.struct(F.lit("blocked").alias("status"), F.lit("source_unavailable").alias("reason")))
        .when((C("snapshot") == "not_contested") & (C("n_locals") > 0), F.struct(F.lit("needs_review").alias("status"), F.lit("event_not_held_but_local_rows_exist").alias("reason")))
        .when(C("snapshot") == "not_contested", F.struct(F.lit("not_contested").alias("status"), F.lit("event_verified_not_held").alias("reason")))
        .when((C("snapshot") == "present") & (C("n_sources") == 0), F.struct(F.lit("needs_review").alias("status"), F.lit("event_present_but_no_rows").alias("reason")))
    )
    _checkpoints(meets.sparkSession)
    known = known.withColumn("early", early).checkpoint()
    open_ = known.where("early IS NULL").select("meet")
    closed = known.where("early IS NOT NULL").select("meet", F.when((C("early.status") == "needs_review") & (C("snapshot") == "not_contested"), "extra").otherwise("not_compared").alias("outcome"))

    s, t = sources.join(open_, "meet", "left_semi"), locals_.join(open_, "meet", "left_semi")
    resolved, valid = s.where("team IS NOT NULL"), t.where("valid")
    pairs = exact_pairs(resolved, valid).checkpoint()
    team = ["meet", "team"]
    of_sources = resolved.join(pairs, "key", "left").groupBy(*team).agg(F.count_if(C("id").isNull()).alias("failed"), F.max_by(F.when(C("id").isNull(), C("key")), F.struct("ordinal", "key")).alias("last_key"))
    of_locals = valid.join(pairs, "id", "left").groupBy(*team).agg(F.count_if(C("key").isNull()).alias("left_over"), F.min(F.when(C("key").isNull(), C("id"))).alias("last_id"))
    conflicts = of_sources.join(of_locals, team).where("failed = 1 AND last_key IS NOT NULL AND left_over = 1").select(C("last_key").alias("key"), C("last_id").alias("id"))
    both = pairs.withColumn("outcome", F.lit("matched")).unionByName(conflicts.withColumn("outcome", F.lit("conflict"))).checkpoint()

    text = lambda x: F.lit(None).cast(x)
    key_type, id_type = sources.schema["key"].dataType, locals_.schema["id"].dataType
    of = lambda df, side, outcome: df.select("meet", *([C("key"), text(id_type).alias("id")] if side == "key" else [text(key_type).alias("key"), C("id")]), outcome.alias("outcome"))
    parts = [
        s.join(both.select("key", "id", "outcome"), "key").select("meet", "key", "id", "outcome"),
        of(resolved.join(both.select("key"), "key", "left_anti"), "key", F.lit("missing")),
        of(valid.join(both.select("id"), "id", "left_anti"), "id", F.lit("extra")),
        of(s.where("team IS NULL"), "key", F.lit("unresolved")),
        of(t.where("NOT coalesce(valid, false)"), "id", F.lit("invalid")),
        of(sources.join(closed, "meet").withColumn("outcome", F.lit("not_compared")), "key", C("outcome")),
        of(locals_.join(closed, "meet"), "id", C("outcome")),
    ]
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    names = ["matched", "conflict", "missing", "extra", "unresolved", "invalid"]
    counts = rows.groupBy("meet").agg(*[F.count_if(C("outcome") == x).alias(f"n_{x}") for x in names])
    out = known.join(counts, "meet", "left").fillna(0, [f"n_{x}" for x in names])
    differs = sum((C(f"n_{x}") for x in names[2:]), C("n_conflict")) > 0
    late = F.when(~differs, F.struct(F.lit("matched").alias("status"), F.lit("source_and_database_match").alias("reason"))).otherwise(F.struct(F.when(C("n_unresolved") > 0, "needs_review").otherwise("repair_ready").alias("status"), F.lit("source_database_difference").alias("reason")))
    verdict = F.coalesce("early", late)
    return rows, out.select("meet", verdict["status"].alias("status"), verdict["reason"].alias("reason"), *[f"n_{x}" for x in names])
