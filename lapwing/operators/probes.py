"""Probes of what a source holds, as patches of a recovery queue.

A run that only looked for relays says in its scope (JSON) how many observations it saw and for which meets. It changes an open meet: relay coverage, whether relays are needed, the error and
the status. Runs of one meet count in their order, but need no loop: each leaves the state as the last one says, until one closes the meet, after which no other applies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C = F.col
OPEN = ["queued", "in_progress", "partial", "exhausted"]
STATE = ["status", "relay_coverage", "needs_relays", "last_error", "run_id"]


def probed_meets(runs: DataFrame) -> DataFrame:
    """run_id, at, meet, relays of the runs (run_id, at, mode, status, scope) that count: succeeded dry runs for relays only, with observations. A scope names meet_id or meet_ids."""
    scope = F.try_parse_json("scope")
    number = lambda path: F.try_variant_get(scope, path, "bigint")
    read = runs.where("mode = 'dry_run' AND status = 'succeeded'").select(
        "run_id", "at", F.try_variant_get(scope, "$.relays_only", "boolean").alias("only"), number("$.source_observation_count").alias("seen"), number("$.source_relay_observation_count").alias("relays"),
        F.coalesce(F.array_compact(F.array(number("$.meet_id"))), F.array().cast("array<bigint>")).alias("one"), F.coalesce(F.try_variant_get(scope, "$.meet_ids", "array<bigint>"), F.array().cast("array<bigint>")).alias("many"),
    )
    sound = read.where("only AND seen > 0 AND relays IS NOT NULL")
    return sound.select("run_id", "at", "relays", F.explode(F.array_distinct(F.when(F.size("one") > 0, C("one")).otherwise(C("many")))).alias("meet")).where("meet IS NOT NULL")


def apply_probes(queue: DataFrame, runs: DataFrame) -> DataFrame:
    """queue (meet, status, relay_coverage, needs_relays, needs_individual, n_relay_facts, n_quarantined, last_error, run_id) after the runs, with before and after images and whether a row changed.

    Runs are ordered by at, then run_id. Only open meets change. With relays seen they are present, and needed if no fact has any; without, they are absent, and the meet is complete unless it needs
    individual results. Quarantined observations make it partial, with an error that names their number. The same runs once more change nothing.
    """
    met = probed_meets(runs).join(queue.where(C("status").isin(OPEN)).select("meet", F.coalesce("n_quarantined", F.lit(0)).alias("q"), F.coalesce("needs_individual", F.lit(False)).alias("i")), "meet")
    order = F.struct("at", "run_id")
    closes = (C("relays") == 0) & (C("q") == 0) & ~C("i")
    ends = met.where(closes).groupBy("meet").agg(F.min(order).alias("end"))
    applied = met.join(ends, "meet", "left").where(C("end").isNull() | (order <= C("end")))
    last = applied.groupBy("meet").agg(F.max_by("relays", order).alias("r"), F.max_by("run_id", order).alias("by"), F.min("relays").alias("least"), F.max(C("end").isNotNull()).alias("closed"))
    before = F.struct(*STATE)
    out = queue.join(last, "meet", "left")
    hit = C("by").isNotNull()
    held = F.coalesce("n_quarantined", F.lit(0)) > 0
    after = F.struct(
        F.when(hit & held, "partial").when(hit & C("closed"), "complete").otherwise(C("status")).alias("status"),
        F.when(hit, F.when(C("r") > 0, "present").otherwise("absent")).otherwise(C("relay_coverage")).alias("relay_coverage"),
        F.when(hit, (C("r") > 0) & (F.coalesce("n_relay_facts", F.lit(0)) == 0)).otherwise(C("needs_relays")).alias("needs_relays"),
        F.when(hit & held, F.concat(F.lit("source_observations_quarantined="), C("n_quarantined").cast("string"))).when(hit & (C("least") == 0), None).otherwise(C("last_error")).alias("last_error"),
        F.coalesce("by", "run_id").alias("run_id"),
    )
    return out.select("meet", before.alias("before"), after.alias("after")).withColumn("changed", ~C("before").eqNullSafe(C("after")))
