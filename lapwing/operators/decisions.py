"""What becomes of an observation: insert, claim of a history row, skip as a duplicate, or quarantine, with the reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decide(observations: DataFrame, facts: DataFrame, id_col: str, days: int = 7) -> DataFrame:
    """observations (a unique id, actor, event, mark, place, meet, day) with decision and reason, from candidates of facts with equal actor, event and mark.

    A fact of the same meet is the same performance unless both have places that differ; a fact without a meet is history, and one such within
    days is claimed. An observation without meet or mark is held back. Candidates are counted by kind before they go back to their
    observations, so no list of candidates grows in a task.
    """
    c = facts.select(*[F.col(x).alias(f"__{x}") for x in ("actor", "event", "mark", "place", "meet", "day")])
    met = observations.join(c, (F.col("actor") == F.col("__actor")) & (F.col("event") == F.col("__event")) & (F.col("mark") == F.col("__mark")))
    here = F.col("__meet") == F.col("meet")
    clash = here & (F.col("__place") != F.col("place"))
    counts = met.groupBy(id_col).agg(
        F.count_if(here & F.coalesce(F.col("__place") == F.col("place"), F.lit(True))).alias("__same"),
        F.count_if(clash).alias("__clash"),
        F.count_if(F.col("__meet").isNull() & (F.abs(F.datediff("__day", "day")) <= days)).alias("__history"),
    )
    out = observations.join(counts, id_col, "left")
    reason = (
        F.when(F.col("meet").isNull() | F.col("mark").isNull(), "incomplete")
        .when(F.col("__same") > 0, "same performance")
        .when(F.col("__clash") > 0, "place differs")
        .when(F.col("__history") == 1, "one history row")
        .when(F.col("__history") > 1, "several history rows")
        .otherwise("new")
    )
    decision = F.when(F.col("reason") == "same performance", "skip_duplicate").when(F.col("reason") == "one history row", "claim").when(F.col("reason") == "new", "insert").otherwise("quarantine")
    return out.withColumn("reason", reason).withColumn("decision", decision).drop("__same", "__clash", "__history")
