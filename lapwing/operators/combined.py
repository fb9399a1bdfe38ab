"""Combined events: one row per athlete and event, the component marks attached."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def collapse(rows: DataFrame, keys: Sequence[str], is_total: Column, priority: Column, points: str, place: str, row_id: str, attach: Sequence[str]) -> DataFrame:
    """keys, total_id, components: the total of the best round (then most points, best place, least id) and the component rows of their best round, ordered by id.

    total_id is null where only components are known; components are empty where only totals are. Rows with a null key are left out: callers union them back. An
    athlete has a handful of rows of one event, so lists stay short; only rows of the best round are listed.
    """
    tagged = rows.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).withColumn("__total", F.coalesce(is_total, F.lit(False))).withColumn("__priority", priority)
    best = tagged.groupBy(*keys).agg(F.min(F.when(~F.col("__total"), F.col("__priority"))).alias("__best"))
    rank = F.struct("__priority", (-F.coalesce(F.col(points), F.lit(-1.0))).alias("p"), F.coalesce(F.nullif(F.col(place), F.lit(0)), F.lit(999)).alias("q"), row_id)
    listed = F.struct(row_id, *[c for c in attach if c != row_id])
    met = tagged.join(best, list(keys)).groupBy(*keys)
    return met.agg(
        F.min(F.when(F.col("__total"), rank)).getField(row_id).alias("total_id"),
        F.array_sort(F.collect_list(F.when(~F.col("__total") & (F.col("__priority") == F.col("__best")), listed))).alias("components"),
    )
