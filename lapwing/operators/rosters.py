"""Rosters: files of schools as one table, and what changed between two of them.

A file holds one school: school_id, school_name, scraped_at, men_roster and women_roster, arrays of athletes; the folder above it is the division. Files that can't be read give nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.functions import marks

C = F.col
ATHLETE = "source_id string, full_name string, class_year string"
SCHOOL = "school_id long, school_name string, scraped_at string"


def consolidated(spark: SparkSession, path: str, athlete: str = ATHLETE, *, pattern: str = "*.json") -> DataFrame:
    """All athletes of the files below path/<division>/ whose names fit the pattern: fields of athlete, school, gender and division."""
    kind = f"array<struct<{athlete.replace(' string', ':string')}>>"
    files = spark.read.schema(f"{SCHOOL}, men_roster {kind}, women_roster {kind}").json(f"{path}/*/{pattern}", multiLine=True).withColumn("division", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))
    both = F.array(F.struct(F.lit("M").alias("gender"), C("men_roster").alias("athletes")), F.struct(F.lit("F").alias("gender"), C("women_roster").alias("athletes")))
    each = files.select("school_id", "school_name", "scraped_at", "division", F.inline(both))
    return each.select("school_id", "school_name", "scraped_at", "division", "gender", F.inline("athletes"))


def _one_each(roster: DataFrame) -> DataFrame:
    """The row of each source_id that was read last, of the largest school_id where two were read at once."""
    fields = [c for c in roster.columns if c != "source_id"]
    return roster.where("source_id IS NOT NULL").groupBy("source_id").agg(F.max_by(F.struct(*fields), F.struct("scraped_at", "school_id", "full_name")).alias("r")).select("source_id", "r.*")


def diff(old: DataFrame, new: DataFrame, fields: tuple[str, ...] = ("full_name", "class_year")) -> DataFrame:
    """source_id, other_id, change, old_school, new_school, fields of every athlete of either roster (source_id, full_name, gender, class_year, school_id, scraped_at).

    By source_id: transfer if the school differs, update with the names of the fields that differ (null-safe), unchanged, added, removed. In a second pass an added and a removed athlete who alone
    in their roster's remainder bear one name and gender are one person with a new id: reidentified, or transfer if the school differs as well; other_id is then the new id.
    Athletes without a source_id can't be followed and are left out.
    """
    a, b = (_one_each(x).select("source_id", *[C(c).alias(f"{p}_{c}") for c in ("full_name", "gender", "class_year", "school_id")]) for x, p in ((old, "old"), (new, "new")))
    met = a.withColumn("was", F.lit(True)).join(b.withColumn("now", F.lit(True)), "source_id", "full")
    names = F.array_compact(F.array(*[F.when(~C(f"old_{f}").eqNullSafe(C(f"new_{f}")), F.lit(f)) for f in fields]))
    change = F.when(C("was").isNull(), "added").when(C("now").isNull(), "removed").when(~C("old_school_id").eqNullSafe(C("new_school_id")), "transfer").when(F.size(names) > 0, "update").otherwise("unchanged")
    rows = met.withColumn("change", change).withColumn("fields", F.when(C("change") == "update", F.array_join(names, ",")))

    def sole(side: str, change: str) -> DataFrame:
        key = marks.name_key(C(f"{side}_full_name"))
        left = rows.where(C("change") == change).select(C("source_id").alias(f"{side}_id"), key.alias("key"), C(f"{side}_gender").alias("gender"), C(f"{side}_school_id").alias(f"{side}_school")).where("key != ''")
        return left.groupBy("key", "gender").agg(F.min(f"{side}_id").alias(f"{side}_id"), F.min(f"{side}_school").alias(f"{side}_school"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")

    pairs = sole("old", "removed").join(sole("new", "added"), ["key", "gender"])
    moved = pairs.select(C("old_id").alias("source_id"), C("new_id").alias("other_id"), F.when(C("old_school").eqNullSafe(C("new_school")), "reidentified").otherwise("transfer").alias("change"), "old_school", "new_school", F.lit(None).cast("string").alias("fields"))
    gone = moved.select(F.explode(F.array("source_id", "other_id")).alias("source_id"))
    rest = rows.join(gone, "source_id", "left_anti").select("source_id", F.lit(None).cast("string").alias("other_id"), "change", C("old_school_id").alias("old_school"), C("new_school_id").alias("new_school"), "fields")
    return rest.unionByName(moved)
