"""Result entries made from the orders table: the key of an order picks a spelling for each field, so that every rule meets its cases on every row.

The tables have no result entries; what is looked at is the rule, not the make-up of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.sources.tables import table

#: Field, factor and step of the key, and the spellings.
SPELLINGS: dict[str, tuple[int, int, list[str | None]]] = {
    "name": (7, 1, ["Ann Lee", "José Núñez", "Mary Van Der Berg", "John Smith Jr.", "unknown", "N/A", "Bo", "Name Withheld", "Al 2 Smith", "Eva de la Cruz", "Tom Tom", "  Zoë   Young ", "", None, "Kim Yu II", "Unattached", "Li San", ",", "ann  lee", "Robert Ray III"]),
    "team": (11, 3, ["State A", "Unattached", "independent", "-", "—", "Open", "Unaffiliated", "Unattached Athlete", "State College - B", "Tech Unattached", "", None, "Openfield"]),
    "division": (13, 2, ["DI", "d1", "Division I", "NCAA Division II", "DII", "NAIA", "NJCAA", "JUCO", "DIII", None, "Other", "ncaa division i"]),
    "gender": (5, 0, ["M", "F", "F", "M", None]),
    "event": (3, 2, ["60 Meters", "200 Meters", "400m", "800 Meters", "Mile", "3000m", "60 Hurdles", "High Jump", "Long Jump", "Shot Put", "4x100 Meter Relay", "4 x 100 Shuttle Hurdles", "DMR", "4×100", "Sprint Medley", "4xMile", "Women's 200 Meters", "Men's Mile", ""]),
    "mark": (17, 1, ["10.24  (2.0)", "10.35a", "10.6", "1:05:37.73", "1:00:06.1", "5.08m", "24-01.50", "15' 6.75\"", "0:00.0", "8420", "DNS", "NM  NM", "10.35", "45.15A", "45.15", "6.88", "6.88m", None, "dq", "NH NM"]),
    "round": (19, 4, ["Finals", "Heat 3", "Semi-Finals", "Prelims", "prelim_qualifying", "h #2", "", None, "Round 1", "FINAL"]),
    "meet": (23, 7, ["Tech Invite 2026 [M]", "Ocean Open & Relays (Outdoor)", "Indoor Classic", "Outdoor Championships", "XC Preview", "Coach's Meet presented by Acme", "Indoor to Outdoor Bridge", None, "Tech invite"]),
    "location": (29, 2, ["Boise, Idaho * Ed Track", "Austin, Texas", "Reno, NV", "Albany, N.Y.", "Nowhere", "Paris, France", None, "Ames, Iowa", "Salem, ore."]),
    "url": (31, 6, ["https://www.tfrrs.org/athletes/42/x", "https://live.pttiming.com/a", "https://www.athletic.net/athlete/77/track", "https://x.milesplit.com/y", "http://jdlfasttrack.com/r", "https://finishlynx.io/q", "https://example.org/Mens-100-Meters", "https://example.org/womens-mile", None]),
    "raw_date": (37, 1, ["2026-05-01", " 2026-13-01 ", "2026-02-30", "", None, "not a date", "2025-12-31"]),
    "raw_number": (41, 3, ["7", "7abc", "-3", "0", " 12 ", "x9", "", None, "3.9"]),
}


def _at(field: str) -> Column:
    factor, step, values = SPELLINGS[field]
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.floor(F.col("o_orderkey") / factor) + F.col("o_orderkey") * (step + 1), F.lit(len(values))) + 1).cast("int"))


def entries(spark: SparkSession, d: str) -> DataFrame:
    """A row for each order: id, athlete, day, place (null where 0), x (a performance in seconds or metres) and every spelled field."""
    k = F.col("o_orderkey")
    x = F.round(F.lit(6.0) + F.pmod(k, F.lit(997)) * 0.37, 2)
    return table(spark, d, "orders").select(k.alias("id"), F.col("o_custkey").alias("athlete"), F.to_date("o_orderdate").alias("day"), F.nullif(F.pmod(k, F.lit(9)), F.lit(0)).cast("int").alias("place"), x.alias("x"), *[_at(f).alias(f) for f in SPELLINGS])


def _sql(field: str) -> str:
    factor, step, values = SPELLINGS[field]
    spelled = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{spelled}])[((o_orderkey // {factor} + o_orderkey * {step + 1}) % {len(values)}) + 1] AS {field}"


#: The same rows in SQL, to stand first in a WITH.
ENTRIES = f"e AS (SELECT o_orderkey AS id, o_custkey AS athlete, o_orderdate::DATE AS day, nullif(o_orderkey % 9, 0)::INT AS place, round(6.0 + (o_orderkey % 997) * 0.37::DOUBLE, 2) AS x, {', '.join(map(_sql, SPELLINGS))} FROM orders)"
