"""Values, names, places and scores against literals."""

import datetime

from pyspark.sql import functions as F

from lapwing.functions import records, scores


def values(spark, texts, f):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", f(F.col("t")).alias("v")).orderBy("i").select("v").collect()]


def test_values(spark):
    assert values(spark, ["7", "7abc", " 12 ", "-3", "0", "x9", "", None], records.positive_integer) == [7, 7, 12, None, None, None, None, None]
    assert values(spark, ["2026-05-01", " 2026-05-01\n", "2026-02-30", "May 1", "", None], records.iso_date) == [datetime.date(2026, 5, 1)] * 2 + [None] * 4
    assert values(spark, [" a\t", "  ", "", None], records.clean_text) == ["a", None, None, None]
    assert values(spark, ["Unattached", "unattached  team", "-", "—", "Open", "Openfield", "State", None], records.is_no_team) == [True, True, True, True, True, False, False, False]
    assert values(spark, ["NM  NM", "NM NH", "DNF\tDNF", "10.2", None], records.doubled_code) == ["NM", None, "DNF", None, None]


def test_names(spark):
    names = ["Jet van der Heijden", "John Smith Jr.", "Ahmed Ahmed", "Cher", "Al (M63)", "Eva de la Cruz III", "Van Dam", "Name Withheld", "", None, "De La Cruz"]
    got = [r and (r.first, r.last) for r in values(spark, names, records.person_name)]
    assert got == [("Jet", "van der Heijden"), ("John", "Smith"), None, None, None, ("Eva", "de la Cruz"), ("Van", "Dam"), None, None, None, ("De", "La Cruz")]
    assert values(spark, ["Unknown", "N/A", "n. a.", "No Name", "Ann", "", None, "Ünknown"], records.is_placeholder) == [True, True, True, True, False, True, True, True]
    assert values(spark, ["Tech - B", "Tech-a", "Tech Unattached", "State – X", None], records.team_name) == ["tech", "tech", "tech", "state x", None]


def test_places(spark):
    assert values(spark, ["Boise, Idaho * Ed Track", "Albany, N.Y.", "Reno, nv", "Paris, France", None], records.state_of) == ["ID", "NY", "NV", None, None]
    assert values(spark, ["4x100m", "4 × 100 Meter Relay", "4x100 Shuttle Hurdles", "14x100", "100", None], records.is_four_by_100) == [True, True, False, False, False, None]
    assert values(spark, ["2025-12-06", "2025-12-07", "2025-12-08"], lambda t: records.last_saturday(t.cast("date"))) == [datetime.date(2025, 11, 29), datetime.date(2025, 12, 6), datetime.date(2025, 12, 6)]
    assert values(spark, ["Indoor Meet", "Indoor to Outdoor", "XC Open", "Open", None], records.season_of_name) == ["indoor", None, "xc", None, None]


def test_scores(spark):
    rows = [("M", "60m", True, 6.6), ("M", "60m", True, 12.1), ("F", "hj", False, 1.9), ("F", "hj", True, 0.9), ("M", "egg", True, 3.0), (None, "60m", True, 7.0), ("M", "60m", True, None), ("M", "200m", True, 21.0), ("M", "200m", False, 21.0)]
    got = [r.points for r in scores.scored(spark, spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "gender string, event string, indoor boolean, x double, i int")).orderBy("i").collect()]
    assert got[1] is None and got[3:7] == [None] * 4 and got[7] > got[8] > 900 and 1100 < got[0] < 1300 and got[2] > 1000
    table = {(g, e, i) for g, e, i, *_ in scores.curves()}
    assert len(table) == len(scores.curves())
