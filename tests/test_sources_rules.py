"""Team ids by source, states of imports and repeats of legs on literals."""

from pyspark.sql import functions as F

from lapwing.operators import sources


def test_teams_by_source(spark):
    teams = spark.createDataFrame(
        [(1, "Riverside City College", "M", "77", "CA"), (2, "Riverside City College", "F", "77", "CA"), (3, "San Diego Mesa", "M", "5", "CA"), (4, "San Diego Miramar", "M", "5", "NV"), (5, "Ohio A&M", "M", None, None), (6, "Twin", "M", "9", "CA"), (7, "Twin", "M", "9", "CA"), (8, None, "M", "8", None)],
        "team_id long, name string, gender string, source_key string, state string",
    )
    rows = spark.createDataFrame(
        [("a", "x", "M", "5", "nv"), ("b", "x", "M", " 77 ", None), ("c", "x", "M", "5", None), ("d", "riverside city college", "F", None, None), ("e", "Ohio A M", "M", None, None), ("f", "Riverside City", "M", None, None), ("g", "San Diego", "M", None, None), ("h", "Twin", "M", "9", "CA"), ("i", "Riverside", None, "77", "CA"), ("j", None, "M", "8", "CA"), ("k", "", "M", None, None)],
        "id string, name string, gender string, source_key string, state string",
    )
    got = {r.id: (r.resolved, r.method) for r in sources.teams_by_source(rows, teams).collect()}
    assert got == {
        "a": (4, "state_key"), "b": (1, "key"), "c": (None, None), "d": (2, "name"), "e": (5, "plain_name"), "f": (1, "prefix"), "g": (None, None), "h": (None, None), "i": (None, None), "j": (8, "key"), "k": (None, None),
    }


def test_environment_and_status(spark):
    df = spark.createDataFrame([("Indoor 2026", 0, 0, 0), ("outdoor", 3, 1, 2), ("XC", 3, 1, 0), ("Track indoor", 3, 0, 0), (None, 3, 0, 1)], "label string, o int, r int, q int")
    status, error = sources.import_status(F.col("o"), F.col("r"), F.col("q"))
    assert [tuple(r) for r in df.select(sources.environment_of(F.col("label")).alias("e"), status.alias("s"), error.alias("x")).collect()] == [
        ("indoor", "no_results_at_source", None), ("outdoor", "partial", "quarantined_observations=2"), ("xc", "imported", None), (None, "pending", "source rows without a canonical one"), (None, "partial", "quarantined_observations=1"),
    ]


def test_leg_repeats(spark):
    legs = spark.createDataFrame([(1, 1, 1, "a", "x"), (1, 1, 1, None, " "), (1, 1, 2, "", "y"), (2, 1, None, "a", None), (2, 1, None, None, None), (None, 1, 1, "a", "a"), (3, 1, 1, "a", "a")], "parent long, athlete long, leg int, source_id string, name string")
    assert {tuple(r) for r in sources.leg_repeats(legs).collect()} == {("by_slots", "2", 1, 2, 1, 2), ("by_slots", "0", 1, 1, 1, 0), ("by_pair", "1,2", 1, 2, None, None), ("by_pair", "", 1, 1, None, None), ("exact", "", 1, 1, None, None)}
