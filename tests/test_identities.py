"""Evidence and reviewed plans against literals: nulls, ties and empty tables among them."""

import datetime

from pyspark.sql import functions as F

from lapwing.operators import evidence, reviews


def test_scored_meets_take_nulls_and_ties(spark):
    d = datetime.date
    schema = "{0}_id int, {0}_name string, {0}_place string, {0}_start date, {0}_end date"
    found = spark.createDataFrame([(1, "a open", None, d(2026, 3, 1), d(2026, 3, 2)), (2, None, "x", d(2026, 3, 1), d(2026, 3, 1)), (3, "b", "x y", d(2026, 3, 1), d(2026, 3, 1)), (4, "b", None, None, None)], schema.format("f"))
    known = spark.createDataFrame([(9, "a open", "z", d(2026, 3, 2), d(2026, 3, 2)), (8, "a open", "z", d(2026, 3, 2), d(2026, 3, 2)), (7, "b", "x", d(2026, 3, 4), d(2026, 3, 4)), (6, "b", "x y", d(2026, 3, 4), d(2026, 3, 5))], schema.format("k"))
    got = sorted(tuple(r) for r in evidence.scored_meets(found, known).collect())
    assert got == [(1, 8, 115), (3, 6, 110)]
    assert evidence.scored_meets(found.limit(0), known).count() == 0


def test_likeness(spark):
    df = spark.createDataFrame([("ab", "ab", False), ("spring open", "spring", False), ("rain city open", "open raincoat", False), ("x", "y", True), ("ab cd", "zz", False), (None, "a", False)], "a string, b string, m boolean")
    got = [r[0] for r in df.select(evidence.name_likeness(F.col("a"), F.col("b"), F.col("m"))).collect()]
    assert got[:2] == [1.0, 0.85] and abs(got[2] - 2 / 3) < 1e-9 and got[3:] == [0.95, 0.0, None]


def test_prefixes_and_source_identity(spark):
    names = spark.createDataFrame([("ohio state", "M", 1), ("ohio tech", "M", 2), ("ohio state x", "F", 3), ("solo", "M", 4), (None, "M", 5)], "name string, g string, v int")
    assert sorted((r.key, r.value) for r in evidence.prefix_lookup(names, "name", "g", "v").collect()) == [("ohio state|F", 3), ("ohio|F", 3)]
    links = spark.createDataFrame([("a", "direct_profile", 1), ("a", "verified_alias", 2), ("b", "direct_profile", 1), ("b", "direct_profile", 2), ("c", "guess", 1), ("d", "direct_profile", 4), ("d", "direct_profile", 4)], "k string, m string, v int")
    assert sorted(map(tuple, evidence.source_identity(links, "k", "m", "v").collect())) == [("a", "resolved", 2, "reviewed_identity"), ("b", "conflict", None, None), ("c", "conflict", None, None), ("d", "resolved", 4, "direct_profile")]


def test_corroboration(spark):
    facts = spark.createDataFrame([(1, "a", 10, 5, 7), (2, "a", None, 5, 7), (3, "b", 12, 5, 7), (4, "c", 10, 5, 8), (5, None, 10, 5, 7)], "fact_id int, name string, school int, team int, meet int")
    people = spark.createDataFrame([(1, "a", 10), (2, "a", 11), (3, "b", 10), (4, "c", 10), (5, "c", 10), (6, None, 10)], "person int, name string, person_school int")
    played = spark.createDataFrame([(3, 5, 1), (3, 5, 2), (5, 1, 8)], "person int, team int, meet int")
    got = sorted(map(tuple, evidence.corroborated(facts, people, ["name"], played, played).collect()))
    assert got == [(1, 1, "exact_name_gender_school"), (3, 3, "exact_name_gender_team_participation"), (4, 5, "exact_name_gender_school_meet_participation")]


def test_guards_stand_in_order(spark):
    df = spark.createDataFrame([(1, None), (2, True), (3, False)], "i int, g boolean")
    got = [r[0] for r in df.orderBy("i").select(reviews.first_reason([(F.col("g"), "first"), (F.col("i") > 0, "second")])).collect()]
    assert got == ["second", "first", "second"]


def test_empty_twins_and_groups(spark):
    people = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "person int, name string")
    facts, legs = spark.createDataFrame([(1,), (None,)], "person int"), spark.createDataFrame([], "person int")
    assert [r.person for r in reviews.empty_twins(people, "name", facts, [legs]).collect()] == [2]
    cases = spark.createDataFrame([("k", "x", None), ("k", "y", "z"), (None, "x", "z")], "k string, a string, b string")
    assert sorted(((r.k or "", r.n, r.conflicts) for r in reviews.consistent_groups(cases, ["k"], ["a", "b"]).collect())) == [("", 1, ""), ("k", 2, "a")]


def test_names_backed_by_schools(spark):
    facts = spark.createDataFrame([(1, "a", "Univ. of Austin"), (2, "a", "State College"), (3, "b", "Austin"), (4, "c", None), (5, None, "Austin"), (6, "d", "Austin")], "fact_id int, name string, team string")
    people = spark.createDataFrame([(1, "a", "Austin State"), (2, "a", "State"), (3, "b", "Austin"), (4, "b", "Austin's"), (5, "c", "Austin"), (6, "b", "austin")], "person int, name string, school string")
    got = sorted(tuple(r) for r in evidence.by_name_and_school(facts, people, ["name"]).collect())
    assert got == [(1, 1, "name_school"), (2, None, "ambiguous_name"), (3, None, "ambiguous_school"), (4, None, "no_school_corroboration"), (5, None, "no_name_match"), (6, None, "no_name_match")]
    meets, schools = spark.createDataFrame([(1, "TX"), (2, "TX"), (3, None), (4, "TX")], "meet int, host string"), spark.createDataFrame([(1, "OK"), (1, "TX"), (2, "OK"), (2, None), (3, "TX"), (4, None)], "meet int, state string")
    assert sorted(map(tuple, evidence.host_verdicts(meets, schools).collect())) == [(1, "real"), (2, "copy"), (3, None), (4, None)]


def test_profiles(spark):
    rows = [(1, 5, "ann lee", "ann lee", None, True), (1, 4, "ann lee", "ann lee", False, True), (1, 3, "ann lee", "ann b lee", True, None), (2, 6, "bo", "bo", None, None), (3, 7, "bo", "cy", True, True), (4, 8, None, "cy", True, True), (5, 9, "al", "al li", False, False)]
    df = spark.createDataFrame(rows, "k int, p int, a string, b string, s boolean, c boolean")
    got = evidence.profile_matches(df, "k", "p", F.col("a"), F.col("b"), F.col("s"), F.col("c")).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, 3, 80, "high", False), (2, 6, 50, "medium", True), (5, 9, 30, "low", False)]
