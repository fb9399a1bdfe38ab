"""Profiles, foreign keys and roster changes on small tables."""

import json

from lapwing.operators import profiles, rosters
from lapwing.operators.profiles import ForeignKey


def test_profiles(spark):
    a = spark.createDataFrame([(1, None, " "), (None, None, ""), (3, 2, "x")], "id long, `odd name` int, t string")
    b = spark.createDataFrame([], "id long")
    got = {(r.table, r.column): (r.n_rows, r.n_null, r.n_empty, r.null_rate) for r in profiles.columns({"a": a, "b": b}).collect()}
    assert got == {("a", "id"): (3, 1, 0, 1 / 3), ("a", "odd name"): (3, 2, 0, 2 / 3), ("a", "t"): (3, 0, 2, 0.0), ("b", "id"): (0, 0, 0, None)}


def test_foreign_keys(spark):
    child = spark.createDataFrame([(1, 1), (1, None), (None, None), (2, 2), (2, 2)], "x long, y long")
    parent = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (None, None, "c")], "x long, y long, z string")
    tables = {"c": child, "p": parent, "e": child.limit(0)}
    keys = [ForeignKey("c", ["x", "y"], "p", ["x", "y"]), ForeignKey("c", ["x"], "p", ["x"]), ForeignKey("c", ["x"], "p", ["z"]), ForeignKey("c", ["no"], "p", ["x"]), ForeignKey("q", ["x"], "p", ["x"]), ForeignKey("e", ["x"], "p", ["x"])]
    got = [tuple(r)[1:] for r in profiles.foreign_keys(tables, keys).collect()]
    assert got == [(True, 5, 2, 1, 1), (True, 5, 2, 1, 0), (False, None, None, None, None), (False, None, None, None, None), (False, None, None, None, None), (True, 0, 0, 0, 0)]


def test_rosters(spark, tmp_path):
    for division, school, men, women in (("DI", 1, [("a", "Ann Lee", "SR"), (None, "No Id", "FR")], []), ("DII", 2, [("b", "Bo Ray", None)], [("c", "Cy", "FR"), ("x", "Same Name", "FR"), ("y", "Same Name", "FR")])):
        (tmp_path / division).mkdir()
        rows = [[dict(zip(("source_id", "full_name", "class_year"), r)) for r in side] for side in (men, women)]
        (tmp_path / division / f"{school}.json").write_text(json.dumps({"school_id": school, "school_name": "S", "scraped_at": "2026", "men_roster": rows[0], "women_roster": rows[1]}, indent=2))
    (tmp_path / "DI" / "bad.json").write_text("{no")
    new = rosters.consolidated(spark, str(tmp_path)).where("school_id IS NOT NULL")
    assert {(r.source_id, r.gender, r.division, r.school_id) for r in new.collect()} == {("a", "M", "DI", 1), (None, "M", "DI", 1), ("b", "M", "DII", 2), ("c", "F", "DII", 2), ("x", "F", "DII", 2), ("y", "F", "DII", 2)}
    old = spark.createDataFrame(
        [("a", "Ann Lee", "M", "JR", 1, "2025"), ("b", "Bo Ray", "M", None, 9, "2025"), ("b", "Bo R", "M", None, 8, "2024"), ("old", "CY", "F", "FR", 2, "2025"), ("z", "Same Name", "F", "FR", 2, "2025"), (None, "Nobody", "M", None, 1, "2025")],
        "source_id string, full_name string, gender string, class_year string, school_id long, scraped_at string",
    )
    got = {r.source_id: (r.other_id, r.change, r.old_school, r.new_school, r.fields) for r in rosters.diff(old, new).collect()}
    # two added athletes of one name are not paired with the removed one
    assert got == {
        "a": (None, "update", 1, 1, "class_year"), "b": (None, "transfer", 9, 2, None), "old": ("c", "reidentified", 2, 2, None),
        "z": (None, "removed", 2, None, None), "x": (None, "added", None, 2, None), "y": (None, "added", None, 2, None),
    }
    assert rosters.diff(old.limit(0), old.limit(0)).count() == 0
