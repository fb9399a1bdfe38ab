"""Points by a file of coefficients."""

import json

from lapwing.functions import scores


def test_file_of_coefficients(spark, tmp_path):
    (tmp_path / "k.json").write_text(json.dumps({"men": {"60m": [0, -100, 2000], "60m sh": [0, -100, 2001], "HJ": [0, 500, 0], "bad": [1, 2], "null": None}, "women": {"60m": [0, -100, 2100.4]}, "mixed": {"60m": [1, 1, 1]}}, indent=1))
    curves = scores.file_curves(spark, str(tmp_path / "k.json"))
    assert {(r.gender, r.event, r.short) for r in curves.collect()} == {("M", "60m", False), ("M", "60m", True), ("M", "HJ", False), ("F", "60m", False)}
    marks = spark.createDataFrame(
        [(1, "M", "60m", True, 7.0), (2, "M", "60m", False, 7.0), (3, "F", "60m", True, 7.0), (4, "M", "60m", True, 5.9), (5, "M", "60m", True, 12.1), (6, "M", "HJ", True, 2.0), (7, "M", "bad", True, 2.0), (8, None, "60m", True, 7.0), (9, "M", "HJ", None, None), (10, "M", "HJ", False, -1.0)],
        "id int, gender string, event string, indoor boolean, x double",
    )
    got = {r.id: r.points for r in scores.scored_by_file(spark, marks, curves).collect()}
    assert got == {1: 1301, 2: 1300, 3: 1400, 4: None, 5: None, 6: 1000, 7: None, 8: None, 9: None, 10: 0}
