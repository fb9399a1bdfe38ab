"""Names, dates, pages and JSON feeds against literals: nulls, empty and odd texts among them."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from lapwing.functions import events
from lapwing.operators import combined
from lapwing.sources import documents, html


def day(text):
    return datetime.date.fromisoformat(text) if text else None


def values(spark, rows, kind, f):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_event_names(spark):
    assert events.spellings()["4x800m relay"] == "4x800m" and events.spellings()["10000.0"] == "10,000m"
    assert values(spark, ["55.0", "55 Meter Dash", "500 meter dash", "3200 M", "", None, "Shot (O)", "100 hurdles final", "5k (XC)"], "string", events.event_label) == ["55m", "55m", "500 meter dash", "3200m", "", None, "Shot Put (O)", "100m H", "5k XC"]
    assert values(spark, ["60 H", "100m", "Women's Mile", " pole vault ", None, "smr"], "string", events.event_code) == ["60m H", "100m", "Mile", "Pole Vault", None, "SMR"]


def test_an_alias_with_two_meanings_fails(spark):
    rows = spark.createDataFrame([("x",), (None,), (" ",)], "name string")
    aliases = spark.createDataFrame([("X ", 1), ("x", 1), ("y", 2), (None, 3)], "raw_name string, event_type_id long")
    out = events.resolve_events(rows, "name", aliases)
    assert sorted((r[0], r[1]) for r in out.select("name", "event_type_id").where("name IS NOT NULL").collect()) == [(" ", None), ("x", 1)]
    assert out.count() == 3 and events.unmapped_names(out, "name").count() == 0
    with pytest.raises(Exception, match="two meanings"):
        events.resolve_events(rows, "name", aliases.unionByName(spark.createDataFrame([("x", 9)], aliases.schema))).collect()


def test_dates(spark):
    as_of = F.lit(day("2026-02-01"))
    got = values(spark, ["Fri Feb 20-Sat Feb 21", "December 30-31", "Thu Jan 29", "Fri Dec 5", "soon", None], "string", lambda c: events.calendar_dates(c, as_of))
    assert [r and (r.start, r.end) for r in got] == [(day(a), day(b)) for a, b in (("2026-02-20", "2026-02-21"), ("2026-12-30", "2026-12-31"), ("2026-01-29", "2026-01-29"), ("2026-12-05", "2026-12-05"), ("2026-02-01", "2026-02-01"))] + [None]
    old = values(spark, ["Feb 14-15"], "string", lambda c: events.calendar_dates(c, F.lit(day("2026-05-01"))))[0]
    assert (old.start, old.end) == (day("2027-02-14"), day("2027-02-15"))
    assert values(spark, ["03/14/26", "03/14-15/26", "12/01/99", "13/01/20", "x", None], "string", events.slash_date) == [day("2026-03-14"), day("2026-03-14"), day("1999-12-01"), None, None, None]
    assert values(spark, ["on Mar 14-15, 2026!", "February 30, 2026", "June 3 2025", "Marching 3, 2025", None], "string", events.long_date) == [day("2026-03-14"), None, day("2025-06-03"), None, None]
    on = F.lit(day("2026-03-14"))
    assert values(spark, ["March 16th, 2026", "18 Mar 2026", "11 March 2026", "March 14, 2025", "", None], "string", lambda c: events.mentions_date(c, on)) == [True, False, True, False, False, None]


def test_result_pages(spark):
    page = """<style>.imp {display:none}</style><table><thead><tr><th>skip</th></tr><tr><th>Pl</th><th>Name</th><th>Yr</th><th>Team</th><th>Time</th></tr></thead><tbody>
      <tr><td>1</td><td><a href="/athletes/77/A.html"> Ann &amp; B </a></td><td>SR</td><td><a href="/teams/x.html">X  U</a></td><td class="imp">9.99</td><td class="t round_4">10.24</td></tr>
      <tr><td>2</td><td>Cy</td><td></td><td>Y</td><td style="display: none">9.98</td><td class="round_2">DNF</td></tr><tr><td>3</td><td>No mark</td></tr></tbody></table>"""
    df = spark.createDataFrame([(1, page), (2, ""), (3, None), (4, "<table><tr>no cells</tr></table>")], "id int, html string")
    got = html.event_rows(df).orderBy("place").collect()
    assert [(r.id, r.athlete_id, r.athlete_name, r.team_name, r.team_url, r.round, r.mark_raw) for r in got] == [(1, "77", "Ann & B", "X U", "/teams/x.html", "Finals", "10.24"), (1, None, "Cy", "Y", None, "Preliminaries", "DNF")]
    assert html.multi_event_summary(df).count() == 0


def test_json_feeds(spark):
    doc = {"name": "a/b/c9", "fields": {"n": {"integerValue": "7"}, "x": {"doubleValue": 1}, "l": {"arrayValue": {}}, "m": {"mapValue": {"fields": {"k": {"nullValue": None}}}}, "t": {"timestampValue": "t"}}}
    df = spark.createDataFrame([(json.dumps(doc),), ("[1",), (None,)], "body string")
    got = documents.typed_documents(df, "body", "id STRING, n BIGINT, x DOUBLE, l ARRAY<STRING>, t STRING").collect()
    assert [(r.id, r.n, r.x, r.l, r.t) for r in got if r.id] == [("c9", 7, 1.0, [], "t")] and len(got) == 3
    deep = json.dumps({"athletes": [], "teamName": "T", "mark": "1", "sub": [{"athletes": [], "teamsAbbr": "U", "status": "DNS"}, {"athletes": [], "teamName": "T", "mark": "1"}, {"athletes": 3}]})
    rows = documents.relay_rows(spark.createDataFrame([(deep,), ("",), (None,)], "body string"), "body", "teamName STRING, teamsAbbr STRING").collect()
    assert [(r.row.teamName, r.row.teamsAbbr) for r in rows] == [("T", None), (None, "U")]
    nested = spark.createDataFrame([('{"e":{"E":{"ID":"1"},"ED":{"a":{"M":"x"},"b":null}},"f":null}',), ("{",)], "body string")
    assert [(r.event_key, r.entry_key, r.entry.M, r.event.E.ID) for r in documents.nested_entries(nested, "body", "E: STRUCT<ID: STRING>", "ED", "M: STRING").collect()] == [("e", "a", "x", "1")]


def test_relay_rows_are_read_once(spark):
    row = lambda n, **more: {"id": n, "athletes": ["x"], "teamName": f"t{n}", "mark": "x" if n == 3 else n / 2, "place": n} | more
    levels: list = []
    for _ in range(1200):
        levels = [levels]
    odd = [row(20, teamName="é" * 1500), row(21, place=10**1100), row(22, id=[1]), row(23, teamName={"a": 1}), row(24, extra=levels)]
    body = json.dumps({"page": [[row(n) for n in range(1, 20)], {"again": [row(n) for n in range(1, 20)]}], "odd": odd, "n": [1, "a", None]})
    df = documents.relay_rows(spark.createDataFrame([(7, body), (8, "3"), (9, "{"), (10, "[]")], "k int, body string"), "body", "id BIGINT, teamName STRING, mark DOUBLE, place INT")
    got = {(r.k, r.row.id, r.row.teamName, r.row.mark, r.row.place) for r in df.collect()}
    want = {(7, n, f"t{n}", None if n == 3 else n / 2, n) for n in [*range(1, 20), 24]}
    assert got == want | {(7, 20, "é" * 1500, 10.0, 20), (7, None, None, None, None), (7, None, "t22", 11.0, 22), (7, 23, '{"a":1}', 11.5, 23)}
    # the texts that leave Python: of 24 rows, eight to a text where short, and without what nobody asked for
    texts = spark.createDataFrame([(body,)], "body string").select(F.explode(documents._walk(F.col("body"), ["id", "teamName", "mark", "place"]))).collect()
    assert len(texts) == 2 + 8 and not any("athletes" in t[0] for t in texts)


def test_rosters(spark, tmp_path):
    for division, men in (("d1", ["A", "B"]), ("d2", [])):
        (tmp_path / division).mkdir()
        (tmp_path / division / "r.json").write_text(json.dumps({"men": [{"name": n} for n in men], "women": [{"name": "W" + division}]}, indent=1))
    got = documents.rosters(spark, str(tmp_path / "*"), "name STRING").collect()
    assert sorted(map(tuple, got)) == [("d1", "F", "Wd1"), ("d1", "M", "A"), ("d1", "M", "B"), ("d2", "F", "Wd2")]


def test_combined_events(spark):
    rows = [(1, 1, 10, True, 0, 5000.0, 2), (1, 1, 11, True, 200, 6000.0, 1), (1, 1, 12, False, 0, None, None), (1, 1, 13, False, 200, None, None), (2, 1, 14, False, 200, None, 1), (None, 1, 15, True, 0, 1.0, 1), (3, 1, 16, None, 0, None, None)]
    df = spark.createDataFrame(rows, "event int, athlete int, id int, total boolean, prio int, points double, place int")
    got = combined.collapse(df, ["event", "athlete"], F.col("total"), F.col("prio"), "points", "place", "id", []).orderBy("event").collect()
    assert [(r.event, r.total_id, [c.id for c in r.components]) for r in got] == [(1, 10, [12]), (2, None, [14]), (3, None, [16])]
