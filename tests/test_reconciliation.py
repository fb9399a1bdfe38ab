"""Reconciliation of meets against a loop over the sources of each meet."""

import collections
import random

import pytest

from lapwing.operators import reconciliation

SOURCE = "key string, meet long, team long, mark string, place int, round string, lineup string, ordinal int"
LOCAL = "id long, meet long, team long, valid boolean, mark string, place int, round string, lineup string"


def score(s, t):
    return (8 if s["place"] == t["place"] else 0) + (4 if s["round"] and s["round"] == t["round"] else 0) + (1 if not s["round"] or not t["round"] else 0) + (16 if s["lineup"] and s["lineup"] == t["lineup"] else 0)


def loop(sources, locals_):
    """Outcomes of one meet, one source after another."""
    out = [(s["key"], None, "unresolved") for s in sources if s["team"] is None] + [(None, t["id"], "invalid") for t in locals_ if not t["valid"]]
    resolved, left = sorted((s for s in sources if s["team"] is not None), key=lambda s: (s["ordinal"], s["key"])), {t["id"]: t for t in locals_ if t["valid"]}
    done = set()
    for s in resolved:
        same = [t for t in left.values() if t["team"] == s["team"] and (t["mark"] or "missing") == (s["mark"] or "missing")]
        ranked = sorted(same, key=lambda t: -score(s, t))
        exact = ranked[0] if len(ranked) == 1 or len(ranked) > 1 and score(s, ranked[0]) > score(s, ranked[1]) else None
        if exact:
            del left[exact["id"]]
            done.add(s["key"])
            out.append((s["key"], exact["id"], "matched"))
            continue
        of_team = [t for t in left.values() if t["team"] == s["team"]]
        if len(of_team) == 1 and [x["key"] for x in resolved if x["team"] == s["team"] and x["key"] not in done] == [s["key"]]:
            del left[of_team[0]["id"]]
            done.add(s["key"])
            out.append((s["key"], of_team[0]["id"], "conflict"))
            continue
        out.append((s["key"], None, "missing"))
    return out + [(None, i, "extra") for i in left]


@pytest.mark.parametrize("seed", range(3))
def test_outcomes_equal_a_loop(spark, seed):
    rng = random.Random(seed)
    fact = lambda: {"meet": rng.randint(1, 8), "team": rng.randint(1, 3), "mark": rng.choice(["40.1", "40.1", "40.2", "DQ", None]), "place": rng.choice([None, 1, 2]), "round": rng.choice([None, "Finals", "Preliminaries"]), "lineup": rng.choice([None, "", "a|b", "c|d"])}
    sources = [fact() | {"key": f"s{i:03}", "ordinal": rng.randint(0, 20)} for i in range(70)]
    for s in sources:
        s["team"] = None if rng.random() < 0.1 else s["team"]
    locals_ = [fact() | {"id": i, "valid": rng.random() < 0.9} for i in range(70)]
    meets = [(m, "canonical", "present") for m in range(1, 9)]
    pick = lambda rows, kind: spark.createDataFrame([tuple(r[c.split()[0]] for c in kind.split(", ")) for r in rows], kind)
    rows, states = reconciliation.reconcile_meets(spark.createDataFrame(meets, "meet long, kind string, snapshot string"), pick(sources, SOURCE), pick(locals_, LOCAL))
    got = collections.Counter((r.meet, r.key, r.id, r.outcome) for r in rows.collect())
    want = collections.Counter((m, *x) for m, _, _ in meets for x in loop([s for s in sources if s["meet"] == m], [t for t in locals_ if t["meet"] == m]))
    assert got == want
    assert sum(1 for r in got if r[1]) == 70 and sum(1 for r in got if r[2] is not None) == 70
    for r in states.collect():
        kinds = {x[3] for x in got if x[0] == r.meet}
        assert r.status == ("matched" if kinds <= {"matched"} else "needs_review" if "unresolved" in kinds else "repair_ready")


def test_meets_that_are_not_compared(spark):
    meets = [(1, "combined_child", "present"), (2, "combined_child_candidate", "present"), (3, "canonical", None), (4, "canonical", "unavailable"), (5, "canonical", "not_contested"), (6, "preliminary", "not_contested"), (7, "canonical", "present"), (8, "canonical", "present")]
    sources = spark.createDataFrame([("a", 1, 1, "40", 1, None, None, 1), ("b", 8, 1, "40", 1, None, None, 1), ("c", 8, 2, "41", 1, None, None, 2)], SOURCE)
    locals_ = spark.createDataFrame([(1, 5, 1, True, "40", 1, None, None), (2, 8, 1, True, "40", 2, None, None), (3, 8, 2, True, "42", 1, None, None), (4, 3, 1, True, "40", 1, None, None)], LOCAL)
    rows, states = reconciliation.reconcile_meets(spark.createDataFrame(meets, "meet long, kind string, snapshot string"), sources, locals_)
    assert {r.meet: (r.status, r.reason) for r in states.collect()} == {
        1: ("child", "verified_combined_events_child"), 2: ("needs_review", "combined_events_parent_not_verified"), 3: ("blocked", "source_unavailable"), 4: ("blocked", "source_unavailable"),
        5: ("needs_review", "event_not_held_but_local_rows_exist"), 6: ("not_contested", "event_verified_not_held"), 7: ("needs_review", "event_present_but_no_rows"), 8: ("repair_ready", "source_database_difference"),
    }
    assert sorted(((r.key, r.id, r.outcome) for r in rows.collect()), key=str) == sorted([("a", None, "not_compared"), ("b", 2, "matched"), ("c", 3, "conflict"), (None, 1, "extra"), (None, 4, "not_compared")], key=str)
