"""Commit of a run against a loop over its rows."""

import datetime
import random

import pytest

from lapwing.operators import commits

OBS = "id long, entity string, meet long, actor long, event long, measure string, mark string, mark_key string, place int, round string, team long, day date, lineup string, prior string, linked long, corrected boolean, snapshot boolean, errors int"
FACT = "id long, entity string, meet long, actor long, event long, measure string, mark string, mark_key string, place int, round string, team long, day date, lineup string"
ROUNDS = {None: None, "": None, "Finals": "Finals", "Final": "Finals", "Heat 1": "Preliminaries", "Prelims": "Preliminaries", "Semi": "Semifinals"}
CODES = ("dns", "dq")


def keys(x):
    perf = None if not (x["meet"] and x["event"] and x["actor"] and x["mark_key"]) else (x["entity"], x["meet"], x["actor"], x["event"], x["measure"], x["mark_key"])
    return perf, perf and (*perf, x["place"])


def status(x):
    return (x["mark"] or "").strip().lower() in CODES


def decide(o, facts, days):
    if o["errors"]:
        return "quarantine", "validation_failed", None
    relay = o["entity"] == "relay_result"
    perf, canon = keys(o)
    found = []
    for f in facts:
        fp, fc = keys({**f, "measure": f["measure"]})
        conflict = not relay and o["team"] is not None and f["team"] is not None and o["team"] != f["team"]
        gap = not relay and o["team"] is not None and f["team"] is None
        team = "represented_team_conflict" if conflict else "team_enrichment_required" if gap else None
        a, b = ROUNDS[o["round"]], ROUNDS[f["round"]]
        apart = bool(a and b and a != b)
        if relay and status(o) and status(f) and o["lineup"] and o["lineup"] == f["lineup"]:
            found.append((f, "same_relay_lineup_status"))
        elif not relay and status(o) and status(f) and o["meet"] == f["meet"] and o["day"] and o["day"] == f["day"] and not apart and o["place"] == f["place"]:
            found.append((f, team or ("same_status_code_same_performance" if o["mark"].lower() == f["mark"].lower() else "conflicting_status_codes")))
        elif canon and fc == canon:
            found.append((f, team or "same_performance_same_place"))
        elif perf and fp == perf and not apart:
            found.append((f, "same_performance_place_conflict"))
    here = [x for x in found if x[0]["meet"] == o["meet"]]

    def preference(f):
        a, b = ROUNDS[o["round"]], ROUNDS[f["round"]]
        raw, own = (f["round"] or "").strip() or None, (o["round"] or "").strip() or None
        return (100 if a and a == b else 0) + (10 if own and own == raw else 0) + (2 if raw and raw == b else 0) + {"Finals": 3, "Preliminaries": 2, "Semifinals": 1}.get(b, 0)

    if here and len({keys(f)[1] for f, _ in here}) == 1:
        found = [min(here, key=lambda x: (-preference(x[0]), x[0]["fresh"], x[0]["id"]))]
    elif len(here) == 1 and len(found) > 1:
        found = here
    if len(found) == 1:
        f, kind = found[0]
        return ("skip_duplicate" if kind in commits.SKIPS else "quarantine"), kind, (f["id"], f["fresh"])
    if found:
        return "quarantine", "multiple_matching_performances", None
    past = [f for f in facts if not relay and f["meet"] is None and f["measure"] == o["measure"] and f["mark_key"] and f["mark_key"] == o["mark_key"] and f["day"] and o["day"] and abs((f["day"] - o["day"]).days) <= days]
    if len(past) == 1:
        return "claim", "unlinked_history_exact_match", (past[0]["id"], False)
    if past:
        return "quarantine", "multiple_history_matches", None
    return "insert", "status_code_requires_source_identity" if relay and status(o) else "no_existing_match", None


def loop(observations, facts, days=7):
    facts, out = [{**f, "fresh": False} for f in facts], {}
    for o in sorted(observations, key=lambda x: x["id"]):
        if not o["snapshot"]:
            got = ("skip_duplicate", "source_record_already_linked", (o["linked"], False)) if o["linked"] else ("quarantine", "missing_source_snapshot", None)
        elif o["prior"] == "quarantine":
            got = ("quarantine", "preclassified", None)
        elif o["linked"]:
            got = ("quarantine", "source_correction_required", None) if o["corrected"] else ("skip_duplicate", "source_record_already_linked", (o["linked"], False))
        else:
            own = [f for f in facts if f["entity"] == o["entity"] and f["actor"] == o["actor"] and f["event"] == o["event"] and o["actor"] and o["event"]]
            got = decide(o, own, days)
            if got[0] == "insert":
                facts.append({**{k: o[k] for k in ("id", "entity", "meet", "actor", "event", "measure", "mark", "mark_key", "place", "round", "team", "day", "lineup")}, "fresh": True})
        out[o["id"]] = got
    return out


def some(rng, i, fact=False):
    mark = rng.choice(["10.1", "10.2", "DNS", "dq", None, "10.1"])
    entity = rng.choice(["individual_result", "individual_result", "relay_result"])
    row = {
        "id": i, "entity": entity, "meet": rng.choice([1, 1, 2]), "actor": rng.choice([1, 2, 2, None]) if rng.random() < 0.2 else rng.choice([1, 2]), "event": rng.choice([1, 1, 2]), "measure": "time",
        "mark": mark, "mark_key": mark and f"raw:{mark.lower()}", "place": rng.choice([None, 1, 1, 2]), "round": rng.choice(list(ROUNDS)), "team": rng.choice([None, 7, 7, 8]), "day": rng.choice([None, *[datetime.date(2024, 5, d) for d in (1, 1, 4, 20)]]),
        "lineup": rng.choice([None, "a|b", "c|d"]) if entity == "relay_result" else None,
    }
    if fact:
        return row | {"meet": rng.choice([row["meet"], None]) if entity != "relay_result" else row["meet"]}
    return row | {"prior": rng.choice([None, None, None, None, "quarantine", "pending"]), "linked": rng.choice([None] * 6 + [501]), "corrected": rng.choice([None, False, True]), "snapshot": rng.random() < 0.93, "errors": rng.choice([0] * 8 + [1, None])}


@pytest.mark.parametrize("seed", range(4))
def test_commit_run_equals_a_loop(spark, seed):
    rng = random.Random(seed)
    observations, facts = [some(rng, i) for i in range(160)], [some(rng, 500 + i, True) for i in range(rng.choice([0, 6, 25]))]
    rng.shuffle(observations)
    row = lambda x, kind: tuple(x[k.split()[0]] for k in kind.split(", "))
    got = commits.commit_run(spark.createDataFrame([row(o, OBS) for o in observations], OBS), spark.createDataFrame([row(f, FACT) for f in facts], FACT)).collect()
    assert len(got) == len(observations)
    want = loop(observations, facts)
    for r in got:
        decision, reason, matched = want[r.id]
        assert (r.decision, r.reason, (r.matched, r.matched_in_run) if r.matched is not None else None) == (decision, reason, matched), (r, want[r.id])
        assert r.confidence == commits.CONFIDENCE.get(r.reason)


def test_hot_bucket_takes_few_rounds(spark):
    day = datetime.date(2024, 5, 1)
    rows = [(i, "individual_result", 1, 1, 1, "time", "10.1", "raw:10.1", 1, ["Finals", "Heat 1"][i % 2], 7, day, None, None, None, None, True, 0) for i in range(3000)]
    got = commits.commit_run(spark.createDataFrame(rows, OBS), spark.createDataFrame([], FACT))
    assert {tuple(r) for r in got.groupBy("decision", "matched").count().collect()} == {("insert", None, 1), ("skip_duplicate", 0, 2999)}
