"""Probes against a loop over runs."""

import json
import random

from lapwing.operators import probes

QUEUE = "meet long, status string, relay_coverage string, needs_relays boolean, needs_individual boolean, n_relay_facts long, n_quarantined long, last_error string, run_id long"
RUNS = "run_id long, at int, mode string, status string, scope string"


def loop(queue, runs):
    state = {q[0]: list(q) for q in queue}
    for run_id, _, mode, status, scope in sorted(runs, key=lambda r: (r[1], r[0])):
        try:
            s = json.loads(scope or "")
        except ValueError:
            continue
        if mode != "dry_run" or status != "succeeded" or s.get("relays_only") is not True:
            continue
        seen, relays = s.get("source_observation_count"), s.get("source_relay_observation_count")
        if seen is None or relays is None or seen <= 0:
            continue
        for meet in [s["meet_id"]] if "meet_id" in s else s.get("meet_ids", []):
            q = state.get(meet)
            if q is None or q[1] not in probes.OPEN:
                continue
            held = (q[6] or 0) > 0
            q[2], q[3], q[8] = ("present" if relays else "absent"), bool(relays and not q[5]), run_id
            q[7] = f"source_observations_quarantined={q[6]}" if held else None if not relays else q[7]
            q[1] = "partial" if held else "complete" if not relays and not q[4] else q[1]
    return {k: (q[1], q[2], q[3], q[7], q[8]) for k, q in state.items()}


def test_probes_equal_a_loop_and_change_nothing_twice(spark):
    rng = random.Random(3)
    queue = [(i, rng.choice([*probes.OPEN, "complete", "failed"]), rng.choice(["unknown", "present"]), rng.choice([True, False]), rng.random() < 0.4, rng.randint(0, 1), rng.choice([None, 0, 0, 4]), rng.choice([None, "e"]), None) for i in range(60)]
    runs = []
    for i in range(80):
        scope = {"relays_only": rng.choice([True, True, True, False, None]), "source_observation_count": rng.choice([None, 0, 5, 9, 9]), "source_relay_observation_count": rng.choice([None, 0, 2, 3])}
        scope |= {"meet_id": rng.randint(0, 65)} if rng.random() < 0.3 else {"meet_ids": [rng.randint(0, 65) for _ in range(6)]}
        runs.append((i, rng.randint(0, 20), rng.choice(["dry_run", "dry_run", "apply"]), rng.choice(["succeeded", "succeeded", "failed"]), rng.choice([json.dumps(scope)] * 9 + ["bad"])))
    df, rf = spark.createDataFrame(queue, QUEUE), spark.createDataFrame(runs, RUNS)
    got = probes.apply_probes(df, rf)
    rows = got.collect()
    assert {r.meet: tuple(r.after) for r in rows} == loop(queue, runs)
    assert all(r.changed == (tuple(r.before) != tuple(r.after)) for r in rows) and any(r.changed for r in rows)
    again = got.join(df.select("meet", "needs_individual", "n_relay_facts", "n_quarantined"), "meet").select("meet", "after.status", "after.relay_coverage", "after.needs_relays", "needs_individual", "n_relay_facts", "n_quarantined", "after.last_error", "after.run_id")
    assert not any(r.changed for r in probes.apply_probes(again, rf).collect())
