"""Fuzzy matches and head-to-head against brute force."""

import collections
import datetime
import random

from pyspark.sql import functions as F

import __spark_entry__
from lapwing.operators import fuzzy, races
from lapwing.plans import catalog


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def names(spark, rows):
    return spark.createDataFrame([(x,) for x in rows], "name string")


def test_close_names_miss_none(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 22))) for _ in range(40)]

    def typo(s):
        for _ in range(rng.randint(0, 6)):
            i = rng.randint(0, len(s))
            s = rng.choice([s[:i] + rng.choice("abc") + s[i:], s[:i] + s[i + 1 :], s[:i] + rng.choice("abc") + s[i + 1 :]])
        return s

    left, right = sorted({x for x in base if x}), sorted({typo(x) for x in base for _ in range(4)} - {""})
    got = {(r.a, r.b) for r in fuzzy.close_names(names(spark, left), names(spark, right)).collect()}
    want = {(a, b) for a in left for b in right if max(len(a), len(b)) >= 4 and 10 * edits(a, b) < 3 * max(len(a), len(b))}
    assert got == want and len(want) > 60


def test_name_variants(spark):
    rows = ["Ann Lee", "Lee, Ann", "Ann B. Lee", "O'Neil", None, "", "Van, ", "A  B C D"]
    got = [r.v for r in names(spark, rows).select(fuzzy.name_variants(F.col("name")).alias("v")).collect()]
    assert got[0] == ["ann lee", "lee ann"] and set(got[1]) == {"lee ann", "ann lee"} and got[2] == ["ann b lee", "b lee ann", "ann lee"]
    assert got[3] == ["oneil"] and got[4] == [""] and got[5] == [""] and got[6] == ["van"] and got[7] == ["a b c d", "b c d a", "a d"]


def test_match_people(spark):
    entries = spark.createDataFrame(
        [(1, "Lee, Ann", "Ohio State University"), (2, "Ann Lee", "Nowhere"), (3, "Jonathan Smithe", "Ohio"), (4, None, None), (5, "Bob", "Ohio"), (6, "Jonathan Smith", None), (7, "Ann Lee", "Nowhere")],
        "entry_id long, name string, team string",
    )
    people = spark.createDataFrame([(9, "Ann Lee", "Ohio (Main)"), (8, "Ann Lee", "Utah"), (7, "Jonathan Smith", "Ohio"), (6, "Jonathan Smith", None), (None, "Bob", "Ohio"), (5, "Zed", None)], "person_id long, full_name string, school string")
    got = {r.entry_id: (r.person_id, round(r.name_similarity, 3), r.team_matched, r.confidence) for r in fuzzy.match_people(entries, people).collect()}
    # 1: a turned name of the same team; 2 and 7: an equal name of other teams, ties to the least id; 3: a typo, helped by the team; 6: no school, no penalty
    assert got == {1: (9, 0.95, True, 1.0), 2: (8, 1.0, False, 0.8), 7: (8, 1.0, False, 0.8), 3: (7, 0.933, True, 1.0), 6: (6, 1.0, False, 1.0)}
    assert fuzzy.match_people(entries.limit(0), people).count() == 0 == fuzzy.match_people(entries, people.limit(0)).count()


def test_match_people_misses_none(spark):
    rng = random.Random(3)

    def typo(s, most):
        for _ in range(rng.randint(0, most)):
            i = rng.randint(0, len(s))
            s = rng.choice([s[:i] + rng.choice("ab c") + s[i:], s[:i] + s[i + 1 :], s[:i] + rng.choice("abc") + s[i + 1 :]])
        return s

    word = lambda least, most: "".join(rng.choice("abcde") for _ in range(rng.randint(least, most)))
    bases = [(" ".join(word(2, 9) for _ in range(rng.randint(1, 3))), " ".join(word(1, 10) for _ in range(rng.randint(1, 2)))) for _ in range(12)]
    of = lambda n: [(i, typo(x, 6), rng.choice([None, "", typo(y, 6), typo(y, 1), y[:3], " ".join(reversed(y.split(" ")))])) for i in range(n) for x, y in [rng.choice(bases)]]
    entries, people = of(90), of(70)
    plain = lambda s: " ".join("".join(c for c in (s or "") if c.isalpha() or c == " ").split())

    def variants(k):
        parts = k.split(" ")
        return {k} if len(parts) < 2 else {k, " ".join([*parts[1:], parts[0]]), *([f"{parts[0]} {parts[-1]}"] if len(parts) > 2 else [])}

    def like(a, b):
        return 1.0 if a == b else 0.0 if not a or not b else 0.95 if variants(a) & variants(b) else 1 - edits(a, b) / max(len(a), len(b))

    for accept in (0.75, 0.4, 0.9):
        want = {}
        for i, name, team in entries:
            best = (0, 0, None)
            for j, other, school in people:
                sim, t, u = like(plain(name), plain(other)), plain(team), plain(school)
                same = bool(school) and t != "" and u != "" and (t == u or t in u or u in t or like(t, u) > 0.7)
                score = sim + 0.3 if same else sim - 0.2 if school else sim
                if sim > 0.7 and score > 0:
                    best = max(best, (score, -j, (j, sim, same, min(score, 1.0))), key=lambda x: x[:2])
            if best[2] and best[2][3] > accept:
                want[i] = best[2]
        found = fuzzy.match_people(spark.createDataFrame(entries, "entry_id long, name string, team string"), spark.createDataFrame(people, "person_id long, full_name string, school string"), accept=accept).collect()
        assert {r.entry_id: (r.person_id, r.name_similarity, r.team_matched, r.confidence) for r in found} == want and len(want) > 30


def meet_points(a, b):
    x, y = set(a["tokens"]), set(b["tokens"])
    name = 0
    small = x if len(x) <= len(y) else y
    if x and y and len("".join(small)) >= 4:
        shared = len(x & y)
        name = 80 if x == y else 70 if shared == min(len(x), len(y)) else 55 if shared / len(x | y) >= 0.6 else 35 if shared / len(x | y) >= 0.4 else 0
    p, q = a["place"], b["place"]
    place = 0 if not p or not q else 25 if p == q else 10 if p in q or q in p else 0
    near = a["first"] and b["first"] and (b["first"] - a["last"]).days <= 2 and (a["first"] - b["last"]).days <= 2
    return name + place + (25 if near else 0)


def test_match_meets_miss_none(spark):
    rng = random.Random(2)
    words = ["ocean", "hill", "open", "relays", "tech", "ab", "c", "Outdoor", "2024", "Track & Field", "lake", "[M]"]
    day = datetime.date(2024, 4, 1)

    def side(n):
        out = []
        for i in range(n):
            first = None if rng.random() < 0.15 else day + datetime.timedelta(rng.randint(0, 25))
            last = None if first is None or rng.random() < 0.6 else first + datetime.timedelta(rng.randint(0, 20))
            out.append((i, None if rng.random() < 0.05 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 5))), rng.choice([None, "", "Ames, Iowa * x", "Ames", "Reno NV", "iowa"]), first, last))
        return spark.createDataFrame(out, "id long, name string, location string, first date, last date")

    known, found = side(60), side(60)
    plain = lambda df: [r.asDict() for r in df.select("id", fuzzy.meet_tokens(F.col("name")).alias("tokens"), fuzzy.place_key(F.col("location")).alias("place"), "first", F.coalesce("last", "first").alias("last")).collect()]
    a, b = plain(known), plain(found)
    want = {}
    for y in b:
        best = max(((meet_points(x, y), -x["id"]) for x in a), default=(0, 0))
        if best[0] >= 90:
            want[y["id"]] = (-best[1], best[0])
    assert {r.found_id: (r.known_id, r.score) for r in fuzzy.match_meets(known, found).collect()} == want and len(want) > 15


def test_head_to_head(spark):
    day = datetime.date(2024, 4, 1)
    rows = [
        (1, 1, "Ocean  Open", day, "Finals", 2, "10.0"), (2, 2, "Ocean Open ", day, "F", 3, "10.2"),  # one final
        (3, 1, "Ocean Open", day, "Heat 1", 1, "10.1"), (4, 2, "Ocean Open", day, "Heat 3", 1, "10.3"),  # preliminaries of two heats
        (5, 2, "Ocean Open", day, "P", 4, "10.3"),  # the same preliminaries once more
        (6, 1, "Ocean Open", None, None, 9, "10.0"),  # undated double of 1
        (7, 1, "Hill", None, None, 1, "11"), (8, 2, "Hill", None, "x", 2, "12"),  # undated both
        (9, 1, "Lake", day, "Finals", 1, "11"), (10, 2, "Lake", None, "Finals", 2, "12"),  # one undated
        (11, 1, "Bay", day, None, None, "11"), (12, 2, "Bay", day, None, 2, "12"),  # no place
        (13, 3, None, day, None, 1, "11"),
    ]
    results = spark.createDataFrame(rows, "id long, athlete long, meet string, day date, round string, place int, mark string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 2)], "a long, b long")
    got = {(r.a, r.b): (r.races, r.wins, r.losses, r.ties) for r in races.head_to_head(pairs, results).collect()}
    assert got == {(1, 2): (3, 2, 0, 1), (1, 3): (0, 0, 0, 0)}
    met = {(r.meet, r["round"]) for r in races.common_races(pairs, results).collect()}
    assert met == {("Ocean Open", "Final"), ("Ocean Open", "Prelim"), ("Hill", "x")}


def test_every_name_has_one_function():
    every = collections.Counter(k for m in catalog.MODULES for k in m.QUERIES)
    assert max(every.values()) == 1 and set(every) <= set(__spark_entry__.queries())
    try:
        catalog.together([{"a": 1}, {"a": 2}])
    except ValueError as e:
        assert "a" in str(e)
    else:
        raise AssertionError("a name given twice must be an error")
