"""Near copies of the pipeline against brute-force Jaccard similarity."""

import random

import corpus_pipeline
from lapwing.llm import near_copies, simhash_dedup


def shingled(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_gone(rows):
    sets, parent = [shingled(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, t or "") for k, (i, t) in enumerate(rows) if i is not None and i != least[find(k)])


def corpus():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    common = [rng.choice(words) for _ in range(60)]
    rows = []
    for g in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([3, 30, 80, 200]))] + common * (g % 3 == 0)
        for _ in range(rng.choice([1, 2, 12])):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append(" ".join(text))
    rng.shuffle(rows)
    return list(enumerate(rows)) + [(900, ""), (901, None), (902, " \n"), (None, rows[0]), (903, rows[1]), (903, "a text of its own, not a copy of others"), (904, rows[2].upper())]


def test_near_copies_are_those_of_brute_force(spark):
    rows = corpus()
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    left = sorted((r.doc_id, r.text or "") for r in kept if r.doc_id is not None)
    want = sorted((i, t or "") for i, t in rows if i is not None)
    for x in brute_gone(rows):
        want.remove(x)
    assert left == want and len(want) < len(rows) - 40 and sum(r.doc_id is None for r in kept) == 1


def test_leaders_leave_no_link_out(spark, monkeypatch):
    """A chain whose ends share prefix shingles but are not near copies of each other, with and without rounds of leaders; every shingle frequent."""
    words = [f"x{i}" for i in range(140)]
    rows = [(i, " ".join(words[2 * i : 2 * i + 60])) for i in range(40)] + [(100 + i, " ".join(words[5 * i : 5 * i + 40] + ["y"] * i)) for i in range(20)]
    for rounds in (1, 3):
        monkeypatch.setattr(near_copies, "ROUNDS", rounds)
        monkeypatch.setattr(near_copies, "SAMPLE_OF", 1)
        kept = {r.doc_id for r in simhash_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert kept == {i for i, _ in rows} - {i for i, _ in brute_gone(rows)}
    assert simhash_dedup.drop_near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
