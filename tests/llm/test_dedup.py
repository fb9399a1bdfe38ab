"""Line, exact and SimHash dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lapwing.llm import exact_dedup, line_dedup, queries, simhash_dedup

SCHEMA = "doc_id long, text string, n int, d string, fp long, score double, `group` int, digest string"
LONG = "word " * 40_000


def messy(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, 0.5, 3, "y") for i, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, "a"), (4, LONG), (5, LONG), (6, "The same long line of text here.\nx"), (6, "The same long line of text here.\nx"), (None, "The same long line of text here."), (None, None), (7, "\n\n"), (8, "  The SAME long line of text here. \r")]


# ---- lines
def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] or a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute_lines(rows, min_chars=10, near_min_chars=20):
    lines = []
    for i, t in rows:
        for n, raw in enumerate((t or "").split("\n")):
            x = raw.lower().strip(" \t\r\x0b\x0c\xa0")
            lines.append(((i if i is not None else 1 << 63, n), x))
    gone = {}
    for p, x in lines:
        if len(x) < min_chars:
            continue
        for q, y in lines:
            if q < p and x == y:
                gone[p] = False
            elif q < p and len(x) >= near_min_chars and len(y) >= near_min_chars and within_one(x, y):
                gone.setdefault(p, True)
    return gone


def found_lines(df):
    return {((r.d if r.d != 9223372036854775807 else 1 << 63), r.n): r.near for r in line_dedup.duplicate_lines(df).collect()}


def test_lines_brute_force(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "x1", "ñandú", "été"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(2, 14))) for _ in range(25)] + ["aaaaaaaaaaaaaaaaaaaaaaaa", "ab" * 16, "0123456789abcdef" * 2]
    rows = []
    for i in range(120):
        ls = []
        for _ in range(rng.randint(1, 4)):
            x = rng.choice(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at, kind = rng.randrange(len(x) + 1), rng.randrange(3)
                x = x[:at] + rng.choice("qz a") * (kind != 0) + x[at + (kind != 1) :]
            ls.append(x)
        rows.append((i, "\n".join(ls)))
    assert found_lines(messy(spark, rows)) == brute_lines(rows)


def test_lines_every_length(spark):
    rng = random.Random(6)
    rows, i = [], 0
    for n in [20, 21, 23, 24, 31, 32, 33, 47, 48, 63, 64, 65, 127, 128, 129, 300, 511, 512, 513]:
        x = "".join(rng.choice("abcdefgh") for _ in range(n))
        for y in [x, x[1:], x[:-1], "z" + x, x + "z", x[: n // 2] + "z" + x[n // 2 :], x[: n // 3] + "zz" + x[n // 3 :], x[: n - 2] + "zz"]:
            rows.append((i, y))
            i += 1
    assert found_lines(messy(spark, rows)) == brute_lines(rows)


def test_lines_odd_rows(spark):
    out = line_dedup.dedup_lines(messy(spark, ODD))
    assert set(out.columns) == set(messy(spark, ODD).columns) | {"n_lines", "n_exact", "n_near"}
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in out.collect()), key=str)
    line = "The same long line of text here."
    want = [(False, 1, ""), (False, 2, ""), (False, 3, "a"), (False, 4, LONG), (False, 5, ""), (False, 6, line + "\nx"), (False, 6, line + "\nx"), (True, 0, ""), (True, 0, ""), (False, 7, "\n\n"), (False, 8, "")]
    assert got == sorted(want, key=str)
    assert line_dedup.dedup_lines(messy(spark, ODD).limit(0)).count() == 0


def test_lines_clashing_names(spark):
    line = "A line that two documents have."
    rows = [(1, line, "own", 5, 6, 7, 8, 9), (2, line + "\nrest", "own", 5, 6, 7, 8, 9)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_lines string, __d int, __D_ int, __t int, __g int, __n int"))
    assert out.columns == ["doc_id", "text", "n_lines", "__d", "__D_", "__t", "__g", "__n", "n_exact", "n_near"]
    assert sorted(map(tuple, out.collect())) == [(1, line, 1, 5, 6, 7, 8, 9, 0, 0), (2, "rest", 2, 5, 6, 7, 8, 9, 1, 0)]


def test_lines_native(spark):
    plan = line_dedup.dedup_lines(messy(spark, ODD))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct"))


# ---- exact
def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("condition", [None, "true", "false", "doc_id % 2 = 0"])
def test_exact(spark, condition):
    rng = random.Random(1)
    rows = ODD + [(i, f"text {rng.randrange(900)}") for i in range(10, 2500)]
    got = exact_dedup.exact_dedup(messy(spark, rows), condition and F.expr(condition)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == brute_exact(rows)


def test_exact_empty(spark):
    assert exact_dedup.exact_dedup(messy(spark, ODD).limit(0)).count() == 0


def test_minimal_perfect_hash():
    for n in (1, 2, 3, 100, 700):
        d = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(n)), np.uint8).reshape(-1, 32)
        pilots, slots = exact_dedup.build_slots(d)
        assert sorted(slots) == list(range(n))
        assert (exact_dedup.find_slots(d, pilots, n) == slots).all()


# ---- simhash
def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\r", " ").translate({9: 32, 10: 32, 11: 32, 12: 32}).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps, budget=2):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprint():
    for t in ["", None, "One", "Two Words", "ÀB c\x1cd é", "a b c d e f " * 50, "x\x0by\x0cz\r\nq r"]:
        assert simhash_dedup.fingerprint(t or "") == brute_fingerprint(t)


@pytest.mark.parametrize("subtree,budget", [(2048, 2), (16, 3)])
def test_trie_join(spark, subtree, budget):
    rng = random.Random(subtree)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(200):
        x = rng.choice(fps)
        for _ in range(rng.randint(1, 3)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    fps = sorted(set(fps) | {0, 1, 3, (1 << 64) - 1})
    want = brute_components(fps, budget)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash_dedup.links(spark.createDataFrame([(x,) for x in signed], "fp long"), budget, subtree)
    roots = {r.node: r.root for r in simhash_dedup.components(links).collect()}
    groups, other = {}, {}
    for x, s, w in zip(fps, signed, want):
        groups.setdefault(w, set()).add(s)
        other.setdefault(roots.get(s, s), set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, other.values()))
    one = simhash_dedup.trie_join(np.array(fps, np.uint64), None, 0, budget)
    assert len(one) == len(fps) - len(groups)


def test_prefix_that_many_share(spark):
    """100,000 fingerprints below one prefix of 40 bits: planted links are found."""
    fp = (F.lit(0x123456789A << 24) + F.pmod(F.xxhash64("id"), F.lit(1 << 24))).alias("fp")
    near = [(0x123456789A << 24 | x, 0x123456789A << 24 | x ^ y) for x, y in ((5, 3), (1 << 23, 1), (77, 1 << 20))]
    fps = spark.range(100_000).select(fp).unionByName(spark.createDataFrame([(x,) for p in near for x in p], "fp long")).distinct()
    found = simhash_dedup.links(fps, 1, 8192)
    roots = {r.node: r.root for r in simhash_dedup.components(found).collect()}
    assert all(roots.get(a) == roots.get(b) for a, b in near if (a ^ b).bit_count() == 1)


def test_simhash_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    fps = [brute_fingerprint(r.text) for r in docs]
    roots, least = brute_components(fps), {}
    for r, c in zip(docs, roots):
        least[c] = min(least.get(c, r.doc_id), r.doc_id)
    want = {r.doc_id: (f"{x:016x}", least[c]) for r, x, c in zip(docs, fps, roots)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op9_simhash_dedup(spark, sf).collect()}
    assert got == want


def test_simhash_odd_rows(spark):
    out = simhash_dedup.drop_near_duplicates(messy(spark, ODD))
    assert sorted(out.columns) == sorted(messy(spark, ODD).columns)
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == [1, 3, 4, 6, 6, 8]
    assert simhash_dedup.near_duplicates(messy(spark, ODD).limit(0)).count() == 0


def test_components_chain(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.root for r in simhash_dedup.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
