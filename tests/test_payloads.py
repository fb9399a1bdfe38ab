"""JSON payloads against the json module."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from lapwing.operators import payloads


def some(rng, depth=0):
    kind = rng.random()
    if depth < 4 and kind < 0.35:
        return {rng.choice(["a", "b", 'q"', "c\\", "é", "null", "", "d,"]): some(rng, depth + 1) for _ in range(rng.randint(0, 4))}
    if depth < 4 and kind < 0.5:
        return [some(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([None, None, True, 1, -7, "x", '":null,"', '\\":null', "a\\", "{,", '"', "tab\t", 12.5])


def stripped(v):
    return {k: stripped(x) for k, x in v.items() if x is not None} if isinstance(v, dict) else [stripped(x) for x in v] if isinstance(v, list) else v


def text(v):
    return json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_canonical_stripped_and_merged(spark):
    rng = random.Random(4)
    values = [some(rng) for _ in range(300)] + [{}, [], None, "s"]
    others = [some(rng) for _ in values]
    df = spark.createDataFrame([(i, json.dumps(v), json.dumps(w, indent=1)) for i, (v, w) in enumerate(zip(values, others))], "i int, a string, b string")
    got = df.select("i", payloads.canonical(F.col("a")).alias("c"), payloads.digest(F.col("a")).alias("h"), payloads.strip_nulls(F.col("a")).alias("s"), payloads.merged(F.col("a"), F.col("b")).alias("m"), payloads.has_key(F.col("a"), "a").alias("k")).collect()
    for r in got:
        v, w = values[r.i], others[r.i]
        assert r.c == text(v) and r.h == hashlib.sha256(text(v).encode()).hexdigest()
        assert r.s == text(stripped(v))
        assert r.m == text(v | w if isinstance(v, dict) and isinstance(w, dict) else w)
        assert r.k == (isinstance(v, dict) and "a" in v)


def test_odd_payloads(spark):
    rows = [None, "", "bad", '{"a":1,"a":2}', '{"a": 1.0}', '{"a":"' + "\\\\" * 20000 + '","b":null}', "null"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, p string")
    got = [tuple(r)[1:] for r in df.select("i", payloads.strip_nulls(F.col("p")).alias("s"), payloads.has_key(F.col("p"), "a").alias("k"), payloads.text_at(F.col("p"), "$.a").alias("t")).orderBy("i").collect()]
    assert got[:4] == [(None, False, None)] * 4 and got[4] == ('{"a":1}', True, "1") and got[6] == ("null", False, None)
    assert got[5][0] == '{"a":"' + "\\\\" * 20000 + '"}'


def test_nested_and_versions(spark):
    df = spark.createDataFrame([(1, 2, "x", True), (1, 1, None, True), (1, 3, "y", False), (2, 1, "z", False), (1, 1, "a", True)], "g int, n int, s string, ok boolean")
    made = df.groupBy("g").agg(payloads.nested(F.struct("n", "s"), where=F.col("ok"), order=["-n", "s"]).alias("j"), payloads.nested(F.struct("n")).alias("all"))
    assert {r.g: (r.j, r.all) for r in made.collect()} == {1: ('[{"n":2,"s":"x"},{"n":1,"s":"a"},{"n":1}]', '[{"n":1},{"n":1},{"n":2},{"n":3}]'), 2: ("[]", '[{"n":1}]')}
    first = spark.createDataFrame([("k", '{"b":1, "a":2}', 5), ("k", '{"a":2,"b":1}', 3), (None, "{}", 1), ("k", "no", 1)], "key string, p string, at int")
    log = payloads.append_versions(None, first, "key", "p", "at")
    assert [(r.key, r.payload, r.at) for r in log.collect()] == [("k", '{"a":2,"b":1}', 3)]
    again = first.unionByName(spark.createDataFrame([("k", '{"a":3}', 9)], first.schema))
    assert [(r.key, r.payload, r.at) for r in payloads.append_versions(log, again, "key", "p", "at").collect()] == [("k", '{"a":3}', 9)]
