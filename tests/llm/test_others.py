"""Top-k search, quality classifier, licence scan, chat formatting and the pipeline."""

import glob
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapwing.llm import chat_format, license_scan, quality_crf, queries, topk_search


# ---- top-k search
def brute_top_k(rows, is_query, k):
    v = {}
    for i, x in rows:
        if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            v.setdefault(i, []).append([math.floor(1024 * c) for c in x])
    out = []
    for q, qs in v.items():
        if is_query(q):
            for a in qs:
                s = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, bs in v.items() for b in bs if c != q and len(b) == len(a))
                out += [(q, n + 1, c, min(max(-x, -(1 << 63)), (1 << 63) - 1)) for n, (x, c) in enumerate(s[:k])]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, x, 1, 2, 3) for i, x in rows], "vec_id long, embedding array<float>, id int, rank int, v int")


def test_top_k(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(5, 8))
    rows = [(i, [float(x) for x in np.float32(centre[i % 5] + 0.1 * rng.normal(size=8))]) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)] + [(2000, None), (2100, [1.0, None] * 4), (2200, [float("nan")] + [0.0] * 7), (2300, [float("inf")] * 8), (None, rows[1][1]), (2400, [0.0] * 8)]
    got = topk_search.top_k(vectors(spark, rows), F.col("vec_id") % 100 == 0, 10)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == brute_top_k(rows, lambda i: i % 100 == 0, 10)
    few = rows[:4]
    got = topk_search.top_k(vectors(spark, few), F.col("vec_id") == 0, 10)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == brute_top_k(few, lambda i: i == 0, 10)
    assert topk_search.top_k(vectors(spark, rows).limit(0), F.col("vec_id") % 100 == 0, 10).count() == 0


def test_top_k_large_and_odd_vectors(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([1.0, -1.0]) * rng.choice([0.5, 3.0, 2.0**25, 2.0**25 + 4, 3e9, 1e20, 3e38]) for _ in range(3 if i % 7 else 2)]) for i in range(120)]
    rows += [(i, [rng.random() for _ in range(3)]) for i in range(120, 200)] + [(300, []), (301, [1.0])]
    got = topk_search.top_k(vectors(spark, rows), F.col("vec_id") % 20 == 0, 10, report=True).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top_k(rows, lambda i: i % 20 == 0, 10)
    assert all(10 <= r.evaluated <= 202 for r in got if r.query_id % 7)


def test_search_block_stops_early():
    rng = np.random.default_rng(3)
    c = np.concatenate([rng.integers(-5, 6, (3000, 16)) + 1000 * np.eye(16, dtype=int)[i % 16] for i in range(1)] + [rng.integers(-5, 6, (3000, 16))]).astype(np.int64)
    pivots = topk_search.choose_pivots(c[:500].astype(float), 16)
    far = topk_search._distances(c.astype(float), pivots)
    c = c.astype(float)
    out, evaluated = topk_search.search_block(np.array([-1]), c[:1], far[:1], np.arange(len(c)), c, far, 10)
    s = c @ c[0]
    assert [x[2] for x in out] == sorted(s, reverse=True)[:10]
    assert evaluated[-1] < len(c)


# ---- quality
def test_forward_backward_brute_force():
    rng = np.random.default_rng(1)
    sizes = np.array([1, 4, 2, 3])
    u, moves = rng.normal(size=sizes.sum()), rng.normal(size=(2, 2))
    good, pairs = quality_crf.forward_backward(u, sizes, moves)
    at, all_pairs = 0, np.zeros((2, 2))
    for n in sizes:
        p, marg, pr = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(2**n):
            y = [code >> i & 1 for i in range(n)]
            w = math.exp(sum(u[at + i] * y[i] for i in range(n)) + sum(moves[a, b] for a, b in zip(y, y[1:])))
            p += w
            marg += w * np.array(y)
            for a, b in zip(y, y[1:]):
                pr[a, b] += w
        assert np.allclose(good[at : at + n], marg / p)
        all_pairs += pr / p
        at += n
    assert np.allclose(pairs, all_pairs)


def test_quality_query(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op4_quality_crf(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def slow_score(text, model):
    """One document, line by line, in plain Python."""
    lines = text.split("\n")
    own = [quality_crf.line_features(x) for x in lines]
    none = [0.0] * quality_crf.OWN
    u = [float(np.dot([1.0, *own[i], *(own[i - 1] if i else none), *(own[i + 1] if i + 1 < len(own) else none)], model.weights)) for i in range(len(lines))]
    log = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    m = model.moves
    ahead, back = [(0.0, u[0])], [(0.0, 0.0)]
    for x in u[1:]:
        a = ahead[-1]
        ahead.append((log(a[0] + m[0][0], a[1] + m[1][0]), x + log(a[0] + m[0][1], a[1] + m[1][1])))
    for x in reversed(u[1:]):
        b = back[-1]
        back.append((log(m[0][0] + b[0], m[0][1] + x + b[1]), log(m[1][0] + b[0], m[1][1] + x + b[1])))
    good = [1 / (1 + math.exp(a[0] + b[0] - a[1] - b[1])) for a, b in zip(ahead, reversed(back))]
    p = sum(g * (len(x) + 1) for g, x in zip(good, lines)) / sum(len(x) + 1 for x in lines)
    p = min(max(p, 1e-6), 1 - 1e-6)
    z = min(max(math.log(p / (1 - p)), -12), 12)
    return 1 / (1 + math.exp(-(model.curve[0] + model.curve[1] * z)))


def test_quality_query_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("crc32(cast(doc_id AS string)) % 3 != 1")
    model = quality_crf.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = queries.op4_quality_crf(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert abs(r.score - slow_score(texts[r.doc_id], model)) < 1e-4
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_quality_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(quality_crf, "MAX_TRAIN_LINES", 400)
    docs = spark.createDataFrame([(i, "\n".join(["good words here"] * (i % 30 + 1)) if i % 2 else "$$ ##") for i in range(200)], "doc_id long, text string")
    labels = spark.range(200).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    chosen = quality_crf.sample_of(docs, labels).collect()
    lines = {i: (i % 30 + 1 if i % 2 else 1) for i in range(200)}
    assert 300 < sum(lines[r["__id"]] for r in chosen) <= 400 and all(lines[r["__id"]] <= 20 for r in chosen)


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good text here", 9, 9), (2, "$$$ ### !!!", 9, 9), (3, None, 9, 9), (None, "", 9, 9), (4, "x\n" * 5000, 9, 9), (4, "x\n" * 5000, 9, 9)], "doc_id long, text string, y int, id int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, quality int")
    model = quality_crf.train(docs, labels)
    out = quality_crf.score(docs, model).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
    assert next(r.score for r in out if r.doc_id == 1) > next(r.score for r in out if r.doc_id == 2)
    none = quality_crf.train(docs, labels.limit(0))
    assert {r.score for r in quality_crf.score(docs, none).collect()} == {0.5}
    assert quality_crf.score(docs.limit(0), model).count() == 0


# ---- licences
def scan(spark, texts):
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, licenses int")
    return [r.licenses for r in license_scan.scan_licenses(rows).orderBy("doc_id").collect()]


def full(*names):
    table = {}
    for name, text in license_scan._rows(license_scan.SENTENCES):
        table.setdefault(name, text)
    return "\n".join(table[n] for n in names)


def test_licenses(spark):
    texts = [
        None,
        "",
        "Some prose.\nReleased under the MIT License.\nMore prose.",
        full("mit-name", "reserved") + "\n\nCopyright (c) 2020 A. Holder\n\n" + full("mit-grant", "mit-notice", "mit-warranty", "mit-liability"),
        full("bsd-grant", "bsd-source", "bsd-binary", "bsd-name"),
        full("bsd-grant", "bsd-source", "bsd-binary"),
        "# " + full("gpl-free", "gpl-redistribute", "gpl2-later").replace("\n", "\n# "),
        full("gpl3-later", "gpl-hope", "gpl-implied", "gpl-see"),
        "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.",
        "no stop before\nThis work is licensed under the GNU General Public License, version 3.",
        "Copyright 2001 Someone. All rights reserved.",
        "// SPDX-License-Identifier: MIT",
        "The word licence alone. " * 2000,
        "Licensed under the MIT License" + " " * 3000 + ".",
        "/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR BSD-3-Clause */",
        "Neither the name of the Examples Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "This is free and unencumbered software released into the public domain.",
    ]
    got = scan(spark, texts)
    assert got == [[], [], ["MIT"], ["MIT"], ["BSD-3-Clause"], ["BSD-2-Clause"], ["GPL-2.0-or-later"], ["GPL-3.0-or-later"], ["Apache-2.0", "CC-BY-NC-4.0"], ["GPL-3.0"], ["proprietary"], ["MIT"], [], ["MIT"], ["GPL-2.0-only", "Linux-syscall-note", "BSD-3-Clause"], [], ["Unlicense"]]


def test_licenses_of_installed_packages(spark):
    """Licence files as their authors wrote them."""
    found = {}
    for path in glob.glob("/opt/py313/lib/python3.13/site-packages/*/**/LICENSE*", recursive=True):
        text = open(path, encoding="utf-8", errors="replace").read()
        start = " ".join(text.lower().split())[:4000]
        want = (
            "MIT" if "permission is hereby granted, free of charge, to any person obtaining a copy of this software and" in start and "the above copyright notice and this permission notice shall be included in all" in start and len(start) < 1400
            else "BSD-3-Clause" if "redistributions of source code must retain the above" in start and "neither the name" in start and len(start) < 1900
            else "Apache-2.0" if start.startswith("apache license version 2.0, january 2004") else None
        )
        if want:
            found[text] = want
    if not found:
        pytest.skip("no licence files here")
    got = scan(spark, list(found))
    missed = [(want, text[:60]) for (text, want), x in zip(found.items(), got) if want not in x]
    assert len(missed) <= len(found) // 10, missed


def test_license_query_brute_force(spark, sf):
    known = license_scan.known_sentences()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op6_license_scan(spark, sf).collect():
        lines = [known[license_scan.normal_form(x)] for x in docs[r.doc_id].split("\n") if license_scan.normal_form(x) in known]
        assert r.sentences.split() == lines
        assert bool(r.licenses) == any(x.endswith("-short") for x in lines)
    plan = queries.op6_license_scan(spark, sf)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Exchange"))


# ---- chat
def test_chat(spark):
    rows = [(1, 0, "user", "hi\\ <|im_end|>\n<|im_start|>assistant\nok \\<| <\\|", 5), (1, 1, "assistant", "a\\<|b", 5), (1, 2, "user", None, 5), (2, 0, "a b\n<|%", "x", 5), (3, 1, "assistant", "", 5), (3, 1, "assistant", "", 5), (3, 0, None, "é🎉", 5), (None, 0, "assistant", "z" * 100_000, 5), (4, None, "user", "null turn", 5), (4, 0, "assistant", "y", 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example int")
    convs = {}
    for c, t, r, x, _ in rows:
        convs.setdefault(c, []).append((t if t is not None else -1, r or "", x or ""))
    out = chat_format.read_back(chat_format.examples(df)).collect()
    assert len(out) == len(convs)
    for r in out:
        turns = sorted(convs[r.conv_id])
        learned = "".join(x for _, role, x in turns if role == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    ex = {(r.conv_id, r.example): r for r in chat_format.examples(df).collect()}
    one = ex[(1, 0)]
    assert one.text[one.loss_start : one.loss_start + one.loss_chars] == "a\\\\<\\|b" and one.text.count("<|im_end|>") == 2
    assert ex[(1, 1)].loss_chars == 0
    plan = chat_format.read_back(chat_format.examples(df))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow"))
    assert chat_format.examples(df.limit(0)).count() == 0


# ---- pipeline
def test_pipeline(spark, sf):
    import corpus_pipeline as p
    from test_dedup import brute_lines
    from test_near_copies import brute_gone

    assert [n for n, _ in p.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = p.keep_good(spark, docs, sf)
    assert good.columns == docs.columns
    bad = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality == 0}
    rows = good.orderBy("doc_id").collect()
    assert len({r.doc_id for r in rows} & bad) <= 0.1 * len(bad) and len(rows) > 0.7 * docs.count()
    lines = p.drop_lines(spark, good, sf)
    gone = brute_lines([(r.doc_id, r.text) for r in rows])
    want = {}
    for r in rows:
        left = "\n".join(x for n, x in enumerate(r.text.split("\n")) if (r.doc_id, n) not in gone)
        if left.strip():
            want[r.doc_id] = left
    assert {r.doc_id: r.text for r in lines.collect()} == want
    copies = {i for i, _ in brute_gone(sorted(want.items()))}
    least = sorted(set(want) - copies)
    near = p.drop_near_copies(spark, lines, sf)
    assert near.columns == docs.columns and sorted(r.doc_id for r in near.collect()) == least
    out = p.run(spark, sf).collect()
    assert {r.doc_id for r in out} == set(least) and all(len(r.ids) == 4 * r.length for r in out)
