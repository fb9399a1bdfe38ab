"""Filter audit, syncmers and token alignment against SQL, brute force and the tokenizer libraries."""

import collections
import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lapwing.llm import bpe, filter_audit, queries, syncmers, token_alignment
from lapwing.llm.common import tokenizer_path

ODD = [None, "", " ", "a", "\n\n", "x" * 5000, "tail  ", "  two  spaces ", "▁x", "a▁b", "<s>hi</s> <unk> <0x41> <|endoftext|>", "naïve Ünïcödé 漢字 🎉👩‍👩‍👧 " * 9, "\x00\x01 tab\there\n\n new", " x　y", "é" * 70, "🎉" * 80, "same text here, forty characters or more of it", "same text here, forty characters or more of it", "A B C D $ *" * 30]


def rows_of(df):
    return collections.Counter(map(tuple, df.collect()))


def test_audit_equals_its_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL["op11_filter_audit"])
    got = queries.op11_filter_audit(spark, sf)
    assert got.columns == want.columns
    assert rows_of(got) == collections.Counter(want.fetchall())


def test_transpositions_visit_every_order():
    for n in range(1, 6):
        order, seen = list(range(n)), {tuple(range(n))}
        for i in filter_audit.transpositions(n):
            order[i], order[i + 1] = order[i + 1], order[i]
            seen.add(tuple(order))
        assert len(seen) == len(list(itertools.permutations(range(n))))


def audited(rows, marks):
    """part, order, step -> counts, by applying the filters one after another."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    docs = []
    for i, part, t in rows:
        t, part, w = t or "", part or "", word.findall(t or "")
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, _, u in rows)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": copy}
        docs.append((part, {x for x, y in fails.items() if y}, any(q == 1 for j, q, _ in marks if j == i and i is not None), any(x == 1 for j, _, x in marks if j == i and i is not None)))
    out, shapley = {}, collections.Counter()
    for part in {d[0] for d in docs}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                all_ = [d for d in docs if d[0] == part and f in d[1]]
                out[part, order, step] = (len(left), len(gone), len(all_) - len(gone), sum(d[1] == {f} for d in all_), sum(d[2] for d in gone), sum(d[3] for d in gone))
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_brute_force_and_odd_rows(spark):
    rng = random.Random(5)
    texts = ODD + [" ".join(rng.choice(["aa", "Bb", "cc", "d$", "e"]) for _ in range(rng.choice([3, 150, 250]))) for _ in range(20)]
    rows = [(rng.choice([None, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]), rng.choice([None, "", "en", "de"]), rng.choice(texts)) for _ in range(90)]
    marks = [(rng.choice([None, *range(12)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(14)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, lang string, text string, mask int, words string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {tuple(r[:3]): tuple(r[3:]) for r in filter_audit.audit(docs, labels).collect()}
    assert got == audited(rows, marks)
    assert filter_audit.audit(docs.limit(0), labels).count() == 0 and filter_audit.audit(docs, labels.limit(0)).count() == len(got)
    with pytest.raises(ValueError):
        filter_audit.interactions(docs, "ABCDEFGHI")


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def spark_hash(text):
    return signed(xxhash.xxh64_intdigest(text.encode(), 42))


def joined(a, z):
    return signed(xxhash.xxh64_intdigest(z.to_bytes(8, "little", signed=True), xxhash.xxh64_intdigest(a.to_bytes(8, "little", signed=True), 42)))


def anchors(text):
    s, k = syncmers.S, syncmers.K
    h = [spark_hash(text[i : i + s]) for i in range(len(text) - s + 1)]
    found = []
    for i in range(len(text) - k + 1):
        inner = h[i : i + k - s + 1]
        if min(inner) in (inner[0], inner[-1]):
            found.append((i, joined(inner[0], inner[-1])))
    return found or ([(0, spark_hash(text))] if text else [])


def dice(a, b):
    a, b = {h & 0xFFFFFFFF for _, h in a}, {h & 0xFFFFFFFF for _, h in b}
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def halves(rows):
    """What edited_half should give for rows of id and text, made from the edited texts themselves."""
    low = -(1 << 63)
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (-(low if r[0] is None else r[0]), r[1].encode()))
    out = []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        e = t[: len(t) - half] + u[:half]
        a, b, c = anchors(t), anchors(e), anchors(u)
        show = lambda x: ",".join(str(h & 0xFFFFFFFF) for _, h in x)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), show(a), show(b), dice(a, b), dice(a, c)))
    return collections.Counter(out)


def test_syncmers_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = halves([(r.doc_id, r.text) for r in docs.collect()])
    assert rows_of(syncmers.edited_half(docs, rows=40)) == want
    assert rows_of(queries.op12_syncmers(spark, sf)) == want


def test_syncmers_odd_rows(spark):
    rng = random.Random(6)
    texts = ODD + ["".join(rng.choice("abcé 🎉") for _ in range(n)) for n in (15, 16, 30, 31, 44, 45, 46, 61, 62, 63, 90, 124, 200) for _ in range(3)]
    rows = [(rng.choice([None, 5, *range(40)]), t) for t in texts]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, `next` int, bucket int")
    for size in (1, 7, 1000):
        assert rows_of(syncmers.edited_half(docs, rows=size)) == halves(rows)
    one = docs.where("doc_id = 5").limit(1)
    assert rows_of(syncmers.edited_half(one)) == halves([(r.doc_id, r.text) for r in one.collect()])
    assert syncmers.edited_half(docs.limit(0)).count() == 0


def test_shared_spans(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    text = lambda n: " ".join(word() for _ in range(n))
    common = text(60)
    a, b = text(30) + " " + common + " " + text(20), text(5) + " " + common + " " + text(40)
    made = syncmers.with_anchors(spark.createDataFrame([("a", a), ("b", b), ("c", text(100))], "side string, text string"))
    held = {r.side: r.anchors for r in made.select("side", "anchors").collect()}
    kind = "array<bigint>"
    pairs = spark.createDataFrame([(1, held["a"], held["b"]), (2, held["a"], held["c"]), (3, [], [])], f"pair int, a {kind}, b {kind}")
    (span,) = syncmers.shared_spans(pairs).collect()
    assert span.pair == 1 and a[span.start_a : span.start_a + span.length] == b[span.start_b : span.start_b + span.length] and span.length > len(common) - 60


def aligned(texts):
    """doc -> row, by comparing all token ranges of a text."""
    lib, sp = Tokenizer.from_file(tokenizer_path()), sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    lib.encode_special_tokens = True
    chars = {c: b for b, c in enumerate(bpe.byte_characters())}
    out, links = [], []
    for t in texts:
        full = (" " + (t or "")).encode()
        ids_a, ids_b = (lib.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)) if t else ([], [])
        by_a = [bytes(chars[c] for c in lib.id_to_token(i)) for i in ids_a]
        by_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, sp.id_to_piece(i)) for i in ids_b)]
        if not t or b"".join(by_a) != full or b"".join(by_b) != full:
            out.append((0, 0, 0, 0, ""))
            links.append([])
            continue
        ends = [set(np.cumsum([len(x) for x in by]).tolist()) for by in (by_a, by_b)]
        cuts = sorted(ends[0] & ends[1])
        span = lambda by: [(e - len(x), e) for x, e in zip(by, np.cumsum([len(x) for x in by]).tolist())]
        sa, sb = span(by_a), span(by_b)
        inside = lambda ids, spans, lo, hi: ",".join(str(i) for i, (x, y) in zip(ids, spans) if lo <= x and y <= hi)
        text = ";".join(inside(ids_a, sa, lo, hi) + "|" + inside(ids_b, sb, lo, hi) for lo, hi in zip([0, *cuts], cuts))
        own = [(i, j) for i, (x, y) in zip(ids_a, sa) for j, (z, w) in zip(ids_b, sb) if x < w and z < y]
        links.append(own)
        out.append((len(ids_a), len(ids_b), len(cuts), len(own), hashlib.sha256(text.encode()).hexdigest()))
    n = collections.Counter(x for own in links for x in own)
    best = collections.Counter()
    for (_, j), c in n.items():
        best[j] = max(best[j], c)
    return [(*o[:4], sum(n[x] == best[x[1]] for x in own), sum(n[x] for x in own), o[4]) for o, own in zip(out, links)]


def test_alignment_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("n_chars < 3000").collect()
    rng = random.Random(8)
    alphabet = "aaeeiosn  \n\t.,'!?-éßñ漢🎉́▁ ABZ019<|>" + "etaoin shrdlu"
    texts = [r.text for r in docs] + [t if t is None else t[:800] for t in ODD] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 90))) for _ in range(150)]
    want = collections.Counter((i, *x) for i, x in enumerate(aligned(texts)))
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, `row` int, pairs int")
    paths = (tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    for frequent in (1 << 19, 500, 0):
        assert rows_of(token_alignment.alignment(frame, *paths, frequent=frequent)) == want
    assert token_alignment.alignment(frame.limit(0), *paths).count() == 0
    again = spark.createDataFrame([(None, "one two"), (None, "one two"), (3, None)], "doc_id int, text string")
    got = token_alignment.alignment(again, *paths).collect()
    assert sorted((r.n_links, r.count_sum) for r in got) == [(0, 0), (2, 4), (2, 4)]


def test_links_in_blocks():
    rng = np.random.default_rng(9)
    for _ in range(40):
        total = int(rng.integers(1, 60))
        ends = [np.unique(np.append(rng.integers(1, total + 1, int(rng.integers(0, 20))), total)) for _ in range(2)]
        whole = token_alignment.links_of(*ends, total)
        for block in (1, 3, 7):
            assert all((x == y).all() for x, y in zip(whole, token_alignment.links_of(*ends, total, block)))
        at, a, b, last = whole
        starts = [np.concatenate([[0], e[:-1]]) for e in ends]
        assert [(int(i), int(j)) for i, j in zip(a, b)] == sorted((i, j) for i in range(len(ends[0])) for j in range(len(ends[1])) if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i])
        assert at[last == 1].tolist() == sorted(set(ends[0].tolist()) & set(ends[1].tolist()))


def test_queries_read_all_rows(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    got = queries.op13_token_alignment(spark, sf)
    assert got.count() == n and got.where(F.col("n_links") != F.col("n_a") + F.col("n_b") - F.col("n_groups")).count() == 0
