"""BPE, packing and token counts against the installed tokenizer libraries."""

import binascii
import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from lapwing.llm import bpe, packing, queries, token_counts
from lapwing.llm.common import tokenizer_path
from lapwing.llm.tokens import encoding

ODD = ["", "a", "  lead", "tail  ", "\n\n \t x", "<|endoftext|>", "a<|endoftext|>b <|endoftext|><|endoft", "naïve Ünïcödé 漢字 🎉👩‍👩‍👧", "don't I'll WE'RE", "x" * 3000, "ab" * 700 + " c", "\x1c\x1d \x85 　z", "123 4567٣", "é́", "\x00\x01"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def fuzz():
    rng = random.Random(3)
    alphabet = "aaeeiosn  \n\t.,'!?-éßñ漢🎉́\x1c ABZ019<|>" + "etaoin shrdlu"
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 400))) for _ in range(400)]


def test_encode_decode_like_library(library):
    own, fast = bpe.load(tokenizer_path()), encoding(tokenizer_path())
    for t in fuzz():
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
        assert fast.encode(t, allowed_special="all") == ids


def test_decode_broken_bytes(library):
    own, rng = bpe.load(tokenizer_path()), random.Random(4)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 12))]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, 2, "z") for i, t in enumerate(texts)], "doc_id long, text string, row int, ids int, `group` string")


def test_round_trip_query(spark, sf, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op10_bpe(spark, sf).collect():
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_bpe_odd_rows(spark):
    rows = frame(spark, [None, *ODD, "a"])
    out = bpe.decode(bpe.encode(rows, tokenizer_path(), ids_col="tok"), tokenizer_path(), ids_col="tok").collect()
    assert all(r.decoded == (r.text or "") for r in out)
    assert bpe.round_trip(rows.limit(0), tokenizer_path()).count() == 0
    assert bpe.round_trip(rows, tokenizer_path()).count() == len(ODD) + 2


# ---- packing
def test_best_fit_against_scan():
    rng = random.Random(9)
    for length in (16, 100, 2048):
        sizes = [rng.randint(1, length) for _ in range(400)]
        where, offset, n = packing.best_fit_decreasing(sizes, length)
        room: list[int] = []
        used = [0] * n
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            fit = [r for r in room if r >= sizes[i]]
            assert used[where[i]] == offset[i]
            if fit:
                assert length - offset[i] == min(fit)
                room.remove(min(fit))
            else:
                assert offset[i] == 0
            room.append(length - offset[i] - sizes[i])
            used[where[i]] += sizes[i]
        assert max(used) <= length


def check_packing(rows, texts, library, length=2048):
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in texts}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for i, rs in by_doc.items():
        at = 0
        for r in sorted(rs, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[i])
            assert r.ids_crc32 == binascii.crc32(np.array(ids[i][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[i])
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length and all(r.sequence_tokens == at for r in rs)
        assert rs[0].padded == (at if at & (at - 1) == 0 else length)
    return sum(r.length for r in rows) / (length * len(by_seq))


def test_packing_query(spark, sf, library):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert check_packing(queries.op8_packing(spark, sf).collect(), texts, library) > 0.97


def test_packing_odd_rows(spark, library):
    texts = [None, *ODD, "word " * 30_000, " " * 1_200_000 + "a"]
    rows = frame(spark, texts)
    out = packing.pack_documents(rows, tokenizer_path(), group=5).collect()
    check_packing(out, list(enumerate(texts)), library)
    assert packing.pack_documents(rows.limit(0), tokenizer_path()).count() == 0
    twice = packing.pack_documents(rows.unionByName(rows).selectExpr("cast(null as long) doc_id", "text"), tokenizer_path()).collect()
    assert sum(r.start == 0 for r in twice) == 2 * len(texts)


# ---- token counts
def test_scan_blocks():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 6, 5000)
    whole, carry = [], 0
    for x in ids:
        if x == 0:
            whole.append(carry)
            carry = 0
        else:
            carry += 1
    for block in (1, 2, 7, 1000, 9999):
        lengths, left = token_counts.scan(ids, 0, block)
        assert lengths.tolist() == whole and left == carry


def test_documents_across_files(spark, tmp_path):
    docs = [5, 0, 17, 1, 0, 0, 40, 3]
    stream = np.concatenate([np.append(np.full(n, 9), 0) for n in docs] + [np.full(4, 9)]).astype("<u4")
    cuts = [0, 3, 3, 10, 12, 30, 31, 50, 60, len(stream)]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        (tmp_path / f"part-{k:03}").write_bytes(stream[a:b].tobytes())
    out = token_counts.token_counts(spark, str(tmp_path), 0, block=4).orderBy("path", "ordinal").collect()
    assert [r.n_tokens for r in out if r.closed] == docs
    assert [r.n_tokens for r in out if not r.closed] == [4]
    (tmp_path / "part-999").write_bytes(b"abc")
    with pytest.raises(Exception, match="whole number"):
        token_counts.token_counts(spark, str(tmp_path), 0).count()


def test_token_counts_query(spark, sf, library):
    library.encode_special_tokens = True
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in docs.items()}
    assert {r.doc_id: r.n_tokens for r in queries.op5_token_counts(spark, sf).collect()} == want


def test_token_counts_odd_rows(spark, library):
    library.encode_special_tokens = True
    texts = [None, *ODD, " " * 1_200_000 + "a", "word " * 30_000, "other " * 300_000]
    rows = frame(spark, texts)
    out = token_counts.document_token_counts(rows.unionByName(rows), tokenizer_path(), 50256).collect()
    want = sorted([(i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)] * 2)
    assert sorted((r.doc_id, r.n_tokens) for r in out) == want
    assert token_counts.document_token_counts(rows.limit(0), tokenizer_path(), 50256).count() == 0
