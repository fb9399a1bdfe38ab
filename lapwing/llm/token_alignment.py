"""Alignment of two tokenizers over the same bytes: byte-level BPE (A) against a piece model with byte fallback (B).

Both cut a text's bytes into tokens. Where a token of A and one of B end at one byte, a group ends; two tokens are linked if their bytes overlap. A slice of an
Arrow batch is one run of bytes: token ends are counted by byte once for A and once for B, a byte with either count ends a link, one with both a group. Prefix sums of
those counts name the tokens of a link and its group; differences at the documents' ends give each its own results. A run is read in blocks of bytes, whose sums
carry over, so a single very long text takes no more than a block at once beside its tokens.

How often two ids are linked in the corpus is summed from each document's distinct pairs. These meet the totals again by a shuffle on the pair; pairs that most
documents hold would make it hot, so the most frequent ones, FREQUENT at most whatever the corpus, are broadcast, and all others are shuffled.

Edge cases: texts that are null, empty, or that a tokenizer doesn't spell back byte by byte, have no tokens: zeros and an empty groups_sha256; strings of special
tokens in a text are plain text; rows with equal or null ids keep rows of their own; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.llm.bpe import load
from lapwing.llm.common import cut, text_of
from lapwing.llm.tokens import token_ids

SLICE = 1 << 21
BLOCK = 1 << 22
FREQUENT = 1 << 19
CACHE = 500_000
SPACE = "▁"
CHUNK = re.compile(" +[^ ]*")
PAIRS = "row long, doc_id {}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<struct<pair: long, n: long>>"


class Pieces:
    """A piece model that puts a space before each text. Chunks, each from its spaces to the next, are encoded by the library and remembered."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.vocab_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        # no piece runs over the start of a chunk, so chunks can be encoded one by one
        self.chunked = not any(SPACE in x.lstrip(SPACE) for x in names)
        self.bytes = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(names)]
        self.lengths = np.array([len(x) for x in self.bytes], np.int64)
        self.cache: dict[str, list[int] | None] = {}

    def _checked(self, chunk: str) -> list[int] | None:
        """Ids of a string that begins with a space, or None where they spell something else."""
        ids = self.model.encode(chunk[1:]) if chunk != " " else [self.model.piece_to_id(SPACE)]  # the library puts no space before an empty text
        return ids if b"".join([self.bytes[i] for i in ids]) == chunk.encode() else None

    def encode(self, text: str) -> list[int] | None:
        """Ids of a text with a space before it; None where their bytes aren't those of the text."""
        if SPACE in text:
            return None
        if not self.chunked:
            return self._checked(" " + text)
        out, cache = [], self.cache
        for chunk in CHUNK.findall(" " + text):
            if (ids := cache.get(chunk, 0)) == 0:
                ids = self._checked(chunk)
                if len(chunk) < 64:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[chunk] = ids
            if ids is None:
                return None
            out += ids
        return out


@functools.cache
def pieces(path: str) -> Pieces:
    """One copy for each Python worker."""
    return Pieces(path)


@functools.cache
def _spelled(path: str) -> tuple[list[bytes], np.ndarray]:
    known = load(path).bytes
    every = [known.get(i, b"") for i in range(max(known) + 1)]
    return every, np.array([len(x) for x in every], np.int64)


@functools.cache
def _printed(n: int) -> np.ndarray:
    """Decimal ids followed by a comma, a bar or a semicolon: id * 3 + 0, 1 or 2."""
    out = np.empty(3 * n, object)
    out[:] = [b"%d%c" % (i, c) for i in range(n) for c in b",|;"]
    return out


def links_of(ends_a: np.ndarray, ends_b: np.ndarray, total: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each link, in order: the byte at which it ends, its token of A, its token of B, and whether a group ends with it."""
    found, before_a, before_b = [], 0, 0
    for lo in range(0, total, block):
        size = min(block, total - lo)
        own = lambda ends, lo=lo, size=size: ends[np.searchsorted(ends, lo, "right") : np.searchsorted(ends, lo + size, "right")]
        a, b = (np.bincount(own(ends) - 1 - lo, minlength=size) for ends in (ends_a, ends_b))
        at = np.flatnonzero(a | b)
        sum_a, sum_b, a, b = np.cumsum(a[at]), np.cumsum(b[at]), a[at], b[at]
        found.append((at + lo + 1, before_a + sum_a - a, before_b + sum_b - b, (a & b).astype(np.int64)))
        if len(at):
            before_a, before_b = before_a + int(sum_a[-1]), before_b + int(sum_b[-1])
    if not found:
        return (np.zeros(0, np.int64),) * 4
    return tuple(map(np.concatenate, zip(*found)))


def align(ids_a: np.ndarray, lengths_a: np.ndarray, ids_b: np.ndarray, lengths_b: np.ndarray, sizes: np.ndarray, n_b: int, block: int = BLOCK):
    """Per document of a run of bytes (sizes: bytes of each): groups, links, digest of its groups; and the distinct pairs (id of A * n_b + id of B) with their numbers, and where each document's begin."""
    ends, ends_a, ends_b = np.cumsum(sizes), np.cumsum(lengths_a), np.cumsum(lengths_b)
    at, in_a, in_b, last = links_of(ends_a, ends_b, int(ends[-1]), block)
    upto = lambda of: np.searchsorted(of, ends, "right")
    links = np.diff(upto(at), prepend=0)
    closed = np.concatenate([[0], np.cumsum(last)])
    groups = np.diff(closed[upto(at)], prepend=0)
    group = closed[:-1]
    # the group of each token, and from it the token's place where A's and B's take turns group by group
    group_a, group_b = group[np.flatnonzero(np.diff(in_a, prepend=-1))], group[np.flatnonzero(np.diff(in_b, prepend=-1))]
    of_a, of_b = np.cumsum(np.bincount(group_a, minlength=int(closed[-1]))), np.cumsum(np.bincount(group_b, minlength=int(closed[-1])))
    place_a, place_b = np.arange(len(ids_a)) + np.concatenate([[0], of_b])[group_a], np.arange(len(ids_b)) + of_a[group_b]
    code = np.empty(len(ids_a) + len(ids_b), np.int64)
    code[place_a] = ids_a * 3 + (np.diff(group_a, append=-1) != 0)
    code[place_b] = ids_b * 3 + 2 * (np.diff(group_b, append=-1) != 0)
    text = _printed(1 + max(int(ids_a.max()), int(ids_b.max()), 1 << 16))[code].tolist()
    tokens = np.concatenate([[0], upto(ends_a) + upto(ends_b)]).tolist()
    digests = [hashlib.sha256(b"".join(text[x:y])[:-1]).hexdigest() for x, y in zip(tokens, tokens[1:])]
    span = (int(ids_a.max()) + 1) * n_b
    whole = np.repeat(np.arange(len(sizes)), links) * span + ids_a[in_a] * n_b + ids_b[in_b]
    distinct, n = np.unique(whole, return_counts=True)
    starts = np.searchsorted(distinct, np.arange(len(sizes) + 1) * span)
    return groups, links, digests, distinct % span, n, starts


def aligned(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, n_b: int, *, slice_bytes: int = SLICE, block: int = BLOCK) -> DataFrame:
    """Rows of PAIRS for docs (doc_id, text): results of each document that need no other, and its distinct pairs of linked ids with their numbers."""

    def work(batches):
        b = pieces(tokenizer_b)
        bytes_a, size_a = _spelled(tokenizer_a)

        def one(text: str):
            """Ids of A, of B and bytes of a text; none where either spells something else."""
            spelled = b" " + text.encode() if text else b""
            of_b = b.encode(text) if text else None
            if of_b is None:
                return [], [], 0
            of_a = token_ids(" " + text, tokenizer_a, special=False)
            return (of_a, of_b, len(spelled)) if b"".join([bytes_a[i] for i in of_a.tolist()]) == spelled else ([], [], 0)

        def results(doc_ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
            found = [one(x) for x in texts]
            n_a, of_b, sizes = np.array([len(x[0]) for x in found]), np.array([len(x[1]) for x in found]), np.array([x[2] for x in found], np.int64)
            some = np.flatnonzero(sizes)
            groups, links, digests = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.full(len(texts), "", object)
            pair, n, starts = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int32)
            if len(some):
                ids_a = np.concatenate([found[i][0] for i in some]).astype(np.int64)
                ids_b = np.array([x for i in some for x in found[i][1]], np.int64)
                groups[some], links[some], digests[some], pair, n, at = align(ids_a, size_a[ids_a], ids_b, b.lengths[ids_b], sizes[some], n_b, block)
                starts[some + 1] = np.diff(at)
                starts = np.cumsum(starts, dtype=np.int32)
            held = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"]))
            columns = [pa.array(np.zeros(len(texts), np.int64)), doc_ids, pa.array(n_a), pa.array(of_b), pa.array(groups), pa.array(links), pa.array(digests.tolist(), pa.string()), held]
            return pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])

        for batch in batches:
            ids, column = batch.column("doc_id"), batch.column("text")
            start, held, size = 0, [], 0
            for i in range(len(column)):
                held.append(column[i].as_py())
                size += len(held[-1])
                if size >= slice_bytes or i + 1 == len(column):
                    yield results(ids.slice(start, len(held)), held)
                    start, held, size = i + 1, [], 0

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(work, PAIRS.format(kind)).withColumn("row", F.monotonically_increasing_id())


def pair_totals(rows: DataFrame, n_b: int) -> DataFrame:
    """pair, total, docs, top of the rows of aligned: links and documents of each pair in the corpus, and whether no pair of its B id has more links. That is the table from ids of B to those of A, too."""
    totals = cut(rows.select(F.inline("pairs")).groupBy("pair").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("docs")), "pair-totals")
    most = totals.groupBy((F.col("pair") % n_b).alias("b")).agg(F.max("total").alias("most"))  # n_b rows at most
    met = totals.join(F.broadcast(most), F.col("pair") % n_b == F.col("b"))
    return met.select("pair", "total", "docs", (F.col("total") == F.col("most")).alias("top"))


def frequent_from(totals: DataFrame, most: int) -> int:
    """The least power of two of documents that no more than so many pairs reach."""
    held = {r.p: r["count"] for r in totals.groupBy(F.floor(F.log2("docs")).alias("p")).count().collect()}  # 63 rows at most
    p = max(held, default=0) + 1
    left = most
    while p > 0 and held.get(p - 1, 0) <= left:
        p -= 1
        left -= held.get(p, 0)
    return 1 << p


def alignment(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, *, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    n_b = len(pieces(tokenizer_b).bytes)
    rows = cut(aligned(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), tokenizer_a, tokenizer_b, n_b), "alignments")
    totals = cut(pair_totals(rows, n_b), "pair-ranks")
    at = frequent_from(totals, frequent)
    often, seldom = totals.where(F.col("docs") >= at).drop("docs"), totals.where(F.col("docs") < at).drop("docs")
    each = rows.select("row", F.inline("pairs"))
    summed = lambda met: met.groupBy("row").agg(F.sum(F.when(F.col("top"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("total")).alias("count_sum"))
    some = summed(each.join(F.broadcast(often), "pair"))
    rest = summed(each.join(F.broadcast(often.select("pair")), "pair", "left_anti").join(seldom, "pair"))
    sums = some.unionByName(rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return rows.drop("pairs").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
