"""Packing of tokenised documents into sequences of a fixed length, by best-fit decreasing.

A document's ids, closed by an end id, are cut into full windows, each a sequence of its own, and a rest. The pieces are a table; only the rests
are shuffled, and only with their ids where the caller keeps those. Rests are packed in groups of about GROUP: from the longest down, each goes into the open sequence with the least room that still
takes it. A segment tree over remaining capacities, with the number of open sequences of each, finds that room in logarithmic time.
Groups are dealt by a hash of the document and its place in its input partition, so that repeated ids or texts spread; they have bounded size
whatever the input. With thousands of rests to choose from, little is left open in each group's sequences.

A sequence is padded to ``length``, unless its tokens are a power of two already: then it stays as it is (``padded``).

Edge cases: null and empty texts have the end id alone; very long texts become many windows, and a run of white space that the library can't split is encoded by ``bpe``; repeated rows are packed
each for itself; a null doc_id is carried; an empty table gives an empty table; columns of the input other than id and
text take no part.
"""

from __future__ import annotations

import binascii

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.llm.common import cut, text_of
from lapwing.llm.tokens import token_ids

LENGTH = 2048
GROUP = 4096


class Capacities:
    """Segment tree over remaining capacity 0..length: counts of open sequences, summed upwards."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def tightest(self, need: int) -> int:
        """The least room of at least need that an open sequence has, or -1."""
        i, count = need + self.size, self.count
        if count[i]:
            return need
        while i > 1:
            if not i & 1 and count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def best_fit_decreasing(sizes: list[int], length: int) -> tuple[list[int], list[int], int]:
    """Sequence and offset of each size, and the number of sequences. Equal sizes go in the order given."""
    tree, open_at = Capacities(length), {}
    where, offset, n = [0] * len(sizes), [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        room = tree.tightest(size)
        if room < 0:
            seq, room, n = n, length, n + 1
        else:
            seq = open_at[room].pop()
            tree.add(room, -1)
        where[i], offset[i] = seq, length - room
        if room > size:
            tree.add(room - size, 1)
            open_at.setdefault(room - size, []).append(seq)
    return where, offset, n


def pieces(docs: DataFrame, path: str, *, end_id: int = 1, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Windows and rests of every document: doc_id, start, length, doc_tokens, ids_crc32, row (its place in its partition), ids (little-endian uint32; only if kept)."""
    names = ["doc_id", "start", "length", "doc_tokens", "ids_crc32", "row", *(["ids"] if keep_ids else [])]

    def work(batches):
        row = 0
        for b in batches:
            out: dict[str, list] = {k: [] for k in names}
            for doc_id, text in zip(b["doc_id"], b["text"]):
                ids = np.append(token_ids(text, path), end_id).astype("<u4")
                for start in range(0, len(ids), length):
                    part = ids[start : start + length]
                    for k, x in zip(names, (doc_id, start, len(part), len(ids), binascii.crc32(part.tobytes()), row, part.tobytes())):
                        out[k].append(x)
                row += 1
            ids_of = pd.Series(out["doc_id"], dtype="Int64") if kind == "bigint" else out["doc_id"]
            yield pd.DataFrame(out | {"doc_id": ids_of})

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, doc_tokens long, ids_crc32 long, row long" + ", ids binary" * keep_ids
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInPandas(work, schema)


def pack(rows: DataFrame, groups: int, length: int = LENGTH) -> DataFrame:
    """Pieces with sequence_id, offset, sequence_tokens and padded.

    A piece of full length fills a sequence and needs no shuffle; its sequence_id is odd. The others are packed in groups; theirs are even.
    """

    def work(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["doc_id", "start", "row", "length"], kind="stable").reset_index(drop=True)
        where, offset, n = best_fit_decreasing(g["length"].tolist(), length)
        where = np.array(where, np.int64)
        tokens = np.bincount(where, weights=g["length"], minlength=n).astype(np.int64)[where]
        g["sequence_id"], g["offset"], g["sequence_tokens"] = 2 * (where * groups + g["group"]), offset, tokens
        g["padded"] = np.where(tokens & (tokens - 1), length, tokens)
        return g.drop(columns=["group", "row"])

    kept = ", ids binary" * ("ids" in rows.columns)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start long, length long, doc_tokens long, ids_crc32 long{kept}, sequence_id long, offset long, sequence_tokens long, padded long"
    dealt = rows.where(F.col("length") < length).withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "row"), F.lit(groups)))
    rests = dealt.groupBy("group").applyInPandas(work, schema)
    whole = rows.where(F.col("length") == length).drop("row")
    whole = whole.select(*whole.columns, (2 * F.monotonically_increasing_id() + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.col("length").alias("sequence_tokens"), F.col("length").alias("padded"))
    return rests.unionByName(whole)


def pack_documents(docs: DataFrame, path: str, *, end_id: int = 1, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP, keep_ids: bool = True) -> DataFrame:
    """Every document's pieces with their places in sequences, and their ids if kept. A document has one rest at most, so a group has about ``group`` pieces."""
    rows = cut(pieces(docs, path, end_id=end_id, length=length, id_col=id_col, text_col=text_col, keep_ids=keep_ids), "pieces")
    groups = max(1, -(-rows.where(F.col("length") < length).count() // group))
    return pack(rows, groups, length)
