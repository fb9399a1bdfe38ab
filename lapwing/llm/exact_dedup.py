"""Exact deduplication against a historical index that is a minimal perfect hash over its distinct SHA-256 digests.

The index is a table. Each row holds one bucket of digests: a pilot for each small group of keys, and n slots for n keys;
a slot holds the full digest, the locator (doc_id) of the winner and the number of rows. A lookup computes a slot from
the digest and compares all 32 bytes: equal means a repeat of a historical text, else the text is new. New texts are
grouped among themselves. Of equal texts, the row with the largest doc_id stays.

Skew: rows are counted by digest before any shuffle, so a text that fills a third of the table is one row for each
task; the verdicts go back to the rows by a shuffle join, whose hot keys Spark splits. Buckets hold about BUCKET digests
however large the input.

Edge cases: a null text is an empty one; null doc_ids lose against any id, and a group of them alone has keep_id null and
keeps all its rows; rows that repeat a doc_id and its text share one verdict; empty tables give empty results.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.llm.common import cut, text_of

BUCKET = 512
BUCKETS_A_SHARD = 32
KEYS_A_PILOT = 3
INDEX = "shard long, bucket long, n int, pilots binary, digests binary, keep_ids binary, counts binary"
VERDICT = "digest binary, keep_id long, group_size long"
NONE = np.iinfo(np.int64).min


def _words(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit words of each digest; the first eight bytes choose the bucket."""
    w = np.ascontiguousarray(digests).view("<u8").reshape(-1, 4)
    return w[:, 1], w[:, 2]


def _place(b: np.ndarray, pilot: np.ndarray, n: int) -> np.ndarray:
    x = b ^ (pilot.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(n)).astype(np.int64)


def build_slots(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pilots, and the slot of each of the n distinct digests: every slot of 0..n-1 once.

    Groups of keys are placed from the largest to the smallest; a group takes the first pilot that puts its keys on free, distinct slots.
    """
    n = len(digests)
    a, b = _words(digests)
    groups = max(1, -(-n // KEYS_A_PILOT))
    of = (a % np.uint64(groups)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    starts = np.searchsorted(of[order], np.arange(groups + 1))
    pilots, slots, free = np.zeros(groups, np.int32), np.zeros(n, np.int64), np.ones(n, bool)
    for g in np.argsort(starts[:-1] - starts[1:], kind="stable"):
        keys = order[starts[g] : starts[g + 1]]
        if not len(keys):
            break
        tried, step = 0, 64
        while True:
            at = _place(b[keys][None, :], np.arange(tried, tried + step)[:, None], n)
            ok = free[at].all(axis=1)
            if len(keys) > 1:
                s = np.sort(at, axis=1)
                ok &= (s[:, 1:] != s[:, :-1]).all(axis=1)
            if ok.any():
                i = int(ok.argmax())
                pilots[g], slots[keys] = tried + i, at[i]
                free[at[i]] = False
                break
            tried, step = tried + step, min(step * 2, 4096)
    return pilots, slots


def find_slots(digests: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    a, b = _words(digests)
    return _place(b, pilots[(a % np.uint64(len(pilots))).astype(np.int64)], n)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, 32)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text_of(text_col), 256)).alias("digest"))


def _grouped(rows: DataFrame, buckets: int) -> DataFrame:
    """Distinct digests with winner and count, and the bucket and shard that they belong to."""
    shards = -(-buckets // BUCKETS_A_SHARD)
    bucket = F.pmod(F.conv(F.substring(F.hex("digest"), 1, 12), 16, 10).cast("long"), F.lit(buckets))
    return (
        rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).withColumn("bucket", bucket).withColumn("shard", F.pmod("bucket", F.lit(shards)))
    )


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """The index over rows (doc_id, digest)."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for bucket, g in rows.groupby("bucket"):
            keys, n = _matrix(g["digest"]), len(g)
            pilots, slots = build_slots(keys)
            at = np.argsort(slots)
            keep = g["keep_id"].fillna(NONE).astype("int64").to_numpy()
            out.append((int(rows["shard"].iloc[0]), int(bucket), n, pilots.tobytes(), keys[at].tobytes(), keep[at].tobytes(), g["group_size"].to_numpy("int64")[at].tobytes()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in INDEX.split(", ")])

    grouped = _grouped(history, buckets).withColumn("keep_id", F.coalesce("keep_id", F.lit(int(NONE))))
    return cut(grouped.groupBy("shard").applyInPandas(build, INDEX), "mph-index")


def merge_with_index(fresh: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """A verdict for every distinct digest: slots with their new repeats taken up, and the groups of those that no slot holds."""

    def merge(rows: pd.DataFrame, slots: pd.DataFrame) -> pd.DataFrame:
        parts, left = [], {k: g for k, g in rows.groupby("bucket")} if len(rows) else {}
        for s in slots.itertuples():
            keys = np.frombuffer(s.digests, np.uint8).reshape(-1, 32)
            keep, count = np.frombuffer(s.keep_ids, np.int64).copy(), np.frombuffer(s.counts, np.int64).copy()
            if (g := left.get(s.bucket)) is not None:
                own = _matrix(g["digest"])
                at = find_slots(own, np.frombuffer(s.pilots, np.int32), s.n)
                same = (keys[at] == own).all(axis=1)
                np.maximum.at(keep, at[same], g["keep_id"].to_numpy("int64")[same])
                np.add.at(count, at[same], g["group_size"].to_numpy("int64")[same])
                left[s.bucket] = g[~same]
            parts.append(pd.DataFrame({"digest": [k.tobytes() for k in keys], "keep_id": keep, "group_size": count}))
        parts += [g[["digest", "keep_id", "group_size"]] for g in left.values() if len(g)]
        return pd.concat(parts) if parts else pd.DataFrame({"digest": [], "keep_id": [], "group_size": []})

    grouped = _grouped(fresh, buckets).withColumn("keep_id", F.coalesce("keep_id", F.lit(int(NONE))))
    out = grouped.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(merge, VERDICT)
    return out.withColumn("keep_id", F.when(F.col("keep_id") != int(NONE), F.col("keep_id")))


def exact_dedup(docs: DataFrame, is_history=None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row. is_history: condition on doc_id; by default, the lower half of the range of ids."""
    rows = cut(digests(docs, id_col, text_col), "digests")
    n, lo, hi = rows.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    if is_history is None:
        is_history = F.col("doc_id") <= F.lit(lo + (hi - lo) // 2 if lo is not None else 0)
    old = F.coalesce(is_history, F.lit(False))
    buckets = max(1, -(-n // BUCKET))
    index = build_index(rows.where(old), buckets)
    verdicts = merge_with_index(rows.where(~old), index, buckets)
    return rows.join(verdicts, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
