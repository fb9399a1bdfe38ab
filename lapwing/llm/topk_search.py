"""Exact top-k search by inner product with a pivot table.

Distances of every candidate to a set of pivots are computed once. For a query q and candidate v each pivot p gives
|d(q,p) - d(v,p)| <= d(q,v); the largest over all pivots is the best lower bound on the distance, and so, as
2<q,v> = |q|^2 + |v|^2 - d(q,v)^2, an upper bound on the score. A block's candidates are evaluated in the order of that
bound until the next bound falls below the k-th best score found: the answer is exact.

Vectors are integers: floor(scale * x) of each component. Queries are laid against all rows in blocks: a task holds one
block of queries and one of candidates, both of bounded size; each gives k rows a query, and these are merged by a window.

Edge cases: null vectors and vectors with a null or non-finite component (also one that scaling takes beyond a double) take no part; a query meets the
candidates of its own length (pivots have the most frequent length, others have the norms as bound); fewer than k candidates give all of them; rows that
repeat a vec_id are separate candidates, but none is a candidate of its own id; ties go to the smaller vec_id. Large components are multiplied in
integers without bound; a score that doesn't fit a long is ranked exactly and reported as the nearest long.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lapwing.llm.common import MAX_LONG, cut

PIVOTS = 24
PIVOT_SAMPLE = 2000
QUERY_BLOCK = 8192
CANDIDATE_BLOCK = 32768
STEP = 128


def integer_vectors(rows: DataFrame, is_query: Column, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, query and v (array of double, all integers) of the rows that take part."""
    kept = rows.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("query"), F.transform(F.col(vector_col), lambda x: x.cast("double") * scale).alias("v"))
    sound = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    whole = lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)  # noqa: E731  from there on every double is an integer
    return kept.where(sound & F.col("id").isNotNull()).select("id", "query", F.transform("v", whole).alias("v"))


def choose_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Farthest-first traversal of a bounded sample."""
    if not len(sample):
        return sample
    chosen, gap = [0], None
    while len(chosen) < min(pivots, len(sample)):
        d = ((sample - sample[chosen[-1]]) ** 2).sum(axis=1)
        gap = d if gap is None else np.minimum(gap, d)
        if gap.max() <= 0:
            break
        chosen.append(int(gap.argmax()))
    return sample[chosen]


def _distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(((v[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2)) if len(v) * pivots.size < 4e6 else np.concatenate([_distances(x, pivots) for x in np.array_split(v, 2)])


def search_block(q_ids, q, q_far, c_ids, c, c_far, k: int) -> tuple[list, dict]:
    """(query, candidate, score) of the k best of this block for each query, and how many candidates were evaluated by query id.

    Products that may pass 2**52 are summed in Python's integers, which have no bound.
    """
    out, evaluated = [], {}
    c2, c_max = (c**2).sum(axis=1), np.abs(c).max(axis=1, initial=0)
    for i, qid in enumerate(q_ids):
        low = np.zeros(len(c))
        for p in range(c_far.shape[1]):
            np.maximum(low, np.abs(c_far[:, p] - q_far[i, p]), out=low)
        reach = c2 + (q[i] ** 2).sum()
        low = np.maximum(0.0, low - 1e-9 * np.sqrt(reach))  # rounding must not raise a bound
        bound = (reach - low * low) / 2 * (1 + 1e-12) + 1
        bound[~np.isfinite(bound)] = np.inf
        exact = c_max * (np.abs(q[i]).max(initial=0) * max(1, c.shape[1])) < 2.0**52
        order = np.argsort(-bound)
        best: list[tuple[int, int]] = []
        for at in range(0, len(order), STEP):
            part = order[at : at + STEP]
            if len(best) == k and float(bound[part[0]]) < -best[-1][0]:
                break
            evaluated[int(qid)] = evaluated.get(int(qid), 0) + len(part)
            sure = part[exact[part]]
            score = c[sure] @ q[i]
            if len(best) == k:
                good = score >= float(-best[-1][0])
                sure, score = sure[good], score[good]
            new = [(-int(s), int(c_ids[j])) for s, j in zip(score, sure)]
            new += [(-sum(int(x) * int(y) for x, y in zip(q[i], c[j])), int(c_ids[j])) for j in part[~exact[part]]]
            best = sorted([*best, *(x for x in new if x[1] != qid)])[:k]
        out += [(int(qid), cid, -s) for s, cid in best]
    return out, evaluated


def _order(score: int) -> str:
    """Text that sorts as the scores do among those beyond a long; empty for all others."""
    if -MAX_LONG - 1 < score < MAX_LONG:
        return ""
    digits = str(abs(score))
    key = f"{len(digits):06d}{digits}"
    return key if score > 0 else key.translate(str.maketrans("0123456789", "9876543210"))


def top_k(rows: DataFrame, is_query: Column, k: int = 10, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, report: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for each row that meets is_query. report: also evaluated, the candidates whose score was worked out for this query."""
    spark = rows.sparkSession
    vectors = integer_vectors(rows, is_query, id_col, vector_col, scale)
    sizes = vectors.groupBy(F.size("v").alias("s")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "s").limit(1).collect()
    dim, n = (sizes[0]["s"], sizes[0]["n"]) if sizes else (0, 0)
    sample = vectors.where(F.size("v") == dim).orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).collect()
    pivots = choose_pivots(np.array([r["v"] for r in sample], np.float64).reshape(len(sample), dim), PIVOTS)

    def pivot_table(batches):
        for b in batches:
            out = []
            for size, g in b.groupby(b["v"].map(len)):
                v = np.stack(g["v"]).astype(np.float64)
                far = _distances(v, pivots) if size == dim else np.zeros((len(v), 0))
                out.append(pd.DataFrame({"id": g["id"], "query": g["query"], "size": size, "v": [x.tobytes() for x in v], "far": [x.tobytes() for x in far]}))
            if out:
                yield pd.concat(out)

    base = cut(vectors.mapInPandas(pivot_table, "id long, query boolean, size int, v binary, far binary"), "pivot-table")
    q_blocks = max(1, -(-base.where("query").count() // QUERY_BLOCK))
    c_blocks = max(4 * spark.sparkContext.defaultParallelism, -(-n // CANDIDATE_BLOCK))
    queries = base.where("query").select("id", F.col("size").cast("long").alias("width"), "v", "far", F.pmod(F.xxhash64("id", "v"), F.lit(q_blocks)).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("cb"))
    spread = F.pmod(F.xxhash64("id", "v", F.monotonically_increasing_id()), F.lit(c_blocks))
    candidates = base.select("id", F.col("size").cast("long").alias("width"), "v", "far", spread.cast("int").alias("cb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))).alias("qb"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list = []
        if len(left) and len(right):
            size = int(left["width"].iloc[0])
            wide = len(pivots) if size == dim else 0
            read = lambda column, width, m: np.frombuffer(b"".join(column), np.float64).reshape(m, width)
            best, work = search_block(left["id"].to_numpy(), read(left["v"], size, len(left)), read(left["far"], wide, len(left)), right["id"].to_numpy(), read(right["v"], size, len(right)), read(right["far"], wide, len(right)), k)
            first: set[int] = set()
            for query, candidate, score in best:
                out.append((query, candidate, min(max(score, -MAX_LONG - 1), MAX_LONG), _order(score), 0 if query in first else work[query]))
                first.add(query)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "beyond", "work"])

    block = F.concat_ws("/", "width", "qb", "cb").alias("block")
    # Every column gets a new name of its own: cogroup takes columns of one table on both sides for the same.
    left, right = (x.select(block, *(F.col(c).alias(c) for c in ("id", "width", "v", "far"))) for x in (queries, candidates))
    found = left.groupBy("block").cogroup(right.groupBy("block")).applyInPandas(search, "query_id long, vec_id long, score long, beyond string, work long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")))
    if report:
        ranked = ranked.withColumn("evaluated", F.sum("work").over(Window.partitionBy("query_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", *(["evaluated"] if report else []))
