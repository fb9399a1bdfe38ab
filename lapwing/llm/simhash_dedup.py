"""SimHash near-duplicates by a self-join of a binary trie.

A fingerprint has a bit set where more than half of a document's word-shingle hashes have it set. Distinct fingerprints
form a binary trie. The join walks pairs of nodes at equal depth together, adds up the differing bits of their
prefixes and turns back once they exceed the error budget; what is left at small nodes is compared at once.

Spread: pairs of nodes go down the top of the trie as tables, until both hold at most SUBTREE fingerprints. Each pair of
subtrees whose prefixes differ within the budget is one group, so each task holds two small subtrees, whatever prefix many documents share. A task returns
a spanning forest of the links it found, never all pairs of a dense ball. Components come from alternating min-label steps
on tables, with the lineage cut at every step.

Edge cases: texts without words have fingerprint zero and link like any other; fewer words than a shingle make one
shingle of all; null texts are empty; repeated rows share fingerprint and component; null doc_ids get a fingerprint and the component's
smallest non-null id, and are never dropped; empty tables give empty tables.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.llm import near_copies
from lapwing.llm.common import cut, text_of

BUDGET = 2
LEAF = 48
SUBTREE = 2048
STEP = 4
SEED = 42
CHUNK = 1 << 16


def fingerprint(text: str, words: int = 3) -> int:
    """SimHash of the word shingles of a text; ASCII letters in lower case, words split at ASCII white space."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    w = min(words, len(parts))
    starts, ends = starts[: len(parts) - w + 1], ends[w - 1 :]
    hashed, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(starts), CHUNK):
        h = np.array([hashed(joined[a:b], SEED) for a, b in zip(starts[i : i + CHUNK].tolist(), ends[i : i + CHUNK].tolist())], dtype="<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(starts), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, *, text_col: str = "text", words: int = 3) -> DataFrame:
    """docs with column fp (long; the fingerprint's 64 bits)."""

    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).astype(np.int64), dtype="int64")

    return docs.withColumn("fp", hashed(text_of(text_col)))


def _forest(n: int, a: np.ndarray, b: np.ndarray, parent: np.ndarray) -> None:
    for x, y in zip(a.tolist(), b.tolist()):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)


def trie_join(left: np.ndarray, right: np.ndarray | None, depth: int, budget: int = BUDGET) -> list[tuple[int, int]]:
    """Links of a spanning forest over all pairs within the budget, between two subtrees that start at depth, or within one (right None).

    A subtree is a sorted array of uint64: a node is a range of it, and its children meet where the next bit turns to 1.
    """
    keys = left if right is None else np.concatenate([left, right])
    base = 0 if right is None else len(left)
    other = left if right is None else right
    parent = list(range(len(keys)))
    spent = 0 if right is None or depth == 0 else int((int(left[0]) ^ int(right[0])) >> (64 - depth)).bit_count()
    stack = [(0, len(left), 0, len(other), depth, spent)]
    while stack:
        a, b, c, d, bit, spent = stack.pop()
        if a >= b or c >= d or spent > budget:
            continue
        same = right is None and a == c
        if bit == 64 or (b - a <= LEAF and d - c <= LEAF):
            near = np.bitwise_count(left[a:b, None] ^ other[None, c:d]) <= budget
            if same:
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            if len(i):
                _forest(len(keys), i + a, j + c + base, parent)
            continue
        mask = np.uint64(1 << (63 - bit))

        def turn(array, lo, hi):
            return lo + int(np.searchsorted((array[lo:hi] & mask) != 0, True))

        m, k = turn(left, a, b), turn(other, c, d)
        stack += [(a, m, c, k, bit + 1, spent), (m, b, k, d, bit + 1, spent), (a, m, k, d, bit + 1, spent + 1)]
        if not same:
            stack.append((m, b, c, k, bit + 1, spent + 1))
    links = []
    for x in range(len(keys)):
        r = x
        while parent[r] != r:
            r = parent[r]
        if r != x:
            links.append((int(keys[r]), int(keys[x])))
    return links


def links(fingerprints: DataFrame, budget: int = BUDGET, subtree: int = SUBTREE) -> DataFrame:
    """a, b: links that connect what lies within the budget, from a table of distinct fingerprints fp.

    Node pairs go down the trie STEP levels at a time while one of the two holds more than ``subtree`` fingerprints, so a prefix that many share is
    cut further, to single fingerprints if need be.
    """
    depth, ready = 0, []
    open_ = fingerprints.sparkSession.range(1).select(F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"), F.lit(0).alias("spent"))
    while True:
        depth += STEP
        node = F.shiftrightunsigned("fp", 64 - depth)
        nodes = fingerprints.groupBy(node.alias("node")).agg(F.count(F.lit(1)).alias("size")).withColumn("parent", F.shiftrightunsigned("node", STEP))
        one, two = (nodes.select(F.col("parent").alias(f"parent_{x}"), F.col("node").alias(x), F.col("size").alias(f"size_{x}")) for x in "ab")
        met = open_.join(one, F.col("p") == F.col("parent_a")).join(two, F.col("q") == F.col("parent_b")).where("p != q OR a <= b")
        met = met.withColumn("spent", F.col("spent") + F.bit_count(F.col("a").bitwiseXOR(F.col("b")).bitwiseAND((1 << STEP) - 1)))
        small = (F.col("size_a") <= subtree) & (F.col("size_b") <= subtree)
        met = cut(met.where(F.col("spent") <= budget).select(F.col("a").alias("p"), F.col("b").alias("q"), "spent", small.alias("small")), "trie-nodes")
        ready.append((depth, met.where("small")))
        open_ = met.where("NOT small").drop("small")
        if depth == 64 or open_.isEmpty():
            break
    parts = []
    for depth, pairs in ready:
        rows = fingerprints.select("fp", F.shiftrightunsigned("fp", 64 - depth).alias("own"))
        for side, of in (("p", pairs), ("q", pairs.where("p != q"))):
            parts.append(rows.join(of, rows.own == of[side]).select(F.lit(depth).alias("depth"), "p", "q", F.lit(side == "q").alias("second"), "fp"))
    spread = parts[0]
    for x in parts[1:]:
        spread = spread.unionByName(x)

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        bits = lambda x: np.sort(x.to_numpy("int64").view(np.uint64))
        one, two, at = bits(rows.loc[~rows["second"], "fp"]), bits(rows.loc[rows["second"], "fp"]), int(rows["depth"].iloc[0])
        found = trie_join(one, None if rows["p"].iloc[0] == rows["q"].iloc[0] else two, at, budget)
        return pd.DataFrame(np.array(found, np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])

    return spread.groupBy("depth", "p", "q").applyInPandas(join, "a long, b long")


def components(pairs: DataFrame) -> DataFrame:
    """node, root: the least node that each node of pairs (a, b) reaches. Alternates large-star and small-star steps on tables."""
    edges = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    while True:
        # large star: every larger neighbour of a node goes to the least of the node and its neighbours
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: a node and its smaller neighbours go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        new = cut(small, "edges")
        # done when every node hangs on one root and no root hangs on another
        roots = new.select(F.col("v").alias("u")).distinct().join(new, "u", "left_semi")
        many = new.groupBy("u").count().where("count > 1")
        done = roots.isEmpty() and many.isEmpty()
        edges = new
        if done:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, budget: int = BUDGET) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    marked = cut(with_fingerprints(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")), words=words).select("doc_id", "fp"), "fingerprints")
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), budget))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = cut(named, "rooted")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(named.select("fp", "root").join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def similar_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, budget: int = BUDGET) -> DataFrame:
    """doc_id, t, component_id, near of every row: components of documents whose sets of shingles have at least that Jaccard similarity. t: xxhash64 of the text.

    The trie join at the given budget finds the nearly equal ones first; near_copies finds what lies further apart and verifies every link.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity must lie in (0, 1]")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("t"), text_of(text_col).alias("text"))
    marked = near_copies.marked_documents(rows, words, similarity)
    sets = cut(marked.groupBy("sig").agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp")), "distinct-sets")
    first = sets.groupBy("fp").agg(F.min("sig").alias("first"))
    trie = links(first.select("fp"), budget)
    one, two = (first.select(F.col("fp").alias(x), F.col("first").alias(f"sig_{x}")) for x in "ab")
    between = trie.join(one, "a").join(two, "b").select(F.col("sig_a").alias("a"), F.col("sig_b").alias("b"))
    within = sets.join(first, "fp").where("sig != first").select(F.col("sig").alias("a"), F.col("first").alias("b"))
    roots = components(near_copies.links(rows, marked, between.unionByName(within), components, words, similarity))
    named = cut(sets.join(roots, sets.sig == roots.node, "left").select("sig", "least", F.coalesce("root", "sig").alias("root")), "near-roots")
    ids = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("sig", "component_id")
    return marked.select("doc_id", "t", "sig").join(ids, "sig").select("doc_id", "t", "component_id")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, budget: int = BUDGET) -> DataFrame:
    """docs without the rows whose id isn't the least of their component of similar documents; see similar_documents. Null ids stay."""
    found = similar_documents(docs, id_col=id_col, text_col=text_col, words=words, similarity=similarity, budget=budget)
    gone = found.where("component_id != doc_id").select(F.col("doc_id").alias("__id"), F.col("t").alias("__t")).distinct()
    return docs.join(gone, (docs[id_col] == F.col("__id")) & (F.xxhash64(text_of(text_col)) == F.col("__t")), "left_anti")
