"""Near copies by the Jaccard similarity of word shingles: the part of SimHash near-dedup that reaches a similarity of 0.8, without loss.

Two documents are near copies if their sets of 5-word shingles have Jaccard similarity 0.8 or more. 64 bits of SimHash differ in about ten places
at that similarity, where a trie can't turn back early. So the trie join's links, at its small budget, settle what is nearly equal; the rest comes
from prefixes. All shingles are put in one order. Of two sets that are so similar, the first (1 - similarity) * n + 1 shingles of each, its prefix,
have a shingle in common. So documents that share a prefix shingle are the candidates, and each link, the trie's too, is verified on whole sets.

The order only decides how much work there is: shingles that are frequent in a sample of the documents come last, the others by hash. A prefix
shingle that no other set has can't be in common, and what stands before and after a common one bounds what two sets can share: pairs that can't
reach the similarity are left out. Documents of one prefix shingle first meet one leader, another in every round, and groups that have become one
component rest. What can still be a link across components after these rounds is compared pair by pair, so no link is left out.

Only prefixes are kept for every document; whole sets are made again from the texts that have a candidate. Sets hold 32 bits of each shingle's hash there:
two sets of n shingles are expected to agree by chance in n * n / 2**32 of them (0.0001 for 600 words).

Edge cases: texts without words have an empty set and are copies of one another; fewer words than a shingle make one shingle of all; null texts are
empty; null doc_ids are never dropped; of rows that repeat a doc_id, only those whose own text is a near copy go.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lapwing.llm.common import cut, text_of

WORDS = 5
SIMILARITY = 0.8
ROUNDS = 3
SAMPLE_OF = 16
FREQUENT = 10_000
CACHE = 500_000
MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """XXH64 of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


WORD_HASHES = WordHashes()


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; ASCII letters in lower case, words split at ASCII white space."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.int64)
    w = min(words, len(parts))
    each = np.fromiter(map(WORD_HASHES.__getitem__, parts), np.uint64, len(parts))
    m = len(parts) - w + 1
    h = np.zeros(m, np.uint64)
    for i in range(w):
        h = (h ^ (h >> np.uint64(29))) * MIX + each[i : i + m]
    h = (h ^ (h >> np.uint64(32))) * MIX
    return np.unique(h ^ (h >> np.uint64(29))).view(np.int64)


def bits_of(h: np.ndarray) -> int:
    """SimHash of a set of 64-bit hashes: a bit is set if more than half of them have it."""
    votes = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        votes += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(h), bitorder="little").view("<i8")[0])


def prefix_length(n: int, similarity: float) -> int:
    return n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0


def _prefixes(docs: DataFrame, words: int, similarity: float, last: np.ndarray) -> DataFrame:
    """doc_id, t, sig, n, fp, rare, hs: of each row the first shingles in the common order, those of last at the end. t stands for the text, sig for the set; rare: how many of hs aren't in last."""

    rank = np.argsort(last)
    known = last[rank]

    def moved(h: np.ndarray) -> tuple[np.ndarray, int]:
        if not len(last):
            return h, len(h)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        often = known[at] == h
        return np.concatenate([h[~often], last[np.sort(rank[at[often]])]]), len(h) - int(often.sum())

    def each(batches):
        for b in batches:
            out = []
            for t in b["text"]:
                h = shingles(t, words)
                ordered, rare = moved(h)
                first = ordered[: prefix_length(len(h), similarity)]
                out.append((np.uint64(xxhash.xxh64_intdigest(h.tobytes())).view(np.int64), len(h), bits_of(h), min(rare, len(first)), first))
            yield pd.concat([b[["doc_id", "t"]].reset_index(drop=True), pd.DataFrame(out, columns=["sig", "n", "fp", "rare", "hs"])], axis=1)

    return docs.mapInPandas(each, "doc_id long, t long, sig long, n int, fp long, rare int, hs array<long>")


def _whole(rows: DataFrame, words: int) -> DataFrame:
    """sig, n, hs of rows of sig and text: 32 bits of every shingle."""

    def each(batches):
        for b in batches:
            found = [shingles(t, words) for t in b["text"]]
            yield pd.DataFrame({"sig": b["sig"], "n": [len(h) for h in found], "hs": [(h & 0xFFFFFFFF).astype(np.uint32).view(np.int32) for h in found]})

    return rows.mapInPandas(each, "sig long, n int, hs array<int>")


def _candidates(marked: DataFrame, similarity: float) -> DataFrame:
    """sig, h, n, i, u, most, root: prefix shingles that different sets share. i: place in the order; u: shared ones before it; most: shingles that the set can have in common with any other.

    Rows of the FREQUENT shingles aren't shuffled: they are aggregated on the map side, and what is shared of them, at most FREQUENT rows, is broadcast.
    The others are shuffled once by shingle, for the aggregate and for the join with it alike: both take the same columns, so that Spark reuses the exchange.
    """
    prefix = marked.where("n > 0").select("sig", "n", "rare", F.posexplode("hs").alias("i", "h"))
    prefix = prefix.select("sig", "h", (F.shiftleft(F.col("n").cast("long"), 32) + F.col("i")).alias("at"), (F.col("i") < F.col("rare")).alias("once"))

    def shared(rows: DataFrame) -> DataFrame:
        both = rows.groupBy("h").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi"), F.min("at").alias("first"))
        return both.where("lo != hi").select("h", F.shiftright("first", 32).cast("int").alias("least"))

    one, often = prefix.where("once").drop("once").repartition("h"), prefix.where("NOT once").drop("once")
    met = one.join(shared(one), "h").unionByName(often.join(F.broadcast(shared(often)), "h"))
    met = met.distinct().select("sig", "h", F.shiftright("at", 32).cast("int").alias("n"), F.col("at").bitwiseAND(0xFFFFFFFF).cast("int").alias("i"), "least")
    own = Window.partitionBy("sig")  # the prefix of one set
    length = F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9).cast("int") + 1
    met = met.withColumn("u", F.row_number().over(own.orderBy("i")) - 1).withColumn("most", F.col("n") - length + F.count(F.lit(1)).over(own).cast("int"))
    return cut(met.where(F.col("most") >= _needed("n", "least", similarity)).select("sig", "h", "n", "i", "u", "most", F.col("sig").alias("root")), "near-prefixes")


def _needed(n: str, m: str, similarity: float):
    """Shingles in common that two sets of these sizes need, less what rounding may take."""
    return F.lit(similarity / (1 + similarity)) * (F.col(n) + F.col(m)) - 1e-9


def _possible(x: str, y: str, similarity: float):
    """Whether two rows of candidates with one shingle can belong to near copies: shared ones before it, itself, and what follows."""
    upto = F.least(f"{x}.u", f"{y}.u") + 1 + F.least(F.col(f"{x}.n") - F.col(f"{x}.i"), F.col(f"{y}.n") - F.col(f"{y}.i")) - 1
    return F.least(upto, f"{x}.most", f"{y}.most") >= _needed(f"{x}.n", f"{y}.n", similarity)


def links(docs: DataFrame, marked: DataFrame, settled: DataFrame, components, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """a, b: links between sigs of sets that connect all pairs of at least that similarity.

    docs: doc_id, t, text; marked: their prefixes; settled: pairs a, b of sigs that are likely near, tried first; components: as simhash_dedup has it.
    """
    met = _candidates(marked, similarity)
    some = marked.join(met.select("sig").distinct(), "sig", "left_semi").groupBy("sig").agg(F.min(F.struct("t", "doc_id")).alias("m")).select("sig", F.col("m.t").alias("mt"), F.col("m.doc_id").alias("mid"))
    texts = docs.join(some, (docs.t == some.mt) & docs.doc_id.eqNullSafe(some.mid)).select("sig", "text")
    whole = cut(_whole(texts, words).dropDuplicates(["sig"]), "near-sets")

    def verified(pairs: DataFrame) -> DataFrame:
        a, b = (whole.select(F.col("sig").alias(x), F.col("n").alias(f"n{x}"), F.col("hs").alias(f"h{x}")) for x in "ab")
        common = F.size(F.array_intersect("ha", "hb"))
        full = pairs.join(a, "a").join(b, "b").withColumn("common", common)
        return full.where(F.col("common") >= F.lit(similarity) * (F.col("na") + F.col("nb") - F.col("common")) - 1e-9).select("a", "b")

    found = cut(verified(settled.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))), "near-links")
    left = _unsettled(met, found, components)
    for k in range(ROUNDS):
        if left.isEmpty():
            return found
        # One leader for each shingle: first the set with the fewest shingles of its own, then any. One pair for each set.
        rank = F.struct((F.col("n") - F.col("most") if k == 0 else F.lit(0)).alias("own"), F.xxhash64("sig", F.lit(k)).alias("rank"), *left.columns)
        leader = left.groupBy("h").agg(F.min(rank).alias("m")).select(F.col("h").alias("mh"), "m")
        star = left.alias("x").join(leader, (F.col("x.h") == F.col("mh")) & (F.col("x.root") != F.col("m.root")) & _possible("x", "m", similarity))
        star = star.groupBy("sig").agg(F.min(F.struct("m.own", "m.rank", "m.sig")).alias("m")).select(F.least("sig", "m.sig").alias("a"), F.greatest("sig", "m.sig").alias("b")).distinct()
        found = cut(found.unionByName(verified(star)), "near-links")
        left = _unsettled(left, found, components)
    x, y = left.alias("x"), left.alias("y")
    rest = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.sig") < F.col("y.sig")) & (F.col("x.root") != F.col("y.root")) & _possible("x", "y", similarity))
    return found.unionByName(verified(rest.select(F.col("x.sig").alias("a"), F.col("y.sig").alias("b")).distinct()))


def _unsettled(met: DataFrame, found: DataFrame, components) -> DataFrame:
    """Rows of met, with their components, where a prefix shingle still joins several components."""
    roots = components(found)
    now = met.drop("root").join(roots, met.sig == roots.node, "left").select("sig", "h", "n", "i", "u", "most", F.coalesce("root", "sig").alias("root"))
    open_ = now.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("h")
    return cut(now.join(open_, "h", "left_semi"), "near-open")


def marked_documents(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The table of prefixes of docs (doc_id, t, text)."""
    seen = _prefixes(docs.where(F.pmod("t", F.lit(SAMPLE_OF)) == 0), words, 0.0, np.empty(0, np.int64)).select(F.explode("hs").alias("h"))
    often = seen.groupBy("h").count().where("count >= 8").orderBy(F.desc("count"), "h").limit(FREQUENT).collect()
    return cut(_prefixes(docs, words, similarity, np.array([r.h for r in often][::-1], np.int64)), "shingle-prefixes")
