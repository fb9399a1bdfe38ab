"""Document fingerprints of closed syncmers, in DataFrame functions only.

A k-mer, K characters, is a closed syncmer if the least of the hashes of its S-mers is that of its first or its last one. Whether it is one can be seen from the
k-mer alone, so the same passage gives the same anchors wherever it stands, and what is cut, moved or joined keeps those it had. Two in K - S + 1 k-mers are
chosen, and any K - S neighbours have one. As K is less than twice S, the first and last S-mer spell the k-mer out: an anchor is the hash of their two hashes.

A fingerprint is all anchors of a text in their order, 32 bits of each in decimal digits. Likeness is the Dice coefficient of two sets of anchors; ``shared_spans`` matches by position.

Neighbours in the order of ids meet without one task for all: bounds taken from the quantiles of the ids split the order into buckets of about ROWS rows, each
sorted by itself, and the first row of a bucket also goes to the one before it. Texts are shuffled once.

Edge cases: a null text is empty and has no anchor; a text without a syncmer (under 2 * K - S - 1 characters) has one anchor, the hash of the whole; two
fingerprints without anchors are alike (1.0), one without and one with are not (0.0). Characters are code points. Rows with equal ids follow one another by text;
rows without an id come after all others; a single row is its own next one. All rows that share one id lie in one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lapwing.llm.common import text_of

S = 16
WINDOW = 16
K = S + WINDOW - 1
ROWS = 256
MAX_BUCKETS = 1 << 16
NO_ID = -(1 << 63)
LOW = (1 << 32) - 1


def hashes(text: Column) -> Column:
    """The hashes of all S-mers of a text, by position."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{S}}})).")), lambda x: F.xxhash64(x))


def anchor(at: Column, h: Column) -> Column:
    """Position and hash in one long: the position in the upper half, 32 bits of the hash below."""
    return F.shiftleft(at.cast("long"), 32).bitwiseOR(h.bitwiseAND(LOW))


def at_of(x: Column) -> Column:
    return F.shiftright(x, 32).cast("int")


def with_syncmers(docs: DataFrame, text: Column, name: str) -> DataFrame:
    """docs with the anchors of a text's closed syncmers.

    The array of hashes is the variable of an outer lambda, so it is made once and read in place. The lesser one of a k-mer's two edges is
    compared with what stands between them, one by one, until one is less: 4.6 comparisons of 14 are expected.
    """
    none = F.lit(-1).cast("long")

    def chosen(h: Column) -> Column:
        last = lambda i: F.get(h, i + (WINDOW - 1))

        def syncmer(edge: Column, i: Column) -> Column:
            least = last(i).isNotNull()  # a k-mer begins here
            for n in reversed(range(1, WINDOW - 1)):  # nested to the right, so that the first failure ends it
                least = (edge <= F.get(h, i + n)) & least
            return F.when(least, anchor(i, F.xxhash64(F.get(h, i), last(i)))).otherwise(none)

        return F.array_remove(F.transform(F.transform(h, lambda a, i: F.least(a, last(i))), syncmer), none)

    return docs.withColumn(name, F.get(F.transform(F.array(hashes(text)), chosen), 0))


def or_whole(found: Column, text: Column) -> Column:
    """The anchors of a text: its syncmers, or one of the whole text if there are none."""
    return F.when((F.size(found) > 0) | (F.length(text) == 0), found).otherwise(F.array(anchor(F.lit(0), F.xxhash64(text))))


def with_anchors(docs: DataFrame, *, text_col: str = "text", anchors_col: str = "anchors") -> DataFrame:
    """docs with a column of anchors, array<long>; see anchor."""
    return with_syncmers(docs, text_of(text_col), anchors_col).withColumn(anchors_col, or_whole(F.col(anchors_col), text_of(text_col)))


def hashes_of(found: Column) -> Column:
    return F.transform(found, lambda x: x.bitwiseAND(LOW))


def printed(h: Column) -> Column:
    """A fingerprint: hashes in order, in decimal digits with commas between."""
    return F.array_join(h.cast("array<string>"), ",")


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two sets of hashes, arrays without repeats."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def bounds(docs: DataFrame, key: Column, rows: int = ROWS) -> list[int]:
    """Upper bounds of buckets of about so many rows in the order of key, a long: values of key, the largest last. At most MAX_BUCKETS."""
    n = docs.count()
    if not n:
        return []
    parts = min(MAX_BUCKETS, max(1, n // rows))
    shares = F.split(F.lit(",".join(str(i / parts) for i in range(1, parts + 1))), ",").cast("array<double>")
    row = docs.agg(F.percentile_approx(key, shares, min(20 * parts + 1000, 1 << 20)).alias("q"), F.max(key).alias("most")).first()
    return sorted({*row.q, row.most})


def bucket_of(key: Column, known: list[int]) -> Column:
    """How many of the sorted bounds lie below key: a binary search in a literal array."""
    array = F.split(F.lit(",".join(map(str, known))), ",").cast("array<long>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(known).bit_length()))])
    below = lambda lo, step: F.coalesce(F.get(array, lo + step - 1) < key, F.lit(False))
    return F.aggregate(steps, F.lit(0), lambda lo, step: F.when(below(lo, step), lo + step).otherwise(lo))


def with_next(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """doc_id, text and syncmers of every row of docs (doc_id, text), and of the next one by descending doc_id as next: struct<text, found>; after the last comes the first."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    known = bounds(docs, key, rows)
    if not known:
        known = [0]
    first_of_another = F.when(F.get(F.split(F.lit(",".join(map(str, known))), ",").cast("array<long>"), F.col("bucket")) == F.col("key"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    placed = docs.withColumn("key", key).withColumn("bucket", bucket_of(F.col("key"), known)).withColumn("guest", F.explode(first_of_another))
    placed = placed.withColumn("bucket", F.when(F.col("guest"), (F.col("bucket") + 1) % len(known)).otherwise(F.col("bucket")))
    dealt = with_syncmers(placed.repartition("bucket"), F.col("text"), "found")
    order = Window.partitionBy("bucket").orderBy("guest", F.desc("key"), "text")
    return dealt.withColumn("next", F.lead(F.struct("text", "found")).over(order)).where("NOT guest").select("doc_id", "text", "found", "next")


def edited_half(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: each text against itself with its last half replaced from the next one.

    The edited text's anchors are put together from those of both texts, as far as they lie in what is kept of each, and those of the k-mers across the seam.
    """
    met = with_next(docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")), rows)
    n = F.length("text")
    met = met.withColumn("n_chars", n).withColumn("keep", (n - F.floor(n / 2)).cast("int")).withColumn("head", F.expr("left(text, keep)"))
    met = met.withColumn("tail", F.expr("left(next.text, n_chars - keep)")).withColumn("taken", F.length("tail")).withColumn("edited", F.concat("head", "tail"))
    short = F.when(F.col("keep") + F.col("taken") < 2 * K, F.col("edited")).otherwise("")
    met = with_syncmers(with_syncmers(met, F.concat(F.right("head", F.lit(K - 1)), F.left("tail", F.lit(K - 1))), "across"), short, "short")
    upper = lambda x: F.shiftleft(F.greatest(x, F.lit(0)).cast("long"), 32)
    met = met.withColumn("own_end", upper(F.col("keep") - (K - 1))).withColumn("their_end", upper(F.col("taken") - (K - 1)))
    own, theirs = F.filter("found", lambda x: x < F.col("own_end")), F.filter("next.found", lambda x: x < F.col("their_end"))
    parts = F.concat(own, "across", theirs)  # positions are those in the three texts; from here on only the order counts
    made = met.withColumn("a", hashes_of(or_whole(F.col("found"), F.col("text")))).withColumn("b", hashes_of(or_whole(F.col("next.found"), F.col("next.text"))))
    made = made.withColumn("e", hashes_of(F.when(F.col("keep") + F.col("taken") < 2 * K, or_whole(F.col("short"), F.col("edited"))).otherwise(parts)))
    made = made.withColumn("set_a", F.array_distinct("a")).withColumn("set_b", F.array_distinct("b")).withColumn("set_e", F.array_distinct("e"))
    return made.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("a")).alias("fingerprint"),
        printed(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("set_a"), F.col("set_e")).alias("near_edited"),
        likeness(F.col("set_a"), F.col("set_b")).alias("near_next"),
    )


def shared_spans(pairs: DataFrame, *, gap: int = 2 * K) -> DataFrame:
    """pair, start_a, start_b, length, n_anchors: passages that two texts share, from rows of pair and the anchors a and b.

    Anchors that occur once in each text are matched; those at one distance of positions, each within gap of the one before, are a passage.
    """
    def once(side: str) -> DataFrame:
        each = pairs.select("pair", F.explode(side).alias("x")).select("pair", F.col("x").bitwiseAND(LOW).alias("h"), at_of(F.col("x")).alias(f"at_{side}"))
        return each.groupBy("pair", "h").agg(F.min(f"at_{side}").alias(f"at_{side}"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")

    met = once("a").join(once("b"), ["pair", "h"]).withColumn("shift", F.col("at_b") - F.col("at_a"))
    order = Window.partitionBy("pair", "shift").orderBy("at_a")
    starts = F.coalesce(F.col("at_a") - F.lag("at_a").over(order) > gap, F.lit(True)).cast("int")
    runs = met.withColumn("starts", starts).withColumn("run", F.sum("starts").over(order))
    found = runs.groupBy("pair", "shift", "run").agg(F.min("at_a").alias("start_a"), F.min("at_b").alias("start_b"), (F.max("at_a") - F.min("at_a") + K).alias("length"), F.count(F.lit(1)).alias("n_anchors"))
    return found.select("pair", "start_a", "start_b", "length", "n_anchors")
