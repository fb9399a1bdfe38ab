"""How document filters act on one another, for every order in which they can be applied.

Each document fails a set of filters, a mask. Counts by mask are all that any order needs: at most 2**n cells for n filters and each part. They are summed on the
map side, so whole tables shrink to a few rows before they meet. Then the n! orders of a part are visited by swapping neighbours (Steinhaus, Johnson and
Trotter): one swap changes what two steps see, so only those two are read from the cells again. The walk adds up what each filter removes; over n! that
is its Shapley value.

One filter looks beyond its document: whether a smaller id has the same text. It needs no join back: all rows count as copies first, then the row with the
least id of each text (a rank that Spark limits on the map side, so a hot text sends one row a task) is moved from the cell of copies to that of first ones.

Edge cases: null texts are empty, null parts are the empty string; rows without an id are no copies of others, nor others of them; rows that share both an id and
a text are no copies of one another; several labels of an id count as one if any is 1; documents without labels are in no loss; an empty table has no parts.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lapwing.llm.common import cut, text_of

MAX_FILTERS = 8
WORD = r"[^\x20\x09-\x0D]+"
COPY = "E"


def standard_filters(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions of the filters that look at one document. words: its words, made once."""
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 3 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def mask_of(failures: Sequence[Column]) -> Column:
    """Bit i is set where failures[i] holds; null counts as passed."""
    return sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(failures)), F.lit(0))


def cells(rows: DataFrame, losses: Sequence[str]) -> DataFrame:
    """part, mask, n and a count for each of the boolean columns losses."""
    return rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(x)).alias(x) for x in losses])


def copies_flagged(rows: DataFrame, bit: int, losses: Sequence[str], *, id_col: str = "doc_id", digest_col: str = "digest") -> DataFrame:
    """cells of rows, with the bit for copies set in mask where a smaller id has the same digest. rows should be a table: it is read twice."""
    own = Window.partitionBy(digest_col).orderBy(id_col)
    first = rows.where(F.col(id_col).isNotNull()).withColumn("__rank", F.rank().over(own)).where("__rank = 1").drop("__rank").unionByName(rows.where(F.col(id_col).isNull()))
    columns = ["part", "mask", "n", *losses]
    copied = lambda df: df.withColumn("mask", F.col("mask").bitwiseOR(bit))
    whole, moved = cells(rows, losses), cells(first, losses)
    back = copied(moved).select("part", "mask", *[(-F.col(x)).alias(x) for x in columns[2:]])
    both = copied(whole).unionByName(back).unionByName(moved)
    return both.groupBy("part", "mask").agg(*[F.sum(x).alias(x) for x in columns[2:]])


def transpositions(n: int) -> Iterator[int]:
    """The n! - 1 places i whose elements i and i + 1 are swapped, so that every order of n elements is visited once."""
    at, toward = list(range(n)), [-1] * n  # of each element, by size
    order = list(range(n))
    while True:
        for x in reversed(range(n)):
            i, j = at[x], at[x] + toward[x]
            if 0 <= j < n and order[j] < x:
                break
        else:
            return
        y = order[j]
        order[i], order[j], at[x], at[y] = y, x, j, i
        for z in range(x + 1, n):
            toward[z] = -toward[z]
        yield min(i, j)


def walk(counts: Mapping[str, np.ndarray], names: Sequence[str], losses: Sequence[str]) -> pd.DataFrame:
    """A row for each order and step. counts: for n and each loss, an array by mask."""
    n, size = len(names), len(names)
    masks = np.arange(1 << size)
    total = counts["n"]
    alone = [int(total[1 << f]) for f in range(size)]

    def step(before: int, f: int) -> tuple[int, ...]:
        fails, open_ = (masks >> f & 1) == 1, (masks & before) == 0
        here = fails & open_
        return (int(total[open_ & ~fails].sum()), int(total[here].sum()), int(total[fails & ~open_].sum()), alone[f], *(int(counts[x][here].sum()) for x in losses))

    order, before, rows = list(range(size)), [(1 << i) - 1 for i in range(size)], []
    steps = [step(before[i], order[i]) for i in range(n)]
    shapley = [0] * size

    def visit() -> None:
        name = "".join(names[f] for f in order)
        for i, f in enumerate(order):
            shapley[f] += steps[i][1]
            rows.append((name, i + 1, f, *steps[i]))

    visit()
    for i in transpositions(size):
        order[i], order[i + 1] = order[i + 1], order[i]
        before[i + 1] = before[i] | 1 << order[i]
        steps[i], steps[i + 1] = step(before[i], order[i]), step(before[i + 1], order[i + 1])
        visit()
    out = pd.DataFrame(rows, columns=["filter_order", "step", "f", "kept", "removed", "redundant", "unique_fails", *(f"{x}_lost" for x in losses)])
    out["shapley"] = out["f"].map(dict(enumerate(shapley))).astype("int64")
    return out.drop(columns="f")


def interactions(found: DataFrame, names: Sequence[str], losses: Sequence[str] = ()) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, <loss>_lost, shapley, from cells. Each part's cells, 2**n at most, are one small group."""
    if not 1 <= len(names) <= MAX_FILTERS or any(len(x) != 1 for x in names) or len(set(names)) < len(names):
        raise ValueError(f"1 to {MAX_FILTERS} filters, each named by a letter of its own")
    names, losses = list(names), list(losses)

    def orders(group: pd.DataFrame) -> pd.DataFrame:
        counts = {x: np.zeros(1 << len(names), np.int64) for x in ("n", *losses)}
        for x, of in counts.items():
            of[group["mask"].to_numpy()] = group[x].to_numpy()
        out = walk(counts, names, losses)
        out.insert(0, "part", group["part"].iloc[0])
        return out

    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, " + "".join(f"{x}_lost long, " for x in losses) + "shapley long"
    return found.groupBy("part").applyInPandas(orders, schema)


def audit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The standard filters and that for copies, over whole texts; losses of documents that labels mark as good (quality 1) or toxic (toxic 1)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_of(text_col).alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    filters = standard_filters(F.col("text"), F.col("words"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask_of(list(filters.values())).alias("mask"))
    marks = labels.groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    joined = rows.join(marks, F.col("doc_id") == F.col("__id"), "left").drop("__id")
    losses = ["good", "toxic"]
    names = [*filters, COPY]
    return interactions(copies_flagged(cut(joined, "filter-masks"), 1 << names.index(COPY), losses), names, losses)
