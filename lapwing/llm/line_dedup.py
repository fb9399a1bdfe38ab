"""Line deduplication by a deletion-neighbourhood join. DataFrame functions only.

A line is compared in normal form: lower case, no white space at the ends.
Its place is (doc_id, hash of the text, line number); a null doc_id comes last. Rows that share a doc_id and the text count as one document.

* Lines whose normal form has under ``min_chars`` characters always stay (headings, list marks, blanks).
* Of lines with equal normal form, the earliest stays.
* A line of ``near_min_chars`` or more goes too if some earlier line lies within one character edit of it
  (insertion, deletion or substitution). The earlier line need not itself stay, so the result doesn't depend on
  the order of the work.

Emitting every one-deletion variant of every line costs a row for each character of the corpus. So lines first pass
lossless sieves, two at least and more while a window is long. A line is laid out in windows; a single edit falls into one of them, and what lies outside it is equal in
both lines. Only windows whose outside is shared with a different line go on. Their deletion variants are emitted as hashed
keys, equal variants are joined, and the edit distance of the joined windows is verified with ``levenshtein``.

Edge cases: a null text becomes an empty one; an empty text has one empty line, which stays; an empty table gives an empty table; columns of the
input other than the text are carried through, whatever their names, but for n_lines, n_exact and n_near, which the result's own replace; rows that repeat keep the same lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapwing.llm.common import MAX_LONG, cut, text_of

WINDOW = 256
WHITE = " \t\r\x0b\x0c\xa0"


def normal_line(line: Column) -> Column:
    return F.trim(F.lower(line), F.lit(WHITE))


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """d, t, n, line, h1, h2 of every line that takes part; h1 and h2 together identify the normal form."""
    return (
        docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(MAX_LONG)).alias("d"), F.xxhash64(text_of(text_col)).alias("t"), F.posexplode(F.split(text_of(text_col), "\n", -1)).alias("n", "raw"))
        .select("d", "t", "n", normal_line(F.col("raw")).alias("line"))
        .where(F.length("line") >= min_chars)
        .select("d", "t", "n", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("b"), "line").alias("h2"))
    )


def _step(length: Column, windows: int) -> Column:
    """The block by which each window starts after the one before. It is rounded, so nearby lengths mostly share it."""
    grain = F.greatest(F.lit(1), F.pow(F.lit(2.0), F.floor(F.log2(length + F.lit(0.5))) - 3 - windows.bit_length()).cast("int"))
    return (grain * F.floor(length / (windows * grain))).cast("int")


def _windows(rows: DataFrame, windows: int) -> DataFrame:
    """A row for each window of each text: key stands for all that lies outside it, text becomes the inside.

    Lengths differ by one at most in a pair, so a text is also laid out as the text that is one shorter, where that differs.
    """
    laid = rows.withColumn("size", F.length("text")).select("*", _step(F.col("size"), windows).alias("b1"), _step(F.col("size") - 1, windows).alias("b2"))
    total = windows * F.when(F.col("b1") != F.col("b2"), 2).otherwise(1)
    each = laid.select("*", F.explode(F.sequence(F.lit(0), total - 1)).alias("i"))
    each = each.select("key", "h1", "d", "t", "n", "text", "size", F.when(F.col("i") < windows, F.col("b1")).otherwise(F.col("b2")).alias("b"), (F.col("i") % windows).alias("q"))
    before, after = F.col("q") * F.col("b"), (windows - 1 - F.col("q")) * F.col("b")
    head, tail = F.substring(F.col("text"), F.lit(1), before), F.substring(F.col("text"), F.col("size") - after + 1, after)
    inside = F.substring(F.col("text"), before + 1, F.col("size") - before - after)
    return each.select(F.xxhash64("key", "b", "q", head, tail).alias("key"), "h1", "d", "t", "n", inside.alias("text"))


def _sieve(rows: DataFrame, windows: int) -> DataFrame:
    """Windows whose outside is shared by different lines, once for each line, at its first place."""
    laid = _windows(rows, windows)
    shared = laid.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo != hi").select("key")
    kept = laid.join(shared.hint("shuffle_hash"), "key", "left_semi")
    return cut(kept.groupBy("key", "h1").agg(F.min(F.struct("d", "t", "n", "text")).alias("m")).select("key", "h1", "m.*"), "line-windows")


def near_matches(lines: DataFrame, near_min_chars: int = 20) -> DataFrame:
    """The first place (d, t, n) of every distinct line that has an earlier line within one edit, with the place (near_d, near_t, near_n) of the earliest."""
    rows = lines.where(F.length("line") >= near_min_chars).select(F.lit(0).cast("long").alias("key"), "h1", "d", "t", "n", F.col("line").alias("text"))
    kept = _sieve(_sieve(rows, 2), 4)
    while (kept.agg(F.max(F.length("text"))).first()[0] or 0) > WINDOW:
        kept = _sieve(kept, 4)

    text, size = F.col("text"), F.length("text")
    less = kept.where(size > 0).withColumn("i", F.explode(F.sequence(F.lit(1), size)))
    gone = F.concat(F.substring(text, F.lit(1), F.col("i") - 1), F.substring(text, F.col("i") + 1, size))
    less = less.withColumn("variant", F.xxhash64(gone))
    whole = kept.withColumn("variant", F.xxhash64(text))
    # Equal variants at one place: substitutions. A variant that is a whole window: insertions and deletions.
    member = F.struct("d", "t", "n", "text")
    sites = less.select("key", "i", "variant", member.alias("own"))
    same_place = sites.groupBy("key", "i", "variant").agg(F.min("own").alias("other"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    substituted = sites.join(same_place, ["key", "i", "variant"]).select("own", "other")
    shorter = whole.groupBy("key", "variant").agg(F.min(member).alias("short"))
    longer = less.select("key", "variant", member.alias("long"))
    meets = longer.join(shorter, ["key", "variant"])
    edited = meets.select(F.explode(F.array(F.struct(F.col("long").alias("own"), F.col("short").alias("other")), F.struct(F.col("short").alias("own"), F.col("long").alias("other")))).alias("p")).select("p.*")
    return (
        substituted.unionByName(edited)
        .where((F.struct("other.d", "other.t", "other.n") < F.struct("own.d", "own.t", "own.n")) & (F.levenshtein("own.text", "other.text", 1) >= 0))
        .groupBy(F.col("own.d").alias("d"), F.col("own.t").alias("t"), F.col("own.n").alias("n"))
        .agg(F.min(F.struct("other.d", "other.t", "other.n")).alias("o"))
        .select("d", "t", "n", F.col("o.d").alias("near_d"), F.col("o.t").alias("near_t"), F.col("o.n").alias("near_n"))
    )


def duplicate_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, near_min_chars: int = 20) -> DataFrame:
    """d, t, n, near of every line that goes; near: only a near line precedes it."""
    lines = _lines(docs, id_col, text_col, min_chars)
    ids = cut(lines.drop("line"), "lines")
    repeated = ids.groupBy("h1", "h2").agg(F.min(F.struct("d", "t", "n")).alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1")
    known = repeated.select("h1", "h2", F.col("f.d").alias("fd"), F.col("f.t").alias("ft"), F.col("f.n").alias("fn"))
    near = near_matches(lines, near_min_chars).join(ids, ["d", "t", "n"]).select("h1", "h2", F.lit(-MAX_LONG - 1).cast("long").alias("fd"), F.lit(0).cast("long").alias("ft"), F.lit(-1).alias("fn"))
    later = F.struct("d", "t", "n") > F.struct("fd", "ft", "fn")
    return ids.join(known.unionByName(near), ["h1", "h2"]).where(later).groupBy("d", "t", "n").agg(F.min(F.col("fn") < 0).alias("near"))


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, near_min_chars: int = 20) -> DataFrame:
    """docs with the repeated lines taken out of the text, plus n_lines, n_exact and n_near: lines had, gone as equal, gone as near."""
    d, t, g, n = (_free(docs, x) for x in ("__d", "__t", "__g", "__n"))
    gone = (
        duplicate_lines(docs, id_col=id_col, text_col=text_col, min_chars=min_chars, near_min_chars=near_min_chars)
        .groupBy("d", "t")
        .agg(F.collect_set("n").alias("gone"), F.count_if(F.col("near")).alias("near"))
    )
    gone = gone.select(F.col("d").alias(d), F.col("t").alias(t), F.struct("gone", "near").alias(g))
    keyed = docs.withColumns({d: F.coalesce(F.col(id_col).cast("long"), F.lit(MAX_LONG)), t: F.xxhash64(text_of(text_col))})
    lines = F.split(text_of(text_col), "\n", -1)
    here = F.filter(F.coalesce(F.col(f"{g}.gone"), F.array().cast("array<int>")), lambda i: i < F.size(lines))
    kept = F.filter(lines, lambda x, i: ~F.array_contains(F.coalesce(F.col(f"{g}.gone"), F.array().cast("array<int>")), i))
    out = keyed.join(gone, [d, t], "left").withColumn(n, F.struct(F.size(lines).cast("long").alias("lines"), F.size(here).cast("long").alias("gone"), F.coalesce(F.col(f"{g}.near"), F.lit(0)).alias("near")))
    return out.withColumns(
        {text_col: F.array_join(kept, "\n"), "n_lines": F.col(f"{n}.lines"), "n_exact": F.greatest(F.lit(0).cast("long"), F.col(f"{n}.gone") - F.col(f"{n}.near")), "n_near": F.least(F.col(f"{n}.near"), F.col(f"{n}.gone"))}
    ).drop(d, t, g, n)
