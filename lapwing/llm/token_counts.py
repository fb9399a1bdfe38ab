"""Token counts from flat, unindexed token files by a separator scan.

A token file is a run of little-endian unsigned ids of 32 bits, or of 16 where the vocabulary is small enough; each document ends with the end-of-document id. Nothing says where documents
begin, and a document may run on from one file into the next. A scan takes each file in blocks: one vectorised comparison finds
the separators of a block, and their differences are the lengths of the documents inside. What lies before the first and after the last
separator of a block is stitched on by prefix scans: over the blocks of a file, then over one small row a file, by ranges of paths.

Files come through Spark's own reader, so any store that Spark knows will do. One file is one row: write files of bounded size, as
``document_token_counts`` does (by classes of text length, CLASSES). Files are taken in the order of their paths.

Edge cases: an empty file adds nothing; a document of the end id alone counts as zero tokens (or one with the id);
ids after the last separator form an unclosed document, reported with closed = false; bytes short of a whole id at a file's end raise an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lapwing.llm.common import cut, scratch, text_of
from lapwing.llm.tokens import encoding, token_ids

BLOCK = 1 << 18
#: Most bytes of a text (None: no bound), and documents a file. So a file has 128 MB of text at most, or one document.
CLASSES = {16 << 10: 8192, 1 << 20: 128, None: 1}
EMIT = 100_000


def scan(ids: np.ndarray, end_id: int, block: int = BLOCK) -> tuple[np.ndarray, int]:
    """Lengths of the documents that end in this file, separators left out, and what is open at its end. The first length may be the tail of an earlier file's document.

    Blocks are searched each for itself; a prefix scan, the running maximum of their last separators, tells each block where its first document began.
    """
    ends = [at + np.flatnonzero(ids[at : at + block] == end_id) for at in range(0, len(ids), block)]
    last = np.maximum.accumulate(np.array([-1, *(int(e[-1]) if len(e) else -1 for e in ends)]))
    lengths = [np.diff(e, prepend=before) - 1 for e, before in zip(ends, last) if len(e)]
    return (np.concatenate(lengths) if lengths else np.zeros(0, np.int64)), len(ids) - 1 - int(last[-1])


def _carried(rows: DataFrame, part: list[str], order: str) -> DataFrame:
    """rows (order, tail, closes) with what each hands on (run) and whether anything closes up to and with it (any), within each part."""
    within = Window.partitionBy(*part).orderBy(order)
    section = rows.withColumn("s", F.sum(F.col("closes").cast("long")).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return section.withColumn("run", F.sum("tail").over(Window.partitionBy(*part, "s").orderBy(order))).withColumn("any", F.col("s") > 0).drop("s")


def handed_on(tails: DataFrame) -> DataFrame:
    """path, carry, last, closes of rows path, tail, closes, one for each file: what reaches a file from those before it, in the order of paths.

    A prefix scan of two levels: files by ranges of paths, then the ranges (as many as partitions), so no task holds all files.
    """
    ranged = cut(tails.repartitionByRange("path").withColumn("bucket", F.spark_partition_id()), "file-tails")
    inner = _carried(ranged, ["bucket"], "path")
    own = Window.partitionBy("bucket").orderBy("path")
    inner = inner.withColumn("before", F.lag("run").over(own)).withColumn("closed_before", F.coalesce(F.lag("any").over(own), F.lit(False))).withColumn("next", F.lead("path").over(own))
    ends = inner.where("next IS NULL").select("bucket", F.col("run").alias("tail"), F.col("any").alias("closes"), F.lit(0).alias("all"))
    outer = _carried(ends, ["all"], "bucket")
    each = Window.partitionBy("all").orderBy("bucket")
    outer = outer.select("bucket", F.coalesce(F.lag("run").over(each), F.lit(0)).alias("reaches"), F.lead("bucket").over(each).isNull().alias("last_bucket"))
    met = inner.join(outer, "bucket")
    carry = F.coalesce("before", F.lit(0)) + F.when(F.col("closed_before"), 0).otherwise(F.col("reaches"))
    return met.select("path", carry.alias("carry"), (F.col("last_bucket") & F.col("next").isNull()).alias("last"), "closes")


def token_counts(spark: SparkSession, path: str, end_id: int, *, block: int = BLOCK, width: int = 4) -> DataFrame:
    """path, ordinal (from 0, among the documents that end in the file), n_tokens without the separator, closed. width: bytes of an id. path is that of the file in which the document ends."""

    def work(batches):
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                if len(content) % width:
                    raise ValueError(f"{name}: {len(content)} bytes are no whole number of ids")
                lengths, left = scan(np.frombuffer(content, f"<u{width}"), end_id, block)
                for i in range(0, len(lengths), EMIT):
                    part = lengths[i : i + EMIT]
                    yield pd.DataFrame({"path": name, "ordinal": np.arange(i, i + len(part)), "n_tokens": part, "open": False})
                yield pd.DataFrame({"path": [name], "ordinal": [len(lengths)], "n_tokens": [left], "open": [True]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    found = cut(files.mapInPandas(work, "path string, ordinal long, n_tokens long, open boolean"), "file-documents")
    tails = found.where("open").select("path", F.col("n_tokens").alias("tail"), (F.col("ordinal") > 0).alias("closes"))
    out = found.join(handed_on(tails), "path")
    closed = out.where("not open").select("path", "ordinal", (F.col("n_tokens") + F.when(F.col("ordinal") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("closed"))
    left = out.where("open and last").select("path", "ordinal", (F.col("n_tokens") + F.when(~F.col("closes"), F.col("carry")).otherwise(0)).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(left.where("n_tokens > 0"))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, *, text_col: str = "text", docs_a_file: int = CLASSES[16 << 10]) -> int:
    """Writes flat token files below path, documents in the order in which docs has them, without a shuffle. Returns the bytes of an id.

    Spark's text sink writes the bytes as they are, with the end id's bytes as its line separator. Partition p goes to part-p, with a new file (c000, c001 ..) after docs_a_file documents.
    """
    width = 2 if encoding(tokenizer).n_vocab <= 1 << 16 else 4

    @F.pandas_udf("binary")
    def encoded(texts: pd.Series) -> pd.Series:
        return pd.Series([token_ids(x, tokenizer, special=False).astype(f"<u{width}").tobytes() for x in texts], dtype=object)

    separator = int(end_id).to_bytes(width, "little").decode("latin-1")
    values = docs.select(encoded(text_of(text_col)).cast("string").alias("value"))
    values.write.option("encoding", "ISO-8859-1").option("lineSep", separator).option("maxRecordsPerFile", docs_a_file).text(path)
    return width


def document_token_counts(docs: DataFrame, tokenizer: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text", classes: dict[int | None, int] = CLASSES) -> DataFrame:
    """doc_id, n_tokens, part, ordinal of every row, as the scan of token files of the table finds them. part: partition and size class.

    A document is known by its partition and its place in it among those of its class, so docs must have the same rows in the same partitions whenever
    it is read, as a table has. Where a place has no document or a document no place, the job fails.
    """
    size, least, out = F.octet_length(text_of(text_col)), -1, None
    named = lambda pattern: F.regexp_extract("path", pattern, 1).cast("long")
    for most, docs_a_file in classes.items():
        some = docs.where((size > least) & (size <= most) if most else size > least)
        least, path = most, scratch(docs.sparkSession, "tokens")
        width = write_token_files(some, path, tokenizer, end_id, text_col=text_col, docs_a_file=docs_a_file)
        counts = token_counts(docs.sparkSession, path, end_id, width=width).where("closed")
        counts = counts.select(named(r"part-(\d+)-").alias("part"), (named(r"-c(\d+)\.\w+$") * docs_a_file + F.col("ordinal")).alias("ordinal"), "n_tokens")
        place = F.monotonically_increasing_id()
        places = some.select(F.col(id_col).cast("long").alias("doc_id"), place.alias("place")).select("doc_id", F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND((1 << 33) - 1).alias("ordinal"), F.lit(True).alias("there"))
        met = counts.join(places, ["part", "ordinal"], "full_outer")
        whole = F.col("there").isNotNull() & F.col("n_tokens").isNotNull()
        one = met.select("doc_id", F.when(whole, F.col("n_tokens")).otherwise(F.raise_error(F.lit("token files and documents differ")).cast("long")).alias("n_tokens"), F.concat_ws("/", F.lit(most).cast("string"), "part").alias("part"), "ordinal")
        out = one if out is None else out.unionByName(one)
    return out
