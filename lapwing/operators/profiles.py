"""Profiles of all tables of a catalogue, planned from their schemas: one pass over a table for all its columns, and every declared foreign key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C = F.col


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def columns(tables: Mapping[str, DataFrame]) -> DataFrame:
    """table, column, kind, n_rows, n_null, n_empty (blank texts), null_rate of every column of every table; an empty table has a rate of null."""
    parts = []
    for name, df in tables.items():
        counts = [F.count(F.lit(1)).alias("n")]
        for i, (c, kind) in enumerate(df.dtypes):
            column = C(f"`{c}`")
            counts += [F.count_if(column.isNull()).alias(f"null_{i}"), (F.count_if(F.trim(column) == "") if kind == "string" else F.lit(0).cast("long")).alias(f"empty_{i}")]
        rows = [F.struct(F.lit(c).alias("column"), F.lit(kind).alias("kind"), C("n").alias("n_rows"), C(f"null_{i}").alias("n_null"), C(f"empty_{i}").alias("n_empty")) for i, (c, kind) in enumerate(df.dtypes)]
        parts.append(df.agg(*counts).select(F.inline(F.array(*rows))).withColumn("table", F.lit(name)))
    return _together(parts).select("table", "column", "kind", "n_rows", "n_null", "n_empty", F.when(C("n_rows") > 0, C("n_null") / C("n_rows")).alias("null_rate"))


@dataclass(frozen=True)
class ForeignKey:
    child: str
    keys: Sequence[str]
    parent: str
    targets: Sequence[str]

    def __str__(self) -> str:
        return f"{self.child}({', '.join(self.keys)}) -> {self.parent}({', '.join(self.targets)})"


def foreign_keys(tables: Mapping[str, DataFrame], keys: Sequence[ForeignKey]) -> DataFrame:
    """key, supported, n_rows, n_orphans (whole keys without a partner), n_null (all parts null), n_partial (some parts null) of each foreign key.

    A key is unsupported, and its counts null, where a table or column is missing or the kinds of its columns differ. Keys are counted before they meet their parents, so a hot one is one row.
    """
    parts = []
    for fk in keys:
        child, parent = tables.get(fk.child), tables.get(fk.parent)
        kinds = [dict(df.dtypes) if df is not None else {} for df in (child, parent)]
        fits = len(fk.keys) == len(fk.targets) and all(k in kinds[0] and t in kinds[1] and kinds[0][k] == kinds[1][t] for k, t in zip(fk.keys, fk.targets))
        if not fits:
            session = next(iter(tables.values())).sparkSession
            parts.append(session.range(1).select(F.lit(str(fk)).alias("key"), F.lit(False).alias("supported"), *[F.lit(None).cast("long").alias(x) for x in ("n_rows", "n_orphans", "n_null", "n_partial")]))
            continue
        rows = child.groupBy(*fk.keys).agg(F.count(F.lit(1)).alias("__n"))
        there = parent.select(*[C(t).alias(k) for k, t in zip(fk.keys, fk.targets)]).distinct().withColumn("__hit", F.lit(True))
        nulls = sum((C(k).isNull().cast("int") for k in fk.keys), F.lit(0))
        met = rows.join(there, list(fk.keys), "left")
        of = lambda where: F.coalesce(F.sum(F.when(where, C("__n"))), F.lit(0))
        parts.append(met.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n_rows"), of((nulls == 0) & C("__hit").isNull()).alias("n_orphans"), of(nulls == len(fk.keys)).alias("n_null"), of((nulls > 0) & (nulls < len(fk.keys))).alias("n_partial")).select(F.lit(str(fk)).alias("key"), F.lit(True).alias("supported"), "n_rows", "n_orphans", "n_null", "n_partial"))
    return _together(parts)
