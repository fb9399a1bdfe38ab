"""Duplicate removal: survivors of a key, archives of what goes, group sizes, fingerprints of groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rank: str = "rn", size: str | None = None) -> DataFrame:
    """df with the place of each row in its group and, on demand, the group's size. Null keys form a group."""
    w = Window.partitionBy(*keys)
    out = df.withColumn(rank, F.row_number().over(w.orderBy(*order)))
    return out.withColumn(size, F.count(F.lit(1)).over(w)) if size else out


def survivors(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return ranked(df, keys, order, "__rn").where("__rn = 1").drop("__rn")


def counted_survivors(df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: Sequence[str], size: str = "copies") -> DataFrame:
    """keys and keep of the first row of each group, ascending, and the group's size. Both are summed up on the map side, so a key that many rows share sends one row a task. Nulls in order come first."""
    first = F.min_by(F.struct(*keep), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    return df.groupBy(*keys).agg(first.alias("__first"), F.count(F.lit(1)).alias(size)).select(*keys, "__first.*", size)


def split_duplicates(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """Survivors, and the rows to archive before they are deleted."""
    marked = ranked(df, keys, order, "__rn")
    return marked.where("__rn = 1").drop("__rn"), marked.where("__rn > 1").drop("__rn")


def duplicate_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row has, with n."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def extra_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n_groups, n_extra: one row, zeros where nothing repeats."""
    return duplicate_groups(df, keys).agg(F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_extra"))


def signature(members: Column, separator: str = ",") -> Column:
    """Distinct members in order, as one text: the identity of a lineup."""
    return F.array_join(F.array_sort(F.collect_set(members)), separator)


def fingerprint(row: Column) -> Column:
    """MD5 of the sorted MD5s of a group's rows."""
    return F.md5(F.array_join(F.array_sort(F.collect_list(F.md5(row))), ","))


def copied_containers(df: DataFrame, container: str, keys: Sequence[str]) -> DataFrame:
    """Containers of which every row has its key in another container too: container, n_rows. A keyed aggregate in place of comparing pairs."""
    elsewhere = df.groupBy(*keys).agg(F.countDistinct(container).alias("__c"))
    same = None
    for k in keys:
        same = df[k].eqNullSafe(elsewhere[k]) if same is None else same & df[k].eqNullSafe(elsewhere[k])
    joined = df.join(elsewhere, same, "left").select(df[container], "__c")
    return joined.groupBy(container).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("__c") > 1).alias("__shared")).where("n_rows = __shared").drop("__shared")
