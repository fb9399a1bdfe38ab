"""Profiles of all given tables, and rosters made from customers, written as files and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.operators import profiles, rosters
from lapwing.operators.profiles import ForeignKey
from lapwing.sources.tables import shared_folder, table

C = F.col
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations"]
KEYS = [
    ForeignKey("nation", ["n_regionkey"], "region", ["r_regionkey"]), ForeignKey("customer", ["c_nationkey"], "nation", ["n_nationkey"]), ForeignKey("supplier", ["s_nationkey"], "nation", ["n_nationkey"]),
    ForeignKey("orders", ["o_custkey"], "customer", ["c_custkey"]), ForeignKey("lineitem", ["l_orderkey"], "orders", ["o_orderkey"]), ForeignKey("lineitem", ["l_partkey"], "part", ["p_partkey"]),
    ForeignKey("lineitem", ["l_suppkey"], "supplier", ["s_suppkey"]), ForeignKey("events", ["user_id"], "customer", ["c_custkey"]), ForeignKey("labels", ["doc_id"], "documents", ["doc_id"]),
    ForeignKey("orders", ["o_custkey", "o_orderkey"], "lineitem", ["l_suppkey", "l_orderkey"]), ForeignKey("events", ["event_type"], "customer", ["c_custkey"]), ForeignKey("pages", ["doc_id"], "documents", ["doc_id"]),
]


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {name: table(spark, d, name) for name in TABLES}


def catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Nulls, blank texts and the rate of nulls of every column of every table."""
    return profiles.columns(_tables(spark, d)).drop("kind")


def catalogue_keys(spark: SparkSession, d: str) -> DataFrame:
    """The foreign keys of these tables, one of two columns, one of different kinds and one of a missing column among them."""
    return profiles.foreign_keys(_tables(spark, d), KEYS)


def roster_changes(spark: SparkSession, d: str) -> DataFrame:
    """Customers as athletes of their nations' schools against a later roster in files, a school a file: some have left, moved, changed their year or name, or come with a new id."""
    k = C("c_custkey") % 10
    c = table(spark, d, "customer")
    base = c.select(C("c_custkey").cast("string").alias("source_id"), F.concat_ws(" ", "c_mktsegment", F.md5("c_name")).alias("full_name"), F.when(k > 4, "M").otherwise("F").alias("gender"), F.format_string("%d", k).alias("class_year"), C("c_nationkey").cast("long").alias("school_id"), F.lit("2026-01-01").alias("scraped_at"), C("c_custkey").alias("key"))
    k = C("key") % 10
    later = base.where(k != 0).select(
        F.when(k.isin(1, 2), F.concat(F.lit("n"), "source_id")).otherwise(C("source_id")).alias("source_id"), F.when(k == 3, F.concat("full_name", F.lit(" Jr"))).otherwise(C("full_name")).alias("full_name"), "gender",
        F.when(k.isin(3, 4), "next").otherwise(C("class_year")).alias("class_year"), F.when(k.isin(2, 5), (C("school_id") + 1) % 25).otherwise(C("school_id")).alias("school_id"),
    )
    people = lambda g: F.collect_list(F.when(C("gender") == g, F.struct("source_id", "full_name", "class_year")))
    schools = later.groupBy("school_id").agg(people("M").alias("men_roster"), people("F").alias("women_roster"))
    files = schools.select(F.concat(F.lit("division"), (C("school_id") % 3).cast("string")).alias("division"), F.to_json(F.struct("school_id", F.concat(F.lit("School "), C("school_id").cast("string")).alias("school_name"), F.lit("2026-02-01").alias("scraped_at"), "men_roster", "women_roster")).alias("value"))
    path = shared_folder(spark, "rosters")
    files.repartition("division").write.option("maxRecordsPerFile", 1).partitionBy("division").text(path)
    return rosters.diff(base.drop("key"), rosters.consolidated(spark, path, pattern="*.txt").drop("division", "school_name"))


QUERIES = {"Q15_A23_catalogue": catalogue, "Q14b_catalogue_keys": catalogue_keys, "S12_J40_roster_changes": roster_changes}

#: Columns of the given tables, for SQL; the plans read them from the schemas. A star marks texts.
_COLUMNS = {
    "region": "r_regionkey *r_name", "nation": "n_nationkey *n_name n_regionkey", "customer": "c_custkey *c_name c_nationkey c_acctbal *c_mktsegment", "supplier": "s_suppkey *s_name s_nationkey s_acctbal",
    "part": "p_partkey *p_name *p_brand *p_type p_size p_retailprice", "orders": "o_orderkey o_custkey *o_orderstatus o_totalprice o_orderdate *o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax *l_returnflag *l_linestatus l_shipdate", "events": "event_id ts user_id *event_type value *props",
    "documents": "doc_id *text *lang *source n_chars", "pages": "page_id *url *html", "benchmark": "item_id *text", "labels": "doc_id quality toxic", "conversations": "conv_id turn *role *text",
}


def _profile(name: str, column: str) -> str:
    empty = f"count(*) FILTER (trim({column[1:]}, ' ') = '')" if column.startswith("*") else "0::BIGINT"
    c = column.lstrip("*")
    return f"SELECT '{name}' AS \"table\", '{c}' AS \"column\", count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_null, {empty} AS n_empty, CASE WHEN count(*) > 0 THEN count(*) FILTER ({c} IS NULL) / count(*)::DOUBLE END AS null_rate FROM {name}"


def _key(fk: ForeignKey) -> str:
    if str(fk).startswith(("pages(", "events(event_type")):
        return f"SELECT '{fk}' AS key, false AS supported, NULL::BIGINT AS n_rows, NULL::BIGINT AS n_orphans, NULL::BIGINT AS n_null, NULL::BIGINT AS n_partial"
    whole, same = " AND ".join(f"c.{k} IS NOT NULL" for k in fk.keys), " AND ".join(f"p.{t} = c.{k}" for k, t in zip(fk.keys, fk.targets))
    none = " AND ".join(f"c.{k} IS NULL" for k in fk.keys)
    return f"SELECT '{fk}', true, count(*), count(*) FILTER ({whole} AND NOT EXISTS (SELECT 1 FROM {fk.parent} p WHERE {same})), count(*) FILTER ({none}), count(*) FILTER (NOT ({whole}) AND NOT ({none})) FROM {fk.child} c"


ORACLE_SQL = {
    "Q15_A23_catalogue": " UNION ALL ".join(_profile(name, c) for name, columns in _COLUMNS.items() for c in columns.split()),
    "Q14b_catalogue_keys": "SELECT * FROM (SELECT NULL AS key, NULL AS supported, NULL AS n_rows, NULL AS n_orphans, NULL AS n_null, NULL AS n_partial WHERE false UNION ALL " + " UNION ALL ".join(map(_key, KEYS)) + ")",
    "S12_J40_roster_changes": """
        WITH c AS (SELECT c_custkey AS i, c_custkey % 10 AS k, c_nationkey::BIGINT AS s FROM customer)
        SELECT i::VARCHAR AS source_id, CASE WHEN k IN (1, 2) THEN 'n' || i END AS other_id,
               CASE k WHEN 0 THEN 'removed' WHEN 1 THEN 'reidentified' WHEN 2 THEN 'transfer' WHEN 3 THEN 'update' WHEN 4 THEN 'update' WHEN 5 THEN 'transfer' ELSE 'unchanged' END AS change,
               s AS old_school, CASE WHEN k = 0 THEN NULL WHEN k IN (2, 5) THEN (s + 1) % 25 ELSE s END AS new_school, CASE k WHEN 3 THEN 'full_name,class_year' WHEN 4 THEN 'class_year' END AS fields FROM c""",
}
