"""Joins, identity resolution, set operations, upserts, decisions, components and integrity checks on the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lapwing.operators import dedup, decisions, intervals, matching, upsert
from lapwing.sources.tables import table
from lapwing.streaming import live


def _days(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))


def region_totals(spark: SparkSession, d: str) -> DataFrame:
    """Orders by region: fact to dimension to an affiliation that may be unknown (nations 20 and up count as unknown here)."""
    nation = table(spark, d, "nation").where("n_nationkey < 20")
    joined = (
        table(spark, d, "orders")
        .join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    )
    return joined.groupBy("r_name").agg(F.count(F.lit(1)).alias("n_orders"), F.countDistinct("c_custkey").alias("n_customers"))


def nation_summary(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers of each nation, counted before the join; nations without any stay."""
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("c"))
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("s"))
    n = table(spark, d, "nation")
    out = n.join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    zero = F.lit(0)
    return out.select("n_name", F.coalesce("c", zero).alias("n_customers"), F.coalesce("s", zero).alias("n_suppliers"))


def idle_customers(spark: SparkSession, d: str) -> DataFrame:
    """Customers without an order."""
    return table(spark, d, "customer").select("c_custkey", "c_name").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


def urgent_customers(spark: SparkSession, d: str) -> DataFrame:
    """Customers with an urgent order that is finished."""
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


def null_safe_groups(spark: SparkSession, d: str) -> DataFrame:
    """Rows of repeated keys, where an undiscounted line has no discount: null keys meet null keys."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.nullif("l_discount", F.lit(0.0)).alias("discount"), "l_partkey")
    groups = dedup.duplicate_groups(rows, ["l_orderkey", "discount"]).select(F.col("l_orderkey").alias("k"), F.col("discount").alias("dk"), "n")
    return rows.join(groups, (F.col("l_orderkey") == F.col("k")) & F.col("discount").eqNullSafe(F.col("dk"))).drop("k", "dk")


#: Changes work, not results: customers with more keys than this meet others key by key, not by pairs of keys.
MANY_KEYS = 64


def _alike(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers of equal sets of (day, priority, status) as classes, and how classes meet: two that share two keys share a pair of keys, which few have, while many have each key.

    members: member, rep (the least customer of the class), n_keys, n_members; paired: rep, k, l, a row for each two keys of a class (a key by its hash of 64 bits); listed: a < b (representatives), n_shared >= 2, where
    one has more than MANY_KEYS keys.
    """
    key = ["day", "o_orderpriority", "o_orderstatus"]
    facts = _days(spark, d).select(F.col("o_custkey").alias("member"), *key).dropna().distinct()
    # a set by its size and two hashes of 64 bits
    sets = facts.groupBy("member").agg(F.count(F.lit(1)).alias("n_keys"), F.bit_xor(F.xxhash64(*key)).alias("x"), F.bit_xor(F.xxhash64(F.lit("b"), *key)).alias("y"))
    classes = sets.groupBy("n_keys", "x", "y").agg(F.min("member").alias("rep"), F.count(F.lit(1)).alias("n_members"))
    members = sets.join(classes, ["n_keys", "x", "y"]).select("member", "rep", "n_keys", "n_members")
    shown = facts.join(classes.where("n_keys > 1").select(F.col("rep").alias("member"), "n_keys"), "member").select(F.col("member").alias("rep"), F.xxhash64(*key).alias("k"), (F.col("n_keys") > MANY_KEYS).alias("many"))

    # as many parts as a shuffle has, since each list becomes many rows
    few = shown.where("NOT many").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "rep").groupBy("rep").agg(F.sort_array(F.collect_list("k")).alias("keys"))
    paired = few.select("rep", "keys", F.posexplode("keys").alias("at", "k")).select("rep", "k", F.explode(F.slice("keys", F.col("at") + 2, F.size("keys"))).alias("l"))
    one, two = shown.where("many").select(F.col("rep").alias("one"), "k"), shown.select(F.col("rep").alias("two"), "k", "many")
    met = one.join(two, "k").where("one < two OR one > two AND NOT many").groupBy(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b"))
    return members, paired, met.agg(F.count(F.lit(1)).alias("n_shared")).where("n_shared >= 2")


def overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of customers that ordered alike on the same day at least twice: found between classes of customers that always ordered alike, then laid out for their members."""
    members, paired, listed = _alike(spark, d)
    pairs = paired.withColumnRenamed("rep", "a").join(paired.withColumnRenamed("rep", "b"), ["k", "l"]).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    # n shared keys are n * (n - 1) / 2 shared pairs
    pairs = pairs.select("a", "b", F.round((1 + F.sqrt(1 + 8 * F.col("c"))) / 2).cast("long").alias("n_shared")).unionByName(listed)
    within = members.where("member = rep AND n_keys >= 2 AND n_members > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.col("n_keys").alias("n_shared"))
    side = lambda rep, name: members.select(F.col("rep").alias(rep), F.col("member").alias(name))
    met = pairs.unionByName(within).join(side("a", "one"), "a").join(side("b", "two"), "b").where("a < b OR one < two")
    return met.select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b"), "n_shared")


def overlap_components(spark: SparkSession, d: str) -> DataFrame:
    """Connected components over those pairs, found between classes; a class stands for its members, whose least one represents it. All classes that share a pair of keys are joined to the least of them."""
    members, paired, listed = _alike(spark, d)
    least = paired.groupBy("k", "l").agg(F.min("rep").alias("a"), F.max("rep").alias("most")).where("a < most").drop("most")
    stars = paired.withColumnRenamed("rep", "b").join(least, ["k", "l"]).where("a < b").select("a", "b").distinct()
    found = matching.components(stars.unionByName(listed.select("a", "b"))).withColumnRenamed("node", "rep")
    met = members.join(found, "rep", "left").where("root IS NOT NULL OR n_keys >= 2 AND n_members > 1")
    return met.select(F.col("member").alias("node"), F.coalesce("root", "rep").alias("root"))


def copied_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders of which every line (part, supplier, quantity) occurs in another order."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.nullif("l_quantity", F.lit(1.0)).alias("quantity"))
    return dedup.copied_containers(rows, "l_orderkey", ["l_partkey", "l_suppkey"])


def current_status(spark: SparkSession, d: str) -> DataFrame:
    """Status of customers on 1 July 1998: an order's status holds until the customer's next order."""
    o = _days(spark, d)
    until = F.lead("day").over(Window.partitionBy("o_custkey").orderBy("day", "o_orderkey"))
    periods = o.withColumn("until", until)
    return periods.where(intervals.holds(F.lit("1998-07-01").cast("date"), F.col("day"), F.col("until"))).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("until").isNull()).alias("n_open"))


def overlapping_orders(spark: SparkSession, d: str) -> DataFrame:
    """Finished and open orders of one customer whose ten-day ranges come within three days."""
    o = _days(spark, d)
    side = lambda status, p: o.where(F.col("o_orderstatus") == status).select("o_custkey", F.col("o_orderkey").alias(f"{p}_order"), F.col("day").alias(f"{p}_from"), F.date_add("day", 10).alias(f"{p}_to"))
    return intervals.overlapping(side("F", "f"), side("O", "o"), ("f_from", "f_to"), ("o_from", "o_to"), 3, keys=["o_custkey"]).select("o_custkey", "f_order", "o_order")


def latest_orders(spark: SparkSession, d: str) -> DataFrame:
    return intervals.latest(_days(spark, d), ["o_custkey"], [F.desc_nulls_last("day"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "day", "o_orderstatus")


def unique_claims(spark: SparkSession, d: str) -> DataFrame:
    """Pending orders with the one finished order of the same customer within 60 days."""
    o = _days(spark, d)
    p = o.where("o_orderstatus = 'P'").select("o_custkey", F.col("o_orderkey").alias("claim"), F.col("day").alias("claim_day"))
    f = o.where("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderkey").alias("found"), F.col("day").alias("found_day"))
    return intervals.unique_claims(p, f, ["o_custkey"], "claim_day", "found_day", 60, "claim").select("claim", "found")


def token_matches(spark: SparkSession, d: str) -> DataFrame:
    """Distinct part names that share a word, with their overlap and similarity; names are met by word."""
    names = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    words = names.select("name", F.explode(matching.tokens(F.col("name"))).alias("word"))
    pairs = words.withColumnRenamed("name", "a").join(words.withColumnRenamed("name", "b"), "word").where("a < b").select("a", "b").distinct()
    scored = pairs.withColumn("overlap", F.round(matching.token_overlap(matching.tokens(F.col("a")), matching.tokens(F.col("b"))), 6))
    return scored.withColumn("similarity", F.round(matching.similarity(F.col("a"), F.col("b")), 6))


def closest_names(spark: SparkSession, d: str) -> DataFrame:
    """The one most similar part name of each, if it is the only one as close and 0.6 or more."""
    both = token_matches(spark, d)
    each = both.select(F.col("a").alias("name"), F.col("b").alias("other"), "similarity").unionByName(both.select(F.col("b").alias("name"), F.col("a").alias("other"), "similarity"))
    return matching.best_unique(each, "name", F.col("similarity"), 0.6).select("name", "other", "score")


def sole_claims(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers that alone deliver a part."""
    return matching.one_claimant(table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct(), "l_partkey")


def resolved_suppliers(spark: SparkSession, d: str) -> DataFrame:
    """A customer for each supplier: by balance in the same nation, else by number, else by the only customer of nation and segment BUILDING; unique keys only."""
    c = table(spark, d, "customer")
    cents = lambda name: F.round(F.col(name) * 100).cast("long").cast("string")
    by_balance = matching.unique_lookup(c, F.concat_ws("|", F.col("c_nationkey").cast("string"), cents("c_acctbal")), "c_custkey")
    by_number = matching.unique_lookup(c.where("c_mktsegment <> 'MACHINERY'"), F.split_part("c_name", F.lit("#"), F.lit(2)), "c_custkey")
    by_segment = matching.unique_lookup(c.where("c_mktsegment = 'BUILDING'"), F.col("c_nationkey").cast("string"), "c_custkey")
    s = table(spark, d, "supplier")
    tiers = [
        ("balance", F.concat_ws("|", F.col("s_nationkey").cast("string"), cents("s_acctbal")), by_balance),
        ("number", F.split_part("s_name", F.lit("#"), F.lit(2)), by_number),
        ("segment", F.col("s_nationkey").cast("string"), by_segment),
    ]
    return matching.resolve_by_tiers(s, tiers).select("s_suppkey", "resolved", "method")


def equal_lineups(spark: SparkSession, d: str) -> DataFrame:
    """Orders with the same ordered list of suppliers as an earlier order, and the earliest such."""
    lineup = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"])
    orders = table(spark, d, "lineitem").groupBy("l_orderkey").agg(lineup.alias("lineup"))
    first = orders.groupBy("lineup").agg(F.min("l_orderkey").alias("first_order"))
    return orders.join(first, "lineup").where("l_orderkey > first_order").select("l_orderkey", "first_order")


def head_to_head(spark: SparkSession, d: str, a: int = 1, b: int = 2) -> DataFrame:
    """Wins, losses and ties of two users over the days and event types that both have; their least values count."""
    e = table(spark, d, "events").where(F.col("user_id").isin(a, b))
    best = e.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.min(F.when(F.col("user_id") == a, F.col("value"))).alias("x"), F.min(F.when(F.col("user_id") == b, F.col("value"))).alias("y"))
    return best.where("x IS NOT NULL AND y IS NOT NULL").agg(F.count_if(F.col("x") < F.col("y")).alias("wins"), F.count_if(F.col("x") > F.col("y")).alias("losses"), F.count_if(F.col("x") == F.col("y")).alias("ties"))


def nested_lines(spark: SparkSession, d: str) -> DataFrame:
    """Each order with its lines in order, as text."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string")))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(parts, " ").alias("lines"))
    return table(spark, d, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("lines", F.lit("")).alias("lines"))


def reconciled_orders(spark: SparkSession, d: str) -> DataFrame:
    """Finished orders matched with open ones of the same customer, one to one: the nearer in days, within 90, the better; 10 more for the same priority."""
    o = _days(spark, d)
    side = lambda status, p: o.where(F.col("o_orderstatus") == status).select("o_custkey", F.col("o_orderkey").alias(f"{p}_order"), F.col("day").alias(f"{p}_day"), F.col("o_orderpriority").alias(f"{p}_priority"))
    score = F.greatest(F.lit(0), 91 - F.abs(F.datediff("f_day", "o_day"))) + F.when((F.abs(F.datediff("f_day", "o_day")) <= 90) & (F.col("f_priority") == F.col("o_priority")), 10).otherwise(0)
    return matching.reconcile(side("F", "f"), side("O", "o"), ["o_custkey"], score, "f_order", "o_order", ("f_day", "o_day", 90))


def order_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Every finished and every open order with its outcome in that matching: matched, missing (finished only), extra (open only)."""
    o, pairs = _days(spark, d), reconciled_orders(spark, d)
    one = lambda status, name: o.where(F.col("o_orderstatus") == status).select(F.col("o_orderkey").alias(name))
    both = one("F", "f_order").join(pairs, "f_order", "left").join(one("O", "o_order"), "o_order", "full")
    outcome = F.when(F.col("o_order").isNull(), "missing").when(F.col("f_order").isNull(), "extra").otherwise("matched")
    return both.select("f_order", "o_order", "score", outcome.alias("outcome"))


def all_nations(spark: SparkSession, d: str) -> DataFrame:
    """Nations of customers or suppliers, each once."""
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


def status_changes(spark: SparkSession, d: str) -> DataFrame:
    """Customers' last orders of up to 1997 against those of later years: added, removed, updated, unchanged, with the fields."""
    o = _days(spark, d)
    last = lambda rows: intervals.latest(rows, ["o_custkey"], [F.desc("day"), F.desc("o_orderkey")]).select("o_custkey", "o_orderstatus", "o_orderpriority")
    return upsert.change_set(last(o.where("day < '1998-01-01'")), last(o.where("day >= '1998-01-01'")), "o_custkey", ["o_orderstatus", "o_orderpriority"])


def merged_status(spark: SparkSession, d: str) -> DataFrame:
    """The same two states, merged: a newer value wins unless it is null (status P counts as null here)."""
    o = _days(spark, d).withColumn("status", F.nullif("o_orderstatus", F.lit("P")))
    last = lambda rows: intervals.latest(rows, ["o_custkey"], [F.desc("day"), F.desc("o_orderkey")]).select("o_custkey", "status", "o_orderkey")
    return upsert.upsert(last(o.where("day < '1998-01-01'")), last(o.where("day >= '1998-01-01'")), ["o_custkey"])


def common_days(spark: SparkSession, d: str) -> DataFrame:
    """Days on which both urgent and low orders were placed."""
    o = _days(spark, d)
    return o.where("o_orderpriority = '1-URGENT'").select("day").intersect(o.where("o_orderpriority = '5-LOW'").select("day"))


def moved_lines(spark: SparkSession, d: str) -> DataFrame:
    """Returned lines to be moved, or deleted where an accepted line has their order and part."""
    rows = table(spark, d, "lineitem")
    out = upsert.move_or_delete(rows.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey"), rows.where("l_returnflag = 'A'"), ["l_orderkey", "l_partkey"])
    return out.groupBy("l_orderkey", "action").agg(F.count(F.lit(1)).alias("n"))


def match_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Lines returned, as observations, against the lines accepted, as facts: actor is the part, event the supplier, mark the quantity, place the line number."""
    rows = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("actor"), F.col("l_suppkey").alias("event"), F.col("l_quantity").alias("mark"), F.when(F.col("l_tax") > 0.02, F.col("l_linenumber")).alias("place"), F.when(F.col("l_discount") > 0, F.col("l_orderkey")).alias("meet"), F.to_date("l_shipdate").alias("day"), "l_returnflag"
    )
    marked = rows.where("l_returnflag = 'R'").withColumn("obs", F.xxhash64("actor", "event", "mark", "place", "meet", "day")).dropDuplicates(["obs"])
    return decisions.decide(marked, rows.where("l_returnflag <> 'R'"), "obs", 365).groupBy("decision", "reason").agg(F.count(F.lit(1)).alias("n"))


def integrity(spark: SparkSession, d: str) -> DataFrame:
    """Violation counts against what is tolerated."""
    o, lines, c = _days(spark, d), table(spark, d, "lineitem"), table(spark, d, "customer")
    n = F.count(F.lit(1)).alias("n")
    periods = o.withColumn("until", F.date_add("day", 3)).withColumn("before", F.max("until").over(Window.partitionBy("o_custkey").orderBy("day", "o_orderkey").rowsBetween(Window.unboundedPreceding, -1)))
    found = [
        ("two_states_a_day", 10, o.groupBy("o_custkey", "day").agg(F.countDistinct("o_orderstatus").alias("k")).where("k > 1").agg(n)),
        ("repeated_lines", 0, dedup.extra_rows(lines, ["l_orderkey", "l_linenumber"]).select(F.col("n_extra").alias("n"))),
        ("same_line_other_part", 0, lines.groupBy("l_orderkey", "l_linenumber").agg(F.countDistinct("l_partkey").alias("k")).where("k > 1").agg(n)),
        ("order_key_not_unique", 0, dedup.duplicate_groups(o, ["o_orderkey"]).agg(n)),
        ("overlapping_periods", 100, periods.where("day < before").agg(n)),
        ("lines_without_order", 0, lines.join(o, lines.l_orderkey == o.o_orderkey, "left_anti").agg(n)),
        ("orders_without_customer", 0, o.join(c, o.o_custkey == c.c_custkey, "left_anti").agg(n)),
        ("prices_not_positive", 0, o.where("o_totalprice <= 0").agg(n)),
        ("shipped_before_order", 0, lines.join(o, lines.l_orderkey == o.o_orderkey).where("to_date(l_shipdate) < day").agg(n)),
    ]
    out = None
    for name, tolerate, count in found:
        row = count.select(F.lit(name).alias("name"), "n", F.lit(tolerate).alias("tolerate"), (F.col("n") <= tolerate).alias("ok"))
        out = row if out is None else out.unionByName(row)
    return out


def live_state(spark: SparkSession, d: str) -> DataFrame:
    """The events table replayed as a stream of upserts: the last row of each user; a purchase is final and stays, whatever comes later but another purchase."""
    return live.replay(spark, f"{d}/events.parquet", ["user_id"], F.col("event_type") == "purchase", "ts", "event_id").select("user_id", "event_type", "event_id", "value")


QUERIES = {
    "J1_region_totals": region_totals,
    "J2_J3_J5_nation_summary": nation_summary,
    "J6_urgent_customers": urgent_customers,
    "J7_idle_customers": idle_customers,
    "J8_null_safe_groups": null_safe_groups,
    "J9_overlap_pairs": overlap_pairs,
    "G1_overlap_components": overlap_components,
    "M15_J11_copied_orders": copied_orders,
    "J14_current_status": current_status,
    "J15_overlapping_orders": overlapping_orders,
    "J16_latest_orders": latest_orders,
    "J17_unique_claims": unique_claims,
    "J20_word_pairs": token_matches,
    "J20_T10_closest_names": closest_names,
    "J21_sole_claims": sole_claims,
    "J24_resolved_suppliers": resolved_suppliers,
    "J33_equal_lineups": equal_lineups,
    "J37_users_compared": head_to_head,
    "J38_nested_lines": nested_lines,
    "J39_reconciled_orders": reconciled_orders,
    "J39_order_outcomes": order_outcomes,
    "U2_all_nations": all_nations,
    "U4_status_changes": status_changes,
    "S15_merged_status": merged_status,
    "U5_common_days": common_days,
    "U7_moved_lines": moved_lines,
    "M3_match_decisions": match_decisions,
    "Q_integrity": integrity,
    "R2_R3_live_state": live_state,
}

_LAST = "SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderdate::DATE {} DATE '1998-01-01') WHERE rn = 1"
_PAIRS = """f AS (SELECT DISTINCT o_custkey, o_orderdate::DATE AS day, o_orderpriority AS p, o_orderstatus AS s FROM orders),
        pairs AS (SELECT x.o_custkey AS a, y.o_custkey AS b, count(*) AS n_shared FROM f x JOIN f y ON x.day = y.day AND x.p = y.p AND x.s = y.s AND x.o_custkey < y.o_custkey GROUP BY ALL HAVING count(*) >= 2)"""
_NAMES = """w AS (SELECT DISTINCT p_name AS name, unnest(string_split(p_name, ' ')) AS word FROM part),
        p AS (SELECT DISTINCT x.name AS a, y.name AS b FROM w x JOIN w y ON x.word = y.word AND x.name < y.name),
        m AS (SELECT a, b, round(len(list_intersect(string_split(a, ' '), string_split(b, ' '))) / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' '))))::DOUBLE, 6) AS overlap,
                     round(1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE, 6) AS similarity FROM p)"""

ORACLE_SQL = {
    "J1_region_totals": """
        SELECT r_name, count(*) AS n_orders, count(DISTINCT c_custkey) AS n_customers FROM orders JOIN customer ON o_custkey = c_custkey
        LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
    "J2_J3_J5_nation_summary": """
        SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n_customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n_suppliers FROM nation""",
    "J6_urgent_customers": "SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')",
    "J7_idle_customers": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "J8_null_safe_groups": """
        WITH r AS (SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) AS discount, l_partkey FROM lineitem)
        SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, discount) AS n FROM r) WHERE n > 1""",
    "J9_overlap_pairs": f"WITH {_PAIRS} SELECT * FROM pairs",
    "G1_overlap_components": f"""
        WITH RECURSIVE {_PAIRS}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
        r(node, root) AS (SELECT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
        SELECT node, min(root) AS root FROM r GROUP BY node""",
    "M15_J11_copied_orders": """
        WITH k AS (SELECT l_partkey, l_suppkey, count(DISTINCT l_orderkey) AS c FROM lineitem GROUP BY ALL)
        SELECT l_orderkey, count(*) AS n_rows FROM lineitem JOIN k USING (l_partkey, l_suppkey) GROUP BY l_orderkey HAVING min(c) > 1""",
    "J14_current_status": """
        WITH p AS (SELECT o_orderstatus, o_orderdate::DATE AS day, lead(o_orderdate::DATE) OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderkey) AS until FROM orders)
        SELECT o_orderstatus, count(*) AS n, count(*) FILTER (until IS NULL) AS n_open FROM p WHERE day <= DATE '1998-07-01' AND (until IS NULL OR DATE '1998-07-01' < until) GROUP BY 1""",
    "J15_overlapping_orders": """
        SELECT f.o_custkey, f.o_orderkey AS f_order, o.o_orderkey AS o_order FROM orders f JOIN orders o ON f.o_custkey = o.o_custkey AND f.o_orderstatus = 'F' AND o.o_orderstatus = 'O'
        WHERE abs(date_diff('day', f.o_orderdate::DATE, o.o_orderdate::DATE)) <= 13""",
    "J16_latest_orders": """
        SELECT o_custkey, o_orderkey, o_orderdate::DATE AS day, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE DESC NULLS LAST, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""",
    "J17_unique_claims": """
        SELECT p.o_orderkey AS claim, min(f.o_orderkey) AS found FROM orders p JOIN orders f ON p.o_custkey = f.o_custkey AND p.o_orderstatus = 'P' AND f.o_orderstatus = 'F'
        AND abs(date_diff('day', p.o_orderdate::DATE, f.o_orderdate::DATE)) <= 60 GROUP BY 1 HAVING count(*) = 1""",
    "J20_word_pairs": f"WITH {_NAMES} SELECT * FROM m",
    "J20_T10_closest_names": f"""
        WITH {_NAMES}, e AS (SELECT a AS name, b AS other, similarity AS score FROM m UNION ALL SELECT b, a, similarity FROM m)
        SELECT name, min(other) AS other, score FROM e WHERE score >= 0.6 AND score = (SELECT max(x.score) FROM e x WHERE x.name = e.name) GROUP BY name, score HAVING count(*) = 1""",
    "J21_sole_claims": "SELECT l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) = 1",
    "J24_resolved_suppliers": """
        WITH k AS (
          SELECT 'balance' AS m, 1 AS t, c_nationkey || '|' || round(c_acctbal * 100)::BIGINT AS key, c_custkey FROM customer
          UNION ALL SELECT 'number', 2, split_part(c_name, '#', 2), c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY'
          UNION ALL SELECT 'segment', 3, c_nationkey::VARCHAR, c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'),
        u AS (SELECT m, t, key, min(c_custkey) AS c FROM k GROUP BY ALL HAVING count(DISTINCT c_custkey) = 1),
        s AS (SELECT s_suppkey, unnest([1, 2, 3]) AS t, unnest([s_nationkey || '|' || round(s_acctbal * 100)::BIGINT, split_part(s_name, '#', 2), s_nationkey::VARCHAR]) AS key FROM supplier)
        SELECT s_suppkey, arg_min(c, t) AS resolved, arg_min(m, t) AS method FROM s LEFT JOIN u USING (t, key) GROUP BY s_suppkey""",
    "J33_equal_lineups": """
        WITH l AS (SELECT l_orderkey, list(l_suppkey ORDER BY l_linenumber, l_suppkey) AS lineup FROM lineitem GROUP BY 1)
        SELECT * FROM (SELECT l_orderkey, min(l_orderkey) OVER (PARTITION BY lineup) AS first_order FROM l) WHERE l_orderkey > first_order""",
    "J37_users_compared": """
        WITH b AS (SELECT ts::DATE AS day, event_type, min(value) FILTER (user_id = 1) AS x, min(value) FILTER (user_id = 2) AS y FROM events GROUP BY 1, 2)
        SELECT count(*) FILTER (x < y) AS wins, count(*) FILTER (x > y) AS losses, count(*) FILTER (x = y) AS ties FROM b""",
    "J38_nested_lines": """
        SELECT o_orderkey, coalesce(string_agg(l_linenumber || ':' || l_partkey, ' ' ORDER BY l_linenumber, l_partkey), '') AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
    "U2_all_nations": "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier",
    "U4_status_changes": f"""
        WITH a AS ({_LAST.format("<")}), b AS ({_LAST.format(">=")}),
        j AS (SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, a.o_custkey AS x, b.o_custkey AS y, a.o_orderstatus <> b.o_orderstatus AS s, a.o_orderpriority <> b.o_orderpriority AS p
              FROM a FULL JOIN b ON a.o_custkey = b.o_custkey)
        SELECT o_custkey, CASE WHEN x IS NULL THEN 'added' WHEN y IS NULL THEN 'removed' WHEN s OR p THEN 'updated' ELSE 'unchanged' END AS change,
               CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN concat_ws(',', CASE WHEN s THEN 'o_orderstatus' END, CASE WHEN p THEN 'o_orderpriority' END) END AS changed FROM j""",
    "S15_merged_status": f"""
        WITH a AS ({_LAST.format("<")}), b AS ({_LAST.format(">=")})
        SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(nullif(b.o_orderstatus, 'P'), nullif(a.o_orderstatus, 'P')) AS status, coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey
        FROM a FULL JOIN b ON a.o_custkey = b.o_custkey""",
    "U5_common_days": "SELECT o_orderdate::DATE AS day FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT o_orderdate::DATE FROM orders WHERE o_orderpriority = '5-LOW'",
    "U7_moved_lines": """
        SELECT l_orderkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem a WHERE a.l_returnflag = 'A' AND a.l_orderkey = r.l_orderkey AND a.l_partkey = r.l_partkey) THEN 'delete' ELSE 'move' END AS action, count(*) AS n
        FROM lineitem r WHERE l_returnflag = 'R' GROUP BY 1, 2""",
    "Q_integrity": """
        WITH o AS (SELECT *, o_orderdate::DATE AS day FROM orders),
        p AS (SELECT day, max(day + 3) OVER (PARTITION BY o_custkey ORDER BY day, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o),
        c(name, n, tolerate) AS (
          SELECT 'two_states_a_day', (SELECT count(*) FROM (SELECT 1 FROM o GROUP BY o_custkey, day HAVING count(DISTINCT o_orderstatus) > 1)), 10
          UNION ALL SELECT 'repeated_lines', (SELECT coalesce(sum(k - 1), 0)::BIGINT FROM (SELECT count(*) AS k FROM lineitem GROUP BY l_orderkey, l_linenumber)), 0
          UNION ALL SELECT 'same_line_other_part', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(DISTINCT l_partkey) > 1)), 0
          UNION ALL SELECT 'order_key_not_unique', (SELECT count(*) FROM (SELECT 1 FROM o GROUP BY o_orderkey HAVING count(*) > 1)), 0
          UNION ALL SELECT 'overlapping_periods', (SELECT count(*) FROM p WHERE day < before), 100
          UNION ALL SELECT 'lines_without_order', (SELECT count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)), 0
          UNION ALL SELECT 'orders_without_customer', (SELECT count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)), 0
          UNION ALL SELECT 'prices_not_positive', (SELECT count(*) FROM o WHERE o_totalprice <= 0), 0
          UNION ALL SELECT 'shipped_before_order', (SELECT count(*) FROM lineitem JOIN o ON o_orderkey = l_orderkey WHERE l_shipdate::DATE < day), 0)
        SELECT name, n, tolerate, n <= tolerate AS ok FROM c""",
    "R2_R3_live_state": """
        SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'purchase' DESC, ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
    "M3_match_decisions": """
        WITH r AS (SELECT l_partkey AS actor, l_suppkey AS event, l_quantity AS mark, CASE WHEN l_tax > 0.02 THEN l_linenumber END AS place, CASE WHEN l_discount > 0 THEN l_orderkey END AS meet, l_shipdate::DATE AS day, l_returnflag AS f FROM lineitem),
        o AS (SELECT *, row_number() OVER () AS obs FROM (SELECT DISTINCT actor, event, mark, place, meet, day FROM r WHERE f = 'R')),
        k AS (SELECT o.obs, count(*) FILTER (c.meet = o.meet AND (c.place IS NULL OR o.place IS NULL OR c.place = o.place)) AS same,
                     count(*) FILTER (c.meet = o.meet AND c.place <> o.place) AS clash,
                     count(*) FILTER (c.actor IS NOT NULL AND c.meet IS NULL AND abs(date_diff('day', c.day, o.day)) <= 365) AS history
              FROM o LEFT JOIN (SELECT * FROM r WHERE f <> 'R') c ON c.actor = o.actor AND c.event = o.event AND c.mark = o.mark GROUP BY o.obs),
        d AS (SELECT CASE WHEN meet IS NULL OR mark IS NULL THEN 'incomplete' WHEN same > 0 THEN 'same performance' WHEN clash > 0 THEN 'place differs' WHEN history = 1 THEN 'one history row' WHEN history > 1 THEN 'several history rows' ELSE 'new' END AS reason
              FROM o JOIN k USING (obs))
        SELECT CASE reason WHEN 'same performance' THEN 'skip_duplicate' WHEN 'one history row' THEN 'claim' WHEN 'new' THEN 'insert' ELSE 'quarantine' END AS decision, reason, count(*) AS n FROM d GROUP BY 1, 2""",
}
