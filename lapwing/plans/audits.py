"""Joins for evidence, integrity checks, sinks, queues and plans over result entries and the star schema, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.functions import marks, records
from lapwing.sources.entries import ENTRIES, entries
from lapwing.sources.tables import table

C = F.col
DIGITS = r"[0-9]"


def _n(name: str = "n"):
    return F.count(F.lit(1)).alias(name)


# ---- joins
def against_totals(spark: SparkSession, d: str) -> DataFrame:
    """Customers against one row of totals."""
    o = table(spark, d, "orders")
    totals = o.agg(F.count(F.lit(1)).alias("all_orders"), F.max(F.to_date("o_orderdate")).alias("newest"))
    return o.groupBy("o_custkey").agg(_n(), F.max(F.to_date("o_orderdate")).alias("last_day")).crossJoin(F.broadcast(totals)).select("o_custkey", "n", "all_orders", F.datediff("newest", "last_day").alias("days_behind"))  # one row


def two_meets_a_day(spark: SparkSession, d: str) -> DataFrame:
    """Athletes who were at different meets on one day: a contradiction, by the least and the greatest meet."""
    e = entries(spark, d).select("athlete", F.trunc("day", "month").alias("day"), records.meet_key(C("meet")).alias("m")).where("m <> ''")
    return e.groupBy("athlete", "day").agg(F.min("m").alias("one"), F.max("m").alias("other"), F.countDistinct("m").alias("n")).where("n > 1")


def event_properties(spark: SparkSession, d: str) -> DataFrame:
    """Each name and value in the JSON of the events."""
    e = table(spark, d, "events").select("event_type", F.from_json("props", "map<string,string>").alias("p"))
    return e.select("event_type", F.explode("p").alias("name", "value")).groupBy("event_type", "name").agg(_n(), F.countDistinct("value").alias("n_values"))


def customer_evidence(spark: SparkSession, d: str) -> DataFrame:
    """What speaks for each customer: flags joined from distinct keys, and their combinations."""
    o = table(spark, d, "orders")
    flags = o.groupBy("o_custkey").agg(F.bool_or(C("o_orderstatus") == "F").alias("finished"), F.bool_or(C("o_totalprice") > 200000).alias("large"), F.bool_or(C("o_orderpriority").startswith("1")).alias("urgent"))
    c = table(spark, d, "customer").join(flags, C("c_custkey") == C("o_custkey"), "left")
    no = F.lit(False)
    return c.select("c_custkey", (C("c_acctbal") < 0).alias("in_debt"), *[F.coalesce(x, no).alias(x) for x in ("finished", "large", "urgent")])


def evidence_profile(spark: SparkSession, d: str) -> DataFrame:
    return customer_evidence(spark, d).groupBy("in_debt", "finished", "large", "urgent").agg(_n())


def schools_by_state(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as schools: a name without its number and its nation as state; entries' teams by name, and by name and state where a name isn't unique."""
    s = table(spark, d, "supplier").select(F.concat(F.lit("state "), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("college")), (C("s_suppkey") % 3 + 1).cast("int"))).alias("k"), "s_suppkey", (C("s_nationkey") % 5).alias("state"))
    unique = s.groupBy("k").agg(F.countDistinct("s_suppkey").alias("c"), F.min("s_suppkey").alias("by_name")).where("c = 1").select("k", "by_name")
    stated = s.groupBy("k", "state").agg(F.countDistinct("s_suppkey").alias("c"), F.min("s_suppkey").alias("by_state")).where("c = 1").select("k", "state", "by_state")
    e = entries(spark, d).select("id", records.team_name(C("team")).alias("k"), (C("athlete") % 5).alias("state"))
    met = e.join(unique, "k", "left").join(stated, ["k", "state"], "left")
    return met.where("k <> ''").select("id", F.coalesce("by_name", "by_state").alias("school"), F.when(C("by_name").isNotNull(), "name").when(C("by_state").isNotNull(), "name and state").otherwise("none").alias("how"))


def same_name_and_day(spark: SparkSession, d: str) -> DataFrame:
    """Entries linked to the one order-day group that has their meet and day exactly."""
    e = entries(spark, d).where("meet IS NOT NULL")
    groups = e.groupBy("meet", "day").agg(F.min("id").alias("meet_id"), _n("size"))
    return e.select("id", "meet", "day").join(groups, ["meet", "day"]).select("id", "meet_id", "size")


def tuples_in(spark: SparkSession, d: str) -> DataFrame:
    """Lines whose (part, supplier) is that of some returned line, and whose order is among the urgent ones."""
    l = table(spark, d, "lineitem")
    returned = l.where("l_returnflag = 'R'").select("l_partkey", "l_suppkey").distinct()
    urgent = table(spark, d, "orders").where("o_orderpriority LIKE '1%'").select(C("o_orderkey").alias("l_orderkey"))
    return l.join(returned, ["l_partkey", "l_suppkey"], "left_semi").join(urgent, "l_orderkey", "left_semi").groupBy("l_linestatus").agg(_n())


def members_of_groups(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers that are members of the group of some nation of two: membership by exploded lists."""
    g = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_set("s_suppkey")).alias("ids"))
    flat = g.select("s_nationkey", F.size("ids").alias("size"), F.explode("ids").alias("s_suppkey"))
    return table(spark, d, "lineitem").groupBy(C("l_suppkey").alias("s_suppkey")).agg(_n()).join(flat, "s_suppkey").groupBy("s_nationkey", "size").agg(F.sum("n").alias("n_lines"))


def pairs_of_two(spark: SparkSession, d: str) -> DataFrame:
    """Orders with exactly two suppliers: how often each pair of suppliers meets, and how many parts."""
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("ids"), F.countDistinct("l_partkey").alias("parts")).where("size(ids) = 2")
    return g.groupBy(C("ids")[0].alias("one"), C("ids")[1].alias("two")).agg(_n(), F.sum("parts").alias("n_parts"))


def window_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Entries without a link against meets of one key within 7 days: one candidate only, else the one at the same place, else none."""
    e = entries(spark, d)
    meets = e.where("location IS NOT NULL AND meet IS NOT NULL").groupBy(records.meet_key(C("meet")).alias("k"), "day").agg(F.min("id").alias("meet_id"), F.min("location").alias("spot"))
    asks = e.where("place IS NULL AND meet IS NOT NULL").select("id", records.meet_key(C("meet")).alias("k"), C("day").alias("on"), "location", F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("w"))
    block = lambda c: F.floor(F.datediff(c, F.lit("1990-01-01").cast("date")) / 8)
    met = asks.withColumn("b", block(C("on")) + C("w")).join(meets.withColumn("b", block(C("day"))), ["k", "b"]).where(F.abs(F.datediff("day", "on")) <= 7)
    g = met.groupBy("id").agg(_n(), F.min("meet_id").alias("only"), F.count_if(C("spot") == C("location")).alias("here"), F.min(F.when(C("spot") == C("location"), C("meet_id"))).alias("at_place"))
    return g.select("id", F.when(C("n") == 1, C("only")).when(C("here") == 1, C("at_place")).alias("meet_id"), F.when(C("n") == 1, "only").when(C("here") == 1, "place").otherwise("ambiguous").alias("how"))


def chosen_athletes(spark: SparkSession, d: str) -> DataFrame:
    """Name keys to one athlete: the one of the same team, else the only one, else none; with the reason."""
    e = entries(spark, d).select("id", "athlete", "place", marks.name_key(C("name")).alias("k"), records.team_name(C("team")).alias("t")).where("k <> ''")
    known = e.where("place IS NOT NULL")
    same = known.groupBy("k", "t").agg(F.countDistinct("athlete").alias("c"), F.min("athlete").alias("a")).where("c = 1").select("k", "t", C("a").alias("same_team"))
    only = known.groupBy("k").agg(F.countDistinct("athlete").alias("c"), F.min("athlete").alias("a")).where("c = 1").select("k", C("a").alias("only"))
    met = e.where("place IS NULL").join(same, ["k", "t"], "left").join(only, "k", "left")
    return met.select("id", F.coalesce("same_team", "only").alias("athlete"), F.when(C("same_team").isNotNull(), "team").when(C("only").isNotNull(), "only").otherwise("none").alias("how"))


# ---- aggregates
def unlinked_counts(spark: SparkSession, d: str) -> DataFrame:
    """One row of counts across tables: unresolved entries, entries of no event, and what they come to together."""
    e = entries(spark, d)
    one = e.agg(F.count_if(C("event") == "").alias("n_events"), F.count_if(C("name").isNull()).alias("n_names"), F.bool_or(C("mark").isNull()).alias("any_unmarked"))
    two = table(spark, d, "lineitem").agg(F.count_if(C("l_discount") == 0).alias("n_full"))
    return one.crossJoin(F.broadcast(two)).select("n_events", "n_names", "n_full", (C("n_events") + C("n_names") + C("n_full")).alias("total"), F.coalesce("any_unmarked", F.lit(False)).alias("any_unmarked"))  # one row


def usage(spark: SparkSession, d: str) -> DataFrame:
    """How often each nation is used: by customers, suppliers and their orders."""
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(_n("n_customers"))
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(_n("n_suppliers"))
    out = table(spark, d, "nation").join(c, C("n_nationkey") == C("c_nationkey"), "left").join(s, C("n_nationkey") == C("s_nationkey"), "left")
    return out.select("n_nationkey", F.coalesce("n_customers", F.lit(0)).alias("n_customers"), F.coalesce("n_suppliers", F.lit(0)).alias("n_suppliers"))


def collisions(spark: SparkSession, d: str) -> DataFrame:
    """Addresses that several athletes share: how many, of what shape, whether a known athlete is among them."""
    shape = F.when(C("url").rlike("/athletes?/[0-9]+"), "profile").when(C("url").rlike("(?i)(mens|womens)-"), "event").otherwise("other")
    g = entries(spark, d).where("url IS NOT NULL").groupBy("url", shape.alias("shape")).agg(F.countDistinct("athlete").alias("n_athletes"), F.bool_or(C("athlete") == 42).alias("known"), F.countDistinct("team").alias("n_teams"))
    bucket = F.when(C("n_teams") <= 1, "one team").when(C("known"), "known athlete").otherwise("mixed")
    return g.where("n_athletes > 1").select("url", "shape", "n_athletes", "n_teams", "known", bucket.alias("bucket"))


def coverage(spark: SparkSession, d: str) -> DataFrame:
    """Of each event spelling: occurrences, and whether the catalogue resolves it."""
    known = C("event").isin("60 Meters", "200 Meters", "800 Meters", "Mile", "High Jump", "Long Jump", "Shot Put")
    return entries(spark, d).groupBy(known.alias("matched")).agg(F.countDistinct("event").alias("n_spellings"), _n("occurrences"))


def unlinked_projections(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of entries with a place that no entry without one has."""
    fp = F.concat_ws("|", C("athlete").cast("string"), C("event"), F.coalesce(marks.mark_key(C("mark")), F.lit("null")))
    e = entries(spark, d).select(fp.alias("fp"), "place", "id")
    linked = e.where("place IS NULL").select("fp").distinct()
    return e.where("place IS NOT NULL").join(linked, "fp", "left_anti").groupBy("fp").agg(F.min("id").alias("id"), _n())


# ---- integrity
def entry_checks(spark: SparkSession, d: str) -> DataFrame:
    """Checks on entries in one pass over the rows: name and count of each."""
    seconds, meters = marks.mark_seconds(C("mark")), marks.mark_meters(C("mark"))
    e = entries(spark, d).withColumn("s", seconds).withColumn("m", meters)
    rules = {
        "Q2_unresolved_event": C("event") == "",
        "Q5_doubled_code": records.doubled_code(C("mark")).isNotNull(),
        "Q9_mark_without_number": C("mark").rlike(r"^\d+[.:]\d") & C("s").isNull() & C("m").isNull(),
        "Q10_not_positive": C("s") <= 0,
        "Q10_truncated": C("mark").rlike(r"^\d+:\d{2}:\d") & (C("s") < 3600),
        "Q18_undecided": C("place").isNull() & C("mark").isNotNull(),
    }
    one = e.agg(*[F.count_if(F.coalesce(r, F.lit(False))).alias(k) for k, r in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), C(k).alias("n")) for k in rules])).alias("x")).select("x.name", "x.n")


def pair_checks(spark: SparkSession, d: str) -> DataFrame:
    """Q7: marks of one athlete and event that differ in a source's suffix only. Q17: one source id of several athletes. Q12: keys that repeat."""
    e = entries(spark, d)
    plain = F.lower(F.regexp_replace("mark", "[ah]$", ""))
    g = e.where(C("mark").rlike(DIGITS)).groupBy("athlete", "event", plain.alias("k")).agg(_n("c"), F.count_if(C("mark").rlike("[ah]$")).alias("s"), F.count_if(~C("mark").rlike("[ah]$")).alias("p"))
    q7 = g.agg(F.count_if((C("c") > 1) & (C("s") > 0) & (C("p") > 0)).alias("n")).select(F.lit("Q7_suffixed_and_plain").alias("name"), "n")
    ids = e.select(F.regexp_extract("url", "/athletes?/([0-9]+)", 1).alias("k"), "athlete").where("k <> ''").groupBy("k").agg(F.countDistinct("athlete").alias("c"))
    q17 = ids.agg(F.count_if(C("c") > 1).alias("n")).select(F.lit("Q17_shared_source_id").alias("name"), "n")
    key = e.groupBy("athlete", "event", marks.mark_key(C("mark")), "round").agg(_n("c"))
    q12 = key.agg(F.coalesce(F.sum(F.when(C("c") > 1, C("c") - 1)), F.lit(0)).alias("n")).select(F.lit("Q12_repeated_key").alias("name"), "n")
    return q7.unionByName(q17).unionByName(q12)


def relay_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Orders as relays, lines as legs: relays of one customer and priority with the same lineup in order (all legs known), beyond the first."""
    legs = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.struct("l_linenumber", C("l_suppkey").cast("string").alias("who")))).alias("legs"))
    key = F.array_join(F.transform("legs", lambda x: x["who"]), "|")
    o = table(spark, d, "orders").join(legs, C("o_orderkey") == C("l_orderkey"))
    return o.groupBy(key.alias("lineup"), F.size("legs").alias("n_legs")).agg(_n("n_relays"), F.countDistinct("o_custkey").alias("n_customers"))


def late_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines shipped over 7 days from their order, by how far."""
    days = F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))
    return table(spark, d, "lineitem").join(table(spark, d, "orders"), C("l_orderkey") == C("o_orderkey")).where(F.abs(days) > 7).groupBy(F.floor(F.abs(days) / 30).alias("months")).agg(_n())


FOREIGN_KEYS = [("nation", ["n_regionkey"], "region", ["r_regionkey"]), ("customer", ["c_nationkey"], "nation", ["n_nationkey"]), ("supplier", ["s_nationkey"], "nation", ["n_nationkey"]), ("orders", ["o_custkey"], "customer", ["c_custkey"]), ("lineitem", ["l_orderkey"], "orders", ["o_orderkey"]), ("lineitem", ["l_partkey"], "part", ["p_partkey"]), ("lineitem", ["l_suppkey"], "supplier", ["s_suppkey"]), ("events", ["user_id"], "customer", ["c_custkey"])]


def key_profile(spark: SparkSession, d: str) -> DataFrame:
    """Each declared foreign key: rows without a partner, and rows with a null in the key."""
    out = None
    for child, keys, parent, targets in FOREIGN_KEYS:
        rows = table(spark, d, child).select(*keys)
        there = table(spark, d, parent).select(*[C(t).alias(k) for k, t in zip(keys, targets)]).distinct().withColumn("hit", F.lit(True))
        null = F.lit(False)
        for k in keys:
            null = null | C(k).isNull()
        one = rows.join(there, keys, "left").agg(F.count_if(~null & C("hit").isNull()).alias("n_orphans"), F.count_if(null).alias("n_null")).select(F.lit(f"{child}.{','.join(keys)}").alias("key"), "n_orphans", "n_null")
        out = one if out is None else out.unionByName(one)
    return out


# ---- sinks, queues and plans, as the rows they would write
def restage(spark: SparkSession, d: str) -> DataFrame:
    """A second delivery against the first: accepted again if nothing differs (null-safe), else a conflict; new keys are inserted. Only new content gets a version."""
    first = entries(spark, d).where("place IS NOT NULL").select("id", "mark", "name", "team", "place")
    again = entries(spark, d).select("id", F.when(C("id") % 10 == 1, F.lit("10.99")).otherwise(C("mark")).alias("mark2"), C("name").alias("name2"), C("team").alias("team2"), C("place").alias("place2"))
    same = C("mark").eqNullSafe(C("mark2")) & C("name").eqNullSafe(C("name2")) & C("team").eqNullSafe(C("team2")) & C("place").eqNullSafe(C("place2"))
    met = again.join(first.withColumn("known", F.lit(True)), "id", "left")
    return met.groupBy(F.when(C("known").isNull(), "inserted").when(same, "replayed").otherwise("conflict").alias("outcome")).agg(_n(), F.min("id").alias("first_id"))


def archive(spark: SparkSession, d: str) -> DataFrame:
    """What goes to the archive before deletion: whole rows of repeated lines but the first, with the survivor and the batch of each."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    first = l.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")).alias("f"), _n("c")).where("c > 1")
    rest = l.join(first, ["l_orderkey", "l_linenumber"]).where(F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity") != C("f"))
    return rest.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", C("f.l_partkey").alias("kept_part"), F.pmod("l_orderkey", F.lit(16)).alias("batch"))


def report(spark: SparkSession, d: str) -> DataFrame:
    """One JSON document of summary counts."""
    e = entries(spark, d).agg(_n("entries"), F.countDistinct("athlete").alias("athletes"), F.count_if(C("mark").isNull()).alias("unmarked"))
    return e.select(F.to_json(F.struct("athletes", "entries", "unmarked")).alias("report"))


def best_table(spark: SparkSession, d: str) -> DataFrame:
    """The materialised table of bests and which of its rows a refresh would write: rows that are missing or differ in the older state."""
    now = entries(spark, d).groupBy("athlete", "event").agg(F.min(F.struct("x", "id")).alias("b")).select("athlete", "event", C("b.x").alias("x"), C("b.id").alias("id"))
    old = entries(spark, d).where("day < DATE '2000-01-01'").groupBy("athlete", "event").agg(F.min("x").alias("old_x"))
    met = now.join(old, ["athlete", "event"], "left")
    return met.where(~C("x").eqNullSafe(C("old_x"))).select("athlete", "event", "x", "id", F.when(C("old_x").isNull(), "insert").otherwise("update").alias("action"))


def repairs(spark: SparkSession, d: str) -> DataFrame:
    """Differences between a source (finished orders) and the stored lines as repair actions: add, set a total, or review what the source lacks."""
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", F.round(C("o_totalprice") * 100).cast("long").alias("source"))
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.round(C("l_extendedprice") * 100).cast("long")).alias("stored"))
    met = o.join(l, C("o_orderkey") == C("l_orderkey"), "full_outer")
    action = F.when(C("l_orderkey").isNull(), "add").when(C("o_orderkey").isNull(), "review").when(C("source") != C("stored"), "set").otherwise("none")
    return met.groupBy(action.alias("action")).agg(_n(), F.min(F.coalesce("o_orderkey", "l_orderkey")).alias("first_key"))


def relay_queue(spark: SparkSession, d: str) -> DataFrame:
    """Meets with 4x100 entries as a queue: platform by the address, priority by what is missing, in the order in which jobs are taken."""
    e = entries(spark, d).where(records.is_four_by_100(C("event"))).where("meet IS NOT NULL")
    g = e.groupBy(records.meet_key(C("meet")).alias("meet_key"), "day").agg(_n("n_entries"), F.count_if(C("mark").isNull()).alias("n_missing"), F.min(records.timing_platform(C("url"))).alias("platform"))
    priority = F.when(C("n_missing") > 0, 1).when(C("platform") == "other", 3).otherwise(2)
    return g.select("meet_key", "day", "n_entries", "n_missing", "platform", priority.alias("priority")).orderBy("priority", "day", "meet_key")


def leases(spark: SparkSession, d: str) -> DataFrame:
    """Jobs after a step: leases that ran out go back, a finish counts only with the token that holds the lease, a failed try waits twice as long each time, at 5 tries it stops."""
    e = table(spark, d, "events").select(C("event_id").alias("job"), F.pmod("event_id", F.lit(6)).alias("attempts"), F.pmod("event_id", F.lit(4)).alias("state"), F.dayofmonth("ts").alias("until"), F.pmod("user_id", F.lit(3)).alias("token"), F.pmod("event_id", F.lit(3)).alias("shown"))
    leased, today = C("state") == 1, F.lit(15)
    status = (
        F.when(leased & (C("until") < today), F.when(C("attempts") >= 5, "failed").otherwise("ready"))
        .when(leased & (C("token") == C("shown")), "done")
        .when(leased, "leased")
        .when(C("state") == 2, F.when(C("attempts") >= 5, "failed").otherwise("waiting"))
        .otherwise("ready")
    )
    return e.select("job", status.alias("status"), F.when(status == "waiting", F.pow(F.lit(2.0), "attempts").cast("long")).alias("retry_after"))


def unprocessed(spark: SparkSession, d: str) -> DataFrame:
    """Events that no later event of their user and type follows on the same day: what a feed still has to process, in order of arrival."""
    e = table(spark, d, "events")
    last = e.groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(F.max(F.struct("ts", "event_id")).alias("m"))
    return last.select(C("m.event_id").alias("event_id"), "user_id", "event_type", "day").orderBy("event_id")


def split_plan(spark: SparkSession, d: str) -> DataFrame:
    """Customers whose orders fall into two statuses as identities to split: guards in order (too few, no finished, too many), else the rows to move."""
    g = table(spark, d, "orders").groupBy("o_custkey").agg(_n(), F.count_if(C("o_orderstatus") == "F").alias("n_move"), F.count_if(C("o_orderstatus") == "P").alias("n_open"))
    reason = F.when(C("n") < 3, "too_few").when(C("n_move") == 0, "nothing_to_move").when(C("n_move") == C("n"), "nothing_stays").when(C("n_open") > 0, "open_rows")
    return g.select("o_custkey", F.when(reason.isNull(), "ready").otherwise("held").alias("state"), reason.alias("reason"), F.when(reason.isNull(), C("n_move")).otherwise(F.lit(0)).alias("n_moved"))


def corrections(spark: SparkSession, d: str) -> DataFrame:
    """Corrected deliveries of entries: the fields that differ and may be set; held where the identity differs or nothing does."""
    e = entries(spark, d).select("id", "mark", "place", "team", "athlete")
    new = e.select("id", F.when(C("id") % 6 == 0, F.lit("9.99")).otherwise(C("mark")).alias("mark2"), F.when(C("id") % 10 == 0, F.lit(1)).otherwise(C("place")).alias("place2"), F.when(C("id") % 15 == 0, C("athlete") + 1).otherwise(C("athlete")).alias("athlete2"))
    met = e.join(new, "id")
    fields = F.array_join(F.array(F.when(~C("mark").eqNullSafe(C("mark2")), "mark"), F.when(~C("place").eqNullSafe(C("place2")), "place")), ",")
    state = F.when(C("athlete") != C("athlete2"), "held: identity").when(fields == "", "unchanged").otherwise("update")
    return met.groupBy(state.alias("state"), fields.alias("fields")).agg(_n(), F.min("id").alias("first_id"))


def backfill(spark: SparkSession, d: str) -> DataFrame:
    """Published bests against stored ones: insert, already there, a conflict, or no single target."""
    best = entries(spark, d).groupBy("athlete", "event").agg(F.min("x").alias("stored"), F.countDistinct("name").alias("n_names"))
    said = entries(spark, d).where("place = 1").groupBy("athlete", "event").agg(F.min("x").alias("said"))
    met = best.join(said, ["athlete", "event"], "full_outer")
    outcome = F.when(C("said").isNull(), "not_published").when(C("n_names") > 1, "ambiguous").when(C("stored") == C("said"), "already_present").otherwise("conflict")
    return met.groupBy(outcome.alias("outcome")).agg(_n())


def commit_run(spark: SparkSession, d: str) -> DataFrame:
    """A run of entries against those stored (place known), in sets: each is an insert, a link to the stored one, a duplicate within the run, or held."""
    e = entries(spark, d).where("event <> ''").select("id", "athlete", "event", "place", marks.mark_key(C("mark")).alias("k"), records.is_placeholder(C("name")).alias("nobody"))
    stored = e.where("place IS NOT NULL").groupBy("athlete", "event", "k").agg(F.min("id").alias("stored_id"))
    run = e.where("place IS NULL")
    first = run.groupBy("athlete", "event", "k").agg(F.min("id").alias("first_id"))
    met = run.join(stored, ["athlete", "event", "k"], "left").join(first, ["athlete", "event", "k"], "left")
    outcome = F.when(C("k").isNull(), "held: no mark").when(C("nobody"), "held: no name").when(C("stored_id").isNotNull(), "linked").when(C("id") != C("first_id"), "duplicate").otherwise("insert")
    return met.select("id", outcome.alias("outcome"), F.when(outcome == "linked", C("stored_id")).alias("linked_id"))


def resync(spark: SparkSession, d: str) -> DataFrame:
    """After a run: each meet's counts and state, and of its open quarantines the newest; older ones are superseded."""
    e = entries(spark, d).where("meet IS NOT NULL")
    g = e.groupBy(records.meet_key(C("meet")).alias("meet_key")).agg(_n(), F.count_if(C("mark").isNotNull()).alias("n_marked"), F.max(F.when(C("mark").isNull(), C("id"))).alias("open_id"), F.count_if(C("mark").isNull()).alias("n_open"))
    state = F.when(C("n_marked") == C("n"), "complete").when(C("n_marked") > 0, "partial").otherwise("missing")
    return g.select("meet_key", "n", "n_marked", state.alias("state"), "open_id", F.greatest(C("n_open") - 1, F.lit(0)).alias("n_superseded"))


QUERIES = {
    "J4_against_totals": against_totals, "J10_two_meets_a_day": two_meets_a_day, "J12_event_properties": event_properties, "J13_A10_customer_evidence": customer_evidence, "Q14d_evidence_profile": evidence_profile,
    "J30_schools_by_state": schools_by_state, "J32_same_name_and_day": same_name_and_day, "J34_tuples_in": tuples_in, "J35_members_of_groups": members_of_groups, "J36_pairs_of_two": pairs_of_two,
    "J42a_window_candidates": window_candidates, "J42b_chosen_athletes": chosen_athletes, "A13_unlinked_counts": unlinked_counts, "A14_usage": usage, "A15_Q14c_collisions": collisions, "A25_coverage": coverage, "U8_unlinked_projections": unlinked_projections,
    "Q2_Q5_Q9_Q10_Q18_entry_checks": entry_checks, "Q7_Q12_Q17_pair_checks": pair_checks, "Q4_X39_relay_duplicates": relay_duplicates, "Q11_late_lines": late_lines, "Q14b_key_profile": key_profile,
    "S16_S17_R9_restage": restage, "S18_archive": archive, "S20_report": report, "S22_best_table": best_table, "M8_repairs": repairs, "M10_T9_relay_queue": relay_queue, "R6_R7_leases": leases, "R5_unprocessed": unprocessed,
    "M18_split_plan": split_plan, "M19_corrections": corrections, "M20_backfill": backfill, "M6_run_outcomes": commit_run, "M22_resync": resync,
}

_E = f"WITH {ENTRIES}"
_MARK_KEY = r"regexp_replace(regexp_replace(lower(mark), '\s+', '', 'g'), '[ahcy]+$', '')"
_MEET_KEY = r"trim(regexp_replace(replace(regexp_replace(regexp_replace(lower(coalesce(meet, '')), '\s*\[[^\]]+\]', '', 'g'), '\s*\(outdoor\)\s*', ' ', 'g'), '&', 'and'), '[^a-z0-9]+', ' ', 'g'))"
_NAME_KEY = "trim(regexp_replace(strip_accents(lower({})), '[^a-z0-9]+', ' ', 'g'))"
_TEAM = r"trim(regexp_replace(regexp_replace(" + _NAME_KEY.format(r"regexp_replace(team, '(?i)\s*[-–—]\s*[a-h]$', '')") + r", '\b(unattached|independent|unaffiliated)\b', '', 'g'), '\s+', ' ', 'g'))"
_PLATFORM = "CASE WHEN url IS NULL THEN NULL " + " ".join("WHEN " + " OR ".join(f"contains(url, '{p}')" for p in parts) + f" THEN '{name}'" for name, parts in records.PLATFORMS) + " ELSE 'other' END"
_COMPACT = r"trim(regexp_replace(regexp_replace(lower(trim(round)), '[._-]+', ' ', 'g'), '\s+', ' ', 'g'))"
_ROUND = rf"CASE WHEN {_COMPACT} = '' THEN NULL WHEN regexp_matches({_COMPACT}, '^(heat|h)\s*#?\s*\d+$|prelim|qualif|heat') THEN 'Preliminaries' WHEN {_COMPACT} LIKE '%semi%' THEN 'Semifinals' WHEN {_COMPACT} LIKE '%final%' THEN 'Finals' ELSE trim(round) END"
_NOBODY = f"(coalesce(trim(name) = '', true) OR replace({_NAME_KEY.format('name')}, ' ', '') IN ({', '.join(map(repr, records.PLACEHOLDERS))}))"
_EVIDENCE = """SELECT c_custkey, c_acctbal < 0 AS in_debt, coalesce(f, false) AS finished, coalesce(l, false) AS large, coalesce(u, false) AS urgent FROM customer LEFT JOIN
    (SELECT o_custkey, bool_or(o_orderstatus = 'F') AS f, bool_or(o_totalprice > 200000) AS l, bool_or(o_orderpriority LIKE '1%') AS u FROM orders GROUP BY 1) ON c_custkey = o_custkey"""
_DOUBLED = "regexp_matches(mark, '^(" + "|".join(records.DOUBLED) + r")\s+(" + "|".join(records.DOUBLED) + r")$') AND regexp_extract(mark, '^(\S+)', 1) = regexp_extract(mark, '(\S+)$', 1)"


ORACLE_SQL = {
    "J4_against_totals": "SELECT o_custkey, count(*) AS n, any_value(a) AS all_orders, date_diff('day', max(o_orderdate::DATE), any_value(m))::INT AS days_behind FROM orders, (SELECT count(*) AS a, max(o_orderdate::DATE) AS m FROM orders) GROUP BY o_custkey",
    "J10_two_meets_a_day": f"{_E} SELECT athlete, date_trunc('month', day)::DATE AS day, min({_MEET_KEY}) AS one, max({_MEET_KEY}) AS other, count(DISTINCT {_MEET_KEY}) AS n FROM e WHERE {_MEET_KEY} <> '' GROUP BY 1, 2 HAVING n > 1",
    "J12_event_properties": "WITH k AS (SELECT event_type, props, unnest(json_keys(props)) AS name FROM events) SELECT event_type, name, count(*) AS n, count(DISTINCT json_extract_string(props, '$.\"' || name || '\"')) AS n_values FROM k GROUP BY 1, 2",
    "J13_A10_customer_evidence": _EVIDENCE,
    "Q14d_evidence_profile": f"SELECT in_debt, finished, large, urgent, count(*) AS n FROM ({_EVIDENCE}) GROUP BY ALL",
    "J30_schools_by_state": f"""{_E}, s AS (SELECT 'state ' || (['a', 'b', 'college'])[s_suppkey % 3 + 1] AS k, s_suppkey, s_nationkey % 5 AS state FROM supplier),
        r AS (SELECT id, {_TEAM} AS k, athlete % 5 AS state FROM e), m AS (SELECT id, (SELECT min(s_suppkey) FROM s WHERE s.k = r.k HAVING count(*) = 1) AS by_name, (SELECT min(s_suppkey) FROM s WHERE s.k = r.k AND s.state = r.state HAVING count(*) = 1) AS by_state FROM r WHERE k <> '')
        SELECT id, coalesce(by_name, by_state) AS school, CASE WHEN by_name IS NOT NULL THEN 'name' WHEN by_state IS NOT NULL THEN 'name and state' ELSE 'none' END AS how FROM m""",
    "J32_same_name_and_day": f"{_E} SELECT id, min(id) OVER w AS meet_id, count(*) OVER w AS size FROM e WHERE meet IS NOT NULL WINDOW w AS (PARTITION BY meet, day)",
    "J34_tuples_in": "SELECT l_linestatus, count(*) AS n FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT (l_partkey, l_suppkey) FROM lineitem WHERE l_returnflag = 'R') AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%') GROUP BY 1",
    "J35_members_of_groups": "WITH g AS (SELECT s_nationkey, list(DISTINCT s_suppkey) AS ids FROM supplier GROUP BY 1) SELECT s_nationkey, len(ids)::INT AS size, count(*) AS n_lines FROM lineitem JOIN g ON list_contains(ids, l_suppkey) GROUP BY ALL",
    "J36_pairs_of_two": "SELECT one, two, count(*) AS n, sum(p)::BIGINT AS n_parts FROM (SELECT min(l_suppkey) AS one, max(l_suppkey) AS two, count(DISTINCT l_partkey) AS p FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) = 2) GROUP BY 1, 2",
    "J42a_window_candidates": f"""{_E}, k AS (SELECT *, {_MEET_KEY} AS mk FROM e), m AS (SELECT mk, day, min(id) AS meet_id, min(location) AS spot FROM k WHERE location IS NOT NULL AND meet IS NOT NULL GROUP BY ALL),
        g AS (SELECT k.id, count(*) AS n, min(meet_id) AS lone, count(*) FILTER (spot = location) AS here, min(meet_id) FILTER (spot = location) AS at_place FROM k JOIN m ON k.mk = m.mk AND abs(date_diff('day', k.day, m.day)) <= 7 WHERE k.place IS NULL AND k.meet IS NOT NULL GROUP BY k.id)
        SELECT id, CASE WHEN n = 1 THEN lone WHEN here = 1 THEN at_place END AS meet_id, CASE WHEN n = 1 THEN 'only' WHEN here = 1 THEN 'place' ELSE 'ambiguous' END AS how FROM g""",
    "J42b_chosen_athletes": f"""{_E}, r AS (SELECT id, athlete, place, {_NAME_KEY.format('name')} AS k, {_TEAM} AS t FROM e WHERE {_NAME_KEY.format('name')} <> ''),
        m AS (SELECT id, (SELECT min(b.athlete) FROM r b WHERE b.place IS NOT NULL AND b.k = a.k AND b.t = a.t HAVING count(DISTINCT b.athlete) = 1) AS s, (SELECT min(b.athlete) FROM r b WHERE b.place IS NOT NULL AND b.k = a.k HAVING count(DISTINCT b.athlete) = 1) AS o FROM r a WHERE a.place IS NULL)
        SELECT id, coalesce(s, o) AS athlete, CASE WHEN s IS NOT NULL THEN 'team' WHEN o IS NOT NULL THEN 'only' ELSE 'none' END AS how FROM m""",
    "A13_unlinked_counts": f"{_E} SELECT a AS n_events, b AS n_names, c AS n_full, a + b + c AS total, u AS any_unmarked FROM (SELECT (SELECT count(*) FROM e WHERE event = '') AS a, (SELECT count(*) FROM e WHERE name IS NULL) AS b, (SELECT count(*) FROM lineitem WHERE l_discount = 0) AS c, (SELECT coalesce(bool_or(mark IS NULL), false) FROM e) AS u)",
    "A14_usage": "SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n_customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n_suppliers FROM nation",
    "A15_Q14c_collisions": f"""{_E}, g AS (SELECT url, CASE WHEN regexp_matches(url, '/athletes?/[0-9]+') THEN 'profile' WHEN regexp_matches(url, '(mens|womens)-', 'i') THEN 'event' ELSE 'other' END AS shape, count(DISTINCT athlete) AS n_athletes, count(DISTINCT team) AS n_teams, bool_or(athlete = 42) AS known FROM e WHERE url IS NOT NULL GROUP BY 1, 2)
        SELECT url, shape, n_athletes, n_teams, known, CASE WHEN n_teams <= 1 THEN 'one team' WHEN known THEN 'known athlete' ELSE 'mixed' END AS bucket FROM g WHERE n_athletes > 1""",
    "A25_coverage": f"{_E} SELECT event IN ('60 Meters', '200 Meters', '800 Meters', 'Mile', 'High Jump', 'Long Jump', 'Shot Put') AS matched, count(DISTINCT event) AS n_spellings, count(*) AS occurrences FROM e GROUP BY 1",
    "U8_unlinked_projections": f"{_E}, f AS (SELECT athlete || '|' || event || '|' || coalesce({_MARK_KEY}, 'null') AS fp, place, id FROM e) SELECT fp, min(id) AS id, count(*) AS n FROM f WHERE place IS NOT NULL AND fp NOT IN (SELECT fp FROM f WHERE place IS NULL) GROUP BY fp",
    "Q2_Q5_Q9_Q10_Q18_entry_checks": f"""{_E}, c AS (SELECT regexp_replace(trim(regexp_replace(trim(mark), '\\s*\\([-+]?[0-9.]+\\)\\s*$', '')), '[ahcyAHCY]$', '') AS core, * FROM e),
        z AS (SELECT *, NOT (regexp_matches(core, '^(\\d+:)?\\d+:\\d\\d(\\.\\d+)?$') OR regexp_matches(core, '^\\d+\\.\\d+$')) OR regexp_matches(core, '^[0:.]+$') AS blank, regexp_matches(trim(mark), '^\\d+(\\.\\d+)?\\s*[mM]$|^\\d+-\\d|^\\d+''') AS field FROM c)
        SELECT 'Q2_unresolved_event' AS name, count(*) FILTER (event = '') AS n FROM z UNION ALL SELECT 'Q5_doubled_code', count(*) FILTER ({_DOUBLED}) FROM z
        UNION ALL SELECT 'Q9_mark_without_number', count(*) FILTER (regexp_matches(mark, '^\\d+[.:]\\d') AND blank AND NOT field) FROM z UNION ALL SELECT 'Q10_not_positive', 0 UNION ALL SELECT 'Q10_truncated', 0
        UNION ALL SELECT 'Q18_undecided', count(*) FILTER (place IS NULL AND mark IS NOT NULL) FROM z""",
    "Q7_Q12_Q17_pair_checks": f"""{_E} SELECT 'Q7_suffixed_and_plain' AS name, count(*) AS n FROM (SELECT 1 FROM e WHERE regexp_matches(mark, '[0-9]') GROUP BY athlete, event, lower(regexp_replace(mark, '[ah]$', '')) HAVING count(*) > 1 AND bool_or(regexp_matches(mark, '[ah]$')) AND bool_or(NOT regexp_matches(mark, '[ah]$')))
        UNION ALL SELECT 'Q17_shared_source_id', count(*) FROM (SELECT 1 FROM e WHERE regexp_matches(url, '/athletes?/[0-9]+') GROUP BY regexp_extract(url, '/athletes?/([0-9]+)', 1) HAVING count(DISTINCT athlete) > 1)
        UNION ALL SELECT 'Q12_repeated_key', coalesce(sum(c - 1), 0)::BIGINT FROM (SELECT count(*) AS c FROM e GROUP BY athlete, event, {_MARK_KEY}, round HAVING c > 1)""",
    "Q4_X39_relay_duplicates": """WITH g AS (SELECT l_orderkey, string_agg(w, '|' ORDER BY n, w) AS lineup, count(*)::INT AS n_legs FROM (SELECT DISTINCT l_orderkey, l_linenumber AS n, l_suppkey::VARCHAR AS w FROM lineitem) GROUP BY 1)
        SELECT lineup, n_legs, count(*) AS n_relays, count(DISTINCT o_custkey) AS n_customers FROM g JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    "Q11_late_lines": "SELECT abs(date_diff('day', o_orderdate::DATE, l_shipdate::DATE)) // 30 AS months, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE abs(date_diff('day', o_orderdate::DATE, l_shipdate::DATE)) > 7 GROUP BY 1",
    "Q14b_key_profile": " UNION ALL ".join(f"SELECT '{c}.{k[0]}' AS key, count(*) FILTER ({k[0]} IS NOT NULL AND {k[0]} NOT IN (SELECT {t[0]} FROM {p})) AS n_orphans, count(*) FILTER ({k[0]} IS NULL) AS n_null FROM {c}" for c, k, p, t in FOREIGN_KEYS),
    "S16_S17_R9_restage": f"{_E}, o AS (SELECT id, CASE WHEN place IS NULL THEN 'inserted' WHEN id % 10 = 1 AND mark IS DISTINCT FROM '10.99' THEN 'conflict' ELSE 'replayed' END AS outcome FROM e) SELECT outcome, count(*) AS n, min(id) AS first_id FROM o GROUP BY 1",
    "S18_archive": """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, rank() OVER w AS k, first_value(l_partkey) OVER w AS kept_part FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity))
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, kept_part, l_orderkey % 16 AS batch FROM r WHERE k > 1""",
    "S20_report": f"{_E} SELECT '{{\"athletes\":' || count(DISTINCT athlete) || ',\"entries\":' || count(*) || ',\"unmarked\":' || count(*) FILTER (mark IS NULL) || '}}' AS report FROM e",
    "S22_best_table": f"""{_E}, b AS (SELECT athlete, event, min(x) AS x, first(id ORDER BY x, id) AS id, min(x) FILTER (day < DATE '2000-01-01') AS o FROM e GROUP BY 1, 2)
        SELECT athlete, event, x, id, CASE WHEN o IS NULL THEN 'insert' ELSE 'update' END AS action FROM b WHERE x IS DISTINCT FROM o""",
    "M8_repairs": """WITH l AS (SELECT l_orderkey, sum(round(l_extendedprice * 100)::BIGINT) AS stored FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS source FROM orders WHERE o_orderstatus = 'F')
        SELECT CASE WHEN l_orderkey IS NULL THEN 'add' WHEN o_orderkey IS NULL THEN 'review' WHEN source <> stored THEN 'set' ELSE 'none' END AS action, count(*) AS n, min(coalesce(o_orderkey, l_orderkey)) AS first_key FROM o FULL JOIN l ON o_orderkey = l_orderkey GROUP BY 1""",
    "M10_T9_relay_queue": f"""{_E}, r AS (SELECT *, trim(regexp_replace(replace(lower(event), '×', 'x'), '[^a-z0-9]+', ' ', 'g')) AS plain FROM e WHERE meet IS NOT NULL),
        g AS (SELECT {_MEET_KEY} AS meet_key, day, count(*) AS n_entries, count(*) FILTER (mark IS NULL) AS n_missing, min({_PLATFORM}) AS platform FROM r WHERE NOT contains(plain, 'shuttle') AND regexp_matches(plain, '(^|\\s)4\\s*x\\s*100(\\s*m(eter)?s?)?(\\s*relay)?(\\s*race)?($|\\s)') GROUP BY 1, 2)
        SELECT *, CASE WHEN n_missing > 0 THEN 1 WHEN platform = 'other' THEN 3 ELSE 2 END AS priority FROM g""",
    "R6_R7_leases": """WITH j AS (SELECT event_id AS job, event_id % 6 AS attempts, event_id % 4 AS state, day(ts) AS until, user_id % 3 = event_id % 3 AS held FROM events),
        s AS (SELECT job, attempts, CASE WHEN state = 1 THEN CASE WHEN until < 15 THEN CASE WHEN attempts >= 5 THEN 'failed' ELSE 'ready' END WHEN held THEN 'done' ELSE 'leased' END WHEN state = 2 THEN CASE WHEN attempts >= 5 THEN 'failed' ELSE 'waiting' END ELSE 'ready' END AS status FROM j)
        SELECT job, status, CASE WHEN status = 'waiting' THEN (2 ** attempts)::BIGINT END AS retry_after FROM s""",
    "R5_unprocessed": "SELECT event_id, user_id, event_type, ts::DATE AS day FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, ts::DATE ORDER BY ts DESC, event_id DESC) = 1 ORDER BY event_id",
    "M18_split_plan": """WITH g AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS m, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1),
        r AS (SELECT *, CASE WHEN n < 3 THEN 'too_few' WHEN m = 0 THEN 'nothing_to_move' WHEN m = n THEN 'nothing_stays' WHEN p > 0 THEN 'open_rows' END AS reason FROM g)
        SELECT o_custkey, CASE WHEN reason IS NULL THEN 'ready' ELSE 'held' END AS state, reason, CASE WHEN reason IS NULL THEN m ELSE 0 END AS n_moved FROM r""",
    "M19_corrections": f"""{_E}, c AS (SELECT id, concat_ws(',', CASE WHEN id % 6 = 0 AND mark IS DISTINCT FROM '9.99' THEN 'mark' END, CASE WHEN id % 10 = 0 AND place IS DISTINCT FROM 1 THEN 'place' END) AS fields FROM e)
        SELECT CASE WHEN id % 15 = 0 THEN 'held: identity' WHEN fields = '' THEN 'unchanged' ELSE 'update' END AS state, fields, count(*) AS n, min(id) AS first_id FROM c GROUP BY 1, 2""",
    "M20_backfill": f"""{_E}, g AS (SELECT min(x) AS stored, count(DISTINCT name) AS n_names, min(x) FILTER (place = 1) AS said FROM e GROUP BY athlete, event)
        SELECT CASE WHEN said IS NULL THEN 'not_published' WHEN n_names > 1 THEN 'ambiguous' WHEN stored = said THEN 'already_present' ELSE 'conflict' END AS outcome, count(*) AS n FROM g GROUP BY 1""",
    "M6_run_outcomes": f"""{_E}, r AS (SELECT id, athlete, event, place, {_MARK_KEY} AS k, {_NOBODY} AS nobody FROM e WHERE event <> ''),
        m AS (SELECT a.id, a.k, a.nobody, (SELECT min(b.id) FROM r b WHERE b.place IS NOT NULL AND b.athlete = a.athlete AND b.event = a.event AND b.k = a.k) AS stored_id, min(a.id) OVER (PARTITION BY a.athlete, a.event, a.k) AS first_id FROM r a WHERE a.place IS NULL),
        o AS (SELECT *, CASE WHEN k IS NULL THEN 'held: no mark' WHEN nobody THEN 'held: no name' WHEN stored_id IS NOT NULL THEN 'linked' WHEN id <> first_id THEN 'duplicate' ELSE 'insert' END AS outcome FROM m)
        SELECT id, outcome, CASE WHEN outcome = 'linked' THEN stored_id END AS linked_id FROM o""",
    "M22_resync": f"""{_E}, g AS (SELECT {_MEET_KEY} AS meet_key, count(*) AS n, count(mark) AS n_marked, max(id) FILTER (mark IS NULL) AS open_id FROM e WHERE meet IS NOT NULL GROUP BY 1)
        SELECT meet_key, n, n_marked, CASE WHEN n_marked = n THEN 'complete' WHEN n_marked > 0 THEN 'partial' ELSE 'missing' END AS state, open_id, greatest(n - n_marked - 1, 0) AS n_superseded FROM g""",
}
