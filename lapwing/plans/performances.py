"""Window and aggregate queries on the star schema: orders stand for results, customers for athletes, order lines for legs, events for a feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lapwing.functions import marks
from lapwing.operators import dedup, intervals
from lapwing.sources.tables import table


def personal_bests(spark: SparkSession, d: str) -> DataFrame:
    """Best order of each customer, priority and status; for status F the least price is best, else the greatest. Every status O order has no date."""
    o = table(spark, d, "orders").withColumn("day", F.when(F.col("o_orderstatus") != "O", F.to_date("o_orderdate")))
    signed = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))
    best = dedup.survivors(o, ["o_custkey", "o_orderpriority", "o_orderstatus"], [signed.asc(), F.asc_nulls_last("day"), F.asc("o_orderkey")])
    return best.select("o_custkey", "o_orderpriority", "o_orderstatus", "o_orderkey", "o_totalprice", "day")


LINE_ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def line_survivors(spark: SparkSession, d: str) -> DataFrame:
    """One row of each order line: the latest shipped, then one with a discount, then by return flag and all else; and how many there were."""
    rows = table(spark, d, "lineitem").withColumn("ship", F.to_date("l_shipdate"))
    flag = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    order = [F.col("ship").isNull(), -F.unix_date("ship"), ~(F.col("l_discount") > 0), flag, *[F.col(c) for c in LINE_ORDER]]
    return dedup.counted_survivors(rows, ["l_orderkey", "l_linenumber"], order, ["l_partkey", "l_suppkey", "ship"])


def survivor_of_group(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier with the richest of its nation."""
    w = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.first("s_suppkey").over(w).alias("survivor"), F.row_number().over(w).alias("place"))


def running_bests(spark: SparkSession, d: str) -> DataFrame:
    """Least value of a user and event type so far, and whether the row sets it."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    out = table(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.min("value").over(w).alias("best"))
    return out.withColumn("is_best", F.col("value") <= F.col("best"))


def progress(spark: SparkSession, d: str) -> DataFrame:
    """Of each user and event type: strict improvements, first and best value, the improvement in all and the last step."""
    keyed = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    rows = table(spark, d, "events").withColumn("before", F.min("value").over(keyed.rowsBetween(Window.unboundedPreceding, -1)))
    first = rows.withColumn("start", F.first("value").over(keyed))
    bests = first.where("before IS NULL OR value < before")
    out = bests.groupBy("user_id", "event_type").agg(
        F.count_if(F.col("before").isNotNull()).alias("n_better"), F.max("start").alias("start"), F.min("value").alias("best"), F.max_by(F.col("before") - F.col("value"), F.struct("ts", "event_id")).alias("last_step")
    )
    return out.withColumn("gain", F.col("start") - F.col("best"))


def order_islands(spark: SparkSession, d: str) -> DataFrame:
    """Chains of a customer's orders, each of which lies within 30 days of the end of what came before."""
    s = F.to_date("o_orderdate")
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", s.alias("s"), F.date_add(s, F.length("o_orderpriority")).alias("e"))
    return intervals.islands(rows, ["o_custkey"], "s", "e", 30, ["o_orderkey"]).groupBy("o_custkey", "island").agg(F.min("s").alias("first_day"), F.max("e").alias("last_day"), F.count(F.lit(1)).alias("n"))


def reranked(spark: SparkSession, d: str) -> DataFrame:
    """Places of an order's lines by price; a price over 50,000 counts as missing and comes last."""
    price = F.when(F.col("l_extendedprice") <= 50000, F.col("l_extendedprice"))
    w = Window.partitionBy("l_orderkey").orderBy(price.asc_nulls_last(), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_shipdate")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", F.row_number().over(w).alias("place")).withColumn("l_shipdate", F.to_date("l_shipdate"))


def missing_places(spark: SparkSession, d: str) -> DataFrame:
    """Line numbers that an order lacks up to its greatest, where it has 10 lines at most and the greatest is at most twice their number."""
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("has"), F.max("l_linenumber").alias("m"))
    ok = g.where((F.size("has") <= 10) & (F.col("m") <= 2 * F.size("has")))
    return ok.select("l_orderkey", F.explode(F.array_except(F.sequence(F.lit(1), F.col("m")), "has")).alias("place"))


def line_profile(spark: SparkSession, d: str) -> DataFrame:
    """Filtered counts in one pass."""
    return table(spark, d, "lineitem").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("l_returnflag") == "R").alias("n_returned"),
        F.count_if(F.col("l_discount") == 0).alias("n_full_price"),
        F.count_if(F.col("l_shipdate").isNull()).alias("n_unshipped"),
        F.countDistinct("l_orderkey").alias("n_orders"),
        F.countDistinct(F.struct("l_partkey", "l_suppkey")).alias("n_offers"),
    )


def duplicate_lines(spark: SparkSession, d: str) -> DataFrame:
    return dedup.extra_rows(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def lineup_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Sets of suppliers that deliver together, with the number of orders."""
    lineups = table(spark, d, "lineitem").groupBy("l_orderkey").agg(dedup.signature(F.col("l_suppkey").cast("string")).alias("lineup"))
    return lineups.groupBy("lineup").agg(F.count(F.lit(1)).alias("n_orders"), F.min("l_orderkey").alias("first_order"))


def customer_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    row = F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority")
    return table(spark, d, "orders").groupBy("o_custkey").agg(dedup.fingerprint(row).alias("fingerprint"))


def group_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Distribution of the number of lines of an order."""
    sizes = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"))
    return sizes.groupBy("n_lines").agg(F.count(F.lit(1)).alias("n_orders"))


def day_sources(spark: SparkSession, d: str) -> DataFrame:
    """The event type of a user's day, or 'mixed'."""
    g = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day"))
    return g.agg(F.when(F.countDistinct("event_type") > 1, "mixed").otherwise(F.max("event_type")).alias("source"), F.count(F.lit(1)).alias("n"))


def event_stats(spark: SparkSession, d: str) -> DataFrame:
    """Number, best value, the event that holds it first, and sum in hundredths."""
    cents = F.round(F.col("value") * 100).cast("long")
    return (
        table(spark, d, "events")
        .groupBy("user_id", "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("best"), F.min_by("event_id", F.struct("value", "event_id")).alias("best_event"), F.sum(cents).alias("cents"))
    )


def profiles(spark: SparkSession, d: str) -> DataFrame:
    """Of each customer: kinds of orders, days, finished orders, first and last day, the ten newest orders."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus", F.to_date("o_orderdate").alias("day"))
    counts = o.groupBy("o_custkey").agg(
        F.countDistinct("o_orderpriority").alias("n_kinds"), F.countDistinct("day").alias("n_days"), F.count_if(F.col("o_orderstatus") == "F").alias("n_finished"), F.min("day").alias("first_day"), F.max("day").alias("last_day")
    )
    # ten rows of a customer at most leave a task
    ten = dedup.ranked(o, ["o_custkey"], [F.desc("day"), F.col("o_orderkey")]).where("rn <= 10")
    newest = F.transform(F.array_sort(F.collect_list(F.struct("rn", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string"))
    lists = ten.groupBy(F.col("o_custkey").alias("key")).agg(F.array_join(newest, ",").alias("newest"))
    return counts.join(lists, F.col("o_custkey").eqNullSafe(F.col("key"))).drop("key")


def live_groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max(F.to_date("ts")).alias("last_day"))


def labelled_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name in ("customer", "supplier", "part", "orders", "lineitem", "events"):
        part = table(spark, d, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("metric"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def column_profile(spark: SparkSession, d: str) -> DataFrame:
    """Nulls and empty texts of every column of customer, in one pass."""
    df = table(spark, d, "customer")
    one = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns],
        *[(F.count_if(F.col(c) == "") if kind == "string" else F.lit(0).cast("long")).alias(f"empty_{c}") for c, kind in df.dtypes],
    )
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col("n_rows"), F.col(f"null_{c}").alias("n_null"), F.col(f"empty_{c}").alias("n_empty")) for c in df.columns])
    return one.select(F.inline(each))


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    word = F.lower(F.trim(F.regexp_replace("o_orderpriority", r"^[0-9]+-", "")))
    return table(spark, d, "orders").groupBy(F.when(word.rlike("^not"), "none").otherwise(word).alias("word")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderpriority").alias("n_spellings"))


def unanimous_flags(spark: SparkSession, d: str) -> DataFrame:
    """The return flag of the orders whose lines all bear the same."""
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"), F.count(F.lit(1)).alias("n"))
    return g.where(F.size("flags") == 1).select("l_orderkey", F.element_at("flags", 1).alias("flag"), "n")


def duplicate_classes(spark: SparkSession, d: str) -> DataFrame:
    """Repeated order lines by whether their parts and suppliers differ."""
    g = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("supps")).where("n > 1")
    kind = F.when((F.col("parts") == 1) & (F.col("supps") == 1), "copy").when(F.col("parts") == 1, "other supplier").when(F.col("supps") == 1, "other part").otherwise("unlike")
    return g.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n_groups"), F.sum(F.col("n") - 1).alias("n_extra"))


def season_counts(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").groupBy(marks.season_label(day).alias("label"), marks.season_environment(day).alias("environment"), marks.season_academic(day).alias("academic"), marks.season_start(day, 8).alias("school_start")).agg(F.count(F.lit(1)).alias("n"))


def parsed_marks(spark: SparkSession, d: str) -> DataFrame:
    """Order prices in cents as published times such as 1:02.03a, parsed back, with their keys."""
    c = F.round(F.col("o_totalprice") * 100).cast("long")
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    raw = F.concat(F.floor(c / 6000).cast("string"), F.lit(":"), two(F.floor(c % 6000 / 100)), F.lit("."), two(c % 100), F.when(F.col("o_orderstatus") == "F", "a").otherwise("  (+1.5)"))
    out = table(spark, d, "orders").select("o_orderkey", raw.alias("mark"))
    return out.select("o_orderkey", "mark", marks.mark_seconds(F.col("mark")).alias("seconds"), marks.mark_key(F.col("mark")).alias("key"))


def page_hosts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").groupBy(marks.url_host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


def third_page(spark: SparkSession, d: str) -> DataFrame:
    """Rows 101 to 150 of the orders by date, newest first: a page of a list."""
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day")).orderBy(F.desc("day"), "o_orderkey").offset(100).limit(50)


QUERIES = {
    "W1_personal_bests": personal_bests,
    "W3_W4_line_survivors": line_survivors,
    "W6_survivor_of_group": survivor_of_group,
    "W9_running_bests": running_bests,
    "W10_W11_W12_progress": progress,
    "W14_order_islands": order_islands,
    "W15_reranked": reranked,
    "W16_missing_places": missing_places,
    "A2_A3_A6_line_profile": line_profile,
    "A4_A5_duplicate_lines": duplicate_lines,
    "A7_lineup_signatures": lineup_signatures,
    "A11_customer_fingerprints": customer_fingerprints,
    "A12_group_sizes": group_sizes,
    "A16_day_sources": day_sources,
    "A17_A18_event_stats": event_stats,
    "A19_A20_profiles": profiles,
    "A21_live_groups": live_groups,
    "A22_labelled_metrics": labelled_metrics,
    "A23_column_profile": column_profile,
    "A24_vocabulary": vocabulary,
    "A26_unanimous_flags": unanimous_flags,
    "A28_duplicate_classes": duplicate_classes,
    "X34_season_counts": season_counts,
    "X1_parsed_marks": parsed_marks,
    "X32_page_hosts": page_hosts,
    "T3_third_page": third_page,
}

_EV = "PARTITION BY user_id, event_type ORDER BY ts, event_id"

ORACLE_SQL = {
    "W1_personal_bests": """
        SELECT o_custkey, o_orderpriority, o_orderstatus, o_orderkey, o_totalprice, day FROM (
          SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority, o_orderstatus
                    ORDER BY CASE o_orderstatus WHEN 'F' THEN o_totalprice ELSE -o_totalprice END, day NULLS LAST, o_orderkey) AS rn
          FROM (SELECT *, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate::DATE END AS day FROM orders)) WHERE rn = 1""",
    "W3_W4_line_survivors": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate::DATE AS ship, copies FROM (
          SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS copies,
                 row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate::DATE DESC NULLS LAST, l_discount > 0 DESC,
                   CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS rn
          FROM lineitem) WHERE rn = 1""",
    "W6_survivor_of_group": """
        SELECT s_suppkey, s_nationkey, first_value(s_suppkey) OVER w AS survivor, (row_number() OVER w)::INT AS place
        FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey)""",
    "W9_running_bests": f"""
        SELECT *, value <= best AS is_best FROM (SELECT event_id, user_id, event_type, value, min(value) OVER ({_EV} ROWS UNBOUNDED PRECEDING) AS best FROM events)""",
    "W10_W11_W12_progress": f"""
        WITH r AS (SELECT *, min(value) OVER ({_EV} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, first_value(value) OVER ({_EV}) AS s0 FROM events)
        SELECT user_id, event_type, count(before) AS n_better, max(s0) AS start, min(value) AS best,
               last(before - value ORDER BY ts, event_id) AS last_step, max(s0) - min(value) AS gain
        FROM r WHERE before IS NULL OR value < before GROUP BY ALL""",
    "W14_order_islands": """
        WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS s, o_orderdate::DATE + length(o_orderpriority)::INT AS e FROM orders),
        f AS (SELECT *, coalesce(date_diff('day', max(e) OVER (PARTITION BY o_custkey ORDER BY s, e, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s) > 30, true)::INT AS fresh FROM r),
        i AS (SELECT *, (sum(fresh) OVER (PARTITION BY o_custkey ORDER BY s, e, o_orderkey ROWS UNBOUNDED PRECEDING))::BIGINT AS island FROM f)
        SELECT o_custkey, island, min(s) AS first_day, max(e) AS last_day, count(*) AS n FROM i GROUP BY o_custkey, island""",
    "W15_reranked": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate::DATE AS l_shipdate,
               (row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_extendedprice <= 50000 THEN l_extendedprice END NULLS LAST,
                 l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_shipdate))::INT AS place FROM lineitem""",
    "W16_missing_places": """
        WITH g AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS c, max(l_linenumber) AS m FROM lineitem GROUP BY l_orderkey),
        p AS (SELECT l_orderkey, unnest(generate_series(1, m))::INT AS place FROM g WHERE c <= 10 AND m <= 2 * c)
        SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = p.l_orderkey AND l_linenumber = place)""",
    "A2_A3_A6_line_profile": """
        SELECT count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS n_returned, count(*) FILTER (l_discount = 0) AS n_full_price,
               count(*) FILTER (l_shipdate IS NULL) AS n_unshipped, count(DISTINCT l_orderkey) AS n_orders, count(DISTINCT (l_partkey, l_suppkey)) AS n_offers FROM lineitem""",
    "A4_A5_duplicate_lines": """
        SELECT count(*) AS n_groups, coalesce(sum(n - 1), 0)::BIGINT AS n_extra FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""",
    "A7_lineup_signatures": """
        SELECT lineup, count(*) AS n_orders, min(l_orderkey) AS first_order
        FROM (SELECT l_orderkey, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS lineup FROM lineitem GROUP BY l_orderkey) GROUP BY lineup""",
    "A11_customer_fingerprints": """
        SELECT o_custkey, md5(string_agg(m, ',' ORDER BY m)) AS fingerprint
        FROM (SELECT o_custkey, md5(o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority) AS m FROM orders) GROUP BY o_custkey""",
    "A12_group_sizes": "SELECT n_lines, count(*) AS n_orders FROM (SELECT count(*) AS n_lines FROM lineitem GROUP BY l_orderkey) GROUP BY n_lines",
    "A16_day_sources": """
        SELECT user_id, ts::DATE AS day, CASE WHEN count(DISTINCT event_type) > 1 THEN 'mixed' ELSE max(event_type) END AS source, count(*) AS n FROM events GROUP BY user_id, ts::DATE""",
    "A17_A18_event_stats": """
        SELECT user_id, event_type, count(*) AS n, min(value) AS best, first(event_id ORDER BY value, event_id) AS best_event, sum(round(value * 100)::BIGINT)::BIGINT AS cents
        FROM events GROUP BY user_id, event_type""",
    "A19_A20_profiles": """
        SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_kinds, count(DISTINCT o_orderdate::DATE) AS n_days, count(*) FILTER (o_orderstatus = 'F') AS n_finished,
               min(o_orderdate::DATE) AS first_day, max(o_orderdate::DATE) AS last_day,
               array_to_string((list(o_orderkey ORDER BY o_orderdate::DATE DESC, o_orderkey))[1:10], ',') AS newest FROM orders GROUP BY o_custkey""",
    "A21_live_groups": "SELECT event_type, count(*) AS n, max(ts::DATE) AS last_day FROM events GROUP BY event_type",
    "A22_labelled_metrics": " UNION ALL ".join(f"SELECT '{t}' AS metric, count(*) AS n FROM {t}" for t in ("customer", "supplier", "part", "orders", "lineitem", "events")),
    "A23_column_profile": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_null, count(*) FILTER ({c}::VARCHAR = '') AS n_empty FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    ),
    "A24_vocabulary": """
        WITH w AS (SELECT o_orderpriority, lower(trim(regexp_replace(o_orderpriority, '^[0-9]+-', ''))) AS word FROM orders)
        SELECT CASE WHEN word LIKE 'not%' THEN 'none' ELSE word END AS word, count(*) AS n, count(DISTINCT o_orderpriority) AS n_spellings FROM w GROUP BY 1""",
    "A26_unanimous_flags": "SELECT l_orderkey, min(l_returnflag) AS flag, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 1",
    "A28_duplicate_classes": """
        WITH g AS (SELECT count(*) AS n, count(DISTINCT l_partkey) AS p, count(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
        SELECT CASE WHEN p = 1 AND s = 1 THEN 'copy' WHEN p = 1 THEN 'other supplier' WHEN s = 1 THEN 'other part' ELSE 'unlike' END AS kind, count(*) AS n_groups, sum(n - 1)::BIGINT AS n_extra
        FROM g GROUP BY 1""",
    "X34_season_counts": """
        WITH d AS (SELECT o_orderdate::DATE AS day, month(o_orderdate) AS m, year(o_orderdate) AS y FROM orders)
        SELECT (CASE WHEN m = 12 THEN y + 1 ELSE y END)::VARCHAR || ' ' || CASE WHEN m IN (12, 1, 2, 3) THEN 'Indoor' WHEN m <= 7 THEN 'Outdoor' WHEN m = 8 THEN 'Summer' ELSE 'XC' END AS label,
               CASE WHEN m IN (1, 2, 3, 11, 12) THEN 'indoor' WHEN m BETWEEN 4 AND 8 THEN 'outdoor' ELSE 'other' END AS environment,
               (CASE WHEN m < 9 THEN y - 1 ELSE y END)::VARCHAR || '-' || lpad(((CASE WHEN m < 9 THEN y ELSE y + 1 END) % 100)::VARCHAR, 2, '0') AS academic,
               make_date(CASE WHEN m < 8 THEN y - 1 ELSE y END, 8, 1) AS school_start, count(*) AS n FROM d GROUP BY ALL""",
    "X1_parsed_marks": """
        WITH c AS (SELECT o_orderkey, o_orderstatus, round(o_totalprice * 100)::BIGINT AS c FROM orders),
        m AS (SELECT o_orderkey, c, (c // 6000)::VARCHAR || ':' || lpad((c % 6000 // 100)::VARCHAR, 2, '0') || '.' || lpad((c % 100)::VARCHAR, 2, '0') AS t, o_orderstatus FROM c)
        SELECT o_orderkey, t || CASE o_orderstatus WHEN 'F' THEN 'a' ELSE '  (+1.5)' END AS mark, c / 100.0::DOUBLE AS seconds, t || CASE o_orderstatus WHEN 'F' THEN '' ELSE '(+1.5)' END AS key FROM m""",
    "X32_page_hosts": "SELECT lower(split_part(split_part(url, '://', 2), '/', 1)) AS host, count(*) AS n FROM pages GROUP BY 1",
    "T3_third_page": "SELECT o_orderkey, o_custkey, o_orderdate::DATE AS day FROM orders ORDER BY day DESC, o_orderkey LIMIT 50 OFFSET 100",
}
