"""Names, dates, states and feeds: pages and JSON are made from the star schema, read back, and held against the rows they were made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.functions import events, marks
from lapwing.operators import combined
from lapwing.sources import documents, html
from lapwing.sources.tables import table

NAMES = ["200 Meter Dash", "Men's 4x100 Relay", "60H (I)", "10,000 Meters (O)", "400 M", "High Jump Invitational", "Women's DMR Prelims", "700m", "Egg Race Finals", "steeple heat 2", "5K", "Weight"]
CODES = ["Women's 60 m Hurdles", "10,000 Meter Run", "4 X 400 m Relay", "1 Mile Run", "Men's Egg Race", "steeplechase", "WT", "300m"]
MEETS = [" [Multis]", " Championships Combined Events", " multi", " Prelims", "", " Open"]


def _pick(values: list[str], number: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (number % len(values)).cast("int"))


def event_labels(spark: SparkSession, d: str) -> DataFrame:
    """Display names of events, one spelling per part."""
    return table(spark, d, "part").select("p_partkey", events.event_label(_pick(NAMES, F.col("p_partkey"))).alias("label"), events.event_code(_pick(CODES, F.col("p_partkey"))).alias("code"))


def unmapped_names(spark: SparkSession, d: str) -> DataFrame:
    """Part names that no small part spells, with their counts; case and outer spaces aside."""
    parts = table(spark, d, "part")
    aliases = parts.where("p_size <= 2").groupBy(F.concat(F.lit(" "), F.upper("p_name")).alias("raw_name")).agg(F.min("p_partkey").alias("event_type_id"))
    return events.unmapped_names(events.resolve_events(parts.select("p_name"), "p_name", aliases), "p_name")


def printed_dates(spark: SparkSession, d: str) -> DataFrame:
    """Order dates read back from three layouts in print."""
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    day, layout = F.col("day"), F.col("o_orderkey") % 3
    long, slash, short = F.concat(F.lit("held on "), F.date_format(day, "MMMM d, yyyy"), F.lit(" at noon")), F.date_format(day, "MM/dd/yy"), F.date_format(day, "EEE MMM d")
    read = F.when(layout == 0, events.long_date(long)).when(layout == 1, events.slash_date(slash)).otherwise(events.calendar_dates(short, F.date_sub(day, 10))["start"])
    return o.select("o_orderkey", read.alias("day"))


def mentioned_dates(spark: SparkSession, d: str) -> DataFrame:
    """Whether a page names a day within three days of the one on record, which is up to four days off."""
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    text = F.concat(F.lit("Results of "), F.when(F.col("o_orderkey") % 2 == 0, F.date_format("day", "d MMMM, yyyy")).otherwise(F.date_format("day", "MMM d, yyyy")))
    on_record = F.date_add("day", (F.col("o_orderkey") % 9).cast("int") - 4)
    return o.select("o_orderkey", events.mentions_date(text, on_record).alias("named"))


def meet_states(spark: SparkSession, d: str) -> DataFrame:
    """State of each order, as a meet of up to three days, at 03:30 UTC on 1 July 1998."""
    o = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    zone = F.when(F.col("o_orderpriority") == "1-URGENT", "America/New_York").when(F.col("o_orderpriority") != "2-HIGH", "UTC")
    state = events.meet_status(
        F.col("day"), F.date_add("day", (F.col("o_orderkey") % 3).cast("int")), F.nullif("o_orderstatus", F.lit("P")), F.when(F.col("o_orderkey") % 50 == 0, "completed"), zone, F.lit("1998-07-01 03:30:00").cast("timestamp")
    )
    return o.groupBy("o_orderpriority", "o_orderstatus", state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def meet_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of meets by name."""
    return table(spark, d, "part").select("p_partkey", events.meet_kind(F.concat("p_name", _pick(MEETS, F.col("p_partkey")))).alias("k")).select("p_partkey", "k.*")


def _pages(spark: SparkSession, d: str, head: str, row: Column) -> DataFrame:
    """One page per order with a row per line."""
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", row.alias("html")))), lambda x: x["html"]), "\n")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit(head), rows, F.lit("</tbody></table></body></html>")).alias("html"))


def _tag(value: Column | str, attributes: str = "") -> Column:
    value = F.col(value).cast("string") if isinstance(value, str) else value
    return F.concat(F.lit(f"<td{attributes}>"), value, F.lit("</td>"))


def summary_pages(spark: SparkSession, d: str) -> DataFrame:
    """Points summaries of combined events, from pages with and without links to athletes."""
    name = F.concat(F.lit("Part  "), F.col("l_partkey").cast("string"))
    linked = F.when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit('<a href="https://x.example/athletes/'), F.col("l_partkey").cast("string"), F.lit('/a.html">'), name, F.lit("</a>"))).otherwise(name)
    team = F.concat(F.lit("Team &amp; "), F.col("l_suppkey").cast("string"))
    points = F.when(F.col("l_returnflag") == "R", F.lit("DNF")).otherwise(F.col("l_quantity").cast("string"))
    row = F.concat(F.lit("<tr>"), _tag("l_linenumber"), _tag(linked), _tag(F.lit("SR")), _tag(team), _tag(points), F.lit("</tr>"))
    head = "<html><body><table class='r'><thead><tr><th>Pl</th><th> Name </th><th>Year</th><th>Team</th><th>POINTS</th></tr></thead><tbody>"
    return html.multi_event_summary(_pages(spark, d, head, row)).select("l_orderkey", "place", "athlete_id", "athlete_name", "team_name", "points")


def event_pages(spark: SparkSession, d: str) -> DataFrame:
    """Marks of event pages with hidden cells, rounds by class and status codes."""
    mark = F.when(F.col("l_returnflag") == "R", F.lit("DNS")).otherwise(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(".50m")))
    rounds = F.when(F.col("l_linestatus") == "F", _tag(mark, ' class="mark round_4"')).otherwise(_tag(mark, ' class="mark round_1"'))
    row = F.concat(F.lit("<tr>"), _tag("l_linenumber"), _tag("l_partkey"), _tag(F.lit("SR")), _tag("l_suppkey"), _tag(F.lit("99.99m"), ' class="x off"'), rounds, F.lit("</tr>"))
    head = "<html><head><style>.off { display: none }</style></head><body><table><thead><tr><th>Pl</th><th>Athlete</th><th>Yr</th><th>Team</th><th>Ft</th><th>Mark</th></tr></thead><tbody>"
    return html.event_rows(_pages(spark, d, head, row)).select("l_orderkey", "place", "athlete_name", "team_name", "round", "mark_raw")


def page_tables(spark: SparkSession, d: str) -> DataFrame:
    """Relay teams with listed athletes."""
    names = F.concat(F.lit("A "), F.col("l_partkey").cast("string"), F.lit(" ,  B "), F.col("l_suppkey").cast("string"), F.lit(","))
    row = F.concat(F.lit("<tr>"), _tag("l_linenumber"), _tag("l_suppkey"), _tag(F.lit("B")), _tag(names), F.lit("</tr>"))
    rows = html.identity(html.table_rows(_pages(spark, d, "<table><tbody>", row)), relay=True)
    return rows.select("l_orderkey", "row_no", "team_name", F.array_join(F.transform("relay_athletes", lambda a: a["name"]), "|").alias("athletes"))


def typed_orders(spark: SparkSession, d: str) -> DataFrame:
    """Finished orders from typed documents, with their lines counted."""
    text = lambda c: F.struct(F.col(c).cast("string").alias("stringValue"))
    whole = lambda c: F.struct(F.col(c).cast("string").alias("integerValue"))
    tags = F.struct(F.struct(F.array(text("o_orderpriority"), text("o_orderstatus")).alias("values")).alias("arrayValue"))
    inner = F.struct(F.struct(F.struct(whole("o_custkey").alias("key")).alias("fields")).alias("mapValue"))
    doc = F.to_json(F.struct(F.concat(F.lit("db/orders/"), F.col("o_orderkey").cast("string")).alias("name"), F.struct(text("o_orderstatus").alias("status"), tags.alias("tags"), inner.alias("customer")).alias("fields")))
    docs = documents.typed_documents(table(spark, d, "orders").select(doc.alias("doc")), "doc", "id STRING, status STRING, tags ARRAY<STRING>, customer STRUCT<key: BIGINT>")
    lines = documents.joined_entries(docs, table(spark, d, "lineitem"), "id", "l_orderkey", F.col("status") == "F")
    return lines.groupBy(F.col("id").cast("long").alias("o_orderkey"), F.col("customer.key").alias("o_custkey"), F.array_join("tags", "|").alias("tags")).agg(F.count(F.lit(1)).alias("n_lines"))


def nested_feed(spark: SparkSession, d: str) -> DataFrame:
    """Entries of a feed of events by key, each with entries by key."""
    sums = table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    entry = F.struct(F.col("l_partkey").cast("string").alias("k"), F.struct(F.lit(" ").alias("TN"), F.concat(F.lit("team "), F.col("l_partkey").cast("string")).alias("TC"), F.col("q").cast("long").alias("M")).alias("v"))
    by_order = sums.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(entry)).alias("ED"))
    event = F.struct(F.struct(F.col("l_orderkey").cast("string").alias("ID")).alias("E"), "ED")
    feed = by_order.select((F.col("l_orderkey") % 7).alias("feed"), F.to_json(F.create_map(F.concat(F.lit("e"), F.col("l_orderkey").cast("string")), event)).alias("body"))
    rows = documents.nested_entries(feed, "body", "E: STRUCT<ID: STRING>", "ED", "TN: STRING, TC: STRING, M: BIGINT")
    return rows.select("feed", "event_key", F.col("event.E.ID").cast("long").alias("l_orderkey"), F.col("entry_key").cast("long").alias("l_partkey"), documents.first_known(F.col("entry.TN"), F.col("entry.TC")).alias("team"), F.col("entry.M").alias("quantity"))


def found_rows(spark: SparkSession, d: str) -> DataFrame:
    """Relay rows found at any depth of a payload; each line lies in it twice."""
    one = F.struct(F.col("l_partkey").alias("id"), F.array(F.lit("x")).alias("athletes"), F.concat(F.lit("t"), F.col("l_suppkey").cast("string")).alias("teamName"), F.col("l_quantity").alias("mark"), F.col("l_linenumber").alias("place"))
    # each line is written once, for both places
    rows = F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(one)), ","), F.lit("]"))
    body = F.concat(F.lit('{"page":{"groups":[{"rows":'), rows, F.lit('}]},"other":{"again":'), rows, F.lit("}}"))
    payloads = table(spark, d, "lineitem").groupBy("l_orderkey").agg(body.alias("body"))
    found = documents.relay_rows(payloads, "body", "id BIGINT, teamName STRING, mark DOUBLE, place INT")
    return found.select("l_orderkey", F.col("row.id").alias("part"), F.col("row.teamName").alias("team"), F.col("row.mark").alias("mark"), F.col("row.place").alias("place"))


def record_set(spark: SparkSession, d: str) -> DataFrame:
    """Properties of events, as a record set of two rows each."""
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("["), F.col("props"), F.lit(',{"k":null}]')).alias("records"))
    return documents.record_set(e, "records", "k: INT")


def combined_events(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order and supplier group: shipped ones are components, open ones totals; rounds by return flag."""
    rows = table(spark, d, "lineitem").withColumn("athlete", F.nullif(F.col("l_suppkey") % 3, F.lit(0))).withColumn("round", F.when(F.col("l_returnflag") == "A", "Finals").when(F.col("l_returnflag") == "N", "Semifinals").otherwise("Preliminaries"))
    rows = rows.withColumn("row_id", F.col("l_linenumber") * 1000000 + F.col("l_partkey"))
    out = combined.collapse(rows, ["l_orderkey", "athlete"], F.col("l_linestatus") == "O", marks.round_priority(F.col("round")), "l_quantity", "l_linenumber", "row_id", ["round"])
    return out.select("l_orderkey", "athlete", "total_id", F.array_join(F.transform("components", lambda c: c["row_id"].cast("string")), "|").alias("components"))


QUERIES = {
    "X17_X18_X19_event_names": event_labels,
    "X20_S19_unmapped_names": unmapped_names,
    "X35_printed_dates": printed_dates,
    "X36_mentioned_dates": mentioned_dates,
    "X37_meet_states": meet_states,
    "X38_meet_kinds": meet_kinds,
    "S4_relay_pages": page_tables,
    "S5_event_pages": event_pages,
    "S6_summary_pages": summary_pages,
    "S7_S9_typed_orders": typed_orders,
    "S8_nested_feed": nested_feed,
    "S10_found_rows": found_rows,
    "S13_record_set": record_set,
    "A30_combined_events": combined_events,
}

_LABELS = ["200m", "4x100m", "60m H (I)", "10,000m (O)", "400m", "High Jump", "DMR", "700m", "Egg Race Finals", "3000m SC", "5000m", "Weight Throw"]
_CODES = ["60m H", "10000m", "4x400m", "Mile", "Egg Race", "3000m SC", "Weight Throw", "300m"]

ORACLE_SQL = {
    "X17_X18_X19_event_names": f"SELECT p_partkey, ({_LABELS})[p_partkey % 12 + 1] AS label, ({_CODES})[p_partkey % 8 + 1] AS code FROM part",
    "X20_S19_unmapped_names": "SELECT p_name, count(*) AS seen_count FROM part WHERE lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_size <= 2) GROUP BY p_name",
    "X35_printed_dates": "SELECT o_orderkey, o_orderdate::DATE AS day FROM orders",
    "X36_mentioned_dates": "SELECT o_orderkey, abs(o_orderkey % 9 - 4) <= 3 AS named FROM orders",
    "X37_meet_states": """
        WITH o AS (SELECT *, o_orderdate::DATE AS a, o_orderdate::DATE + (o_orderkey % 3)::INTEGER AS b,
                          CASE WHEN o_orderpriority = '1-URGENT' THEN TIMESTAMP '1998-06-30 23:30:00' WHEN o_orderpriority = '2-HIGH' THEN TIMESTAMP '1998-06-30 22:30:00' ELSE TIMESTAMP '1998-07-01 03:30:00' END AS t FROM orders)
        SELECT o_orderpriority, o_orderstatus, CASE WHEN o_orderkey % 50 = 0 THEN 'completed' WHEN a > t::DATE THEN 'upcoming' WHEN b < t::DATE OR (b = t::DATE AND hour(t) >= 23) THEN 'completed'
               WHEN o_orderstatus <> 'P' THEN 'live' ELSE 'upcoming' END AS state, count(*) AS n FROM o GROUP BY ALL""",
    "X38_meet_kinds": """
        SELECT p_partkey, ['combined_child_candidate', 'combined_child_candidate', 'multi_only', 'preliminary', 'canonical', 'canonical'][p_partkey % 6 + 1] AS kind,
               ['bracketed_combined_events', 'championship_combined_events', 'standalone_multi_event_meet', 'preliminary_meet_record', 'regular_meet_record', 'regular_meet_record'][p_partkey % 6 + 1] AS reason FROM part""",
    "S4_relay_pages": """
        SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey::VARCHAR || '</td><td>B</td><td>A ' || l_partkey) - 1)::INTEGER AS row_no,
               l_suppkey::VARCHAR AS team_name, 'A ' || l_partkey || '|B ' || l_suppkey AS athletes FROM lineitem""",
    "S5_event_pages": """
        SELECT l_orderkey, l_linenumber AS place, l_partkey::VARCHAR AS athlete_name, l_suppkey::VARCHAR AS team_name, CASE WHEN l_linestatus = 'F' THEN 'Finals' ELSE 'Preliminaries' END AS round,
               CASE WHEN l_returnflag = 'R' THEN 'DNS' ELSE l_quantity::INTEGER || '.50m' END AS mark_raw FROM lineitem""",
    "S6_summary_pages": """
        SELECT l_orderkey, l_linenumber AS place, CASE WHEN l_linenumber % 2 = 1 THEN l_partkey::VARCHAR END AS athlete_id, 'Part ' || l_partkey AS athlete_name, 'Team & ' || l_suppkey AS team_name, l_quantity AS points
        FROM lineitem WHERE l_returnflag <> 'R'""",
    "S7_S9_typed_orders": """
        SELECT o_orderkey, o_custkey, o_orderpriority || '|' || o_orderstatus AS tags, count(*) AS n_lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY ALL""",
    "S8_nested_feed": """
        SELECT l_orderkey % 7 AS feed, 'e' || l_orderkey AS event_key, l_orderkey, l_partkey, 'team ' || l_partkey AS team, sum(l_quantity)::BIGINT AS quantity FROM lineitem GROUP BY l_orderkey, l_partkey""",
    "S10_found_rows": "SELECT DISTINCT l_orderkey, l_partkey AS part, 't' || l_suppkey AS team, l_quantity AS mark, l_linenumber AS place FROM lineitem",
    "S13_record_set": "SELECT event_id, regexp_extract(props, '[0-9]+')::INTEGER AS k FROM events UNION ALL SELECT event_id, NULL FROM events",
    "A30_combined_events": """
        WITH r AS (SELECT l_orderkey, l_suppkey % 3 AS athlete, l_linestatus = 'O' AS total, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 200 END AS prio, l_quantity AS q, l_linenumber AS place,
                          l_linenumber * 1000000 + l_partkey AS row_id FROM lineitem WHERE l_suppkey % 3 <> 0),
        b AS (SELECT *, min(prio) FILTER (NOT total) OVER (PARTITION BY l_orderkey, athlete) AS best,
                     row_number() OVER (PARTITION BY l_orderkey, athlete, total ORDER BY prio, q DESC, place, row_id) AS rn FROM r)
        SELECT l_orderkey, athlete, min(row_id) FILTER (total AND rn = 1) AS total_id, coalesce(string_agg(row_id::VARCHAR, '|' ORDER BY row_id) FILTER (NOT total AND prio = best), '') AS components
        FROM b GROUP BY l_orderkey, athlete""",
}
