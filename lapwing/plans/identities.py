"""Identities by evidence and reviewed plans on the star schema: customers stand for athletes, nations for schools, orders for meets, lines for results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.operators import evidence, matching, reviews, upsert
from lapwing.sources.tables import table


def _meets(spark: SparkSession, d: str, status: str, p: str) -> DataFrame:
    o = table(spark, d, "orders").where(F.col("o_orderstatus") == status).withColumn("day", F.to_date("o_orderdate"))
    pick = lambda values, by: F.get(F.array(*[F.lit(v) for v in values]), (F.col(by) % len(values)).cast("int"))
    return o.select(
        F.col("o_orderkey").alias(f"{p}_id"), pick(["spring open", "open", "spring open relays", "invite"], "o_orderkey").alias(f"{p}_name"), pick(["austin tx", "austin", None], "o_custkey").alias(f"{p}_place"),
        F.col("day").alias(f"{p}_start"), F.date_add("day", (F.col("o_orderkey") % 3).cast("int")).alias(f"{p}_end"),
    )


def scored_meets(spark: SparkSession, d: str) -> DataFrame:
    """The best finished order for each pending one, by name, place and dates."""
    return evidence.scored_meets(_meets(spark, d, "P", "f"), _meets(spark, d, "F", "k"))


def name_likeness(spark: SparkSession, d: str) -> DataFrame:
    """Likeness of each part's name and type to those of the part beside it, where it is 0.35 or more."""
    name = F.lower(F.concat_ws(" ", "p_name", "p_type"))
    p = table(spark, d, "part").select("p_partkey", name.alias("a"))
    beside = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"))
    return p.join(beside, "p_partkey").select("p_partkey", F.round(evidence.name_likeness(F.col("a"), F.col("b")), 6).alias("likeness")).where("likeness >= 0.35")


def prefix_teams(spark: SparkSession, d: str) -> DataFrame:
    """A customer for each supplier by source key with nation, by source key alone, by whole name, by the first words of one name only."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", (F.col("c_custkey") % 2).cast("string").alias("g"), F.format_string("n%d b%d k%d", "c_nationkey", F.col("c_custkey") % 40, "c_custkey").alias("name"))
    s = table(spark, d, "supplier").withColumn("g", (F.col("s_suppkey") % 2).cast("string"))
    key = lambda *cols: F.concat_ws("|", *[x.cast("string") for x in cols])
    tiers = [
        ("state_key", key(F.col("s_nationkey"), F.col("s_suppkey") * 3, F.col("g")), matching.unique_lookup(c, key(F.col("c_nationkey"), F.col("c_custkey"), F.col("g")), "c_custkey")),
        ("exact_name", key(F.format_string("n%d b%d k%d", "s_nationkey", F.col("s_suppkey") % 40, "s_suppkey"), F.col("g")), matching.unique_lookup(c, key(F.col("name"), F.col("g")), "c_custkey")),
        ("unique_prefix", key(F.format_string("n%d b%d", "s_nationkey", F.col("s_suppkey") % 40), F.col("g")), evidence.prefix_lookup(c, "name", "g", "c_custkey")),
    ]
    return matching.resolve_by_tiers(s, tiers).select("s_suppkey", "resolved", "method")


def source_identities(spark: SparkSession, d: str) -> DataFrame:
    """The supplier of a part by return flag: returned lines are reviewed links, accepted ones direct profiles."""
    kind = F.when(F.col("l_returnflag") == "R", "verified_alias").when(F.col("l_returnflag") == "A", "direct_profile").otherwise("guess")
    return evidence.source_identity(table(spark, d, "lineitem").withColumn("kind", kind), "l_partkey", "kind", "l_suppkey")


def corroborated_people(spark: SparkSession, d: str) -> DataFrame:
    """A customer for each supplier by name and gender, backed by nation, by team or by meet."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    gender = lambda k: (F.col(k) % 2).cast("int")
    people = c.select(F.col("c_custkey").alias("person"), (F.col("c_custkey") % 60).alias("name"), gender("c_custkey").alias("gender"), F.col("c_nationkey").alias("person_school"))
    facts = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("fact_id"), (F.col("s_suppkey") % 60).alias("name"), gender("s_suppkey").alias("gender"), F.when(F.col("s_suppkey") % 5 > 0, F.col("s_nationkey")).alias("school"), (F.col("s_suppkey") % 40).alias("team"), (F.col("s_suppkey") % 7).alias("meet")
    )
    played = o.select(F.col("o_custkey").alias("person"), (F.col("o_orderkey") % 40).alias("team"), (F.col("o_orderkey") % 7).alias("meet"))
    return evidence.corroborated(facts, people, ["name", "gender"], played, played)


def roster_plan(spark: SparkSession, d: str) -> DataFrame:
    """Orders as roster rows by customer and year, counted by plan and reason."""
    o = table(spark, d, "orders")
    rows = o.select(
        F.concat_ws("|", F.col("o_custkey").cast("string"), F.year("o_orderdate").cast("string")).alias("source_key"), F.when(F.col("o_orderkey") % 11 == 0, "x").otherwise("y").alias("hash"), F.col("o_custkey").alias("outside_id"),
        (F.col("o_custkey") % 30).alias("school"), (F.col("o_custkey") % 2).cast("int").alias("gender"), F.year("o_orderdate").alias("season"),
    )
    c = table(spark, d, "customer")
    twice = c.unionByName(c.where("c_custkey % 13 = 0")).where("c_custkey % 17 > 0")
    athletes = twice.select(F.col("c_custkey").alias("outside_id"), F.col("c_custkey").alias("athlete"), F.when(F.col("c_custkey") % 19 > 0, (F.col("c_custkey") % 2).cast("int")).otherwise(7).alias("athlete_gender"))
    n = table(spark, d, "nation").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("gender"))
    teams = n.select(F.col("n_nationkey").cast("long").alias("school"), "gender", (F.col("n_nationkey") * 2 + F.col("gender")).alias("team"), F.when(F.col("n_nationkey") % 6 > 0, "collegiate").otherwise("club").alias("kind"))
    members = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("school"), F.lit(1993).alias("first_season"), F.when(F.col("n_nationkey") % 2 == 0, 1996).alias("last_season"))
    known = rows.where("season = 1995").select("source_key", "outside_id").distinct().select("source_key", F.when(F.col("outside_id") % 4 == 0, F.col("outside_id") + 1).otherwise(F.col("outside_id")).alias("known_athlete"), F.lit("y").alias("known_hash"))
    return reviews.roster_plan(rows, athletes, teams, members, known).groupBy("plan", "reason").agg(F.count(F.lit(1)).alias("n"))


def recovery_queue(spark: SparkSession, d: str) -> DataFrame:
    """Orders as meets: finished lines are individual results, open ones relays, returned lines of high tax open cases."""
    o, lines = table(spark, d, "orders"), table(spark, d, "lineitem").withColumn("meet", F.col("l_orderkey"))
    meets = o.select(F.col("o_orderkey").alias("meet"), (F.col("o_orderpriority") != "5-LOW").alias("source_known"))
    prior = o.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("meet"), F.lit("absent").alias("relay_coverage"))
    return reviews.refresh_queue(meets, lines.where("l_linestatus = 'F'"), lines.where("l_linestatus = 'O'"), lines.where("l_returnflag = 'R' AND l_tax > 0.07"), prior)


def merge_plan(spark: SparkSession, d: str) -> DataFrame:
    """Customers with a small balance, to be merged into the one three numbers on; their orders are results."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    url = F.when(F.col("c_custkey") % 5 == 0, F.format_string("u%d", F.floor(F.col("c_custkey") / 40))).when(F.col("c_custkey") % 5 == 1, F.format_string("v%d", "c_custkey"))
    people = c.select(F.col("c_custkey").alias("person"), (F.col("c_nationkey") % 2).alias("gender"), (F.col("c_nationkey") % 3).alias("name"), url.alias("profile"))
    decisions = c.where("c_acctbal < 4000").select(F.col("c_custkey").alias("old"), F.when(F.col("c_custkey") % 21 == 0, F.col("c_custkey")).otherwise(F.col("c_custkey") + 3).alias("target"))
    results = o.select(F.col("o_custkey").alias("person"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("event"), F.col("o_orderstatus").alias("mark"))
    return reviews.merge_plan(decisions, people, results, ["event", "mark"])


def grouped_cases(spark: SparkSession, d: str) -> DataFrame:
    """Returned lines by part and supplier, with the fields in which they differ."""
    return reviews.consistent_groups(table(spark, d, "lineitem").where("l_returnflag = 'R'"), ["l_partkey"], ["l_suppkey", "l_linestatus", "l_linenumber"])


def empty_twins(spark: SparkSession, d: str) -> DataFrame:
    """Customers without a finished or an urgent order whose nation and segment a customer with finished orders shares."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders").withColumnRenamed("o_custkey", "person")
    people = c.select(F.col("c_custkey").alias("person"), F.concat_ws("|", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("name"))
    return reviews.empty_twins(people, "name", o.where("o_orderstatus = 'F'"), [o.where("o_orderpriority = '1-URGENT'")]).select("person", "name")


def backfilled_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines without a supplier (tax 0): the part's only other supplier is filled in, or the line goes where its order has that part and supplier already."""
    lines = table(spark, d, "lineitem").withColumn("supplier", F.when(F.col("l_tax") > 0, F.col("l_suppkey")))
    known = matching.unique_lookup(lines.where("l_returnflag = 'A'"), F.col("l_partkey"), "supplier")
    filled = lines.where("supplier IS NULL").drop("supplier").join(known.withColumnRenamed("value", "supplier"), F.col("l_partkey") == F.col("key"))
    out = upsert.move_or_delete(filled.select("l_orderkey", "l_linenumber", "l_partkey", "supplier"), lines.where("supplier IS NOT NULL"), ["l_orderkey", "l_partkey", "supplier"])
    return out.select("l_orderkey", "l_linenumber", "supplier", "action")


def named_people(spark: SparkSession, d: str) -> DataFrame:
    """A customer for each supplier by number, backed by a distinctive word of the segment."""
    school = F.get(F.array(F.lit("Austin State"), F.lit("Boston Col."), F.lit("State University"), F.lit("St. Olaf's")), (F.col("c_custkey") % 4).cast("int"))
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("person"), (F.col("c_custkey") % 600).alias("name"), school.alias("school"))
    team = F.get(F.array(F.lit("Univ of AUSTIN"), F.lit("Boston"), F.lit("The State University"), F.lit(None).cast("string"), F.lit("olafs")), (F.col("s_suppkey") % 5).cast("int"))
    facts = table(spark, d, "supplier").select(F.col("s_suppkey").alias("fact_id"), (F.col("s_suppkey") * 7).alias("name"), team.alias("team"))
    return evidence.by_name_and_school(facts, people, ["name"])


def backed_names(spark: SparkSession, d: str) -> DataFrame:
    """Customers whose balance in whole units one supplier alone has, if one of their orders has a line of that supplier."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.floor(F.col("c_acctbal") / 10).alias("name"))
    targets = table(spark, d, "supplier").select(F.col("s_suppkey").alias("target"), F.floor(F.col("s_acctbal") / 10).alias("name"))
    backing = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("row_id"), F.col("l_suppkey").alias("target"))
    return evidence.backed_unique_names(rows, targets, "name", backing)


def host_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Orders as meets, hosted by their customer's nation: real if a supplier of a line is of that nation."""
    meets = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("meet"), F.nullif("c_nationkey", F.lit(0)).alias("host"))
    schools = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("meet"), F.nullif("s_nationkey", F.lit(1)).alias("state"))
    return evidence.host_verdicts(meets, schools).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def profile_matches(spark: SparkSession, d: str) -> DataFrame:
    """The best customer profile for each supplier of one nation: names by number, schools by segment."""
    names = ["ann lee", "ann marie lee", "lee", "bo"]
    pick = lambda c: F.get(F.array(*[F.lit(n) for n in names]), (F.col(c) % 4).cast("int"))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", pick("c_custkey").alias("theirs"))
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", pick("s_suppkey").alias("ours"))
    c = evidence.distinct_profiles(c.withColumn("college", F.col("c_custkey") % 3 == 0), "c_custkey", ["c_nationkey", "c_mktsegment", "theirs", "college"])
    pairs = s.join(c, F.col("s_nationkey") == F.col("c_nationkey"))
    school = (F.col("s_suppkey") % 2 == 0) & (F.col("c_mktsegment") == "BUILDING")
    return evidence.profile_matches(pairs, "s_suppkey", "c_custkey", F.col("ours"), F.col("theirs"), school, F.col("college"))


def region_labels(spark: SparkSession, d: str) -> DataFrame:
    """Nations by an inline table of region labels."""
    values = spark.createDataFrame([(0, "south"), (1, "west"), (2, "east")], "n_regionkey int, label string")
    return table(spark, d, "nation").join(values, "n_regionkey").select("n_nationkey", "label")


QUERIES = {
    "J18_scored_meets": scored_meets,
    "J23_name_likeness": name_likeness,
    "J25_prefix_teams": prefix_teams,
    "J26_source_identities": source_identities,
    "J27_corroborated_people": corroborated_people,
    "J28_named_people": named_people,
    "J29_profile_matches": profile_matches,
    "J31_backed_names": backed_names,
    "M7_roster_plan": roster_plan,
    "M9_recovery_queue": recovery_queue,
    "M12_M13_backfilled_lines": backfilled_lines,
    "M14_empty_twins": empty_twins,
    "M16_host_verdicts": host_verdicts,
    "M17_merge_plan": merge_plan,
    "M21_grouped_cases": grouped_cases,
    "S14_region_labels": region_labels,
}

_MEET = "SELECT o_orderkey AS id, ['spring open', 'open', 'spring open relays', 'invite'][o_orderkey % 4 + 1] AS name, ['austin tx', 'austin', NULL][o_custkey % 3 + 1] AS place, o_orderdate::DATE AS a, o_orderdate::DATE + (o_orderkey % 3)::INTEGER AS b FROM orders WHERE o_orderstatus = '{}'"

ORACLE_SQL = {
    "J18_scored_meets": f"""
        WITH f AS ({_MEET.format("P")}), k AS ({_MEET.format("F")}),
        p AS (SELECT f.id AS f_id, k.id AS k_id, CASE WHEN f.name = k.name THEN 80 WHEN contains(f.name, k.name) OR contains(k.name, f.name) THEN 45 ELSE 0 END
                     + CASE WHEN f.place = k.place THEN 30 WHEN contains(f.place, k.place) OR contains(k.place, f.place) THEN 15 ELSE 0 END
                     + CASE WHEN f.a <= k.b AND k.a <= f.b THEN 25 ELSE 0 END + CASE WHEN f.a = k.a THEN 10 ELSE 0 END + CASE WHEN f.b = k.b THEN 10 ELSE 0 END AS score
              FROM f JOIN k ON k.a <= f.b + 3 AND f.a <= k.b + 3)
        SELECT f_id, k_id, score FROM (SELECT *, row_number() OVER (PARTITION BY f_id ORDER BY score DESC, k_id) AS rn FROM p WHERE score >= 100) WHERE rn = 1""",
    "J23_name_likeness": """
        WITH p AS (SELECT p_partkey, lower(p_name || ' ' || p_type) AS a FROM part), q AS (SELECT x.p_partkey, x.a, y.a AS b FROM p x JOIN p y ON y.p_partkey = x.p_partkey + 1),
        v AS (SELECT p_partkey, unnest(string_split(a, ' ')) AS w, b FROM q),
        m AS (SELECT p_partkey, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM (SELECT unnest(string_split(v.b, ' ')) AS u) t WHERE length(u) > 2 AND (contains(w, u) OR contains(u, w)))) AS met FROM v WHERE length(w) > 2 GROUP BY 1),
        s AS (SELECT p_partkey, round(CASE WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN 0.85 ELSE met / greatest(n, len(list_filter(string_split(b, ' '), lambda x: length(x) > 2)))::DOUBLE END, 6)::DOUBLE AS likeness FROM q JOIN m USING (p_partkey))
        SELECT * FROM s WHERE likeness >= 0.35""",
    "J25_prefix_teams": """
        WITH c AS (SELECT c_custkey, c_nationkey AS n, c_custkey % 2 AS g, c_custkey % 40 AS b FROM customer),
        p AS (SELECT n, b, g, min(c_custkey) AS c_custkey FROM c GROUP BY ALL HAVING count(*) = 1)
        SELECT s_suppkey, coalesce(x.c_custkey, y.c_custkey, p.c_custkey) AS resolved, CASE WHEN x.c_custkey IS NOT NULL THEN 'state_key' WHEN y.c_custkey IS NOT NULL THEN 'exact_name' WHEN p.c_custkey IS NOT NULL THEN 'unique_prefix' END AS method
        FROM supplier LEFT JOIN c x ON x.c_custkey = s_suppkey * 3 AND x.n = s_nationkey AND x.g = s_suppkey % 2 LEFT JOIN c y ON y.c_custkey = s_suppkey AND y.n = s_nationkey
        LEFT JOIN p ON p.n = s_nationkey AND p.b = s_suppkey % 40 AND p.g = s_suppkey % 2""",
    "J26_source_identities": """
        WITH r AS (SELECT l_partkey, count(*) FILTER (l_returnflag = 'R') > 0 AS reviewed, list(DISTINCT l_suppkey) FILTER (l_returnflag = 'R') AS x, list(DISTINCT l_suppkey) FILTER (l_returnflag = 'A') AS y FROM lineitem GROUP BY 1),
        e AS (SELECT l_partkey, reviewed, CASE WHEN reviewed THEN x ELSE y END AS v FROM r)
        SELECT l_partkey, CASE WHEN len(v) = 1 THEN 'resolved' ELSE 'conflict' END AS status, CASE WHEN len(v) = 1 THEN v[1] END AS l_suppkey, CASE WHEN len(v) = 1 THEN CASE WHEN reviewed THEN 'reviewed_identity' ELSE 'direct_profile' END END AS method FROM e""",
    "J27_corroborated_people": """
        WITH f AS (SELECT s_suppkey AS fact_id, s_suppkey % 60 AS name, CASE WHEN s_suppkey % 5 > 0 THEN s_nationkey END AS school, s_suppkey % 40 AS team, s_suppkey % 7 AS meet FROM supplier),
        m AS (SELECT f.*, c_custkey AS person, school IS NULL OR school = c_nationkey AS s, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 40 = team) AS t,
                     EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 7 = meet) AS e FROM f JOIN customer ON c_custkey % 60 = name),
        g AS (SELECT fact_id, school, count(*) FILTER (s) AS ns, count(*) FILTER (t) AS nt, count(*) FILTER (s AND e) AS ne, min(person) FILTER (s) AS ps, min(person) FILTER (t) AS pt, min(person) FILTER (s AND e) AS pe FROM m GROUP BY ALL)
        SELECT fact_id, CASE WHEN ns = 1 THEN ps WHEN ns = 0 THEN pt ELSE pe END AS person,
               CASE WHEN ns = 1 THEN CASE WHEN school IS NULL THEN 'exact_unique_name_gender' ELSE 'exact_name_gender_school' END WHEN ns = 0 THEN 'exact_name_gender_team_participation' ELSE 'exact_name_gender_school_meet_participation' END AS match_field
        FROM g WHERE ns = 1 OR (ns = 0 AND nt = 1) OR (ns > 1 AND school IS NOT NULL AND ne = 1)""",
    "J28_named_people": """
        WITH m AS (SELECT s_suppkey AS fact_id, c_custkey AS person, CASE s_suppkey % 5 WHEN 0 THEN c_custkey % 4 = 0 WHEN 1 THEN c_custkey % 4 = 1 WHEN 4 THEN c_custkey % 4 = 3 ELSE FALSE END AS backed
                   FROM supplier LEFT JOIN customer ON c_custkey % 600 = s_suppkey * 7),
        n AS (SELECT fact_id, count(person) AS n, count(*) FILTER (person IS NOT NULL AND backed) AS k, min(person) FILTER (backed) AS p FROM m GROUP BY 1)
        SELECT fact_id, CASE WHEN k = 1 THEN p END AS person, CASE WHEN n = 0 THEN 'no_name_match' WHEN k = 1 THEN 'name_school' WHEN k > 1 THEN 'ambiguous_school' WHEN n = 1 THEN 'no_school_corroboration' ELSE 'ambiguous_name' END AS reason FROM n""",
    "J29_profile_matches": """
        WITH p AS (SELECT s_suppkey, c_custkey, s_suppkey % 4 AS a, c_custkey % 4 AS b, s_suppkey % 2 = 0 AND c_mktsegment = 'BUILDING' AS school, c_custkey % 3 = 0 AS college FROM supplier JOIN customer ON s_nationkey = c_nationkey),
        m AS (SELECT *, CASE WHEN a = b THEN 50 ELSE 30 END + CASE WHEN school THEN 50 ELSE 0 END + CASE WHEN college THEN 10 ELSE 0 END AS score FROM p WHERE a = b OR (a < 3 AND b < 3))
        SELECT s_suppkey, c_custkey, score, CASE WHEN school THEN 'high' WHEN a = b THEN 'medium' ELSE 'low' END AS confidence, a = b AND NOT school AS possible_transfer
        FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY score DESC, c_custkey) AS rn FROM m) WHERE rn = 1""",
    "S14_region_labels": "SELECT n_nationkey, label FROM nation JOIN (VALUES (0, 'south'), (1, 'west'), (2, 'east')) v(k, label) ON n_regionkey = k",
    "J31_backed_names": """
        WITH u AS (SELECT floor(s_acctbal / 10) AS name, min(s_suppkey) AS target FROM supplier GROUP BY 1 HAVING count(*) = 1)
        SELECT c_custkey AS row_id, target FROM customer JOIN u ON name = floor(c_acctbal / 10) WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey = c_custkey AND l_suppkey = target)""",
    "M7_roster_plan": """
        WITH r AS (SELECT o_custkey AS c, year(o_orderdate) AS y, bool_or(o_orderkey % 11 = 0) AS x, bool_or(o_orderkey % 11 <> 0) AS z FROM orders GROUP BY 1, 2),
        d AS (SELECT *, CASE WHEN x AND z THEN 'conflicting_rows_for_source_key' WHEN c % 17 = 0 THEN 'canonical_athlete_missing' WHEN c % 13 = 0 THEN 'ambiguous_outside_id' WHEN c % 19 = 0 THEN 'athlete_gender_conflict'
                     WHEN c % 30 >= 25 THEN 'canonical_team_missing' WHEN c % 30 % 6 = 0 THEN 'school_not_collegiate' WHEN y < 1993 OR (c % 30 % 2 = 0 AND y > 1996) THEN 'collegiate_membership_not_verified_for_season'
                     WHEN y = 1995 AND c % 4 = 0 THEN 'existing_evidence_identity_conflict' WHEN y = 1995 AND x THEN 'source_payload_changed' END AS held FROM r)
        SELECT CASE WHEN held IS NOT NULL THEN 'held' WHEN y = 1995 THEN 'replayed' ELSE 'ready' END AS plan, coalesce(held, CASE WHEN y = 1995 THEN 'exact_replay' END) AS reason, count(*) AS n FROM d GROUP BY ALL""",
    "M9_recovery_queue": """
        WITH k AS (SELECT o_orderkey AS meet, o_orderpriority <> '5-LOW' AS s, o_orderkey % 5 = 0 AS absent, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F') AS n_individual,
                          (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O') AS n_relay, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_tax > 0.07) AS n_open
                   FROM orders),
        n AS (SELECT *, n_individual = 0 AS needs_individual, n_relay = 0 AND NOT absent AS needs_relays, CASE WHEN n_individual = 0 AND n_relay = 0 THEN 'empty' WHEN n_individual = 0 THEN 'relay_only' WHEN n_relay = 0 THEN 'individual_only' ELSE 'covered' END AS coverage FROM k)
        SELECT meet, coverage, needs_individual, needs_relays, n_individual, n_relay, n_open, CASE coverage WHEN 'empty' THEN 10 WHEN 'relay_only' THEN 20 WHEN 'individual_only' THEN 30 ELSE 100 END AS priority,
               CASE WHEN n_open > 0 THEN 'partial' WHEN NOT needs_individual AND NOT needs_relays THEN 'complete' WHEN NOT s THEN 'blocked' ELSE 'queued' END AS status FROM n""",
    "M12_M13_backfilled_lines": """
        WITH k AS (SELECT l_partkey, min(l_suppkey) AS supplier FROM lineitem WHERE l_returnflag = 'A' AND l_tax > 0 GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1)
        SELECT l_orderkey, l_linenumber, supplier, CASE WHEN EXISTS (SELECT 1 FROM lineitem o WHERE o.l_tax > 0 AND o.l_orderkey = l.l_orderkey AND o.l_partkey = l.l_partkey AND o.l_suppkey = supplier) THEN 'delete' ELSE 'move' END AS action
        FROM lineitem l JOIN k USING (l_partkey) WHERE l_tax <= 0""",
    "M14_empty_twins": """
        WITH c AS (SELECT c_custkey AS person, c_nationkey || '|' || c_mktsegment AS name, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS f,
                          EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS u FROM customer)
        SELECT person, name FROM c WHERE NOT f AND NOT u AND name IN (SELECT name FROM c WHERE f)""",
    "M16_host_verdicts": """
        WITH m AS (SELECT o_orderkey, nullif(c_nationkey, 0) AS host FROM orders JOIN customer ON o_custkey = c_custkey),
        v AS (SELECT o_orderkey, max(CASE WHEN s_nationkey IS NULL OR s_nationkey = 1 OR host IS NULL THEN NULL WHEN s_nationkey = host THEN 1 ELSE 0 END) AS same FROM m LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1)
        SELECT CASE same WHEN 1 THEN 'real' WHEN 0 THEN 'copy' END AS verdict, count(*) AS n FROM v GROUP BY 1""",
    "M17_merge_plan": """
        WITH p AS (SELECT c_custkey AS person, c_nationkey % 2 AS g, c_nationkey % 3 AS m, CASE WHEN c_custkey % 5 = 0 THEN 'u' || (c_custkey // 40) WHEN c_custkey % 5 = 1 THEN 'v' || c_custkey END AS url FROM customer),
        d AS (SELECT c_custkey AS old, CASE WHEN c_custkey % 21 = 0 THEN c_custkey ELSE c_custkey + 3 END AS target FROM customer WHERE c_acctbal < 4000),
        r AS (SELECT d.*, CASE WHEN t.person IS NULL THEN 'athlete_not_found' WHEN old = target THEN 'same_athlete' WHEN o.g <> t.g THEN 'gender_mismatch' WHEN o.m <> t.m THEN 'name_mismatch' WHEN t.url <> coalesce(o.url, '') THEN 'target_has_different_profile_url'
                     WHEN (SELECT count(*) FROM p WHERE p.url = o.url AND p.person NOT IN (old, target)) > 0 THEN 'profile_url_has_other_owner' END AS reason
              FROM d LEFT JOIN p o ON o.person = old LEFT JOIN p t ON t.person = target),
        x AS (SELECT old, target, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = target AND b.o_orderpriority = a.o_orderpriority AND b.o_orderstatus = a.o_orderstatus)) AS k
              FROM r JOIN orders a ON a.o_custkey = old WHERE reason IS NULL GROUP BY ALL)
        SELECT old, target, CASE WHEN reason IS NULL THEN 'merge' ELSE 'hold' END AS action, coalesce(reason, 'reviewed_duplicate_identity') AS reason,
               CASE WHEN reason IS NULL THEN coalesce(n - k, 0) END AS n_move, CASE WHEN reason IS NULL THEN coalesce(k, 0) END AS n_delete FROM r LEFT JOIN x USING (old, target)""",
    "M21_grouped_cases": """
        SELECT l_partkey, count(*) AS n, min(l_suppkey) AS l_suppkey, min(l_linestatus) AS l_linestatus, min(l_linenumber) AS l_linenumber,
               concat_ws(',', CASE WHEN count(DISTINCT l_suppkey) > 1 THEN 'l_suppkey' END, CASE WHEN count(DISTINCT l_linestatus) > 1 THEN 'l_linestatus' END, CASE WHEN count(DISTINCT l_linenumber) > 1 THEN 'l_linenumber' END) AS conflicts
        FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey""",
}
