"""Rows that joins put out, where tables hold many rows alike: they follow the distinct forms, not the square of the copies."""

import datetime

from pyspark.sql import functions as F

from lapwing.operators import evidence, fuzzy, races
from lapwing.plans import identities, relations
from lapwing.sources import html


def most_joined(df, kind="Join", metric="numOutputRows"):
    """Rows of df, and the most rows that one of its joins puts out, or that one node of another kind has by its metric."""
    rows, most, todo = df.collect(), 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif kind in name:
            most = max(most, node.metrics().apply(metric).value())
        todo.extend(node.children().apply(i) for i in range(node.children().size()))
    return rows, most


def test_scored_meets_meet_by_forms(spark):
    d = datetime.date(2026, 3, 1)
    side = lambda p, n: spark.range(n).select((F.col("id") + 5).alias(f"{p}_id"), F.lit("open").alias(f"{p}_name"), F.when(F.col("id") % 2 == 0, "austin").alias(f"{p}_place"), F.lit(d).alias(f"{p}_start"), F.lit(d).alias(f"{p}_end"))
    rows, most = most_joined(evidence.scored_meets(side("f", 300), side("k", 300)))
    assert sorted(map(tuple, rows)) == [(i, 5, 155 if i % 2 else 125) for i in range(5, 305)] and most <= 300


def test_profiles_meet_by_forms(spark, tmp_path):
    spark.range(600).select(F.col("id").alias("c_custkey"), F.lit(1).alias("c_nationkey"), F.lit("BUILDING").alias("c_mktsegment")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(600).select(F.col("id").alias("s_suppkey"), F.lit(1).alias("s_nationkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    rows, most = most_joined(identities.profile_matches(spark, str(tmp_path)))
    best = {0: 0, 1: 9, 2: 6, 3: 3}  # the least college customer of the same name
    assert {(r.s_suppkey, r.c_custkey, r.score) for r in rows} == {(i, best[i % 4], 60 + 50 * (i % 2 == 0)) for i in range(600)} and most <= 600 * 8


def test_people_are_corroborated_by_sums(spark):
    facts = spark.range(300).select(F.col("id").alias("fact_id"), F.lit("a").alias("name"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("school"), F.lit(4).alias("team"), F.col("id").alias("meet"))
    people = spark.range(400).select(F.col("id").alias("person"), F.lit("a").alias("name"), (F.col("id") % 2 * 7 + 1).alias("person_school"))
    team = spark.createDataFrame([(17, 4), (17, 4)], "person long, team int")
    meet = spark.createDataFrame([(2, 1), (3, 1), (4, 4), (6, 4), (8, 7), (9, 8)], "person long, meet long")
    rows, most = most_joined(evidence.corroborated(facts, people, ["name"], team, meet))
    # school 1 has 200 people: one of them at meets 1 and 7, two at 4; school 2 has none, so the team's starter stands; facts without a school meet 400 people
    want = [(1, 2, "exact_name_gender_school_meet_participation"), (7, 8, "exact_name_gender_school_meet_participation")]
    want += [(i, 17, "exact_name_gender_team_participation") for i in range(300) if i % 3 == 2]
    assert sorted(map(tuple, rows)) == sorted(want) and most <= 400


def test_segments_stay_out_of_the_driver(spark):
    one = spark.range(1).select(F.concat(F.lit("ann lee mari"), F.char(F.col("id") + 101)).alias("name"))
    df = fuzzy.close_names(one, one)
    assert df.collect() == [("ann lee marie", "ann lee marie")] and "SortMergeJoin" in df._jdf.queryExecution().executedPlan().toString()


def test_people_meet_by_team(spark, monkeypatch):
    # 120 names with the same last word, each of a team of its own: pairs of names alone are asked for only where they are enough
    letters = lambda seed: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda k: F.char(F.pmod(F.xxhash64("id", k, F.lit(seed)), F.lit(26)) + 97)), "")
    side = spark.range(120).select("id", F.concat(letters(1), F.lit(" constantine")).alias("name"), letters(2).alias("team"))
    entries, people = side.select(F.col("id").alias("entry_id"), "name", "team"), side.select(F.col("id").alias("person_id"), F.regexp_replace("name", "constantine", "constantina").alias("full_name"), F.col("team").alias("school"))
    plain, asked = fuzzy.close_names, []
    monkeypatch.setattr(fuzzy, "close_names", lambda left, right, *above: asked.append((round([*above, 0.7][0], 6), left.count())) or plain(left, right, *above))
    rows, most = most_joined(fuzzy.match_people(entries, people).select("entry_id", "person_id", "team_matched"))
    assert sorted(map(tuple, rows)) == [(i, i, True) for i in range(120)] and most <= 1500 and sorted(asked) == [(0.75, 0), (0.95, 120)]


def test_common_words_of_meets_do_not_meet(spark):
    side = spark.range(200).select("id", F.concat(F.lit("hill lake "), F.col("id").cast("string"), F.lit("x")).alias("name"), F.lit("ames").alias("location"), F.lit(None).cast("date").alias("first"), F.lit(None).cast("date").alias("last"))
    rows, most = most_joined(fuzzy.match_meets(side, side))
    assert sorted(map(tuple, rows)) == [(i, i, 105) for i in range(200)] and most <= 1200


def test_scores_of_meets_are_sent_on_not_pairs(spark):
    d = F.lit("2026-03-01").cast("date")
    side = lambda place: spark.range(150).select("id", F.lit("hill lake relays").alias("name"), F.concat(F.lit(place), F.col("id").cast("string"), F.lit("x")).alias("location"), d.alias("first"), F.lit(None).cast("date").alias("last"))
    # every meet scores 105 with every other: 22,500 pairs
    rows, most = most_joined(fuzzy.match_meets(side("ames "), side("reno ")), "ShuffleExchange", "shuffleRecordsWritten")
    assert sorted(map(tuple, rows)) == [(i, 0, 105) for i in range(150)] and 150 <= most <= 6000


def test_overlap_pairs_meet_by_classes(spark, tmp_path):
    day = F.to_timestamp(F.format_string("2024-01-0%d", F.col("id") % 2 + 1))
    spark.range(400).select(F.col("id").alias("o_orderkey"), F.floor(F.col("id") / 2).alias("o_custkey"), day.alias("o_orderdate"), F.lit("p").alias("o_orderpriority"), F.lit("s").alias("o_orderstatus")).write.parquet(f"{tmp_path}/orders.parquet")
    rows, most = most_joined(relations.overlap_pairs(spark, str(tmp_path)))
    assert {tuple(r) for r in rows} == {(a, b, 2) for b in range(200) for a in range(b)} and most <= len(rows)


def test_components_take_no_pairs_of_a_class(spark, tmp_path, monkeypatch):
    day = F.to_timestamp(F.format_string("2024-01-0%d", F.col("id") % 2 + 1))
    spark.range(80).select(F.col("id").alias("o_orderkey"), F.floor(F.col("id") / 2).alias("o_custkey"), day.alias("o_orderdate"), F.lit("p").alias("o_orderpriority"), F.lit("s").alias("o_orderstatus")).write.parquet(f"{tmp_path}/orders.parquet")
    plain, edges = relations.matching.components, []
    monkeypatch.setattr(relations.matching, "components", lambda pairs: edges.append(pairs.count()) or plain(pairs))
    assert {tuple(r) for r in relations.overlap_components(spark, str(tmp_path)).collect()} == {(i, 0) for i in range(40)} and edges == [0]


def mixed_orders(spark, path, customers, days):
    """Orders of one priority and status: customer c on days c * c + 7 * i, with six of them for most and many for some; customers with and without equal sets."""
    each = spark.range(customers).withColumn("i", F.explode(F.sequence(F.lit(0), F.when(F.col("id") % 31 == 30, 80).otherwise(5))))
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.floor(F.col("id") / 2) * F.floor(F.col("id") / 2) * 3 + F.col("i") * (7 + F.floor(F.col("id") / 2) % 5), F.lit(days)).cast("int"))
    rows = each.select((F.col("id") * 100 + F.col("i")).alias("o_orderkey"), F.col("id").alias("o_custkey"), day.cast("timestamp").alias("o_orderdate"), F.lit("p").alias("o_orderpriority"), F.lit("s").alias("o_orderstatus"))
    rows.write.parquet(f"{path}/orders.parquet")
    sets = {}
    for r in rows.collect():
        sets.setdefault(r.o_custkey, set()).add(r.o_orderdate)
    return sets


def test_overlaps_miss_none(spark, tmp_path):
    sets = mixed_orders(spark, tmp_path, 150, 300)
    want = {(a, b, len(sets[a] & sets[b])) for b in sets for a in range(b) if len(sets[a] & sets[b]) >= 2}
    assert max(map(len, sets.values())) > relations.MANY_KEYS and {n > 2 for _, _, n in want} == {True, False}
    assert sorted(map(tuple, relations.overlap_pairs(spark, str(tmp_path)).collect())) == sorted(want)
    root = {a: a for a in sets}
    for _ in sets:
        for a, b, _ in want:
            root[a] = root[b] = min(root[a], root[b])
    linked = {x for a, b, _ in want for x in (a, b)}
    assert {tuple(r) for r in relations.overlap_components(spark, str(tmp_path)).collect()} == {(x, root[x]) for x in linked}


def test_overlaps_meet_by_two_keys(spark, tmp_path, monkeypatch):
    # 300 customers share one day, and each has a day of its own: nobody shares two, where all met all
    spark.range(600).select(F.col("id").alias("o_orderkey"), F.floor(F.col("id") / 2).alias("o_custkey"), F.date_add(F.lit("2024-01-01").cast("date"), F.when(F.col("id") % 2 == 1, F.col("id").cast("int")).otherwise(0)).cast("timestamp").alias("o_orderdate"), F.lit("p").alias("o_orderpriority"), F.lit("s").alias("o_orderstatus")).write.parquet(f"{tmp_path}/orders.parquet")
    rows, most = most_joined(relations.overlap_pairs(spark, str(tmp_path)))
    assert rows == [] and most <= 600
    edges = []
    monkeypatch.setattr(relations.matching, "components", lambda pairs: edges.append(most_joined(pairs)) or pairs.select(F.col("a").alias("node"), F.col("b").alias("root")))
    assert relations.overlap_components(spark, str(tmp_path)).collect() == [] and edges[0][0] == [] and edges[0][1] <= 600


def test_cells_are_read_once(spark):
    pages = spark.createDataFrame([("<table><thead><tr><th>Pl</th></tr></thead><tr><td>1</td><td>a</td><td>b</td><td>c</td><td>1.50m</td></tr></table>",)], "html string")
    df = html.event_rows(pages).select("place", "mark_raw")
    assert df.collect() == [(1, "1.50m")] and df._jdf.queryExecution().optimizedPlan().toString().count("(?i)^(dns") == 1
    text = html.table_rows(pages)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert "<thead" not in text[0]  # the heads lie below the generator of rows


def test_results_go_once_to_a_block_of_partners(spark):
    day = F.lit("2026-03-01").cast("date")
    row = lambda meet, day: F.struct(meet.alias("meet"), day.alias("day"))
    alone = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda k: row(F.concat(F.lit("m"), F.col("id") * 100 + k), day))
    # athletes -20 to 43 in four stretches, each at ten meets of its own and, by turns, at one of two that they share, dated or not
    shared = F.array(row(F.concat(F.lit("all "), (F.col("id") % 8 < 4).cast("string")), F.when(F.col("id") % 2 == 0, day)))
    seen = spark.range(64).select(F.col("id") - 20, "id", F.inline(F.concat(alone, shared))).toDF("athlete", "place", "meet", "day")
    results = seen.select(F.xxhash64("athlete", "meet").alias("id"), "athlete", "meet", "day", F.lit(None).cast("string").alias("round"), (F.col("place") + 1).alias("place"), F.lit(1).alias("mark"))
    pairs = spark.range(64).select((F.col("id") - 20).alias("a")).crossJoin(spark.range(64).select((F.col("id") - 20).alias("b"))).where("a < b")
    group = lambda x: ((x + 20) % 8 < 4, x % 2)
    want = {(a, b, int(group(a) == group(b)), int(group(a) == group(b)), 0, 0) for a in range(-20, 44) for b in range(a + 1, 44)}
    rows, most = most_joined(races.head_to_head(pairs, results))
    # 704 results and 2,016 pairs: a result went to each of its 31.5 partners, 22,176 rows
    assert {tuple(r) for r in rows} == want and most <= 704 * 4
    mixed = races.head_to_head(pairs.select(F.col("a").cast("int"), F.col("b").cast("int")), results).collect()
    words = races.head_to_head(pairs.select(F.col("a").cast("string"), F.col("b").cast("string")), results.withColumn("athlete", F.col("athlete").cast("string"))).collect()
    assert {tuple(r) for r in mixed} == want and {(int(r.a), int(r.b), *r[2:]) for r in words} == want
