"""Filters, values, names, scores and observations of result entries, each with SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lapwing.functions import events, marks, records, scores
from lapwing.operators import ranks
from lapwing.sources.entries import ENTRIES, entries
from lapwing.sources.tables import shared_folder, table

C = F.col


# ---- filters
def divisions(spark: SparkSession, d: str) -> DataFrame:
    """Entries by division as asked for: each name stands for its spellings, in any case; all stands for no filter."""
    low, out = F.lower("division"), None
    for asked in (*records.DIVISIONS, "Other", "all"):
        spelled = [x.lower() for x in records.DIVISIONS.get(asked, [asked])]
        one = entries(spark, d).where(F.lit(True) if asked == "all" else low.isin(spelled)).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).select(F.lit(asked).alias("asked"), "n", "first_id")
        out = one if out is None else out.unionByName(one)
    return out


def filtered(rows: DataFrame, *, gender: str | None = None, division: str | None = None, athlete: int | None = None) -> DataFrame:
    """rows where each parameter that is given holds."""
    if gender is not None:
        rows = rows.where(C("gender") == gender)
    if division not in (None, "all"):
        rows = rows.where(F.lower("division").isin([x.lower() for x in records.DIVISIONS.get(division, [division])]))
    return rows if athlete is None else rows.where(C("athlete") == athlete)


def optional_filters(spark: SparkSession, d: str) -> DataFrame:
    return filtered(entries(spark, d), gender="F", division="D1").select("id", "gender", "division")


def name_search(spark: SparkSession, d: str, term: str = "LEE an") -> DataFrame:
    """Entries whose name has every word of the term, in any case; names that are empty or a comma are no names."""
    rows = entries(spark, d).where(C("name").isNotNull() & ~C("name").isin("", ","))
    for w in term.split():
        rows = rows.where(F.lower("name").contains(w.lower()))
    return rows.select("id", "name")


def meet_or_team_search(spark: SparkSession, d: str, term: str = "tech") -> DataFrame:
    return entries(spark, d).where(F.lower("meet").contains(term) | F.lower("team").contains(term)).select("id", "meet", "team")


def sixty_metres(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).where(C("event").rlike(r"(?i)^60\s*(meters?|m|hurdles?)")).select("id", "event")


def scope(rows: DataFrame, athlete: int | None, meet: str, day) -> DataFrame:
    """Rows of one id where it is known, else of a meet's name and day."""
    return rows.where(C("athlete") == athlete) if athlete is not None else rows.where((C("meet") == meet) & (C("day") == F.lit(day).cast("date")))


def key_or_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Rows in the scope of each entry without a gender: entries of its athlete if place is known, else of its meet's name and day."""
    e = entries(spark, d)
    asks = e.where("gender IS NULL").select(C("id").alias("ask"), C("athlete").alias("a"), C("meet").alias("m"), C("day").alias("on"), C("place").isNotNull().alias("known"))
    by_key = asks.where("known").join(e, C("a") == C("athlete"))
    by_name = asks.where("NOT known").join(e, (C("m") == C("meet")) & (C("on") == C("day")))
    return by_key.unionByName(by_name).groupBy("ask", "known").agg(F.count(F.lit(1)).alias("n"))


def mark_shapes(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).select("mark", C("mark").rlike("[0-9]").alias("digit"), C("mark").rlike("[ah]$").alias("suffixed")).groupBy("mark", "digit", "suffixed").agg(F.count(F.lit(1)).alias("n"))


def season_filter(spark: SparkSession, d: str) -> DataFrame:
    """Entries by season: what the meet's name says wins over what the day says."""
    by_day = marks.season_environment(C("day"))
    return entries(spark, d).groupBy(F.coalesce(records.season_of_name(C("meet")), by_day).alias("season")).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last_id"))


def competition_days(spark: SparkSession, d: str) -> DataFrame:
    """Days of entries with their competition week and the Saturday and Sunday before."""
    week = marks.competition_week(C("day"))
    sat = records.last_saturday(C("day"))
    return entries(spark, d).select("day").distinct().select("day", week["start"].alias("week_start"), week["end"].alias("week_end"), sat.alias("saturday"), F.date_add(sat, 1).alias("sunday"))


def visible_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose customer's segment may be shown: a gate on a dimension."""
    gate = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return table(spark, d, "orders").join(gate, C("o_custkey") == C("c_custkey"), "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def shown_names(spark: SparkSession, d: str) -> DataFrame:
    """The first of team, meet and name that isn't empty, else Unknown."""
    shown = F.coalesce(*[F.nullif(C(x), F.lit("")) for x in ("team", "meet", "name")], F.lit("Unknown"))
    return entries(spark, d).select("id", shown.alias("shown"))


# ---- values
def values(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).select("id", records.iso_date(C("raw_date")).alias("day"), records.positive_integer(C("raw_number")).alias("number"), records.clean_text(C("name")).alias("text"), records.is_no_team(C("team")).alias("no_team"), marks.is_status_code(C("mark")).alias("status"))


def mark_values(spark: SparkSession, d: str) -> DataFrame:
    """Each spelling of a mark with its number, keys and whether a relay may have it."""
    m = marks.parse_mark(C("mark"))
    stable = marks.stable_mark_key(F.lit("time"), C("mark"), m["seconds"], m["meters"], F.lit(None).cast("double"))
    return entries(spark, d).select("mark").distinct().select("mark", m["seconds"].alias("seconds"), m["meters"].alias("meters"), stable.alias("stable"), marks.is_relay_time(C("mark")).alias("relay_time"), records.doubled_code(C("mark")).alias("doubled"), marks.clock(m["seconds"]).alias("clock"))


def keys(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprint (null written out), all-or-nothing keys and record key of each entry."""
    null = lambda c: F.coalesce(C(c).cast("string"), F.lit("null"))
    return entries(spark, d).select(
        "id",
        F.concat_ws("|", null("athlete"), null("event"), F.coalesce(marks.mark_key(C("mark")), F.lit("null"))).alias("fingerprint"),
        marks.all_or_nothing_key(C("meet"), C("event"), C("athlete"), C("mark")).alias("performance_key"),
        marks.all_or_nothing_key(C("meet"), C("event"), C("athlete"), C("mark"), C("place")).alias("canonical_key"),
        marks.source_record_key(*[C(x) for x in ("meet", "event", "name", "team", "mark", "place", "round", "day", "id")]).alias("record_key"),
    )


def rounds(spark: SparkSession, d: str) -> DataFrame:
    """Entries in the order of rounds: spelling, canonical round, part, and rank on a page."""
    r = marks.normal_round(C("round"))
    return entries(spark, d).groupBy("round").agg(F.count(F.lit(1)).alias("n")).select("round", r["canonical"].alias("canonical"), r["subdivision"].alias("subdivision"), marks.round_priority(C("round")).alias("priority"), "n").orderBy("priority", "round")


def event_kinds(spark: SparkSession, d: str) -> DataFrame:
    e = entries(spark, d).select("event", "url").distinct()
    return e.select("event", "url", records.is_relay_source(C("event")).alias("source_relay"), records.is_relay_shown(C("event")).alias("shown_relay"), records.is_four_by_100(C("event")).alias("four_by_100"), records.gender_of_event(C("event"), C("url")).alias("gender"))


def people(spark: SparkSession, d: str) -> DataFrame:
    n = records.person_name(C("name"))
    e = entries(spark, d).select("name", "team").distinct()
    return e.select("name", "team", n["first"].alias("first"), n["last"].alias("last"), records.is_placeholder(C("name")).alias("placeholder"), marks.name_key(C("name")).alias("key"), records.team_name(C("team")).alias("team_key"))


def name_likeness(spark: SparkSession, d: str) -> DataFrame:
    """Spelled names against the names of the same sound length: one less the share of edits; equal keys, or one within the other, count 0.95."""
    names = entries(spark, d).select(marks.name_key(C("name")).alias("k")).where("k <> ''").distinct()
    a, b = names.select(C("k").alias("a"), F.length("k").alias("n")), names.select(C("k").alias("b"), F.length("k").alias("m"))
    near = a.withColumn("m", F.explode(F.sequence(F.greatest(C("n") - 2, F.lit(1)), C("n") + 2))).join(b, "m").where("a < b")
    like = 1 - F.levenshtein("a", "b") / F.greatest("n", "m")
    return near.select("a", "b", F.round(F.when(C("a").contains(C("b")) | C("b").contains(C("a")), 0.95).otherwise(like), 4).alias("likeness"))


def places(spark: SparkSession, d: str) -> DataFrame:
    e = entries(spark, d).select("location", "meet", "url").distinct()
    athlete = F.nullif(F.regexp_extract("url", r"/athletes?/([0-9]+)", 1), F.lit(""))
    return e.select("location", "meet", "url", records.state_of(C("location")).alias("state"), records.meet_key(C("meet")).alias("meet_key"), records.meet_core(C("meet")).alias("meet_core"), records.timing_platform(C("url")).alias("platform"), athlete.alias("source_id"))


def platform_drift(spark: SparkSession, d: str) -> DataFrame:
    """Stored platform (the host's first word) against the one that the rule gives, null-safe."""
    stored = F.regexp_extract(marks.url_host(C("url")), r"^(?:www\.|live\.|x\.)?([a-z]+)", 1)
    now = records.timing_platform(C("url"))
    return entries(spark, d).where(~stored.eqNullSafe(now)).groupBy(stored.alias("stored"), now.alias("projected")).agg(F.count(F.lit(1)).alias("n"))


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Canonical JSON of each entry (names sorted, nulls left out) and its digest; one value read back."""
    js = F.to_json(F.struct(C("event"), C("mark"), C("name"), C("place"), C("team")))
    return entries(spark, d).select("id", js.alias("json")).select("id", "json", F.sha2("json", 256).alias("digest"), F.get_json_object("json", "$.mark").alias("mark"), F.get_json_object("json", "$.team").isNotNull().alias("has_team"))


# ---- scores
_EVENTS = {"60 Meters": "60m", "200 Meters": "200m", "400m": "400m", "800 Meters": "800m", "Mile": "mile", "3000m": "3000m", "60 Hurdles": "60mh", "High Jump": "hj", "Long Jump": "lj", "Shot Put": "sp"}
#: Typical marks, around which the entries' x is laid.
_TYPICAL = {"60m": 7.0, "200m": 23.0, "400m": 51.0, "800m": 118.0, "mile": 265.0, "3000m": 520.0, "60mh": 8.5, "hj": 1.8, "lj": 6.5, "sp": 14.0}


def scored_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries with points. A meet on a day is indoors if any of its entries there is over 60 metres; marks out of bounds have none."""
    e = entries(spark, d)
    code = F.create_map(*[F.lit(x) for p in _EVENTS.items() for x in p])
    typical = F.create_map(*[F.lit(x) for event, mark in _TYPICAL.items() for x in (event, round(100 * mark))])
    indoors = e.where(C("event").rlike(r"(?i)^60\s*(meters?|m|hurdles?)")).select("meet", "day").distinct().withColumn("hit", F.lit(True))
    met = e.join(indoors, ["meet", "day"], "left")
    rows = met.select("id", "athlete", "gender", F.element_at(code, C("event")).alias("event"), F.coalesce("hit", F.lit(False)).alias("indoor"), C("x").alias("raw"))
    # in whole hundredths: a half of one is rounded alike everywhere
    hundredths = F.floor((F.element_at(typical, C("event")) * (32000 + F.round(C("raw") * 100).cast("long")) + 20000) / 40000)
    rows = rows.where("event IS NOT NULL").withColumn("x", hundredths / 100).drop("raw")
    return scores.scored(spark, rows).select("id", "gender", "event", "indoor", "x", "points")


#: Names of events in a coefficients file.
_FILE_NAMES = {"60mh": "60mH", "mile": "Mile", "hj": "HJ", "pv": "PV", "lj": "LJ", "tj": "TJ", "sp": "SP", "wt": "WT"}


def _file_name(event: str) -> str:
    return _FILE_NAMES.get(event, event)


def file_scored_entries(spark: SparkSession, d: str) -> DataFrame:
    """The same entries with points by a file of coefficients, which is written from the curves and read again: indoor curves as short-track ones."""
    found: dict[str, dict[str, list[float]]] = {"men": {}, "women": {}}
    for g, event, indoor, a, b, c, *_ in scores.curves():
        two_curves = sum(1 for x in scores.curves() if x[:2] == (g, event) and x[3:6] != (a, b, c)) > 0
        if two_curves or not indoor:
            found["men" if g == "M" else "women"][_file_name(event) + (scores.SHORT_TRACK if two_curves and indoor else "")] = [a, b, c]
    path = shared_folder(spark, "coefficients")
    spark.createDataFrame([(json.dumps(found),)], "value string").coalesce(1).write.text(path)
    names = F.create_map(*[F.lit(x) for event in _TYPICAL for x in (event, _file_name(event))])
    rows = scored_entries(spark, d).drop("points").withColumn("event", names[C("event")])
    return scores.scored_by_file(spark, rows, scores.file_curves(spark, path)).select("id", "gender", "event", "indoor", "x", "points")


def points_board(spark: SparkSession, d: str) -> DataFrame:
    """Best points of each athlete, the best 50 of these: the leaderboard with real curves."""
    rows = scored_entries(spark, d).join(entries(spark, d).select("id", "athlete"), "id").where("points IS NOT NULL")
    best = rows.groupBy("athlete").agg(F.max(F.struct("points", (-C("id")).alias("neg"), "event")).alias("b"))
    return best.select("athlete", C("b.points").alias("points"), (-C("b.neg")).alias("id"), C("b.event").alias("event")).orderBy(F.desc("points"), "id").limit(50)


# ---- observations
MEASURES = {"60m": "time", "hj": "distance"}


def observations(spark: SparkSession, d: str) -> DataFrame:
    """Each entry as an observation: normalised fields, its record key and the codes of what is wrong with it, in the order of the checks."""
    e = entries(spark, d)
    measure = F.when(C("event").rlike("Jump|Put"), "distance").when(C("event") == "", "unknown").when(C("event").rlike("Medley"), "points").otherwise("time")
    mark = records.clean_text(C("mark"))
    m = marks.parse_mark(mark)
    points = F.when((measure == "points") & mark.rlike(r"^\d+(\.\d+)?$"), mark.try_cast("double"))
    rows = e.select(
        "id", measure.alias("measure"), mark.alias("mark_raw"), m["seconds"].alias("mark_seconds"), m["meters"].alias("mark_meters"), points.alias("points"),
        records.positive_integer(C("raw_number")).alias("target_meet_id"), records.clean_text(C("event")).alias("event_key"), C("athlete"), records.clean_text(C("team")).alias("source_team"), F.when(C("place") > 4, C("place")).alias("team_id"),
        records.display_round(C("round")).alias("round"), records.iso_date(C("raw_date")).alias("result_date"), F.when(C("gender") == "M", "individual_result").when(C("gender") == "F", "relay_result").alias("entity"),
        marks.source_record_key(C("meet"), C("event"), C("name"), C("mark"), C("id")).alias("record_key"),
    )
    number = sum((C(x).isNotNull().cast("int") for x in ("mark_seconds", "mark_meters", "points")), F.lit(0))
    checks = [
        ("invalid_entity_type", C("entity").isNull()),
        ("missing_target_meet", C("target_meet_id").isNull()),
        ("missing_event_type", C("event_key").isNull()),
        ("unknown_measure", C("measure") == "unknown"),
        ("missing_team", (C("entity") == "relay_result") & C("team_id").isNull()),
        ("missing_team", (C("entity") == "individual_result") & C("source_team").isNotNull() & C("team_id").isNull() & ~records.is_no_team(C("source_team"))),
        ("missing_mark", C("mark_raw").isNull()),
        ("multiple_measurements", number > 1),
        ("multi_event_component_mark", (C("measure") == "points") & (C("mark_seconds").isNotNull() | C("mark_meters").isNotNull())),
        ("time_distance_conflict", (C("measure") == "time") & C("mark_meters").isNotNull()),
        ("distance_time_conflict", (C("measure") == "distance") & C("mark_seconds").isNotNull()),
    ]
    errors = F.array_join(F.array(*[F.when(F.coalesce(bad, F.lit(False)), code) for code, bad in checks]), ",")
    return rows.select("id", "entity", "measure", "mark_raw", "mark_seconds", "mark_meters", "points", "target_meet_id", "round", "result_date", "record_key", errors.alias("errors"))


def matched_rows(spark: SparkSession, d: str) -> DataFrame:
    """Entries against others of the same athlete and event: codes of one status and place on one day, team conflicts and gaps, and the preferred one by round."""
    e = entries(spark, d).select("id", "athlete", "event", "mark", "day", "place", marks.normal_round(C("round"))["canonical"].alias("canon"), F.trim("round").alias("raw"), F.when(C("place") > 4, C("place")).alias("team_id"))
    a, b = (e.select(*[C(x).alias(f"{p}_{x}") for x in e.columns]) for p in "ab")
    met = a.join(b, (C("a_athlete") == C("b_athlete")) & (C("a_event") == C("b_event")) & (C("a_id") != C("b_id")))
    status = marks.is_status_code(C("a_mark")) & marks.is_status_code(C("b_mark")) & (C("a_day") == C("b_day")) & ~F.coalesce(C("a_canon") != C("b_canon"), F.lit(False)) & C("a_place").eqNullSafe(C("b_place"))
    known = F.coalesce(F.create_map(F.lit("Finals"), F.lit(3), F.lit("Preliminaries"), F.lit(2), F.lit("Semifinals"), F.lit(1))[C("b_canon")], F.lit(0))
    score = F.when(C("a_canon") == C("b_canon"), 100).otherwise(0) + F.when((C("a_raw") == C("b_raw")) & (C("a_raw") != ""), 10).otherwise(0) + F.when(C("b_raw") == C("b_canon"), 2).otherwise(0) + known
    return met.groupBy(C("a_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce(status, F.lit(False))).alias("n_status"),
        F.count_if(F.coalesce(C("a_team_id") != C("b_team_id"), F.lit(False))).alias("n_conflict"),
        F.count_if(C("a_team_id").isNotNull() & C("b_team_id").isNull()).alias("n_enrich"),
        F.max(F.struct(score.alias("s"), (-C("b_id")).alias("neg"))).alias("best"),
    ).select("id", "n", "n_status", "n_conflict", "n_enrich", (-C("best.neg")).alias("preferred"), C("best.s").alias("preference"))


CATALOG = [("60m", "60 Meters"), ("HJ", "High Jump"), ("SP", "Shot Put"), ("DMR", "DMR")]


def canonical_events(spark: SparkSession, d: str) -> DataFrame:
    """Each spelling of an event as the catalogue's name where that has it by code or name, else as its display name."""
    known = F.create_map(*[F.lit(x) for code, name in CATALOG for form in {code.lower(), name.lower()} for x in (form, code)])
    e = entries(spark, d).select("event").distinct()
    return e.select("event", F.coalesce(F.try_element_at(known, F.lower(F.trim("event"))), events.event_label(C("event"))).alias("canonical"))


def source_rows(spark: SparkSession, d: str) -> DataFrame:
    """Source rows fitted to what is known: team by its unique name, athlete by its unique name key, a key within source and meet; a relay has participants (its team's names), others one."""
    e = entries(spark, d)
    # a few names may have all the rows: each known name stands there once for each of 64 shares, so that no task gets the rows of a name
    shares, share = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("share"), F.pmod(F.xxhash64("id"), F.lit(64)).cast("int").alias("share")
    unique = lambda key, value: e.select(key.alias("k"), value.alias("v")).where("k <> ''").groupBy("k").agg(F.min("v").alias("v"), F.max("v").alias("m")).where("v = m").select("k", "v", shares)
    teams = unique(records.team_name(C("team")), F.length("team")).select(C("k").alias("team_key"), C("v").alias("team_id"), "share")
    people = unique(marks.name_key(C("name")), C("athlete")).select(C("k").alias("name_key"), C("v").alias("athlete_id"), "share")
    relay = F.coalesce(records.is_relay_source(C("event")), F.lit(False))
    rows = e.select("id", share, records.team_name(C("team")).alias("team_key"), marks.name_key(C("name")).alias("name_key"), marks.source_record_key(records.meet_key(C("meet")), C("event"), C("id")).alias("scoped_key"), relay.alias("relay"))
    met = rows.join(teams, ["team_key", "share"], "left").join(people, ["name_key", "share"], "left")
    return met.select("id", "scoped_key", "team_id", F.when(~C("relay"), C("athlete_id")).alias("athlete_id"), F.when(C("relay"), 4).otherwise(1).alias("n_participants"))


def rereads(spark: SparkSession, d: str) -> DataFrame:
    """A feed that is read whole again each day: rows by then, and users whose last row is another one than at the read before."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts", F.to_date("ts").alias("day"))
    daily = e.groupBy("day").agg(F.count(F.lit(1)).alias("new"), F.countDistinct("user_id").alias("n_changed"))
    return daily.select("day", F.sum("new").over(Window.orderBy("day")).alias("n_rows"), "n_changed")  # a row a day


# ---- windows, lists, sets of what is shown
def grouped_nulls(spark: SparkSession, d: str) -> DataFrame:
    """A number for each pair of team and division, nulls being a value of their own."""
    pairs = entries(spark, d).groupBy("team", "division").agg(F.count(F.lit(1)).alias("n"))
    return ranks.ranked(pairs, [F.asc_nulls_first("team"), F.asc_nulls_first("division")], "group_no").select("team", "division", "n", C("group_no").cast("int").alias("group_no"))


def season_bests(spark: SparkSession, d: str) -> DataFrame:
    """Best row of each athlete and event in one academic year."""
    e = entries(spark, d).where(marks.season_academic(C("day")) == "1997-98")
    return e.groupBy("athlete", "event").agg(F.min(F.struct("x", "day", "id")).alias("b")).select("athlete", "event", "b.x", "b.day", "b.id")


def canonical_meets(spark: SparkSession, d: str) -> DataFrame:
    """Of the entries of one meet key and day, the most complete: points for what is known, then the least id."""
    score = F.when(C("location").isNotNull(), 4).otherwise(0) + F.when(C("url").isNotNull(), 2).otherwise(0) + F.when(C("place").isNotNull(), 1).otherwise(0)
    best = entries(spark, d).groupBy(records.meet_key(C("meet")).alias("meet_key"), "day").agg(F.max(F.struct(score.alias("s"), (-C("id")).alias("neg"))).alias("b"))
    return best.select("meet_key", "day", (-C("b.neg")).alias("id"), C("b.s").alias("score"))


def shown_once(spark: SparkSession, d: str) -> DataFrame:
    """In an athlete's day, one row for each event and mark: that of the first round on a page."""
    rank = marks.round_priority(F.coalesce("round", F.lit("")))
    return entries(spark, d).groupBy("athlete", "day", "event", "mark").agg(F.min(F.struct(rank.alias("r"), "id")).alias("b"), F.count(F.lit(1)).alias("n")).select("athlete", "day", "event", "mark", C("b.id").alias("id"), "n")


def event_list(spark: SparkSession, d: str) -> DataFrame:
    """Events with entries in their order on a page: sprints, distances, hurdles, jumps, throws, relays, others; then by name in order of bytes."""
    e = C("event")
    rank = F.when(records.is_relay_source(e) | records.is_relay_shown(e), 6).when(e.rlike("Hurdles"), 3).when(e.rlike("Jump"), 4).when(e.rlike("Put"), 5).when(e.rlike("^(60|200|400)"), 1).when(e.rlike("Mile|800|3000"), 2).otherwise(9)
    return entries(spark, d).groupBy("event").agg(F.count(F.lit(1)).alias("n")).select(rank.alias("rank"), "event", "n").orderBy("rank", "event")


def newest(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).select("id", "day", "event").orderBy(F.desc("day"), "id").limit(25)


def meets_of_both(spark: SparkSession, d: str) -> DataFrame:
    """Meets of single events and of relays, each meet once: the first to name it wins."""
    e = entries(spark, d).where("meet IS NOT NULL")
    relay = records.is_relay_source(C("event"))
    keyed = e.select(records.meet_key(C("meet")).alias("meet_key"), F.when(relay, 1).otherwise(0).alias("from_relay"), "id", "meet")
    return keyed.groupBy("meet_key").agg(F.min(F.struct("from_relay", "id", "meet")).alias("b")).select("meet_key", "b.from_relay", "b.id", "b.meet")


def event_names_by_gender(spark: SparkSession, d: str) -> DataFrame:
    """Sorted distinct events of each gender, from entries and from their addresses."""
    e = entries(spark, d)
    one = e.select("gender", "event").where("gender IS NOT NULL AND event <> ''")
    two = e.select(records.gender_of_event(F.lit(None).cast("string"), C("url")).alias("gender"), "event").where("gender IS NOT NULL AND event <> ''")
    return one.unionByName(two).groupBy("gender").agg(F.array_join(F.array_sort(F.collect_set("event")), ",").alias("events"))


QUERIES = {
    "F2_divisions": divisions, "F3_optional_filters": optional_filters, "F4_name_search": name_search, "F5_meet_or_team_search": meet_or_team_search, "F6_sixty_metres": sixty_metres,
    "F8_key_or_fallback": key_or_fallback, "F9_mark_shapes": mark_shapes, "F10_season_filter": season_filter, "F12_F13_competition_days": competition_days, "F15_visible_orders": visible_orders, "F16_shown_names": shown_names,
    "X10_X11_X12_values": values, "X2_X3_X6_X15_X40_mark_values": mark_values, "X5_X7_X8_keys": keys, "X9_T6_rounds": rounds, "X14_X16_X41_event_kinds": event_kinds, "X25_X26_X27_F14_people": people, "X28_name_likeness": name_likeness,
    "X29_X30_X31_X33_places": places, "Q19_platform_drift": platform_drift, "X42_X43_snapshots": snapshots, "X22_X24_F11_scored_entries": scored_entries, "X23_file_scored_entries": file_scored_entries, "W2_points_board": points_board,
    "X21_canonical_events": canonical_events, "M2_source_rows": source_rows, "R4_rereads": rereads, "M1_X13_observations": observations, "M4_M5_matched_rows": matched_rows, "W7_grouped_nulls": grouped_nulls, "W13_season_bests": season_bests, "W17_canonical_meets": canonical_meets, "W18_shown_once": shown_once,
    "T4_T5_event_list": event_list, "T2_newest": newest, "U3_meets_of_both": meets_of_both, "U6_event_names_by_gender": event_names_by_gender,
}

_RELAY = r"(regexp_matches(lower(trim(event)), '\b(relay|medley|shuttle|dmr|smr|shr)\b') OR regexp_matches(lower(trim(event)), '\b\d+\s*x\s*(\d+(\s*(m|meters?|y|yards?))?|mile)\b'))"
_SHOWN = "(contains(lower(event), 'relay') OR contains(lower(event), '4x') OR contains(lower(event), '4 x') OR lower(event) IN ('dmr', 'smr') OR contains(lower(event), 'medley'))"
_CORE = r"regexp_replace(trim(regexp_replace(trim(mark), '\s*\([-+]?[0-9.]+\)\s*$', '')), '[ahcyAHCY]$', '')"
_SECONDS = rf"""CASE WHEN regexp_matches({_CORE}, '^\d+:\d\d:\d\d?(\.\d+)?$') THEN split_part({_CORE}, ':', 1)::DOUBLE * 3600 + split_part({_CORE}, ':', 2)::DOUBLE * 60 + split_part({_CORE}, ':', 3)::DOUBLE
    WHEN regexp_matches({_CORE}, '^\d+:\d\d(\.\d+)?$') THEN split_part({_CORE}, ':', 1)::DOUBLE * 60 + split_part({_CORE}, ':', 2)::DOUBLE
    WHEN regexp_matches({_CORE}, '^\d+\.\d+$') THEN {_CORE}::DOUBLE END"""
_METERS = r"""CASE WHEN regexp_matches(trim(mark), '^\d+(\.\d+)?\s*[mM]$') THEN trim(regexp_replace(trim(mark), '[mM]$', ''))::DOUBLE
    WHEN regexp_matches(trim(mark), '^\d+-\d+(\.\d+)?$') THEN (split_part(trim(mark), '-', 1)::DOUBLE * 12 + split_part(trim(mark), '-', 2)::DOUBLE) * 0.0254
    WHEN regexp_matches(trim(mark), '^\d+''\s*\d+(\.\d+)?"?$') THEN (split_part(trim(mark), '''', 1)::DOUBLE * 12 + trim(replace(split_part(trim(mark), '''', 2), '"', ''))::DOUBLE) * 0.0254 END"""
_PARSED = f"p AS (SELECT *, CASE WHEN s0 > 0 THEN round(s0, 3) END AS seconds, CASE WHEN NOT coalesce(s0 > 0, false) AND m0 > 0 THEN round(m0, 3) END AS meters FROM (SELECT *, {_SECONDS} AS s0, {_METERS} AS m0 FROM e))"
_COMPACT = r"trim(regexp_replace(regexp_replace(lower(trim(round)), '[._-]+', ' ', 'g'), '\s+', ' ', 'g'))"
_ROUND = rf"""CASE WHEN {_COMPACT} = '' THEN NULL WHEN regexp_matches({_COMPACT}, '^(heat|h)\s*#?\s*\d+$|prelim|qualif|heat') THEN 'Preliminaries' WHEN {_COMPACT} LIKE '%semi%' THEN 'Semifinals' WHEN {_COMPACT} LIKE '%final%' THEN 'Finals' ELSE trim(round) END"""
_PRIORITY = r"CASE WHEN lower(round) LIKE '%semi%' THEN 1 WHEN lower(round) LIKE '%prelim%' THEN 200 WHEN lower(round) LIKE '%final%' THEN 0 WHEN lower(round) LIKE '%heat%' THEN 10 + coalesce(try_cast(regexp_extract(lower(round), '(\d+)', 1) AS INT), 0) ELSE 50 END"
_NAME_KEY = "trim(regexp_replace(strip_accents(lower({})), '[^a-z0-9]+', ' ', 'g'))"
_NO_TEAM = r"regexp_matches(trim(coalesce({}, '')), '^(unattached(\s+(athlete|team))?|independent|unaffiliated|open|[-–—])$', 'i')"
_ISO = r"CASE WHEN regexp_matches(trim(raw_date), '^\d{4}-\d{2}-\d{2}$') THEN try_cast(trim(raw_date) AS DATE) END"
_NUMBER = r"(CASE WHEN try_cast(regexp_extract(raw_number, '^\s*([+-]?\d+)', 1) AS BIGINT) > 0 THEN try_cast(regexp_extract(raw_number, '^\s*([+-]?\d+)', 1) AS BIGINT) END)"
_MEET_KEY = r"trim(regexp_replace(replace(regexp_replace(regexp_replace(lower(coalesce(meet, '')), '\s*\[[^\]]+\]', '', 'g'), '\s*\(outdoor\)\s*', ' ', 'g'), '&', 'and'), '[^a-z0-9]+', ' ', 'g'))"
_PLATFORM = "CASE WHEN url IS NULL THEN NULL " + " ".join("WHEN " + " OR ".join(f"contains(url, '{p}')" for p in parts) + f" THEN '{name}'" for name, parts in records.PLATFORMS) + " ELSE 'other' END"
_BY_URL = "CASE WHEN regexp_matches(lower(url), '(^|/)mens-') THEN 'M' WHEN regexp_matches(lower(url), '(^|/)womens-') THEN 'F' END"
_SEASON = """CASE WHEN (meet ILIKE '%indoor%')::INT + (meet ILIKE '%outdoor%')::INT + regexp_matches(lower(meet), '\\b(xc|cross country)\\b')::INT = 1
    THEN CASE WHEN meet ILIKE '%indoor%' THEN 'indoor' WHEN meet ILIKE '%outdoor%' THEN 'outdoor' ELSE 'xc' END END"""
_CURVES = ", ".join(f"('{g}', '{e}', {str(i).lower()}, {a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE, {'NULL' if m is None else m}::DOUBLE, {'NULL' if n is None else n}::DOUBLE)" for g, e, i, a, b, c, m, n in scores.curves())
_CODE = "CASE event " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _EVENTS.items()) + " END"
_USUAL = "CASE code " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in _TYPICAL.items()) + " END"
_SCORED = f"""k(gender, event, indoor, a, b, c, most, least) AS (VALUES {_CURVES}),
    i AS (SELECT DISTINCT meet, day FROM e WHERE regexp_matches(event, '^60\\s*(meters?|m|hurdles?)', 'i')),
    r AS (SELECT e.id, e.athlete, e.gender, {_CODE} AS code, i.day IS NOT NULL AS indoor, x AS raw FROM e LEFT JOIN i ON e.meet = i.meet AND e.day = i.day),
    q AS (SELECT id, athlete, gender, code AS event, indoor, ((round(100 * {_USUAL})::BIGINT * (32000 + round(raw * 100)::BIGINT) + 20000) // 40000) / 100::DOUBLE AS x FROM r WHERE code IS NOT NULL),
    s AS (SELECT q.*, greatest(0, round(a * x * x + b * x + c)::INT) AS p, coalesce(x <= most, true) AND coalesce(x >= least, true) AS sound, a IS NOT NULL AS has FROM q LEFT JOIN k ON q.gender = k.gender AND q.event = k.event AND q.indoor = k.indoor),
    t AS (SELECT id, athlete, gender, event, indoor, x, CASE WHEN has AND sound AND p > 0 AND p <= 1400 THEN p END AS points FROM s)"""
_E = f"WITH {ENTRIES}"
_REAL = {e: (a, b) for e, a, b in (line.split() for line in scores.TIMES.strip().splitlines())}
_FILE_TIMES = ", ".join(f"('{e}', '{_file_name(e)}', {_REAL.get(_file_name(e), ('NULL',) * 2)[0]}::DOUBLE, {_REAL.get(_file_name(e), ('NULL',) * 2)[1]}::DOUBLE)" for e in _TYPICAL)

ORACLE_SQL = {
    "F2_divisions": f"{_E} " + " UNION ALL ".join(f"SELECT '{a}' AS asked, count(*) AS n, min(id) AS first_id FROM e WHERE {'true' if a == 'all' else 'lower(division) IN (' + ', '.join(repr(x.lower()) for x in records.DIVISIONS.get(a, [a])) + ')'}" for a in (*records.DIVISIONS, "Other", "all")),
    "F3_optional_filters": f"{_E} SELECT id, gender, division FROM e WHERE gender = 'F' AND lower(division) IN ('di', 'd1', 'division i', 'ncaa division i')",
    "F4_name_search": f"{_E} SELECT id, name FROM e WHERE name NOT IN ('', ',') AND name ILIKE '%lee%' AND name ILIKE '%an%'",
    "F5_meet_or_team_search": f"{_E} SELECT id, meet, team FROM e WHERE meet ILIKE '%tech%' OR team ILIKE '%tech%'",
    "F6_sixty_metres": f"{_E} SELECT id, event FROM e WHERE regexp_matches(event, '^60\\s*(meters?|m|hurdles?)', 'i')",
    "F8_key_or_fallback": f"{_E} SELECT a.id AS ask, a.place IS NOT NULL AS known, count(*) AS n FROM e a JOIN e b ON CASE WHEN a.place IS NOT NULL THEN a.athlete = b.athlete ELSE a.meet = b.meet AND a.day = b.day END WHERE a.gender IS NULL GROUP BY ALL",
    "F9_mark_shapes": f"{_E} SELECT mark, regexp_matches(mark, '[0-9]') AS digit, regexp_matches(mark, '[ah]$') AS suffixed, count(*) AS n FROM e GROUP BY ALL",
    "F10_season_filter": f"{_E} SELECT coalesce({_SEASON}, CASE WHEN month(day) IN (1, 2, 3, 11, 12) THEN 'indoor' WHEN month(day) BETWEEN 4 AND 8 THEN 'outdoor' ELSE 'other' END) AS season, count(*) AS n, max(id) AS last_id FROM e GROUP BY 1",
    "F12_F13_competition_days": f"""{_E}, d AS (SELECT DISTINCT day FROM e), w AS (SELECT day, day - ((isodow(day) + 3) % 7)::INT AS s, day - (CASE WHEN dayofweek(day) = 6 THEN 7 ELSE dayofweek(day) + 1 END)::INT AS sat FROM d)
        SELECT day, s AS week_start, s + 4 AS week_end, sat AS saturday, sat + 1 AS sunday FROM w""",
    "F15_visible_orders": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1",
    "F16_shown_names": f"{_E} SELECT id, coalesce(nullif(team, ''), nullif(meet, ''), nullif(name, ''), 'Unknown') AS shown FROM e",
    "X10_X11_X12_values": f"{_E} SELECT id, {_ISO} AS day, {_NUMBER} AS number, nullif(trim(name), '') AS text, {_NO_TEAM.format('team')} AS no_team, lower(trim(mark)) IN ('dns', 'dnf', 'dq', 'fs', 'scr', 'nt', 'nm', 'nh', 'nd', 'enr', 'np', 'nwi') AS status FROM e",
    "X2_X3_X6_X15_X40_mark_values": f"""{_E}, {_PARSED} SELECT DISTINCT mark, seconds, meters,
        CASE WHEN seconds IS NOT NULL THEN printf('seconds:%.3f', seconds) ELSE 'raw:' || nullif(regexp_replace(regexp_replace(lower(mark), '\\s+', '', 'g'), '[ahcy]+$', ''), '') END AS stable,
        regexp_matches({_CORE}, '^(\\d{{1,2}}:\\d{{2}}\\.\\d+|\\d{{2}}\\.\\d+)$') AS relay_time,
        CASE WHEN regexp_matches(mark, '^({'|'.join(records.DOUBLED)})\\s+({'|'.join(records.DOUBLED)})$') AND regexp_extract(mark, '^(\\S+)', 1) = regexp_extract(mark, '(\\S+)$', 1) THEN regexp_extract(mark, '^(\\S+)', 1) END AS doubled,
        CASE WHEN seconds >= 60 THEN (round(seconds * 100)::BIGINT // 6000)::VARCHAR || ':' || lpad((round(seconds * 100)::BIGINT % 6000 // 100)::VARCHAR, 2, '0') ELSE (round(seconds * 100)::BIGINT // 100)::VARCHAR END || '.' || lpad((round(seconds * 100)::BIGINT % 100)::VARCHAR, 2, '0') AS clock
        FROM p""",
    "X5_X7_X8_keys": f"""{_E} SELECT id, coalesce(athlete::VARCHAR, 'null') || '|' || coalesce(event, 'null') || '|' || coalesce(regexp_replace(regexp_replace(lower(mark), '\\s+', '', 'g'), '[ahcy]+$', ''), 'null') AS fingerprint,
        meet || '|' || event || '|' || athlete || '|' || mark AS performance_key, meet || '|' || event || '|' || athlete || '|' || mark || '|' || place AS canonical_key,
        sha256(concat_ws(chr(31), coalesce(meet, ''), coalesce(event, ''), coalesce(name, ''), coalesce(team, ''), coalesce(mark, ''), coalesce(place::VARCHAR, ''), coalesce(round, ''), coalesce(day::VARCHAR, ''), id::VARCHAR)) AS record_key FROM e""",
    "X9_T6_rounds": f"{_E} SELECT round, {_ROUND} AS canonical, CASE WHEN regexp_matches({_COMPACT}, '^(heat|h)\\s*#?\\s*\\d+$') THEN regexp_extract({_COMPACT}, '(\\d+)$', 1)::INT END AS subdivision, {_PRIORITY} AS priority, count(*) AS n FROM e GROUP BY round",
    "X14_X16_X41_event_kinds": f"""{_E}, d AS (SELECT DISTINCT event, url FROM e), n AS (SELECT *, trim(regexp_replace(replace(lower(event), '×', 'x'), '[^a-z0-9]+', ' ', 'g')) AS plain FROM d)
        SELECT event, url, {_RELAY} AS source_relay, {_SHOWN} AS shown_relay, NOT contains(plain, 'shuttle') AND regexp_matches(plain, '(^|\\s)4\\s*x\\s*100(\\s*m(eter)?s?)?(\\s*relay)?(\\s*race)?($|\\s)') AS four_by_100,
        coalesce({_BY_URL}, CASE WHEN event ILIKE '%women''s%' OR event ILIKE '%women %' THEN 'F' WHEN event ILIKE '%men''s%' OR event ILIKE '%men %' THEN 'M' END) AS gender FROM n""",
    "X25_X26_X27_F14_people": f"""{_E}, d AS (SELECT DISTINCT name, team FROM e),
        k AS (SELECT *, {_NAME_KEY.format('name')} AS key, coalesce(trim(name) = '', true) OR replace({_NAME_KEY.format('name')}, ' ', '') IN ({', '.join(map(repr, records.PLACEHOLDERS))}) AS placeholder,
              regexp_replace(trim(regexp_replace(name, '\\s+', ' ', 'g')), '( +(jr|sr|ii|iii|iv)[.,]*)+$', '', 'i') AS bare FROM d),
        n AS (SELECT *, regexp_extract(bare, '^(\\S+)', 1) AS f, regexp_extract(bare, '^\\S+(.*?) ((({'|'.join(records.PARTICLES)})[.,]* )*\\S+)$', 2, 'i') AS l FROM k)
        SELECT name, team, CASE WHEN ok THEN f END AS first, CASE WHEN ok THEN l END AS last, placeholder, key,
               trim(regexp_replace(regexp_replace({_NAME_KEY.format("regexp_replace(team, '(?i)\\s*[-–—]\\s*[a-h]$', '')")}, '\\b(unattached|independent|unaffiliated)\\b', '', 'g'), '\\s+', ' ', 'g')) AS team_key
        FROM (SELECT *, NOT placeholder AND NOT regexp_matches(name, '\\d') AND contains(bare, ' ') AND f <> l AS ok FROM n)""",
    "X28_name_likeness": f"""{_E}, n AS (SELECT DISTINCT {_NAME_KEY.format('name')} AS k FROM e WHERE {_NAME_KEY.format('name')} <> '')
        SELECT a.k AS a, b.k AS b, round(CASE WHEN contains(a.k, b.k) OR contains(b.k, a.k) THEN 0.95::DOUBLE ELSE 1 - levenshtein(a.k, b.k) / greatest(length(a.k), length(b.k))::DOUBLE END, 4) AS likeness
        FROM n a JOIN n b ON a.k < b.k AND abs(length(a.k) - length(b.k)) <= 2""",
    "X29_X30_X31_X33_places": f"""{_E}, d AS (SELECT DISTINCT location, meet, url FROM e), p AS (SELECT *, lower(regexp_replace(trim(list_last(string_split(split_part(location, '*', 1), ','))), '\\.$', '')) AS part FROM d)
        SELECT location, meet, url, CASE WHEN regexp_matches(part, '^[a-z]{{2}}$') THEN upper(part) ELSE CASE part {' '.join(f"WHEN '{x.split()[0]}' THEN '{x.split()[1]}'" for x in records.STATES.replace(chr(10), ' ').split(','))} END END AS state,
        {_MEET_KEY} AS meet_key, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(meet, '')), '[''’`]', '', 'g'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'), '{records.FILLERS}', '', 'g'), '\\s+', ' ', 'g')) AS meet_core,
        {_PLATFORM} AS platform, nullif(regexp_extract(url, '/athletes?/([0-9]+)', 1), '') AS source_id FROM p""",
    "Q19_platform_drift": f"""{_E}, s AS (SELECT regexp_extract(lower(split_part(split_part(url, '://', 2), '/', 1)), '^(?:www\\.|live\\.|x\\.)?([a-z]+)', 1) AS stored, {_PLATFORM} AS projected FROM e)
        SELECT stored, projected, count(*) AS n FROM s WHERE stored IS DISTINCT FROM projected GROUP BY ALL""",
    "X42_X43_snapshots": f"""{_E}, j AS (SELECT id, mark, team, '{{' || concat_ws(',', '"event":' || to_json(event), '"mark":' || to_json(mark), '"name":' || to_json(name), '"place":' || place, '"team":' || to_json(team)) || '}}' AS json FROM e)
        SELECT id, json, sha256(json) AS digest, mark, team IS NOT NULL AS has_team FROM j""",
    "X22_X24_F11_scored_entries": f"{_E}, {_SCORED} SELECT id, gender, event, indoor, x, points FROM t",
    "X23_file_scored_entries": f"""{_E}, {_SCORED}, w(event, name, fastest, slowest) AS (VALUES {_FILE_TIMES})
        SELECT id, t.gender, w.name AS event, t.indoor, t.x, CASE WHEN k.a IS NOT NULL AND coalesce(x BETWEEN fastest AND slowest, true) THEN greatest(0, round(k.a * x * x + k.b * x + k.c)::INT) END AS points
        FROM t JOIN w USING (event) LEFT JOIN k ON k.gender = t.gender AND k.event = t.event AND k.indoor = t.indoor""",
    "W2_points_board": f"{_E}, {_SCORED} SELECT athlete, points, id, event FROM (SELECT *, row_number() OVER (PARTITION BY athlete ORDER BY points DESC, id) AS n FROM t WHERE points IS NOT NULL) WHERE n = 1 ORDER BY points DESC, id LIMIT 50",
    "M1_X13_observations": f"""{_E}, {_PARSED},
        o AS (SELECT *, CASE WHEN regexp_matches(event, 'Jump|Put') THEN 'distance' WHEN event = '' THEN 'unknown' WHEN event LIKE '%Medley%' THEN 'points' ELSE 'time' END AS measure, nullif(trim(mark), '') AS mark_raw,
              {_NUMBER} AS target_meet_id, nullif(trim(event), '') AS event_key, nullif(trim(team), '') AS source_team, CASE WHEN place > 4 THEN place END AS team_id, CASE gender WHEN 'M' THEN 'individual_result' WHEN 'F' THEN 'relay_result' END AS entity FROM p),
        q AS (SELECT *, CASE WHEN measure = 'points' AND regexp_matches(mark_raw, '^\\d+(\\.\\d+)?$') THEN mark_raw::DOUBLE END AS points FROM o)
        SELECT id, entity, measure, mark_raw, seconds AS mark_seconds, meters AS mark_meters, points, target_meet_id, {_ROUND} AS round, {_ISO} AS result_date,
               sha256(concat_ws(chr(31), coalesce(meet, ''), coalesce(event, ''), coalesce(name, ''), coalesce(mark, ''), id::VARCHAR)) AS record_key,
               concat_ws(',', CASE WHEN entity IS NULL THEN 'invalid_entity_type' END, CASE WHEN target_meet_id IS NULL THEN 'missing_target_meet' END, CASE WHEN event_key IS NULL THEN 'missing_event_type' END, CASE WHEN measure = 'unknown' THEN 'unknown_measure' END,
                 CASE WHEN entity = 'relay_result' AND team_id IS NULL THEN 'missing_team' END, CASE WHEN entity = 'individual_result' AND source_team IS NOT NULL AND team_id IS NULL AND NOT {_NO_TEAM.format('source_team')} THEN 'missing_team' END,
                 CASE WHEN mark_raw IS NULL THEN 'missing_mark' END, CASE WHEN (seconds IS NOT NULL)::INT + (meters IS NOT NULL)::INT + (points IS NOT NULL)::INT > 1 THEN 'multiple_measurements' END,
                 CASE WHEN measure = 'points' AND (seconds IS NOT NULL OR meters IS NOT NULL) THEN 'multi_event_component_mark' END, CASE WHEN measure = 'time' AND meters IS NOT NULL THEN 'time_distance_conflict' END,
                 CASE WHEN measure = 'distance' AND seconds IS NOT NULL THEN 'distance_time_conflict' END) AS errors FROM q""",
    "X21_canonical_events": f"{_E} SELECT DISTINCT event, CASE event WHEN '60 Meters' THEN '60m' WHEN '200 Meters' THEN '200m' WHEN '400m' THEN '400m' WHEN '800 Meters' THEN '800m' WHEN 'Mile' THEN 'Mile' WHEN '3000m' THEN '3000m' WHEN '60 Hurdles' THEN '60m H' WHEN 'High Jump' THEN 'HJ' WHEN 'Long Jump' THEN 'Long Jump' WHEN 'Shot Put' THEN 'SP' WHEN '4x100 Meter Relay' THEN '4x100m' WHEN 'DMR' THEN 'DMR' WHEN 'Sprint Medley' THEN 'SMR' WHEN 'Women''s 200 Meters' THEN '200m' WHEN 'Men''s Mile' THEN 'Mile' ELSE event END AS canonical FROM e",
    "M2_source_rows": f"""{_E}, k AS (SELECT *, trim(regexp_replace(regexp_replace({_NAME_KEY.format("regexp_replace(team, '(?i)\\s*[-–—]\\s*[a-h]$', '')")}, '\\b(unattached|independent|unaffiliated)\\b', '', 'g'), '\\s+', ' ', 'g')) AS tk, {_NAME_KEY.format('name')} AS nk FROM e),
        t AS (SELECT tk, min(length(team))::INT AS team_id FROM k WHERE tk <> '' GROUP BY tk HAVING count(DISTINCT length(team)) = 1), p AS (SELECT nk, min(athlete) AS athlete_id FROM k WHERE nk <> '' GROUP BY nk HAVING count(DISTINCT athlete) = 1)
        SELECT id, sha256(concat_ws(chr(31), {_MEET_KEY}, coalesce(event, ''), id::VARCHAR)) AS scoped_key, team_id, CASE WHEN NOT coalesce({_RELAY}, false) THEN athlete_id END AS athlete_id, CASE WHEN {_RELAY} THEN 4 ELSE 1 END AS n_participants
        FROM k LEFT JOIN t USING (tk) LEFT JOIN p USING (nk)""",
    "R4_rereads": "SELECT day, (sum(n) OVER (ORDER BY day))::BIGINT AS n_rows, c AS n_changed FROM (SELECT ts::DATE AS day, count(*) AS n, count(DISTINCT user_id) AS c FROM events GROUP BY 1)",
    "M4_M5_matched_rows": f"""{_E}, r AS (SELECT id, athlete, event, lower(trim(mark)) IN ('dns', 'dnf', 'dq', 'fs', 'scr', 'nt', 'nm', 'nh', 'nd', 'enr', 'np', 'nwi') AS code, day, place, {_ROUND} AS canon, trim(round) AS raw, CASE WHEN place > 4 THEN place END AS team_id FROM e),
        m AS (SELECT a.id, b.id AS other, coalesce(a.code AND b.code AND a.day = b.day, false) AND NOT coalesce(a.canon <> b.canon, false) AND a.place IS NOT DISTINCT FROM b.place AS status, coalesce(a.team_id <> b.team_id, false) AS conflict, a.team_id IS NOT NULL AND b.team_id IS NULL AS enrich,
                CASE WHEN a.canon = b.canon THEN 100 ELSE 0 END + CASE WHEN a.raw = b.raw AND a.raw <> '' THEN 10 ELSE 0 END + CASE WHEN b.raw = b.canon THEN 2 ELSE 0 END + CASE b.canon WHEN 'Finals' THEN 3 WHEN 'Preliminaries' THEN 2 WHEN 'Semifinals' THEN 1 ELSE 0 END AS s
              FROM r a JOIN r b ON a.athlete = b.athlete AND a.event = b.event AND a.id <> b.id)
        SELECT id, count(*) AS n, count(*) FILTER (status) AS n_status, count(*) FILTER (conflict) AS n_conflict, count(*) FILTER (enrich) AS n_enrich, first(other ORDER BY s DESC, other) AS preferred, max(s) AS preference FROM m GROUP BY id""",
    "W7_grouped_nulls": f"{_E}, g AS (SELECT team, division, count(*) AS n FROM e GROUP BY ALL) SELECT *, (dense_rank() OVER (ORDER BY team NULLS FIRST, division NULLS FIRST))::INT AS group_no FROM g",
    "W13_season_bests": f"{_E} SELECT athlete, event, x, day, id FROM (SELECT *, row_number() OVER (PARTITION BY athlete, event ORDER BY x, day, id) AS n FROM e WHERE day BETWEEN DATE '1997-09-01' AND DATE '1998-08-31') WHERE n = 1",
    "W17_canonical_meets": f"""{_E}, s AS (SELECT {_MEET_KEY} AS meet_key, day, id, CASE WHEN location IS NOT NULL THEN 4 ELSE 0 END + CASE WHEN url IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN place IS NOT NULL THEN 1 ELSE 0 END AS score FROM e)
        SELECT meet_key, day, id, score FROM (SELECT *, row_number() OVER (PARTITION BY meet_key, day ORDER BY score DESC, id) AS n FROM s) WHERE n = 1""",
    "W18_shown_once": f"{_E} SELECT athlete, day, event, mark, first(id ORDER BY {_PRIORITY}, id) AS id, count(*) AS n FROM e GROUP BY athlete, day, event, mark",
    "T4_T5_event_list": f"""{_E} SELECT CASE WHEN {_RELAY} OR {_SHOWN} THEN 6 WHEN event LIKE '%Hurdles%' THEN 3 WHEN event LIKE '%Jump%' THEN 4 WHEN event LIKE '%Put%' THEN 5 WHEN regexp_matches(event, '^(60|200|400)') THEN 1 WHEN regexp_matches(event, 'Mile|800|3000') THEN 2 ELSE 9 END AS rank, event, count(*) AS n FROM e GROUP BY event ORDER BY 1, 2""",
    "T2_newest": f"{_E} SELECT id, day, event FROM e ORDER BY day DESC, id LIMIT 25",
    "U3_meets_of_both": f"{_E}, k AS (SELECT {_MEET_KEY} AS meet_key, {_RELAY}::INT AS from_relay, id, meet FROM e WHERE meet IS NOT NULL) SELECT meet_key, from_relay, id, meet FROM (SELECT *, row_number() OVER (PARTITION BY meet_key ORDER BY from_relay, id) AS n FROM k) WHERE n = 1",
    "U6_event_names_by_gender": f"{_E}, u AS (SELECT gender, event FROM e UNION SELECT {_BY_URL} AS gender, event FROM e) SELECT gender, string_agg(event, ',' ORDER BY event) AS events FROM u WHERE gender IS NOT NULL AND event <> '' GROUP BY gender",
}
