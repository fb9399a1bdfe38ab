"""Event names, printed dates and meet states as column functions. All of them give null for null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Each event's display name, and the spellings under which it is known (; stands for a comma in a number).
SPELLINGS = """
55m: 55, 55.0, 55m, 55 m, 55 meters, 55 meter dash
60m: 60, 60.0, 60m, 60 m, 60 meters, 60 meter dash
100m: 100, 100.0, 100m, 100 m, 100 meters, 100 meter dash
200m: 200, 200.0, 200m, 200 m, 200 meters, 200 meter dash
300m: 300, 300.0, 300m, 300 m, 300 meters, 300 meter dash
400m: 400, 400.0, 400m, 400 m, 400 meters, 400 meter dash
500m: 500, 500.0, 500m, 500 m, 500 meters
600m: 600, 600.0, 600m, 600 m, 600 meters
800m: 800, 800.0, 800m, 800 m, 800 meters, 800 meter run
1000m: 1000, 1000.0, 1000m, 1000 m, 1000 meters, 1000 meter run
1500m: 1500, 1500.0, 1500m, 1500 m, 1500 meters, 1500 meter run
3000m: 3000, 3000.0, 3000m, 3000 m, 3000 meters, 3000 meter run
5000m: 5000, 5000.0, 5000m, 5000 m, 5000 meters, 5000 meter run, 5k
10,000m: 10000, 10000.0, 10000m, 10000 m, 10000 meters, 10000 meter run, 10;000, 10;000 meters, 10;000 meter run, 10k
55m H: 55h, 55 hurdles, 55 meter hurdles, 55m hurdles, 55m h
60m H: 60h, 60 hurdles, 60 meter hurdles, 60m hurdles, 60m h
100m H: 100h, 100 hurdles, 100 meter hurdles, 100m hurdles, 100m h
110m H: 110h, 110 hurdles, 110 meter hurdles, 110m hurdles, 110m h
400m H: 400h, 400 hurdles, 400 meter hurdles, 400m hurdles, 400m h
4x100m: 4x100, 4x100m, 4x100 relay, 4x100 meter relay, 4x100m relay
4x200m: 4x200, 4x200m, 4x200 relay, 4x200 meter relay, 4x200m relay
4x400m: 4x400, 4x400m, 4x400 relay, 4x400 meter relay, 4x400m relay
4x800m: 4x800, 4x800m, 4x800 relay, 4x800 meter relay, 4x800m relay
Mile: mile, mile run, 1 mile, 1 mile run
600y: 600y, 600 y
3200m: 3200, 3200m, 3200 m
3000m SC: 3000s, 3000 steeplechase, 3000 meter steeplechase, 3000m steeplechase, 3000m sc, steeplechase, steeple, sc
DMR: dmr, distance medley relay, distance medley
SMR: smr, sprint medley relay, sprint medley
High Jump: high jump, hj
Long Jump: long jump, lj
Triple Jump: triple jump, tj
Pole Vault: pole vault, pv
Shot Put: shot put, sp, shot
Discus: discus, discus throw, dt
Hammer: hammer, hammer throw, ht
Javelin: javelin, javelin throw, jt
Weight Throw: weight throw, weight, wt
Heptathlon: heptathlon, hep
Decathlon: decathlon, dec
Pentathlon: pentathlon, pent
4k XC: 4k, 4k (xc)
5k XC: 5k (xc)
6k XC: 6k, 6k (xc)
8k XC: 8k, 8k (xc)
10k XC: 10k (xc)
"""

#: Words at the end of a name that tell the meet or the round.
TRAILING = ["invitational", "inv", "inv.", "championship", "prelim", "prelims", "preliminary", "final", "finals"]

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def spellings() -> dict[str, str]:
    """Known spelling in lower case: display name."""
    lines = [line.split(":", 1) for line in SPELLINGS.strip().splitlines()]
    return {form.strip().replace(";", ","): name for name, forms in lines for form in forms.split(",")}


def _known(text: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in spellings().items() for x in pair])
    return F.try_element_at(table, text)


def _once(value: Column, f) -> Column:
    """f(value), with value worked out once however often f names it."""
    return F.get(F.transform(F.array(value), lambda x: f(x)), F.lit(0))


def _ungendered(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)^(wo)?men('s|s|')?\s+", "")


def event_label(name: Column) -> Column:
    """Display name of an event: known spellings, without words of meet and round at the end and without Men's or Women's; (I) and (O) stay. Unknown names come back as they are."""
    place = F.regexp_extract(name, r"\(([IO])\)$", 1)
    words = "|".join(w.replace(".", r"\.") for w in TRAILING)
    event = F.trim(F.regexp_replace(F.lower(F.regexp_replace(name, r"\s*\([IO]\)$", "")), rf"(\s+({words}|heat\s*\d*))+\s*$", ""))

    def named(e: Column) -> Column:
        metres = F.regexp_extract(e, r"^(\d+)\s*m$", 1)
        return F.coalesce(_known(e), F.when(metres != "", F.concat(metres, F.lit("m"))), _known(_ungendered(e)))

    return F.coalesce(F.concat(_once(event, named), F.when(place == "", "").otherwise(F.concat(F.lit(" ("), place, F.lit(")")))), name)


#: Words of event names on result pages that mean the same.
SAME_WORDS = {"meter": "m", "meters": "m", "hurdle": "hurdles", "h": "hurdles", "mh": "m hurdles"}


def event_signatures() -> dict[str, str]:
    """What a name on a result page comes to, number by number and word by word, and the event it means."""
    out = {}
    for distances, pace in (((60, 200, 300, 400), "dash"), ((600, 800, 1000, 1500, 3000, 5000, 10000), "run")):
        for d in distances:
            out |= {f"{d}": f"{d}m", f"{d} m": f"{d}m", f"{d} m {pace}": f"{d}m"}
    for d in (60, 100, 110, 400):
        out |= {f"{d} hurdles": f"{d}m H", f"{d} m hurdles": f"{d}m H"}
    for d in (100, 200, 400, 800):
        out |= {f"4 x {d}{m}{r}": f"4x{d}m" for m in ("", " m") for r in ("", " relay")}
    out |= {f"{one}mile{run}": "Mile" for one in ("", "1 ") for run in ("", " run")}
    out |= {f"{d}steeplechase": "3000m SC" for d in ("", "3000 ", "3000 m ")}
    for name in ("High Jump", "Long Jump", "Triple Jump", "Pole Vault", "Shot Put", "Weight Throw", "Discus", "Hammer", "Javelin", "Heptathlon", "Decathlon", "Pentathlon"):
        out[name.lower()] = name
    out |= {f"{x.lower()} throw": x for x in ("Discus", "Hammer", "Javelin")}
    return out | {"wt": "Weight Throw", "distance medley relay": "DMR", "dmr": "DMR", "sprint medley relay": "SMR", "smr": "SMR"}


def event_code(name: Column) -> Column:
    """Canonical name of an event on a result page, without Men's or Women's. A name is taken apart into numbers and words; one that comes to no known event loses its prefix only."""
    bare = F.trim(_ungendered(name))
    same = F.create_map(*[F.lit(x) for pair in SAME_WORDS.items() for x in pair])
    known = F.create_map(*[F.lit(x) for pair in event_signatures().items() for x in pair])

    def coded(b: Column) -> Column:
        parts = F.regexp_extract_all(F.lower(b), F.lit(r"(\d+(?:,\d{3})*|[a-z]+)"))
        whole = F.array_join(parts, "") == F.regexp_replace(F.lower(b), r"\s+", "")
        plain = F.array_join(F.transform(parts, lambda w: F.coalesce(F.try_element_at(same, w), F.replace(w, F.lit(","), F.lit("")))), " ")
        return F.coalesce(F.when(whole, F.try_element_at(known, plain)), b)

    return _once(bare, coded)


def resolve_events(rows: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """rows with event_type_id by aliases(raw_name, event_type_id), spaces and case aside; null where unknown. An alias that leads to two ids fails the job."""
    key = lambda c: F.nullif(F.lower(F.trim(F.col(c))), F.lit(""))
    one = F.when(F.min("event_type_id") == F.max("event_type_id"), F.min("event_type_id")).otherwise(F.raise_error(F.concat(F.lit("alias with two meanings: "), F.first("__alias"))).cast("long"))
    known = aliases.select(key("raw_name").alias("__alias"), "event_type_id").where("__alias IS NOT NULL AND event_type_id IS NOT NULL").groupBy("__alias").agg(one.alias("event_type_id"))
    return rows.drop("event_type_id").withColumn("__key", key(name)).join(known, F.col("__key") == F.col("__alias"), "left").drop("__key", "__alias")


def unmapped_names(resolved: DataFrame, name: str, seen: DataFrame | None = None) -> DataFrame:
    """name, seen_count of names that found no event, added to the counts of an earlier table."""
    new = resolved.where(F.col("event_type_id").isNull() & (F.trim(F.col(name)) != "")).groupBy(name).agg(F.count(F.lit(1)).alias("seen_count"))
    return new if seen is None else seen.select(name, "seen_count").unionByName(new).groupBy(name).agg(F.sum("seen_count").alias("seen_count"))


def _date(year: Column, month: Column, day: Column) -> Column:
    """Null where there is no such day. month: its name or its number."""
    number = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(month, 1, 3))).cast("string")
    month = F.when(month.rlike("^[0-9]+$"), month).otherwise(number)
    text = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text).try_cast("date")


def calendar_dates(text: Column, as_of: Column) -> Column:
    """struct(start, end) of "Fri Feb 20-Sat Feb 21", "February 14-15" and "Fri Feb 20": of as_of's year, or the next one if the start lies over 30 days back. Other texts: as_of."""
    across, within, single = r"\w+\s+(\w+)\s+(\d+)-\w+\s+(\w+)\s+(\d+)", r"(\w+)\s+(\d+)-(\d+)", r"(\w+)\s+(\d+)"
    part = lambda p, i: F.regexp_extract(text, p, i)
    span = lambda *xs: F.struct(*[x.alias(n) for n, x in zip(("m", "d", "end_m", "end_d"), xs)])
    found = (
        F.when(text.rlike(across), span(*[part(across, i) for i in (1, 2, 3, 4)]))
        .when(text.rlike(within), span(*[part(within, i) for i in (1, 2, 1, 3)]))
        .when(text.rlike(single), span(*[part(single, i) for i in (1, 2, 1, 2)]))
    )

    def dated(p: Column) -> Column:
        in_year = lambda y: F.struct(_date(y.cast("string"), p["m"], p["d"]).alias("start"), _date(y.cast("string"), p["end_m"], p["end_d"]).alias("end"))
        return _once(in_year(F.year(as_of)), lambda x: F.when(x["start"] < F.date_sub(as_of, 30), in_year(F.year(as_of) + 1)).otherwise(x))

    return F.when(found.isNotNull(), _once(found, dated)).when(text.isNotNull(), F.struct(as_of.alias("start"), as_of.alias("end")))


def slash_date(text: Column) -> Column:
    """First day of 03/14/26, 03/14-15/26 and 03/14-03/15/26 or the like; years from 50 on are of the last century."""
    p = r"(\d{2})/(\d{2})(?:-\d{2})?(?:/\d{2})?/(\d{2})"
    year = F.regexp_extract(text, p, 3)
    return F.when(text.rlike(p), _date(F.concat(F.when(year >= "50", "19").otherwise("20"), year), F.regexp_extract(text, p, 1), F.regexp_extract(text, p, 2)))


def long_date(text: Column) -> Column:
    """First day of "March 14, 2026", "Mar 14-15, 2026" within a text; null if there is no such day."""
    p = r"(?i)\b(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\s+(\d{1,2})(?:\s*[-–]\s*\d{1,2})?,?\s+(\d{4})\b"
    return F.when(text.rlike(p), _date(F.regexp_extract(text, p, 3), F.regexp_extract(text, p, 1), F.regexp_extract(text, p, 2)))


def mentions_date(text: Column, date: Column, days: int = 3) -> Column:
    """Whether a text names a day within so many days of date, month first or day first, with its year close by."""

    def named(day: Column) -> Column:
        month = F.concat(F.lit("(?:"), F.date_format(day, "MMMM"), F.lit("|"), F.date_format(day, "MMM"), F.lit(r")\.?"))
        number, year = F.concat(F.lit("0?"), F.dayofmonth(day).cast("string")), F.concat(F.lit(r"(?:,|\s){1,3}"), F.year(day).cast("string"), F.lit(r"\b"))
        first = F.concat(F.lit("(?i)"), month, F.lit(r"\s+"), number, F.lit("(?:st|nd|rd|th)?"), year)
        return F.regexp_like(text, first) | F.regexp_like(text, F.concat(F.lit(r"(?i)\b"), number, F.lit(r"\s+"), month, year))

    return F.when(text.isNotNull() & date.isNotNull(), F.exists(F.sequence(F.date_sub(date, days), F.date_add(date, days)), named))


def meet_status(start: Column, end: Column, url: Column, override: Column, zone: Column, as_of: Column) -> Column:
    """upcoming, live or completed at as_of (UTC) on the meet's own clock; its last day is over at 23:00. An override wins."""
    local = F.from_utc_timestamp(as_of, F.coalesce(zone, F.lit("America/Chicago")))
    today = F.to_date(local)
    return (
        F.when(override.isNotNull(), override)
        .when(start > today, "upcoming")
        .when((end < today) | ((end == today) & (F.hour(local) >= 23)), "completed")
        .when((start <= today) & (end >= today) & url.isNotNull(), "live")
        .otherwise("upcoming")
    )


#: Kinds of meets with the reason given for each, by what the name says.
MEET_KINDS = [
    ("bracketed", "combined_child_candidate", "bracketed_combined_events"),
    ("within", "combined_child_candidate", "championship_combined_events"),
    ("combined", "multi_only", "standalone_multi_event_meet"),
    ("early", "preliminary", "preliminary_meet_record"),
    ("other", "canonical", "regular_meet_record"),
]


def meet_kind(name: Column) -> Column:
    """struct(kind, reason): combined events held within another meet or alone, preliminaries, or a meet of its own. A null name is empty."""
    spaced = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"([\[\]])", " $1 "), r"[^a-z0-9_\[\]]+", " ")
    text = F.concat(F.lit(" "), spaced, F.lit(" "))
    says = lambda *phrases: F.exists(F.array(*[F.lit(f" {p} ") for p in phrases]), lambda p: text.contains(p))
    combined = says("combined event", "combined events", "multi", "multis")
    told = {
        "bracketed": says("[ combined event ]", "[ combined events ]", "[ multi ]", "[ multis ]"),
        "within": combined & says("championship", "championships"),
        "combined": combined,
        "early": says("prelim", "prelims", "preliminary", "preliminaries"),
        "other": F.lit(True),
    }
    return F.coalesce(*[F.when(told[key], F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"))) for key, kind, reason in MEET_KINDS])
