"""Marks, rounds, dates and seasons as column functions: what a published result means, without Python on the executors.

All of them give null for null. Marks with no numeric identity (status codes, bare integers, zero) have no number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Results that are no numbers.
STATUS_CODES = ["dns", "dnf", "dq", "fs", "scr", "nt", "nm", "nh", "nd", "enr", "np", "nwi"]


def _positive(value: Column) -> Column:
    return F.when(value > 0, F.round(value, 3))


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("double")


def mark_core(mark: Column) -> Column:
    """A mark without its wind reading and the one letter that tells how it was timed."""
    calm = F.trim(F.regexp_replace(F.trim(mark), r"\s*\([-+]?[0-9.]+\)\s*$", ""))
    return F.regexp_replace(calm, "[ahcyAHCY]$", "")


def mark_seconds(mark: Column) -> Column:
    """h:mm:ss, m:ss or ss.x as seconds. A whole number without a colon may be points, so it isn't a time."""
    core = mark_core(mark)
    long, short = r"^(\d+):(\d{2}):(\d{1,2}(?:\.\d+)?)$", r"^(\d+):(\d{2}(?:\.\d+)?)$"
    value = (
        F.when(core.rlike(long), _part(core, long, 1) * 3600 + _part(core, long, 2) * 60 + _part(core, long, 3))
        .when(core.rlike(short), _part(core, short, 1) * 60 + _part(core, short, 2))
        .when(core.rlike(r"^\d+\.\d+$"), core.try_cast("double"))
    )
    return _positive(value)


def mark_meters(mark: Column) -> Column:
    """Metres of 5.08m, of feet-inches 24-01.50 and of 15' 6.75"."""
    text = F.trim(mark)
    metric, dashed, quoted = r"^(?i)(\d+(?:\.\d+)?)\s*m$", r"^(\d+)-(\d+(?:\.\d+)?)$", r"^(\d+)'\s*(\d+(?:\.\d+)?)\"?$"
    imperial = F.when(text.rlike(dashed), _part(text, dashed, 1) * 12 + _part(text, dashed, 2)).when(text.rlike(quoted), _part(text, quoted, 1) * 12 + _part(text, quoted, 2))
    return _positive(F.when(text.rlike(metric), _part(text, metric, 1)).otherwise(imperial * 0.0254))


def parse_mark(mark: Column) -> Column:
    """struct(seconds, meters), one of them at most; a time wins."""
    seconds = mark_seconds(mark)
    return F.struct(seconds.alias("seconds"), F.when(seconds.isNull(), mark_meters(mark)).alias("meters"))


def mark_key(mark: Column) -> Column:
    """A mark's spelling for comparison. The unit m stays: 6.88 and 6.88m are different marks."""
    return F.regexp_replace(F.regexp_replace(F.lower(mark), r"\s+", ""), "[ahcy]+$", "")


def stable_mark_key(measure: Column, mark: Column, seconds: Column, meters: Column, points: Column) -> Column:
    number = lambda kind, value: F.concat(F.lit(f"{kind}:"), F.format_string("%.3f", value))
    raw = F.nullif(mark_key(mark), F.lit(""))
    return (
        F.when((measure == "points") & points.isNotNull(), number("points", points))
        .when((measure == "time") & seconds.isNotNull(), number("seconds", seconds))
        .when((measure == "distance") & meters.isNotNull(), number("meters", meters))
        .otherwise(F.concat(F.lit("raw:"), raw))
    )


def all_or_nothing_key(*parts: Column) -> Column:
    """The parts joined by |, or null where one of them is null."""
    joined = F.concat_ws("|", *[p.cast("string") for p in parts])
    whole = parts[0].isNotNull()
    for p in parts[1:]:
        whole = whole & p.isNotNull()
    return F.when(whole, joined)


def source_record_key(*fields: Column) -> Column:
    """SHA-256 of the fields, joined by the unit separator; a null field is empty."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256)


def is_status_code(mark: Column) -> Column:
    return F.lower(F.trim(mark)).isin(STATUS_CODES)


def is_relay_time(mark: Column) -> Column:
    """A relay is timed in mm:ss.xx or with two digits before the point."""
    return mark_core(mark).rlike(r"^(\d{1,2}:\d{2}\.\d+|\d{2}\.\d+)$")


def clock(seconds: Column) -> Column:
    """m:ss.xx, or ss.xx under a minute."""
    cents = F.round(seconds * 100).cast("long")
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    minutes, rest = F.floor(cents / 6000), cents % 6000
    tail = F.concat(F.lit("."), two(rest % 100))
    return F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit(":"), two(F.floor(rest / 100)), tail)).otherwise(F.concat(F.floor(rest / 100).cast("string"), tail))


def normal_round(label: Column) -> Column:
    """struct(canonical, subdivision). A heat is a part of the preliminaries."""
    compact = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(label)), r"[._-]+", " "), r"\s+", " "))
    heat = r"^(?:heat|h)\s*#?\s*(\d+)$"
    canonical = (
        F.when(compact == "", F.lit(None).cast("string"))
        .when(compact.rlike(heat) | compact.rlike("prelim|qualif|heat"), "Preliminaries")
        .when(compact.rlike("semi"), "Semifinals")
        .when(compact.rlike("final"), "Finals")
        .otherwise(F.trim(label))
    )
    return F.struct(canonical.alias("canonical"), F.when(compact.rlike(heat), F.regexp_extract(compact, heat, 1).try_cast("int")).alias("subdivision"))


def round_priority(label: Column) -> Column:
    """Order of rounds on a page: finals, semifinals, heats by number, others, preliminaries."""
    low = F.lower(label)
    return F.when(low.contains("semi"), 1).when(low.contains("prelim"), 200).when(low.contains("final"), 0).when(low.contains("heat"), 10 + F.coalesce(F.regexp_extract(low, r"(\d+)", 1).try_cast("int"), F.lit(0))).otherwise(50)


def season_label(date: Column) -> Column:
    """Season of a meet: December opens the next year's indoor season."""
    m, y = F.month(date), F.year(date)
    name = F.when(m.isin(12, 1, 2, 3), "Indoor").when(m <= 7, "Outdoor").when(m == 8, "Summer").otherwise("XC")
    return F.concat_ws(" ", (y + F.when(m == 12, 1).otherwise(0)).cast("string"), name)


def season_environment(date: Column) -> Column:
    m = F.month(date)
    return F.when(m.isin(1, 2, 3, 11, 12), "indoor").when(m.between(4, 8), "outdoor").when(m.isNotNull(), "other")


def season_academic(date: Column) -> Column:
    """September to August, as 2025-26."""
    first = F.year(date) - F.when(F.month(date) < 9, 1).otherwise(0)
    return F.concat(first.cast("string"), F.lit("-"), F.lpad(((first + 1) % 100).cast("string"), 2, "0"))


def season_start(date: Column, month: int) -> Column:
    """First day of the season that opens on the first of a month: August for schools, July for rosters, January for athletes."""
    return F.make_date(F.year(date) - F.when(F.month(date) < month, 1).otherwise(0), F.lit(month), F.lit(1))


def competition_week(date: Column) -> Column:
    """struct(start, end): Thursday to Monday, of the week in which the date lies."""
    start = F.date_sub(F.next_day(F.date_add(date, 0), "Thu"), 7)
    return F.struct(start.alias("start"), F.date_add(start, 4).alias("end"))


def url_host(url: Column) -> Column:
    return F.lower(F.split_part(F.split_part(url, F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)))


def name_key(name: Column) -> Column:
    """Lower case, no accents of Latin letters, one space between runs of letters and digits."""
    plain = F.translate(F.lower(name), "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))
