"""Values, names, places and labels of result entries as column functions. Null gives null unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lapwing.functions import marks

#: Names that stand for nobody, as keys of letters and digits.
PLACEHOLDERS = ["namewithheld", "identitywithheld", "withheld", "unknown", "unknownathlete", "anonymous", "redacted", "unidentified", "noname", "notavailable", "na", "athlete", "unattached"]
#: Words of a surname that stand before its last word, and suffixes that are no surname.
PARTICLES = ["van", "von", "de", "del", "della", "der", "den", "ten", "ter", "di", "da", "dos", "das", "la", "le", "du", "st", "san", "santa", "bin", "al", "vander"]
SUFFIXES = ["jr", "sr", "ii", "iii", "iv"]
#: Spellings of a division, by the name under which it is asked for.
DIVISIONS = {
    "D1": ["DI", "D1", "Division I", "NCAA Division I"],
    "D2": ["DII", "D2", "Division II", "NCAA Division II"],
    "D3": ["DIII", "D3", "Division III", "NCAA Division III"],
    "NAIA": ["NAIA"],
    "JUCO": ["JUCO", "NJCAA"],
}
#: Abbreviations of states in running text, and postal codes.
STATES = """
ala AL, alaska AK, ariz AZ, ark AR, calif CA, colo CO, conn CT, del DE, fla FL, ga GA, hawaii HI, idaho ID, ill IL, ind IN, iowa IA, kan KS, ky KY, la LA,
maine ME, md MD, mass MA, mich MI, minn MN, miss MS, mo MO, mont MT, neb NE, nev NV, n.h NH, n.j NJ, n.m NM, n.y NY, n.c NC, n.d ND, ohio OH, okla OK,
ore OR, pa PA, r.i RI, s.c SC, s.d SD, tenn TN, texas TX, utah UT, vt VT, va VA, wash WA, w.va WV, wis WI, wyo WY, d.c DC
"""
#: A timing platform and the parts of an address that tell it, in order.
PLATFORMS = [
    ("athletic_net", ["athletic.net", "jdlfasttrack", "blacksquirrel"]),
    ("milesplit", ["milesplit"]),
    ("pt_timing", ["pttiming"]),
    ("finish_timing", ["finishtiming", "finishlynx"]),
    ("tfrrs", ["tfrrs"]),
]
#: Labels of entries without a team; words that meets add to their names.
NO_TEAM = r"(?i)^(unattached(\s+(athlete|team))?|independent|unaffiliated|open|[-–—])$"
FILLERS = r"\b(invitational|invite|indoor|outdoor|classic|open|track\s*(and|&)?\s*field|championships?|presented\s+by.*$|roster.*$|\d{4})\b"
#: Codes of results that may be written twice.
DOUBLED = ["NM", "NH", "ND", "DNS", "DNF", "DQ", "NT"]


def words(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def clean_text(value: Column) -> Column:
    """Trimmed; an empty text is null."""
    return F.nullif(F.regexp_replace(value, r"^\s+|\s+$", ""), F.lit(""))


def positive_integer(value: Column) -> Column:
    """The whole number that a text begins with, if over 0."""
    n = F.regexp_extract(value, r"^\s*([+-]?\d+)", 1).try_cast("long")
    return F.when(n > 0, n)


def iso_date(value: Column) -> Column:
    """A day written as 2026-05-01, if there is such a day."""
    day = clean_text(value)
    return F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day.try_cast("date"))


def is_no_team(label: Column) -> Column:
    return F.coalesce(clean_text(label), F.lit("")).rlike(NO_TEAM)


def squeezed(name: Column) -> Column:
    return F.replace(marks.name_key(name), F.lit(" "), F.lit(""))


def is_placeholder(name: Column) -> Column:
    """True for names that stand for nobody, and for no name at all."""
    return clean_text(name).isNull() | squeezed(name).isin(PLACEHOLDERS)


def person_name(name: Column) -> Column:
    """struct(first, last): the first word, and the last one with the particles before it. Null where a name can't be split with confidence."""
    tokens = F.split(F.trim(F.regexp_replace(name, r"\s+", " ")), " ")
    bare = lambda t: F.regexp_replace(F.lower(t), "[.,]", "")

    def run(ts: Column, known: list[str], keep: int) -> Column:
        """How many words at the end are of a kind; the first `keep` words always stay."""
        step = lambda acc, t: F.when(acc["open"] & bare(t).isin(known) & (acc["n"] < F.size(ts) - keep), F.struct((acc["n"] + 1).alias("n"), F.lit(True).alias("open"))).otherwise(F.struct(acc["n"].alias("n"), F.lit(False).alias("open")))
        return F.aggregate(F.reverse(ts), F.struct(F.lit(0).alias("n"), F.lit(True).alias("open")), step, lambda acc: acc["n"])

    kept = F.slice(tokens, F.lit(1), F.size(tokens) - run(tokens, SUFFIXES, 2))
    front = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
    particles = run(front, PARTICLES, 1)
    first, last = F.element_at(kept, 1), F.array_join(F.slice(kept, F.size(kept) - particles, particles + 1), " ")
    sure = ~is_placeholder(name) & ~name.rlike(r"\d") & (F.size(kept) >= 2) & (first != last)
    return F.when(sure, F.struct(first.alias("first"), last.alias("last")))


def team_name(label: Column) -> Column:
    """A team's name without the letter of a squad and words for no team."""
    bare = marks.name_key(F.regexp_replace(label, r"(?i)\s*[-–—]\s*[a-h]$", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(unattached|independent|unaffiliated)\b", ""), r"\s+", " "))


def meet_key(name: Column) -> Column:
    """A meet's name for comparison: no bracketed part, no (outdoor), & as and."""
    low = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\s*\[[^\]]+\]", ""), r"\s*\(outdoor\)\s*", " ")
    return F.trim(F.regexp_replace(F.replace(low, F.lit("&"), F.lit("and")), r"[^a-z0-9]+", " "))


def meet_core(name: Column) -> Column:
    """A meet's name without apostrophes, years and the words that most meets have."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "['’`]", ""), r"[^a-z0-9\s]", " "), r"\s+", " ")
    return words(F.regexp_replace(plain, FILLERS, ""))


def state_of(location: Column) -> Column:
    """Postal code of the state at the end of a location; what follows * is a venue."""
    part = F.lower(F.regexp_replace(F.trim(F.element_at(F.split(F.split_part(location, F.lit("*"), F.lit(1)), ","), -1)), r"\.$", ""))
    known = F.create_map(*[F.lit(x) for pair in STATES.replace("\n", " ").split(",") for x in pair.split()])
    return F.when(part.rlike("^[a-z]{2}$"), F.upper(part)).otherwise(F.element_at(known, part))


def timing_platform(url: Column) -> Column:
    found = F.when(url.isNull(), F.lit(None).cast("string"))
    for name, parts in PLATFORMS:
        hit = F.lit(False)
        for p in parts:
            hit = hit | url.contains(p)
        found = found.when(hit, name)
    return found.otherwise("other")


def is_relay_source(event: Column) -> Column:
    """Whether an event is a relay, as source pages write it."""
    low = F.lower(F.trim(event))
    return low.rlike(r"\b(relay|medley|shuttle|dmr|smr|shr)\b") | low.rlike(r"\b\d+\s*x\s*(\d+(\s*(m|meters?|y|yards?))?|mile)\b")


def is_relay_shown(event: Column) -> Column:
    """Whether an event is shown as a relay: another rule than that for sources."""
    low = F.lower(event)
    return low.contains("relay") | low.contains("4x") | low.contains("4 x") | low.isin("dmr", "smr") | low.contains("medley")


def is_four_by_100(event: Column) -> Column:
    """4x100 in any spelling, but no shuttle."""
    plain = F.trim(F.regexp_replace(F.replace(F.lower(event), F.lit("×"), F.lit("x")), "[^a-z0-9]+", " "))
    return ~plain.contains("shuttle") & plain.rlike(r"(^|\s)4\s*x\s*100(\s*m(eter)?s?)?(\s*relay)?(\s*race)?($|\s)")


def gender_of_event(event: Column, url: Column) -> Column:
    """M or F from the address of an event, else from its name."""
    low, at = F.lower(event), F.lower(url)
    told = F.when(at.rlike("(^|/)mens-"), "M").when(at.rlike("(^|/)womens-"), "F")
    female = low.contains("women's") | low.contains("women ")
    return F.coalesce(told, F.when(female, "F").when(low.contains("men's") | low.contains("men "), "M"))


def doubled_code(mark: Column) -> Column:
    """The code of a result that is written twice, as in NM  NM; null for others."""
    return F.nullif(F.regexp_extract(mark, rf"^({'|'.join(DOUBLED)})\s+\1$", 1), F.lit(""))


def season_of_name(meet: Column) -> Column:
    """indoor, outdoor or xc if the name of a meet says just one of these."""
    low = F.lower(meet)
    said = F.array_compact(F.array(F.when(low.contains("indoor"), "indoor"), F.when(low.contains("outdoor"), "outdoor"), F.when(low.rlike(r"\b(xc|cross country)\b"), "xc")))
    return F.when(F.size(said) == 1, F.element_at(said, 1))


def last_saturday(day: Column) -> Column:
    """The Saturday before a day; of a Saturday, the one a week before."""
    return F.date_sub(day, F.when(F.dayofweek(day) == 7, 7).otherwise(F.dayofweek(day)).cast("int"))


def display_round(label: Column) -> Column:
    return marks.normal_round(label)["canonical"]
