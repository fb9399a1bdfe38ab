"""Result pages: HTML tables as rows of cells, and the columns that a result has, by JVM expressions only.

Text of a cell: tags out, entities decoded, one space for white space. Rows of classes that the page hides aren't dropped here; `event_rows` leaves hidden cells out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Named entities of result pages; the ampersand comes last.
ENTITIES = [("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]


def clean(html: Column) -> Column:
    """Text of a piece of HTML."""
    text = F.regexp_replace(html, r"(?s)<!--.*?-->|<[^>]*>", " ")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _once(rows: DataFrame, *columns: Column) -> DataFrame:
    """rows with columns that a filter may follow: behind a generator they aren't worked out once for the filter and once more for the row."""
    return rows.select("*", F.inline(F.array(F.struct(*columns))))


def table_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without html, one row per body row of each table: table_no, row_no (from 0), heads (texts of the last header row), cells (HTML of each td with its tag)."""
    keep = [c for c in pages.columns if c != html]
    tables = pages.select(*keep, F.posexplode(_all(F.col(html), r"(?is)<table\b[^>]*>(.*?)</table>")).alias("table_no", "__table"))
    last = F.try_element_at(_all(F.regexp_extract("__table", r"(?is)<thead\b[^>]*>(.*?)</thead>", 1), r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(-1))
    heads = F.transform(F.coalesce(_all(last, r"(?is)<th\b[^>]*>(.*?)</th>"), F.array().cast("array<string>")), clean)
    body = F.regexp_replace("__table", r"(?is)<thead\b[^>]*>.*?</thead>", "")
    # heads first: beside the generator they would be worked out for each row of the table
    tables = tables.select(*keep, "table_no", heads.alias("heads"), body.alias("__body"))
    cells = F.transform(_all(F.col("__body"), r"(?is)<tr\b[^>]*>(.*?)</tr>"), lambda row: _all(row, r"(?is)<td\b[^>]*>.*?</td>", 0))
    return tables.select(*keep, "table_no", "heads", F.posexplode(cells).alias("row_no", "cells")).where(F.size("cells") > 0)


def head_index(heads: Column, pattern: str) -> Column:
    """Place (from 0) of the first header that a pattern meets, -1 for none."""
    return F.array_position(F.transform(heads, lambda h: h.rlike(pattern)), True) - 1


def cell(cells: Column, index: Column) -> Column:
    return F.when(index >= 0, F.coalesce(clean(F.get(cells, index.cast("int"))), F.lit("")))


def _or(index: Column, other: Column) -> Column:
    return F.when(index >= 0, index).otherwise(other)


def _links(cells: Column, kind: str) -> tuple[Column, Column]:
    """Addresses and texts of the links to such pages."""
    row, link = F.array_join(cells, " "), rf'(?is)<a\b[^>]*href="([^"]*/{kind}/[^"]*)"[^>]*>(.*?)</a>'
    return _all(row, link, 1), F.transform(_all(row, link, 2), clean)


def _id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/athletes/(\d+)", 1), F.lit(""))


def identity(rows: DataFrame, relay: bool = False) -> DataFrame:
    """table_rows with athlete_id, athlete_name, team_name, team_url and, for relays, relay_athletes(athlete_id, name). Links come first; without them the header tells
    the column, and without a header place, athlete, year, team (relays: place, team, squad letter if any, athletes)."""
    cells, heads, keep = F.col("cells"), F.col("heads"), rows.columns
    for kind in ("athletes", "teams"):
        urls, names = _links(cells, kind)
        rows = rows.withColumn(f"__{kind}_urls", urls).withColumn(f"__{kind}_names", names)
    athlete_urls, athlete_names, team_urls, team_names = (F.col(f"__{k}_{x}") for k in ("athletes", "teams") for x in ("urls", "names"))
    team_cell = cell(cells, _or(head_index(heads, r"(?i)\bteam\b"), F.lit(1 if relay else 3)))
    out = rows.withColumn("team_url", F.get(team_urls, F.lit(0))).withColumn("team_name", F.nullif(F.coalesce(F.get(team_names, F.lit(0)), team_cell), F.lit("")))
    if not relay:
        name = F.coalesce(F.get(athlete_names, F.lit(0)), cell(cells, _or(head_index(heads, r"(?i)^(name|athlete)s?$"), F.lit(1))))
        return out.withColumn("athlete_id", _id(F.get(athlete_urls, F.lit(0)))).withColumn("athlete_name", name).select(*keep, "team_url", "team_name", "athlete_id", "athlete_name")
    at = _or(head_index(heads, "(?i)^athletes?$"), F.when(cell(cells, F.lit(2)).rlike("^[A-Za-z0-9]$"), 3).otherwise(2))
    linked = F.filter(F.zip_with(athlete_urls, athlete_names, lambda u, n: F.struct(_id(u).alias("athlete_id"), n.alias("name"))), lambda x: x["name"] != "")
    listed = F.transform(F.filter(F.transform(F.split(cell(cells, at), ","), lambda n: F.trim(n)), lambda n: n != ""), lambda n: F.struct(F.lit(None).cast("string").alias("athlete_id"), n.alias("name")))
    none = F.lit(None).cast("string")
    out = out.withColumn("athlete_id", none).withColumn("athlete_name", none).withColumn("relay_athletes", F.when(F.size(linked) > 0, linked).otherwise(listed))
    return out.select(*keep, "team_url", "team_name", "athlete_id", "athlete_name", "relay_athletes")


def multi_event_summary(pages: DataFrame, html: str = "html") -> DataFrame:
    """Rows of the first table with a POINTS column: identity, place and points; rows whose score is no number or that name no athlete are left out."""
    rows = identity(table_rows(pages, html).where("table_no = 0").withColumn("__at", head_index(F.col("heads"), "(?i)^points$")).where("__at >= 0"))
    score, place = cell(F.col("cells"), F.col("__at")), F.regexp_extract(cell(F.col("cells"), F.lit(0)), r"^\s*(\d+)", 1).try_cast("int")
    out = rows.withColumn("__score", score).withColumn("__place", place).withColumnRenamed("athlete_name", "__name")
    points = F.when(F.col("__score").rlike(r"^\d+(\.\d+)?$"), F.col("__score").try_cast("double"))
    out = _once(out, F.col("__name").alias("athlete_name"), points.alias("points"), F.when(F.col("__place") > 0, F.col("__place")).alias("place"))
    return out.where("points IS NOT NULL AND athlete_name <> ''").drop("__at", "__score", "__place", "__name")


def _visible(cell_html: Column, hidden: Column) -> Column:
    classes = F.split(F.regexp_extract(cell_html, r'(?is)^<td\b[^>]*class="([^"]*)"', 1), r"\s+")
    return ~F.arrays_overlap(classes, hidden) & ~cell_html.rlike(r"(?is)^<td\b[^>]*style=\"[^\"]*display:\s*none")


def event_rows(pages: DataFrame, html: str = "html", relay: bool = False) -> DataFrame:
    """Rows of an event page with identity, place, round and mark. The round is told by the class of a cell (round_4: finals, other rounds: preliminaries, heat_a_b:
    heat b). The mark is the first visible time, metric or feet-inches cell, else a status code; a time of a relay has two digits before its point."""
    hidden = F.concat(_all(F.col(html), r"\.([\w-]+)\s*\{\s*display:\s*none"), F.array(F.lit("hidden")))
    rows = identity(table_rows(pages.withColumn("__hidden", hidden), html), relay)
    shown = F.filter("cells", lambda c: _visible(c, F.col("__hidden")))
    rows = rows.withColumn("__texts", F.transform(shown, clean)).withColumn("__row", F.array_join("cells", " "))
    texts, row = F.col("__texts"), F.col("__row")
    time = r"^(\d+:)?\d{2}:\d{2}(\.\d+)?[ah]?$|^\d{1,2}:\d{2}\.\d+[ah]?$|^\d{2}\.\d+[ah]?$" if relay else r"^(\d+:){0,2}\d+\.\d+[ah]?$|^\d+:\d{2}(\.\d+)?[ah]?$"
    first = lambda p: F.get(F.filter(texts, lambda t: t.rlike(p)), F.lit(0))
    mark = F.coalesce(first(rf"{time}|^\d+(\.\d+)?m$|^\d+-\d+(\.\d+)?$|^\d+'\s*\d"), first("(?i)^(dns|dnf|dq|fs|scr|nt|nm|nh|nd)$"))
    number, heat = F.regexp_extract(row, r"\bround_(\d+)", 1), F.regexp_extract(row, r"\bheat_\w+?_(\w+?)\b", 1)
    label = F.when(number == "4", "Finals").when(number != "", "Preliminaries").when(heat != "", F.concat(F.lit("Heat "), heat)).otherwise("Finals")
    out = _once(rows, label.alias("round"), mark.alias("mark_raw"), F.regexp_extract(F.get(texts, F.lit(0)), r"^(\d+)", 1).try_cast("int").alias("place"))
    return out.where("mark_raw IS NOT NULL").drop("__hidden", "__texts", "__row")
