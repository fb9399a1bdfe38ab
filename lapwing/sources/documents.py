"""JSON feeds as rows: typed document fields, maps of maps, joined documents, payloads of unknown shape, record sets and rosters.

A text that is no JSON of the shape gives no rows. What JSON functions of Spark can't walk (a value of any depth) is one small function per value, applied by Arrow batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

#: The wrappers of a typed value and what they hold.
NUMBERS, PLAIN = ("integerValue", "doubleValue"), ("stringValue", "booleanValue", "timestampValue", "referenceValue", "bytesValue")
#: Fixed value: a text of fewer letters meets none of the JSON reader's limits (1,000 levels, 1,000 digits), so that no row takes others with it.
ALONE = 1000
NESTED = frozenset((dict, list))


def _plain(value):
    """A typed value of any depth as plain JSON."""
    if not isinstance(value, dict):
        return value
    if "nullValue" in value:
        return None
    for kind in PLAIN:
        if kind in value:
            return value[kind]
    if "integerValue" in value:
        return int(value["integerValue"])
    if "doubleValue" in value:
        return float(value["doubleValue"])
    if "arrayValue" in value:
        return [_plain(x) for x in value["arrayValue"].get("values", [])]
    if "mapValue" in value:
        return {k: _plain(x) for k, x in value["mapValue"].get("fields", {}).items()}
    return value


def _load(text):
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


@F.pandas_udf(StringType())
def plain_fields(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A typed document (name, fields) as plain JSON with id, the last part of its name; null for what is no document."""

    def one(text):
        doc = _load(text)
        if not isinstance(doc, dict):
            return None
        fields = {k: _plain(x) for k, x in (doc.get("fields") or {}).items()}
        return json.dumps(fields | {"id": str(doc.get("name") or "").split("/")[-1] or None})

    for batch in texts:
        yield batch.map(one)


def typed_documents(docs: DataFrame, text: str, schema: StructType | str) -> DataFrame:
    """docs with the fields of their typed documents as columns of schema, in place of the text."""
    return docs.withColumn("__doc", F.from_json(plain_fields(F.col(text)), schema)).drop(text).select("*", "__doc.*").drop("__doc")


def nested_entries(feeds: DataFrame, text: str, event: str, entries: str, entry: str) -> DataFrame:
    """Rows of a map of events that each hold a map of entries: event_key, entry_key, event (struct of event's fields) and entry. event and entry are schemas in DDL form."""
    schema = f"MAP<STRING, STRUCT<{event}, {entries}: MAP<STRING, STRUCT<{entry}>>>>"
    keep = [c for c in feeds.columns if c != text]
    events = feeds.select(*keep, F.explode(F.from_json(text, schema)).alias("event_key", "event")).where("event IS NOT NULL")
    return events.select(*keep, "event_key", F.explode(F.col(f"event.{entries}")).alias("entry_key", "entry"), F.col("event").dropFields(entries).alias("event")).where("entry IS NOT NULL")


def first_known(*values: Column) -> Column:
    """The first value that isn't null or blank, as trimmed text."""
    return F.coalesce(*[F.nullif(F.trim(v.cast("string")), F.lit("")) for v in values])


def joined_entries(events: DataFrame, entries: DataFrame, event_id: str, entry_event: str, wanted: Column) -> DataFrame:
    """Entries with the wanted event that they name; entries of other events are left out."""
    return entries.join(events.where(wanted), F.col(entry_event).cast("string") == F.col(event_id).cast("string"))


def _relay_rows(value, found: list) -> list:
    """Every object with a list of athletes, a team and a mark or status, wherever it lies, outer ones first. A stack of its own, as payloads may be deep; of what an object or list holds, only objects and lists are put on it."""
    stack = [value]
    while stack:
        v = stack.pop()
        if type(v) is dict:
            if isinstance(v.get("athletes"), list) and (v.get("teamName") or v.get("teamsAbbr")) and (v.get("mark") is not None or v.get("status") is not None):
                found.append(v)
            v = v.values()
        elif type(v) is not list:
            continue
        inner = [x for x in v if type(x) in NESTED]
        inner.reverse()
        stack += inner
    return found


def _walk(text: Column, fields: Sequence[str]) -> Column:
    """The relay rows of a payload, each once and with these fields only, as JSON arrays of up to eight. A row of its own where an array has `ALONE` letters or more."""
    encode = json.JSONEncoder().encode

    def one(text):
        kept = {}
        for row in _relay_rows(_load(text), []):
            key = (str(row.get("id") or ""), str(row.get("teamName") or ""), str(row.get("mark") or row.get("status") or ""), str(row.get("place") or ""))
            if key not in kept:
                kept[key] = {k: row[k] for k in fields if k in row}
        rows, out = list(kept.values()), []
        for i in range(0, len(rows), 8):
            some = encode(rows[i : i + 8])
            out += [some] if len(some) < ALONE else [encode([row]) for row in rows[i : i + 8]]
        return out

    @F.pandas_udf(ArrayType(StringType()))
    def arrays(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(one)

    return arrays(text)


def relay_rows(payloads: DataFrame, text: str, schema: StructType | str) -> DataFrame:
    """payloads, one row per relay row found in a payload of any shape, each once (id, team, mark or status, place), as struct row of schema."""
    keep, shape = [c for c in payloads.columns if c != text], StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrays = payloads.select(*keep, F.explode(_walk(F.col(text), shape.names)).alias("__rows"))
    # outer: a row that can't be read is a row of nulls
    rows = arrays.select(*keep, F.explode_outer(F.from_json("__rows", ArrayType(shape))).alias("row"))
    return rows.withColumn("row", F.coalesce("row", F.from_json(F.lit("{}"), shape)))


def record_set(rows: DataFrame, text: str, schema: str) -> DataFrame:
    """A JSON array of objects as an inline table with the columns of schema (DDL)."""
    keep = [c for c in rows.columns if c != text]
    return rows.select(*keep, F.inline(F.from_json(text, f"ARRAY<STRUCT<{schema}>>")))


def rosters(spark: SparkSession, paths: str | Sequence[str], schema: str, genders: Sequence[tuple[str, str]] = (("men", "M"), ("women", "F"))) -> DataFrame:
    """Roster files that hold an array of athletes per gender, as one table with gender and division (the folder above the file)."""
    shape = ", ".join(f"{name}: ARRAY<STRUCT<{schema}>>" for name, _ in genders)
    files = spark.read.json(paths, schema=shape.replace(": ARRAY", " ARRAY"), multiLine=True).withColumn("division", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))
    out = None
    for name, code in genders:
        part = files.select("division", F.lit(code).alias("gender"), F.inline(name))
        out = part if out is None else out.unionByName(part)
    return out
