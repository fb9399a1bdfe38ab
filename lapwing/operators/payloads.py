"""JSON payloads of any shape as Variant values: canonical text and its hash, nulls stripped, merges, key tests; an append-only log of versions.

A payload that isn't JSON, or names a key twice in one object, is null. Canonical text has its keys in order at every depth, no white space, and numbers without trailing zeros,
so two payloads that say the same have one hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# stand for an escaped backslash and an escaped quote, as raw control characters can't be in JSON
_BACKSLASH, _QUOTE = "\u0001", "\u0002"
_STRING = '"[^"]*+"'


def canonical(text: Column) -> Column:
    return F.to_json(F.try_parse_json(text))


def digest(text: Column) -> Column:
    """SHA-256 of the canonical text."""
    return F.sha2(canonical(text), 256)


def strip_nulls(text: Column) -> Column:
    """Canonical text without the fields of objects, at any depth, that are null; nulls in arrays stay.

    One pass takes out fields, with the comma before them, and steps over strings as wholes; a second takes out a comma that is left at an object's start.
    """
    plain = F.replace(F.replace(canonical(text), F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))
    gone = F.regexp_replace(plain, rf",?{_STRING}:null(?=[,}}])|({_STRING})", "$1")
    tidy = F.regexp_replace(gone, rf"(\{{),|({_STRING})", "$1$2")
    return F.replace(F.replace(tidy, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))


def _fields(text: Column) -> Column:
    """The fields of an object by name; null for what is no object."""
    return F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>")


def merged(a: Column, b: Column) -> Column:
    """Canonical text of two objects put together; of a field that both have, that of b stands, null too. The other where one is no object."""
    both = F.map_zip_with(_fields(a), _fields(b), lambda k, x, y: F.coalesce(y, x))
    return F.coalesce(F.to_json(F.call_function("to_variant_object", both)), canonical(b), canonical(a))


def has_key(text: Column, key: str) -> Column:
    """Whether an object has a field, null or not; false for what is no object."""
    return F.coalesce(F.map_contains_key(_fields(text), key), F.lit(False))


def text_at(text: Column, path: str) -> Column:
    """The value at a path ($.a.b[0]) as text: a string itself, anything else as JSON; null if it isn't there or is null."""
    return F.try_variant_get(F.try_parse_json(text), path, "string")


def nested(fields: Column, *, where: Column | None = None, order: Sequence[str] = ()) -> Column:
    """An aggregate: the structs of a group as a JSON array, in the order of their fields or of those named, [] where there are none. where: which rows count."""
    kept = F.collect_list(F.when(where, fields) if where is not None else fields)
    return F.to_json(F.array_sort(kept, _by(order)) if order else F.array_sort(kept))


def _by(order: Sequence[str]):
    """Compares structs field by field; a name that begins with - turns its order. Nulls come last."""
    def one(x: Column, y: Column, name: str) -> Column:
        a, b = x[name.lstrip("-")], y[name.lstrip("-")]
        a, b = (b, a) if name.startswith("-") else (a, b)
        empty = F.when(x[name.lstrip("-")].isNull() & y[name.lstrip("-")].isNull(), 0).when(x[name.lstrip("-")].isNull(), 1).when(y[name.lstrip("-")].isNull(), -1)
        return F.coalesce(empty, F.when(a < b, -1).when(a > b, 1).otherwise(0))

    def compare(x: Column, y: Column) -> Column:
        out = F.lit(0)
        for name in reversed(order):
            step = one(x, y, name)
            out = F.when(step != 0, step).otherwise(out)
        return out

    return compare


def append_versions(log: DataFrame | None, deliveries: DataFrame, key: str, payload: str, at: str) -> DataFrame:
    """New rows of a log of versions (key, hash, payload, at): what deliveries say that the log doesn't hold yet, each once, as first delivered.

    log None is empty. A delivery that comes again adds nothing. The payload is kept in canonical form; what is no JSON, or has no key, is left out.
    """
    rows = deliveries.select(key, canonical(F.col(payload)).alias("payload"), at).where(F.col(key).isNotNull() & F.col("payload").isNotNull()).withColumn("hash", F.sha2("payload", 256))
    first = rows.groupBy(key, "hash").agg(F.first("payload").alias("payload"), F.min(at).alias(at))
    return first if log is None else first.join(log.select(key, "hash"), [key, "hash"], "left_anti")
