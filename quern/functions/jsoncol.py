"""JSON text columns as dictionaries and lists. Missing keys and null columns give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import col

ENTRIES = "map<string,string>"


def serialised(c: Column | str) -> Column:
    """JSON text of a struct, map or array; null stays null."""
    return F.to_json(col(c))


def deserialised(c: Column | str, schema: str) -> Column:
    """A struct, map or array from JSON text; null and empty text give null."""
    return F.when(F.trim(col(c)) != "", F.from_json(col(c), schema))


def parsed(c: Column | str) -> Column:
    """A VARIANT, null where the text is no JSON."""
    return F.try_parse_json(col(c))


def get(c: Column | str, key: str, kind: str = "string") -> Column:
    return F.try_variant_get(parsed(c), f"$['{checked(key)}']", kind)


def checked(key: str) -> str:
    if "'" in key or "\\" in key:
        raise ValueError("quotes and backslashes are not allowed in keys")
    return key


def entries(c: Column | str) -> Column:
    """The members of a JSON object, values as JSON text."""
    return F.from_json(col(c), ENTRIES)


def keys(c: Column | str) -> Column:
    return F.json_object_keys(col(c))


def has_key(c: Column | str, key: str) -> Column:
    return F.coalesce(F.array_contains(keys(c), key), F.lit(False))


def rebuilt(pairs: Column) -> Column:
    """A JSON object from an array of (key, value as JSON text)."""
    quoted = lambda k: F.regexp_extract(F.to_json(F.array(k)), r"^\[(.*)\]$", 1)
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: F.concat(quoted(p["key"]), F.lit(":"), p["value"])), ","), F.lit("}"))


def members(c: Column | str) -> Column:
    """(key, value as JSON text) of an object's members in order; an empty array for null."""
    found = F.transform(keys(c), lambda k: F.struct(k.alias("key"), F.to_json(F.variant_get(F.parse_json(col(c)), F.concat(F.lit("$['"), k, F.lit("']")), "variant")).alias("value")))
    return F.coalesce(found, F.array().cast("array<struct<key:string,value:string>>"))


def put(c: Column | str, key: str, value: Column) -> Column:
    """The object with the key set; value is any column, written as JSON."""
    text = F.regexp_extract(F.to_json(F.array(value)), r"(?s)^\[(.*)\]$", 1)
    kept = F.filter(members(c), lambda m: m["key"] != key)
    return rebuilt(F.concat(kept, F.array(F.struct(F.lit(key).alias("key"), text.alias("value")))))


def remove(c: Column | str, key: str) -> Column:
    return F.when(col(c).isNotNull(), rebuilt(F.filter(members(c), lambda m: m["key"] != key)))


def items(c: Column | str, kind: str = "string") -> Column:
    return F.coalesce(F.from_json(col(c), f"array<{kind}>"), F.array().cast(f"array<{kind}>"))


def append(c: Column | str, value: Column, kind: str = "string") -> Column:
    return F.to_json(F.array_append(items(c, kind), value))


def drop_first(c: Column | str, value: Column, kind: str = "string") -> Column:
    """Without the first item that equals value."""
    found = items(c, kind)
    at = F.array_position(found, value).cast("int")
    rest = F.concat(F.slice(found, F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(found, F.greatest(at, F.lit(0)) + 1, F.size(found)))
    return F.when(at > 0, F.to_json(rest)).otherwise(F.to_json(found))


def item(c: Column | str, index: int, kind: str = "string") -> Column:
    return F.get(items(c, kind), F.lit(index))


def length(c: Column | str) -> Column:
    return F.size(items(c))
