"""Attributes of OTLP log batches.

Attribute values are one-of wrappers.  They are read as a struct of texts:
numbers become their text, nested values stay raw JSON and are decoded only
where a row has one.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ANY_VALUE = (
    "struct<stringValue:string,intValue:string,doubleValue:string,boolValue:string,"
    "arrayValue:string,kvlistValue:string>"
)
LISTED, KEYED = "struct<values:array<string>>", "struct<values:array<struct<key:string,value:string>>>"
#: The same value with the parts of an array or list already apart.
PARTED_VALUE = f"struct<stringValue:string,intValue:string,doubleValue:string,boolValue:string,arrayValue:{LISTED},kvlistValue:{KEYED}>"
ATTRIBUTES = f"array<struct<key:string,value:{ANY_VALUE}>>"


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), F.lit(1))


def scalar_text(value: Column) -> Column:
    return F.coalesce(value["stringValue"], value["intValue"], value["doubleValue"], value["boolValue"])


def quoted(text: Column) -> Column:
    """A text as a JSON string; null stays null."""
    return F.when(text.isNotNull(), bound(F.to_json(F.array(text)), lambda listed: F.substring(listed, F.lit(2), F.length(listed) - 2)))


def _piece(text: Column, wrapped: Column | None = None) -> Column:
    """A piece of output, and the wrapped value that follows it and is still to be opened."""
    return F.struct(text.alias("text"), (F.lit(None).cast("string") if wrapped is None else wrapped).alias("wrapped"))


def _opened(value: Column, items: Column, pairs: Column, before: Column) -> Column:
    """One level of a value behind the text ``before``: its plain text, or brackets around its wrapped parts."""
    plain = F.coalesce(quoted(value["stringValue"]), value["intValue"], value["doubleValue"], value["boolValue"])

    def part(i: Column, begin: str, name: Column, wrapped: Column) -> Column:
        opening = F.when(i == 0, F.concat(before, F.lit(begin))).otherwise(",")
        return _piece(F.concat(opening, name, F.when(wrapped.isNull(), "null").otherwise("")), wrapped)

    def around(begin: str, parts: Column, end: str) -> Column:
        return bound(
            parts,
            lambda x: F.when(F.size(x) > 0, F.concat(x, F.array(_piece(F.lit(end))))).otherwise(
                F.array(_piece(F.concat(before, F.lit(begin + end))))
            ),
        )

    listed = F.transform(items, lambda v, i: part(i, "[", F.lit(""), v))
    keyed = F.transform(
        pairs, lambda kv, i: part(i, "{", F.concat(F.coalesce(quoted(kv["key"]), F.lit('""')), F.lit(":")), kv["value"])
    )
    return (
        F.when(scalar_text(value).isNotNull(), F.array(_piece(F.concat(before, plain))))
        .when(value["arrayValue"].isNotNull(), around("[", listed, "]"))
        .when(value["kvlistValue"].isNotNull(), around("{", keyed, "}"))
        .otherwise(F.array(_piece(F.concat(before, F.lit("null")))))
    )


def _opened_raw(value: Column, before: Column) -> Column:
    """One level of a value whose array or list is still JSON text."""
    return _opened(value, F.from_json(value["arrayValue"], LISTED)["values"], F.from_json(value["kvlistValue"], KEYED)["values"], before)


def _opened_json(json: Column, before: Column) -> Column:
    """One level of a value as JSON text, read once; a value that shows nothing, an odd one perhaps, is read again as its plain texts."""

    def parted(v: Column) -> Column:
        shown = F.coalesce(scalar_text(v).isNotNull() | v["arrayValue"].isNotNull() | v["kvlistValue"].isNotNull(), F.lit(False))
        again = bound(F.from_json(json, ANY_VALUE), lambda raw: _opened_raw(raw, before))
        return F.when(shown, _opened(v, v["arrayValue"]["values"], v["kvlistValue"]["values"], before)).otherwise(again)

    return bound(F.from_json(json, PARTED_VALUE), parted)


def nested_text(value: Column) -> Column:
    """Arrays and key-value lists as plain JSON text, at any depth.

    The value is a list of finished pieces, each with the wrapped value that
    follows it, if any.  Each pass opens the wrapped ones by a level, each
    read once, and the passes end when none is left; a value has at most as
    many levels as its text has wrappers.
    """
    raw = F.coalesce(value["arrayValue"], value["kvlistValue"])
    levels = F.regexp_count(raw, F.lit('"(arrayValue|kvlistValue)"')) + 2

    def state(pieces: Column) -> Column:
        return bound(pieces, lambda ps: F.struct(ps.alias("pieces"), F.exists(ps, lambda p: p["wrapped"].isNotNull()).alias("open")))

    def opened(p: Column) -> Column:
        return F.when(p["wrapped"].isNull(), F.array(p)).otherwise(_opened_json(p["wrapped"], p["text"]))

    def deeper(at: Column, _: Column) -> Column:
        return F.when(at["open"], state(F.flatten(F.transform(at["pieces"], opened)))).otherwise(at)

    last = F.aggregate(F.sequence(F.lit(1), levels), state(_opened_raw(value, F.lit(""))), deeper)
    return F.when(raw.isNotNull(), F.array_join(F.transform(last["pieces"], lambda p: p["text"]), ""))


def any_value(value: Column) -> Column:
    """Decoded attribute value as text; nested values as plain JSON."""
    return F.coalesce(scalar_text(value), nested_text(value))


def attribute(attributes: Column, key: str) -> Column:
    """First value of that key, '' when absent."""
    hits = F.filter(attributes, lambda a: a["key"] == key)
    return F.coalesce(F.try_element_at(F.transform(hits, lambda a: any_value(a["value"])), F.lit(1)), F.lit(""))


def attribute_map(attributes: Column) -> Column:
    """Attribute list as a map; of equal keys the last one counts."""
    keys = F.transform(attributes, lambda a: F.coalesce(a["key"], F.lit("")))
    unique = F.size(F.array_distinct(keys)) == F.size(keys)
    last = F.transform(
        F.array_distinct(keys),
        lambda k: F.element_at(F.filter(attributes, lambda a: F.coalesce(a["key"], F.lit("")) == k), -1),
    )
    kept = F.when(unique, attributes).otherwise(last)
    return F.map_from_entries(
        F.transform(kept, lambda a: F.struct(F.coalesce(a["key"], F.lit("")), any_value(a["value"])))
    )


def flat_names(values: Column, prefix: str = "") -> Column:
    """Map with dots in its keys replaced by underscores, and a prefix; of names that become equal the last one counts."""

    def name(entry: Column) -> Column:
        return F.concat(F.lit(prefix), F.replace(entry["key"], F.lit("."), F.lit("_")))

    def as_map(entries: Column) -> Column:
        def last(names: Column) -> Column:
            found = F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: e["key"] == n), -1))
            return F.when(F.size(names) == F.size(entries), entries).otherwise(found)

        return F.map_from_entries(bound(F.array_distinct(F.transform(entries, lambda e: e["key"])), last))

    renamed = F.transform(F.map_entries(values), lambda e: F.struct(name(e).alias("key"), e["value"].alias("value")))
    return bound(renamed, as_map)


def without_keys(values: Column, names: list[str]) -> Column:
    return F.map_filter(values, lambda k, v: ~k.isin(names))
