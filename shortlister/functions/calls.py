"""Text expressions of generated calls: blocks, names, arguments, types."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed formats: a marked block, and a function with its parameters.
BLOCK = r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"
FUNCTION = r"(?s)<function=([^>\s]+)\s*>(.*?)</function>"
PARAMETER = r"(?s)<parameter=([^>\s]+)\s*>(.*?)</parameter>"
#: What \\s stands for.
SPACE = " \t\n\x0b\f\r"
#: Fixed aliases of parameter types; any other is a string.
TYPES = {"int": "integer", "integer": "integer", "float": "number", "number": "number", "double": "number", "bool": "boolean", "boolean": "boolean", "list": "array", "array": "array", "dict": "object", "object": "object"}
_INTEGER = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"
_NUMBER = r"(?i)^\s*[+-]?(([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)(e[+-]?[0-9]+(_[0-9]+)*)?|inf|infinity|nan)\s*$"


def sanitize(name: Column) -> Column:
    """Anything but letters, digits, underscore and hyphen becomes an underscore."""
    return F.regexp_replace(name, "[^A-Za-z0-9_-]", "_")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blocks(text: Column) -> Column:
    """The marked blocks; without any, the whole text if it has a function."""
    none = F.array().cast("array<string>")
    marked = F.regexp_extract_all(text, F.lit(BLOCK), F.lit(1))
    whole = F.when(F.contains(text, F.lit("<function=")) & text.rlike(FUNCTION), F.array(text)).otherwise(none)
    return F.when(F.contains(text, F.lit("<tool_call>")), let(marked, lambda m: F.when(F.size(m) > 0, m).otherwise(whole))).otherwise(whole)


def is_call(block: Column) -> Column:
    """Whether ``xml_call`` or ``json_call`` gives a call, without its arguments."""
    # Texts without what either needs are told apart by a search, before a pattern or a failing parser meets them.
    function = F.contains(block, F.lit("<function=")) & F.contains(block, F.lit("</function>"))
    named = F.contains(block, F.lit("}")) & (F.contains(block, F.lit('"name"')) | F.contains(block, F.lit("\\")))
    return (function & block.rlike(FUNCTION)) | (named & F.try_variant_get(F.try_parse_json(block), "$.name", "string").isNotNull())


def _last_of_each(pairs: Column) -> Column:
    """A map in which a later entry replaces an earlier one of the same key."""
    def in_order(pairs: Column) -> Column:
        return F.array_sort(F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), i.alias("i"), p["v"].alias("v"))))

    def last(rows: Column) -> Column:
        following = F.slice(rows, F.lit(2), F.size(rows))
        kept = F.zip_with(rows, following, lambda x, y: F.when(~x["k"].eqNullSafe(y["k"]), F.struct(x["k"].alias("k"), x["v"].alias("v"))))
        return F.map_from_entries(F.filter(kept, lambda x: x.isNotNull()))

    def of(pairs: Column) -> Column:
        alone = F.size(F.array_distinct(F.transform(pairs, lambda p: p["k"]))) == F.size(pairs)
        return F.when(alone, F.map_from_entries(F.sort_array(pairs))).otherwise(let(in_order(pairs), last))

    return let(pairs, of)


def _opened(element: Column, tag: str, found: Callable[[Column, Column], Column]) -> Column:
    """``found`` of the name in an opening tag and what stands between it and the closing one."""

    def opened(head: Column) -> Column:
        name = F.rtrim(F.substr(head, F.lit(len(tag) + 3)), F.lit(SPACE))
        body = F.substr(element, F.length(head) + 2, F.length(element) - F.length(head) - len(tag) - 4)
        return found(name, body)

    return let(F.substring_index(element, ">", 1), opened)


def xml_call(block: Column) -> Column:
    """name and arguments of the first function in a block, or null."""

    def pair(element: Column) -> Column:
        return _opened(element, "parameter", lambda k, v: F.struct(k.alias("k"), F.btrim(v, F.lit(SPACE)).alias("v")))

    def call(name: Column, body: Column) -> Column:
        return F.struct(name.alias("name"), _last_of_each(F.transform(F.regexp_extract_all(body, F.lit(PARAMETER), F.lit(0)), pair)).alias("args"))

    return let(F.regexp_extract(block, FUNCTION, 0), lambda whole: F.when(whole != "", _opened(whole, "function", call)))


def json_call(block: Column) -> Column:
    """name and arguments of a JSON object with a name, or null; arguments that are no object stand under ``_value``."""

    def call(parsed: Column) -> Column:
        name = F.try_variant_get(parsed, "$.name", "string")
        args = F.try_variant_get(parsed, "$.arguments", "map<string,string>")

        def coerced(raw: Column) -> Column:
            # A string may hold an object itself.
            inner = F.when(raw.startswith("{") & F.try_parse_json(raw).isNotNull(), F.from_json(raw, "map<string,string>"))
            return F.coalesce(inner, F.when(raw.isNotNull(), F.create_map(F.lit("_value"), raw)), F.create_map().cast("map<string,string>"))

        return F.when(name.isNotNull(), F.struct(name.alias("name"), F.coalesce(args, let(F.try_variant_get(parsed, "$.arguments", "string"), coerced)).alias("args")))

    return let(F.try_parse_json(block), call)


def coercible(value: Column, kind: Column) -> Column:
    """Whether text can be read as a value of a type; unknown types accept all."""
    trimmed = F.trim(value)
    parsed = F.schema_of_variant(F.try_parse_json(value))
    return (
        F.when(kind == "integer", value.rlike(_INTEGER))
        .when(kind == "number", value.rlike(_NUMBER))
        .when(kind == "boolean", F.lower(trimmed).isin("true", "false"))
        .when(kind == "array", F.coalesce(parsed.startswith("ARRAY"), F.lit(False)))
        .when(kind == "object", F.coalesce(parsed.startswith("OBJECT"), F.lit(False)))
        .otherwise(F.lit(True))
    )


def normalise(text: Column) -> Column:
    """Lower case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def json_type(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.coalesce(kind, F.lit("string")))), F.lit("string"))


def args_text(args: Column) -> Column:
    """k=v in order of keys, joined by semicolons."""
    entries = F.array_sort(F.map_entries(args))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ";")
