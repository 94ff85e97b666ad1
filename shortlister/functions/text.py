"""Text expressions of the catalogue: names, ids, descriptions, segments, junk marks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns that mark placeholder tools.
JUNK_NAME = (
    r"(?i)(^|[^a-z])(test|asdf|asd|qwerty|foo|bar|baz|hello ?world|petstore|reqres|swagger|"
    r"demo|sample|example|dont ?change|should ?be ?free|untitled|placeholder|tmp|xxx|todo|"
    r"myapi|new ?api|route-precedence)([^a-z]|$)"
)
HEX_TOOL = r"^[0-9a-f]{20,}$"
#: Fixed sentence ends: full-width ones need no space after them.
WIDE_ENDS = "。！？"
_TRIM = r"^[ ,;、，]+|[ ,;、，]+$"
CONJUNCTION = r"(?i),?\s+(?:and also|also,?|additionally,?|then|as well as|and then|plus,?)\s+"
MIN_CHARS = 12


def norm_name(x: Column) -> Column:
    """Lower-cased letters and digits only."""
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def norm_text(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def make_id(category: Column, tool: Column, api: Column) -> Column:
    return F.concat_ws("__", category, tool, api)


def service_key(tool_id: Column) -> Column:
    """The first two of three or more parts, else all."""
    parts = F.split(tool_id, "__")
    return F.when(F.size(parts) >= 3, F.concat_ws("__", F.slice(parts, 1, 2))).otherwise(tool_id)


def tool_segment(tool_id: Column) -> Column:
    parts = F.split(tool_id, "__")
    return F.when(F.size(parts) >= 3, F.element_at(parts, 2)).otherwise(tool_id)


def description_text(name: Column, description: Column, parameters: Column) -> Column:
    """The non-empty ones of name, description and the list of parameters."""
    listed = F.when(F.size(parameters) > 0, F.concat(F.lit("Parameters: "), F.array_join(parameters, ", "))).otherwise("")
    return F.array_join(F.filter(F.array(F.coalesce(name, F.lit("")), F.coalesce(description, F.lit("")), listed), lambda x: x != ""), ". ")


def junk_reasons(tool_id: Column, name: Column, description: Column, fallback: Column) -> tuple[Column, Column, Column]:
    """clearly_junk, missing_meta, reasons."""
    tool, desc = tool_segment(tool_id), F.trim(F.coalesce(description, F.lit("")))
    word = desc.rlike("^[a-zA-Z]{3,8}$") & ~desc.rlike("(?i)[aeiou].*[aeiou]")
    checks = {"name_pattern": F.concat_ws(" ", tool, name).rlike(JUNK_NAME), "hex_tool": F.replace(tool, F.lit(" "), F.lit("")).rlike(HEX_TOOL), "gibberish_desc": word}
    lacks = {"desc_fallback": fallback, "short_desc": F.length(desc) < 12}
    some = lambda d: F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in d.items()]))
    junk, missing = some(checks), some(lacks)
    return F.size(junk) > 0, (F.size(junk) == 0) & (F.size(missing) > 0), F.concat(junk, missing)


def segments(query: Column, conjunctions: bool = False) -> Column:
    """Pieces of a query at sentence ends (and conjunctions), without empty ones."""
    marked = F.regexp_replace(F.regexp_replace(F.trim(query), f"([{WIDE_ENDS}])\\s*", "$1\u0001"), r"([.!?])\s+", "$1\u0001")
    if conjunctions:
        marked = F.regexp_replace(marked, CONJUNCTION, "\u0001")
    pieces = F.transform(F.split(marked, "\u0001", -1), lambda x: F.regexp_replace(x, _TRIM, ""))
    return F.filter(pieces, lambda x: x != "")


def merged_segments(query: Column, min_chars: int = MIN_CHARS, conjunctions: bool = False) -> Column:
    """Short pieces joined to the piece before; the query itself if nothing is left."""

    def step(acc: Column, piece: Column) -> Column:
        n = F.size(acc)
        joined = F.concat(F.slice(acc, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.concat_ws(" ", F.element_at(acc, -1), piece)))
        return F.when((n > 0) & (F.length(piece) < min_chars), joined).otherwise(F.concat(acc, F.array(piece)))

    out = F.aggregate(segments(query, conjunctions), F.array().cast("array<string>"), step)
    whole = F.when(F.trim(query) != "", F.trim(query)).otherwise(query)
    return F.when(F.size(out) > 0, out).otherwise(F.array(whole))
