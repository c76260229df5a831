"""Reading JSON out of free-form response text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordforge.functions.variants import entries, json_type, let

# Fixed patterns: what counts as a fence, a plus sign before a number, and a trailing comma.
JSON_FENCE = r"(?s)```json(.*?)```"
ANY_FENCE = r"(?s)```(.*?)```"
PLUS_AFTER_KEY = (r'"\s*:\s*\+([0-9])', '": $1')
PLUS_AFTER_BRACKET = (r"\[\s*\+([0-9])", "[$1")
PLUS_AFTER_COMMA = (r",\s*\+([0-9])", ", $1")
TRAILING_COMMA = (r",\s*([}\]])", "$1")
OUTER_BLANKS = r"^[ \t\n\r\f\x0b]+|[ \t\n\r\f\x0b]+$"


def strip(text: Column) -> Column:
    """Remove blanks of every kind at both ends."""
    return F.regexp_replace(text, OUTER_BLANKS, "")


def unfence(text: Column) -> Column:
    """The body of the first ```json fence, else of the first plain fence, else the text.

    A fence counts only if it is closed and not empty.
    """
    in_json, in_any = F.regexp_extract(text, JSON_FENCE, 1), F.regexp_extract(text, ANY_FENCE, 1)
    marked = text.contains("```json")
    return (
        F.when(marked & (in_json != ""), strip(in_json))
        .when(~marked & (in_any != ""), strip(in_any))
        .otherwise(text)
    )


def drop_plus_signs(text: Column) -> Column:
    for pattern, to in (PLUS_AFTER_KEY, PLUS_AFTER_BRACKET, PLUS_AFTER_COMMA):
        text = F.regexp_replace(text, pattern, to)
    return text


def drop_trailing_commas(text: Column) -> Column:
    return F.regexp_replace(text, *TRAILING_COMMA)


def repaired_text(text: Column) -> Column:
    return drop_trailing_commas(drop_plus_signs(unfence(strip(text))))


def repair_json(text: Column, safe: bool = False) -> Column:
    """Response text to VARIANT; NULL if it cannot be read as JSON.

    The repairs also touch text inside JSON strings. `safe` first tries the fence body as it is.
    """
    fixed = F.try_parse_json(repaired_text(text))
    return F.coalesce(F.try_parse_json(unfence(strip(text))), fixed) if safe else fixed


def unwrap_response(data: Column, required: list[str]) -> Column:
    """Lift the fields of a JSON object that is wrapped as text in a `response` field.

    Only done if a required field is missing outside and at least one of the missing ones is inside. Fields that exist
    outside stay as they are; `response` itself is replaced or dropped.
    """
    if not required:
        return data
    wrapped = F.try_variant_get(F.try_element_at(data, F.lit("response")), "$", "string")
    is_text = json_type(F.try_element_at(data, F.lit("response"))) == "string"
    bare = strip(wrapped)
    opened = F.regexp_replace(bare, r"^```([^\n]*\n)?", "")
    closed = strip(F.regexp_replace(opened, r"```$", ""))
    inner = entries(F.try_parse_json(drop_trailing_commas(closed)))

    def missing_but_inside(found: Column) -> Column:
        hit = F.lit(False)
        for name in required:
            hit = hit | (~F.map_contains_key(data, F.lit(name)) & F.map_contains_key(found, F.lit(name)))
        return hit

    def merged(found: Column) -> Column:
        outer = F.map_filter(data, lambda k, _: k != "response")
        added = F.map_filter(found, lambda k, _: ~F.map_contains_key(outer, k))
        return F.map_concat(outer, added)

    return F.when(
        is_text, let(inner, lambda found: F.when(missing_but_inside(found), merged(found)).otherwise(data))
    ).otherwise(data)
