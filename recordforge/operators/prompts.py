"""Prompts from row fields, compiled once into a Column."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructType

# Fixed pattern: a placeholder names a field, with dots for nested fields and an optional filter.
PLACEHOLDER = re.compile(r"\{\{\s*([A-Za-z_][\w.]*)\s*(?:\|\s*(upper|lower|length|trim|truncate\(\s*\d+\s*\))\s*)?\}\}")
MARK = re.compile(r"\{\{|\{%|\{#")
FILTERS = {"upper": F.upper, "lower": F.lower, "length": F.length, "trim": F.trim}


def context(df: DataFrame, config: Mapping[str, object] | None = None, global_context: Mapping[str, object] | None = None) -> DataFrame:
    """Template context: row fields win over config values, `global_context` wins over both."""
    extra = {k: F.lit(v) for k, v in (config or {}).items() if k not in df.columns}
    extra |= {k: F.lit(v) for k, v in (global_context or {}).items()}
    return df.withColumns(extra) if extra else df


LEEWAY = 5  # fixed value: characters beyond the limit that do not yet make a text too long
DOTS = "..."


def truncated(text: Column, most: int) -> Column:
    """Texts up to `most` characters and a little more stay; longer ones end at a word, with dots within the limit."""
    start = F.left(text, F.lit(max(0, most - len(DOTS))))
    whole_words = F.when(F.contains(start, F.lit(" ")), F.regexp_replace(start, "(?s) [^ ]*$", "")).otherwise(start)
    return F.when(F.char_length(text) > most + LEEWAY, F.concat(whole_words, F.lit(DOTS))).otherwise(text)


def _plain(text: str) -> Column:
    if found := MARK.search(text):
        raise ValueError(f"Template mark that is not built: {text[found.start() : found.start() + 40]!r}")
    return F.lit(text)


def compile_template(template: str, schema: StructType | None = None) -> Column:
    """A Column for the template text. A field that does not exist fails when the query is analyzed.

    Blocks, comments and unknown filters raise an error. With a schema, booleans read `True` and `False`.
    """
    parts: list[Column] = []
    at = 0
    for m in PLACEHOLDER.finditer(template):
        if m.start() > at:
            parts.append(_plain(template[at : m.start()]))
        names = m.group(1).split(".")
        value = F.col(".".join(f"`{p}`" for p in names))
        kind = schema
        for name in names:
            kind = next((f.dataType for f in kind.fields if f.name == name), None) if isinstance(kind, StructType) else None
        text = F.initcap(value.cast("string")) if isinstance(kind, BooleanType) else value.cast("string")
        if m.group(2):
            name, _, most = m.group(2).partition("(")
            text = truncated(text, int(most.rstrip(") "))) if most else FILTERS[name](text)
        parts.append(F.coalesce(text.cast("string"), F.lit("None")))
        at = m.end()
    if at < len(template):
        parts.append(_plain(template[at:]))
    return F.concat(*parts) if parts else F.lit("")


def each(items: Column, render, separator: str = "") -> Column:
    """The loop of a template: render every element and join."""
    return F.array_join(F.transform(items, render), separator)


def render_prompts(
    df: DataFrame,
    template: str | Column,
    step: str = "",
    config: Mapping[str, object] | None = None,
    global_context: Mapping[str, object] | None = None,
) -> DataFrame:
    """(unit_id, step, prompt) per unit. `template` is text with `{{field}}` marks, or a Column for branches and loops."""
    ready = context(df, config, global_context)
    prompt = compile_template(template, ready.schema) if isinstance(template, str) else template
    return ready.select("unit_id", F.lit(step).alias("step"), prompt.alias("prompt"))
