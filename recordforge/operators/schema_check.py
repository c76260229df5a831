"""Type coercion and schema validation of JSON values, compiled from a schema into Columns.

The schema is walked once on the driver. Each node gives one Column that binds the value, coerces it, and lists the
errors and the coercions made; objects and arrays combine their children the same way, so depth costs no shuffle and no
Python.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordforge.functions.jsonfix import repair_json, unwrap_response
from recordforge.functions.variants import as_type, entries, instance_name, items, json_type, let, type_name
from recordforge.session import evaluated_once, settle

ERROR = "struct<path:string,rule:string,message:string,validator:string,validator_value:string,instance_type:string>"
NOTE = "struct<path:string,from:string,to:string>"
# Fixed patterns: whole numbers and decimals as they may stand in a string, and the enum decorations that are dropped.
INT_TEXT = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"
FLOAT_TEXT = r"^\s*[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?\s*$"
ENUM_PREFIX = "shadow "
ENUM_DELIMITER = " | "
# Fixed value: a number JSON cannot hold, between the marks that may surround a value.
NON_FINITE = r"([:\[,]\s*|^\s*)(-?Infinity|NaN)(?=\s*[,}\]]|\s*$)"
NON_FINITE_MARK = "\ue000non-finite:"


def no_errors() -> Column:
    return F.expr(f"cast(array() as array<{ERROR}>)")


def no_notes() -> Column:
    return F.expr(f"cast(array() as array<{NOTE}>)")


def error(path, rule: str, message, value=None, instance: Column | None = None) -> Column:
    """One error record; the rule name is `schema_<keyword>`."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    shown = None if value is None else (value if isinstance(value, str) else json.dumps(value))[:100]
    return F.struct(
        lit(path).alias("path"),
        F.lit(f"schema_{rule}").alias("rule"),
        lit(message).alias("message"),
        F.lit(rule).alias("validator"),
        F.lit(shown).cast("string").alias("validator_value"),
        (instance if instance is not None else F.lit(None).cast("string")).alias("instance_type"),
    ).cast(ERROR)


class SchemaError(ValueError):
    """A schema that cannot be checked as it stands."""


# The keywords that are checked, and those that only describe.
CHECKED = {
    "type", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "pattern",
    "minItems", "maxItems", "items", "properties", "additionalProperties", "required", "$ref",
}
DESCRIBING = {"$schema", "$id", "$defs", "$comment", "title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly"}
_REF = "#/$defs/"


def _assert_known(node: object, defs: Mapping, inside: tuple[str, ...] = ()) -> None:
    """Fail for keywords that are not built, unknown references, and structures that hold themselves."""
    if isinstance(node, bool):
        return
    if not isinstance(node, Mapping):
        raise SchemaError(f"Not a schema: {node!r}")
    if unknown := sorted(set(node) - CHECKED - DESCRIBING):
        raise SchemaError(f"Keywords that are not built: {', '.join(unknown)}")
    if "$ref" in node:
        target = node["$ref"].removeprefix(_REF)
        if not node["$ref"].startswith(_REF) or target not in defs:
            raise SchemaError(f"Unknown reference {node['$ref']!r}")
        if target in inside:
            raise SchemaError(f"Recursive reference {node['$ref']!r}")
        if _resolve(node, defs):
            _assert_known(defs[target], defs, (*inside, target))
    children = [*node.get("properties", {}).values()]
    children += [node[k] for k in ("items", "additionalProperties") if k in node]
    for child in children:
        _assert_known(child, defs, inside)


def _resolve(node: Mapping, defs: Mapping) -> Mapping:
    """Follow local references. Those that only lead in a circle say nothing."""
    seen = set()
    while "$ref" in node:
        target = node["$ref"].removeprefix(_REF)
        if target in seen:
            return {}
        seen.add(target)
        node = defs[target]
    return node


def _shown(v: Column) -> Column:
    return F.to_json(v)


class _Compiler:
    def __init__(self, schema: Mapping):
        self.defs = schema.get("$defs", {})
        _assert_known(schema, self.defs)

    # A node gives struct<v: variant, e: errors, n: notes>.
    def node(self, spec: Mapping, v: Column, path: Column) -> Column:
        spec = _resolve(spec, self.defs)
        kind = spec.get("type")
        if not spec:
            return self.result(v, no_errors(), no_notes())
        if kind in ("integer", "number", "boolean"):
            return self.leaf(spec, v, path)
        if kind == "array":
            return self.array(spec, v, path)
        if kind == "object" or (kind is None and ("properties" in spec or "required" in spec)):
            return self.object(spec, v, path)
        return self.leaf(spec, v, path)

    @staticmethod
    def result(v: Column, errors: Column, notes: Column) -> Column:
        return F.struct(v.alias("v"), errors.alias("e"), notes.alias("n"))

    @staticmethod
    def note(path: Column, before: Column, after: Column) -> Column:
        return F.struct(path.alias("path"), _shown(before).alias("from"), _shown(after).alias("to")).cast(NOTE)

    def leaf(self, spec: Mapping, v: Column, path: Column) -> Column:
        def with_type(b: Column) -> Column:
            coerced = self.coerced_scalar(spec, b.o, b.t)
            if coerced is None:
                return self.result(b.o, self.checks(spec, b.o, b.t, path), no_notes())
            new_type = spec.get("type", "string")
            changed = let(
                coerced.cast("variant"),
                lambda c: self.result(c, self.checks(spec, c, F.lit(new_type), path), F.array(self.note(path, b.o, c))),
            )
            return F.when(coerced.isNotNull(), changed).otherwise(
                self.result(b.o, self.checks(spec, b.o, b.t, path), no_notes())
            )

        return let(F.struct(v.alias("o"), json_type(v).alias("t")), with_type)

    def coerced_scalar(
        self, spec: Mapping, v: Column, t: Column, text: Column | None = None, number: Column | None = None
    ) -> Column | None:
        """The coerced value in its Spark type, NULL where nothing is coerced; None if the node never coerces.

        `text` and `number` are the value as string and double where the caller has them at hand.
        """
        kind = spec.get("type")
        text = as_type(v, "string") if text is None else text
        if kind == "integer":
            digits = F.regexp_replace(F.trim(text), "_", "").try_cast("bigint")
            number = as_type(v, "double") if number is None else number
            whole = F.when(number == F.floor(number), as_type(v, "decimal(38,10)").try_cast("bigint"))
            fixed = F.when((t == "string") & text.rlike(INT_TEXT), digits).when(t == "number", whole)
            return fixed
        if kind == "number":
            value = F.regexp_replace(F.trim(text), "_", "").try_cast("double")
            finite = (F.abs(value) < float("inf")) & ~F.isnan(value)
            return F.when((t == "string") & text.rlike(FLOAT_TEXT) & finite, value)
        if kind == "boolean":
            low = F.lower(text)
            return F.when((t == "string") & low.isin("true", "false"), low == "true")
        allowed = [x for x in spec.get("enum", []) if isinstance(x, str)]
        if allowed:
            bare = F.when(F.lower(text).startswith(ENUM_PREFIX), F.substr(text, F.lit(len(ENUM_PREFIX) + 1))).otherwise(text)
            key = F.lower(F.trim(F.substring_index(bare, ENUM_DELIMITER, 1)))
            canon = {}
            for x in allowed:
                canon.setdefault(x.lower(), x)
            table = F.create_map(*[F.lit(y) for pair in canon.items() for y in pair])
            hit = F.try_element_at(table, key)
            return F.when((t == "string") & ~text.isin(allowed), hit)
        return None

    def checks(
        self, spec: Mapping, v: Column, t: Column, path: Column, text: Column | None = None, number: Column | None = None
    ) -> Column:
        """Keyword checks of one value of JSON type `t`, without its children."""
        kind_name = instance_name(t)
        number = as_type(v, "double") if number is None else number
        text = as_type(v, "string") if text is None else text
        is_number, is_text = t.isin("integer", "number"), t == "string"
        found: list[Column] = []

        def add(bad: Column, rule: str, message: Column) -> None:
            found.append(F.when(F.coalesce(bad, F.lit(False)), error(path, rule, message, spec[rule], kind_name)))

        def text_of(*parts) -> Column:
            return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

        if "type" in spec:
            wanted = spec["type"] if isinstance(spec["type"], list) else [spec["type"]]
            fits = t.isin(wanted)
            if "number" in wanted:
                fits = fits | (t == "integer")
            if "integer" in wanted:
                fits = fits | ((t == "number") & (number == F.floor(number)) & (F.abs(number) < 2.0**63))
            add(~fits, "type", text_of(_shown(v), f" is not of type {', '.join(map(repr, wanted))}"))
        if "enum" in spec:
            texts = [x for x in spec["enum"] if isinstance(x, str)]
            others = [json.dumps(x) for x in spec["enum"] if not isinstance(x, str)]
            inside = (is_text & text.isin(texts)) if texts else F.lit(False)
            if others:
                inside = inside | (~is_text & _shown(v).isin(others))
            add(~inside, "enum", text_of(_shown(v), f" is not one of {spec['enum']}"))
        for rule, bad, said in (
            ("minimum", lambda m: number < m, "less than the minimum of"),
            ("maximum", lambda m: number > m, "greater than the maximum of"),
            ("exclusiveMinimum", lambda m: number <= m, "less than or equal to the minimum of"),
            ("exclusiveMaximum", lambda m: number >= m, "greater than or equal to the maximum of"),
        ):
            if rule in spec:
                add(is_number & bad(F.lit(float(spec[rule]))), rule, text_of(_shown(v), f" is {said} {spec[rule]}"))
        if "const" in spec:
            want = spec["const"]
            same = (is_text & (text == want)) if isinstance(want, str) else (~is_text & (_shown(v) == json.dumps(want)))
            add(~F.coalesce(same, F.lit(False)), "const", text_of(f"{want!r} was expected"))
        if "pattern" in spec:
            shown = text_of("'", text, f"' does not match {spec['pattern']!r}")
            add(is_text & ~F.rlike(text, F.lit(spec["pattern"])), "pattern", shown)
        size, count = F.char_length(text), F.size(items(v))
        for rule, applies, bad, said in (
            ("minLength", is_text, lambda m: size < m, "is too short"),
            ("maxLength", is_text, lambda m: size > m, "is too long"),
            ("minItems", t == "array", lambda m: count < m, "is too short"),
            ("maxItems", t == "array", lambda m: count > m, "is too long"),
        ):
            if rule in spec:
                add(applies & bad(F.lit(spec[rule])), rule, text_of(_shown(v), f" {said}"))
        return F.array_compact(F.array(*found)) if found else no_errors()

    def array(self, spec: Mapping, v: Column, path: Column) -> Column:
        child = spec.get("items")
        child = _resolve(child, self.defs) if isinstance(child, Mapping) else None
        if child and child.get("type") == "object" and "tag" in child.get("properties", {}):
            one = F.to_variant_object(F.array(F.create_map(F.lit("tag"), v)))
        else:
            one = F.to_variant_object(F.array(v))
        parsed = let(F.try_parse_json(as_type(v, "string")), lambda r: F.when(json_type(r) == "array", r).otherwise(one))
        kind = json_type(v)
        from_text = F.when(kind == "string", parsed)

        def with_items(b: Column) -> Column:
            now = F.coalesce(b.c, b.o)
            own = self.checks(spec, now, F.when(b.c.isNotNull(), F.lit("array")).otherwise(b.t), path)
            notes = F.when(b.c.isNotNull(), F.array(self.note(path, b.o, b.c))).otherwise(no_notes())
            if not child:
                return self.result(now, own, notes)
            parts = F.transform(
                F.coalesce(items(now), F.expr("cast(array() as array<variant>)")),
                lambda x, i: self.node(child, x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))),
            )
            return let(
                F.struct(now.alias("now"), parts.alias("p")),
                lambda s: self.result(
                    F.when(
                        F.exists(s.p, lambda r: F.size(r.n) > 0), F.to_variant_object(F.transform(s.p, lambda r: r.v))
                    ).otherwise(s.now),
                    F.concat(own, F.flatten(F.transform(s.p, lambda r: r.e))),
                    F.concat(notes, F.flatten(F.transform(s.p, lambda r: r.n))),
                ),
            )

        return let(F.struct(v.alias("o"), kind.alias("t"), from_text.alias("c")), with_items)

    def object(self, spec: Mapping, v: Column, path: Column) -> Column:
        def with_fields(fields: Column) -> Column:
            r = self.fields(spec, fields, path)
            return let(
                r,
                lambda s: self.result(
                    F.when(F.size(s.n) > 0, F.to_variant_object(s.m)).otherwise(v),
                    F.concat(self.checks(spec, v, F.lit("object"), path), s.e),
                    s.n,
                ),
            )

        def by_type(t: Column) -> Column:
            plain = self.result(v, self.checks(spec, v, t, path), no_notes())
            return F.when(t == "object", let(entries(v), with_fields)).otherwise(plain)

        return let(json_type(v), by_type)

    @staticmethod
    def unexpected(fields: Column, known: list[str], path: Column) -> Column:
        """The error of a closed object that holds other fields than the known ones."""
        others = F.array_sort(F.filter(F.map_keys(fields), lambda k: ~k.isin(known) if known else F.lit(True)))
        named = F.array_join(F.transform(others, lambda k: F.concat(F.lit("'"), k, F.lit("'"))), ", ")
        verb = F.when(F.size(others) == 1, F.lit("was")).otherwise(F.lit("were"))
        message = F.concat(F.lit("Additional properties are not allowed ("), named, F.lit(" "), verb, F.lit(" unexpected)"))
        return F.when(F.size(others) > 0, error(path, "additionalProperties", message, False, F.lit("dict")))

    def fields(self, spec: Mapping, fields: Column, path: Column) -> Column:
        """Check the fields of an object held as a map: struct<m: map, e: errors, n: notes>."""
        missing = [
            F.when(
                ~F.map_contains_key(fields, F.lit(name)),
                error(path, "required", f"'{name}' is a required property", spec["required"], F.lit("dict")),
            )
            for name in spec.get("required", [])
        ]
        known = spec.get("properties", {})
        checked: list[tuple[str, Column]] = []
        for name, child in known.items():
            value = F.try_element_at(fields, F.lit(name))
            at = F.concat(path, F.lit(f".{name}"))
            checked.append((name, F.when(F.map_contains_key(fields, F.lit(name)), self.node(child, value, at))))
        extra = spec.get("additionalProperties")
        rest = None
        if isinstance(extra, Mapping):
            others = F.map_filter(fields, lambda k, _: ~k.isin(list(known)) if known else F.lit(True))
            rest = F.transform(
                F.map_entries(others),
                lambda kv: F.struct(
                    kv.key.alias("k"), self.node(extra, kv.value, F.concat(path, F.lit("."), kv.key)).alias("r")
                ),
            )
        none = F.expr("cast(array() as array<struct<k:string,r:struct<v:variant,e:array<" + ERROR + ">,n:array<" + NOTE + ">>>>)")
        named = [F.when(r.isNotNull(), F.struct(F.lit(n).alias("k"), r.alias("r"))) for n, r in checked]
        done = F.array_compact(F.array(*named)) if named else none
        if rest is not None:
            done = F.concat(done, rest)
        if extra is False:
            missing.append(self.unexpected(fields, list(known), path))
        required = F.array_compact(F.array(*missing)) if missing else no_errors()

        def rebuilt(parts: Column) -> Column:
            new = F.map_from_entries(F.transform(parts, lambda p: F.struct(p.k, p.r.v)))
            if rest is not None:
                return new
            return F.map_concat(F.map_filter(fields, lambda k, _: ~k.isin(list(known)) if known else F.lit(True)), new)

        return let(
            done,
            lambda parts: F.struct(
                F.when(F.exists(parts, lambda p: F.size(p.r.n) > 0), rebuilt(parts)).otherwise(fields).alias("m"),
                F.concat(required, F.flatten(F.transform(parts, lambda p: p.r.e))).alias("e"),
                F.flatten(F.transform(parts, lambda p: p.r.n)).alias("n"),
            ),
        )


def mark_non_finite(text: Column) -> Column:
    """Bare NaN and Infinity as marked strings, so that the rest of the value can still be read."""
    return F.regexp_replace(text, NON_FINITE, f'$1"{NON_FINITE_MARK}$2"')


# Fixed pattern: strings, structural signs and other scalars of a JSON text.
_TOKEN = r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"]+'


def _non_finite_errors(root: Column) -> Column:
    """One error per marked number at any depth: a fold over the signs of the text with a stack of the steps that lead
    to the current place. A step is `.name` in an object and `[number]` in an array."""
    tokens = F.regexp_extract_all(F.to_json(root), F.lit(_TOKEN), F.lit(0))
    steps = "cast(array() as array<string>)"
    hit = "struct<path:string,value:string>"
    start = F.struct(F.expr(steps).alias("at"), F.lit(False).alias("name_next"), F.expr(f"cast(array() as array<{hit}>)").alias("hits"))

    def read(s: Column, t: Column) -> Column:
        at, hits = s["at"], s["hits"]
        top = F.try_element_at(at, F.lit(-1))
        below = F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0)))
        in_array = F.coalesce(top.startswith("["), F.lit(False))
        put = lambda under, step: F.concat(under, F.array(step))
        next_item = F.concat(F.lit("["), (F.regexp_extract(top, "[0-9]+", 0).cast("int") + 1).cast("string"), F.lit("]"))
        # Only strings with a backslash need a parser, which costs more than all else here.
        bare = F.substr(t, F.lit(2), F.length(t) - 2)
        text = F.when(F.contains(t, F.lit("\\")), as_type(F.try_parse_json(t), "string")).otherwise(bare)
        marked = t.startswith(f'"{NON_FINITE_MARK}')
        # Most signs are names, values and colons: they are told apart from the others by one look.
        new_at = (
            F.when(~t.isin("{", "[", "}", "]", ",") & ~(s["name_next"] & t.startswith('"')), at)
            .when(t == "{", put(at, F.lit("."))).when(t == "[", put(at, F.lit("[0]")))
            .when(t.isin("}", "]"), below).when((t == ",") & in_array, put(below, next_item))
            .when(s["name_next"] & t.startswith('"'), put(below, F.concat(F.lit("."), text))).otherwise(at)
        )
        name_next = F.when(t == "{", F.lit(True)).when(t == ",", ~in_array).when(t.isin(":", "["), F.lit(False)).otherwise(s["name_next"])
        found = F.struct(F.concat(F.lit("$"), F.array_join(at, "")).alias("path"), text.alias("value"))
        new_hits = F.when(marked & ~s["name_next"], F.concat(hits, F.array(found))).otherwise(hits)
        return F.struct(new_at.alias("at"), name_next.alias("name_next"), new_hits.alias("hits"))

    def told(h: Column) -> Column:
        sign = F.substr(h["value"], F.lit(len(NON_FINITE_MARK) + 1))
        shown = F.when(sign == "NaN", F.lit("nan")).when(sign == "Infinity", F.lit("inf")).otherwise(F.lit("-inf"))
        return error(h["path"], "non_finite_number", F.concat(F.lit("Non-finite number at "), h["path"], F.lit(": "), shown))

    return F.transform(F.aggregate(tokens, start, read)["hits"], told)


def field(data: Column, name: str, kind: str = "variant") -> Column:
    """A top-level field of a VARIANT object; NULL if absent or of another type."""
    quoted = name.replace("\\", "\\\\").replace("'", "\\'")
    return F.try_variant_get(data, f"$['{quoted}']", kind)


def check_schema(
    df: DataFrame,
    schema: Mapping,
    column: str,
    coerce: bool = True,
    repair: bool = False,
    out: str = "data",
    tasks: int | None = None,
) -> DataFrame:
    """Check a JSON column against a schema whose root is an object.

    `column` is text, VARIANT, or MAP<STRING, VARIANT>. Adds `data` (VARIANT after coercion), `errors`, `coercions` and
    `is_valid`. Text that is no JSON gives one `schema_json_parse` error and NULL data. Invalid rows keep their data for a
    retry. `coerce=False` keeps the values as they came while still judging the coerced ones.

    Fields of the root and of objects in objects are spread over helper columns in a few projections, each read from the
    document by its whole path, so every value is read, typed and coerced once by generated code. Objects are then put
    together from the deepest up, one projection per level, so the plan grows with the number of fields, whatever the depth.
    Only what lies in arrays goes through array functions. `tasks` spreads the rows first, for input that comes in fewer
    parts than there are cores. A number that JSON cannot hold gives one error at its own path,
    and no others there.
    """
    df = df.repartition(tasks) if tasks else df
    kind = df.schema[column].dataType.typeName()
    source = F.col(f"`{column}`")
    compiler = _Compiler(schema)
    keep = [c for c in df.columns if c not in (out, "errors", "coercions", "is_valid")]
    p = "_"
    while any(c.lower().startswith(p) for c in df.columns):
        p += "_"
    if kind == "map":
        root = F.to_variant_object(source)
    elif kind == "variant":
        root = source
    elif repair:
        root = F.coalesce(repair_json(source), repair_json(mark_non_finite(source)))
    else:
        root = F.coalesce(F.try_parse_json(source), F.try_parse_json(mark_non_finite(source)))
    work = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, column])], root.alias(f"{p}root0"))
    required = list(schema.get("required", []))
    doc = F.col(f"{p}root0")
    if required:
        wrapped = field(doc, "response", "string")
        missing = F.lit(False)
        for name in required:
            missing = missing | field(doc, name).isNull()
        opened = F.to_variant_object(unwrap_response(entries(doc), required))
        work = work.withColumn(f"{p}root", F.when(wrapped.isNotNull() & missing, opened).otherwise(doc))
    else:
        work = work.withColumnRenamed(f"{p}root0", f"{p}root")
    doc = F.col(f"{p}root")
    spots = _spots(schema, compiler.defs)
    top = spots[0]
    flat = [x for x in spots if x.kind == "flat"]
    objects = [x for x in spots if x.kind == "object"]
    col = lambda letter, x: F.col(f"{p}{letter}{x.number}")
    work = work.withColumns({f"{p}f{x.number}": _at_path(doc, x.names) for x in spots[1:]} | {f"{p}f0": doc})
    work = work.withColumns({f"{p}s{x.number}": F.schema_of_variant(col("f", x)) for x in flat + objects})
    # The value as text and as number, read once for coercion and all checks.
    typed = lambda x, no, t: F.when(no(col("s", x)), as_type(col("f", x), t))
    work = work.withColumns(
        {f"{p}t{x.number}": type_name(col("s", x)) for x in flat + objects}
        | {f"{p}x{x.number}": typed(x, lambda s: s == "STRING", "string") for x in flat}
        | {f"{p}y{x.number}": typed(x, lambda s: ~s.isin("STRING", "BOOLEAN", "VOID"), "double") for x in flat}
    )
    native = {x.number: compiler.coerced_scalar(x.spec, *(col(c, x) for c in "ftxy")) for x in flat}
    native = {n: c for n, c in native.items() if c is not None}
    work = work.withColumns({f"{p}k{n}": c for n, c in native.items()})
    work = work.withColumns({f"{p}c{n}": F.col(f"{p}k{n}").cast("variant") for n in native})
    new_types = {x.number: x.spec.get("type", "string") for x in flat if x.number in native}
    work = work.withColumns(
        {f"{p}v{x.number}": F.coalesce(col("c", x), col("f", x)) for x in flat if x.number in native}
        | {
            f"{p}u{x.number}": F.when(col("k", x).isNotNull(), F.lit(new_types[x.number])).otherwise(col("t", x))
            for x in flat
            if x.number in native
        }
    )
    work = work.withColumns(
        {
            f"{p}d{x.number}": F.when(col("f", x).isNotNull(), compiler.node(x.spec, col("f", x), F.lit(x.path)))
            for x in spots
            if x.kind == "lambda"
        }
        | {f"{p}r{x.number}": _extra_fields(compiler, x, col("f", x)) for x in objects if isinstance(x.extra, Mapping)}
    )

    def judged(x: _Spot) -> tuple[Column, Column | None, Column]:
        """Errors, coercions, and the new value (NULL if it is the old one) of a field below an object."""
        at = F.lit(x.path)
        if x.kind == "object":
            return col("e", x), col("n", x), col("w", x)
        if x.kind == "lambda":
            changed = F.when(F.size(col("d", x)["n"]) > 0, col("d", x)["v"])
            return col("d", x)["e"], col("d", x)["n"], changed
        text, number, v, t = col("x", x), col("y", x), col("f", x), col("t", x)
        if x.number not in native:
            return F.when(t.isNotNull(), compiler.checks(x.spec, v, t, at, text, number)), None, F.lit(None).cast("variant")
        v, t = col("v", x), col("u", x)
        if new_types[x.number] in ("integer", "number"):
            number = F.coalesce(col("k", x).cast("double"), number)
        elif new_types[x.number] == "string":
            text = F.coalesce(col("k", x), text)
        note = F.when(col("c", x).isNotNull(), F.array(compiler.note(at, col("f", x), col("c", x))))
        return F.when(t.isNotNull(), compiler.checks(x.spec, v, t, at, text, number)), note, col("c", x)

    for depth in range(max(x.depth for x in objects), -1, -1):
        made, new_values = {}, {}
        for x in objects:
            if x.depth != depth:
                continue
            own = [
                F.when(_at_path(doc, (*x.names, n)).isNull(), error(x.path, "required", f"'{n}' is a required property", x.required, F.lit("dict")))
                for n in x.required
            ]
            if x.extra is False:
                own.append(compiler.unexpected(entries(col("f", x)), x.known, F.lit(x.path)))
            lists = [F.array_compact(F.array(*own))] if own else []
            # At the root what is missing comes last, and simple fields come before others.
            order = sorted(x.children, key=lambda i: spots[i].kind != "flat") if x is top else x.children
            children = [judged(spots[i]) for i in order]
            below = [c[0] for c in children]
            lists = [*below, *lists] if x is top else [*lists, *below]
            notes = [c[1] for c in children if c[1] is not None]
            changed = [F.when(c[2].isNotNull(), F.struct(F.lit(spots[i].names[-1]).alias("k"), c[2].alias("v"))) for c, i in zip(children, order) if c[1] is not None]
            new = F.array_compact(F.array(*changed)) if changed else None
            if isinstance(x.extra, Mapping):
                rest = col("r", x)
                found = F.flatten(F.transform(rest, lambda q: q.r.e))
                lists.insert(len(lists) - bool(own) if x is top else len(lists), found)
                notes.append(F.flatten(F.transform(rest, lambda q: q.r.n)))
                more = F.transform(F.filter(rest, lambda q: F.size(q.r.n) > 0), lambda q: F.struct(q.k.alias("k"), q.r.v.alias("v")))
                new = F.concat(new, more) if new is not None else more
            is_object = col("t", x) == "object"
            all_errors = F.concat(*[F.coalesce(e, no_errors()) for e in lists]) if lists else no_errors()
            if x is top:
                bad = F.when(doc.isNull(), error("$", "json_parse", "Invalid JSON")).otherwise(
                    error("$", "type", F.concat(_shown(doc), F.lit(" is not of type 'object'")), "object", instance_name(col("t", x)))
                )
                made[f"{p}e0"] = F.when(is_object, all_errors).otherwise(F.array(bad))
            else:
                own_checks = compiler.checks(x.spec, col("f", x), col("t", x), F.lit(x.path))
                made[f"{p}e{x.number}"] = F.when(is_object, F.concat(own_checks, all_errors)).when(col("t", x).isNotNull(), own_checks)
            made[f"{p}n{x.number}"] = F.when(is_object, F.concat(*[F.coalesce(n, no_notes()) for n in notes])) if notes else no_notes()
            made[f"{p}g{x.number}"] = F.when(is_object, new) if notes else F.lit(None)
            new_values[f"{p}w{x.number}"] = (
                F.when(F.size(col("g", x)) > 0, let(F.map_from_entries(col("g", x)), _over(col("f", x))))
                if notes
                else F.lit(None).cast("variant")
            )
        work = work.withColumns(made).withColumns(new_values)
    errors = col("e", top)
    if kind == "string":
        odd = F.contains(source, F.lit("NaN")) | F.contains(source, F.lit("Infinity"))
        # Texts that merely look like such numbers were read without a mark.
        odd = odd & F.contains(F.to_json(doc), F.lit(NON_FINITE_MARK))
        work = work.withColumn(f"{p}odd", F.when(odd & (col("t", top) == "object"), _non_finite_errors(doc)))
        mine = F.transform(f"{p}odd", lambda e: e.path)
        others = F.filter(errors, lambda e: ~F.array_contains(mine, e.path))
        errors = F.when(F.size(f"{p}odd") > 0, F.concat(F.col(f"{p}odd"), others)).otherwise(errors)
    work = work.withColumn(f"{p}errors", errors)
    data = F.coalesce(col("w", top), doc) if coerce else doc
    done = work.select(
        *[F.col(f"`{c}`") for c in keep],
        F.when(col("t", top) == "object", data).alias(out),
        F.col(f"{p}errors").alias("errors"),
        F.coalesce(col("n", top), no_notes()).alias("coercions"),
        (F.size(f"{p}errors") == 0).alias("is_valid"),
    )
    return evaluated_once(done, [out, "errors", "coercions", "is_valid"])


class _Spot(NamedTuple):
    """A place of the document that is the same in every row: the root, or a field below objects only."""

    number: int
    names: tuple[str, ...]
    spec: Mapping
    kind: str  # object, flat, or lambda for what may hold arrays
    children: list[int]

    @property
    def path(self) -> str:
        return "$" + "".join(f".{n}" for n in self.names)

    @property
    def depth(self) -> int:
        return len(self.names)

    @property
    def required(self) -> list[str]:
        return list(self.spec.get("required", []))

    @property
    def known(self) -> list[str]:
        return list(self.spec.get("properties", {}))

    @property
    def extra(self):
        return self.spec.get("additionalProperties")


def _spots(schema: Mapping, defs: Mapping) -> list[_Spot]:
    """All places, the root first; parents stand before their children."""
    out = [_Spot(0, (), schema, "object", [])]
    for x in out:  # grows while it is read
        if x.kind != "object":
            continue
        for name, child in x.spec.get("properties", {}).items():
            spec = _resolve(child, defs)
            kind = spec.get("type")
            if kind == "object" or (kind is None and ("properties" in spec or "required" in spec)):
                how = "object"
            else:
                how = "lambda" if kind == "array" else "flat"
            out.append(_Spot(len(out), (*x.names, name), spec, how, []))
            x.children.append(len(out) - 1)
    return out


def _at_path(doc: Column, names: tuple[str, ...]) -> Column:
    quoted = [n.replace("\\", "\\\\").replace("'", "\\'") for n in names]
    return F.try_variant_get(doc, "$" + "".join(f"['{n}']" for n in quoted), "variant")


def _over(v: Column):
    """A body for `let` that puts a map of new fields into the object v."""
    kept = lambda m: F.map_filter(entries(v), lambda k, _: ~F.map_contains_key(m, k))
    return lambda m: F.to_variant_object(F.map_concat(kept(m), m))


def _extra_fields(compiler: _Compiler, x: _Spot, v: Column) -> Column:
    """(k, r) for the fields of an object that its properties do not name: the name and what the schema for others says."""
    others = F.map_filter(entries(v), lambda k, _: ~k.isin(x.known) if x.known else F.lit(True))
    return F.transform(
        F.map_entries(others),
        lambda kv: F.struct(kv.key.alias("k"), compiler.node(x.extra, kv.value, F.concat(F.lit(f"{x.path}."), kv.key)).alias("r")),
    )


def field_types(schema: Mapping) -> dict[str, str]:
    """Spark types for the top-level properties of a schema."""
    names = {"integer": "bigint", "number": "double", "boolean": "boolean", "string": "string", "object": "variant"}
    defs = schema.get("$defs", {})
    out = {}
    for name, spec in schema.get("properties", {}).items():
        spec = _resolve(spec, defs)
        if spec.get("type") == "array":
            child = spec.get("items")
            inner = _resolve(child, defs).get("type") if isinstance(child, Mapping) else None
            out[name] = f"array<{names.get(inner, 'variant')}>"
        elif "type" not in spec and spec.get("enum") and all(isinstance(x, str) for x in spec["enum"]):
            out[name] = "string"
        else:
            out[name] = names.get(spec.get("type"), "variant")
    return out


def typed_fields(df: DataFrame, types: Mapping[str, str], data: str = "data") -> DataFrame:
    """Fields of a checked VARIANT as typed columns; a value of another type gives NULL."""
    return df.withColumns({n: field(F.col(data), n, t) for n, t in types.items()})


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid and failed rows of one checked table, which is judged once for both."""
    once = settle(checked)
    return once.filter("is_valid"), once.filter("not is_valid")


def strict(checked: DataFrame) -> DataFrame:
    """All rows if every one is valid, else none."""
    once = settle(checked)
    return once if once.filter("not is_valid").isEmpty() else once.limit(0)


def check_summary(checked: DataFrame) -> DataFrame:
    return checked.agg(
        F.count_if("is_valid").alias("valid"),
        F.count_if(~F.col("is_valid")).alias("invalid"),
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum(F.size("coercions")), F.lit(0)).alias("coerced_fields"),
    )
