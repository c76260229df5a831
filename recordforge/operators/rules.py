"""Business rules over typed or VARIANT columns, compiled from a declarative spec into Columns."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordforge.functions.text import python_text, truthy
from recordforge.functions.variants import INSTANCE_NAMES, as_type, json_type
from recordforge.operators.schema_check import ERROR, no_errors
from recordforge.session import evaluated_once, null_on_error

# Accepted type names and the JSON types each admits.
TYPE_NAMES = {
    "integer": ["integer"],
    "float": ["integer", "number"],
    "number": ["integer", "number"],
    "string": ["string"],
    "boolean": ["boolean"],
    "array": ["array"],
    "list": ["array"],
    "object": ["object"],
    "dict": ["object"],
}
# Fixed order: the comparison a rule is split at is the first of these found in its text.
COMPARISONS = ["==", "!=", ">=", "<=", ">", "<"]
# Fixed pattern: a placeholder of a message.
PLACEHOLDER = re.compile(r"\{([^}]+)\}")
GROUP = 20  # checks per array, which keeps generated methods small
SPARK_KINDS = {
    "byte": "integer", "short": "integer", "integer": "integer", "long": "integer",
    "float": "number", "double": "number", "decimal": "number",
    "string": "string", "boolean": "boolean", "array": "array", "struct": "object", "map": "object",
}


def finding(path, rule: str, message: Column) -> Column:
    return F.struct(
        F.lit(path).alias("path"),
        F.lit(rule).alias("rule"),
        message.alias("message"),
        *[F.lit(None).cast("string").alias(n) for n in ("validator", "validator_value", "instance_type")],
    ).cast(ERROR)


def collect(checks: Sequence[Column]) -> Column:
    """Non-null findings of many checks as one array, in order."""
    if not checks:
        return no_errors()
    groups = [F.array(*checks[i : i + GROUP]) for i in range(0, len(checks), GROUP)]
    return F.array_compact(F.concat(*groups) if len(groups) > 1 else groups[0])


class _Fields:
    """Columns of a table as the fields of a record.

    A NULL in a typed column is an absent field; a VARIANT column tells absent (NULL) from a JSON null.
    """

    def __init__(self, df: DataFrame):
        self.df = df
        self.kinds = {f.name: f.dataType for f in df.schema.fields}

    def has(self, name: str) -> bool:
        return name in self.kinds

    def col(self, name: str) -> Column:
        return F.col(f"`{name}`")

    def is_variant(self, name: str) -> bool:
        return self.kinds[name].typeName() == "variant"

    def kind(self, name: str) -> Column:
        """JSON type of the value in this row; NULL if absent."""
        if self.is_variant(name):
            return json_type(self.col(name))
        known = SPARK_KINDS.get(self.kinds[name].typeName(), "object")
        return F.when(self.col(name).isNotNull(), F.lit(known))

    def number(self, name: str) -> Column | None:
        """The value for range checks; booleans count as 0 and 1."""
        c = self.col(name)
        if self.is_variant(name):
            as_flag = as_type(c, "boolean").cast("int").cast("double")
            return F.when(json_type(c).isin("integer", "number"), as_type(c, "double")).when(json_type(c) == "boolean", as_flag)
        kind = SPARK_KINDS.get(self.kinds[name].typeName())
        if kind == "boolean":
            return c.cast("int")
        return c if kind in ("integer", "number") else None

    def text(self, name: str) -> Column:
        c = self.col(name)
        if self.is_variant(name):
            return F.when(json_type(c) == "string", as_type(c, "string")).otherwise(F.to_json(c))
        return python_text(c, self.kinds[name])


def _listed(values: Sequence) -> str:
    return "[" + ", ".join(repr(v) for v in values) + "]"


def _required(f: _Fields, name: str) -> Column:
    found = finding(f"$.{name}", f"required_{name}", F.lit(f"Missing required field: '{name}'"))
    if not f.has(name):
        return found
    gone = f.col(name).isNull()
    if f.is_variant(name):
        gone = gone | F.is_variant_null(f.col(name))
    return F.when(gone, found)


def _type(f: _Fields, name: str, wanted: str) -> Column | None:
    if not f.has(name):
        return None
    if wanted.lower() not in TYPE_NAMES:
        said = F.lit(f"Field '{name}': Unknown type: {wanted}")
        return F.when(f.kind(name).isNotNull(), finding(f"$.{name}", f"type_{name}", said))
    fits = TYPE_NAMES[wanted.lower()]
    if not f.is_variant(name) and SPARK_KINDS.get(f.kinds[name].typeName(), "object") in fits:
        return None  # the column type already guarantees it
    shown = F.try_element_at(
        F.create_map(*[F.lit(x) for k, v in INSTANCE_NAMES.items() for x in (k, "NoneType" if k == "null" else v)]), f.kind(name)
    )
    said = F.concat(F.lit(f"Field '{name}': Expected {wanted}, got "), shown)
    return F.when(~f.kind(name).isin(fits), finding(f"$.{name}", f"type_{name}", said))


def _range(f: _Fields, name: str, low, high) -> Column | None:
    value = f.number(name) if f.has(name) else None
    if value is None:
        return None
    said = F.concat(F.lit(f"Field '{name}' value "), f.text(name), F.lit(f" outside range [{low}, {high}]"))
    return F.when((value < low) | (value > high), finding(f"$.{name}", f"range_{name}", said))


def _enum(f: _Fields, name: str, allowed: Sequence) -> Column | None:
    if not f.has(name):
        return None
    texts = [x.lower() for x in allowed if isinstance(x, str)]
    others = [x for x in allowed if not isinstance(x, str)]
    c = f.col(name)
    if f.is_variant(name):
        is_text = json_type(c) == "string"
        inside = F.when(is_text, F.lower(as_type(c, "string")).isin(texts)).otherwise(
            F.to_json(c).isin([str(x).lower() if isinstance(x, bool) else str(x) for x in others])
        )
    elif SPARK_KINDS.get(f.kinds[name].typeName()) == "string":
        inside = F.lower(c).isin(texts) if texts else F.lit(False)
    else:
        inside = c.isin(others) if others else F.lit(False)
    said = F.concat(F.lit(f"Field '{name}' value '"), f.text(name), F.lit(f"' not in allowed values: {_listed(allowed)}"))
    return F.when(c.isNotNull() & ~inside, finding(f"$.{name}", f"enum_{name}", said))


def message(f: _Fields, template: str, computed: Column | None) -> Column:
    """The template with `{field}` replaced; what has no value stays as it is written."""
    parts, at = [], 0
    for m in PLACEHOLDER.finditer(template):
        if m.start() > at:
            parts.append(F.lit(template[at : m.start()]))
        name, raw = m.group(1), F.lit(m.group(0))
        if name == "_computed":
            parts.append(F.coalesce(computed, raw) if computed is not None else raw)
        else:
            parts.append(F.coalesce(f.text(name), raw) if f.has(name) else raw)
        at = m.end()
    if at < len(template):
        parts.append(F.lit(template[at:]))
    return F.concat(*parts) if parts else F.lit("")


def _left_side(df: DataFrame, expr: str) -> str | None:
    for op in COMPARISONS:
        if op in expr:
            left = expr.split(op, 1)[0].strip()
            try:
                df.select(F.expr(left))
                return left
            except (AnalysisException, ParseException):
                return None
    return None


def check_rules(df: DataFrame, spec: Mapping, errors: str = "errors", warnings: str = "warnings") -> DataFrame:
    """Apply `required`, `types`, `ranges`, `enums` and `rules` and add arrays of findings.

    A missing required field stops the later checks of the row. A rule is an SQL expression: false, zero or empty fails;
    NULL is an evaluation error and fails too. A `when` guard skips the rule if false, and skips it with a warning if NULL.
    Rules of level `warning` go to `warnings` only. Everything happens in the projections of one narrow stage.
    """
    f = _Fields(df)
    rules = list(spec.get("rules", []))
    with null_on_error(df.sparkSession):
        helpers: dict[str, Column] = {}
        for i, rule in enumerate(rules):
            helpers[f"_rule{i}"] = F.expr(rule["expr"])
            if rule.get("when"):
                helpers[f"_when{i}"] = F.expr(rule["when"])
            left = _left_side(df, rule["expr"]) if "{_computed}" in rule.get("error", "") else None
            if left:
                helpers[f"_left{i}"] = F.expr(left)
        work = df.withColumns(helpers) if helpers else df
    types = {x.name: x.dataType for x in work.schema.fields}

    missing = [_required(f, n) for n in spec.get("required", [])]
    plain = [_type(f, n, t) for n, t in spec.get("types", {}).items()]
    plain += [_range(f, n, lo, hi) for n, (lo, hi) in spec.get("ranges", {}).items()]
    plain += [_enum(f, n, allowed) for n, allowed in spec.get("enums", {}).items()]
    failed, warned = [c for c in plain if c is not None], []
    for i, rule in enumerate(rules):
        name = rule.get("name", "unnamed_rule")
        template = rule.get("error", f"Rule '{name}' failed")
        truth = truthy(F.col(f"_rule{i}"), types[f"_rule{i}"])
        computed = python_text(F.col(f"_left{i}"), types[f"_left{i}"]) if f"_left{i}" in types else None
        broken = finding("$", name, F.concat(message(f, template, None), F.lit(" (expression error: no value)")))
        bad = F.when(truth.isNull(), broken).when(~truth, finding("$", name, message(f, template, computed)))
        if f"_when{i}" in types:
            guard = truthy(F.col(f"_when{i}"), types[f"_when{i}"])
            warned.append(F.when(guard.isNull(), finding("$", name, F.lit("when clause failed to evaluate: no value"))))
            bad = F.when(guard, bad)
        (warned if rule.get("level", "error") == "warning" else failed).append(bad)

    work = work.withColumn("_missing", collect(missing))
    stop = F.size("_missing") > 0
    kept = [c for c in df.columns if c not in (errors, warnings)]
    done = work.select(
        *[F.col(f"`{c}`") for c in kept],
        F.when(stop, F.col("_missing")).otherwise(collect(failed)).alias(errors),
        F.when(stop, no_errors()).otherwise(collect(warned)).alias(warnings),
    )
    return evaluated_once(done, [errors, warnings])


def rule_failures(checked: DataFrame, step: str, unit_id: str = "unit_id") -> DataFrame:
    """Failure records of the rows with findings; `input` is the row itself."""
    own = [c for c in checked.columns if c not in ("errors", "warnings", unit_id)]
    return checked.filter(F.size("errors") > 0).select(
        F.col(unit_id).alias("unit_id"),
        F.lit("validation").alias("failure_stage"),
        F.lit(step).alias("step"),
        F.struct(*own).alias("input"),
        F.col("errors"),
        (F.col("retry_count") if "retry_count" in checked.columns else F.lit(0)).alias("retry_count"),
    )


