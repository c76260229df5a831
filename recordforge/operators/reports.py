"""Report tables of a run: distributions, statistics, funnel, failures, top errors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordforge.functions.text import repetition_base, shorten
from recordforge.operators.order import lay_out, running_sum
from recordforge.session import null_on_error


def count_distribution(df: DataFrame, group: str, value: str) -> DataFrame:
    """Count and share of every value per group; rows without a group or value are left out."""
    kept = df.filter(F.col(group).isNotNull() & F.col(value).isNotNull())
    counts = kept.groupBy(F.col(group).cast("string").alias("group"), F.col(value).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # Group totals come from the counted table, so no group's rows are gathered.
    totals = counts.groupBy("group").agg(F.sum("n").alias("group_n"))
    return counts.join(totals, "group").withColumn("pct", F.col("n") * 100.0 / F.col("group_n"))


def skipped_rows(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.agg(
        F.count_if(F.col(group).isNull() | F.col(value).isNull()).alias("skipped"), F.count(F.lit(1)).alias("total")
    )


def distribution_matrix(
    df: DataFrame,
    group: str,
    value: str,
    positive: Sequence[str] = (),
    negative: Sequence[str] = (),
    values: Sequence[str] | None = None,
) -> DataFrame:
    """Wide form: one row per group, one column per value, total and optional net score.

    Ordered by net score, else by the count of the first value in sorted order; the group breaks ties. With `values` nothing
    is looked up first, and other values are left out; without, they are collected, so there must not be too many. The
    long form is `count_distribution`.
    """
    counts = count_distribution(df, group, value)
    wide = counts.groupBy("group").pivot("value", list(values) if values else None).agg(F.sum("n"))
    values = sorted(c for c in wide.columns if c != "group")
    wide = wide.select("group", *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(v) for v in values])
    total = sum((F.col(f"`{v}`") for v in values), F.lit(0))
    wide = wide.withColumn("total", total)
    if positive or negative:
        wide = wide.join(net_score(df, group, value, positive, negative), "group")
        return wide.orderBy(F.desc("net"), "group")
    return wide.orderBy(F.desc(f"`{values[0]}`"), "group") if values else wide


def net_score(df: DataFrame, group: str, value: str, positive: Sequence[str], negative: Sequence[str]) -> DataFrame:
    """Positive minus negative values per group, in any case of letters; a value on both lists is positive."""
    v = F.lower(F.col(value).cast("string"))
    plus, minus = [x.lower() for x in positive], [x.lower() for x in negative]
    score = F.when(v.isin(plus), 1).when(v.isin(minus), -1).otherwise(0)
    kept = df.filter(F.col(group).isNotNull() & F.col(value).isNotNull())
    return kept.groupBy(F.col(group).cast("string").alias("group")).agg(F.sum(score).alias("net"))


def _numbers(df: DataFrame, group: str, field: str) -> DataFrame:
    cast = F.trim(F.col(field).cast("string")).try_cast("double")
    return df.select(F.col(group).cast("string").alias("group"), cast.alias("x")).filter("group is not null and x is not null")


def medians(numbers: DataFrame) -> DataFrame:
    """Exact median per group of (group, x), interpolated for an even count.

    Equal values are counted first; positions then come from running counts, so a group may be any share of the table.
    """
    counts = numbers.groupBy("group", "x").agg(F.count(F.lit(1)).alias("n"))
    laid = lay_out(counts, ["x"], ["group"])
    ranked = running_sum(laid, F.col("n"), ["x"], ["group"], out="upto")
    totals = counts.groupBy("group").agg(F.sum("n").alias("total"))
    placed = ranked.join(totals, "group")
    low, high = F.floor((F.col("total") + 1) / 2), F.floor((F.col("total") + 2) / 2)
    before = F.col("upto") - F.col("n")
    covers = lambda at: (before < at) & (F.col("upto") >= at)
    middle = placed.filter(covers(low) | covers(high)).groupBy("group").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    return middle.select("group", ((F.col("a") + F.col("b")) / 2).alias("median"))


def numeric_stats(df: DataFrame, group: str, field: str, custom: Mapping[str, str] | None = None) -> DataFrame:
    """count, mean, median, stdev, variance, min_val, max_val, sum_val per group; values that are no numbers are left out.

    `custom` adds SQL expressions over these columns; one that cannot be computed gives NULL. An expression that names
    `data` needs every value of a group in one place and is refused: write it over the statistics instead.
    """
    numbers = _numbers(df, group, field)
    basic = numbers.groupBy("group").agg(
        F.count("x").alias("count"),
        F.avg("x").alias("mean"),
        F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("stdev"),
        F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("variance"),
        F.min("x").alias("min_val"),
        F.max("x").alias("max_val"),
        F.sum("x").alias("sum_val"),
    )
    joined = basic.join(medians(numbers), "group")
    stats = joined.select("group", "count", "mean", "median", "stdev", "variance", "min_val", "max_val", "sum_val")
    return custom_stats(stats, custom) if custom else stats


def by_mean(stats: DataFrame) -> DataFrame:
    """Statistics in the order of a report: the largest mean first, and of equal ones the first group."""
    return stats.orderBy(F.desc("mean"), "group")


def custom_stats(stats: DataFrame, custom: Mapping[str, str]) -> DataFrame:
    with null_on_error(stats.sparkSession):
        return stats.withColumns({name: F.expr(e) for name, e in custom.items()})


def data_stats(df: DataFrame, group: str, field: str, custom: Mapping[str, str]) -> DataFrame:
    """Custom aggregate expressions over the raw values `x` of each group, for example `sum(abs(x - 1))`."""
    with null_on_error(df.sparkSession):
        return _numbers(df, group, field).groupBy("group").agg(*[F.expr(e).alias(n) for n, e in custom.items()])


def step_table(spark, steps: Sequence[str], fan_out: Sequence[str] = ()) -> DataFrame:
    """(step, step_no, is_fan_out) of a pipeline."""
    return spark.createDataFrame([(s, i, s in fan_out) for i, s in enumerate(steps)], "step string, step_no int, is_fan_out boolean")


def funnel(
    units: DataFrame, outputs: DataFrame, failures: DataFrame, steps: Sequence[str], fan_out: Sequence[str] = ()
) -> DataFrame:
    """Per step: valid, failed, expected, lost since the start, pass share of the step before, yield share of the start.

    A fan-out step starts a new base: later yields are shares of its children. The window runs over one row per step.
    """
    spark = units.sparkSession
    start = units.select(F.lit("").alias("step"), "unit_id", F.lit("start").alias("what"))
    parts = start.unionByName(outputs.select("step", "unit_id", F.lit("valid").alias("what")))
    parts = parts.unionByName(failures.select("step", "unit_id", F.lit("failed").alias("what")))
    ids = parts.filter("unit_id is not null and unit_id <> ''").groupBy("step", "what").agg(F.countDistinct("unit_id").alias("n"))
    counts = ids.groupBy("step").agg(
        *[F.coalesce(F.sum(F.when(F.col("what") == w, F.col("n"))), F.lit(0)).alias(w) for w in ("start", "valid", "failed")]
    )
    plan = step_table(spark, ["", *steps], fan_out).withColumn("step_no", F.col("step_no") - 1)
    rows = plan.join(counts, "step", "left").select(
        "step", "step_no", "is_fan_out",
        F.when(F.col("step") == "", F.coalesce("start", F.lit(0))).otherwise(F.coalesce("valid", F.lit(0))).alias("valid"),
        F.coalesce("failed", F.lit(0)).alias("failed"),
    )
    w = Window.partitionBy(F.lit(0)).orderBy("step_no")
    base = F.last(F.when(F.col("is_fan_out") | (F.col("step_no") < 0), F.col("valid")), ignorenulls=True).over(w)
    placed = rows.withColumns({"expected": F.lag("valid").over(w), "base": base}).filter("step_no >= 0")
    share = lambda part, whole: F.coalesce(F.try_divide(F.col(part) * 100.0, F.col(whole)), F.lit(0.0))
    plain = ~F.col("is_fan_out")
    return placed.select(
        "step",
        "step_no",
        "is_fan_out",
        "expected",
        "valid",
        F.when(plain, F.col("failed")).otherwise(F.lit(0)).alias("failed"),
        F.when(plain & (F.col("base") > 0), F.col("base") - F.col("valid")).otherwise(F.lit(0)).alias("lost"),
        F.when(plain, share("valid", "expected")).otherwise(F.lit(0.0)).alias("pass_pct"),
        F.when(plain, share("valid", "base")).otherwise(F.lit(0.0)).alias("yield_pct"),
    ).orderBy("step_no")


def failures_by(failures: DataFrame, field: str | None = None) -> DataFrame:
    """(step, group, n): failures per item (the id without its repetition), or per field with `(missing)` for none."""
    if field is None:
        group = repetition_base(F.coalesce("unit_id", F.lit("")))
    elif field in failures.columns:
        group = F.coalesce(F.col(field).cast("string"), F.lit("(missing)"))
    else:
        group = F.lit("(missing)")
    return failures.groupBy("step", group.alias("group")).agg(F.count(F.lit(1)).alias("n"))


def failures_matrix(by: DataFrame, steps: Sequence[str]) -> DataFrame:
    """One row per group, one column per step."""
    wide = by.groupBy("group").pivot("step", list(steps)).agg(F.sum("n"))
    return wide.na.fill(0, subset=list(steps))


# Fixed order: fields that may tell why a record failed.
ERROR_FIELDS = ["verification_details", "strategy_verification_details", "error", "validation_error"]


def error_text(columns: Sequence[str]) -> Column:
    """The first non-empty error field of a record, whole."""
    found = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ERROR_FIELDS if c in columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def top_errors(failures: DataFrame, k: int = 3, by: str = "step", message: Column | None = None) -> DataFrame:
    """The k most frequent messages per step, with rank; the message breaks ties.

    Whole messages are counted; the shown ones are cut to 100 characters.
    Counting comes first and the rank limit reaches the map side, so a hot step brings k rows per task.
    """
    text = message if message is not None else error_text(failures.columns)
    counts = failures.withColumn("message", text).filter("message is not null").groupBy(by, "message").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "message"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k).withColumn("message", shorten(F.col("message")))


def errors_by_rule(failures: DataFrame) -> DataFrame:
    """(step, rule, n) over all errors of all records; a record without readable errors counts as `parse_error`."""
    opened = failures.select("step", F.explode_outer("errors").alias("e"))
    return opened.groupBy("step", F.coalesce("e.rule", F.lit("parse_error")).alias("rule")).agg(F.count(F.lit(1)).alias("n"))


def failure_categories(failures: DataFrame, retryable: Column) -> DataFrame:
    """Validation and hard failures per step."""
    return failures.groupBy("step").agg(F.count_if(retryable).alias("validation"), F.count_if(~retryable).alias("hard"))


def failure_groups(failures: DataFrame, top: int = 10, samples: int = 3, raw_chars: int = 200) -> DataFrame:
    """The largest groups of equal stage and first message, with a few sample units each.

    Samples are the smallest unit ids. Both limits are applied on the map side.
    """
    first = F.coalesce(F.col("errors")[0]["message"], F.lit("Unknown error"))
    rows = failures.select(
        "step",
        F.coalesce("failure_stage", F.lit("validation")).alias("failure_stage"),
        F.when(F.size("errors") > 0, first).otherwise(F.lit("Unknown error")).alias("message"),
        "unit_id",
        F.substring("raw_response", 1, raw_chars).alias("raw"),
    )
    keys = ["step", "failure_stage", "message"]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    best = counts.withColumn(
        "rank", F.row_number().over(Window.partitionBy("step").orderBy(F.desc("n"), "failure_stage", "message"))
    ).filter(F.col("rank") <= top)
    picked = rows.withColumn(
        "sample", F.row_number().over(Window.partitionBy(*keys).orderBy("unit_id", "raw"))
    ).filter(F.col("sample") <= samples)
    return best.join(picked, keys).select(*keys, "n", "rank", "sample", "unit_id", "raw")


def retry_hot_spots(failures: DataFrame, separator: str = "__", top: int | None = None) -> DataFrame:
    """Failures per unit, per first part of the id, per second part, and per pair of parts, by grouping sets."""
    parts = F.split("unit_id", separator)
    rows = failures.filter("unit_id is not null").select(
        "unit_id",
        F.when(F.size(parts) >= 2, parts[0]).alias("first"),
        F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(2))).alias("second"),
    )
    sets = [[F.col("unit_id")], [F.col("first")], [F.col("second")], [F.col("first"), F.col("second")]]
    grouped = rows.groupingSets(sets, "unit_id", "first", "second").agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g")
    )
    kind = (
        F.when(F.col("_g") == 3, F.lit("unit"))
        .when(F.col("_g") == 5, F.lit("first"))
        .when(F.col("_g") == 6, F.lit("second"))
        .otherwise(F.lit("pair"))
    )
    key = F.when(kind == "unit", F.col("unit_id")).otherwise(F.concat_ws(separator, "first", "second"))
    named = grouped.select(kind.alias("kind"), key.alias("key"), "n").filter("key <> ''")
    if top is None:
        return named
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "key"))
    return named.withColumn("rank", rank).filter(F.col("rank") <= top)


def attach_prompts(failures: DataFrame, prompts: DataFrame) -> DataFrame:
    """The prompt behind each failure, where one is stored; of several the largest."""
    stored = prompts.groupBy("step", "unit_id").agg(F.max("prompt").alias("prompt"))
    return failures.join(stored, ["step", "unit_id"], "left")


def all_units(validated: DataFrame, failures: DataFrame) -> DataFrame:
    """Validated and failed units with status and number of attempts."""
    tries = F.coalesce("retry_count", F.lit(0)) + 1
    ok = validated.withColumns({"status": F.lit("valid"), "attempts": tries if "retry_count" in validated.columns else F.lit(1)})
    bad = failures.withColumns({"status": F.lit("failed"), "attempts": tries})
    return ok.unionByName(bad, allowMissingColumns=True)


def browse(units: DataFrame, status: str | None = None, step: str | None = None, cap: int = 1000) -> DataFrame:
    """The first units for display: failed before valid, then by step and id, at most `cap` rows (the feature itself)."""
    kept = units.filter(F.col("status") == status) if status else units
    kept = kept.filter(F.col("step") == step) if step else kept
    weight = F.when(F.col("status") == "failed", 0).otherwise(1)
    return kept.orderBy(weight, "step", "unit_id").limit(cap)
