"""Derived columns, seeded and repeatable; and seeded loops per row."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordforge.functions import rng
from recordforge.functions.text import truthy
from recordforge.session import evaluated_once, null_on_error

# Fields that expressions do not see.
HIDDEN = ("_metadata", "_raw_text", "_repetition_seed")
SEED = "_seed"
LAMBDA_STATE = "s"


def _mentions(text: str, names: set[str]) -> bool:
    return any(re.search(rf"(?<![\w.]){re.escape(n)}(?!\w)", text) for n in names)


def _batches(exprs: Mapping[str, str | Column]) -> list[dict[str, Column]]:
    """Runs of expressions that do not use each other, each computed in one projection."""
    out: list[dict[str, Column]] = []
    for name, e in exprs.items():
        text = e if isinstance(e, str) else str(e)
        if not out or name in out[-1] or _mentions(text, set(out[-1])):
            out.append({})
        out[-1][name] = F.expr(e) if isinstance(e, str) else e
    return out


def derive(
    df: DataFrame,
    exprs: Mapping[str, str | Column],
    init: Mapping[str, str | Column] | None = None,
    step: str = "",
    on_error: str = "flag",
) -> DataFrame:
    """Evaluate named SQL expressions in order; later ones see earlier results, a repeated name replaces the value.

    `_seed` holds the row's seed while expressions run. An expression that gives NULL has failed: `flag` names it in
    `_expr_error`, `drop` removes the row, `ignore` lets it pass, `fail` ends the job.
    """
    hidden = [c for c in HIDDEN if c in df.columns]
    seeded = df.withColumn(SEED, rng.default_seed(df.columns, step))
    work = seeded.select(
        *[c for c in seeded.columns if c not in hidden],
        *([F.struct(*hidden).alias("_hidden")] if hidden else []),
    )
    names: list[str] = []
    with null_on_error(df.sparkSession):
        for stage in (init or {}, exprs):
            for batch in _batches(stage):
                work = work.withColumns(batch)
                names += [n for n in batch if n not in names]
    failed = F.lit(None).cast("string")
    for name in reversed(names):
        failed = F.when(F.col(name).isNull(), F.lit(name)).otherwise(failed)
    if on_error == "flag":
        work = work.withColumn("_expr_error", failed)
    elif on_error == "drop":
        work = work.filter(failed.isNull())
    elif on_error == "fail":
        stop = lambda n: F.raise_error(F.concat(F.lit(f"Expression '{n}' failed for unit "), F.col("unit_id")))
        work = work.withColumns({n: F.when(F.col(n).isNull(), stop(n)).otherwise(F.col(n)) for n in names})
    rest = [c for c in work.columns if c not in (SEED, "_hidden")]
    return work.select(*rest, *[F.col(f"_hidden.{c}").alias(c) for c in hidden])


class Draws:
    """Random draws inside a loop round: every draw has its own name, the round is the counter."""

    def __init__(self, seed: Column, counter: Column):
        self.seed, self.counter = seed, counter

    def random(self, name: str) -> Column:
        return rng.u01(self.seed, name, self.counter)

    def uniform(self, name: str, low, high) -> Column:
        return rng.uniform(self.seed, name, low, high, self.counter)

    def integer(self, name: str, low, high) -> Column:
        return rng.integer(self.seed, name, low, high, self.counter)

    def choice(self, name: str, seq: Column) -> Column:
        return rng.choice(self.seed, name, seq, self.counter)

    def gauss(self, name: str, mu, sigma) -> Column:
        return rng.gauss(self.seed, name, mu, sigma, self.counter)


def iterate(
    df: DataFrame,
    init: Mapping[str, str | Column],
    body: Callable[[Callable[[str], Column], Draws], Mapping[str, Column]],
    until: Callable[[Callable[[str], Column]], Column],
    max_iter: int = 1000,
    step: str = "",
    tasks: int | None = None,
) -> DataFrame:
    """Run `body` per row until `until` holds, at most `max_iter` rounds; the condition is checked after each round.

    `init` gives the state fields once. `body(get, draws)` returns new values of state fields; unnamed fields stay. A row
    that reaches the limit is kept and marked in `_metadata.timeout`. The loop is a fold over a number array inside one
    task: no shuffle, no Python. `tasks` spreads the rows first, for input that comes in fewer parts than there are cores.
    Filters on the results stay above the loop, so no row runs twice and none before the rows are spread.
    """
    fields = list(init)
    df = df.repartition(tasks) if tasks else df
    start_row = df.withColumn(SEED, rng.default_seed(df.columns, step))
    first = [(F.expr(e) if isinstance(e, str) else e).alias(n) for n, e in init.items()]
    # The seed is part of the state: a column would be computed again in every round.
    start = F.struct(*first, F.col(SEED), F.lit(0).alias("_rounds"), F.lit(False).alias("_done"))

    def one_round(state: Column, i: Column) -> Column:
        new = dict(body(lambda n: state[n], Draws(state[SEED], i)))
        after = {n: new.get(n, state[n]) for n in fields}
        bound = F.struct(*[v.alias(n) for n, v in after.items()])
        # Bind the new values once: the stop condition and the result both read them.
        advanced = F.element_at(
            F.transform(
                F.array(bound),
                lambda s: F.struct(
                    *[s[n].alias(n) for n in fields],
                    state[SEED].alias(SEED),
                    i.cast("int").alias("_rounds"),
                    F.coalesce(until(lambda n: s[n]), F.lit(False)).alias("_done"),
                ),
            ),
            1,
        )
        return F.when(state["_done"], state).otherwise(advanced)

    # Rounds run in blocks: a finished row skips whole blocks instead of every single round left.
    block = max(1, math.isqrt(max_iter))

    def one_block(state: Column, b: Column) -> Column:
        last = F.least((b + 1) * block, F.lit(max_iter))
        rounds = F.sequence(b * block + 1, last)
        return F.when(state["_done"], state).otherwise(F.aggregate(rounds, state, one_round))

    end = F.aggregate(F.sequence(F.lit(0), F.lit((max_iter - 1) // block)), start, one_block)
    done = evaluated_once(start_row.withColumn("_end", end), ["_end"])
    kept = [c for c in df.columns if c not in fields and c != "_metadata"]
    meta = F.struct(
        F.lit(step).alias("expression_step"),
        F.col("_end._rounds").alias("iterations"),
        (~F.col("_end._done")).alias("timeout"),
    )
    return done.select(*kept, *[F.col(f"_end.{n}").alias(n) for n in fields], meta.alias("_metadata"))


def matches(df: DataFrame, condition: str) -> DataFrame:
    """Rows for which a condition of any type is true in the sense of Python truth."""
    with null_on_error(df.sparkSession):
        tested = df.withColumn("_cond", F.expr(condition))
    return tested.filter(truthy(F.col("_cond"), tested.schema["_cond"].dataType)).drop("_cond")


def run_scope(df: DataFrame, hooks: Mapping[str, Callable[[DataFrame], DataFrame]]) -> dict[str, DataFrame]:
    """Named whole-run functions over the final records of a run."""
    return {name: hook(df) for name, hook in hooks.items()}
