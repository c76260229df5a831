"""Units from item lists: permutations, cross products, direct rows, repetitions and chunks.

A product grows out of its largest list. The other lists are packed into blocks of items; a number names an item of the
largest list and one block of each other list, `spark.range` yields these numbers evenly over the cluster, and equi-joins
fetch the item and the blocks. Only then are the blocks opened, so what moves between tasks is the numbers and the lists,
never the product. The place of a unit in the order of nested loops follows from the indexes of its items, and `max_units`
cuts the lists before anything is multiplied.

Joined names are tested on the lists (`ambiguous_names`), not on the units made of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordforge.functions.rng import hash_seed
from recordforge.functions.text import safe_name
from recordforge.operators.order import row_positions
from recordforge.session import settle

POS = "_unit_pos"
ROWS_PER_TASK = 2_000_000
BLOCK_ITEMS = 4096


class GenerationError(ValueError):
    """The item lists cannot give a valid set of units."""


def item_name(item: DataFrame, name_field: str, fallback: bool) -> Column:
    """The column that names an item: the field asked for, else `id`, else `name`.

    The choice depends on which columns exist; a present column with a NULL does not fall back.
    """
    for field in [name_field, "id", "name"] if fallback else [name_field]:
        if field in item.columns:
            return F.col(f"`{field}`")
    raise GenerationError(f"Items have no field to name units by (tried '{name_field}')")


def _named(name: Column) -> Column:
    return F.when(
        name.isNull() | (name.cast("string") == ""), F.raise_error(F.lit("Item without a name for unit_id"))
    ).otherwise(safe_name(name))


def _indexed(
    items: DataFrame, order_by: list[str], limit: int | None, name: Column, unique: bool = False
) -> tuple[DataFrame, int]:
    """Items as (`_idx`, `_name`, `_item`) and their number; `unique` refuses items that give one name."""
    packed = items.select(*order_by, _named(name).alias("_name"), F.struct("*").alias("_item"))
    placed = row_positions(packed, order_by, out="_idx").select("_idx", "_name", "_item")
    if limit:
        placed = placed.filter(F.col("_idx") < limit)
    seen = placed.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("_name").alias("names")).first()
    if unique and seen.n != seen.names:
        raise GenerationError("Items whose names give one unit_id")
    return placed, seen.n


def _product(
    lists: list[tuple[DataFrame, int]], positions: list[str], below: list[int], wanted: int, distinct: bool
) -> DataFrame:
    """(unit_id, positions, POS) of the combinations with a place below `wanted`.

    `below` is the number of combinations per item of each position; `distinct` takes every item once at most.
    """
    spark, k = lists[0][0].sparkSession, len(lists)
    # A place below `wanted` leaves only the first items of a list possible.
    sizes = [min(n, -(-wanted // b) + (i if distinct else 0)) for i, ((_, n), b) in enumerate(zip(lists, below))]
    base = max(range(k), key=lambda i: sizes[i])
    others = sorted((i for i in range(k) if i != base), key=lambda i: -sizes[i])
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(wanted / ROWS_PER_TASK))
    per_block = {i: max(1, min(sizes[i], BLOCK_ITEMS)) for i in others}
    blocks = {i: -(-sizes[i] // per_block[i]) for i in others}
    outer = sizes[base] * math.prod(blocks.values())
    for i in others:
        if 0 < outer < tasks:  # smaller blocks, so that all tasks have work
            per_block[i] = max(1, sizes[i] // (blocks[i] * -(-tasks // outer)))
            outer, blocks[i] = outer // blocks[i], -(-sizes[i] // per_block[i])
            outer *= blocks[i]
    if max(outer, wanted) >= 2**63:
        raise GenerationError(f"{wanted} combinations exceed the 64-bit range")
    units = spark.range(0, outer, 1, max(1, min(tasks, outer)))
    radix = 1
    for i in [base, *others]:
        n = sizes[i] if i == base else blocks[i]
        units = units.withColumn(f"_at{i}", F.expr(f"pmod(id div {radix}L, {max(1, n)}L)"))
        radix *= max(1, n)
    entry = F.struct("_idx", "_name", "_item")
    one = lists[base][0].filter(F.col("_idx") < sizes[base]).select(F.col("_idx").alias(f"_at{base}"), entry.alias(f"_e{base}"))
    units = units.join(one, f"_at{base}")
    for i in others:
        packed = (
            lists[i][0].filter(F.col("_idx") < sizes[i])
            .select(F.expr(f"_idx div {per_block[i]}L").alias(f"_at{i}"), entry.alias("e"))
            .groupBy(f"_at{i}").agg(F.collect_list("e").alias(f"_b{i}"))
        )
        units = units.join(packed, f"_at{i}")
    index = lambda i: F.col(f"_e{i}._idx")
    opened = [base]
    for i in others:
        units = units.withColumn(f"_e{i}", F.explode(f"_b{i}")).drop(f"_b{i}")
        if distinct:
            for j in opened:
                units = units.filter(index(i) != index(j))
        opened.append(i)
    place = F.lit(0).cast("long")
    for i in range(k):
        digit = index(i)
        if distinct:  # how many free items were skipped
            for j in range(i):
                digit = digit - F.when(index(j) < index(i), 1).otherwise(0)
        place = place + digit * F.lit(below[i])
    unit_id = F.concat_ws("-", *[F.col(f"_e{i}._name") for i in range(k)]).alias("unit_id")
    made = units.select(unit_id, *[F.col(f"_e{i}._item").alias(p) for i, p in enumerate(positions)], place.alias(POS))
    return made.filter(F.col(POS) < wanted)


def ambiguous_names(lists: list[DataFrame]) -> bool:
    """Whether two choices of one name per list, joined by `-`, can give one text. Names of a list are different.

    Two choices are followed side by side from the first place where they differ. One is ahead of the other by some text,
    which must be the end of a name: so all that can be ahead are ends of names at a `-`, and one more name of the other
    choice either lies within that text or goes beyond it. Both are equi-joins between ends and beginnings of names; a
    search over the ends stops after at most two names per list. If the choices meet after the same number of names, equal
    names may follow, and the joined text is ambiguous.
    """
    counted = [x.agg(F.min(_words("_name")).alias("a"), F.max(_words("_name")).alias("b")).first() for x in lists]
    if all(c.a == c.b for c in counted):
        return False  # every list has names of one number of parts
    parts = None
    for i, names in enumerate(lists):
        cuts = F.explode(F.sequence(F.lit(1), _words("_name")))
        words = F.split("_name", "-")
        made = names.select(F.lit(i).alias("place"), words.alias("w"), cuts.alias("n")).select(
            "place",
            F.array_join(F.slice("w", F.lit(1), F.col("n")), "-").alias("head"),
            # What is left behind the head; NULL if it is the whole name.
            F.when(F.col("n") < F.size("w"), F.array_join(F.slice("w", F.col("n") + 1, F.size("w")), "-")).alias("tail"),
        )
        parts = made if parts is None else parts.union(made)
    parts = settle(parts)
    whole = parts.filter("tail is null").select("place", F.col("head").alias("name"))
    longer = parts.filter("tail is not null")
    # ahead: names taken by the choice that is ahead, behind: by the other, rest: the text between them (NULL for none).
    ahead = longer.join(whole.withColumnRenamed("name", "head"), ["place", "head"]).select(
        (F.col("place") + 1).alias("ahead"), (F.col("place") + 1).alias("behind"), F.col("tail").alias("rest")
    )
    seen = None
    for _ in range(2 * len(lists)):
        ahead = ahead.distinct() if seen is None else ahead.distinct().join(seen, ["ahead", "behind", "rest"], "left_anti")
        ahead = settle(ahead)
        if ahead.isEmpty():
            return False
        seen = ahead if seen is None else seen.union(ahead)
        rest = F.split("rest", "-")
        heads = ahead.select("ahead", F.col("behind").alias("place"), "rest", F.explode(F.sequence(F.lit(1), F.size(rest))).alias("n"))
        heads = heads.select(
            "ahead", "place",
            F.array_join(F.slice(rest, F.lit(1), F.col("n")), "-").alias("name"),
            F.when(F.col("n") < F.size(rest), F.array_join(F.slice(rest, F.col("n") + 1, F.size(rest)), "-")).alias("left"),
        )
        within = heads.join(whole, ["place", "name"]).select("ahead", (F.col("place") + 1).alias("behind"), F.col("left").alias("rest"))
        beyond = ahead.select("ahead", F.col("behind").alias("place"), F.col("rest").alias("head")).join(longer, ["place", "head"])
        beyond = beyond.select((F.col("place") + 1).alias("ahead"), F.col("ahead").alias("behind"), F.col("tail").alias("rest"))
        within = settle(within)
        if not within.filter("rest is null and ahead = behind").isEmpty():
            return True
        # Level, but with different numbers of names: whatever the one with fewer takes next is ahead.
        level = within.filter("rest is null").select(F.greatest("ahead", "behind").alias("more"), F.least("ahead", "behind").alias("place"))
        onward = level.distinct().join(whole, "place").select(
            (F.col("place") + 1).alias("ahead"), F.col("more").alias("behind"), F.col("name").alias("rest")
        )
        ahead = within.filter("rest is not null").union(beyond).union(onward)
    return False


def _words(name: str) -> Column:
    return F.size(F.split(name, "-"))


def permutations(
    items: DataFrame,
    positions: list[str],
    name_field: str = "id",
    order_by: list[str] | None = None,
    limit: int | None = None,
    max_units: int | None = None,
) -> DataFrame:
    """Every ordered choice of distinct items (by place in the list, not by value) over the positions."""
    return _permute(items, positions, name_field, order_by, limit, max_units)[0]


def _permute(items, positions, name_field, order_by, limit, max_units, unique=False) -> tuple[DataFrame, int]:
    if not positions:
        raise GenerationError("positions are required")
    indexed, n = _indexed(items, order_by or [], limit, item_name(items, name_field, fallback=False), unique)
    k = len(positions)
    if n < k:
        raise GenerationError(f"Not enough items ({n}) for {k} positions")
    total = math.perm(n, k)
    wanted = min(total, max_units) if max_units else total
    units = _product([(indexed, n)] * k, positions, [math.perm(n - i - 1, k - i - 1) for i in range(k)], wanted, True)
    if unique and ambiguous_names([indexed] * k):
        assert_unique_ids(units)  # items may be taken once only, so the units themselves must tell
    return units, total


def cross_product(
    groups: dict[str, DataFrame],
    positions: list[str] | dict[str, str] | None = None,
    name_field: str = "id",
    order_by: dict[str, list[str]] | None = None,
    limit: int | None = None,
    max_units: int | None = None,
) -> DataFrame:
    """One item of each group per unit, in position order.

    `positions` maps a position to its group; a plain list uses the group named like the position plus `s`. By default
    every group is its own position.
    """
    return _cross(groups, positions, name_field, order_by, limit, max_units)[0]


def _cross(groups, positions, name_field, order_by, limit, max_units, unique=False) -> tuple[DataFrame, int]:
    if positions is None:
        sources = {name: name for name in groups}
    elif isinstance(positions, dict):
        sources = dict(positions)
    else:
        sources = {p: p + "s" for p in positions}
    for pos, key in sources.items():
        if key not in groups:
            raise GenerationError(f"No group '{key}' for position '{pos}'; there are {sorted(groups)}")
    if not sources:
        raise GenerationError("positions are required")
    order_by = order_by or {}
    lists = {
        key: _indexed(groups[key], order_by.get(key, []), limit, item_name(groups[key], name_field, fallback=True), unique)
        for key in dict.fromkeys(sources.values())
    }
    chosen = [lists[key] for key in sources.values()]
    sizes = [n for _, n in chosen]
    total = math.prod(sizes)
    wanted = min(total, max_units) if max_units else total
    below = [max(1, math.prod(sizes[i + 1 :])) for i in range(len(sizes))]
    units = _product(chosen, list(sources), below, wanted, False)
    if unique and total and ambiguous_names([names for names, _ in chosen]):
        if wanted == total:
            raise GenerationError("Item names that give one unit_id when they are joined")
        assert_unique_ids(units)  # the units that clash may lie beyond the limit
    return units, total


def direct(
    items: DataFrame,
    name_field: str = "id",
    positions: list[str] = (),
    order_by: list[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """One unit per item, item fields on top level. Without `limit` this is a plain projection."""
    name = item_name(items, name_field, fallback=True)
    first = [p for p in positions if p in items.columns]
    rest = [c for c in items.columns if c not in first and c != "unit_id"]
    units = items.select(_named(name).alias("unit_id"), *first, *rest)
    if not limit and order_by is None:
        return units
    placed = row_positions(units, order_by or [], out=POS)
    return placed.filter(F.col(POS) < limit) if limit else placed


def duplicate_ids(units: DataFrame) -> DataFrame:
    return units.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or unit_id is null or unit_id = ''")


def assert_unique_ids(units: DataFrame) -> DataFrame:
    """Fail the job if an id is empty or occurs twice."""
    bad = duplicate_ids(units).take(3)
    if bad:
        raise GenerationError(f"Duplicate or empty unit_id: {[r.unit_id for r in bad]}")
    return units


def repeat(units: DataFrame, n: int, max_units: int | None = None, base_count: int | None = None) -> DataFrame:
    """n seeded copies of every unit. With positions at hand, copies are numbered repetition by repetition, so the first
    `max_units` cover all items evenly. n = 1 leaves the units as they are. `base_count` saves counting the units.
    """
    if n < 1:
        raise GenerationError("repeat must be at least 1")
    if max_units and POS not in units.columns:
        units = row_positions(units, out=POS)
    if n == 1:
        return units.filter(F.col(POS) < max_units) if max_units else units
    kept = [c for c in units.columns if c not in ("unit_id", POS)]
    placed = POS in units.columns
    rep = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_repetition_id")
    copies = units.select("*", rep)
    out = [
        F.format_string("%s__rep%04d", "unit_id", "_repetition_id").alias("unit_id"),
        *kept,
        F.col("_repetition_id"),
        (hash_seed(F.col("unit_id")) + F.col("_repetition_id")).alias("_repetition_seed"),
    ]
    if placed:
        base = units.count() if base_count is None else base_count
        out.append((F.col("_repetition_id") * F.lit(base) + F.col(POS)).alias(POS))
        if max_units:
            needed = math.ceil(max_units / base) if base else 0
            copies = copies.filter(F.col("_repetition_id") < needed)
    repeated = copies.select(*out)
    return repeated.filter(F.col(POS) < max_units) if max_units else repeated


def assign_chunks(units: DataFrame, size: int = 100, order_by: list[str] | None = None, first_chunk: int = 0) -> DataFrame:
    """`chunk_id` and `chunk_name` for runs of `size` units in order. A size that is not positive counts as 100."""
    size = size if isinstance(size, int) and size > 0 else 100
    if order_by is not None or POS not in units.columns:
        units = row_positions(units.drop(POS), order_by or [], out=POS)
    chunk = F.expr(f"cast({POS} div {size}L as int)") + F.lit(first_chunk)
    return units.withColumn("chunk_id", chunk).withColumn("chunk_name", F.format_string("chunk_%03d", "chunk_id"))


def generation_summary(chunked: DataFrame, strategy: str) -> DataFrame:
    """Totals of a generated set: units, base units, chunks."""
    base = F.regexp_replace("unit_id", r"__rep[0-9]+$", "") if "_repetition_id" in chunked.columns else F.col("unit_id")
    return chunked.agg(
        F.lit(strategy).alias("strategy"),
        F.count(F.lit(1)).alias("total_units"),
        F.countDistinct(base).alias("base_units"),
        F.countDistinct("chunk_id").alias("chunks"),
    ).select("strategy", "total_units", "base_units", "chunks")


def generate_units(
    sources: DataFrame | dict[str, DataFrame],
    strategy: str = "permutation",
    positions=None,
    name_field: str = "id",
    repeat_count: int = 1,
    max_units: int | None = None,
    limit: int | None = None,
    order_by=None,
) -> DataFrame:
    """The three strategies behind one call, then repetition and the unit limit.

    Items of a list must give different names; `permutations` and `cross_product` alone do not ask for that.
    """
    few = max_units if repeat_count == 1 else None
    if strategy == "permutation":
        base, total = _permute(sources, positions or [], name_field, order_by, limit, few, True)
    elif strategy == "cross_product":
        base, total = _cross(sources, positions, name_field, order_by, limit, few, True)
    elif strategy == "direct":
        base, total = assert_unique_ids(direct(sources, name_field, positions or [], order_by, limit)), None
    else:
        raise GenerationError(f"Unknown strategy '{strategy}'")
    return repeat(base, repeat_count, max_units, total)
