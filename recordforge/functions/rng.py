"""Stateless random draws: a value depends on (seed, name, counter) only.

Every draw is a Column over the row's own seed, so results are the same under any partitioning and after any task retry.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# 31-bit seed mask, and 13 hex digits = 52 random bits per draw.
SEED_MASK = 0x7FFFFFFF
HEX_DIGITS = 13
DRAW_RANGE = float(2**52)


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def hash_seed(text: Column) -> Column:
    """The low 31 bits of sha256(text)."""
    tail = F.substring(F.sha2(text, 256), 57, 8)
    return F.conv(tail, 16, 10).cast("bigint").bitwiseAND(F.lit(SEED_MASK))


def default_seed(columns: list[str], step: str, unit_id: str = "unit_id") -> Column:
    """`_repetition_seed` where the row has one, else a seed from unit id and step name."""
    own = hash_seed(F.concat(F.col(unit_id), F.lit(step)))
    return F.coalesce(F.col("_repetition_seed"), own) if "_repetition_seed" in columns else own


def u01(seed, name, counter=0) -> Column:
    """Uniform in [0, 1)."""
    name = F.lit(name) if isinstance(name, str) else name
    key = F.concat_ws(":", _col(seed).cast("string"), name, _col(counter).cast("string"))
    return F.conv(F.substring(F.sha2(key, 256), 1, HEX_DIGITS), 16, 10).cast("bigint") / F.lit(DRAW_RANGE)


def uniform(seed, name, low, high, counter=0) -> Column:
    low, high = _col(low), _col(high)
    return low + u01(seed, name, counter) * (high - low)


def integer(seed, name, low, high, counter=0) -> Column:
    """Whole number with both ends included."""
    low, high = _col(low).cast("bigint"), _col(high).cast("bigint")
    return low + F.floor(u01(seed, name, counter) * (high - low + F.lit(1)))


def choice(seed, name, seq: Column, counter=0) -> Column:
    """One element of an array; NULL for an empty array."""
    at = (F.lit(1) + F.floor(u01(seed, name, counter) * F.size(seq))).cast("int")
    return F.when(F.size(seq) > 0, F.try_element_at(seq, at))


def shuffle(seed, name, seq: Column) -> Column:
    """All elements in random order. Equal elements stay apart: order is drawn by position."""
    seed = _col(seed)
    keyed = F.transform(seq, lambda x, i: F.struct(u01(seed, name, i).alias("u"), i.alias("i"), x.alias("x")))
    ordered = F.array_sort(
        keyed,
        lambda a, b: F.when((a.u < b.u) | ((a.u == b.u) & (a.i < b.i)), F.lit(-1)).otherwise(F.lit(1)),
    )
    return F.transform(ordered, lambda s: s.x)


def sample(seed, name, seq: Column, k: int) -> Column:
    """k elements without replacement by position; NULL (an evaluation error) when k exceeds the size."""
    return F.when(F.size(seq) >= k, F.slice(shuffle(seed, name, seq), 1, k))


def gauss(seed, name, mu, sigma, counter=0) -> Column:
    """Normal draw by Box-Muller over two uniform draws."""
    a = u01(seed, f"{name}/r", counter)
    b = u01(seed, f"{name}/t", counter)
    radius = F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - a))
    return _col(mu) + _col(sigma) * radius * F.cos(F.lit(2.0 * math.pi) * b)
