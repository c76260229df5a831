"""Vector compression by parts, with a dictionary of values per dimension.

Vectors of integers are cut into equal parts, and each part is written as the number of the nearest entry in the codebook of
its place. Squared distances are not computed per vector: rows are kept in blocks, each dimension of a block as a dictionary
of its distinct integers and a code per row. For every dimension the squared differences of all distinct integers to all
entries are tabulated once; the distances of a part are then gathers from these tables by code, added up over the part's
dimensions. Sums of the members of an entry are counts of codes times the dictionary, so they are exact as well.

The dictionaries belong to blocks, so their size is bounded by the block whatever the table holds. Codebooks start as the
parts of the vectors with the smallest ids. Every round is one pass over the blocks; a task returns its sums per entry and
dimension as limbs of 40 bits, so no sum can overflow, and the driver receives entries x dimensions rows of totals.

Left out are vectors that are NULL, empty, or hold a NULL, NaN or infinite component, and vectors of another length than the
vector with the smallest id has. Rows with a NULL id are compressed; they come last in the order of ids. Equal ids are
ordered by their vectors. With fewer vectors than entries the codebooks are shorter. Where the length is no multiple of the
number of parts, part p holds the dimensions from p * length // parts on. Integers of any size are exact; errors beyond a
long become its largest value. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordforge.llm.work import free_name, stored

BLOCK_VALUES = 1 << 18
SCALE_BITS = 12  # components are counted in steps of 1 / 4096
LIMB = 40
_FAST = 1 << 62
MOST = (1 << 63) - 1
HOT_SHARE = 1000  # labels with more than this part of all rows are joined by broadcast; there are fewer than that many


class Codebooks(NamedTuple):
    """entries[p][e] is the list of integers of entry e in part p."""

    entries: list[list[list[int]]]

    def digest(self) -> str:
        whole = ",".join(str(x) for part in self.entries for entry in part for x in entry)
        return hashlib.sha256(whole.encode()).hexdigest()


def cuts(length: int, parts: int) -> list[int]:
    return [p * length // parts for p in range(parts + 1)]


def whole_steps(x: np.ndarray) -> np.ndarray:
    """floor(4096 * x) / 4096 of doubles, exactly; from 2 ** 52 on all doubles are whole."""
    big = np.abs(x) >= 2.0**52
    return np.where(big, x, np.floor(np.where(big, 0.0, x) * 2.0**SCALE_BITS) / 2.0**SCALE_BITS)


def integers(steps: np.ndarray) -> np.ndarray:
    """The steps as integers: 64-bit ones if they fit well, else Python's."""
    if not len(steps) or np.abs(steps).max() < 2.0**40:
        return (steps * 2.0**SCALE_BITS).astype(np.int64)
    return np.array([int(v) << SCALE_BITS if abs(v) >= 2.0**52 else int(v * 2.0**SCALE_BITS) for v in steps.tolist()], object)


class Block(NamedTuple):
    """Rows of one block: per dimension the distinct values from starts[d] to starts[d + 1], and codes[d] of all rows."""

    values: np.ndarray
    starts: np.ndarray
    codes: np.ndarray

    @staticmethod
    def of(vectors: np.ndarray) -> Block:
        values, codes, starts = [], np.empty(vectors.shape[::-1], np.uint32), [0]
        for d, column in enumerate(whole_steps(vectors).T):
            distinct, codes[d] = np.unique(column, return_inverse=True)
            values.append(distinct)
            starts.append(starts[-1] + len(distinct))
        return Block(np.concatenate(values), np.array(starts, np.int64), codes)

    def assign(self, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row and part, and its squared distance; arrays (part, row)."""
        parts, n = len(books.entries), self.codes.shape[1]
        bounds = cuts(len(self.codes), parts)
        values = integers(self.values)
        largest = max((abs(x) for part in books.entries for entry in part for x in entry), default=0)
        reach = largest + int(np.abs(values).max())
        kind = np.int64 if values.dtype == np.int64 and reach * reach * max(1, len(self.codes)) < _FAST else object
        values = values.astype(kind)
        nearest, distance = np.empty((parts, n), np.int64), np.empty((parts, n), kind)
        for p in range(parts):
            total = np.zeros((n, len(books.entries[p])), kind)
            for d in range(bounds[p], bounds[p + 1]):
                own = values[self.starts[d] : self.starts[d + 1]]
                entry = np.array([e[d - bounds[p]] for e in books.entries[p]], kind)
                table = (own[:, None] - entry[None, :]) ** 2
                total += table[self.codes[d]]
            nearest[p] = [row.index(min(row)) for row in total.tolist()] if kind is object else total.argmin(1)
            distance[p] = total[np.arange(n), nearest[p]]
        return nearest, distance

    def sums(self, nearest: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the members per (dimension, entry), and number of members per (part, entry), as Python integers."""
        parts = len(nearest)
        bounds = cuts(len(self.codes), parts)
        out = np.zeros((len(self.codes), entries), object)
        for p in range(parts):
            for d in range(bounds[p], bounds[p + 1]):
                own = integers(self.values[self.starts[d] : self.starts[d + 1]])
                counts = np.bincount(nearest[p] * len(own) + self.codes[d], minlength=entries * len(own))
                out[d] += counts.reshape(entries, len(own)).astype(own.dtype) @ own
        return out, np.stack([np.bincount(x, minlength=entries) for x in nearest]).astype(object)


def _vectors(column: pa.Array) -> np.ndarray:
    """A list column without NULLs and with one length as doubles (row, dimension)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _slices(n: int, length: int) -> Iterator[tuple[int, int]]:
    step = max(1, min(65_535, BLOCK_VALUES // max(1, length)))
    for lo in range(0, n, step):
        yield lo, min(step, n - lo)


def usable(vector: str) -> Column:
    """Whether a vector takes part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = F.col(f"`{vector}`")
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, bad), F.lit(False))


def blocks(rows: DataFrame, vector: str) -> DataFrame:
    """The vectors of all rows as blocks in the shared folder."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = _vectors(b.column(0))
            for lo, n in _slices(*whole.shape):
                block = Block.of(whole[lo : lo + n])
                fields = [pa.array([a.tobytes()], pa.binary()) for a in block]
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *fields], names=["n", *Block._fields])

    packed = rows.select(f"`{vector}`").mapInArrow(pack, "n long, values binary, starts binary, codes binary")
    return stored(packed, "vector-blocks")


def _limbs(total: int) -> Iterator[tuple[int, int]]:
    """The parts of a number in base 2 ** LIMB, the last one with its sign."""
    place = 0
    while total:
        low = total & (1 << LIMB) - 1
        if -(1 << LIMB) < total < 1 << LIMB:
            low = total
        yield place, low
        total, place = (total - low) >> LIMB, place + 1


def next_codebooks(packed: DataFrame, books: Codebooks) -> Codebooks:
    """One round: assign all parts, and put each entry in the middle of its members."""
    entries, parts = len(books.entries[0]), len(books.entries)
    length = sum(len(part[0]) for part in books.entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((length, entries), object), np.zeros((parts, entries), object)
        for b in batches:
            for n, values, starts, codes in zip(*(c.to_pylist() for c in b.columns)):
                block = Block(np.frombuffer(values), np.frombuffer(starts, np.int64), np.frombuffer(codes, np.uint32).reshape(-1, n))
                more, members = block.sums(block.assign(books)[0], entries)
                sums, counts = sums + more, counts + members
        found = [(i, *limb) for i, x in enumerate([*sums.ravel(), *counts.ravel()]) for limb in _limbs(int(x))]
        columns = list(zip(*found)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["slot", "limb", "x"])

    told = packed.mapInArrow(run, "slot long, limb long, x long").groupBy("slot", "limb").agg(F.sum("x").alias("x"))
    totals = [0] * ((length + parts) * entries)
    for r in told.collect():  # entries x dimensions x limbs
        totals[r.slot] += r.x << (LIMB * r.limb)
    bounds = cuts(length, parts)
    out = []
    for p in range(parts):
        members = totals[(length + p) * entries :]
        out.append([
            [totals[d * entries + e] // members[e] for d in range(bounds[p], bounds[p + 1])] if members[e] else books.entries[p][e]
            for e in range(entries)
        ])
    return Codebooks(out)


def compress(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6
) -> tuple[DataFrame, Codebooks]:
    """The usable rows of `df` with `code` (two hex digits per part) and `error` (long), and the codebooks.

    The two columns get a free name if `df` has them already.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits, so 1 to 256 entries")
    rows = df.filter(usable(vector))
    order = [F.col(f"`{vec_id}`").asc_nulls_last(), F.col(f"`{vector}`")]
    first = rows.orderBy(*order).select(F.size(f"`{vector}`").alias("n")).first()
    code, error = free_name(df, "code"), free_name(df, "error")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"{code} string, {error} long"])
    if first is None:
        return rows.select("*", F.lit("").alias(code), F.lit(0).cast("long").alias(error)), Codebooks([[] for _ in range(parts)])
    rows = rows.filter(F.size(f"`{vector}`") == first.n)
    seeds = rows.orderBy(*order).limit(entries).select(F.col(f"`{vector}`").cast("array<double>").alias("v")).collect()
    start = [integers(whole_steps(np.array(r.v, np.float64))).tolist() for r in seeds]
    bounds = cuts(first.n, parts)
    books = Codebooks([[s[a:b] for s in start] for a, b in zip(bounds, bounds[1:])])
    packed = blocks(rows, vector)
    for _ in range(rounds):
        books = next_codebooks(packed, books)
    digits = np.array([f"{i:02x}" for i in range(256)])
    at, names = df.columns.index(vector), [*df.columns, code, error]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = _vectors(b.column(at))
            for lo, n in _slices(*whole.shape):
                nearest, distance = Block.of(whole[lo : lo + n]).assign(books)
                codes = ["".join(row) for row in digits[nearest].T.tolist()]
                errors = [min(MOST, int(x)) for x in distance.sum(0)]
                made = [pa.array(codes, pa.string()), pa.array(errors, pa.int64())]
                yield pa.RecordBatch.from_arrays([*b.slice(lo, n).columns, *made], names=names)

    return rows.mapInArrow(run, schema), books


def with_group_sum(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """`df` with the sum of `value` over all rows of the same group (NULLs are one group), at most the largest long.

    Sums are made before anything is joined. Groups with a large share of all rows are fewer than HOT_SHARE, so they are
    joined by broadcast and their rows do not move; the rest is left to the optimizer.
    """
    key, total, n, one = (free_name(df, c) for c in ("_group", "_total", "_rows", "_all"))
    rows = stored(df, "group-rows")
    summed = rows.groupBy(F.col(group).alias(key)).agg(
        F.sum(F.col(value).cast("decimal(20,0)")).alias(total), F.count(F.lit(1)).alias(n)
    )
    capped = summed.select(key, n, F.least(total, F.lit(MOST).cast("decimal(38,0)")).cast("long").alias(name))
    sums = stored(capped, "group-sums")
    all_rows = sums.agg(F.sum(n).alias(one)).first()[0] or 0
    is_hot = F.col(n) * HOT_SHARE > all_rows
    hot, rest = F.broadcast(sums.filter(is_hot)), sums.filter(~is_hot)
    same = F.col(group).eqNullSafe(F.col(key))
    first = rows.join(hot, same).select(*df.columns, name)
    return first.union(rows.join(hot, same, "left_anti").join(rest, same).select(*df.columns, name))
