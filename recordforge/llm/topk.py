"""Exact top-k search by inner product with a pivot table.

For every vector the distances to many pivots are computed once. The triangle inequality turns them into a lower bound of
the distance between a query and a candidate, |d(q, p) - d(x, p)| at its largest over the pivots p, and so into an upper
bound of their inner product, (|q|^2 + |x|^2 - bound^2) / 2. Candidates are evaluated in the order of their bounds, and a
query stops as soon as no bound reaches its k-th score. Scores are integers and exact; ties go to the smaller id, so the
search goes on while a bound equals the k-th score.

Rows are dealt by hash into slices of bounded size, one task each. Queries, a stated part of the rows, go to every slice as
plain rows and stream past it, so a task holds one slice and one block of queries; nothing is joined, and no part of either
side passes through the driver. The best of all slices are ranked at the end. Pivots are chosen on a bounded sample by
farthest-first traversal; they decide about speed only.

Vectors that are NULL or hold NULL or non-finite components take no part, nor do NULL ids and empty vectors. Vectors only
meet those of the same dimension. Rows with one id are separate candidates; a query leaves out all rows of its own id, and
repeated query rows are answered each. Products whose sums could pass 2**53 raise an error, for they would not be exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordforge.llm.work import stored, tidy

BLOCK_ROWS = 65_536  # at most so many rows in a slice of one dimension,
BLOCK_VALUES = 1 << 22  # and at most about so many components
LEAST_ROWS = 4_096  # smaller slices are not made for the sake of more tasks
BLOCK_QUERIES = 512
CHUNK = 512


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component as long; NULL for vectors that take no part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    return F.when(F.coalesce(fine, F.lit(False)) & (F.size(vector) > 0), whole)


def choose_pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """Farthest-first: each pivot is the sample row farthest from those before it."""
    picked = [0]
    gap = ((sample - sample[0]) ** 2).sum(1)
    while len(picked) < min(most, len(sample)) and gap.max() > 0:
        picked.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[picked[-1]]) ** 2).sum(1))
    return sample[picked]


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (vectors**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * vectors @ pivots.T
    return np.sqrt(np.maximum(square, 0))


class Best:
    """The k best of one block of queries so far."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, [np.zeros(0)] * n, [np.zeros(0, np.int64)] * n

    def worst(self, q: int) -> float:
        return self.scores[q][-1] if len(self.scores[q]) == self.k else -np.inf

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[q], scores]), np.concatenate([self.ids[q], ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[q], self.ids[q] = scores[order], ids[order]


class Slice:
    """The rows of one slice, with their distances to the pivots."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, kind: type):
        self.ids, self.size = ids, (vectors**2).sum(1)
        self.by_pivot = np.ascontiguousarray(distances(vectors, pivots).T)
        self.vectors = vectors.astype(kind)


def search(best: Best, q_ids, q, q_far, x: Slice) -> None:
    """Merge the candidates of one slice into `best`; `q_far` are distances to the pivots."""
    q_size, q_fine = (q**2).sum(1), q.astype(x.vectors.dtype)
    apart = np.empty(len(x.ids))
    for i in range(len(q_ids)):
        gap = np.zeros(len(x.ids))
        for far, own in zip(x.by_pivot, q_far[i]):
            np.abs(np.subtract(far, own, out=apart), out=apart)
            np.maximum(gap, apart, out=gap)
        # A little slack for rounding in the distances; scores themselves are integers.
        gap = np.maximum(gap * (1 - 1e-9) - 1e-6, 0)
        bound = (q_size[i] + x.size - gap**2) / 2
        bound[x.ids == q_ids[i]] = -np.inf
        bound = np.floor(bound + 0.5)
        open_rows = np.flatnonzero((bound >= best.worst(i)) & (bound > -np.inf))
        order = open_rows[np.argsort(-bound[open_rows])]
        at, step = 0, CHUNK
        while at < len(order) and bound[order[at]] >= best.worst(i):
            rows = order[at : at + step]
            scores = (x.vectors[rows] @ q_fine[i]).astype(np.float64)
            near = scores >= best.worst(i)
            if near.any():
                best.add(i, scores[near], x.ids[rows[near]])
            at, step = at + step, 2 * step


def top_k(
    table: DataFrame, is_query: Column, k: int = 5, scale: int = 256, n_pivots: int = 48, sample: int = 4096
) -> DataFrame:
    """(query_id, rank, vec_id, score) for a table (vec_id, embedding)."""
    spark = table.sparkSession
    whole = table.select("vec_id", integers(F.col("embedding"), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))
    whole = whole.filter("v is not null and vec_id is not null").withColumn("dim", F.size("v"))
    rows = stored(whole.withColumn("place", F.monotonically_increasing_id()), "vectors")
    largest = F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))).alias("largest")
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), largest).collect()
    if any(s["largest"] ** 2 * s["dim"] * 4 >= 2.0**53 for s in sizes):
        raise ValueError("vector components are too large for exact scores")
    # Single precision holds all sums below 2**24.
    kinds = {s["dim"]: np.float32 if s["largest"] ** 2 * s["dim"] < 2.0**24 else np.float64 for s in sizes}
    per_dim = max(1, sample // max(1, len(sizes)))
    mixed = Window.partitionBy("dim").orderBy(F.xxhash64("vec_id"), "vec_id")
    picked = rows.withColumn("_r", F.row_number().over(mixed)).filter(F.col("_r") <= per_dim).select("dim", "v").collect()
    pivots = {
        s["dim"]: choose_pivots(np.array([p["v"] for p in picked if p["dim"] == s["dim"]], np.float64), n_pivots) for s in sizes
    }
    shared = spark.sparkContext.broadcast((pivots, kinds))
    least = max([1, *(-(-s["n"] // max(1, min(BLOCK_ROWS, BLOCK_VALUES // s["dim"]))) for s in sizes)])
    spread = min(2 * spark.sparkContext.defaultParallelism, max([1, *(s["n"] // LEAST_ROWS for s in sizes)]))
    slices = max(least, spread)
    parts = ("place", "vec_id", F.col("v").cast("array<int>").alias("v"))
    own = F.pmod(F.xxhash64("place"), F.lit(slices)).cast("int")
    x = rows.select("dim", own.alias("slice"), F.lit(False).alias("asks"), *parts)
    q = rows.filter("query").select("dim", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(True).alias("asks"), *parts)
    met = x.unionByName(q).repartitionById(slices, "slice").sortWithinPartitions("slice", "dim", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, kept = None, [], None  # rows of a slice come before its queries
        for b in batches:
            dims, at, asks = (b.column(n).to_numpy(zero_copy_only=False) for n in ("dim", "slice", "asks"))
            change = (np.diff(dims) != 0) | (np.diff(at) != 0) | (np.diff(asks.astype(np.int8)) != 0)
            for piece, first in _pieces(b, [0, *(np.flatnonzero(change) + 1), b.num_rows]):
                dim = int(dims[first])
                ids = piece.column("vec_id").to_numpy()
                vectors = piece.column("v").flatten().to_numpy().reshape(-1, dim).astype(np.float64)
                if (dim, at[first]) != key:
                    key, held, kept = (dim, at[first]), [], None
                if not asks[first]:
                    held.append((ids, vectors))
                    continue
                if kept is None and held:
                    all_ids, all_vectors = (np.concatenate(c) for c in zip(*held))
                    held, kept = [], Slice(all_ids, all_vectors, shared.value[0][dim], shared.value[1][dim])
                if kept is None:
                    continue
                best = Best(len(ids), k)
                search(best, ids, vectors, distances(vectors, shared.value[0][dim]), kept)
                count = [len(s) for s in best.scores]
                cells = [
                    np.repeat(ids, count), np.repeat(piece.column("place").to_numpy(), count),
                    np.concatenate(best.ids), np.concatenate(best.scores).astype(np.int64),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], names=["query_id", "place", "vec_id", "score"])

    near = met.mapInArrow(tidy(run), "query_id long, place long, vec_id long, score long")
    order = Window.partitionBy("query_id", "place").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _pieces(batch: pa.RecordBatch, borders: list[int]) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Parts of a batch between borders, of at most a block of queries each, and where they begin."""
    for a, b in zip(borders, borders[1:]):
        for first in range(a, b, BLOCK_QUERIES):
            yield batch.slice(first, min(BLOCK_QUERIES, b - first)), first
