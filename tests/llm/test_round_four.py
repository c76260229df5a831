"""Searches whose blocks do not pass through the driver."""

import numpy as np
from pyspark.sql import functions as F

from recordforge.llm import topk

VECTORS = "vec_id long, embedding array<float>"


def test_top_k_broadcasts_no_blocks(spark, monkeypatch):
    # Copies of all queries for all slices used to be broadcast, as their size was taken for that of the queries alone.
    monkeypatch.setattr(topk, "BLOCK_ROWS", 40)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 7)
    r = np.random.default_rng(6)
    vectors = r.normal(size=(700, 8)).astype(np.float32) * 100  # too large for single precision
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], VECTORS)
    found = topk.top_k(table, F.col("vec_id") % 10 == 0)
    got = sorted(map(tuple, found.collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "Join" not in plan and "Broadcast" not in plan
    ints = np.floor(vectors.astype(float) * 256).astype(np.int64)
    want = []
    for i in range(0, 700, 10):
        scores = ints @ ints[i]
        best = [j for j in np.lexsort((np.arange(700), -scores)) if j != i][:5]
        want += [(i, n + 1, int(j), int(scores[j])) for n, j in enumerate(best)]
    assert got == sorted(want)
