"""Operators on vectors, conversations and the pipeline."""

import json
import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recordforge.llm import chat, topk
from recordforge.llm.components import components
from tests.llm import brute

VECTORS = "vec_id long, embedding array<float>, dim int, query string"


def test_top_k(spark):
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=8).astype(np.float32).tolist(), 1, "q") for i in range(400)]
    rows += [(400 + i, rows[7][1], 1, "q") for i in range(30)]  # many equal vectors: ties by id
    rows += [(500 + i, r.normal(size=3).tolist(), 1, "q") for i in range(4)]  # another dimension, fewer than k others
    rows += [(600, None, 1, "q"), (650, [1.0, None] * 4, 1, "q"), (700, [float("nan")] * 8, 1, "q"), (750, [], 1, "q")]
    rows += [(800, [float("inf")] + [0.0] * 7, 1, "q"), (None, [1.0] * 8, None, None), rows[50], rows[3], (850, [0.0] * 8, 1, "q")]
    table = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = topk.top_k(table, F.col("vec_id") % 50 == 0, k=5).collect()
    whole = [
        (i, [int(np.floor(float(np.float32(x)) * 256)) for x in v])
        for i, v, *_ in rows
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v)
    ]
    want = []
    for i, q in whole:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in whole if j != i and len(x) == len(q))
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best[:5])]
    assert sorted(tuple(g) for g in got) == sorted(want)
    assert sum(g.query_id == 500 for g in got) == 3


def test_top_k_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 50)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 7)
    r = np.random.default_rng(5)
    # Clusters, so that pivots do exclude candidates.
    rows = [(i, (r.normal(size=6) * 0.05 + 3 * np.eye(6)[i % 6]).tolist(), 1, "") for i in range(600)]
    table = spark.createDataFrame(rows, VECTORS)
    few = topk.top_k(table, F.col("vec_id") % 20 == 0, n_pivots=8, sample=100).collect()
    ints = np.floor(np.array([v for _, v, *_ in rows], np.float32).astype(float) * 256)
    for i in range(0, 600, 20):
        scores = ints @ ints[i]
        order = [j for j in np.lexsort((np.arange(600), -scores)) if j != i][:5]
        mine = sorted((g.rank, g.vec_id, g.score) for g in few if g.query_id == i)
        assert mine == [(k + 1, j, int(scores[j])) for k, j in enumerate(order)]


def test_top_k_empty(spark):
    assert topk.top_k(spark.createDataFrame([], VECTORS), F.col("vec_id") % 50 == 0).count() == 0


def test_too_large_components(spark):
    table = spark.createDataFrame([(i, [1e9] * 4, 1, "") for i in range(3)], VECTORS)
    with pytest.raises(Exception, match="too large"):
        topk.top_k(table, F.lit(True)).collect()


def test_preferences(spark):
    r = random.Random(3)
    turns = [(c, t, r.choice(["user", "assistant"]), r.choice(["yes", "no", "é" * 5])) for c in range(40) for t in range(r.randint(1, 5))]
    turns += [(100, 0, "user", "hi"), (100, 1, "assistant", "a"), (101, 0, "user", "hi"), (101, 1, "assistant", "b")]
    turns += [(102, 0, None, None), (103, 0, None, None), (103, 0, None, None), (104, 0, "user", "alone"), (105, None, "assistant", "")]
    turns += [(106, 1, "user", "x" * 100_000), (None, 0, "user", "nobody"), turns[0]]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("prompt", F.lit(1))
    got = chat.format_preferences(table.repartition(4), F.floor(F.col("conv_id") / 2), F.col("conv_id") % 2 == 0).collect()
    sides = defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            sides[c].append(((t is not None, t or 0), (role is not None, role or ""), (text is not None, text or "")))
    assert sorted(g.pair_id for g in got) == sorted({c // 2 for c in sides})
    for g in got:
        a, b = (sorted(sides[2 * g.pair_id + k]) for k in (0, 1))
        n = 0
        while n < min(len(a), len(b)) and a[n][1:] == b[n][1:]:
            n += 1
        show = lambda ts: "".join(f"<|im_start|>{t[1][1]}\n{t[2][1]}<|im_end|>\n" for t in ts)
        assert (g.n_shared, g.prompt, g.chosen, g.rejected) == (n, show(a[:n]), show(a[n:]), show(b[n:]))
        for text, mask, own in ((g.chosen, g.chosen_mask, a[n:]), (g.rejected, g.rejected_mask, b[n:])):
            at, learned = 0, ""
            for run in mask:
                learned += text[at : at + run.chars] if run.learn else ""
                at += run.chars
            assert at == len(text)
            assert learned == "".join(t[2][1] + "<|im_end|>\n" for t in own if t[1][1] == "assistant")


def test_preferences_empty(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_preferences(table, F.col("conv_id"), F.lit(True)).count() == 0


def test_components(spark):
    r = random.Random(7)
    links = [(i, i + 1) for i in range(60)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(60)] + [(-5, 300), (300, -5), (7, 7)]
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {g.node: g.component for g in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage kept, from a folder with odd documents."""
    folder = str(tmp_path_factory.mktemp("docs"))
    rows = brute.odd_rows(11, 200)
    spark.createDataFrame(rows, brute.COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [docs.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        kept.append(docs.collect())
    return folder, kept


def test_stages(spark, stages):
    folder, (raw, known, single, cut, mixed, coded) = stages
    assert all(rows[0].__fields__ == raw[0].__fields__ for rows in (known, single, cut, mixed))
    row = lambda x: json.dumps(x.asDict(), sort_keys=True)
    assert sorted(map(row, known)) == sorted(row(x) for x in raw if any(c.isalpha() for c in x.text or ""))
    groups = brute.components([(x.doc_id, x.text) for x in known if x.doc_id is not None])
    want = [x for x in known if x.doc_id is None or groups[x.doc_id][1] == x.doc_id]
    assert sorted(map(row, single)) == sorted(map(row, want)) and len(want) < len(known)
    left = brute.without_repeats([(x.doc_id if x.doc_id is not None else 10**18, x.text) for x in single])
    text_of = {x.doc_id: x.text for x in single}
    for x in cut:
        n, kept = left[x.doc_id if x.doc_id is not None else 10**18]
        assert brute.words(x.text) == kept
        assert x.text == text_of[x.doc_id] if n == len(kept) else x.n_chars == len(x.text)
    assert {x.doc_id for x in single} - {x.doc_id for x in cut} == {i for i, (n, k) in left.items() if n and not k}
    sizes, taken = defaultdict(int), defaultdict(int)
    for x in cut:
        sizes[x.source] += len(brute.words(x.text))
    for x in mixed:
        taken[x.source] += len(brute.words(x.text))
    longest = max(len(brute.words(x.text)) for x in cut)
    for s, t in brute.targets(dict(sizes)).items():
        assert abs(taken[s] - t) <= longest
    assert all(x.same_text and x.n_tokens == len(x.ids) for x in coded)
    assert sorted(map(repr, ((x.doc_id, x.source) for x in coded))) == sorted(map(repr, ((x.doc_id, x.source) for x in mixed)))


def test_run(spark, stages):
    folder, kept = stages
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, kept[-1]))


def test_empty_run(spark, tmp_path):
    spark.createDataFrame([], brute.COLUMNS).write.parquet(os.fspath(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, os.fspath(tmp_path)).count() == 0
