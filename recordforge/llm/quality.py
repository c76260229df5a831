"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of 64 words; only the document has a label. Every passage is described by shares of its
bytes and words (letters, capitals, signs, repeated words, …) and encoded by a small layer. A gated attention weighs the
passages (tanh gate times sigmoid gate, softmax over the document's passages), and a logistic unit scores the weighted
sum. Training is by gradient descent (Adam) on a bounded sample of labelled documents: at most `sample` of them, none
longer than `longest` characters. Scoring covers every passage of every text.

A text without words is one passage of zeros. NULL texts score like empty ones. Without any label the score is 0.5.
Labelled documents are picked by a hash, so repeated runs agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordforge.llm.textarrays import pieces, split, word_hashes
from recordforge.llm.work import free_name

PASSAGE = 64  # words
# Classes of bytes whose shares describe a passage; bytes above 127 belong to letters beyond ASCII.
_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"()-", b"!?", b"#*$%&@=+~^", b"|<>[]{}\\/_`"]
_CLASS = np.zeros(256, np.uint8)
for _i, _chars in enumerate(_CLASSES):
    _CLASS[list(_chars)] = _i + 1
_CLASS[128:] = len(_CLASSES) + 1
N_FEATURES = len(_CLASSES) + 1 + 9


def passages(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the number of passages of each text (at least 1)."""
    w = split(texts)
    n = np.diff(w.first)
    count = np.maximum(1, -(-n // PASSAGE))
    before = np.cumsum(count) - count
    doc = np.repeat(np.arange(len(n)), count)
    lo = np.minimum(w.first[:-1][doc] + (np.arange(len(doc)) - before[doc]) * PASSAGE, w.first[1:][doc])
    hi = np.minimum(lo + PASSAGE, w.first[1:][doc])
    size = hi - lo
    out = np.zeros((len(doc), N_FEATURES), np.float32)
    if not len(w.starts):
        return out, count
    full = size > 0
    lo_, hi_, words = lo[full], hi[full], size[full].astype(np.float64)
    b0, b1 = w.starts[lo_], w.ends[hi_ - 1]
    letters = np.maximum(b1 - b0, 1).astype(np.float64)

    def over(flags: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[b] - sums[a]

    kinds = _CLASS[w.data]
    columns = [over(kinds == i + 1, b0, b1) / letters for i in range(len(_CLASSES) + 1)]
    h = word_hashes(w)
    lengths = w.ends - w.starts
    first, last = kinds[w.starts], kinds[w.ends - 1]
    for back in (1, 2, 3):
        same = np.zeros(len(h), bool)
        same[back:] = h[back:] == h[:-back]
        columns.append(over(same, lo_, hi_) / words)
    columns.append(over(first == 2, lo_, hi_) / words)
    columns.append(over((last == 5) | (last == 6), lo_, hi_) / words)
    columns.append(over((lengths == 1) & (first == 7), lo_, hi_) / words)
    columns.append(over(lengths, lo_, hi_) / words / 10)
    columns.append(over(lengths > 20, lo_, hi_) / words)
    columns.append(np.log1p(words) / 4)
    out[full] = np.stack(columns, 1)
    return out, count


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Encoder, gated attention and scoring unit over standardized passage features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, base: float, hidden: int = 24, gate: int = 12, seed: int = 7):
        r = np.random.default_rng(seed)
        d = len(mean)
        self.mean, self.scale = mean, scale
        self.p = {
            "W": r.normal(0, d**-0.5, (d, hidden)), "b": np.zeros(hidden),
            "V": r.normal(0, hidden**-0.5, (hidden, gate)), "U": r.normal(0, hidden**-0.5, (hidden, gate)),
            "w": r.normal(0, gate**-0.5, gate), "c": np.zeros(hidden), "d": np.array(base),
        }

    def forward(self, x: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, tuple]:
        p, x = self.p, (x - self.mean) / self.scale
        starts = np.cumsum(count) - count
        h = np.maximum(x @ p["W"] + p["b"], 0)
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), count))
        a = e / np.repeat(np.add.reduceat(e, starts), count)
        z = np.add.reduceat(a[:, None] * h, starts)
        return _sigmoid(z @ p["c"] + p["d"]), (x, h, t, g, a, z, starts)

    def gradients(self, x: np.ndarray, count: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        s, (x, h, t, g, a, z, starts) = self.forward(x, count)
        out = (s - y) / len(y)
        of = np.repeat(np.arange(len(y)), count)
        dz = out[:, None] * p["c"]
        da = (dz[of] * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, starts)[of])
        dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
        dh = a[:, None] * dz[of] + dt @ p["V"].T + dg @ p["U"].T
        dh[h <= 0] = 0
        return {
            "W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ out, "d": out.sum(),
        }


def train(x: np.ndarray, count: np.ndarray, y: np.ndarray, rounds: int = 60, batch: int = 256, rate: float = 0.01) -> Model:
    """Fit on bags given one after the other; `count` passages each, labels 0 or 1."""
    share = np.clip(y.mean(), 0.01, 0.99)
    model = Model(x.mean(0), x.std(0) + 1e-3, float(np.log(share / (1 - share))))
    starts = np.concatenate([[0], np.cumsum(count)])
    r = np.random.default_rng(11)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(w) for k, w in model.p.items()}
    step = 0
    for turn in range(rounds):
        order = r.permutation(len(y))
        for i in range(0, len(y), batch):
            pick = order[i : i + batch]
            rows = np.concatenate([np.arange(starts[j], starts[j + 1]) for j in pick])
            step += 1
            now = rate * (1 - turn / rounds)
            for k, d in model.gradients(x[rows], count[pick], y[pick]).items():
                d = d + 1e-4 * model.p[k] * (k not in "bd")
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.99 * v[k] + 0.01 * d * d
                model.p[k] = model.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return model


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).cast(pa.binary()).to_pylist()
        for lo, hi in pieces(texts):
            x, count = passages(texts[lo:hi])
            ends = np.cumsum(count)
            bags = [x[e - c : e].tobytes() for e, c in zip(ends, count)]
            yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array(bags, pa.binary())], names=["label", "bag"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 6000, longest: int = 50_000) -> Model | None:
    """Learn from `labels` (doc_id, label 0/1) and the texts of `docs` (doc_id, text)."""
    usable = labels.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    picked = usable.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.filter(F.coalesce(F.char_length("text"), F.lit(0)) <= longest).select("doc_id", "text")
    # At most `sample` pairs of numbers.
    known = texts.join(F.broadcast(picked), "doc_id").select("label", "text")
    # A label of a repeated doc_id is learned from several texts; the bound is on documents with a label.
    rows = known.mapInArrow(_bags, "label int, bag binary").limit(2 * sample).collect()
    if not rows:
        return None
    x = [np.frombuffer(r["bag"], np.float32).reshape(-1, N_FEATURES) for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["label"], rows[i]["bag"]))  # not the order of arrival
    y = np.array([rows[i]["label"] for i in order], float)
    return train(np.concatenate([x[i] for i in order]).astype(np.float64), np.array([len(x[i]) for i in order]), y)


def score(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The columns `keep` of `docs` with `score`, computed from the whole `text`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            values = np.full(len(texts), 0.5)
            for lo, hi in pieces(texts) if shared.value else ():
                values[lo:hi] = shared.value.forward(*passages(texts[lo:hi]))[0]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), pa.array(values, pa.float64())], names=out
            )

    rows = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")
    out = [*keep, free_name(rows, "score")]
    kinds = [*(rows.schema[c].dataType.simpleString() for c in keep), "double"]
    return rows.mapInArrow(scored, ", ".join(f"`{c}` {t}" for c, t in zip(out, kinds)))
