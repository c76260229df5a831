"""Language identification with string kernels.

The kernel of two texts is the number of character n-grams (n = 1, 2, 3 together: a blended spectrum) present in both,
divided by the root of the product of the two numbers of n-grams. Presence is over whole texts. The alphabet is the most
common letters of the training texts, one sign for other letters and one for all else; the n-grams counted are the most
widespread of the training texts. A set of training texts are landmarks (Nyström); one ridge regression per language
against the rest is solved on the landmark features. Texts are scored in batches: presence matrix times landmark matrix
times coefficients.

Training uses a bounded sample: at most `per_language` labelled texts of a language (of MOST_LANGUAGES, the most common), none longer than `longest` characters;
scores are computed for every text. NULL texts and texts without a letter are `und` with score 0, as is everything if no
label can be learned from. Ties go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordforge.llm.work import free_name, tidy

SIGNS = 64  # alphabet size, including "other letter" and "no letter"
MOST_LANGUAGES = 1000  # that are learned
CODES = SIGNS + SIGNS**2 + SIGNS**3


@lru_cache(1)
def _letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _codes(signs: np.ndarray) -> np.ndarray:
    """Numbers of all 1-, 2- and 3-grams of a text."""
    s = signs.astype(np.int32)
    two = s[:-1] * SIGNS + s[1:]
    three = two[:-1] * SIGNS + s[2:]
    return np.concatenate([s, two + SIGNS, three + (SIGNS + SIGNS**2)])


class Model:
    """What scoring needs; its size is bounded by the parameters of `fit`."""

    def __init__(self, sign_of, column_of, landmarks, coefficients, languages):
        self.sign_of, self.column_of, self.landmarks = sign_of, column_of, landmarks
        self.coefficients, self.languages = coefficients, languages

    def presence(self, points: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(points), self.landmarks.shape[0]), np.float32)
        for row, p in zip(out, points):
            columns = self.column_of[_codes(self.sign_of[p])]
            row[columns[columns >= 0]] = 1
        return out

    def kernel(self, present: np.ndarray) -> np.ndarray:
        sizes = np.sqrt(np.maximum(present.sum(1, keepdims=True), 1))
        return (present @ self.landmarks) / sizes

    def scores(self, points: list[np.ndarray]) -> np.ndarray:
        return self.kernel(self.presence(points)) @ self.coefficients


def fit(texts: list[str], labels: list[str], n_grams: int = 4096, n_landmarks: int = 160, ridge: float = 1e-3) -> Model | None:
    languages = sorted(set(labels))
    if not languages:
        return None
    letters, points = _letters(), [_points(t) for t in texts]
    counts = np.zeros(0x110000, np.int64)
    for p in points:
        seen = np.unique(p)
        counts[seen[letters[seen]]] += 1
    sign_of = np.where(letters, 1, 0).astype(np.uint8)
    common = np.argsort(-counts, kind="stable")[: SIGNS - 2]
    sign_of[common[counts[common] > 0]] = np.arange(2, SIGNS)[: int((counts[common] > 0).sum())]
    y = np.array([languages.index(x) for x in labels])
    spread = np.zeros((len(languages), CODES), np.int32)
    for p, k in zip(points, y):
        spread[k, np.unique(_codes(sign_of[p]))] += 1
    # The most widespread n-grams of every language get an equal share of the columns.
    share = max(1, n_grams // len(languages))
    used = np.unique(np.concatenate([np.argsort(-row, kind="stable")[:share] for row in spread]))
    used = used[spread[:, used].sum(0) > 0]
    column_of = np.full(CODES, -1, np.int32)
    column_of[used] = np.arange(len(used))
    picked: list[int] = []
    for k in range(len(languages)):
        picked += np.flatnonzero(y == k)[: max(1, n_landmarks // len(languages))].tolist()
    model = Model(sign_of, column_of, np.zeros((len(used), 1), np.float32), None, languages)
    blocks = [model.presence(points[i : i + 256]) for i in range(0, len(points), 256)]
    chosen = np.concatenate([blocks[i // 256][i % 256][None] for i in picked])
    model.landmarks = (chosen / np.sqrt(np.maximum(chosen.sum(1, keepdims=True), 1))).T.copy()
    k_mm = model.kernel(chosen).astype(np.float64)
    values, vectors = np.linalg.eigh((k_mm + k_mm.T) / 2)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])  # k_mm^(-1/2) up to a rotation
    features = np.concatenate([model.kernel(b) for b in blocks]).astype(np.float64) @ root
    targets = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    # Every language weighs the same in the regression.
    weight = (1.0 / np.bincount(y, minlength=len(languages)))[y][:, None] * len(y) / len(languages)
    gram = features.T @ (features * weight) + ridge * len(y) * np.eye(features.shape[1])
    model.coefficients = (root @ np.linalg.solve(gram, features.T @ (targets * weight))).astype(np.float32)
    return model


def training_sample(docs: DataFrame, per_language: int, longest: int) -> tuple[list[str], list[str]]:
    """At most `per_language` texts of each of the most common languages, picked by hash."""
    counts = docs.groupBy("lang").count().filter("lang is not null").orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES)
    # The share thins the rows before any text is moved.
    part = F.pmod(F.xxhash64("text", F.lit(1)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    # At most MOST_LANGUAGES rows; a shuffle would put all texts of a language into one task.
    thin = docs.join(F.broadcast(counts), "lang").filter(
        (part < F.lit(2.0 * per_language) / F.col("count")) & (F.char_length("text") <= longest)
    )
    thin = thin.select("lang", "text").distinct()  # copies teach nothing
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text"))
    rows = thin.withColumn("_r", rank).filter(F.col("_r") <= per_language).orderBy("lang", "_r").select("text", "lang").collect()
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def identify(
    docs: DataFrame, learn: Column, keep: list[str], per_language: int = 600, longest: int = 20_000, batch: int = 128
) -> DataFrame:
    """Columns `keep` of `docs` (text, lang, …) with `lang_pred` and `score`; `learn` says which rows may be learned from.

    If `docs` has columns of these names already, the new ones get an underscore more.
    """
    spark = docs.sparkSession
    known = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    shared = spark.sparkContext.broadcast(fit(*training_sample(known, per_language, longest)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, letters = shared.value, _letters()
        for b in batches:
            texts = b.column("text")
            names, values = ["und"] * b.num_rows, np.zeros(b.num_rows)
            for at in range(0, b.num_rows if model else 0, batch):
                found = [(at + i, _points(t)) for i, t in enumerate(texts[at : at + batch].to_pylist()) if t]
                found = [(i, p) for i, p in found if letters[p].any()]
                if found:
                    got = model.scores([p for _, p in found])
                    best = got.argmax(1)
                    values[[i for i, _ in found]] = np.clip((got[np.arange(len(best)), best] + 1) / 2, 0, 1)
                    for (i, _), k in zip(found, best):
                        names[i] = model.languages[k]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), pa.array(names, pa.string()), pa.array(values, pa.float64())], names=out
            )

    rows = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")
    out = [*keep, free_name(rows, "lang_pred"), free_name(rows, "score")]
    kinds = [*(rows.schema[c].dataType.simpleString() for c in keep), "string", "double"]
    return rows.mapInArrow(tidy(score), ", ".join(f"`{c}` {t}" for c, t in zip(out, kinds)))
