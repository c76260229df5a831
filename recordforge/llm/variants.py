"""Spelling variants: words one edit apart, grouped by rotations of marked words.

A word with a terminator behind it has one rotation per place. If two words differ in one replaced character, the rotations
that put that character last agree in all before it; if one word has a character more, its rotation without the last character
is a whole rotation of the other. So every word writes its rotations twice, whole and without the last character, where
that is a letter. Sorted, the words that are one edit apart at one place stand side by side: a group is what fits the rotation
with any one letter or none at its end, so it has at most as many members as there are letters, and one more. A scan of the
groups tells each member how many others it has and which is the most frequent; nothing is expanded into pairs.

A letter of a run of equal letters may be deleted at several places with the same result; only the last place of a run counts
as a deletion, so every two neighbours meet in exactly one group.

A word's form is its most frequent neighbour if that is frequent enough by far. Forms lead to ever more frequent words, so
following them ends; paths are halved until none gets shorter.

NULL texts hold no words, a NULL id is written as an empty text. Repeated rows count again. An empty table gives an empty
result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordforge.llm.work import stored

SHORTEST = 7
TIMES = 10  # a form occurs this many times as often
SPOILED = 31  # every run whose checksum this divides loses a letter
END = "$"
_RUN = re.compile(rb"[a-z\xc0-\xff]{%d,}" % SHORTEST)
_KEEP = 200_000  # words that a task counts before it hands them on


def spelled_runs(doc_id: int | None, text: str | None) -> Iterator[bytes]:
    """The runs of a text that are long enough, in Latin-1 and with one letter less where the checksum says so."""
    if not text:
        return
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for found in _RUN.finditer(text.encode("latin-1", "replace").lower()):
        run = found.group()
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
        if h % SPOILED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < SHORTEST:
                continue
        yield run


def count_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) over all texts; runs are added up inside a task before anything moves."""

    def batch(counts: dict[bytes, int]) -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in counts], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for b in batches:
            for i, t in zip(b.column(0), b.column(1)):
                for w in spelled_runs(i.as_py(), t.as_py()):
                    counts[w] = counts.get(w, 0) + 1
                    if len(counts) >= _KEEP:
                        yield batch(counts)
                        counts.clear()
        yield batch(counts)

    rows = docs.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def rotations(words: DataFrame) -> DataFrame:
    """(key, word, n, whole, deletes): whole rotations, and those without the last letter; whether the word without that
    letter counts as its neighbour."""
    word, place = F.col("word"), F.col("place")
    before = word.substr(F.lit(1), place)
    after = lambda skip: word.substr(place + 1 + skip, F.length("word"))
    rotated = lambda skip: F.concat(after(skip), F.lit(END), before)
    letter = lambda at: word.substr(at, F.lit(1))
    whole = F.struct(rotated(0).alias("key"), F.lit(True).alias("whole"), F.lit(False).alias("deletes"))
    cut = F.struct(
        rotated(1).alias("key"), F.lit(False).alias("whole"), (letter(place + 1) != letter(place + 2)).alias("deletes")
    )
    made = F.when(place < F.length("word"), F.array(whole, cut)).otherwise(F.array(whole))
    placed = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("place"))
    return placed.select("word", "n", F.inline(made))


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best) for words (word, n) with a neighbour; best is (-n, word) of the most frequent, and of these the
    first, among the neighbours that are more frequent than the word itself (else it may be another neighbour)."""
    over = lambda value, when, how: how(F.when(when, value)).over(Window.partitionBy("key"))
    ranked = F.struct((-F.col("n")).alias("minus_n"), F.col("word").alias("word"))
    cut, deletes = ~F.col("whole"), F.col("deletes")
    scanned = rotations(words).select(
        "word", "n", "whole", "deletes",
        over(F.lit(1), F.lit(True), F.count).alias("members"),
        over(F.lit(1), cut, F.count).alias("n_cut"),
        over(F.lit(1), deletes, F.count).alias("n_deletes"),
        over(ranked, cut, F.min).alias("best_cut"),
        over(ranked, deletes, F.min).alias("best_deletes"),
        over(ranked, F.col("whole"), F.min).alias("the_whole"),
    ).filter("members > 1")
    others = lambda best: F.when(best["word"] != F.col("word"), best)
    near = F.when(F.col("whole"), F.col("n_deletes")).otherwise(
        F.col("n_cut") - 1 + F.when(deletes & F.col("the_whole").isNotNull(), 1).otherwise(0)
    )
    best = F.when(F.col("whole"), F.col("best_deletes")).otherwise(
        F.least(others(F.col("best_cut")), F.when(deletes, F.col("the_whole")))
    )
    found = scanned.select("word", near.cast("long").alias("near"), best.alias("best"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the end of the path of forms that starts with each word."""
    paths = stored(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        further = paths.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = stored(paths.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        paths = longer.select("word", "root")
        if longer.filter("moved").isEmpty():
            return paths


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word with at least two occurrences."""
    words = stored(count_words(docs, doc_id, text).filter("n >= 2"), "variant-words")
    near = stored(neighbours(words).filter("n_near > 0"), "variant-near")
    told = words.join(near, "word", "left")
    enough = -F.col("best.minus_n") >= TIMES * F.col("n")
    judged = stored(
        told.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.minus_n")).alias("form_n"),
        ),
        "variant-forms",
    )
    ends = roots(judged.filter("form is not null"))
    return judged.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
