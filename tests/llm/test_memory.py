"""What a Python worker holds does not grow with how often a text repeats itself, nor from group to group."""

import tracemalloc

import numpy as np
import pyarrow as pa

from recordforge.llm import repeats, work
from recordforge.llm.textarrays import split


def test_a_text_of_one_word_is_located_in_little_memory():
    n = 300_000
    p = repeats.Places(split([b"a " * n]))
    keys = np.unique(repeats._keys(p.phrases[p.represents], 64))
    tracemalloc.start()
    try:
        got = repeats._located(p, keys, 64)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(got) == n - repeats.WINDOW + 1
    assert peak < 80 << 20


def test_memory_is_given_back_after_a_large_group(monkeypatch):
    calls = []
    monkeypatch.setattr(work, "give_back_memory", lambda: calls.append(1))
    small, large = pa.table({"a": [1, 2]}), pa.table({"a": np.arange(work.SMALL_GROUP)})
    run = work.tidy_group(lambda key, own, other: own.num_rows + other.num_rows)
    assert run((1,), small, small) == 4 and calls == []
    assert run((1,), small, large) == 2 + work.SMALL_GROUP and calls == [1]
    assert run.__code__.co_argcount == 3
