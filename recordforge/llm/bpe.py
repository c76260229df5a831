"""Byte-level BPE encoding and decoding with a lexicon of frequent words.

Texts are cut into words by the rule of the public byte-level tokenizers, in arrays of code points. The most frequent words
of the corpus are encoded once and compiled into a minimal acyclic transducer: an automaton over bytes that shares suffixes
as well as prefixes, whose arcs carry numbers that add up to a word's place in the list of ids. Tasks map it into memory as
flat arrays and follow all different words of a slice through it at once. Words that it lacks are merged exactly, pair by
pair in order of rank, so the lexicon decides about speed only.

The lexicon has at most `lexicon_size` words and is built from counts over all texts. Decoding looks up the bytes of every
id; bytes that are no UTF-8 become replacement characters.

Special tokens that stand in a text are encoded as such. NULL and empty texts have no ids and decode to an empty text.
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import unicodedata
import uuid
from array import array
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple, TypeVar

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from recordforge.llm.textarrays import pieces, span_hashes
from recordforge.llm.work import free_name, give_back_memory, stored

T = TypeVar("T")
LONGEST_IN_LEXICON = 64  # bytes
_END = 0x110000  # stands behind every text; no code point
_SPACE, _LETTER, _NUMBER, _OTHER, _BORDER = range(5)
SHORT = 24  # bytes up to which a word is merged by looking at all its pairs
_ID_BITS, _NONE = 32, 1 << 64
NO_PAIR = (1 << 63) - 1
_KEEP_MERGED = 200_000  # words whose merges a process remembers
_KEEP_COUNTS = 200_000  # words that a task counts before it hands them on
BLOCK = 1 << 20  # characters of a text that are cut at a time
GROUP = 1 << 20  # characters of several texts that are cut at a time
_SOLID = regex.compile(r"[^\s\x1c-\x1f\x85](?= )")


@lru_cache(1)
def kinds_of_points() -> np.ndarray:
    """Kind of every code point as the tokenizers library sees it, and of the border.

    Two Unicode tables are at hand, one older and one newer than the library's. Where they agree, it does too; it is asked
    about the code points that were assigned in between.
    """
    kinds = np.full(_END + 1, _OTHER, np.uint8)
    newer = np.full(_END, _OTHER, np.uint8)
    points = [c for c in range(_END) if not 0xD800 <= c < 0xE000]
    of = {"L": _LETTER, "N": _NUMBER, "Z": _SPACE}
    for c in points:
        kinds[c] = of.get(unicodedata.category(chr(c))[0], _OTHER)
    kinds[[9, 10, 11, 12, 13, 0x85]] = _SPACE
    everything = "".join(map(chr, points))
    for kind, pattern in ((_SPACE, r"\p{White_Space}"), (_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}")):
        newer[[ord(c) for c in regex.findall(pattern, everything)]] = kind
    open_points = np.flatnonzero(kinds[:_END] != newer)
    kinds[open_points] = _OTHER
    cutter = ByteLevel(add_prefix_space=False, use_regex=True)
    for head, kind in (("a", _LETTER), ("1", _NUMBER)):
        for _, (start, end) in cutter.pre_tokenize_str("".join(f"{head}{chr(c)}\n" for c in open_points)):
            if end - start > 1 and start % 3 == 0:
                kinds[open_points[start // 3]] = kind
    kinds[_END] = _BORDER
    return kinds


def byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in vocabulary files: itself if printable, else the next free one."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Merges and ids of a byte-level tokenizer file."""

    def __init__(self, spec: dict):
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        split_by_rule = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if spec["normalizer"] or not split_by_rule or model["type"] != "BPE" or not plain:
            raise ValueError("only plain byte-level BPE is built")
        signs, vocab = byte_signs(), model["vocab"]
        self.byte_id = [-1] * 256
        for sign, b in signs.items():
            self.byte_id[b] = vocab[sign]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = rank, vocab[a + b]
        # Both ids of a pair as one number, and its rank and new id as one.
        self.ranked = {a << _ID_BITS | b: rank << _ID_BITS | new for (a, b), (rank, new) in self.merges.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(signs[s] for s in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()

    def merge(self, word: bytes) -> list[int]:
        """Ids of a word: the pair of least rank, and of these the leftmost, is merged until none is left."""
        ids = [self.byte_id[b] for b in word]
        if len(ids) > SHORT:
            return self._merge_long(ids)
        find = self.ranked.get
        found = [find(a << _ID_BITS | b, _NONE) for a, b in zip(ids, ids[1:])]
        while found and (best := min(found)) < _NONE:
            i = found.index(best)
            ids[i] = best & (1 << _ID_BITS) - 1
            del ids[i + 1], found[i]
            if i < len(found):
                found[i] = find(ids[i] << _ID_BITS | ids[i + 1], _NONE)
            if i:
                found[i - 1] = find(ids[i - 1] << _ID_BITS | ids[i], _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs and links between neighbours, for words of any length."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*self.merges[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merges]
        heap = [(rank, i, ids[i], ids[i + 1], new) for rank, new, i in heap]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue  # one of the two is gone
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                m = after[k] if k >= 0 else n
                if m < n and (found := self.merges.get((ids[k], ids[m]))):
                    heapq.heappush(heap, (found[0], k, ids[k], ids[m], found[1]))
        return [i for i in ids if i >= 0]


class PairTable:
    """Ranks of pairs of ids in arrays: an open table in which a pair stands at its hash or just behind."""

    BITS = 20

    def __init__(self, ranked: dict[int, int]):
        keys = np.array(list(ranked), np.int64)
        size = 1 << self.BITS
        if 4 * len(keys) > size:
            raise ValueError("more merges than the table of pairs holds")
        self.keys, self.values = np.full(size + 64, -1, np.int64), np.full(size + 64, NO_PAIR, np.int64)
        self.longest = 0
        for at, key, value in zip(self._home(keys).tolist(), keys.tolist(), ranked.values()):
            k = at
            while self.keys[k] >= 0:
                k += 1
            self.longest = max(self.longest, k - at)
            self.keys[k], self.values[k] = key, value

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank and new id of each pair as one number, NO_PAIR for pairs that are not merged or hold no id."""
        keys = a.astype(np.int64) << _ID_BITS | b
        home = self._home(keys)
        out = np.where(self.keys[home] == keys, self.values[home], NO_PAIR)
        open_ones = np.flatnonzero((self.keys[home] != keys) & (self.keys[home] >= 0))
        for step in range(1, self.longest + 1):
            if not len(open_ones):
                break
            at = home[open_ones] + step
            hit = self.keys[at] == keys[open_ones]
            out[open_ones[hit]] = self.values[at[hit]]
            open_ones = open_ones[~hit & (self.keys[at] >= 0)]
        out[(a < 0) | (b < 0)] = NO_PAIR
        return out

    def merge(self, words: list[bytes], byte_id: np.ndarray) -> list[bytes]:
        """Packed ids of short words: in every round each word has its pair of least rank, and of these the leftmost, merged."""
        n, width = len(words), max(map(len, words))
        data = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        ids = byte_id[data]
        ids[np.arange(width) >= np.array([len(w) for w in words])[:, None]] = -1
        ids = np.concatenate([ids, np.full((n, 1), -1, np.int32)], 1)  # a border for shifts
        ranks = self.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width)
        done = np.empty((n, width), np.int32)
        rows = np.arange(n)
        place = np.arange(width)
        while len(rows):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            live = best < NO_PAIR
            done[rows[~live]] = ids[~live, :-1]
            rows, ids, ranks, at, best = rows[live], ids[live], ranks[live], at[live], best[live]
            if not len(rows):
                break
            own = np.arange(len(rows))
            ids[own, at] = best & (1 << _ID_BITS) - 1
            shift = place[None, :] + (place[None, :] > at[:, None])
            ids[:, :-1] = np.take_along_axis(ids, shift, 1)
            shift = np.minimum(shift, width - 1)
            ranks = np.take_along_axis(ranks, shift, 1)
            ranks[own, at] = self.find(ids[own, at], ids[own, at + 1])
            ranks[:, -1] = NO_PAIR
            left = np.maximum(at - 1, 0)
            before = at > 0
            ranks[own[before], left[before]] = self.find(ids[own, left], ids[own, at])[before]
        count = ((done >= 0).sum(1) * 4).tolist()
        packed, step = done.tobytes(), 4 * width
        return [packed[i * step : i * step + c] for i, c in enumerate(count)]


class Lexicon(NamedTuple):
    """A minimal acyclic transducer in flat arrays.

    arcs: state * 256 + byte, sorted; targets: the next state; adds: what the arc adds to the word's place; final: whether a
    word ends in the state; at, ids: the ids of the word in place i are ids[at[i]:at[i + 1]].
    """

    arcs: np.ndarray
    targets: np.ndarray
    adds: np.ndarray
    final: np.ndarray
    at: np.ndarray
    ids: np.ndarray

    def pack(self) -> bytes:
        sizes = np.array([len(a) for a in self], np.int64)
        return b"".join([sizes.tobytes(), *(a.astype(np.int64).tobytes() for a in self)])

    @staticmethod
    def mapped(packed: bytes) -> Lexicon:
        """The arrays as views of a memory map that no folder holds."""
        file = os.memfd_create("lexicon")
        with os.fdopen(file, "w+b") as f:
            f.write(packed)
            f.flush()
            view = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n = len(Lexicon._fields)
        whole = np.frombuffer(view, np.int64)
        cuts = n + np.concatenate([[0], np.cumsum(whole[:n])])
        return Lexicon(*(whole[a:b] for a, b in zip(cuts, cuts[1:])))

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Place of each word data[start:end], or -1; all words take one step at a time."""
        place, state = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        live = np.arange(len(starts)) if len(self.arcs) else np.zeros(0, np.int64)
        out = np.full(len(starts), -1)
        step = 0
        while len(live):
            done = starts[live] + step == ends[live]
            over = live[done]
            out[over] = np.where(self.final[state[over]] > 0, place[over], -1)
            live = live[~done]
            key = state[live] * 256 + data[starts[live] + step]
            at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            good = self.arcs[at] == key
            live, at = live[good], at[good]
            place[live] += self.adds[at]
            state[live] = self.targets[at]
            step += 1
        return out


def compile_lexicon(words: dict[bytes, Sequence[int]]) -> Lexicon:
    """Add words in order; states that can no longer change are replaced by an equal one that exists."""
    known: dict[tuple, int] = {}
    frozen: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    path: list[list] = [[False, []]]  # of the last word: [final, arcs]; the last arc of each leads to the next

    def freeze(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs = path.pop()
            key = (final, tuple(arcs))
            if key not in known:
                known[key] = len(frozen)
                frozen.append(key)
            path[-1][1][-1] = (path[-1][1][-1][0], known[key])

    last = b""
    listed = sorted(w for w in words if w)
    for word in listed:
        common = len(os.path.commonprefix([last, word]))
        freeze(common)
        for b in word[common:]:
            path[-1][1].append((b, -1))
            path.append([False, []])
        path[-1][0] = True
        last = word
    freeze(0)
    frozen.append((path[0][0], tuple(path[0][1])))
    # The start comes first; a state's words are counted after those of its targets, which have smaller numbers.
    n = len(frozen)
    number = {old: n - 1 - old for old in range(n)}
    words_below = [0] * n
    arcs, targets, adds, final = [], [], [], [False] * n
    for old, (ends, out) in enumerate(frozen):
        seen = int(ends)
        final[number[old]] = ends
        for b, to in out:
            arcs.append(number[old] * 256 + b)
            targets.append(number[to])
            adds.append(seen)
            seen += words_below[to]
        words_below[old] = seen
    order = np.argsort(np.array(arcs, np.int64))
    ids = [words[w] for w in listed]
    pick = lambda x: np.array(x, np.int64)[order]
    return Lexicon(
        pick(arcs), pick(targets), pick(adds), np.array(final, np.int64),
        np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int64),
        np.array([x for i in ids for x in i], np.int64),
    )


class Cut(NamedTuple):
    """The words of some texts: the different ones as bytes, and for each word in order which it is and in which text."""

    different: list[bytes]
    which: np.ndarray
    text: np.ndarray


def cut_words(texts: list[str], kinds: np.ndarray) -> Cut:
    """Cut texts where the public pattern does: contractions, letters, numbers, other signs, each with one space before it,
    and white space."""
    border = _END.to_bytes(4, "little")
    points = np.frombuffer(border + b"".join(t.encode("utf-32-le") + border for t in texts), np.uint32)
    kind = kinds[points]
    n = len(points)
    new = np.ones(n, bool)
    new[1:] = kind[1:] != kind[:-1]
    solid = (kind != _SPACE) & (kind != _BORDER)
    blank = points == 32
    starts = new.copy()
    starts[1:] &= ~(solid[1:] & blank[:-1])  # takes the space before it
    starts[:-1] |= (kind[:-1] == _SPACE) & solid[1:]  # the last of several spaces stands apart, or goes with what follows
    quotes = np.flatnonzero((points == 39) & starts & (kind == _OTHER))
    quotes = quotes[kind[quotes + 1] == _LETTER]
    one, two = points[quotes + 1], points[np.minimum(quotes + 2, n - 1)]
    single = np.isin(one, [ord(c) for c in "stmd"])
    double = np.zeros(len(quotes), bool)
    for a, b in ("re", "ve", "ll"):
        double |= (one == ord(a)) & (two == ord(b))
    for found, size in ((quotes[single], 2), (quotes[double], 3)):
        starts[found + 1] = False
        starts[found + size] = True
    at = np.flatnonzero(starts)
    ends = np.append(at[1:], n)
    inside = kind[at] != _BORDER
    at, ends = at[inside], ends[inside]
    text = np.cumsum(kind == _BORDER)[at] - 1
    _, first, which = np.unique(span_hashes(points, at, ends), return_index=True, return_inverse=True)
    whole = points.astype("<u4").tobytes()
    different = [whole[4 * a : 4 * b].decode("utf-32-le").encode() for a, b in zip(at[first].tolist(), ends[first].tolist())]
    return Cut(different, which, text)


def blocks(text: str) -> Iterator[str]:
    """A text in parts of about BLOCK characters. Words hold a space only at their start, so it may be cut before a space
    that follows a solid character."""
    start = 0
    while start < len(text):
        found = _SOLID.search(text, start + BLOCK) if start + BLOCK < len(text) else None
        end = found.end() if found else len(text)
        yield text[start:end]
        start = end


def grouped(parts: Iterator[T], size: Callable[[T], int]) -> Iterator[list[T]]:
    """Parts in order, in groups of about GROUP characters."""
    group, total = [], 0
    for part in parts:
        group.append(part)
        total += size(part)
        if total >= GROUP:
            yield group
            group, total = [], 0
    if group:
        yield group


def _segments(text: str, special: regex.Pattern | None) -> list[str]:
    """Texts between special tokens, and the tokens: at odd places."""
    return special.split(text) if special and special.search(text) else [text]


class Encoder:
    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon, kinds: np.ndarray):
        self.vocabulary, self.lexicon, self.kinds = vocabulary, lexicon, kinds
        names = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.pairs, self.byte_id = PairTable(vocabulary.ranked), np.array(vocabulary.byte_id, np.int32)
        self.merged: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and the number of each."""
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words]).astype(np.int64) if words else np.zeros(0, np.int64)
        starts = np.append(0, ends[:-1])[: len(ends)]
        place = self.lexicon.find(data, starts, ends)
        unseen = np.flatnonzero(place < 0).tolist()
        made = self._merged([words[i] for i in unseen])
        # Unseen words take places behind the lexicon's.
        base = len(self.lexicon.at) - 1
        place[unseen] = base + np.arange(len(unseen))
        at = np.concatenate([self.lexicon.at, self.lexicon.at[-1] + np.cumsum([len(m) // 4 for m in made])]).astype(np.int64)
        ids = np.concatenate([self.lexicon.ids, np.frombuffer(b"".join(made), np.int32)])
        return _gather(ids, at[place], at[place + 1])

    def _merged(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of words that the lexicon lacks. Words are remembered until the memory was full twice since they were
        last asked for."""
        missing: dict[int, list[bytes]] = {}
        for w in words:
            if w not in self.merged:
                if w in self.older:
                    self.merged[w] = self.older[w]
                else:
                    missing.setdefault(min(-(-len(w) // 6), 5), []).append(w)
        for size, own in missing.items():
            if size * 6 <= SHORT:
                found = self.pairs.merge(own, self.byte_id)
            else:
                found = [array("i", self.vocabulary.merge(w)).tobytes() for w in own]
            self.merged.update(zip(own, found))
        made = [self.merged[w] for w in words]
        if len(self.merged) > _KEEP_MERGED:
            self.older, self.merged = self.merged, {}
        return made

    def _parts(self, texts: list[str | None]) -> Iterator[tuple[int, str, int]]:
        """(text, part of it, -1 or special id) in order."""
        for i, t in enumerate(texts):
            for k, segment in enumerate(_segments(t or "", self.special)):
                if k % 2:
                    yield i, "", self.vocabulary.special[segment]
                else:
                    yield from ((i, part, -1) for part in blocks(segment))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of each."""
        out, total = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        for group in grouped(self._parts(texts), lambda p: len(p[1])):
            owner, parts, special = zip(*group)
            cut = cut_words(parts, self.kinds)
            ids, count = self._ids(cut.different)
            starts = np.cumsum(count) - count
            ids, _ = _gather(ids, starts[cut.which], (starts + count)[cut.which])
            per_part = np.bincount(cut.text, weights=count[cut.which], minlength=len(parts)).astype(np.int64)
            marks = np.array(special)
            if (marks >= 0).any():
                ids = np.insert(ids, np.cumsum(per_part)[marks >= 0], marks[marks >= 0])
                per_part += marks >= 0
            np.add.at(total, np.array(owner), per_part)
            out.append(ids.astype(np.int32))
        return np.concatenate(out), total


def _gather(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[start:end] of all spans, one after the other, and their lengths."""
    count = ends - starts
    total = int(count.sum())
    shift = np.repeat(starts - (np.cumsum(count) - count), count)
    return values[shift + np.arange(total)], count


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        self.data = np.frombuffer(b"".join(vocabulary.bytes_of), np.uint8)
        self.ends = np.cumsum([len(b) for b in vocabulary.bytes_of])
        self.starts = self.ends - [len(b) for b in vocabulary.bytes_of]

    def decode(self, ids: np.ndarray, count: np.ndarray) -> list[str]:
        data, sizes = _gather(self.data, self.starts[ids], self.ends[ids])
        sums = np.concatenate([[0], np.cumsum(sizes)])
        cuts = sums[np.concatenate([[0], np.cumsum(count)])].tolist()
        whole = data.tobytes()
        return [whole[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]


_held: dict[str, tuple[Encoder, Decoder]] = {}  # of the file in use, once per process


def _coders(key: str, parts: Callable[[], tuple]) -> tuple[Encoder, Decoder]:
    if key not in _held:
        _held.clear()
        spec, packed, kinds = parts()
        vocabulary = Vocabulary(spec)
        _held[key] = Encoder(vocabulary, Lexicon.mapped(packed), kinds), Decoder(vocabulary)
    return _held[key]


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def frequent_words(docs: DataFrame, text: str, most: int) -> list[bytes]:
    """The most frequent words of all texts, at most `most`."""
    shared = docs.sparkSession.sparkContext.broadcast(kinds_of_points())

    def batch(counts: dict[bytes, int]) -> pa.RecordBatch:
        columns = [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["w", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        parts = (part for b in batches for t in b.column(0) for part in blocks(t.as_py() or ""))
        for group in grouped(parts, len):
            cut = cut_words(group, shared.value)
            n = np.bincount(cut.which, minlength=len(cut.different)).tolist()
            for w, k in zip(cut.different, n):
                if len(w) <= LONGEST_IN_LEXICON:
                    counts[w] = counts.get(w, 0) + k
            if len(counts) >= _KEEP_COUNTS:
                yield batch(counts)
                counts.clear()
        yield batch(counts)
        counts.clear()
        give_back_memory()

    counted = docs.select(text).mapInArrow(count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))
    # Steps of an eighth of a power of two: few, and whole steps are taken, so only what is wanted comes to the driver.
    stepped = stored(counted.withColumn("step", F.floor(F.log2("n") * 8).cast("int")), "bpe-words")
    sizes = sorted(((r["step"], r["count"]) for r in stepped.groupBy("step").count().collect()), reverse=True)
    least, total = None, 0
    for step, n in sizes:
        total += n
        if total > most:
            break
        least = step
    if least is None:
        return []
    return [bytes(r["w"]) for r in stepped.filter(F.col("step") >= least).select("w").collect()]


def encode(docs: DataFrame, tokenizer: str, text: str = "text", lexicon_size: int = 65_536) -> DataFrame:
    """`docs` with `ids` (array of int) and `decoded` (text of these ids). `tokenizer` is a file on the driver."""
    spec = load(tokenizer)
    vocabulary = Vocabulary(spec)
    words = frequent_words(docs, text, lexicon_size)
    lexicon = compile_lexicon({w: vocabulary.merge(w) for w in words})
    shared = docs.sparkSession.sparkContext.broadcast((spec, lexicon.pack(), kinds_of_points()))  # both of bounded size

    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _coders(key, lambda: shared.value)
        for b in batches:
            texts = b.column(text).to_pylist()
            for lo, hi in pieces(texts):
                ids, count = encoder.encode(texts[lo:hi])
                ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
                decoded = pa.array(decoder.decode(ids, count), pa.string())
                own = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*own.columns, lists, decoded], names=names)
        give_back_memory()

    names = [*docs.columns, free_name(docs, "ids"), free_name(docs, "decoded")]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.mapInArrow(run, ", ".join([*fields, f"{names[-2]} array<int>", f"{names[-1]} string"]))
