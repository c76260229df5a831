"""Removal of repeated passages with phrase automata.

A passage repeats if 20 consecutive words also start earlier: in a document of smaller id, or earlier in the same one. All
words under such a window go; windows are judged on the input.

1. Confirm. Every 20-word window is represented by the smallest hash among its 8-word phrases, so equal windows have equal
   representatives, and about one phrase in seven is one. Counting representatives over all documents gives the phrases
   that recur.
2. Compile and stream. Documents are dealt over parts of bounded size. Each part compiles the recurring phrases that its
   documents hold into one Aho-Corasick automaton over numbered words, and streams all its documents through it. Every
   occurrence of a phrase gives the windows that it represents; per part each different window is kept once, with its first
   place.
3. Judge. For each window the first place over all parts and the number of places are found; parts learn which of their
   windows start earlier, and remove what these cover.

The number of parts grows with the input, so an automaton's size does not; documents are never sent to automata that cannot
match. What moves are packed arrays and compressed slices of rows, dealt by hash: a passage held by a third of all documents
is one entry per part.

NULL texts have no words. Texts under 20 words stay whole. Rows with the same doc_id count as one document that is there
several times, so they do not empty each other; NULL ids sort last, as one document. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordforge.llm.textarrays import Words, pieces, sized_pieces, split, window_hashes, word_hashes
from recordforge.llm.work import free_name, tidy, tidy_group

WINDOW = 20
PHRASE = 8
PART_BYTES = 2 << 20
STARTS = 1 << 14  # phrases whose windows are looked at together
_SIGNS = 64
_INSIDE = WINDOW - PHRASE + 1  # phrases in a window
_LAST = np.iinfo(np.int64).max


def _sliding(x: np.ndarray, width: int, pick: Callable) -> np.ndarray:
    """`pick` (minimum or maximum) over every `width` consecutive values."""
    span = 1
    while span * 2 <= width:
        x = pick(x[:-span], x[span:]) if len(x) > span else x[:0]
        span *= 2
    rest = width - span
    return pick(x[:-rest], x[rest:]) if rest and len(x) > rest else x if not rest else x[:0]


class Places:
    """Phrase hashes of a slice of documents, and which phrases represent which windows."""

    def __init__(self, words: Words):
        self.words, self.hashes = words, word_hashes(words)
        n = len(self.hashes)
        self.phrases = window_hashes(self.hashes, PHRASE) | np.uint64(1)  # never 0
        self.valid = np.zeros(max(0, n - WINDOW + 1), bool)
        doc_end = np.repeat(words.first[1:], np.diff(words.first))
        self.valid[:] = np.arange(len(self.valid)) + WINDOW <= doc_end[: len(self.valid)]
        self.least = _sliding(self.phrases, _INSIDE, np.minimum)[: len(self.valid)]
        self.least[~self.valid] = 0
        # A phrase represents a window if it is the largest of the least values over it.
        padded = np.concatenate([np.zeros(_INSIDE - 1, np.uint64), self.least, np.zeros(_INSIDE - 1, np.uint64)])
        most = _sliding(padded, _INSIDE, np.maximum)
        self.represents = most == self.phrases if len(self.least) else np.zeros(len(self.phrases), bool)


def _bin(x: np.ndarray, bins: int) -> np.ndarray:
    return ((x >> np.uint64(40)) % np.uint64(bins)).astype(np.int64)


def _keys(x: np.ndarray, bins: int) -> np.ndarray:
    """What is left of a hash after it was dealt into bins and packed into four bytes."""
    return (_bin(x, bins) << 32) | (x & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _by_group(groups: np.ndarray, arrays: dict[str, np.ndarray], key: str = "bin") -> pa.RecordBatch | None:
    """One row per group with the packed values of each array."""
    order = np.argsort(groups, kind="stable")
    found, at = np.unique(groups[order], return_index=True)
    ends = np.append(at, len(groups))
    sorted_arrays = {k: a[order] for k, a in arrays.items()}
    return pa.RecordBatch.from_arrays(
        [pa.array(found, pa.int64())]
        + [pa.array([a[s:e].tobytes() for s, e in zip(ends, ends[1:])], pa.binary()) for a in sorted_arrays.values()],
        names=[key, *arrays],
    )


def _column(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _texts(table: pa.Table | pa.RecordBatch, name: str) -> list[bytes | None]:
    return table.column(name).cast(pa.binary()).to_pylist()


def _pieces(b: pa.RecordBatch, text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `most` bytes of text each, so that its texts are never copied all at once."""
    sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_pylist()
    for lo, hi in sized_pieces(sizes, most):
        yield b.slice(lo, hi - lo)


def _recurring(rows: DataFrame, parts: int, bins: int, part: str, text: str) -> DataFrame:
    """(part, keys): for each part the packed keys of its phrases that recur anywhere."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in _pieces(b, text):
                words, own = split(_texts(piece, text)), piece.column(part).to_numpy()
                p = Places(words)
                at = np.flatnonzero(p.represents)
                if len(at):
                    doc = np.searchsorted(words.first, at, "right") - 1
                    low = (p.phrases[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                    yield _by_group(_bin(p.phrases[at], bins), {"keys": low, "parts": own[doc].astype(np.uint32)})

    def confirm(table: pa.Table) -> pa.Table:
        keys, where = _column(table, "keys", np.uint32), _column(table, "parts", np.uint32)
        both = (keys.astype(np.uint64) << np.uint64(32)) | where
        both.sort()
        keys = (both >> np.uint64(32)).astype(np.int64)
        again = np.zeros(len(keys), bool)
        again[1:] = keys[1:] == keys[:-1]
        again[:-1] |= again[1:]
        both = np.unique(both[again])
        base = table.column("bin")[0].as_py() << 32
        found = (both >> np.uint64(32)).astype(np.int64) + base
        out = _by_group((both & np.uint64(0xFFFFFFFF)).astype(np.int64), {"keys": found}, "part")
        return pa.Table.from_batches([out])

    packed = rows.select(part, text).mapInArrow(tidy(pack), "bin long, keys binary, parts binary")
    return packed.groupBy("bin").applyInArrow(tidy_group(confirm), "part long, keys binary")


def _slices(rows: DataFrame, part: str, text: str) -> DataFrame:
    """(part, rows): compressed slices of the rows of each part."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for b in batches:
            for own in _pieces(b, text, 8 << 20):
                groups = own.column(part).to_numpy()
                order = np.argsort(groups, kind="stable")
                found, at = np.unique(groups[order], return_index=True)
                ends = np.append(at, len(groups))
                blobs = []
                for s, e in zip(ends, ends[1:]):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, own.schema, options=options) as out:
                        out.write_batch(own.take(pa.array(order[s:e])))
                    blobs.append(sink.getvalue().to_pybytes())
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(blobs, pa.binary())], names=["part", "rows"])

    return rows.mapInArrow(tidy(pack), "part long, rows binary")


def _unpacked(table: pa.Table) -> pa.Table | None:
    read = [pa.ipc.open_stream(blob).read_all() for blob in table.column("rows").to_pylist()]
    return pa.concat_tables(read) if read else None


def _ids(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).fill_null(_LAST).to_numpy().astype(np.int64)


def _spelled(hashes: np.ndarray) -> tuple[str, int]:
    """Every word as a few signs of a small alphabet, for an automaton looks through a state's arcs one by one."""
    different, numbers = np.unique(hashes, return_inverse=True)
    width = 1
    while _SIGNS**width < len(different):
        width += 1
    digits = numbers[:, None] // _SIGNS ** np.arange(width)[::-1] % _SIGNS
    return (digits + 48).astype(np.uint8).tobytes().decode("latin-1"), width


def _located(p: Places, keys: np.ndarray, bins: int) -> np.ndarray:
    """Starts of all windows that a recurring phrase represents, found by the part's automaton."""
    confirmed = np.flatnonzero(p.represents)
    if not len(confirmed) or not len(keys):
        return confirmed[:0]
    own = _keys(p.phrases[confirmed], bins)
    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
    confirmed = confirmed[keys[at] == own]
    if not len(confirmed):
        return confirmed
    _, first = np.unique(p.phrases[confirmed], return_index=True)
    spelled, width = _spelled(p.hashes)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for start in confirmed[first].tolist():
        automaton.add_word(spelled[start * width : (start + PHRASE) * width], start)
    automaton.make_automaton()
    ends = []
    for d in range(len(p.words.first) - 1):
        own = p.words.of(d)
        if own.stop - own.start >= WINDOW:
            base = own.start * width + 1
            ends += [base + end for end, _ in automaton.iter(spelled[own.start * width : own.stop * width])]
    found = np.array(ends, np.int64)
    starts = found[found % width == 0] // width - PHRASE  # matches between two words are none
    found = [starts[:0]]
    for lo in range(0, len(starts), STARTS):
        own = starts[lo : lo + STARTS]
        windows = (own[:, None] - np.arange(_INSIDE)).ravel()
        phrases = np.repeat(p.phrases[own], _INSIDE)
        inside = (windows >= 0) & (windows < len(p.least))
        windows, phrases = windows[inside], phrases[inside]
        found.append(np.unique(windows[p.least[windows] == phrases]))
    return np.unique(np.concatenate(found))


def _windows(slices: DataFrame, phrases: DataFrame, bins: int, window_bins: int, doc_id: str, text: str) -> DataFrame:
    """(bin, part, hashes, docs, places, many): every different window of a part that may recur, with its first place."""

    def locate(key: tuple, own: pa.Table, confirmed: pa.Table) -> pa.Table:
        names = ["bin", "part", "hashes", "docs", "places", "many"]
        nothing = pa.table({n: pa.array([], pa.int64() if i < 2 else pa.binary()) for i, n in enumerate(names)})
        table = _unpacked(own)
        if table is None:
            return nothing
        words = split(_texts(table, text))
        p = Places(words)
        at = _located(p, np.sort(_column(confirmed, "keys", np.int64)), bins)
        if not len(at):
            return nothing
        doc = np.searchsorted(words.first, at, "right") - 1
        places, docs = at - words.first[doc], _ids(table, doc_id)[doc]
        hashes = window_hashes(p.hashes, WINDOW)[at]
        order = np.lexsort((places, docs, hashes))
        hashes, docs, places = hashes[order], docs[order], places[order]
        new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
        at = np.flatnonzero(new)
        # Several places: not only the same place of rows with the same id.
        last = np.append(at[1:], len(hashes)) - 1
        many = (docs[last] != docs[at]) | (places[last] != places[at])
        out = _by_group(
            _bin(hashes[at], window_bins),
            {"hashes": hashes[at], "docs": docs[at], "places": places[at].astype(np.uint32), "many": many.astype(np.uint8)},
        )
        whole = pa.Table.from_batches([out])
        return whole.add_column(1, "part", pa.array([key[0].as_py()] * out.num_rows, pa.int64()))

    schema = "bin long, part long, hashes binary, docs binary, places binary, many binary"
    return slices.groupBy("part").cogroup(phrases.groupBy("part")).applyInArrow(tidy_group(locate), schema)


def _first_places(windows: DataFrame) -> DataFrame:
    """(part, hashes, docs, places): for each part its windows with a later place, and their first places."""

    def judge(table: pa.Table) -> pa.Table:
        hashes, docs = _column(table, "hashes", np.uint64), _column(table, "docs", np.int64)
        places, many = _column(table, "places", np.uint32), _column(table, "many", np.uint8)
        part = np.repeat(table.column("part").to_numpy(), [len(m) for m in table.column("many").to_pylist()])
        order = np.lexsort((places, docs, hashes))
        hashes, docs, places, many, part = hashes[order], docs[order], places[order], many[order], part[order]
        at = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        first = np.repeat(at, np.diff(np.append(at, len(hashes))))
        later = (docs != docs[first]) | (places != places[first]) | (many > 0)
        out = _by_group(part[later], {"hashes": hashes[later], "docs": docs[first][later], "places": places[first][later]}, "part")
        return pa.Table.from_batches([out])

    return windows.groupBy("bin").applyInArrow(tidy_group(judge), "part long, hashes binary, docs binary, places binary")


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES
) -> DataFrame:
    """`docs` with `n_words` and `n_removed`, and the text cut to the words that stay.

    A text from which words go is its remaining words joined by one space; others are unchanged.
    """
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(64, -(-total // part_bytes))
    bins = max(64, total // (32 << 20))
    part = free_name(docs, "_part")
    rows = docs.withColumn(part, F.pmod(F.xxhash64(doc_id, F.octet_length(text)), F.lit(parts)))
    confirmed = _recurring(rows, parts, bins, part, text)
    places = _first_places(_windows(_slices(rows.select(part, doc_id, text), part, text), confirmed, bins, bins, doc_id, text))
    columns = list(docs.columns)
    counted = [free_name(docs, "n_words"), free_name(docs, "n_removed")]

    def cut(own: pa.Table, found: pa.Table) -> pa.Table:
        table = _unpacked(own)
        if table is None:
            raise AssertionError("windows of a part without documents")
        texts, ids = _texts(table, text), _ids(table, doc_id)
        hashes = _column(found, "hashes", np.uint64)
        order = np.argsort(hashes)
        hashes, docs_, places_ = hashes[order], _column(found, "docs", np.int64)[order], _column(found, "places", np.uint32)[order]
        n_words, n_removed, out = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), list(texts)
        for lo, hi in pieces(texts):
            words = split(texts[lo:hi])
            n_words[lo:hi] = np.diff(words.first)
            p = Places(words)
            at = np.flatnonzero(p.valid)
            if not len(at) or not len(hashes):
                continue
            own_hashes = window_hashes(p.hashes, WINDOW)[at]
            k = np.minimum(np.searchsorted(hashes, own_hashes), len(hashes) - 1)
            hit = hashes[k] == own_hashes
            at, k = at[hit], k[hit]
            doc = np.searchsorted(words.first, at, "right") - 1
            later = (ids[lo + doc] != docs_[k]) | (at - words.first[doc] != places_[k])
            change = np.zeros(len(p.hashes) + 1, np.int64)
            np.add.at(change, at[later], 1)
            np.add.at(change, at[later] + WINDOW, -1)
            gone = np.cumsum(change[:-1]) > 0
            removed = np.add.reduceat(np.append(gone, False), np.minimum(words.first[:-1], len(gone)), dtype=np.int64)
            removed[words.first[:-1] == words.first[1:]] = 0
            n_removed[lo:hi] = removed
            for d in np.flatnonzero(removed):
                pick = np.flatnonzero(~gone[words.of(d)]) + words.first[d]
                data, base = texts[lo + d], words.text_starts[d]
                out[lo + d] = b" ".join(
                    data[s:e] for s, e in zip((words.starts[pick] - base).tolist(), (words.ends[pick] - base).tolist())
                )
        cells = [
            pa.chunked_array([pa.array(out, pa.binary()).cast(pa.string())]) if c == text else table.column(c) for c in columns
        ]
        return pa.table([*cells, pa.array(n_words), pa.array(n_removed)], names=[*columns, *counted])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    slices = _slices(rows, part, text)
    result = ", ".join([*fields, *(f"{c} long" for c in counted)])
    return slices.groupBy("part").cogroup(places.groupBy("part")).applyInArrow(tidy_group(cut), result)
