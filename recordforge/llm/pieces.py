"""SentencePiece encoding and decoding of BPE models with a table of prefixes.

Merging always takes the pair of neighbours that together make the piece of highest score, and of these the leftmost. The
encoding of a text is then fixed by its neighbours: a sequence of pieces is the encoding if and only if every two neighbours
are compatible, that is, would be left as they are if they were the whole text. So each prefix of a word has exactly one last
piece: among the pieces that end there, which an Aho-Corasick automaton lists in one pass, the one that is compatible with the
last piece of the prefix before it. The table keeps that piece per prefix; the ids follow from it backwards from the end.

Two pieces are compatible if no merge across their border comes before the merges that made them. The test takes merges back,
the latest first, and looks for a piece over the border at every step. Pieces whose score is not unique, or is higher than
that of a half, are outside this argument (runs of spaces, in practice): pairs with one of them are merged in full. Results of
tests are remembered per process.

A text gets a space in front if the model asks for it, and spaces become the sign U+2581. Texts are cut where a sign follows
another character if no piece goes over such a border, and equal words are encoded once per process. Characters without a
piece become the pieces of their UTF-8 bytes. Encoding a text takes time and memory in proportion to its length.

NULL and empty texts have the end id only and decode to an empty text. Built are BPE models with byte fallback and without
normalization, which is all that the parameter file uses; any other model is refused when it is loaded.
"""

from __future__ import annotations

import codecs
import re
import struct
import uuid
from array import array
from collections.abc import Callable, Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from recordforge.llm.work import free_name

SIGN = "▁"  # stands for a space in pieces
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values: types of pieces in model files
UNKNOWN_TEXT = " ⁇ "
CHUNK = 1 << 19  # characters of a text at a time
BATCH = 1 << 20  # characters of the texts of an output batch
LONGEST_KEPT = 64
KEEP_WORDS, KEEP_PAIRS = 200_000, 400_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a message in the wire format of model files."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind, size = key & 7, 0
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


class Model(NamedTuple):
    """Pieces by id with scores and types, whether texts get a space in front, and the end id."""

    pieces: list[str]
    scores: list[float]
    types: list[int]
    space_in_front: bool
    end_id: int


def load(path: str) -> Model:
    with open(path, "rb") as f:
        data = f.read()
    pieces, scores, types, front, end, end_text = [], [], [], True, 2, "</s>"
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            pieces.append(own[1].decode())
            scores.append(struct.unpack("<f", own.get(2, bytes(4)))[0])
            types.append(own.get(3, NORMAL))
        elif number == 2:
            own = dict(_fields(value))
            if own.get(3, 1) != 2 or not own.get(35, 0) or own.get(24, 0):
                raise ValueError("only BPE models with byte fallback and spaces before words are built")
            end, end_text = own.get(42, end), own.get(47, end_text.encode()).decode()
        elif number == 3:
            own = dict(_fields(value))
            front = bool(own.get(3, 1))
            if own.get(2, b"") or own.get(4, 1) or not own.get(5, 1):
                raise ValueError("only models without normalization are built")
    if {USER, UNUSED} & set(types):
        raise ValueError("user-defined and unused pieces are not built")
    return Model(pieces, scores, types, front, pieces.index(end_text) if end_text in pieces else end)


def merge(text: str, score_of: dict[str, float]) -> list[str]:
    """Pieces of a short text by merging pairs one by one."""
    parts = list(text)
    while True:
        best = None
        for i in range(len(parts) - 1):
            score = score_of.get(parts[i] + parts[i + 1])
            if score is not None and (best is None or score > best[0]):
                best = (score, i)
        if best is None:
            return parts
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


class Tables(NamedTuple):
    """What encoding needs, made once on the driver. Tokens are the pieces that encode to themselves, and the single
    characters of pieces that are no pieces; ids of the latter are -1.

    rank: place of the token's merge, -1 for single characters; left, right: the halves it is merged from; odd: to be
    merged in full in tests.
    """

    model: Model
    tokens: list[str]
    ids: list[int]
    rank: list[int]
    left: list[int]
    right: list[int]
    odd: list[bool]
    words_stand_alone: bool


def tabulate(model: Model) -> Tables:
    score_of = {p: s for p, s, t in zip(model.pieces, model.scores, model.types) if t == NORMAL}
    id_of = {p: i for i, (p, t) in enumerate(zip(model.pieces, model.types)) if t == NORMAL}
    tokens = [p for p in score_of if len(p) == 1]
    tokens += sorted({c for p in score_of for c in p} - set(tokens))
    halves: dict[str, tuple[str, str]] = {}
    for p in score_of:
        if len(p) > 1:
            last = merge_halves(p, score_of)
            if last:
                halves[p] = last
                tokens.append(p)
    number = {t: i for i, t in enumerate(tokens)}
    levels = sorted({score_of[p] for p in halves}, reverse=True)
    place = {s: i for i, s in enumerate(levels)}
    rank = [place[score_of[t]] if t in halves else -1 for t in tokens]
    left = [number[halves[t][0]] if t in halves else i for i, t in enumerate(tokens)]
    right = [number[halves[t][1]] if t in halves else i for i, t in enumerate(tokens)]
    holders: dict[int, int] = {}
    for r in rank:
        holders[r] = holders.get(r, 0) + 1
    odd = [r >= 0 and holders[r] > 1 for r in rank]
    changed = True
    while changed:
        changed = False
        for i, r in enumerate(rank):
            wrong = r >= 0 and (max(rank[left[i]], rank[right[i]]) >= r or odd[left[i]] or odd[right[i]])
            if wrong and not odd[i]:
                odd[i] = changed = True
    crossing = any(a != SIGN and b == SIGN for p in score_of for a, b in zip(p, p[1:]))
    return Tables(model, tokens, [id_of.get(t, -1) for t in tokens], rank, left, right, odd, not crossing)


def merge_halves(piece: str, score_of: dict[str, float]) -> tuple[str, str] | None:
    """The two parts whose merge makes the piece, or None if merging does not lead to it."""
    parts = list(piece)
    while len(parts) > 2:
        best = max(range(len(parts) - 1), key=lambda i: (score_of.get(parts[i] + parts[i + 1], -float("inf")), -i))
        if parts[best] + parts[best + 1] not in score_of:
            return None
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts[0], parts[1]


class _Words(dict):
    """Ids by word, as packed 32-bit integers; missing words are encoded. Words that were not asked for since the one but
    last time that the table was full are forgotten."""

    def __init__(self, encode):
        self.encode, self.older = encode, {}

    def __missing__(self, word: str) -> bytes:
        made = self.older.get(word)
        if made is None:
            made = array("i", self.encode(word)).tobytes()
        if len(word) <= LONGEST_KEPT:
            if len(self) >= KEEP_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = made
        return made


class Encoder:
    def __init__(self, tables: Tables):
        self.tables, model = tables, tables.model
        self.number = {t: i for i, t in enumerate(tables.tokens)}
        self.rank_of = {t: r for t, r in zip(tables.tokens, tables.rank) if r >= 0}
        self.score_of = {p: s for p, s, t in zip(model.pieces, model.scores, model.types) if t == NORMAL}
        self.sizes = [len(t) for t in tables.tokens]
        self.byte_ids = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(model.pieces, model.types)) if t == BYTE}
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(tables.tokens):
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.words = _Words(self.encode_word)
        # A word is what stands between two borders that no piece crosses.
        self.word = re.compile(f"{SIGN}*[^{SIGN}]+|{SIGN}+" if tables.words_stand_alone else "(?s).+")
        self.border = re.compile(f"[^{SIGN}](?={SIGN})")

    def compatible(self, a: int, b: int) -> bool:
        """Whether token a followed by token b stays as it is."""
        t = self.tables
        if t.odd[a] or t.odd[b]:
            return merge(t.tokens[a] + t.tokens[b], self.score_of) == [t.tokens[a], t.tokens[b]]
        # What stands at the border before the merges of `until` and later ones, on both sides.
        until_left = until_right = len(t.tokens)
        while True:
            over = self.rank_of.get(t.tokens[a] + t.tokens[b])
            # Merging over the border happens before the next merge on either side; at equal ranks the leftmost is first.
            if over is not None and over < until_left and over <= until_right:
                return False
            if t.rank[a] < 0 and t.rank[b] < 0:
                return True
            if t.rank[a] >= t.rank[b] and t.rank[a] >= 0:
                # With equal ranks the left one was merged first, so the right one is taken back first.
                if t.rank[a] == t.rank[b]:
                    until_right, b = t.rank[b], t.left[b]
                else:
                    until_left, a = t.rank[a], t.right[a]
            else:
                until_right, b = t.rank[b], t.left[b]

    def _tested(self, a: int, b: int, key: int) -> bool:
        if len(self.pairs) >= KEEP_PAIRS:
            self.pairs.clear()
        known = self.pairs[key] = self.compatible(a, b)
        return known

    def last_tokens(self, word: str) -> list[int]:
        """The last token of each prefix of 1, 2, ... characters; -1 after a character that no piece holds."""
        last = [-1] * (len(word) + 1)
        known, sizes, n = self.pairs.get, self.sizes, len(self.sizes)
        for end, token in self.automaton.iter(word):
            end += 1
            if last[end] < 0:
                a = last[end - sizes[token]]
                # Nothing is merged with the start or with a character that no piece holds.
                if a >= 0:
                    key = a * n + token
                    fits = known(key)
                    if fits is None:
                        fits = self._tested(a, token, key)
                    if not fits:
                        continue
                last[end] = token
        return last

    def encode_word(self, word: str) -> list[int]:
        last, out, at = self.last_tokens(word), [], len(word)
        ids, sizes = self.tables.ids, self.sizes
        while at:
            token = last[at]
            if token >= 0 and (i := ids[token]) >= 0:
                out.append(i)
                at -= sizes[token]
            else:
                at -= 1
                out.extend(self.byte_ids[b] for b in reversed(word[at].encode()))
        out.reverse()
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids of a text with the end id, as packed 32-bit integers."""
        out = []
        if text:
            marked = (SIGN if self.tables.model.space_in_front else "") + text.replace(" ", SIGN)
            start = 0
            while start < len(marked):
                end = len(marked)
                if self.tables.words_stand_alone and start + CHUNK < end:
                    found = self.border.search(marked, start + CHUNK)
                    end = found.end() if found else end
                out.append(b"".join(map(self.words.__getitem__, self.word.findall(marked, start, end))))
                start = end
        out.append(array("i", [self.tables.model.end_id]).tobytes())
        return b"".join(out)


class Decoder:
    def __init__(self, model: Model):
        self.front = model.space_in_front
        self.types = model.types
        of = {BYTE: lambda p: bytes([int(p[3:5], 16)]), CONTROL: lambda p: b"", UNKNOWN: lambda p: UNKNOWN_TEXT.encode()}
        self.bytes_of = [of.get(t, lambda p: p.replace(SIGN, " ").encode())(p) for p, t in zip(model.pieces, model.types)]

    def decode(self, ids: array) -> str:
        whole = b"".join(map(self.bytes_of.__getitem__, ids))
        if self.front and whole[:1] == b" ":
            shown = next(i for i in ids if self.types[i] != CONTROL)
            whole = whole[self.types[shown] == NORMAL :]
        try:
            return whole.decode()
        except UnicodeDecodeError:
            return whole.decode("utf-8", "lone_bytes")


def _lone_bytes(error: UnicodeError):
    """Each byte that starts no character becomes one replacement character."""
    return "�", error.start + 1


codecs.register_error("lone_bytes", _lone_bytes)
_held: dict[str, tuple[Encoder, Decoder]] = {}  # of the model in use, once per process


def _coders(key: str, tables: Callable[[], Tables]) -> tuple[Encoder, Decoder]:
    if key not in _held:
        _held.clear()
        made = tables()
        _held[key] = Encoder(made), Decoder(made.model)
    return _held[key]


def encode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """`docs` with `ids` (array of int, the end id last) and `decoded` (text of these ids). `model` is a file on the driver.

    The two columns get a free name if `docs` has them already. The tables are broadcast; their size is the model's.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tabulate(load(model)))
    key = uuid.uuid4().hex
    names = [*docs.columns, free_name(docs, "ids"), free_name(docs, "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _coders(key, lambda: shared.value)
        for b in batches:
            texts = b.column(text)
            lo = 0
            while lo < len(texts):
                packed, decoded, size, hi = [], [], 0, lo
                while hi < len(texts) and size < BATCH:
                    own = encoder.encode(texts[hi].as_py())
                    ids = array("i")
                    ids.frombytes(own)
                    packed.append(own)
                    decoded.append(decoder.decode(ids))
                    size += len(decoded[-1]) + 16
                    hi += 1
                ends = array("i", [0])
                for p in packed:
                    ends.append(ends[-1] + len(p) // 4)
                values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(packed))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                own = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*own.columns, lists, pa.array(decoded, pa.string())], names=names)
                lo = hi

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.mapInArrow(run, ", ".join([*fields, f"`{names[-2]}` array<int>", f"`{names[-1]}` string"]))
