"""Plain versions of the operators, and texts to try them on."""

from __future__ import annotations

import random
import re
from collections import defaultdict

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score int, _part int"


def words(text: str | None) -> list[bytes]:
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())


def made_texts(n: int, seed: int, vocabulary: int = 400) -> list[str]:
    """Random texts, some of them near copies of others, some with a shared passage, some tiny."""
    r = random.Random(seed)
    pool = ["".join(r.choice("abcdeéßñ") for _ in range(r.randint(1, 7))) for _ in range(vocabulary)]
    passage = [r.choice(pool) for _ in range(60)]
    out: list[str] = []
    for i in range(n):
        kind = r.random()
        if out and kind < 0.3:
            own = r.choice(out).split(" ")
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                own[r.randrange(len(own))] = r.choice(pool)
        else:
            own = [r.choice(pool) for _ in range(r.choice([1, 3, 5, 6, 7, 8, 9, 12, 40, 150, 400]))]
            if kind < 0.5:
                at = r.randrange(len(own))
                own[at:at] = passage[: r.choice([15, 20, 25, 60])]
        out.append(r.choice([" ", " ", "\n"]).join(own) if r.random() < 0.1 else " ".join(own))
    return out


def odd_rows(seed: int = 3, n: int = 120) -> list[tuple]:
    """Rows with NULLs everywhere, empty and very long texts, ties, repeated rows; columns with names that operators use."""
    r = random.Random(seed)
    texts = made_texts(n, seed)
    texts += [None, "", " \n\t ", "!!! 123", "x", texts[0], texts[1].upper(), "a " * 100, "né " * 20, "\x00 \x1c \x85"]
    texts.append(" ".join(r.choice(["lorem", "ipsum", "dolor", "sit", str(r.random())]) for _ in range(60_000)))
    rows = [
        (i, t, r.choice(["en", "fr", None]), r.choice(["a", "b", "b", "b", None]), len(t) if t else None, "w", 1, 2)
        for i, t in enumerate(texts)
    ]
    return rows + rows[5:8] + [(None, texts[2], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


def components(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    sets = {}
    for i, t in rows:
        w = [x.lower() for x in words(t)]
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j >= i:
                break
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


def without_repeats(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, list[bytes]]]:
    """(words, words that stay) by id; ids are different."""
    first: dict[tuple, tuple] = {}
    for i, t in sorted(rows):
        w = words(t)
        for j in range(len(w) - 19):
            first.setdefault(tuple(w[j : j + 20]), (i, j))
    out = {}
    for i, t in rows:
        w = words(t)
        gone = set()
        for j in range(len(w) - 19):
            if first[tuple(w[j : j + 20])] != (i, j):
                gone |= set(range(j, j + 20))
        out[i] = (len(w), [x for k, x in enumerate(w) if k not in gone])
    return out


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    t = text or ""
    w = words(t)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    covered = {p + k for v in at.values() if len(v) > 1 for p in v for k in range(8)}
    lines = [x for x in t.split("\n") if words(x)]
    return (
        len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered),
    )


def targets(sizes: dict, weights=(5, 2, 1), most: int = 3) -> dict:
    """Water-filling step by step."""
    keys = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {k: weights[i % len(weights)] for i, k in enumerate(keys)}
    total, out, free = float(sum(sizes.values())), {}, set(keys)
    while free:
        level = (total - sum(out.values())) / sum(weight[k] for k in free)
        above = {k for k in free if level * weight[k] > most * sizes[k]}
        if not above:
            return out | {k: level * weight[k] for k in free}
        out |= {k: float(most * sizes[k]) for k in above}
        free -= above
    return out


def vector_codes(rows: list[tuple[int | None, list[float] | None]]) -> tuple[list[tuple], list[list[list[int]]]]:
    """((vec_id, code, error) of the usable vectors in order of id, codebooks), component by component."""
    from fractions import Fraction
    from math import floor, isfinite

    kept = [(i, v) for i, v in rows if v and all(x is not None and isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    width = len(kept[0][1]) // 8 if kept else 0
    parts = [[[floor(Fraction(x) * 4096) for x in v[p * width : (p + 1) * width]] for p in range(8)] for _, v in kept]
    books = [[parts[e][p] for e in range(min(16, len(kept)))] for p in range(8)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(book))

    for _ in range(6):
        for p in range(8):
            members = defaultdict(list)
            for own in parts:
                members[nearest(own[p], books[p])[1]].append(own[p])
            books[p] = [
                [sum(c) // len(members[e]) for c in zip(*members[e])] if members[e] else entry for e, entry in enumerate(books[p])
            ]
    out = []
    for (i, _), own in zip(kept, parts):
        found = [nearest(own[p], books[p]) for p in range(8)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    return out, books


def spelling_variants(rows: list[tuple[int | None, str | None]]) -> dict[str, tuple]:
    """(form, root, n, n_near, form_n) by word."""
    import zlib

    count: dict[str, int] = defaultdict(int)
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                count[run] += 1
    count = {w: n for w, n in count.items() if n >= 2}

    def near(a: str, b: str) -> bool:
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    of = {w: [v for v in count if near(w, v)] for w in count}
    form = {}
    for w, others in of.items():
        best = min(others, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= 10 * count[w] else None
    out = {}
    for w in count:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, count[w], len(of[w]), count.get(form[w]))
    return out
