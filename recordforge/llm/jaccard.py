"""Near-duplicate texts: a Jaccard join over word shingles with prefixes of token combinations.

Tokens are 64-bit hashes of five lower-cased words. If two sets are similar, each misses few tokens of the other, so a short
prefix in one global token order must hit the other's. The order is rare tokens first. Rare tokens are signatures by
themselves. Frequent tokens would give long lists, so they are signatures only in combination: pairs of the second class,
triples of the third, each inside small subgroups of the class. A combination is lost with a single token, so the prefix is
extended until the tokens that may be missing cannot break all combinations: with c tokens in a subgroup of class k, k - 1
of them protect nothing, and the prefix must hold

    sum over subgroups of max(0, c - (k - 1))  >=  size - needed overlap + 1.

The number of subgroups follows the set's size; sizes are cut into bands in ratio 4/3, so similar sets lie in the same or in
neighbouring bands, and a set writes combinations for its own band and the next. Sets of 3 to 5 tokens, where combinations
cannot be protected, link only if one is the other plus a token, and write all sets with one token left out.

Texts with equal sets are one node from the start. Nodes that share a signature form a list; nodes that fit no other node of
the list by size and by number of tokens held elsewhere leave it. Lists with the same leader, the node that fits the largest
partners, become one circle: copies of one text share many signatures, and so meet once instead of once per list.

Links are only needed up to components, so circles are not expanded into pairs. First every node is compared with one leader.
Circles that still span several components are then settled as a whole: each gets the token sets of its nodes, counts what
its nodes share by products of incidence matrices, and hands on only links that join two components, which are fewer than
its nodes. A circle with more than CIRCLE_TOKENS tokens is cut into blocks, and every two blocks meet in a task. Each
comparison is exact on whole sets.

Exact counts of all tokens come first. They tell how many of a set's tokens any other set holds: with fewer than the overlap
that a link needs, the set takes no further part. They also give the frequency classes: frequent are tokens in at least
`total / MOST_FREQUENT` sets, so there are at most MOST_FREQUENT at any scale, and their table can be broadcast. The order
affects speed only, never results. Tokens move between tasks in packed arrays, dealt by hash over a number of partitions that
follows the total.

NULL and wordless texts have no tokens, and are components of their own. Fewer than five words are one token. Repeated rows
are equal texts. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordforge.llm.components import components
from recordforge.llm.textarrays import mix, pieces, split, whole_hash, window_hashes, word_hashes
from recordforge.llm.work import stored, tidy, tidy_group

WORDS = 5
PERCENT = 75
MOST_FREQUENT = 2_000_000
LEAST_FREQUENT = 32
TRIPLES_FROM = 16  # times as frequent as the bound: combinations of three
BIN_TOKENS = 2_000_000  # tokens that one task counts at a time
MOST_TASKS = 50_000  # beyond that, tasks work through several bins or units one after the other
SMALL = 5
CIRCLE_TOKENS = 4_000_000  # that one task compares at a time
UNIT_TOKENS = 1_000_000  # of circles that share a task, on average
_SEED = np.uint64(0x5851F42D4C957F2D)


def token_sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """The sorted distinct tokens of each text."""
    for lo, hi in pieces(texts):
        w = split(texts[lo:hi], lower=True)
        h = word_hashes(w)
        windows = window_hashes(h, WORDS)
        for d in range(hi - lo):
            at = w.of(d)
            n = at.stop - at.start
            tokens = np.sort(windows[at.start : at.stop - WORDS + 1] if n >= WORDS else whole_hash(h[at]))
            yield tokens[np.concatenate([[True], tokens[1:] != tokens[:-1]])] if n else tokens


def node_of(tokens: np.ndarray) -> int:
    """A 64-bit name of a set."""
    total = mix(tokens ^ _SEED).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(tokens))
    return int(mix(total).view(np.int64)[0])


def needed(n: int) -> int:
    """Tokens that a set of n shares with any set it links to, at least."""
    return -(-PERCENT * n // 100)


def largest_partner(n, held):
    """Size of the largest set that one of n tokens, of which other sets hold `held`, can link to: the two share at least
    PERCENT / (100 + PERCENT) of both sizes, and what they share is held."""
    return held * (100 + PERCENT) // PERCENT - n


def _fit(marks: np.ndarray, sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Which members of the lists (runs of one mark) have a partner there: each within the other's limit."""
    order = np.lexsort((sizes, marks))
    own_marks, own_sizes, own_limits = marks[order], sizes[order], limits[order]
    out = np.zeros(len(marks), bool)
    for a, b in zip(at := _runs(own_marks), np.append(at[1:], len(marks))):
        if b - a < 2:
            continue
        size, limit = own_sizes[a:b], own_limits[a:b]
        # The best limits among the smaller sets; the second best where the best is one's own.
        best = np.maximum.accumulate(limit)
        leader = np.maximum.accumulate(np.where(limit == best, np.arange(b - a), 0))
        inside = np.searchsorted(size, limit, "right") - 1
        ok = inside >= 0
        at_best = leader[np.maximum(inside, 0)]
        self_best = at_best == np.arange(b - a)
        fits = ok & ~self_best & (best[np.maximum(inside, 0)] >= size)
        for i in np.flatnonzero(ok & self_best):
            others = limit[: inside[i] + 1]
            fits[i] = bool(((others >= size[i]) & (np.arange(len(others)) != i)).any())
        out[order[a:b]] = fits
    return out


def _bands() -> list[int]:
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(edges[-1] + -(-edges[-1] // 3))
    return edges


BANDS = np.array(_bands())


def _mixed(*parts: int) -> int:
    """A 64-bit hash of a few numbers."""
    x = 0x9E3779B97F4A7C15
    for p in parts:
        x = ((x * 31 + p) ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 32
    return x * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF


def small_signatures(tokens: np.ndarray) -> list[int]:
    """For sets of up to five tokens: the set (up to four), and the set without each token (from four)."""
    values = [int(t) for t in tokens]
    out = [_mixed(len(values), *values)] if len(values) < SMALL else []
    if len(values) > 3:
        out += [_mixed(len(values) - 1, *(v for v in values if v != left)) for left in values]
    return out


def frequent_signatures(rare: int, frequent: list[tuple[int, int]], n: int) -> list[int]:
    """Combinations for a set with `rare` rare tokens, which do not suffice; `frequent` holds (token, class) in order."""
    out = []
    band = int(np.searchsorted(BANDS, n, "right"))
    for b in (band, band + 1):
        groups = {2: max(1, int(BANDS[b - 1]) // 6), 3: max(1, int(BANDS[b - 1]) // 12)}
        held: dict[tuple[int, int], list[int]] = defaultdict(list)
        missing = n - needed(n) + 1 - rare
        for token, k in frequent:
            if missing <= 0:
                break
            own = held[k, (token >> 20) % groups[k]]
            own.append(token)
            missing -= len(own) >= k
        if missing > 0:
            raise AssertionError(f"no complete prefix for {n} tokens")
        for (k, group), own in held.items():
            out += [_mixed(b, k, group, *combo) for combo in combinations(sorted(own), k)]
    return out


def signatures(tokens: np.ndarray, ranks: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """All signatures of a set. `ranks`: place among the frequent tokens or -1; `classes`: 2 or 3 by rank."""
    n = len(tokens)
    parts = [np.array(small_signatures(tokens), np.uint64)] if 3 <= n <= SMALL else []
    if n >= SMALL:
        rare = tokens[ranks < 0]
        need = n - needed(n) + 1
        parts.append(rare[:need])
        if len(rare) < need:
            held = np.flatnonzero(ranks >= 0)
            order = held[np.argsort(ranks[held])]
            parts.append(
                np.array(
                    frequent_signatures(len(rare), [(int(tokens[i]), int(classes[ranks[i]])) for i in order], n), np.uint64
                )
            )
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _bin(x: np.ndarray, bins: int) -> np.ndarray:
    return (x >> np.uint64(40)) % np.uint64(bins)


def _low(x: np.ndarray) -> np.ndarray:
    return (x & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, node) for (doc_id, text); node is NULL for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(token_sets(_texts(b)))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
                ],
                names=["doc_id", "n_shingles", "node"],
            )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_shingles long, node long")


def _node_runs(nodes: np.ndarray, values: np.ndarray, bins: int, facts: np.ndarray | None = None) -> pa.RecordBatch:
    """Values (hashes) with their nodes, dealt by hash: per bin the low halves, and the nodes as runs. `facts` are rows of
    numbers about the node of each value."""
    where = _bin(values, bins)
    order = np.argsort(where, kind="stable")
    facts = facts[order] if facts is not None else np.zeros((len(order), 0), np.int64)
    nodes, low, cut = nodes[order], _low(values[order]), np.searchsorted(where[order], np.arange(bins + 1))
    rows = []
    for i in np.flatnonzero(cut[1:] > cut[:-1]):
        own = nodes[cut[i] : cut[i + 1]]
        at = _runs(own)
        runs = np.diff(np.append(at, len(own))).astype(np.uint32)
        told = facts[cut[i] : cut[i + 1]][at]
        rows.append((int(i), low[cut[i] : cut[i + 1]].tobytes(), own[at].tobytes(), runs.tobytes(), told.tobytes()))
    columns = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.binary() if k else pa.int64()) for k, c in enumerate(columns)], names=_RUNS
    )


_RUNS = ["bin", "marks", "nodes", "runs", "facts"]
_RUN_SCHEMA = "bin long, marks binary, nodes binary, runs binary, facts binary"


def _read_runs(table: pa.Table, n_facts: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (mark, node) pairs of a bin, in order, and the facts of the nodes."""
    column = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), t)
    runs = column("runs", np.uint32)
    marks, nodes = column("marks", np.uint32), np.repeat(column("nodes", np.int64), runs)
    facts = np.repeat(column("facts", np.int64).reshape(len(runs), n_facts), runs, axis=0)
    order = np.lexsort((nodes, marks))
    marks, nodes = marks[order], nodes[order]
    new = np.concatenate([[True], (marks[1:] != marks[:-1]) | (nodes[1:] != nodes[:-1])])
    return marks[new], nodes[new], facts[order][new]


def shared_tokens(docs: DataFrame, total: int) -> DataFrame:
    """Rows (name, count, is_token): nodes with the number of their tokens that other nodes hold too, and frequent tokens
    with the number of their nodes. A name of a token is its bin and the low half of its hash."""
    bins, bound = _token_bins(total), _frequent_from(total)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _texts(b)
            for lo, hi in pieces(texts, 2 << 20):
                sets = {}
                for s in token_sets(texts[lo:hi]):
                    if len(s):
                        sets.setdefault(node_of(s), s)
                if sets:
                    nodes = np.repeat(np.fromiter(sets, np.int64, len(sets)), [len(s) for s in sets.values()])
                    yield _node_runs(nodes, np.concatenate(list(sets.values())), bins)

    def count(table: pa.Table) -> pa.Table:
        marks, nodes, _ = _read_runs(table)
        at = _runs(marks)
        size = np.diff(np.append(at, len(marks)))
        with_others, n = np.unique(nodes[np.repeat(size > 1, size)], return_counts=True)
        often = size >= bound
        base = table.column("bin")[0].as_py() << 32
        tokens = marks[at][often].astype(np.int64) + base
        return pa.table(
            {
                "name": np.concatenate([with_others, tokens]),
                "count": np.concatenate([n, size[often]]).astype(np.int64),
                "is_token": np.arange(len(with_others) + len(tokens)) >= len(with_others),
            }
        )

    packed = docs.select("text").mapInArrow(tidy(pack), _RUN_SCHEMA).repartition(min(bins, MOST_TASKS), "bin")
    return packed.groupBy("bin").applyInArrow(tidy_group(count), "name long, count long, is_token boolean")


def _token_bins(total: int) -> int:
    return max(16, total // BIN_TOKENS)


def _frequent_from(total: int) -> int:
    return max(LEAST_FREQUENT, total // MOST_FREQUENT)


def circles(sets: DataFrame, frequent: DataFrame, total: int) -> DataFrame:
    """(node, leader) for nodes that share a signature, where the leader of a list is the node that fits the largest
    partners. Nodes that fit no other node of the list are left out.

    `sets` is (node, held, tokens), `frequent` (name, count) of the frequent tokens, at most MOST_FREQUENT."""
    often = frequent.toArrow()
    names, n = often.column("name").to_numpy(), often.column("count").to_numpy()
    order, rank = np.argsort(names), np.empty(len(names), np.int64)
    rank[np.lexsort((names, n))] = np.arange(len(names))
    classes = np.where(np.sort(n) >= _frequent_from(total) * TRIPLES_FROM, 3, 2).astype(np.int8)  # by rank
    shared = sets.sparkSession.sparkContext.broadcast((names[order].astype(np.uint64), rank[order], classes))
    token_bins, bins = _token_bins(total), max(16, total // (2 * BIN_TOKENS))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ranks_of, classes = shared.value
        for b in batches:
            nodes, held = b.column("node").to_numpy(), b.column("held").to_numpy()
            tokens = [np.frombuffer(t, np.uint64) for t in b.column("tokens").to_pylist()]
            for lo, hi in pieces([t.data for t in tokens], 4 << 20):
                made = []
                for s in tokens[lo:hi]:
                    own = (_bin(s, token_bins) << np.uint64(32)) | _low(s)
                    at = np.minimum(np.searchsorted(names, own), max(0, len(names) - 1))
                    ranks = np.where(names[at] == own, ranks_of[at], -1) if len(names) else np.full(len(s), -1)
                    made.append(signatures(s, ranks, classes))
                size = np.array([len(t) for t in tokens[lo:hi]])
                facts = np.stack([size, largest_partner(size, held[lo:hi])], 1)
                count = [len(m) for m in made]
                yield _node_runs(np.repeat(nodes[lo:hi], count), np.concatenate(made), bins, np.repeat(facts, count, axis=0))

    def lists(table: pa.Table) -> pa.Table:
        marks, nodes, facts = _read_runs(table, 2)
        fits = _fit(marks, facts[:, 0], facts[:, 1])
        marks, nodes, facts = marks[fits], nodes[fits], facts[fits]
        at = _runs(marks)
        size = np.diff(np.append(at, len(marks)))
        if not len(at):
            return pa.table({"node": nodes, "leader": nodes})
        best = np.repeat(np.maximum.reduceat(facts[:, 1], at), size) == facts[:, 1]
        leaders = nodes[np.minimum.reduceat(np.where(best, np.arange(len(marks)), len(marks)), at)]
        pairs = np.unique(np.stack([nodes, np.repeat(leaders, size)], 1)[np.repeat(size > 1, size)], axis=0)
        return pa.table({"node": pairs[:, 0], "leader": pairs[:, 1]})

    packed = sets.select("node", "held", "tokens").mapInArrow(tidy(pack), _RUN_SCHEMA).repartition(min(bins, MOST_TASKS), "bin")
    return packed.groupBy("bin").applyInArrow(tidy_group(lists), "node long, leader long").distinct()


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, held, size, tokens) for wanted (doc_id, node, held)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # A repeated doc_id may have other texts: only the one that is the node counts.
            nodes = b.column("node").to_pylist()
            sets = [s if node_of(s) == n else None for n, s in zip(nodes, token_sets(_texts(b)))]
            sizes = pa.array([None if s is None else len(s) for s in sets], pa.int64())
            blobs = pa.array([None if s is None else s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column("node"), b.column("held"), sizes, blobs], names=["node", "held", "size", "tokens"]
            )

    # By shuffle at every size, so what the join costs does not jump when the list of ids outgrows a broadcast.
    found = docs.select("doc_id", "text").join(wanted.hint("merge"), "doc_id").select("node", "held", "text")
    sets = found.mapInArrow(tidy(run), "node long, held long, size long, tokens binary")
    return sets.filter("tokens is not null")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for (doc_id, text)."""
    told = stored(describe(docs), "jaccard-nodes")
    total = told.agg(F.sum("n_shingles")).first()[0] or 0
    nodes = told.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"))
    counts = stored(shared_tokens(docs, total), "jaccard-tokens")
    held = counts.filter("not is_token").groupBy("name").agg(F.sum("count").alias("held"))
    # What two similar sets share, both hold with another: a set with too few such tokens has no links.
    hopeful = (F.col("held") * 100 >= F.col("n_shingles") * PERCENT) & (F.col("n_shingles") > 2)
    wanted = nodes.join(held, F.col("node") == F.col("name")).filter(hopeful).select("node", "doc_id", "held")
    sets = stored(_sets(docs, stored(wanted, "jaccard-wanted")), "jaccard-sets")
    members = stored(circles(sets, counts.filter("is_token").select("name", "count"), total), "jaccard-circles")
    sizes = sets.select("node", "size").groupBy("node").agg(F.first("size").alias("size"))
    links = stored(_starred(members, sizes, sets), "jaccard-links")
    parts = stored(components(links), "jaccard-parts")
    undecided = stored(_undecided(members, parts, sizes), "jaccard-undecided")
    if not undecided.isEmpty():
        links = links.union(stored(_settled(undecided, sets), "jaccard-links"))
        parts = stored(components(links), "jaccard-parts")
    placed = nodes.join(parts, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    smallest = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = placed.join(smallest, "component").select("node", "component_id")
    filled = told.filter("node is not null").join(named, "node").select("doc_id", "n_shingles", "component_id")
    empty = told.filter("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return filled.union(empty)


def _starred(members: DataFrame, sizes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between nodes and one leader each, the smallest of theirs."""
    own = members.filter("node <> leader").groupBy("node").agg(F.min("leader").alias("leader")).join(sizes, "node")
    stars = own.groupBy("leader").agg(F.ceil(F.sum("size") / CIRCLE_TOKENS).alias("blocks"), F.sum("size").alias("weight"))
    stars = stored(stars, "jaccard-stars")
    circle = lambda block: F.struct("leader", block.alias("x"), block.alias("y")).alias("circle")
    of_node = own.join(stars, "leader").select("node", circle(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    # The leader meets every block of its nodes.
    of_leader = stars.select("leader", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("x")).select(
        F.col("leader").alias("node"), circle(F.col("x"))
    )
    total = stars.agg(F.sum("weight")).first()[0] or 0

    def links(nodes: np.ndarray, tokens: list[np.ndarray], parts: np.ndarray, leader: int) -> list[tuple[int, int]]:
        lead = int(np.flatnonzero(nodes == leader)[0])
        size = np.array([len(t) for t in tokens], np.int64)
        known = tokens[lead]
        whole = np.concatenate(tokens)
        hit = known[np.minimum(np.searchsorted(known, whole), len(known) - 1)] == whole
        shared = np.add.reduceat(hit, np.cumsum(size) - size, dtype=np.int64)
        similar = (100 + PERCENT) * shared >= PERCENT * (size + size[lead])
        return [(i, lead) for i in np.flatnonzero(similar).tolist() if nodes[i] != leader]

    return _met(of_node.union(of_leader).withColumn("part", F.col("node")), sets, total, links)


def _undecided(members: DataFrame, parts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(leader, node, part, size) of the circles that span several components."""
    placed = members.join(parts, "node", "left").select("node", "leader", F.coalesce("component", "node").alias("part"))
    spread = placed.groupBy("leader").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p <> q")
    return placed.join(spread.select("leader"), "leader", "left_semi").join(sizes, "node")


class Circle:
    """Nodes of one circle, or of two blocks of one, with their token sets and components."""

    def __init__(self, tokens: list[np.ndarray], parts: np.ndarray):
        self.size = np.array([len(t) for t in tokens], np.int64)
        owner = np.repeat(np.arange(len(tokens)), self.size)
        _, which, held = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
        n = len(tokens)
        # Tokens of many nodes are columns of a dense matrix, the others lists of nodes; those of one node are not shared.
        dense = held >= max(8, n // 4)
        column = np.cumsum(dense) - 1
        at = dense[which]
        self.dense = np.zeros((n, int(dense.sum())), np.float32)
        self.dense[owner[at], column[which[at]]] = 1
        at = (held[which] > 1) & ~at
        self.owner, self.token = owner[at], which[at]  # in order of owners
        self.first = np.searchsorted(self.owner, np.arange(n + 1))
        order = np.argsort(self.token, kind="stable")
        self.holders = self.owner[order]
        self.held_from = np.searchsorted(self.token[order], np.arange(len(held) + 1))
        self.parts = np.unique(parts, return_inverse=True)[1]

    def shared(self, lo: int, hi: int, rows: np.ndarray) -> np.ndarray:
        """Tokens that rows[lo:hi] share with every node."""
        own = rows[lo:hi]
        out = self.dense[own] @ self.dense.T
        runs = self.first[own + 1] - self.first[own]
        row = np.repeat(np.arange(len(own)), runs)
        token = self.token[_spans(self.first[own], runs)]
        count = self.held_from[token + 1] - self.held_from[token]
        cell = np.repeat(row, count) * len(self.size) + self.holders[_spans(self.held_from[token], count)]
        return out.astype(np.int64) + np.bincount(cell, minlength=out.size).reshape(out.shape)

    def links(self) -> list[tuple[int, int]]:
        """Pairs of similar nodes that join components; after them no similar nodes are in different components."""
        label, found = self.parts.copy(), []
        main = np.bincount(label).argmax()
        rows = np.flatnonzero(label != main)
        for lo in range(0, len(rows), 256):
            hi = lo + 256
            shared = self.shared(lo, hi, rows)
            own = rows[lo:hi, None]
            similar = (100 + PERCENT) * shared >= PERCENT * (self.size[own] + self.size[None, :])
            x, y = np.nonzero(similar & (label[own] != label[None, :]))
            x = rows[lo:hi][x]
            while len(x):
                # One pair of every two components, joined one after the other; then those that are still apart.
                _, at = np.unique(label[x] * (len(label) + 1) + label[y], return_index=True)
                for i, j in zip(x[at].tolist(), y[at].tolist()):
                    a, b = label[i], label[j]
                    if a != b:
                        label[label == b] = a
                        found.append((i, j))
                apart = label[x] != label[y]
                x, y = x[apart], y[apart]
        return found


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every span, one after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def _met(dealt: DataFrame, sets: DataFrame, total: int, links: Callable) -> DataFrame:
    """Links (a, b) found by `links` in the circles of (node, part, circle), where `total` tokens meet."""
    units = max(16, total // UNIT_TOKENS)

    def settle(table: pa.Table) -> pa.Table:
        tokens = [np.frombuffer(t, np.uint64) for t in table.column("tokens").to_pylist()]
        nodes, parts = table.column("node").to_numpy(), table.column("part").to_numpy()
        members: dict[tuple, list[int]] = defaultdict(list)
        for i, own in enumerate(table.column("circles").to_pylist()):
            for c in own:
                members[c["leader"], c["x"], c["y"]].append(i)
        found = []
        for (leader, _, _), own in members.items():
            if len(own) > 1:
                made = links(nodes[own], [tokens[i] for i in own], parts[own], leader)
                found += [(nodes[own[i]], nodes[own[j]]) for i, j in made]
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    named = dealt.withColumn("unit", F.pmod(F.xxhash64("circle.leader", "circle.x", "circle.y"), F.lit(units)))
    # The tokens of a node travel once per unit.
    once = named.groupBy("unit", "node", "part").agg(F.collect_set("circle").alias("circles"))
    full = once.join(sets.select("node", "tokens").hint("merge"), "node").repartition(min(units, MOST_TASKS), "unit")
    return full.groupBy("unit").applyInArrow(tidy_group(settle), "a long, b long").distinct()


def _settled(undecided: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that join components inside circles (leader, node, part, size)."""
    weight = undecided.groupBy("leader").agg(F.sum("size").alias("weight"))
    blocks = weight.select("leader", F.ceil(F.col("weight") / CIRCLE_TOKENS).cast("int").alias("blocks"))
    total = undecided.agg(F.sum("size")).first()[0]
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cut = undecided.join(blocks, "leader").select("leader", "node", "part", "blocks", block.alias("block"))
    # A block meets every block, itself included, once: as the first or as the second of two.
    meets = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.struct("leader", F.least("block", other).alias("x"), F.greatest("block", other).alias("y")),
    )
    dealt = cut.select("node", "part", F.explode(meets).alias("circle"))
    return _met(dealt, sets, total, lambda nodes, tokens, parts, leader: Circle(tokens, parts).links())
