"""Operators on documents against plain versions, on odd rows, and on empty tables."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordforge.llm import bpe, jaccard, language, mixing, quality, repeats, rules, sharding
from recordforge.llm.queries import QUERIES, tokenizer_file
from recordforge.llm.work import n_words
from tests.llm import brute

ROWS = brute.odd_rows()
ONCE = [(r[0], r[1]) for r in ROWS[:-5]]  # every id once


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, brute.COLUMNS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], brute.COLUMNS)


def test_prefixes_share_a_signature():
    r = random.Random(5)
    for trial in range(3000):
        n = r.choice([3, 4, 5, 6, 7, 8, 11, 16, 23, 40, 90])
        base = [r.getrandbits(64) for _ in range(n)]
        other = list(base)
        for _ in range(r.randint(0, max(1, n // 6))):
            kind = r.random()
            if kind < 0.4 and len(other) > 3:
                other.pop(r.randrange(len(other)))
            elif kind < 0.7:
                other.append(r.getrandbits(64))
            else:
                other[r.randrange(len(other))] = r.getrandbits(64)
        share = len(set(base) & set(other)) / len(set(base) | set(other))
        if share < 0.75 or set(base) == set(other):
            continue
        tokens = sorted(set(base) | set(other))
        frequent = r.choice([0.0, 0.5, 0.8, 1.0])
        rank = {t: (i if r.random() < frequent else -1) for i, t in enumerate(r.sample(tokens, len(tokens)))}
        classes = np.array(sorted(r.choice([2, 3]) for _ in tokens), np.int8)
        made = []
        for s in (base, other):
            own = np.array(sorted(set(s)), np.uint64)
            made.append(set(jaccard.signatures(own, np.array([rank[int(t)] for t in own]), classes).tolist()))
        assert made[0] & made[1], (trial, n, share)


@pytest.mark.parametrize("frequent_from", [32, 3])
def test_near_duplicates(spark, odd, frequent_from, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAST_FREQUENT", frequent_from)
    monkeypatch.setattr(jaccard, "TRIPLES_FROM", 3)
    rows = ONCE + [(1000 + i, t) for i, t in enumerate(brute.made_texts(250, 8, 60))]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(table).collect()}
    assert got == brute.components(rows)
    assert len({c for _, c in got.values()}) < len(got) - 50


def test_near_duplicates_odd(odd, empty):
    got = jaccard.near_duplicates(odd).collect()
    assert len(got) == len(ROWS)
    assert [r.component_id for r in got if r.n_shingles == 0] == [r.doc_id for r in got if r.n_shingles == 0]
    assert len({r.component_id for r in got if r.doc_id == 5}) == 1  # repeated rows
    assert jaccard.near_duplicates(empty).count() == 0


def test_repeats(spark):
    rows = ONCE + [(1000 + i, t) for i, t in enumerate(brute.made_texts(200, 9, 60))]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute.without_repeats(rows)
    for part_bytes in (4 << 20, 2000):
        for r in repeats.remove_repeats(table, part_bytes=part_bytes).collect():
            n, kept = want[r.doc_id]
            assert (r.n_words, r.n_removed, brute.words(r.text)) == (n, n - len(kept), kept)
            if n == len(kept):
                assert r.text == dict(rows)[r.doc_id]


def test_repeats_odd(odd, empty):
    out = repeats.remove_repeats(odd)
    assert out.columns == [*odd.columns, "n_words_", "n_removed"]
    rows = out.collect()
    assert len(rows) == len(ROWS)
    assert len({(r.text, r.n_removed) for r in rows if r.doc_id == 6}) == 1  # repeated rows do not empty each other
    assert repeats.remove_repeats(empty).count() == 0


def test_mix(odd, empty):
    sized = odd.withColumn("size", n_words(F.col("text")))
    got = mixing.mix(sized).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(sized.repartition(2)).collect()))
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.copies
        largest[r.source] = max(largest[r.source], r.size)
        assert 0 <= r.copies <= 3
    want = brute.targets(dict(sizes))
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    assert len(got) == len(ROWS) and mixing.mix(empty.withColumn("size", F.lit(1))).count() == 0


def test_water_level(spark):
    r = random.Random(2)
    for n in (1, 2, 5, 17):
        sizes = {f"s{i}": r.choice([0, 1, 10, 1000, 50_000]) for i in range(n)} | {None: 7}
        table = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {x.source: x.target for x in mixing.source_targets(table).collect()}
        assert got == pytest.approx(brute.targets(sizes))


def test_shards(odd, empty):
    rows = sharding.shard_documents(odd).collect()
    assert len(rows) == len(ROWS)
    slots, texts, loads = defaultdict(list), defaultdict(set), Counter()
    crc = {(r.doc_id, r.text_crc32) for r in odd.select("doc_id", F.crc32(F.encode("text", "UTF-8")).alias("text_crc32")).collect()}
    for r in rows:
        assert (r.doc_id, r.text_crc32) in crc
        slots[r.shard].append(r.slot)
        texts[r.text_crc32].add(r.shard)
        loads[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in texts.values())
    assert sharding.shard_documents(empty).count() == 0


def test_shards_follow_the_heap(spark):
    sizes = [random.Random(4).randint(1, 1000) for _ in range(300)]
    table = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "group long, size long")
    placed = {r.group: r.shard for r in sharding.assign(table, 7, items=1_000_000).collect()}
    loads = [0] * 7
    for i in sorted(range(300), key=lambda i: (-sizes[i], i)):
        least = min(range(7), key=lambda k: (loads[k], k))
        assert placed[i] == least
        loads[least] += sizes[i]
    few = sharding.assign(table, 7, items=40).groupBy("shard").agg(F.sum("size").alias("n")).collect()  # with parcels
    assert len(few) == 7 and max(r.n for r in few) < 1.2 * sum(sizes) / 7


def test_rule_counts(odd, empty):
    rows = rules.rule_verdicts(odd).collect()
    want = Counter((r[0], *brute.base_counts(r[1])) for r in ROWS)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert got == want
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in rows)
    assert not any(r.kept and r.base_failed for r in rows)
    assert rules.rule_verdicts(empty).count() == 0


def test_estimates_find_accuracies():
    r = random.Random(1)
    hit, false_alarm = [0.6, 0.5, 0.4, 0.3], [0.005, 0.0, 0.002, 0.004]
    seen, truth = Counter(), Counter()
    for _ in range(20_000):
        bad = r.random() < 0.2
        votes = tuple(-1 if r.random() < (hit[k] if bad else false_alarm[k]) else 1 for k in range(4))
        seen[votes] += 1
        truth[votes, bad] += 1
    found = rules.estimate(list(seen.items()), 4)
    assert abs(found.prior - 0.8) < 0.05
    assert all(abs(b[-1] - h) < 0.12 for b, h in zip(found.bad, hit))
    assert found.posterior((1, 1, 1, 1)) > 0.5 > found.posterior((-1, 1, 1, 1))
    # The table's own judge gives the same posteriors.
    right = sum(n for (v, bad), n in truth.items() if (found.posterior(v) < 0.5) == bad)
    assert right > 0.95 * 20_000


def test_bpe_matches_the_library(odd, empty):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_file())
    parts = ["a", "'s", "'ll", "'re", "!'s", " '", " ", "  ", "\n", "\r\n", "1", "é", "日本", "😀", "<|endoftext|>", "\x85", "x" * 80]
    r = random.Random(6)
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(400)] + [t for _, t in ONCE]
    table = odd.sparkSession.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    coded = bpe.encode(table, tokenizer_file(), lexicon_size=200)
    assert coded.columns == ["doc_id", "text", "ids", "ids_", "decoded"]
    for row in coded.collect():
        want = plain.encode(row.text or "", add_special_tokens=False).ids
        assert row.ids_ == want and row.decoded == plain.decode(want, skip_special_tokens=False)
    assert bpe.encode(empty, tokenizer_file()).count() == 0


def test_lexicon_is_minimal():
    words = {w.encode(): [i] for i, w in enumerate(["walking", "talking", "walks", "talks", "walk", "talk", "a", "é"])}
    lexicon = bpe.Lexicon.mapped(bpe.compile_lexicon(words).pack())
    # the start; after w or t, then a, l, k, i, n; the end; after the first byte of é
    assert len(lexicon.final) == 9
    tried = [*words, b"", b"wal", b"walkings", b"b"]
    data = np.frombuffer(b"".join(tried), np.uint8)
    ends = np.cumsum([len(t) for t in tried])
    place = lexicon.find(data, ends - [len(t) for t in tried], ends)
    got = [lexicon.ids[lexicon.at[p] : lexicon.at[p + 1]].tolist() if p >= 0 else None for p in place]
    assert got == [*words.values(), None, None, None, None]


def test_kinds_are_those_of_the_library():
    from tokenizers.pre_tokenizers import ByteLevel

    cut, kinds = ByteLevel(add_prefix_space=False, use_regex=True), bpe.kinds_of_points()
    r = random.Random(8)
    for c in [*range(0x3000), *(r.randrange(0x3000, 0xD800) for _ in range(500)), *(r.randrange(0xE000, 0x110000) for _ in range(500))]:
        own = next((k for head, k in (("a", 1), ("1", 2), ("!", 3)) if len(cut.pre_tokenize_str(head + chr(c))) == 1), 0)
        assert kinds[c] == own, hex(c)


def test_attention_gradients():
    r = np.random.default_rng(0)
    x, count, y = r.normal(size=(9, 5)), np.array([1, 4, 4]), np.array([0.0, 1.0, 1.0])
    model = quality.Model(np.zeros(5), np.ones(5), 0.1, hidden=4, gate=3)
    model.p["c"] = r.normal(size=4)
    loss = lambda: -np.mean(y * np.log(s := model.forward(x, count)[0]) + (1 - y) * np.log(1 - s))
    for name, g in model.gradients(x, count, y).items():
        for at in np.ndindex(np.shape(g)):
            kept = model.p[name].copy()
            model.p[name][at] += 1e-5
            up = loss()
            model.p[name][at] -= 2e-5
            down = loss()
            model.p[name] = kept
            assert (up - down) / 2e-5 == pytest.approx(g[at], abs=1e-5)


def test_quality_odd(odd, empty):
    labels = odd.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label"))
    model = quality.fit(odd, labels, sample=50)
    rows = quality.score(odd, model, ["doc_id", "text", "score"]).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score_ <= 1 for r in rows)
    assert len({r.score_ for r in rows if not (r.text or "").strip()}) == 1
    assert quality.score(empty, quality.fit(empty, empty.select("doc_id", F.lit(1).alias("label"))), ["doc_id"]).count() == 0


def test_language_odd(odd, empty):
    rows = language.identify(odd, F.lit(True), odd.columns).collect()
    assert len(rows) == len(ROWS) and rows[0].asDict().keys() >= {"lang_pred", "score", "score_"}
    for r in rows:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
        assert r.lang_pred in ("und", "en", "fr") and 0 <= r.score_ <= 1
    unlearned = language.identify(odd, F.lit(False), ["doc_id"]).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in unlearned] == ["und"]
    assert language.identify(empty, F.lit(True), ["doc_id"]).count() == 0


SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = QUERIES["op10_language"](spark, SF).filter("held_out").join(docs, "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    scored = QUERIES["op5_quality_scores"](spark, SF).filter("held_out").join(labels, "doc_id").groupBy("quality")
    right = {r.quality: r.n for r in scored.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("n")).collect()}
    assert right[0] > 0.8 and right[1] > 0.95


def test_digests(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    want = brute.without_repeats(list(rows.items()))
    for r in QUERIES["op8_repeated_passages"](spark, SF).collect():
        n, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed) == (n, n - len(kept))
        assert r.kept_sha256 == hashlib.sha256(b" ".join(kept)).hexdigest()
    for r in QUERIES["op4_bpe_round_trip"](spark, SF).collect():
        assert r.decoded_sha256 == hashlib.sha256(rows[r.doc_id].encode()).hexdigest()
