"""Vector codes, SentencePiece and spelling variants against plain versions, on odd rows, and on empty tables."""

import hashlib
import random
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordforge.llm import codes, pieces, variants
from recordforge.llm.queries import QUERIES, piece_file
from tests.llm import brute

VECTORS = "vec_id long, embedding array<double>, label int, code int, _rows string"


def vectors(seed: int, n: int, size: int, scale: float) -> list[tuple]:
    r = random.Random(seed)
    centers = [[r.gauss(0, scale) for _ in range(size)] for _ in range(5)]
    rows = [(i * 3, [c + r.gauss(0, scale / 9) for c in r.choice(centers)], r.choice([0, 1, 1, None]), i, "x") for i in range(n)]
    rows += [(r[0] + 10_000, r[1], 1, 0, None) for r in rows[:7]]  # equal vectors
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [None] * size, [nan] * size, [inf] + [0.0] * (size - 1), [-inf] * size]
    return rows + [(-5 - i, v, 1, 0, "bad") for i, v in enumerate(bad)] + [(None, rows[0][1], None, None, None)]


def coded(spark, rows, partitions=3):
    table = spark.createDataFrame(rows, VECTORS).repartition(partitions)
    out, books = codes.compress(table)
    assert out.columns == [*table.columns, "code_", "error"]
    return sorted((r.vec_id is None, r.vec_id, r.code_, r.error) for r in out.collect()), books


@pytest.mark.parametrize(("size", "scale", "n"), [(16, 0.3, 90), (8, 3e4, 40), (24, 1e30, 25), (8, 1.0, 9)])
def test_vector_codes(spark, size, scale, n):
    rows = vectors(size, n, size, scale)
    got, books = coded(spark, rows)
    want, want_books = brute.vector_codes([r[:2] for r in rows])
    assert books.entries == want_books
    assert got == sorted((i is None, i, c, min(codes.MOST, e)) for i, c, e in want)
    flat = ",".join(str(x) for part in want_books for entry in part for x in entry)
    assert books.digest() == hashlib.sha256(flat.encode()).hexdigest()


def test_vector_codes_odd(spark):
    one = [(4, [0.5] * 8, 1, 0, "x"), (9, [0.1] * 3, 1, 0, "other length")]
    assert coded(spark, one)[0] == [(False, 4, "00" * 8, 0)]
    out, books = codes.compress(spark.createDataFrame([], VECTORS))
    assert out.collect() == [] and books.entries == [[]] * 8
    assert codes.compress(spark.createDataFrame([(1, None, 1, 0, "x")], VECTORS))[0].count() == 0


def test_limbs_carry_any_sum():
    r = random.Random(1)
    for x in [0, 1, -1, 2**40, -(2**40), 2**200 + 5, -(2**130)] + [r.getrandbits(90) - 2**89 for _ in range(200)]:
        limbs = list(codes._limbs(x))
        assert sum(v << (codes.LIMB * k) for k, v in limbs) == x and all(abs(v) <= 2**codes.LIMB for _, v in limbs)


def test_blocks_do_not_change_codes(spark, monkeypatch):
    rows = vectors(3, 60, 16, 0.3)
    whole = coded(spark, rows)
    monkeypatch.setattr(codes, "BLOCK_VALUES", 64)
    assert coded(spark, rows, 5) == whole


def test_group_sum(spark):
    rows = [(i, None if i % 7 == 0 else ("hot" if i % 3 else f"g{i}"), i, "x") for i in range(2500)]
    table = spark.createDataFrame(rows, "id long, label string, value long, _total string")
    got = {r.id: r.all for r in codes.with_group_sum(table, "label", "value", "all").collect()}
    sums = {}
    for _, g, v, _ in rows:
        sums[g] = sums.get(g, 0) + v
    assert got == {i: sums[g] for i, g, _, _ in rows}
    large = spark.createDataFrame([(1, "a", 2**62, ""), (2, "a", 2**62, "")], table.schema)
    assert {r.all for r in codes.with_group_sum(large, "label", "value", "all").collect()} == {codes.MOST}


@pytest.fixture(scope="module")
def coder():
    import sentencepiece

    tables = pieces.tabulate(pieces.load(piece_file()))
    return pieces.Encoder(tables), pieces.Decoder(tables.model), sentencepiece.SentencePieceProcessor(model_file=piece_file())


def same_as_library(coder, text):
    encoder, decoder, library = coder
    ids = array("i")
    ids.frombytes(encoder.encode(text))
    want = library.encode(text, add_eos=True)
    assert list(ids) == want, text
    assert decoder.decode(ids) == library.decode(want), text


def test_pieces_like_the_library(coder):
    r = random.Random(11)
    signs = [
        "abcdefghijklmnopqrstuvwxyz", "the an in er on  ", "ABC abc .,!?\n\t", "àéîñß straße", "漢字かな 한국어", "😀🎉‍👍🏽",
        "\x00\x01\x7f\u0085　▁ ", "0123456789 ", "((()))[]{};=  ",
    ]
    known = coder[0].tables.model.pieces[259:]
    for trial in range(4000):
        if r.random() < 0.5:
            pool = "".join(r.choice(signs) for _ in range(r.randint(1, 3)))
            text = "".join(r.choice(pool) for _ in range(r.choice([0, 1, 2, 3, 5, 8, 20, 60])))
        else:
            text = "".join(r.choice(known) for _ in range(r.randint(1, 8))).replace("▁", r.choice([" ", "", "▁"]))
        same_as_library(coder, text)
    for n in range(40):
        for s in ("", "x", "the", "\n"):
            same_as_library(coder, " " * n + s + " " * n + s)
    for text in brute.made_texts(60, 4) + ["<s>", "</s>", "<0x41>", "<unk>", "a " * 70_000, "ab" * 40_000]:
        same_as_library(coder, text)


def test_pairs_of_tokens(coder):
    encoder = coder[0]
    r = random.Random(7)
    tokens = encoder.tables.tokens
    for trial in range(3000):
        a, b = r.randrange(len(tokens)), r.randrange(len(tokens))
        if r.random() < 0.7:  # a border that a merge may cross
            whole = tokens[a]
            cut = r.randint(1, len(whole))
            a, b = encoder.number.get(whole[:cut], a), encoder.number.get(whole[cut:] + tokens[b][:1], b)
        stays = pieces.merge(tokens[a] + tokens[b], encoder.score_of) == [tokens[a], tokens[b]]
        assert encoder.compatible(a, b) == stays, (tokens[a], tokens[b])


def test_chunks_do_not_change_ids(coder, monkeypatch):
    encoder = coder[0]
    text = " ".join(brute.made_texts(30, 5)) + "   " + "x" * 300 + "  y"
    whole = encoder.encode(text)
    monkeypatch.setattr(pieces, "CHUNK", 7)
    assert encoder.encode(text) == whole


def test_bytes_that_are_no_text(coder):
    _, decoder, library = coder
    for ids in ([3 + 0xE2, 3 + 0x96, 28705], [3 + 0xFF, 3 + 0x41], [1, 28705, 264, 2], [0, 264], []):
        assert decoder.decode(array("i", ids)) == library.decode(ids), ids


def test_pieces_on_tables(spark, coder):
    rows = brute.odd_rows()
    table = spark.createDataFrame(
        [(*r, "own") for r in rows], brute.COLUMNS + ", ids string"
    ).repartition(4)
    out = pieces.encode(table, piece_file())
    assert out.columns == [*table.columns, "ids_", "decoded"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids_ == coder[2].encode(r.text or "", add_eos=True) and r.ids == "own"
        assert r.decoded == coder[2].decode(r.ids_)
    assert pieces.encode(spark.createDataFrame([], brute.COLUMNS), piece_file()).count() == 0


def test_piece_query(spark, coder):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in QUERIES["op12_piece_round_trip"](spark, sf).collect():
        ids = coder[2].encode(texts[r.doc_id], add_eos=True)
        want = (len(ids), digest(" ".join(map(str, ids))), digest(coder[2].decode(ids)))
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want


def variant_rows() -> list[tuple]:
    r = random.Random(9)
    base = ["".join(r.choice("abcdeé") for _ in range(r.randint(7, 10))) for _ in range(12)] + ["aaaaaaaa", "aaaaaaab", "ÀÉÎÕÜÝþÿ"]
    rows = []
    for i in range(300):
        words = []
        for _ in range(r.randint(1, 40)):
            w = base[int(r.random() ** 3 * len(base))]
            if r.random() < 0.3:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abcx") + w[k:], w[:k] + r.choice("abcx") + w[k + 1 :]])
            words.append(r.choice([w, w.title(), w.upper()]) if r.random() < 0.2 else w)
        rows.append((i, r.choice([" ", "\n", "-", "漢", "1"]).join(words)))
    return rows + [(None, "abstract abstract"), (5, None), (6, ""), (7, "abstracts"), (7, "abstracts"), (8, "x" * 5000 + " " + "x" * 5000)]


def test_spelling_variants(spark, monkeypatch):
    rows = variant_rows()
    want = brute.spelling_variants(rows)
    for keep in (200_000, 3):
        monkeypatch.setattr(variants, "_KEEP", keep)
        table = spark.createDataFrame([(*r, "own", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(3)
        got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.spelling_variants(table).collect()}
        assert got == want
    assert any(f for f, *_ in want.values()) and any(root != f for f, root, *_ in want.values() if f)


def test_spelling_variants_empty(spark):
    assert variants.spelling_variants(spark.createDataFrame([], brute.COLUMNS)).count() == 0
    assert variants.spelling_variants(spark.createDataFrame([(1, None), (2, "short")], "doc_id long, text string")).count() == 0


def test_rotations_meet_once(spark):
    words = spark.createDataFrame([("aabbccdd", 5), ("aabccdd", 50), ("aabbccde", 4), ("aabbccd", 9)], "word string, n long")
    near = {r.word: r.n_near for r in variants.neighbours(words).collect()}
    assert near == {"aabbccdd": 3, "aabccdd": 1, "aabbccde": 2, "aabbccd": 2}
    keys = variants.rotations(words).groupBy("key").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    assert keys <= 4 and np.isfinite(keys)


def test_bpe_merges_in_arrays_like_one_by_one():
    from recordforge.llm import bpe
    from recordforge.llm.queries import tokenizer_file

    vocabulary = bpe.Vocabulary(bpe.load(tokenizer_file()))
    table = bpe.PairTable(vocabulary.ranked)
    r = random.Random(2)
    words = [bytes(r.choice(b"abcdet ainshr\xc3\xa9\xe4\xb8") for _ in range(r.randint(1, bpe.SHORT))) for _ in range(3000)]
    words += [b"a" * n for n in range(1, bpe.SHORT + 1)]
    want = [array("i", vocabulary.merge(w)).tobytes() for w in words]
    assert table.merge(words, np.array(vocabulary.byte_id, np.int32)) == want
    assert table.merge([b"x"], np.array(vocabulary.byte_id, np.int32)) == [array("i", vocabulary.merge(b"x")).tobytes()]


def test_bpe_long_texts_and_full_memories(monkeypatch):
    from tokenizers import Tokenizer

    from recordforge.llm import bpe
    from recordforge.llm.queries import tokenizer_file

    library = Tokenizer.from_file(tokenizer_file())
    vocabulary = bpe.Vocabulary(bpe.load(tokenizer_file()))
    monkeypatch.setattr(bpe, "BLOCK", 50)
    monkeypatch.setattr(bpe, "GROUP", 80)
    monkeypatch.setattr(bpe, "_KEEP_MERGED", 20)
    lexicon = bpe.compile_lexicon({b" the": vocabulary.merge(b" the")})
    encoder = bpe.Encoder(vocabulary, lexicon, bpe.kinds_of_points())
    texts = brute.made_texts(25, 6) + [None, "", "a  b\n\n c<|endoftext|>d " * 30, "x" * 400, "it's we'll  'tis　é́ " * 20]
    ids, count = encoder.encode(texts)
    assert np.split(ids, np.cumsum(count)[:-1])[-1].tolist() == library.encode(texts[-1], add_special_tokens=False).ids
    assert ids.tolist() == [i for t in texts for i in library.encode(t or "", add_special_tokens=False).ids]


def test_pairs_of_large_ids(spark):
    from recordforge.llm.queries import pair_of

    ids = [0, 1, -1, -2, -3, 2**60 + 2, 2**60 + 3, 2**63 - 1, -(2**63)]
    table = spark.createDataFrame([(i,) for i in ids], "conv_id long")
    assert [r[0] for r in table.select(pair_of("conv_id")).collect()] == [i // 2 for i in ids]
