"""The fold on long and odd pieces, and decoding of null and unknown ids; columns with clashing names."""

import random

import pytest
from pyspark.sql import functions as F

from canopyflow.llm import byte_bpe


@pytest.fixture(scope="module")
def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def test_fold_of_long_and_random_pieces(spark, vocabulary):
    ranks = byte_bpe.load_ranks(vocabulary[0])
    rng = random.Random(5)
    words = ["a" * 500, "漢" * 170, "", "\u0000", "ab" * 120] + ["".join(rng.choice("aeinstr hé漢 ") for _ in range(rng.randrange(2, 60))) for _ in range(150)]
    table = byte_bpe.rank_literal(ranks)
    out = spark.createDataFrame([(w,) for w in words], "w string").select("w", byte_bpe.fold_merges(F.col("w").cast("binary"), table).alias("ids")).collect()
    assert {r["w"]: r["ids"] for r in out} == {w: byte_bpe.merge(w.encode(), ranks) if w else [] for w in words}


def test_decode_of_null_and_unknown_ids(spark, vocabulary):
    codec = byte_bpe.Codec(spark, byte_bpe.load_ranks(vocabulary[0]), vocabulary[1])
    known = spark.createDataFrame([(1, None), (2, []), (3, [0, 1])], "doc_id long, ids array<int>")
    own = {r: p for p, r in codec.ranks.items()}
    assert {r["doc_id"]: r["bytes"] if r["bytes"] is None else bytes(r["bytes"]) for r in codec.decode(known).collect()} == {1: None, 2: b"", 3: own[0] + own[1]}
    for ids in ([10_000_000], [0, None]):
        with pytest.raises(Exception, match="vocabulary"):
            codec.decode(spark.createDataFrame([(1, ids)], "doc_id long, ids array<int>")).collect()


def test_columns_with_clashing_names(spark, vocabulary):
    rows = [(1, "Hello  world zzxqj", 5, "x", 1.0), (None, None, 6, "y", 2.0), (1, "", None, None, None)]
    plain = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    wide = spark.createDataFrame(rows, "doc_id long, text string, ids int, piece string, n_tokens double")
    made = [sorted(map(tuple, byte_bpe.train_free_codec(d, *vocabulary).digests(d).collect()), key=str) for d in (plain, wide)]
    assert made[0] == made[1] and len(made[0]) == 3


def test_texts_are_cut_at_spaces_as_by_the_pattern(vocabulary):
    regex = pytest.importorskip("regex")
    rng = random.Random(3)
    signs = ["a", "Bé", "漢", "12", "'s", "'", "!", "(", " ", " ", " ", "  ", "\n", "\t", "\u00a0", "\x1c", "\u0301", " \n", "\n "]
    texts = ["", " ", " a", "a ", "a  b", "a\n b", "a \nb", " 's 't"] + ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 12))) for _ in range(5000)]
    for pattern in (vocabulary[1], r"\s?\S+|\s+"):
        cutter, whole = byte_bpe.Cutter(pattern), regex.compile(pattern).findall
        for t in texts:
            head, rest = cutter.cut(t)
            assert head + [p for w in rest for p in cutter.word(w)] == whole(t), t
    assert byte_bpe.Cutter(vocabulary[1]).cut("one two two") == (["one"], ["two", "two"])


def test_words_of_known_pieces_are_looked_up_once_and_others_forgotten(vocabulary):
    ranks = byte_bpe.load_ranks(vocabulary[0])
    known = {p: bytes([k, 0, 0, 0]) for k, p in enumerate([" one", "one", " two", ","])}
    splitter = byte_bpe.Splitter(byte_bpe.Pieces(known, ranks, 512), byte_bpe.Cutter(vocabulary[1]), most=2)
    for _ in range(2):
        ids, words = splitter.ids("one one, zzxqj zzxqj two")
        assert words == [b" zzxqj"] and [int.from_bytes(ids[k : k + 4], "little", signed=True) for k in range(0, len(ids), 4)] == [1, 0, 3, -1, -1, 2]
        assert "zzxqj" not in splitter and len(splitter) <= 2 and len(splitter.pieces) == 4
    spelling, text = byte_bpe.Spelling(ranks), "Hello wörld 漢 12 " * 50
    assert spelling.decode(byte_bpe.np.array(byte_bpe.merge(text.encode(), ranks)), block=7) == text.encode()
