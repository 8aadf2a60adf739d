import pytest

from loomfit.operators import vocab
from loomfit.sources import tables


def test_counts(spark, rows):
    df = spark.createDataFrame([([1, 1, 2],), ([2, None],), (None,), ([],)], "sequence array<bigint>")
    assert rows(vocab.word_counts(df)) == [(1, 2), (2, 2)]
    assert rows(vocab.word_counts(df, 3)) == []
    r = spark.createDataFrame([(1, 5, 1.0), (1, 6, 1.0), (None, 5, 1.0)], "user bigint, item bigint, rating float")
    assert rows(vocab.role_counts(r, 2, 2)) == [(False, 1, 2), (True, 5, 2)]


def test_signed_roles(spark, rows):
    df = vocab.both_roles(spark.createDataFrame([(3, 1), (0, 1), (-3, 1)], "id bigint, cn bigint"))
    assert rows(vocab.signed_roles(df)) == [(False, 3, 1), (True, -3, 1)]


def test_cdf(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(50)], "id bigint, cn bigint")
    got = vocab.unigram_cdf(df, 0.5, 5).orderBy("id").collect()
    total, run = sum((i + 1) ** 0.5 for i in range(50)), 0.0
    for i, r in enumerate(got):
        run += (i + 1) ** 0.5 / total
        assert r["cdf"] == pytest.approx(run)
    assert vocab.unigram_cdf(df.limit(0), 0.5).count() == 0


def test_first_vectors(spark):
    df = spark.createDataFrame([(False, 1, 2), (True, 1, 2), (True, -2, 2)], "type boolean, id bigint, cn bigint")
    got = [r["f"] for r in vocab.first_vectors(df, 8, True, 3).collect()]
    assert all(len(f) == 9 and f[8] == 0 and all(abs(x) <= 0.5 / 8 for x in f) for f in got)
    assert len({tuple(f) for f in got}) == 3


def test_rating_scan_refuses_double(spark):
    with pytest.raises(TypeError):
        tables.ratings(spark.createDataFrame([(1, 2, 3.0)], "user bigint, item bigint, rating double"))


def test_rare_word_keeps_its_place(spark, rows):
    from loomfit.operators.pairs import window_pairs

    df = spark.createDataFrame([([1, 9, 2],), ([1, 2],)], "sequence array<bigint>")
    known = vocab.word_counts(df, 2)
    assert rows(vocab.in_vocab(window_pairs(df, 1), known, known)) == [(1, 2), (2, 1)]
