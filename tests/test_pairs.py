from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomfit.operators import pairs

SEQ = "sequence array<bigint>"


def brute(s, w):
    return Counter((x, s[c]) for i, x in enumerate(s) for c in range(len(s)) if abs(i - c) <= w and s[c] != x)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.integers(-3, 3), max_size=9), max_size=6), st.integers(1, 4))
def test_window_equals_brute_force(spark, seqs, w):
    got = Counter(tuple(r) for r in pairs.window_pairs(spark.createDataFrame([(s,) for s in seqs], SEQ), w).collect())
    assert got == sum((brute(s, w) for s in seqs), Counter())


def test_window_edges(spark, rows):
    df = spark.createDataFrame([([],), ([5],), ([5, 5, 5],), (None,), ([1, None, 2],)], SEQ)
    assert rows(pairs.window_pairs(df, 1)) == []
    assert rows(pairs.window_pairs(df, 2)) == [(1, 2), (2, 1)]
    with pytest.raises(ValueError):
        pairs.window_pairs(df, 0)


def test_draws(spark):
    df = spark.createDataFrame([([1, 2, 3, 4],), ([7],), ([],), (None,), ([5, 5],)], SEQ)
    got = pairs.item2vec_pairs(df, 1, 3).collect()
    assert Counter(r["left"] for r in got) == {1: 2, 2: 2, 3: 2, 4: 2}
    assert all(r["left"] != r["right"] for r in got)
    assert got == pairs.item2vec_pairs(df, 1, 3).collect()


def test_two_roles(spark, rows):
    df = spark.createDataFrame([([3, -1],), ([3, -1, -2],), ([0, 7, -7],)], SEQ)
    got = rows(pairs.pos2neg_pairs(df, 1, 0))
    assert Counter(r[0] for r in got) == {3: 1, 7: 1}
    assert all(r[1] <= 0 for r in got)


def test_rating_pairs(spark, rows):
    df = spark.createDataFrame([(1, 1, 0.5), (None, 2, 1.0), (2, None, 1.0), (3, 4, None)], "user bigint, item bigint, rating float")
    assert rows(pairs.rating_pairs(df, True)) == [(1, 1, None, 0.5), (3, 4, None, None)]
    assert rows(pairs.rating_pairs(df, False))[0] == (1, 1, 0.5, None)
