"""Training pairs from sequences and ratings, without a join: everything happens inside a row's array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_pairs(seqs: DataFrame, window: int) -> DataFrame:
    """``left, right``: every position with every other at most ``window`` away, ids unequal, duplicates kept.

    The window is fixed and counts array positions; rare or filtered words keep theirs. Null elements keep their
    position but pair with nothing; null arrays give none.
    """
    if window < 1:
        raise ValueError("window must be positive")
    s = F.col("sequence")

    def around(x: Column, i: Column) -> Column:
        first = F.greatest(i - window, F.lit(0))
        near = F.slice(s, first + 1, i + window - first + 1)
        return F.transform(F.filter(near, lambda y: y != x), lambda y: F.struct(x.alias("left"), y.alias("right")))

    return seqs.select(F.inline(F.flatten(F.transform(s, around))).alias("left", "right"))


def _draws(owner: Column, partners: Column, skip_self: bool, budget: Column, salt: list[Column]) -> Column:
    """For each owner ``(x, i)``: ``budget`` partners by hashed index, with replacement; equal ids drop out."""
    n = F.size(partners)

    def of(x: Column, i: Column) -> Column:
        def one(j: Column) -> Column:
            at = F.pmod(F.xxhash64(*salt, i, j), (n - 1 if skip_self else n).cast("bigint")).cast("int")
            at = F.when(at >= i, at + 1).otherwise(at) if skip_self else at
            return F.struct(x.alias("left"), F.get(partners, at).alias("right"))

        return F.filter(F.transform(F.sequence(F.lit(1), budget), one), lambda p: p["left"] != p["right"])

    return F.when(budget > 0, F.flatten(F.transform(owner, of))).otherwise(F.array().cast("array<struct<left:bigint,right:bigint>>"))


def item2vec_budget(length: Column, window: int) -> Column:
    """Partners drawn per position: twice the window, at most all others."""
    return F.greatest(F.least(F.lit(2 * window), length - 1), F.lit(0))


def sequence_parts(s: Column) -> tuple[Column, Column]:
    """Left role (positive ids) and right role (the others, 0 among them) of a two-role sequence."""
    return F.filter(s, lambda x: x > 0), F.filter(s, lambda x: x <= 0)


def item2vec_pairs(seqs: DataFrame, window: int, seed: int = 0) -> DataFrame:
    """``left, right``: each position with randomly drawn other positions of its sequence, reproducible from the seed.

    The draw hashes seed, the sequence's content and the position, so equal sequences draw alike. Null elements drop out.
    """
    s = F.col("sequence")
    pairs = _draws(s, s, True, item2vec_budget(F.size(s), window), [F.lit(seed), F.xxhash64(s)])
    return seqs.where("sequence IS NOT NULL").select(F.inline(pairs).alias("left", "right")).where("left IS NOT NULL AND right IS NOT NULL")


def pos2neg_pairs(seqs: DataFrame, window: int, seed: int = 0) -> DataFrame:
    """``left, right``: each positive id with ids drawn from the sequence's others; their number less 1 is the most drawn.

    Sequences with fewer than two right ids give no pairs.
    """
    left, right = sequence_parts(F.col("sequence"))
    parts = seqs.where("sequence IS NOT NULL").select(left.alias("l_"), right.alias("r_"), F.xxhash64("sequence").alias("h_"))
    pairs = _draws(F.col("l_"), F.col("r_"), False, item2vec_budget(F.size("r_"), window), [F.lit(seed), F.col("h_")])
    return parts.select(F.inline(pairs).alias("left", "right"))


def rating_pairs(ratings: DataFrame, implicit: bool) -> DataFrame:
    """``left, right, label, weight``: the rating weighs an implicit pair and labels an explicit one.

    Users and items are different domains: equal ids stay a pair. Rows with a null id give none.
    """
    none = F.lit(None).cast("float")
    label, weight = (none, F.col("rating")) if implicit else (F.col("rating"), none)
    return ratings.where("user IS NOT NULL AND item IS NOT NULL").select(F.col("user").alias("left"), F.col("item").alias("right"), label.alias("label"), weight.alias("weight"))
