"""Vocabularies: counts, minimum counts, roles, negative-sampling distribution and first vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomfit.functions.hashing import uniform


def word_counts(seqs: DataFrame, min_count: int = 0) -> DataFrame:
    """``id, cn``: occurrences of every id of ``sequence``, of those with at least ``min_count``.

    Counted in one pass, before any filter. Null arrays and null elements count for nothing.
    """
    words = seqs.select(F.explode("sequence").alias("id")).where("id IS NOT NULL")
    counts = words.groupBy("id").agg(F.count(F.lit(1)).alias("cn"))
    return counts.where(F.col("cn") >= min_count) if min_count > 1 else counts


def role_counts(ratings: DataFrame, min_user: int = 0, min_item: int = 0) -> DataFrame:
    """``type, id, cn``: rows of every user (false) and item (true), each side with its own minimum.

    Both are counted on the whole input in one scan, so a filtered item still counts for its users. Null ids have no row.
    """
    sides = F.array(F.struct(F.lit(False).alias("type"), F.col("user").alias("id")), F.struct(F.lit(True).alias("type"), F.col("item").alias("id")))
    counts = ratings.select(F.explode(sides).alias("s")).select("s.type", "s.id").where("id IS NOT NULL")
    counts = counts.groupBy("type", "id").agg(F.count(F.lit(1)).alias("cn"))
    return counts.where(F.col("cn") >= F.when(F.col("type"), min_item).otherwise(min_user))


def both_roles(vocab: DataFrame) -> DataFrame:
    """``type, id, cn`` with a left and a right row for every word."""
    return vocab.select(F.explode(F.array(F.lit(False), F.lit(True))).alias("type"), "id", "cn")


def signed_roles(rows: DataFrame) -> DataFrame:
    """Two-role vocabulary: positive ids on the left, negative ones on the right; 0 has no role."""
    return rows.where((F.col("id") > 0) & ~F.col("type") | (F.col("id") < 0) & F.col("type"))


def unigram(vocab: DataFrame, power: float) -> DataFrame:
    """``id, cn, mass, prob``: each word's share of ``sum(cn ** power)``."""
    mass = F.pow(F.col("cn").cast("double"), F.lit(float(power)))
    total = vocab.agg(F.sum(mass).alias("total_"))
    # one row, so the broadcast has a fixed size
    return vocab.withColumn("mass", mass).crossJoin(F.broadcast(total)).select("id", "cn", "mass", (F.col("mass") / F.col("total_")).alias("prob"))


def unigram_cdf(vocab: DataFrame, power: float, buckets: int = 64) -> DataFrame:
    """``id, prob, cdf``: the running sum of :func:`unigram` in order of id.

    Ids are range-partitioned; each partition adds up its own shares, and the partitions' totals, one row each, are added
    to the next ones'. No task sees the whole vocabulary.
    """
    ranged = unigram(vocab, power).repartitionByRange(buckets, "id").withColumn("part_", F.spark_partition_id())
    inside = F.sum("prob").over(Window.partitionBy("part_").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    local = ranged.withColumn("sum_", inside)
    tops = local.groupBy("part_").agg(F.max("sum_").alias("top_"))
    before = F.coalesce(F.sum("top_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    offsets = F.broadcast(tops.select("part_", before.alias("before_")))  # at most ``buckets`` rows
    return local.join(offsets, "part_").select("id", "prob", (F.col("sum_") + F.col("before_")).alias("cdf"))


def first_vectors(rows: DataFrame, size: int, use_bias: bool, seed: int = 0) -> DataFrame:
    """``type, id, cn, f``: values in ``[-0.5, 0.5) / size``, reproducible from seed, side and whole id; the bias is 0."""
    value = lambda k: ((uniform(seed, F.col("type"), F.col("id"), k) - 0.5) / size).cast("float")
    f = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), value)
    f = F.concat(f, F.array(F.lit(0.0).cast("float"))) if use_bias else f
    return rows.select("type", "id", "cn", f.alias("f"))


def in_vocab(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs whose ``left`` and ``right`` both have a vector."""
    keep = pairs.join(left.select(F.col("id").alias("left")), "left", "left_semi")
    return keep.join(right.select(F.col("id").alias("right")), "right", "left_semi")
