"""Exact quantiles per key when a few keys hold most rows.

No task ever gathers a key's values. Equal values of a key are counted once, before the shuffle; values become whole numbers
of the same order, and histograms over their first bits are merged counts of these. The bin that holds a rank is looked at by
more bits, until its smallest and largest value agree. What is joined are counts, never values: a hot key costs as many rows
as it has bins.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfit.session import BROADCAST_ROWS, store

#: Bits left out of the ordered numbers' 64 in every round. The first bins are 1/256 of a power of two wide.
SHIFTS = (44, 32, 20, 8, 0)


def ordered(v: Column) -> Column:
    """A BIGINT in the order of a finite DOUBLE: its exponent above its 52 bits of fraction, negative for negative values."""
    x = F.abs(v)
    least = F.lit(2.0**-1022)
    guess = F.floor(F.log2(F.greatest(x, least)))
    power = F.pow(F.lit(2.0), guess)
    # the logarithm may be off by one next to a power of two
    e = guess + F.when(x / 2 >= power, 1).when((x < power) & (x >= least), -1).otherwise(0)
    share = F.when(x < least, x / least).otherwise(x / F.pow(F.lit(2.0), e) - 1)
    number = F.when(x < least, F.lit(0).cast("bigint")).otherwise(e + 1023) * F.lit(1 << 52) + F.floor(share * F.lit(float(1 << 52)))
    return F.when(v < 0, -number).otherwise(number)


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def _locate(hist: DataFrame, targets: DataFrame, by: Sequence[str]) -> DataFrame:
    """The bin of every target's rank: ``hist`` has ``by, bin, c, lo, hi``, ``targets`` has ``by, p, r`` (r from 1)."""
    w = Window.partitionBy(*by).orderBy("bin")
    run = hist.withColumn("top", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # a hot key has as many rows here as any other at most: its bins
    hit = run.alias("h").join(targets.alias("t"), [F.col(f"h.{k}").eqNullSafe(F.col(f"t.{k}")) for k in by])
    inside = (F.col("t.r") <= F.col("h.top")) & (F.col("t.r") > F.col("h.top") - F.col("h.c"))
    return hit.where(inside).select(*[F.col(f"t.{k}").alias(k) for k in targets.columns if k != "r"], (F.col("t.r") - F.col("h.top") + F.col("h.c")).alias("r"), *[F.col(f"h.{k}").alias(f"{k}_new") for k in ("lo", "hi")])


def keyed_quantiles(rows: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Row count and exact quantiles of ``value`` for every key.

    Columns: the keys, ``n`` (all rows), ``n_values`` (rows with a finite value) and ``q<percent>`` per probability: the
    value of rank ``ceil(p * n_values)``, as double, null for a key without values. Null keys form a group like any
    other; null, NaN and infinite values count in ``n`` only. An empty input gives no rows.
    """
    if not probs or not all(0 < p <= 1 for p in probs):
        raise ValueError("probabilities must be in (0, 1]")
    keys = list(keys)
    v = F.col(value).cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    base = rows.select(*keys, F.when(finite, v + F.lit(0.0)).alias("v_")).groupBy(*keys, "v_").agg(F.count(F.lit(1)).alias("c_"))
    base = store(base.withColumn("u_", ordered(F.col("v_"))), "counted").df
    known = base.where("v_ IS NOT NULL")

    def histogram(counts: DataFrame, shift: int, *more: Column) -> DataFrame:
        merged = counts.groupBy(*keys, *more, F.shiftright("u_", shift).alias("bin"))
        return merged.agg(F.sum("c_").alias("c"), F.min("v_").alias("lo"), F.max("v_").alias("hi"))

    totals = base.groupBy(*keys).agg(F.sum("c_").alias("n"), F.coalesce(F.sum(F.when(F.col("v_").isNotNull(), F.col("c_"))), F.lit(0)).cast("bigint").alias("n_values"))
    totals = store(totals, "totals").df
    ps = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p")
    rank = F.greatest(F.ceil(F.col("p") * F.col("n_values") - F.lit(1e-9)), F.lit(1)).alias("r")
    targets = totals.where("n_values > 0").select(*keys, "n_values", ps).select(*keys, "p", rank)
    found = []
    at = store(_locate(histogram(known, SHIFTS[0]), targets, keys), "ranks").df
    for before, shift in zip(SHIFTS, SHIFTS[1:]):
        found.append(at.where("lo_new = hi_new").select(*keys, "p", F.col("lo_new").alias("q")))
        open_ = at.where("lo_new < hi_new").select(*keys, "p", "r", F.shiftright(ordered(F.col("lo_new")), before).alias("of_"))
        parts = open_.select(*keys, "of_").distinct()
        n = parts.count()
        if not n:
            break
        inside = known.withColumn("of_", F.shiftright("u_", before))
        if n <= BROADCAST_ROWS:  # spares counting what no rank needs
            inside = inside.join(F.broadcast(parts), _same(inside, parts, [*keys, "of_"]), "left_semi")
        at = store(_locate(histogram(inside, shift, F.col("of_")), open_, [*keys, "of_"]), "ranks").df
    else:
        found.append(at.select(*keys, "p", F.col("lo_new").alias("q")))
    every = reduce(DataFrame.unionByName, found)
    names = {p: f"q{p * 100:g}".replace(".", "_") for p in probs}
    wide = every.groupBy(*keys).agg(*[F.max(F.when(F.col("p") == F.lit(float(p)), F.col("q"))).alias(name) for p, name in names.items()])
    joined = totals.join(wide, _same(totals, wide, keys), "left")
    return joined.select(*[totals[k] for k in keys], "n", "n_values", *names.values())
