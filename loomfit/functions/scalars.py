"""The scalar functions of logistic factorization as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Beyond this the sigmoid is taken as 0 or 1.
SATURATION = 6.0
#: Steps of the sigmoid table over [-6, 6], and table cells per unit: 1000 // 6 halves.
SLOTS, PER_UNIT = 1000, 83.0
#: Fixed value: loss of a saturated miss, -log(sigmoid(-6)).
MISS = 6.00247569


def sigmoid(f: Column) -> Column:
    """Exact logistic function, 1 above 6 and 0 below -6."""
    exact = 1.0 / (1.0 + F.exp(-f))
    return F.when(f > SATURATION, 1.0).when(f < -SATURATION, 0.0).otherwise(exact)


def sigmoid_table(f: Column) -> Column:
    """The logistic function read from a table of ``SLOTS`` cells, as a table-driven trainer sees it."""
    slot = F.least(F.floor((f + SATURATION) * PER_UNIT), F.lit(SLOTS - 1))
    at = (slot / F.lit(float(SLOTS)) * 2 - 1) * SATURATION
    return F.when(f > SATURATION, 1.0).when(f < -SATURATION, 0.0).otherwise(1.0 / (1.0 + F.exp(-at)))


def logloss(f: Column, label: Column) -> Column:
    """Loss of score ``f`` for label 1 or 0: nothing for a saturated hit, ``MISS`` for a saturated miss."""
    z = F.when(label > 0, f).otherwise(-f)
    return F.when(z > SATURATION, 0.0).when(z < -SATURATION, MISS).otherwise(F.log1p(F.exp(-z)))


def dot(a: Column, b: Column, size: int, bias: bool = False) -> Column:
    """Inner product of the first ``size`` values, with both biases (the values after them) added if asked for."""
    product = F.zip_with(F.slice(a, 1, size), F.slice(b, 1, size), lambda x, y: x.cast("double") * y.cast("double"))
    f = F.aggregate(product, F.lit(0.0), lambda s, x: s + x)
    return f + F.get(a, F.lit(size)).cast("double") + F.get(b, F.lit(size)).cast("double") if bias else f


def axpy(scale: Column, x: Column, y: Column) -> Column:
    """``scale * x + y`` per value, in double."""
    return F.zip_with(x, y, lambda p, q: scale * p.cast("double") + q.cast("double"))
