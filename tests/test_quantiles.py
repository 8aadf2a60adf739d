import math
import random

import pytest

from loomfit.operators import quantiles
from loomfit.operators.quantiles import keyed_quantiles


def brute(rows, p):
    by = {}
    for k, v in rows:
        by.setdefault(k, [0, []])
        by[k][0] += 1
        if v is not None and math.isfinite(v):
            by[k][1].append(v)
    return sorted(((k, n, len(v), *[sorted(v)[max(1, math.ceil(q * len(v) - 1e-9)) - 1] if v else None for q in p]) for k, (n, v) in by.items()), key=str)


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_equals_brute_force(spark, rows, monkeypatch, broadcast):
    monkeypatch.setattr(quantiles, "BROADCAST_ROWS", broadcast)
    rng = random.Random(2)
    data = [(1, rng.gauss(0, 1e6)) for _ in range(700)] + [(2, rng.choice([0.25, 0.3, 1e300, -1e300])) for _ in range(60)]
    data += [(rng.randrange(3, 9), rng.random()) for _ in range(80)] + [(None, 4.0), (None, None), (50, None), (51, float("nan")), (51, float("inf")), (52, -0.0), (52, 0.0)]
    df = spark.createDataFrame([(k, v, "x") for k, v in data], "key bigint, v double, n string").select("key", "v")
    p = (0.01, 0.5, 1.0)
    assert rows(keyed_quantiles(df, ["key"], "v", p)) == brute(data, p)


def test_empty_and_bad_probability(spark):
    df = spark.createDataFrame([], "key bigint, v double")
    assert keyed_quantiles(df, ["key"], "v", [0.5]).count() == 0
    with pytest.raises(ValueError):
        keyed_quantiles(df, ["key"], "v", [0.0])


def test_ordered_numbers_keep_the_order(spark):
    rng = random.Random(3)
    x = sorted({0.0, 1.0, 2.0, 0.5, 1e-310, 5e-324, 2.0**-1022, 1.7976931348623157e308, *(s * 2.0**e * (1 + d) for s in (1, -1) for e in range(-1070, 1020, 37) for d in (0, 2**-52, 1 - 2**-52)), *(rng.gauss(0, 10.0 ** rng.randrange(-9, 9)) for _ in range(300))})
    df = spark.createDataFrame([(v,) for v in x], "v double")
    got = [r["u"] for r in df.select("v", quantiles.ordered(df["v"]).alias("u")).orderBy("v").collect()]
    assert all(a < b for a, b in zip(got, got[1:]))


def test_many_open_keys_and_a_hot_one(spark, rows, monkeypatch):
    """More open bins than may be sent to all tasks, and a key with a third of the rows, all values unequal."""
    monkeypatch.setattr(quantiles, "BROADCAST_ROWS", 100)
    rng = random.Random(5)
    data = [(k % 600 if k % 3 else -1, 1 + rng.random() / 1000) for k in range(6_000)]
    df = spark.createDataFrame(data, "key bigint, v double")
    assert rows(keyed_quantiles(df, ["key"], "v", (0.25, 0.5))) == brute(data, (0.25, 0.5))
