import pytest
from pyspark.sql import functions as F

from loomfit.functions.hashing import hashed, owners, partitions, units
from loomfit.session import store

# Ids and their hashes for (salt 0, n 4), (salt 3, n 4), (salt 0, n 2500000).
GOLDEN = [(0, 0, 2, 0), (1, 3, 3, 265127), (42, 1, 1, 34813), (1499, 0, 0, 1317200), (-7, 3, 1, 2219211), (1099511627779, 2, 3, 951874)]


def test_golden(spark, rows):
    df = spark.createDataFrame([(g[0],) for g in GOLDEN] + [(None,)], "id bigint")
    got = hashed(df, {"a": (F.col("id"), 0, 4), "b": (F.col("id"), 3, 4), "c": (F.col("id"), 0, 2_500_000)})
    assert rows(got) == sorted([*GOLDEN, (None, None, None, None)], key=str)
    with pytest.raises(ValueError):
        hashed(df, {"a": (F.col("id"), -1, 4)})


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7])
def test_every_pair_is_owned_once(spark, n):
    df = spark.range(40).crossJoin(spark.range(40).withColumnRenamed("id", "r")).selectExpr("id AS left", "r AS right")
    found = store(owners(df, 2, n, "left", "right"), "pairs").df  # a filter would be pushed below the steps of the hash
    got = [found.where(f"rotation = {k}").count() for k in range(n)]
    assert sum(got) == 1600 and min(got) > 0.3 * 1600 / n
    parts = partitions(df, 2, 0, n, "left", "right").groupBy("right_part").count().count()
    assert parts == n and all(a <= n for a in units(n))
    for k in range(n):  # the solved rotation is the one in which both ids are dealt to the pair's partition
        here = partitions(found.where(f"rotation = {k}"), 2, k, n, "left", "right")
        assert here.where("left_part <> right_part OR left_part <> part").count() == 0
