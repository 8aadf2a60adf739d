"""Items that appear together: pair counts over baskets, and their association.

A basket of more than ``CHUNK`` items is split into chunks; every pair of its chunks is a row of its own, dealt over
all tasks. Ordinary baskets and chunk pairs go through one vectorized kernel. Pairs that cannot reach the
thresholds because of their items' own counts are dropped before the shuffle, which loses no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfit.llm.shared import is_id
from loomfit.session import store

#: Items of a basket that are paired in one piece.
CHUNK = 256
#: An item is hot if it is in more than 1 / HOT of all item-basket rows. There are at most HOT such items.
HOT = 4_000
#: Pairs held by a task before they are added up.
BLOCK_PAIRS = 1_500_000


def baskets(copies: DataFrame) -> DataFrame:
    """``items``: the distinct ids of each non-empty sequence, sorted; null and 0 left out."""
    ids = F.array_sort(F.array_distinct(F.filter("sequence", is_id)))
    return copies.where(F.size("sequence") >= 1).select(ids.alias("items"))


def _pieces(kept: DataFrame) -> DataFrame:
    """Rows ``a, b``: all pairs within ``a`` if ``b`` is null, else all pairs of an item of ``a`` and one of ``b``.

    A large basket leaves its task as chunks, each once. The chunks, dealt over all tasks, make a copy for every pair they are
    in, and the two of a pair meet by basket and chunk numbers: no task sees more than a few chunks of a basket.
    """
    none = F.lit(None).cast("array<bigint>")
    plain = kept.where(F.size("items").between(2, CHUNK)).select(F.col("items").alias("a"), none.alias("b"))
    n = F.ceil(F.size("items") / F.lit(CHUNK)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice("items", k * CHUNK + 1, CHUNK))
    large = kept.where(F.size("items") > CHUNK).select(F.monotonically_increasing_id().alias("basket"), n.alias("n"), cut.alias("chunks"))
    large = large.select("basket", "n", F.posexplode("chunks").alias("i", "x"))
    chunks = store(large, "chunks").df.repartition("basket", "i")
    each = chunks.select("basket", "i", "x", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("o"))
    each = each.select("basket", F.least("i", "o").alias("lo"), F.greatest("i", "o").alias("hi"), "i", "x")
    mine = lambda c: F.max(F.when(F.col("i") == F.col(c), F.col("x")))
    two = each.groupBy("basket", "lo", "hi").agg(mine("lo").alias("a"), mine("hi").alias("b"))
    return plain.unionByName(two.select("a", F.when(F.col("lo") != F.col("hi"), F.col("b")).alias("b")))


def pair_counts(kept: DataFrame, hot: tuple[np.ndarray, np.ndarray], cold: int, min_jaccard: float, max_count: float) -> DataFrame:
    """``id_a, id_b, c``: numbers of common baskets, partly added up, of the pairs that can reach ``min_jaccard``.

    ``hot`` has the hot items and their counts, all others are in at most ``cold`` baskets. A pair whose counts differ
    by more than a factor ``1 / min_jaccard`` cannot qualify, nor can an item in more than ``max_count`` baskets.
    """
    shared = kept.sparkSession.sparkContext.broadcast(hot)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts = shared.value
        left: list[np.ndarray] = []
        right: list[np.ndarray] = []
        held = 0

        def out() -> pa.RecordBatch:
            a, b = np.concatenate(left), np.concatenate(right)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            s = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            return pa.RecordBatch.from_arrays([pa.array(a[s]), pa.array(b[s]), pa.array(np.diff(np.r_[s, len(a)]).astype(np.int64))], ["id_a", "id_b", "c"])

        def add(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> int:
            # na and nb: exact counts of hot items, 0 for the others, of which only the upper bound is known
            high, low = np.maximum(na, nb), np.minimum(na, nb)
            ok = np.where(low > 0, low, cold) >= min_jaccard * high * (1 - 1e-9)
            a, b = a[ok], b[ok]
            left.append(np.minimum(a, b))
            right.append(np.maximum(a, b))
            return len(a)

        def of(x: np.ndarray) -> np.ndarray:
            if not len(ids):
                return np.zeros(len(x), np.int64)
            k = np.minimum(np.searchsorted(ids, x), len(ids) - 1)
            return np.where(ids[k] == x, counts[k], 0)

        for batch in batches:
            a, b = batch.columns
            av, ao = a.values.to_numpy(), np.asarray(a.offsets)
            n, size = of(av), np.diff(ao)
            two = np.asarray(b.is_valid())
            for s in np.unique(size[~two]):
                first = ao[:-1][~two & (size == s)]
                i, j = np.triu_indices(s, 1)
                step = max(1, BLOCK_PAIRS // max(1, len(i)))
                for k in range(0, len(first), step):
                    x, y = (first[k : k + step, None] + i).ravel(), (first[k : k + step, None] + j).ravel()
                    fit = (n[x] <= max_count) & (n[y] <= max_count)
                    x, y = x[fit], y[fit]
                    held += add(av[x], av[y], n[x], n[y])
                    if held >= BLOCK_PAIRS:
                        yield out()
                        left.clear(), right.clear()
                        held = 0
            if two.any():
                bv, bo = b.values.to_numpy(), np.asarray(b.offsets)
                m = of(bv)
                for r in np.flatnonzero(two):
                    x, y = np.arange(ao[r], ao[r + 1]), np.arange(bo[r], bo[r + 1])
                    x, y = x[n[x] <= max_count], y[m[y] <= max_count]
                    x, y = np.repeat(x, len(y)), np.tile(y, len(x))
                    held += add(av[x], bv[y], n[x], m[y])
                    if held >= BLOCK_PAIRS:
                        yield out()
                        left.clear(), right.clear()
                        held = 0
        if held:
            yield out()

    return _pieces(kept).mapInArrow(scan, "id_a bigint, id_b bigint, c bigint")


def appear_together(copies: DataFrame, min_pair: int = 6, min_jaccard: float = 0.2, min_lift: float = 5.0) -> DataFrame:
    """Pairs of ids in at least ``min_pair`` common sequences, above both thresholds.

    Columns ``id_a, id_b, n_ab, n_a, n_b, n, jaccard, lift, pmi``; ``n`` counts sequences with at least one element of any
    kind. An id counts once per sequence. Empty input: no rows.
    """
    kept = store(baskets(copies), "baskets").df
    n = kept.count()
    counts = store(kept.select(F.explode("items").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("c")), "basket_counts").df
    total = counts.agg(F.sum("c")).first()[0] or 0
    cold = total // HOT
    got = counts.where(F.col("c") > cold).orderBy("id").toArrow()
    hot = tuple(got.column(c).to_numpy() for c in ("id", "c"))
    pairs = pair_counts(kept, hot, cold, min_jaccard, n / min_lift).groupBy("id_a", "id_b").agg(F.sum("c").alias("n_ab")).where(F.col("n_ab") >= min_pair)
    for side in ("a", "b"):
        pairs = pairs.join(counts.select(F.col("id").alias(f"id_{side}"), F.col("c").alias(f"n_{side}")), f"id_{side}")
    full = pairs.withColumn("n", F.lit(n).cast("bigint"))
    full = full.withColumn("jaccard", F.col("n_ab") / (F.col("n_a") + F.col("n_b") - F.col("n_ab"))).withColumn("lift", F.col("n_ab").cast("double") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b")))
    enough = (F.col("jaccard") >= min_jaccard) & (F.col("n_ab").cast("double") * F.col("n") >= F.lit(float(min_lift)) * F.col("n_a") * F.col("n_b"))
    return full.where(enough).withColumn("pmi", F.log2("lift")).select("id_a", "id_b", "n_ab", "n_a", "n_b", "n", "jaccard", "lift", "pmi")
