"""Most frequent items among billions: exact top-k by the three-phase threshold method.

Every task is a node that holds local counts. Phase 1 adds up the nodes' local leaders, which gives a lower bound
for the k-th largest total. Phase 2 fetches every local count above the bound's share per node: an item that
reaches the bound must exceed that share somewhere. Phase 3 fetches the candidates' counts from all nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomfit.session import small, store

#: Distinct items a node holds at most. A task with more of them becomes several nodes, one after another.
NODE_ITEMS = 4_000_000
NODE_SCHEMA = "node bigint, item bigint, c bigint"


def merge_counts(ids: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sum the counts of equal ids; ids come out sorted."""
    i, c = np.concatenate(ids), np.concatenate(counts)
    order = np.argsort(i, kind="stable")
    i, c = i[order], c[order]
    starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.empty(0, np.int64)
    return i[starts], np.add.reduceat(c, starts) if len(i) else c


def node_counts(values: DataFrame, skip_zero_and_null: bool = False) -> DataFrame:
    """Local counts of the only column of ``values`` (BIGINT or ARRAY<BIGINT>), without a shuffle.

    Columns: ``node, item, c``. Nulls are counted as item null, unless ``skip_zero_and_null`` leaves them and 0 out.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = nulls = 0

        def out(i: np.ndarray, c: np.ndarray, nulls: int) -> pa.RecordBatch:
            item = pa.concat_arrays([pa.array(i, pa.int64()), pa.nulls(int(nulls > 0), pa.int64())])
            c = np.r_[c, [nulls] if nulls else []].astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(c), part << 20 | run, np.int64)), item, pa.array(c)], ["node", "item", "c"])

        for b in batches:
            col = b.column(0)
            if pa.types.is_list(col.type) or pa.types.is_large_list(col.type):
                col = col.flatten()
            if not skip_zero_and_null:
                nulls += col.null_count
            x = col.drop_null().to_numpy(zero_copy_only=False)
            if skip_zero_and_null:
                x = x[x != 0]
            i, c = np.unique(x, return_counts=True)
            ids.append(i)
            counts.append(c.astype(np.int64))
            held += len(i)
            if held > NODE_ITEMS:
                i, c = merge_counts(ids, counts)
                ids, counts, held = [i], [c], len(i)
                if held > NODE_ITEMS // 2:
                    yield out(i, c, nulls)
                    run, ids, counts, held, nulls = run + 1, [], [], 0, 0
        if ids:
            i, c = merge_counts(ids, counts)
            if len(i) or nulls:
                yield out(i, c, nulls)

    return values.mapInArrow(count, NODE_SCHEMA)


def top_items(local: DataFrame, k: int, share: float = 0.0) -> DataFrame:
    """The k most frequent items over all nodes, of those with at least ``share`` of the total.

    ``local`` is what :func:`node_counts` returns. Columns: ``item, n, total``. Ties at rank k all stay. An empty
    input gives no rows; null is part of the total but never an item.
    """
    if k < 1:
        raise ValueError("k must be positive")
    spark = local.sparkSession
    kept = store(local, "node_counts")
    whole = kept.df.agg(F.sum("c").alias("n"), F.countDistinct("node").alias("m")).first()
    total, m = whole["n"] or 0, max(1, whole["m"] or 0)
    items = kept.df.where("item IS NOT NULL")
    # Phase 1: local leaders, and the k-th largest of their sums as lower bound.
    w = Window.partitionBy("node").orderBy(F.col("c").desc(), "item")
    leaders = items.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    sums = leaders.groupBy("item").agg(F.sum("c").alias("low")).orderBy(F.col("low").desc()).limit(k)
    lows = sums.agg(F.min("low").alias("low"), F.count(F.lit(1)).alias("n")).first()
    bound = max(1, int(np.ceil(share * total - 1e-9)), lows["low"] if lows["n"] == k else 1)
    # Phase 2: all local counts above the bound's share. A node that sent nothing holds less than the share.
    part = items.where(F.col("c") * m >= bound).groupBy("item").agg(F.sum("c").alias("low"), F.count(F.lit(1)).alias("sent"))
    part = store(part.where(F.col("low") * m + (m - F.col("sent")) * F.lit(bound) >= F.lit(bound) * m).select("item"), "candidates")
    # Phase 3: the candidates' counts of all nodes.
    exact = items.join(small(part.df, part.count()), "item", "left_semi").groupBy("item").agg(F.sum("c").alias("n"))
    exact = exact.where(F.col("n") >= bound).withColumn("r", F.rank().over(Window.orderBy(F.col("n").desc())))
    return exact.where(F.col("r") <= k).select("item", "n", F.lit(total).cast("bigint").alias("total"))


def distinct_ratings(ratings: DataFrame) -> DataFrame:
    """One row per non-null ``rating_id``, with the item of the latest delivery."""
    at = F.struct(F.col("loaded_at").isNotNull().alias("known"), "loaded_at", "item")
    return ratings.where("rating_id IS NOT NULL").groupBy("rating_id").agg(F.max_by("item", at).alias("item"))
