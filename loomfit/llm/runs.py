"""Runs of repeated events in sequences, collapsed by pointer doubling.

An event that repeats the one before it points to it. A self-join replaces every pointer by its target's pointer;
after logarithmically many rounds all point to the starts of their runs. Sequences whose runs are resolved leave
the joins, so the rounds shrink. The joins' keys are single events, which spreads one huge sequence over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomfit.session import BROADCAST_ROWS, small, store

#: Longest time in seconds from one event of a run to the next.
MAX_GAP = 600
LINKS = "seq_id bigint, dup bigint, pos int, ptr int, t int, t0 int, id bigint, before bigint"
KEY = ["seq_id", "dup"]


def roots(alias: DataFrame) -> DataFrame:
    """``alias, root``: every alias followed to its end, by pointer doubling.

    Null or own item: the alias stands for itself and has no row. Of several rows the one with the latest
    ``since`` counts, then the smaller item. Cycles do not occur; one would end the rounds undecided.
    """
    latest = Window.partitionBy("alias").orderBy(F.col("since").desc_nulls_last(), F.col("item").asc_nulls_last())
    cur = alias.where("alias IS NOT NULL").withColumn("r_", F.row_number().over(latest)).where("r_ = 1")
    now = store(cur.where("item IS NOT NULL AND item <> alias").select("alias", F.col("item").alias("root")), "alias")
    for _ in range(63):
        to = now.df.select(F.col("alias").alias("root"), F.col("root").alias("next"))
        step = now.df.join(to, "root", "left").select("alias", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        done = store(step, "alias")
        moved = done.df.where("moved").count()
        now.drop()
        now = done
        now.df = done.df.select("alias", "root")
        if not moved:
            break
    return now.df


def links(copies: DataFrame, known: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """One row per event that may continue the one before it, where the time allows that.

    ``pos`` and ``ptr`` are the array positions of the event and of the one before (null and 0 left out), ``t`` and
    ``t0`` their times, ``id`` and ``before`` their ids. With ``known`` (sorted aliases, roots) only pairs that stand for
    the same item are kept; without, all pairs.
    """
    spark = copies.sparkSession
    shared = spark.sparkContext.broadcast(known)

    def same(x: np.ndarray) -> np.ndarray:
        a, root = shared.value
        if not len(a):
            return x
        k = np.minimum(np.searchsorted(a, x), len(a) - 1)
        return np.where(a[k] == x, root[k], x)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sid, dup, seq, secs = b.columns
            start = np.asarray(seq.offsets)[:-1]
            size = np.where(np.asarray(seq.is_valid()), np.diff(np.asarray(seq.offsets)), 0)
            row = np.repeat(np.arange(len(seq)), size)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            at = np.repeat(start, size) + pos
            x = seq.values.fill_null(0).to_numpy(zero_copy_only=False)[at]
            held = np.where(np.asarray(secs.is_valid()), np.diff(np.asarray(secs.offsets)), 0)[row]
            times = secs.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
            t = np.full(len(row), np.nan)
            timed = pos < held
            t[timed] = times[(np.asarray(secs.offsets)[:-1][row] + pos)[timed]]
            k = np.flatnonzero(x != 0)
            row, pos, x, t = row[k], pos[k], x[k], t[k]
            gap = t[1:] - t[:-1]
            ok = (row[1:] == row[:-1]) & ~(gap > MAX_GAP)
            if shared.value is not None:
                r = same(x)
                ok &= r[1:] == r[:-1]
            i = np.flatnonzero(ok)
            if not len(i):
                continue
            j = pa.array(row[i + 1])
            time = lambda v: pa.array(np.nan_to_num(v).astype(np.int32), mask=np.isnan(v))
            yield pa.RecordBatch.from_arrays([sid.take(j), dup.take(j), pa.array(pos[i + 1].astype(np.int32)), pa.array(pos[i].astype(np.int32)), time(t[i + 1]), time(t[i]), pa.array(x[i + 1]), pa.array(x[i])], LINKS.replace(",", "").split()[::2])

    return copies.select("seq_id", "dup", "sequence", "secs").mapInArrow(scan, LINKS)


def repeated_links(copies: DataFrame, alias: DataFrame) -> DataFrame:
    """Links between events that stand for the same item. The aliases are sent to all tasks only if few enough."""
    root = roots(alias)
    n = root.count()
    if n <= BROADCAST_ROWS:
        got = root.orderBy("alias").toArrow()
        known = tuple(got.column(c).to_numpy() for c in ("alias", "root"))
        return links(copies, known)
    every = links(copies, None)
    other = every.where("id <> before")
    for c in ("id", "before"):
        other = other.join(root.select(F.col("alias").alias(c), F.col("root").alias(f"{c}_root")), c, "left")
    return every.where("id = before").unionByName(other.where("coalesce(id_root, id) = coalesce(before_root, before)").select(every.columns))


def collapse(found: DataFrame) -> DataFrame:
    """Runs of linked events. Columns ``seq_id, dup, first_pos, last_pos, n, duration``.

    ``found`` has ``seq_id, dup, pos, ptr, t, t0``: one row per event that repeats the event at ``ptr``. ``duration`` is
    the last event's time less the first's; null if either is unknown.
    """
    cur = store(found.select(*KEY, "pos", "ptr", "t", "t0", F.lit(False).alias("moved")), "runs").df
    done = []
    while True:
        to = cur.select(*[F.col(c).alias(f"{c}_") for c in KEY], F.col("pos").alias("at_"), F.col("ptr").alias("ptr_"), F.col("t0").alias("t0_"))
        on = [F.col("seq_id").eqNullSafe(F.col("seq_id_")), F.col("dup") == F.col("dup_"), F.col("ptr") == F.col("at_")]
        hit = F.col("at_").isNotNull()
        step = cur.join(to, reduce(lambda a, b: a & b, on), "left").select(*KEY, "pos", F.coalesce("ptr_", "ptr").alias("ptr"), "t", F.when(hit, F.col("t0_")).otherwise(F.col("t0")).alias("t0"), hit.alias("moved"))
        now = store(step, "runs").df
        live = store(now.where("moved").select(*[F.col(c).alias(f"{c}_") for c in KEY]).distinct(), "live")
        n = live.count()
        if not n:
            done.append(now)
            break
        keys = small(live.df, n)
        same = F.col("seq_id").eqNullSafe(F.col("seq_id_")) & (F.col("dup") == F.col("dup_"))
        done.append(now.join(keys, same, "left_anti"))
        cur = now.join(keys, same, "left_semi")
    rows = reduce(DataFrame.unionByName, done)
    return rows.groupBy(*KEY, F.col("ptr").alias("first_pos")).agg(F.max("pos").alias("last_pos"), (F.count(F.lit(1)) + 1).alias("n"), (F.max_by("t", "pos") - F.max_by("t0", "pos")).alias("duration"))
