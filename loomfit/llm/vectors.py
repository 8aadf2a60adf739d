"""Reading of trained vectors, shared by the operators on similar vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomfit.session import small, store

#: Coordinates of a sound vector; one more value holds the bias.
DIM = 48
SIMILAR = 0.9
#: Unit coordinates are kept as 16-bit numbers: similarities are right to about 1e-5.
SCALE = 32_767


def lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of every list of a column in its flat values; 0 for null."""
    offsets = np.asarray(col.offsets)
    return offsets[:-1], np.where(np.asarray(col.is_valid()), np.diff(offsets), 0)


def unit_rows(f: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the usable vectors of a list column, and their first ``DIM`` values scaled to length 1.

    Usable: ``DIM + 1`` finite values, the first ``DIM`` not all zero.
    """
    start, size = lists(f)
    rows = np.flatnonzero(size == DIM + 1)
    values = f.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    x = values[start[rows][:, None] + np.arange(DIM + 1)] if len(rows) else np.empty((0, DIM + 1))
    ok = np.isfinite(x).all(1) & (x[:, :DIM] != 0).any(1)
    rows, x = rows[ok], x[ok, :DIM]
    x = x / np.abs(x).max(axis=1, keepdims=True)  # lengths may be extreme
    return rows, x / np.linalg.norm(x, axis=1, keepdims=True)


def binary(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    x = np.ascontiguousarray(x)
    offsets = np.arange(len(x) + 1, dtype=np.int32) * (x.nbytes // len(x) if len(x) else 0)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)])


def from_binary(col: pa.Array, kind: type, width: int) -> np.ndarray:
    """The matrix of :func:`binary`, for a column without nulls."""
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data.view(kind).reshape(len(col), width)


def by_group(batches: Iterator[pa.RecordBatch], keys: int, kind: type = np.int16) -> Iterator[list[tuple[np.ndarray, ...]]]:
    """Lists of whole groups of rows sorted by the first ``keys`` columns; the last column is a binary vector of
    ``kind``, all others are numbers. A group may go on over batches; its rows are its columns.
    """
    held: list[tuple[np.ndarray, ...]] = []

    def cut(parts: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
        cols = [np.concatenate(c) for c in zip(*parts)]
        new = np.zeros(len(cols[0]) - 1, bool)
        for c in cols[:keys]:
            new |= c[1:] != c[:-1]
        at = np.r_[0, np.flatnonzero(new) + 1, len(cols[0])]
        return [tuple(c[lo:hi] for c in cols) for lo, hi in zip(at[:-1], at[1:])]

    for b in batches:
        if not b.num_rows:
            continue
        *numbers, q = b.columns
        held.append((*(c.to_numpy() for c in numbers), from_binary(q, kind, DIM)))
        groups = cut(held)
        held = [tuple(c.copy() for c in groups.pop())]
        if groups:
            yield groups
    if held:
        yield cut(held)


def directions(item_data: DataFrame) -> DataFrame:
    """``type, id, q, x`` of the usable vectors as delivered: ``q`` has the unit coordinates as 16-bit numbers, ``x`` the
    first ``DIM`` values themselves as floats.

    Rows with null type or id are left out; rows may repeat. If one (type, id) has unequal usable vectors, that with
    the largest hash counts; the check moves hashes only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = unit_rows(b.column(2))
            q = np.rint(x * SCALE).astype(np.int16)
            take = pa.array(rows)
            start, _ = lists(b.column(2))
            raw = b.column(2).values.cast(pa.float32()).to_numpy(zero_copy_only=False)[start[rows][:, None] + np.arange(DIM)] if len(rows) else np.empty((0, DIM), np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), binary(q), binary(raw)], ["type", "id", "q", "x"])

    known = item_data.where("type IS NOT NULL AND id IS NOT NULL").select("type", "id", "f")
    return known.mapInArrow(run, "type boolean, id bigint, q binary, x binary")


def resolved(item_data: DataFrame) -> tuple[DataFrame, DataFrame]:
    """:func:`directions` without the losing vectors, and ``type, id, h`` of every vector once (``h`` the hash of ``q``)."""
    rows = directions(item_data)
    seen = rows.select("type", "id", F.xxhash64("q").alias("h")).groupBy("type", "id").agg(F.max("h").alias("h"), F.min("h").alias("low"))
    seen = store(seen, "vectors").df
    lost = seen.where("low <> h").select("type", "id", F.col("h").alias("keep"))
    n = lost.count()
    if n:
        rows = rows.join(small(lost, n), ["type", "id"], "left").where("keep IS NULL OR keep = xxhash64(q)").drop("keep")
    return rows, seen.select("type", "id", "h")


def exact_similarities(item_data: DataFrame, seen: DataFrame, pairs: DataFrame) -> DataFrame:
    """``type, v, u, exact``: the similarity of few pairs ``type, v, u`` from the vectors as delivered, in double precision.

    ``seen`` is the second result of :func:`resolved`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = unit_rows(b.column(2))
            take = pa.array(rows)
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * DIM), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), binary(np.rint(x * SCALE).astype(np.int16)), values], ["type", "id", "q", "x"])

    ids = pairs.select("type", F.explode(F.array("v", "u")).alias("id")).distinct()
    n = ids.count()
    known = item_data.where("type IS NOT NULL AND id IS NOT NULL").select("type", "id", "f").join(small(ids, n), ["type", "id"], "left_semi")
    rows = known.mapInArrow(run, "type boolean, id bigint, q binary, x array<double>").withColumn("h", F.xxhash64("q"))
    kept = seen.join(small(ids, n), ["type", "id"], "left_semi")
    rows = rows.join(small(kept, n), ["type", "id", "h"], "left_semi").groupBy("type", "id").agg(F.max("x").alias("x"))
    rows = store(rows, "exact").df
    for c in ("v", "u"):
        pairs = pairs.join(small(rows.select("type", F.col("id").alias(c), F.col("x").alias(f"{c}_x")), n // 8), ["type", c])
    return pairs.select("type", "v", "u", F.aggregate(F.zip_with("v_x", "u_x", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b).alias("exact"))


def shared_vectors(seen: DataFrame, most: int) -> DataFrame:
    """``type, id, rep, place, n`` of the ids whose vector others have too.

    ``rep`` is the group's smallest id, ``n`` its size; ``place`` ranks its ``most`` smallest ids and is null for others.
    """
    w = Window.partitionBy("type", "h")
    groups = store(seen.groupBy("type", "h").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("rep")).where("n > 1"), "groups").df
    # few groups go to all tasks, so that one with many ids stays spread
    top = seen.join(small(groups, groups.count()), ["type", "h"])
    # a limit on the rank is applied before the shuffle too, so a large group sends few rows
    first = top.withColumn("place", F.row_number().over(w.orderBy("id"))).where(F.col("place") <= most).select("type", "id", "place")
    return top.join(first, ["type", "id"], "left").select("type", "id", "rep", "place", "n")
