"""Pairs packed into binary pieces, so that a shuffle or sort moves one row for hundreds of pairs.

A piece belongs to one cell, such as a partition of a rotation, and has at most ``PIECE`` pairs: ``n`` of them, their ids as
``left`` and ``right`` in 8 bytes each and floats in 4 bytes each, or null if all are null. Pieces have no order of their
own. The order of training is that of :func:`keys`, which depends on nothing but the pairs and the salt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Most pairs of a piece: a reader's 4,096 rows are then at most 50 MB.
PIECE = 512
#: Pairs a task holds at once.
BLOCK = 1 << 20
#: Bits of a null float, a NaN that no calculation makes.
NULL = np.uint32(0x7FC0DEAD)
PACKED = "rotation int, part int, n bigint, left binary, right binary, label binary, weight binary"
SPLIT = "bucket int, part int, n bigint, left binary, right binary, given binary"


def keys(left: np.ndarray, right: np.ndarray, given: np.ndarray | None, salt: tuple[int, ...]) -> np.ndarray:
    """A salted 64-bit hash of each pair. ``given`` are bits of floats, None if all are null."""
    h = np.uint64(0)
    for x in (*(np.uint64(s & 0xFFFFFFFF) for s in salt), left.view(np.uint64), right.view(np.uint64), (NULL if given is None else given).astype(np.uint64)):
        with np.errstate(over="ignore"):
            h = (h ^ x) * np.uint64(0xFF51AFD7ED558CCD)
            h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        h = h ^ (h >> np.uint64(33))
    return h


def _bits(c: pa.Array) -> np.ndarray | None:
    """Bits of a float column, None if all are null."""
    if c.null_count == len(c):
        return None
    out = c.fill_null(0.0).to_numpy(zero_copy_only=False).astype(np.float32).view(np.uint32)
    return np.where(c.is_null().to_numpy(zero_copy_only=False), NULL, out) if c.null_count else out


def _joined(parts: list[np.ndarray | None], sizes: list[int]) -> np.ndarray | None:
    if all(x is None for x in parts):
        return None
    return np.concatenate([np.full(n, NULL) if x is None else x for x, n in zip(parts, sizes)])


def _pieces(cell: np.ndarray, columns: list[np.ndarray | None]) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
    """Cell and number of pairs of every piece, and the columns cut into pieces."""
    order = np.argsort(cell.astype(np.uint16) if len(cell) and cell.max() < 1 << 16 else cell, kind="stable")
    cell = cell[order]
    at = np.arange(len(cell))
    first = np.r_[True, cell[1:] != cell[:-1]]
    inside = at - np.maximum.accumulate(np.where(first, at, 0))
    cuts = np.r_[np.flatnonzero(inside % PIECE == 0), len(cell)]
    out = []
    for x in columns:
        if x is None:
            out.append(pa.nulls(len(cuts) - 1, pa.binary()))
        else:
            x = np.take(x, order)
            out.append(pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * x.itemsize).astype(np.int32)), pa.py_buffer(x)]))
    return cell[cuts[:-1]], np.diff(cuts), out


def pack(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Rows ``rotation, part, left, right, label, weight`` of ``n`` partitions to pieces of a rotation's partition."""
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        sizes = [len(x[0]) for x in held]
        cell, left, right = (np.concatenate([x[k] for x in held]) for k in range(3))
        cell, count, columns = _pieces(cell, [left, right, *(_joined([x[k] for x in held], sizes) for k in (3, 4))])
        return pa.RecordBatch.from_arrays([pa.array((cell // n).astype(np.int32)), pa.array((cell % n).astype(np.int32)), pa.array(count.astype(np.int64)), *columns], [c.split()[0] for c in PACKED.split(", ")])

    for b in batches:
        if b.num_rows:
            cell = b.column("rotation").to_numpy().astype(np.int64) * n + b.column("part").to_numpy()
            held.append((cell, b.column("left").to_numpy().copy(), b.column("right").to_numpy().copy(), _bits(b.column("label")), _bits(b.column("weight"))))
        if sum(len(x[0]) for x in held) >= BLOCK:
            yield out()
            held = []
    if held:
        yield out()


def _values(c: pa.Array, kind: type, n: np.ndarray) -> np.ndarray | None:
    """All values of a column of pieces, that have ``n`` pairs each; None if all are null."""
    if c.null_count == len(c):
        return None
    width = np.int64 if pa.types.is_large_binary(c.type) else np.int32
    ends = np.frombuffer(c.buffers()[1], width)[c.offset : c.offset + len(c) + 1]
    got = np.frombuffer(c.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind)
    if c.null_count:
        whole = np.full(int(n.sum()), NULL)
        whole[np.repeat(c.is_valid().to_numpy(zero_copy_only=False), n)] = got
        return whole
    return got


def unpack(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Pieces to their sizes, and to the left ids, right ids and given floats' bits of all their pairs."""
    n = b.column("n").to_numpy()
    return n, _values(b.column("left"), np.int64, n), _values(b.column("right"), np.int64, n), _values(b.column("given"), np.uint32, n)


def split(batches: Iterator[pa.RecordBatch], buckets: int, salt: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Pieces ``part, n, left, right, given`` to pieces of a range of keys each; the ranges are alike and in order."""
    for b in batches:
        if not b.num_rows:
            continue
        n, left, right, given = unpack(b)
        bucket = (keys(left, right, given, salt) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        cell = np.repeat(b.column("part").to_numpy().astype(np.int64), n) * buckets + bucket.astype(np.int64)
        cell, count, columns = _pieces(cell, [left, right, given])
        yield pa.RecordBatch.from_arrays([pa.array((cell % buckets).astype(np.int32)), pa.array((cell // buckets).astype(np.int32)), pa.array(count.astype(np.int64)), *columns], [c.split()[0] for c in SPLIT.split(", ")])


def ordered(batches: Iterator[pa.RecordBatch], salt: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """Pieces with ``bucket``, in order of it, to the left ids, right ids and given floats' bits of each bucket in order of keys."""
    held: list[tuple] = []
    now = -1

    def out() -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        left, right = (np.concatenate([x[k] for x in held]) for k in range(2))
        given = _joined([x[2] for x in held], [len(x[0]) for x in held])
        order = np.argsort(keys(left, right, given, salt))
        return left[order], right[order], None if given is None else given[order]

    for b in batches:
        bucket = b.column("bucket").to_numpy()
        cuts = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)]
        for k, m in zip(cuts[:-1], cuts[1:]):
            if bucket[k] != now and held:
                yield out()
                held = []
            now = bucket[k]
            held.append(tuple(None if x is None else x.copy() for x in unpack(b.slice(k, m - k))[1:]))
    if held:
        yield out()
