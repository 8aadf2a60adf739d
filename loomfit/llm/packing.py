"""Documents packed into containers of fixed capacity, neighbours along a space-filling curve together.

A document's tokens are hashed to a vector that is projected to a few dimensions; its cell's place on the Hilbert
curve is the sort key. Range-sorted documents are packed in short windows along the curve, each item into the fullest
container that takes it; a few containers with room stay open for the next window, so what is in one lies close on the curve.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfit.llm.tokens import RANKS, encode, encoder, rank_file, texts
from loomfit.session import store, tasks

CAPACITY = 4_096
DIMS, BITS = 4, 10
#: Documents packed together, and containers that stay open from one window to the next.
WINDOW, OPEN = 64, 8
#: Documents along the curve that a task packs; every task's last open containers are not filled up.
TASK = 20_000
SEED = 7


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of integer coordinates below ``2 ** bits``.

    The known transpose form: undo excess rotations from the highest bit down, Gray-encode, interleave the bits.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            up = (x[i] >> b & 1).astype(bool)
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[n - 1] >> b & 1, (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def curve_keys(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """``id_col, size, place``: each document's tokens and its place on the curve (0 for an empty or null text)."""
    file = rank_file(df.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(file.value)
        plane = np.random.default_rng(SEED).standard_normal((enc.n_vocab, DIMS), np.float32)
        for b in batches:
            size = np.zeros(b.num_rows, np.int64)
            at = np.zeros((b.num_rows, DIMS), np.float32)
            for k, text in enumerate(texts(b.column(1))):
                ids = encode(enc, text)
                size[k] = len(ids)
                at[k] = plane[ids].sum(0) if ids else 0
            unit = at / np.maximum(np.linalg.norm(at, axis=1, keepdims=True), 1e-9)
            cells = np.clip((unit + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1)
            place = np.where(size > 0, hilbert(cells, BITS), 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(place)], [id_col, "size", "place"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).alias("text_")).mapInArrow(run, f"`{id_col}` {kind}, size bigint, place bigint")


def fill(sizes: np.ndarray, capacity: int, room: list[tuple[int, int]], new: Iterator[int]) -> np.ndarray:
    """The container of every item, none larger than ``capacity``, largest first into the fullest that takes it.

    ``room`` holds (free space, container) of the open containers in ascending order and is updated; ``new`` gives the
    numbers of containers to open.
    """
    out = np.empty(len(sizes), np.int64)
    for k in np.argsort(-sizes, kind="stable"):
        need = int(sizes[k])
        i = bisect_left(room, (need, -1))
        free, box = room.pop(i) if i < len(room) else (capacity, next(new))
        out[k] = box
        insort(room, (free - need, box))
    return out


def pack(sized: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Rows ``container, id_col, piece, start, size``: where each piece of each document lies.

    Documents of up to ``capacity`` tokens are one piece. A longer one is cut into full containers of its own and a
    rest, which is packed like a document. A document without tokens takes no space and still has a row. ``sized``
    has ``id_col, size, place``.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = iter(range(TaskContext.get().partitionId() << 40, (TaskContext.get().partitionId() + 1) << 40))
        room: list[tuple[int, int]] = []
        held: list[pa.RecordBatch] = []
        n = 0

        def packed() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            size = t["size"].to_numpy()
            whole = np.maximum(0, -(-size // capacity) - 1)  # the last piece is packed, full or not
            box = []
            for lo in range(0, len(size), WINDOW):
                box.append(fill((size - whole * capacity)[lo : lo + WINDOW], capacity, room, new))
                del room[: max(0, len(room) - OPEN)]
            box = np.concatenate(box)
            row = np.repeat(np.arange(len(size)), whole + 1)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(whole + 1) - whole - 1, whole + 1)
            last = piece == whole[row]
            at = np.where(last, box[row], -1)
            at[~last] = [next(new) for _ in range(int((~last).sum()))]
            took = np.where(last, (size - whole * capacity)[row], capacity)
            ids = t[id_col].combine_chunks()
            ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
            return pa.RecordBatch.from_arrays([pa.array(at), ids.take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(took)], ["container", id_col, "piece", "start", "size"])

        for b in batches:
            while b.num_rows:
                part = b.slice(0, 64 * WINDOW - n)
                b = b.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == 64 * WINDOW:
                    yield packed()
                    held.clear()
                    n = 0
        if n:
            yield packed()

    kind = sized.schema[id_col].dataType.simpleString()
    ordered = sized.repartitionByRange(tasks(sized.count(), TASK), "place", id_col).sortWithinPartitions("place", id_col)
    return ordered.select(id_col, "size").mapInArrow(run, f"container bigint, `{id_col}` {kind}, piece int, start bigint, size bigint")


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, capacity: int = CAPACITY) -> DataFrame:
    """Encode, place on the curve and pack. The sizes are stored, so texts are encoded once."""
    return pack(store(curve_keys(df, id_col, text_col, ranks), "sizes").df, id_col, capacity)
