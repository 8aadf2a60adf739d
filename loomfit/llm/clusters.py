"""Clusters of mutually similar vectors: MinHash banding, exact Jaccard, connected components, medoids.

A vector's set holds, for each of many fixed directions, the side on which the vector lies. MinHash is taken over the
directions in which it reaches furthest: similar vectors share much of these, others next to nothing. Bands of MinHash
values bring candidates together, the exact Jaccard of the whole sets verifies them, and connected components gather
them. Components of more than a block are taken apart by the similarities themselves: what no chain of similar pairs
connects is separate. Inside a component exact similarities, block by block, tell tight clusters from loose ones; the latter
are split around the vectors with most neighbours, all that are above their neighbours in a round.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomfit.llm import neighbours
from loomfit.llm.vectors import DIM, SIMILAR, binary, by_group, from_binary, resolved
from loomfit.session import Stored, small, store, tasks

#: Fixed directions, and how many of the furthest are hashed.
DIRECTIONS, FAR = 256, 24
#: Bands, and MinHash values in a band. About 0.3 % of pairs at similarity exactly 0.9 share no band, 0.1 % at 0.92.
BANDS, ROWS = 40, 2
#: Least Jaccard of a candidate pair. Sets of vectors at similarity 0.9 have about 0.75; 3 in 100,000 have less than this.
JACCARD = 0.62
#: Buckets up to ``FEW`` rows are compared row by row, larger ones by ``TILE`` rows; those over ``BUCKET`` are dealt.
FEW, TILE, BUCKET = 256, 64, 16_384
#: Counters for the sizes of the buckets; buckets that share one are dealt too early, never too late.
SLOTS = 1 << 18
#: Vectors of a component compared in one piece.
BLOCK = 1_024
#: Members with which a large component is compared before all its pairs are.
PIVOTS = 3
#: Rows of the bands that a task compares on average.
TASK = 250_000
SEED = 5


def places(q: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per band the buckets of a batch of vectors, and the words of their sign sets."""
    rng = np.random.default_rng(SEED)
    plane = rng.standard_normal((DIM, DIRECTIONS)).astype(np.float32)
    plane /= np.linalg.norm(plane, axis=0)
    mixes = rng.permuted(np.tile(np.arange(2 * DIRECTIONS, dtype=np.uint16), (BANDS * ROWS, 1)), axis=1)
    odd = rng.integers(1 << 62, size=(BANDS, ROWS), dtype=np.int64).astype(np.uint64) | np.uint64(1)
    reach = from_binary(q, np.int16, DIM).astype(np.float32) @ plane
    far = np.argpartition(-np.abs(reach), FAR - 1, axis=1)[:, :FAR]
    tokens = far * 2 + (np.take_along_axis(reach, far, 1) > 0)
    words = np.packbits(reach > 0, axis=1)
    for k in range(BANDS):
        mix = np.full(len(tokens), k * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
        for r in range(ROWS):
            mix = (mix ^ (mixes[k * ROWS + r][tokens].min(1).astype(np.uint64) + np.uint64(1))) * odd[k, r]
            mix ^= mix >> np.uint64(29)
        yield mix, words


def slot(place: np.ndarray) -> np.ndarray:
    return (place >> np.uint64(32) & np.uint64(SLOTS - 1)).astype(np.int64)


def crowded(rows: DataFrame) -> dict[int, int]:
    """Slots of buckets with more than ``BUCKET`` rows, and the blocks these are dealt in."""
    most = BUCKET

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.int64)
        for b in batches:
            if b.num_rows:
                for place, _ in places(b.column(0)):
                    n += np.bincount(slot(place), minlength=SLOTS)
        k = np.flatnonzero(n)
        for lo in range(0, len(k), 65_536):
            part = k[lo : lo + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(n[part])], ["k", "n"])

    sizes = rows.select("q").mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n"))
    return {r["k"]: -(-r["n"] * 2 // most) for r in sizes.where(F.col("n") > most).collect()}


def bands(rows: DataFrame) -> DataFrame:
    """``place, id, words``: every vector once per band. ``place`` is the bucket. A crowded bucket is dealt: its rows are in
    one block each, which follows from ``words``, and every two blocks have a place of their own.
    """
    large = crowded(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = np.ones(SLOTS, np.int64)
        parts[list(large)] = list(large.values())
        factor = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407, 0x9FB21C651E98DF25], np.uint64)
        for b in batches:
            if not b.num_rows:
                continue
            for place, words in places(b.column(1)):
                row, n = np.arange(len(place)), parts[slot(place)] if large else None
                if large and (n > 1).any():
                    with np.errstate(over="ignore"):
                        h = (words.view(np.uint64) * factor).sum(1, dtype=np.uint64)
                        mine = ((h ^ h >> np.uint64(31)) * factor[0] >> np.uint64(33)).astype(np.int64) % n
                        times = np.maximum(n - 1, 1)
                        row = np.repeat(row, times)
                        other = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                        other += other >= mine[row]
                        pair = np.minimum(mine[row], other) * n[row] + np.maximum(mine[row], other) + 1
                        place = np.where(n[row] > 1, (place[row] ^ pair.astype(np.uint64) * factor[1]) * factor[2], place[row])
                for lo in range(0, len(row), 8_192):
                    r = row[lo : lo + 8_192]
                    yield pa.RecordBatch.from_arrays([pa.array(place[lo : lo + 8_192].view(np.int64)), b.column(0).take(pa.array(r)), binary(words[r])], ["place", "id", "words"])

    return rows.select("id", "q").mapInArrow(run, "place bigint, id bigint, words binary")


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of the component of each of ``n`` nodes, by the edges ``a, b``."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        now = root.copy()
        for x in (a, b, root[a], root[b]):
            np.minimum.at(now, x, low)
        now = now[now]
        if (now == root).all():
            return root
        root = now


def linked(place: np.ndarray, w: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of row numbers that connect, within each bucket, all rows that a chain of pairs of at least this Jaccard does.

    ``place`` is sorted. Every two rows of a bucket are compared unless they are known to be connected.
    """
    cols = [np.ascontiguousarray(w[:, c]) for c in range(w.shape[1])]
    most = DIRECTIONS - 2 * DIRECTIONS * least / (1 + least) + 1e-9  # so many sides may differ

    def differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return sum(np.bitwise_count(c[a] ^ c[b]).astype(np.uint16) for c in cols)

    cut = np.r_[0, np.flatnonzero(place[1:] != place[:-1]) + 1, len(place)]
    size = np.diff(cut)
    end = np.repeat(cut[1:], size)
    left, right = [], []
    k, lag = np.flatnonzero(np.repeat(size <= FEW, size)), 1
    while len(k := k[k + lag < end[k]]):
        ok = k[differ(k, k + lag) <= most]
        left.append(ok)
        right.append(ok + lag)
        lag += 1
    for at in np.flatnonzero(size > FEW):
        rest = np.arange(cut[at], cut[at + 1])
        while len(rest) > 1:
            tile = rest[:TILE]
            near = differ(tile[:, None], rest[None]) <= most
            r, c = np.nonzero(near) if near.sum() <= 8 * len(rest) else (None, None)
            if r is not None:
                left.append(tile[r[r < c]])
                right.append(rest[c[r < c]])
                rest = rest[len(tile) :]
                continue
            # many are near: the whole component of the row with most is taken out, each member compared with those left
            hub = near.sum(1).argmax()
            todo, rest = [rest[near[hub] & (rest != tile[hub])]], rest[~near[hub]]
            while todo:
                got = todo.pop()
                left.append(np.full(len(got), tile[hub]))
                right.append(got)
                for lo in range(0, len(got) if len(rest) else 0, TILE):
                    new = (differ(got[lo : lo + TILE, None], rest[None]) <= most).any(0)
                    if new.any():
                        todo.append(rest[new])
                        rest = rest[~new]
    none = [np.empty(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def candidates(sorted_rows: DataFrame, least: float = JACCARD) -> DataFrame:
    """``id_a, id_b``: edges that connect the rows of each bucket which pairs of at least this Jaccard, exactly computed, do.

    Rows are sorted by ``place, words, id``, and a place's rows are in one task. Edges grow with the rows, never with the
    pairs of a bucket.
    """

    def edges(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        place, i, w = (np.concatenate(x) for x in zip(*parts))
        root = roots(len(i), *linked(place, w, least))
        k = np.flatnonzero((root != np.arange(len(i))) & (i != i[root]))
        yield from made(i[k], i[root[k]])

    def made(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b], axis=0)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["id_a", "id_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            if not b.num_rows:
                continue
            place, i, w = b.column(0).to_numpy(), b.column(1).to_numpy(), from_binary(b.column(2), np.uint64, DIRECTIONS // 64)
            before = [x[-1:] for x in held[-1]] if held else [place[:0], i[:0], w[:0]]
            place, i, w = (np.concatenate(x) for x in zip(before, (place, i, w)))
            # rows with equal words hang on the first of them
            new = np.r_[True, (place[1:] != place[:-1]) | (w[1:] != w[:-1]).any(1)]
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            yield from made(i[~new], i[first[~new]])
            new[: len(before[0])] = False
            place, i, w = place[new], i[new], w[new]
            if not len(i):
                continue
            at = int(np.searchsorted(place, place[-1]))
            if at or held and held[-1][0][-1] != place[0]:
                yield from edges([*held, (place[:at], i[:at], w[:at])])
                held = []
            held.append((place[at:], i[at:], w[at:]))
        if held:
            yield from edges(held)

    return sorted_rows.mapInArrow(run, "id_a bigint, id_b bigint")


def follow(step: Stored) -> Stored:
    """``id, root`` from ``id, root``: every pointer followed to its end by pointer doubling. Pointers go to smaller ids."""
    while True:
        to = step.df.select(F.col("id").alias("root"), F.col("root").alias("next"))
        now = store(step.df.join(to, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = now.df.where("moved").limit(1).count()
        step.drop()
        step = Stored(now.df.select("id", "root"), now.path)
        if not moved:
            return step


def components(edges: DataFrame) -> DataFrame:
    """``id, root`` of every id of ``edges`` (``id_a < id_b``): ``root`` is the same within a component.

    Each id hooks to its smallest neighbour, the hooks are followed to their ends, and edges within a tree vanish; what
    is left joins trees and is treated likewise.
    """
    edges = store(edges, "edges")
    every = None
    while edges.df.limit(1).count():
        hooks = edges.df.groupBy(F.col("id_b").alias("id")).agg(F.min("id_a").alias("root"))
        step = follow(store(hooks, "hooks"))
        to = [step.df.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root")) for c in ("id_a", "id_b")]
        moved = edges.df.join(to[1], "id_b").join(to[0], "id_a", "left").select(F.coalesce("id_a_root", "id_a").alias("x"), F.col("id_b_root").alias("y"))
        rest = store(moved.where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct(), "edges")
        if every is None:
            every = step
        else:
            up = step.df.select(F.col("id").alias("root"), F.col("root").alias("up"))
            old = every.df.join(up, "root", "left").select("id", F.coalesce("up", "root").alias("root"))
            merged = store(old.unionByName(step.df.join(every.df.select("id"), "id", "left_anti")), "roots")
            every.drop()
            step.drop()
            every = merged
        edges.drop()
        edges = rest
    if every is None:
        return edges.df.select(F.col("id_a").alias("id"), F.col("id_b").alias("root"))
    tops = every.df.select(F.col("root").alias("id")).distinct()
    return every.df.unionByName(tops.join(every.df.select("id"), "id", "left_anti").select("id", F.col("id").alias("root")))


def _blocks(members: DataFrame) -> DataFrame:
    """One row per vector and pair of blocks of its component that it takes part in: ``root, i, j, mine`` and its columns."""
    size = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias("blocks"))
    rows = members.join(size, "root").withColumn("mine", F.pmod(F.xxhash64("id"), "blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    rows = rows.select("*", other.alias("other"))
    return rows.select("root", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", *[c for c in members.columns if c not in ("root", "x")], "x")


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # lengths may be extreme
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _sides(i: int, j: int, mine: np.ndarray) -> list[tuple]:
    return [(slice(None), slice(None))] if i == j else [(mine == i, mine == j), (mine == j, mine == i)]


def degrees(members: DataFrame, least: float = SIMILAR) -> DataFrame:
    """``root, id, w, deg, mark, total``: how many vectors of the component reach ``least``, the vector itself and its
    copies among them, a fingerprint of that set, and the sum of those similarities.

    ``members`` has ``root, id, w, x``: one row per distinct vector, standing for ``w`` copies. Components larger than a
    block are compared by pairs of blocks, dealt over all tasks.
    """

    def group(i: int, j: int, mine: np.ndarray, ids: np.ndarray, w: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        with np.errstate(over="ignore"):
            h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        x = unit(x)
        for a, b in _sides(i, j, mine):
            s = x[a] @ x[b].T
            ok = s >= least
            if i == j:
                np.fill_diagonal(ok, True)
            yield ids[a], w[a], ok @ w[b], np.bitwise_xor.reduce(np.where(ok, h[b], np.uint64(0)), axis=1), np.where(ok, s, 0) @ w[b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in by_group(batches, 3, np.float32):
            got = [(np.full(len(r[0]), root[0]), *r) for root, i, j, mine, ids, w, x in groups for r in group(i[0], j[0], mine, ids, w, x)]
            root, ids, w, deg, mark, total = (np.concatenate(c) for c in zip(*got))
            yield pa.RecordBatch.from_arrays([pa.array(root), pa.array(ids), pa.array(w), pa.array(deg.astype(np.int64)), pa.array(mark.view(np.int64)), pa.array(total)], ["root", "id", "w", "deg", "mark", "total"])

    ordered = _blocks(members.select("root", "id", "w", "x")).repartition(F.col("root"), F.col("i"), F.col("j")).sortWithinPartitions("root", "i", "j")
    part = ordered.mapInArrow(run, "root bigint, id bigint, w bigint, deg bigint, mark bigint, total double")
    return part.groupBy("root", "id", "w").agg(F.sum("deg").alias("deg"), F.bit_xor("mark").alias("mark"), F.sum("total").alias("total"))


def chained(x: np.ndarray, mine: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that connect all rows which a chain of similar pairs does, of those that meet in a sorted array of bit
    strings (see :mod:`neighbours`). With ``mine`` (the block of every row) only pairs of different blocks count.

    Rows that are already connected are not compared again, and a range all of whose rows are connected is left alone.
    """
    n, p = len(x), neighbours.level(least)
    strings, words = neighbours.codes(x)
    part = 1 - neighbours.same_bit(least)
    far = neighbours.SKETCH * part + neighbours.SIGMAS * (neighbours.SKETCH * part * (1 - part)) ** 0.5
    root, left, right = np.arange(n), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for q in strings:
        order = np.argsort(q, kind="stable")
        place = q[order] >> neighbours.LONGEST - p
        start = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if n else np.empty(0, np.int64)
        end = np.repeat(np.r_[start[1:], n], np.diff(np.r_[start, n]))
        k, lag, due = np.arange(n), 1, 1
        while len(k := k[k + lag < end[k]]):
            if lag == due:
                r = root[order]
                open_ = np.minimum.reduceat(r, start) != np.maximum.reduceat(r, start)
                k = k[np.repeat(open_, np.diff(np.r_[start, n]))[k]]
                due *= 2
            a, b = order[k], order[k + lag]
            ok = root[a] != root[b]
            if mine is not None:
                ok &= mine[a] != mine[b]
            a, b = a[ok], b[ok]
            near = sum(np.bitwise_count(w[a] ^ w[b]).astype(np.uint16) for w in words) <= far
            a, b = a[near], b[near]
            near = np.einsum("ij,ij->i", x[a], x[b]) >= least
            a, b = a[near], b[near]
            if len(a):
                left.append(a)
                right.append(b)
                root = roots(n, np.r_[root, a], np.r_[np.arange(n), b])
            lag += 1
    a, b = np.concatenate(left), np.concatenate(right)
    spanning = roots(n, a, b)
    k = np.flatnonzero(spanning != np.arange(n))
    return k, spanning[k]


def apart(members: DataFrame, least: float) -> DataFrame:
    """``members`` (``root, id, w, x``) with the components of more than ``BLOCK`` vectors taken apart: ``root`` is then the
    same for what a chain of pairs of at least this similarity connects."""
    size = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    large = store(size.where(F.col("n") > BLOCK).select("root"), "large")
    n = large.count()
    if not n:
        return members
    of = small(large.df, n)
    rows = store(members.join(of, "root").select(F.lit(True).alias("type"), "id", "x"), "large").df

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q = np.rint(unit(from_binary(b.column(2), np.float32, DIM)) * neighbours.SCALE).astype(np.int16)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), binary(q)], ["type", "id", "q"])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in by_group(batches, 3):
            for _, i, j, mine, ids, q in groups:
                a, b = chained(unit(q).astype(np.float32), None if i[0] == j[0] else mine, least - neighbours.DOUBT)
                a, b = ids[a], ids[b]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["id_a", "id_b"])

    rows = rows.mapInArrow(short, "type boolean, id bigint, q binary")
    bits, trees = neighbours.shape(max(neighbours.WHOLE + 1, rows.count()), least)
    crowd = neighbours.large_units(rows, bits, trees)
    parts = (trees << bits) + sum(k * (k + 1) // 2 for k in crowd.values())
    dealt = neighbours.forest(rows, bits, trees, crowd).repartition(parts, "unit", "i", "j").sortWithinPartitions("unit", "i", "j")
    found = components(dealt.mapInArrow(edges, "id_a bigint, id_b bigint").where("id_a < id_b").distinct())
    found = store(found.select("id", F.col("root").alias("to")), "apart").df
    rest = members.join(of, "root", "left_anti")
    return store(rest.unionByName(members.join(of, "root").join(found, "id", "left").select(F.coalesce("to", "id").alias("root"), "id", "w", "x")), "members").df


def compact(members: DataFrame, least: float) -> DataFrame:
    """``members`` without the large components that a few of their members show not to be tight: one that is taken anyhow,
    then the least similar to it, then the least similar to that. What remains is compared by all pairs."""
    size = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    large = store(size.where(F.col("n") > BLOCK).select("root"), "large")
    n = large.count()
    if not n:
        return members
    rows = store(members.join(small(large.df, n), "root"), "large").df
    rest = members.join(small(large.df, n), "root", "left_anti")
    pivot = rows.groupBy("root").agg(F.min_by("x", "id").alias("m"))
    for _ in range(PIVOTS):
        seen = store(_beside(rows.join(small(store(pivot, "pivots").df, n), "root")), "beside").df
        least_of = store(seen.groupBy("root").agg(F.min("s").alias("s"), F.min_by("x", F.struct("s", "id")).alias("m")).where(F.col("s") >= least), "pivots").df
        rows = rows.join(small(least_of.select("root"), n), "root", "left_semi")
        pivot = least_of.select("root", "m")
    return rest.unionByName(rows)


def grouped(item_data: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """The distinct vectors of every component of two or more ids, and the ids behind each vector.

    First ``root, id, w, x``: one row per distinct vector under its smallest id, with the number of its ids. Then ``rep,
    id``. The first table is stored.
    """
    rows, seen = resolved(item_data)
    order = bands(rows.select("id", "q")).repartition(tasks(seen.count() * BANDS, TASK), "place").sortWithinPartitions("place", "words", "id")
    edges = candidates(order.select("place", "id", "words")).distinct()
    root = components(edges)
    ids = store(seen.select("id", "h").join(root, "id"), "members").df
    reps = ids.groupBy("root", "h").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("w"))
    which = reps.select("root", F.col("rep").alias("id"), "w")
    vectors = rows.select("id", "x").join(which, "id").groupBy("root", "id", "w").agg(F.max("x").alias("x"))
    # ids with a vector of their own need no join, and few shared vectors go to all tasks: one with many ids stays spread
    shared = store(reps.where("w > 1").select("root", "h", "rep"), "shared").df
    of = ids.join(small(shared, shared.count()), ["root", "h"], "left").select(F.coalesce("rep", "id").alias("rep"), "id")
    return apart(store(vectors, "members").df, least), of


def tight_clusters(item_data: DataFrame, least: float = SIMILAR, size: int = 3) -> DataFrame:
    """``cluster, id``: sets of ``size`` or more ids, each two similar, none similar to a vector outside.

    The vectors of such a set, and of no other, have one and the same set of similar vectors, themselves included, whose
    number is theirs. ``cluster`` is the smallest id. Unusable vectors, null ids and types are left out; an empty input
    gives no rows.
    """
    vectors, ids = grouped(item_data, least)
    deg = store(degrees(compact(vectors, least), least), "degrees").df
    found = deg.groupBy("root", "deg", "mark").agg(F.sum("w").alias("n"), F.min("id").alias("cluster")).where((F.col("n") == F.col("deg")) & (F.col("n") >= size))
    of = deg.select("root", "deg", "mark", F.col("id").alias("rep")).join(found, ["root", "deg", "mark"]).select("rep", "cluster")
    return ids.join(of, "rep").select("cluster", "id")


def pairs(clusters: DataFrame) -> DataFrame:
    """``id_a, id_b``: every pair of ids of a cluster, which is what is asked for; its number is the result's."""
    other = clusters.select("cluster", F.col("id").alias("id_b"))
    return clusters.select("cluster", F.col("id").alias("id_a")).join(other, "cluster").where("id_a < id_b").select("id_a", "id_b")


def described(item_data: DataFrame, least: float = SIMILAR, typical: int = 3) -> DataFrame:
    """``cluster, size, medoid, typical``: all clusters of two or more ids, by size and most typical members.

    A tight component is one cluster. A loose one is split: the vector with most neighbours takes them, then the next of
    those that are left, until none is; equal numbers go to the larger sum of similarities, then to the smaller id.
    ``typical`` lists the members' ids with the largest sums of similarities.
    """
    vectors, _ = grouped(item_data, least)
    deg = store(degrees(vectors, least), "degrees").df
    every = vectors.join(deg.select("root", "id", "deg", "total"), ["root", "id"]).select("root", "id", "w", "deg", "total", "x")
    every = store(every.join(vectors.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "root"), "left").df
    rows = store(_split(every.where(F.col("n") <= BLOCK).drop("n"), least), "split").df
    large = store(every.where(F.col("n") > BLOCK).drop("n"), "large").df
    left, medoids = Stored(large, ""), []
    while left.df.limit(1).count():
        # every vector with no undecided neighbour above it is a medoid, whose neighbours are decided then
        above = _highest(left.df.withColumn("open", F.lit(1)), least)
        tops = store(left.df.join(above, ["root", "id"]).withColumn("open", (F.col("top") == F.col("id")).cast("int")).drop("top"), "tops")
        medoids.append(store(tops.df.where("open = 1").select("root", "id"), "medoids").df)
        rest = store(tops.df.join(_highest(tops.df, least), ["root", "id"], "left_anti").drop("open"), "left")
        tops.drop()
        if left.path:
            left.drop()
        left = rest
    if medoids:
        chosen = reduce(DataFrame.unionByName, medoids).withColumn("open", F.lit(1))
        found = _highest(large.join(chosen, ["root", "id"], "left").fillna(0, ["open"]), least)
        rows = rows.unionByName(large.join(found, ["root", "id"]).select(F.col("top").alias("medoid"), "id", "w", "total"))
    order = Window.partitionBy("medoid").orderBy(F.col("total").desc(), "id")
    best = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= typical)
    best = best.groupBy("medoid").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]).alias("typical"))
    sizes = rows.groupBy("medoid").agg(F.min("id").alias("cluster"), F.sum("w").alias("size")).where("size >= 2")
    return sizes.join(best, "medoid").select("cluster", "size", "medoid", "typical")


def order_of(ids: np.ndarray, deg: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Row numbers by falling rank as a medoid."""
    return np.lexsort((ids, -total, -deg))


def _split(rows: DataFrame, least: float) -> DataFrame:
    """``medoid, id, w, total`` for components of one block, each split in its task."""

    def group(ids: np.ndarray, deg: np.ndarray, total: np.ndarray, x: np.ndarray) -> np.ndarray:
        x = unit(x)
        near = x @ x.T >= least
        np.fill_diagonal(near, True)
        medoid = np.full(len(ids), -1)
        for k in order_of(ids, deg, total):
            if medoid[k] < 0:
                medoid[near[k] & (medoid < 0)] = k
        return ids[medoid]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in by_group(batches, 1, np.float32):
            got = [(group(ids, deg, total, x), ids, w, total) for _, ids, w, deg, total, x in groups]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*got)], ["medoid", "id", "w", "total"])

    ordered = rows.select("root", "id", "w", "deg", "total", "x").repartition("root").sortWithinPartitions("root")
    return ordered.mapInArrow(run, "medoid bigint, id bigint, w bigint, total double")


def _highest(rows: DataFrame, least: float) -> DataFrame:
    """``root, id, top``: the highest of the ``open`` vectors (1) that are similar to a vector, itself among them. Vectors with
    none have no row. Compared by pairs of blocks, of which each gives one row per vector."""

    def group(i: int, j: int, mine: np.ndarray, ids: np.ndarray, deg: np.ndarray, total: np.ndarray, open_: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        x, place = unit(x), np.empty(len(ids), np.int64)
        order = order_of(ids, deg, total)
        place[order] = np.arange(len(ids))
        for a, b in _sides(i, j, mine):
            near = x[a] @ x[b].T >= least
            if i == j:
                np.fill_diagonal(near, True)
            best = np.where(near & (open_[b] == 1), place[b], len(ids)).min(1, initial=len(ids))
            ok = best < len(ids)
            top = order[best[ok]]
            yield ids[a][ok], deg[top], total[top], ids[top]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in by_group(batches, 3, np.float32):
            got = [(np.full(len(r[0]), root[0]), *r) for root, i, j, *cols in groups for r in group(i[0], j[0], *cols)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*got)], ["root", "id", "deg", "total", "top"])

    cells = _blocks(rows.select("root", "id", "deg", "total", "open", "x")).repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    part = cells.mapInArrow(run, "root bigint, id bigint, deg bigint, total double, top bigint")
    return part.groupBy("root", "id").agg(F.max_by("top", F.struct("deg", "total", -F.col("top"))).alias("top"))


def _beside(rows: DataFrame) -> DataFrame:
    """``root, id, x, s``: the similarity of ``x`` and ``m``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, m = (unit(from_binary(b.column(k), np.float32, DIM)) for k in (2, 3))
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array((x * m).sum(1))], ["root", "id", "x", "s"])

    return rows.select("root", "id", "x", "m").mapInArrow(run, "root bigint, id bigint, x binary, s double")
