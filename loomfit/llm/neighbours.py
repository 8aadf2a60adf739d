"""The most similar vectors of every vector, by a hash-prefix forest.

A few trees deal the vectors over tasks by a short prefix of their sign bits. Inside such a unit there is a forest of sorted
arrays of longer bit strings: every vector descends in all of them to the longest prefix that others share, and ascends in all
at once, level by level, to the wider ranges of shorter prefixes. It stops at the level where a vector more similar than
the last of its best ones would have been met in one of the arrays but for a small chance; that level follows from their
similarity, so dense places end early and sparse ones go on. Where the ranges cover much of the unit, the ascent goes to the
root: all of the unit is compared. No range is cut, and a unit with more than ``BLOCK`` rows is dealt over tasks as pairs of
blocks, so a pair's chance to be met depends on its similarity alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log1p, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomfit.llm.vectors import DIM, SCALE, SIMILAR, by_group, exact_similarities, from_binary, resolved, shared_vectors
from loomfit.session import small, store

#: Sorted arrays inside a unit and bits of their strings; share of the pairs of a unit that none of its arrays may meet.
ARRAYS, LONGEST, UNSEEN = 24, 20, 0.02
#: Levels of the ascent: bits of the prefix. The last one follows from the least similarity.
LEVELS = (20, 16)
#: Bits by which a pair is looked at before its similarity is computed, and the standard deviations that this is off at most.
SKETCH, SIGMAS = 256, 5.0
#: Of a product of all rows this part costs as much as looking at a pair in an array. So few rows are compared at once.
DIRECT, WHOLE = 4, 4_096
#: Rows that a prefix has on average at most, bits of a prefix at least.
UNIT, LEAST_BITS = 65_536, 2
#: Most rows of a prefix that are compared in one piece; more are dealt as pairs of blocks.
BLOCK = 131_072
#: Share of the pairs at exactly the least similarity that no tree may meet.
MISS = 0.002
#: Rows and columns of a piece of the similarity matrix.
TILE, STRIP = 256, 16_384
TOP = 5
#: Similarities of 16-bit vectors nearer than this to each other or to the least are taken from the vectors as delivered.
DOUBT = 4e-5
SEED = 11


def same_bit(similarity: float) -> float:
    """The chance that two vectors of this similarity are on the same side of a random plane."""
    return 1 - acos(min(1.0, max(-1.0, similarity))) / pi


def shape(rows: int, least: float) -> tuple[int, int]:
    """Bits of a prefix for a side of so many rows, and the trees that keep the misses at ``least`` under ``MISS``."""
    if rows <= WHOLE:
        return 0, 1
    bits = max(LEAST_BITS, ceil(log2(rows / UNIT)))
    met = same_bit(least) ** bits * (1 - UNSEEN)
    return bits, 1 if met >= 1 else max(1, ceil(log(MISS) / log1p(-met)))


def level(least: float) -> int:
    """The longest prefix at which at most ``UNSEEN`` of the pairs of this similarity are met in none of the arrays."""
    c = same_bit(least)
    return LONGEST if c >= 1 else max(0, min(LONGEST, int(log(1 - UNSEEN ** (1 / ARRAYS)) / log(c))))


def hashes(b: pa.RecordBatch, plane: np.ndarray, bits: int, trees: int) -> Iterator[np.ndarray]:
    """Per tree the unit (side, tree and prefix in one number) of ``type, id, q``."""
    side = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    up = from_binary(b.column(2), np.int16, DIM).astype(np.float32) @ plane > 0
    weight = np.int64(1) << np.arange(bits - 1, -1, -1, dtype=np.int64)
    for t in range(trees):
        yield (side * trees + t) << bits | up[:, t * bits : (t + 1) * bits].astype(np.int64) @ weight


def planes(bits: int, trees: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((DIM, trees * bits)).astype(np.float32)


def large_units(rows: DataFrame, bits: int, trees: int) -> dict[int, int]:
    """Units with more than ``BLOCK`` rows, and the blocks they are dealt in. At most a unit per ``BLOCK`` rows and tree."""
    block = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plane = planes(bits, trees)
        for b in batches:
            if b.num_rows:
                unit, n = np.unique(np.concatenate(list(hashes(b, plane, bits, trees))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(unit), pa.array(n)], ["unit", "n"])

    sizes = rows.mapInArrow(run, "unit bigint, n bigint").groupBy("unit").agg(F.sum("n").alias("n"))
    return {r["unit"]: -(-r["n"] // block) for r in sizes.where(F.col("n") > block).collect()}


def forest(rows: DataFrame, bits: int, trees: int, large: dict[int, int]) -> DataFrame:
    """``unit, i, j, mine, id, q``: every vector once per tree, in a large unit once per pair of blocks with its own.

    The block of a vector follows from its values, so copies stay together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plane = planes(bits, trees)
        odd = np.random.default_rng(SEED).integers(1 << 62, size=DIM * 2 // 8, dtype=np.int64).astype(np.uint64) | np.uint64(1)
        many = np.array(sorted(large), np.int64)
        parts = np.array([large[u] for u in many.tolist()], np.int64)
        names = ["unit", "i", "j", "mine", "id", "q"]
        for b in batches:
            if not b.num_rows:
                continue
            with np.errstate(over="ignore"):
                h = (from_binary(b.column(2), np.uint64, DIM * 2 // 8) * odd).sum(1, dtype=np.uint64)
                h = (h ^ h >> np.uint64(32)) * odd[0] >> np.uint64(33)
            for unit in hashes(b, plane, bits, trees):
                n = np.ones(len(unit), np.int64)
                if len(many):
                    k = np.minimum(np.searchsorted(many, unit), len(many) - 1)
                    n = np.where(many[k] == unit, parts[k], 1)
                mine = h.astype(np.int64) % n
                row = np.repeat(np.arange(len(n)), n)
                other = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                for lo in range(0, len(row), 8_192):
                    r, o = row[lo : lo + 8_192], other[lo : lo + 8_192]
                    take = pa.array(r)
                    cols = [unit[r], np.minimum(mine[r], o), np.maximum(mine[r], o), mine[r]]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, cols), b.column(1).take(take), b.column(2).take(take)], names)

    return rows.mapInArrow(run, "unit bigint, i bigint, j bigint, mine bigint, id bigint, q binary")


def strongest(x: np.ndarray, rows: np.ndarray, cols: np.ndarray, least: float, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of ``rows`` the ``top`` of ``cols`` with the highest similarity of at least ``least``, as ``row, col, s``."""
    found = []
    for lo in range(0, len(rows), TILE):
        mine = rows[lo : lo + TILE]
        bound = np.full(len(mine), least, np.float32)
        r, c, s = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
        for at in range(0, len(cols), STRIP):
            strip = cols[at : at + STRIP]
            m = x[mine] @ x[strip].T
            ok = m >= bound[:, None]
            n = np.count_nonzero(ok)
            if not n:
                continue
            if n > 64 * len(mine) and len(strip) > top:
                new_c = np.argpartition(m, len(strip) - top, axis=1)[:, -top:]
                new_r = np.repeat(np.arange(len(mine)), top)
                new_c = new_c.ravel()
                keep = ok[new_r, new_c]
                new_r, new_c = new_r[keep], new_c[keep]
            else:
                new_r, new_c = np.nonzero(ok)
            r, c, s = np.r_[r, new_r], np.r_[c, strip[new_c]], np.r_[s, m[new_r, new_c]]
            order = np.lexsort((-s, r))
            r, c, s = r[order], c[order], s[order]
            rank = np.arange(len(r)) - np.searchsorted(r, r)
            r, c, s, rank = (v[rank < top] for v in (r, c, s, rank))
            full = rank == top - 1
            bound[r[full]] = s[full]
        found.append((mine[r], c, s))
    return tuple(np.concatenate(v) for v in zip(*found))


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit strings of rows in every array (arrays x rows), and the words of their sketches (words x rows)."""
    plane = np.random.default_rng(SEED + 1).standard_normal((DIM, ARRAYS * LONGEST)).astype(np.float32)
    up = np.empty((len(x), ARRAYS * LONGEST), bool)
    for lo in range(0, len(x), STRIP):
        np.greater(x[lo : lo + STRIP] @ plane, 0, out=up[lo : lo + STRIP])
    weight = np.int32(1) << np.arange(LONGEST - 1, -1, -1, dtype=np.int32)
    strings = np.stack([up[:, t * LONGEST : (t + 1) * LONGEST] @ weight for t in range(ARRAYS)])
    return strings, np.ascontiguousarray(np.packbits(up[:, :SKETCH], axis=1).view(np.uint64).T)


def best_places(row: np.ndarray, s: np.ndarray, n: int, top: int) -> np.ndarray:
    """The ``top``-th largest ``s`` of every row, 0 for rows with fewer."""
    order = np.lexsort((-s, row))
    r, out = row[order], np.zeros(n, np.float32)
    k = np.flatnonzero(np.arange(len(r)) - np.searchsorted(r, r) == top - 1)
    out[r[k]] = s[order][k]
    return out


def climb(x: np.ndarray, mine: np.ndarray | None, least: float, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs ``a < b`` of rows with their similarity, of at least ``least``: for every row the ``top`` best and maybe more.

    With ``mine`` (the block of every row) only pairs of different blocks count.
    """
    n, last = len(x), level(least)
    if n <= WHOLE:
        return once(n, *whole(x, mine, np.arange(n), least, top))
    strings, words = codes(x)
    order = np.argsort(strings, axis=1, kind="stable")
    strings = np.take_along_axis(strings, order, axis=1)
    part = 1 - same_bit(least)
    far = SKETCH * part + SIGMAS * (SKETCH * part * (1 - part)) ** 0.5
    active, key, sim = np.ones(n, bool), np.empty(0, np.int64), np.empty(0, np.float32)
    before = LONGEST + 1
    for p in [v for v in LEVELS if v > last] + [last]:
        ends = [np.searchsorted(q, (q >> LONGEST - p) + 1 << LONGEST - p) for q in strings]
        starts = [np.searchsorted(q, q >> LONGEST - p << LONGEST - p) for q in strings]
        size = sum(int((e - b)[active[o]].sum()) for b, e, o in zip(starts, ends, order))
        if size * DIRECT > int(active.sum()) * n:
            a, b, s = whole(x, mine, np.flatnonzero(active), least, top)
            key, sim = np.r_[key, np.minimum(a, b) * n + np.maximum(a, b)], np.r_[sim, s]
            break
        found = []
        for q, o, end in zip(strings, order, ends):
            w, on, m = words[:, o], active[o], None if mine is None else mine[o]
            k, lag = np.arange(n), 1
            while len(k := k[k + lag < end[k]]):
                ok = on[k] | on[k + lag]
                if before <= LONGEST:  # not again what an earlier level has seen
                    ok &= q[k] >> LONGEST - before != q[k + lag] >> LONGEST - before
                if m is not None:
                    ok &= m[k] != m[k + lag]
                c = k[ok]
                c = c[sum(np.bitwise_count(v[c] ^ v[c + lag]).astype(np.uint16) for v in w) <= far]
                a, b = o[c], o[c + lag]
                found.append(np.minimum(a, b) * n + np.maximum(a, b))
                lag += 1
        new = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        s = np.empty(len(new), np.float32)
        for lo in range(0, len(new), 65_536):
            a, b = new[lo : lo + 65_536] // n, new[lo : lo + 65_536] % n
            s[lo : lo + 65_536] = np.einsum("ij,ij->i", x[a], x[b])
        key, sim = np.r_[key, new[s >= least]], np.r_[sim, s[s >= least]]
        if p > last:
            worst = best_places(np.r_[key // n, key % n], np.r_[sim, sim], n, top)
            sure = cos_of(p)
            active &= worst < sure
            if not active.any():
                break
        before = p
    return once(n, key // n, key % n, sim)


def once(n: int, a: np.ndarray, b: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs in either order as ``a < b``, each once."""
    key, first = np.unique(np.minimum(a, b) * n + np.maximum(a, b), return_index=True)
    return key // max(n, 1), key % max(n, 1), s[first]


def whole(x: np.ndarray, mine: np.ndarray | None, rows: np.ndarray, least: float, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The root of the forest: the ``top`` best of all others for ``rows``, with ``mine`` of those of other blocks."""
    every = np.arange(len(x))
    sides = [(rows, every, top + 1)] if mine is None else [(rows[mine[rows] == m], every[mine != m], top) for m in np.unique(mine)]
    got = [strongest(x, a, b, least, k) for a, b, k in sides if len(a) and len(b)]
    none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))
    a, b, s = (np.concatenate(v) for v in zip(none, *got))
    return a[a != b], b[a != b], s[a != b]


def cos_of(p: int) -> float:
    """The similarity from which at most ``UNSEEN`` of the pairs are met in none of the arrays at prefixes of ``p`` bits."""
    return float(np.cos(pi * (1 - (1 - UNSEEN ** (1 / ARRAYS)) ** (1 / p))))


def near(sorted_rows: DataFrame, least: float, top: int, right: int) -> DataFrame:
    """``type, id_a, id_b, similarity`` of each vector's ``top`` most similar others in its unit, from rows of
    :func:`forest` sorted by ``unit, i, j, q, id``. Rows with equal vectors are one, under the smallest id. Units from
    ``right`` on are of the right side.
    """

    def group(i: int, j: int, mine: np.ndarray, ids: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
        first = np.r_[True, (q[1:] != q[:-1]).any(1)]
        mine, ids, x = mine[first], ids[first], q[first].astype(np.float32) / SCALE
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        a, b, s = climb(x, None if i == j else mine, least, top)
        a, b = ids[a], ids[b]
        return np.minimum(a, b), np.maximum(a, b), s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in by_group(batches, 3):
            for unit, i, j, mine, ids, q in groups:
                a, b, s = group(int(i[0]), int(j[0]), mine, ids, q)
                if len(a):
                    side = np.full(len(a), int(unit[0]) >= right)
                    yield pa.RecordBatch.from_arrays([pa.array(side), pa.array(a), pa.array(b), pa.array(s)], ["type", "id_a", "id_b", "similarity"])

    return sorted_rows.mapInArrow(run, "type boolean, id_a bigint, id_b bigint, similarity float")


def most_similar(item_data: DataFrame, least: float = SIMILAR, top: int = TOP) -> DataFrame:
    """The ``top`` most similar others of every usable vector, on its own side, of those with ``least`` similarity.

    Columns ``type, id, other, similarity, place`` (1 is the most similar; ties go to the smaller id). Ids with equal
    vectors are handled exactly and apart, so their number does not matter. Empty input: no rows.
    """
    rows, seen = resolved(item_data)
    rows = rows.select("type", "id", "q")
    sides = [r["count"] for r in seen.groupBy("type").count().collect()]
    bits, trees = shape(max(sides, default=0), least)
    large = large_units(rows, bits, trees)
    # a task per unit, and per pair of blocks of a large one
    parts = (2 * trees << bits) + sum(n * (n + 1) // 2 for n in large.values())
    dealt = forest(rows, bits, trees, large).repartition(parts, "unit", "i", "j")
    arrays = dealt.sortWithinPartitions("unit", "i", "j", "q", "id")
    pairs = near(arrays, least - DOUBT, top + 1, trees << bits)
    pairs = store(pairs.groupBy("type", "id_a", "id_b").agg(F.max("similarity").cast("double").alias("similarity")), "near").df
    group = store(shared_vectors(seen, top + 1), "shared").df
    n = group.count()
    members = small(group, n)
    both = pairs.select("type", F.explode(F.array(F.struct(F.col("id_a").alias("v"), F.col("id_b").alias("u")), F.struct(F.col("id_b").alias("v"), F.col("id_a").alias("u")))).alias("x"), "similarity").select("type", "x.v", "x.u", "similarity")
    if n:
        # vectors stand for their groups: each once, under its smallest id
        for c in ("v", "u"):
            to = members.select("type", F.col("id").alias(c), F.col("rep").alias(f"{c}_rep"))
            both = both.join(to, ["type", c], "left").withColumn(c, F.coalesce(f"{c}_rep", c)).drop(f"{c}_rep")
        both = both.where("v <> u").groupBy("type", "v", "u").agg(F.max("similarity").alias("similarity"))
    rank = lambda v, u: F.row_number().over(Window.partitionBy("type", v).orderBy(F.col("similarity").desc(), u))
    by = Window.partitionBy("type", "v").orderBy(F.col("similarity").desc(), "u")
    ranked = both.withColumn("r", rank("v", "u")).where(F.col("r") <= top + 1)
    beside = [F.abs(F.col("similarity") - f("similarity").over(by)) < DOUBT for f in (F.lag, F.lead)]
    doubt = (F.abs(F.col("similarity") - least) < DOUBT) | F.coalesce(beside[0], F.lit(False)) | F.coalesce(beside[1], F.lit(False))
    ranked = store(ranked.withColumn("doubt", doubt), "ranked").df
    true = exact_similarities(item_data, seen, ranked.where("doubt").select("type", "v", "u"))
    both = ranked.join(true, ["type", "v", "u"], "left").select("type", "v", "u", F.coalesce("exact", "similarity").alias("similarity")).where(F.col("similarity") >= least)
    cut = both.withColumn("r", rank("v", "u")).where(F.col("r") <= top).drop("r")
    if n:
        other = members.where("place IS NOT NULL").select("type", F.col("rep").alias("u"), F.col("id").alias("u_id"))
        cut = cut.join(other, ["type", "u"], "left").select("type", "v", F.coalesce("u_id", "u").alias("u"), "similarity")
        every = members.select("type", F.col("rep").alias("v"), F.col("id").alias("v_id"), F.col("n").alias("size"))
        cut = cut.join(every, ["type", "v"], "left").where(F.coalesce("size", F.lit(0)) <= top).select("type", F.coalesce("v_id", "v").alias("v"), "u", "similarity")
        twins = group.select("type", F.col("id").alias("v"), "rep").join(group.where("place IS NOT NULL").select("type", "rep", F.col("id").alias("u")), ["type", "rep"])
        cut = cut.unionByName(twins.where("v <> u").select("type", "v", "u", F.lit(1.0).alias("similarity")))
    out = cut.withColumn("place", rank("v", "u")).where(F.col("place") <= top)
    return out.select("type", F.col("v").alias("id"), F.col("u").alias("other"), "similarity", "place")
