"""The gradient steps of one partition, in NumPy over Arrow batches.

Pairs are trained in mini-batches: scores are computed from the vectors as they are, and the updates of equal ids add up,
scaled down where they would step over their common goal (see ``CURVATURE``): from stale vectors a frequent id would otherwise
step ever further. For the same reason a batch has at most a quarter as many pairs as the partition has ids on its smaller
side. A batch of one pair is the sequential rule exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from loomfit.functions.scalars import MISS, SATURATION
from loomfit.operators.packed import NULL, ordered
from loomfit.params import TrainParams

#: Most curvature that the updates of an id in one batch may meet: the sum of learning rate, weight and squared length of the
#: vectors on the other side. From 8 on their sum may end up further from its goal than it began.
CURVATURE = 2.0
#: Ids are looked up in a table of all numbers between them if it has at most so many entries an id, else by binary search.
SPAN = 16


def scatter_add(m: np.ndarray, at: np.ndarray, rows: np.ndarray, bend: np.ndarray | None = None, now: np.ndarray | None = None, mark: np.ndarray | None = None) -> None:
    """``m[at] += rows``, rows of equal positions added up, and scaled down where their ``bend`` adds up to more than
    ``CURVATURE``. A row that is alone is taken as it is: only positions that are there again are sorted.

    ``now`` is ``m[at]`` if it is known, ``mark`` a scratch array as long as ``m``.
    """
    if len(at) == 1:
        m[at[0]] += rows[0]
        return
    now = np.take(m, at, axis=0) if now is None else now
    mark = np.empty(len(m), np.intp) if mark is None else mark
    k = np.arange(len(at))
    mark[at] = k
    again = at[mark[at] != k]
    m[at] = now + rows
    if not len(again):
        return
    mark[again] = -1
    order = np.flatnonzero(mark[at] < 0)
    order = order[np.argsort(at[order], kind="stable")]
    same = at[order]
    start = np.flatnonzero(np.r_[True, same[1:] != same[:-1]])
    total = np.add.reduceat(np.take(rows, order, axis=0), start, axis=0)
    if bend is not None:
        sharp = np.add.reduceat(bend[order], start)
        over = sharp > CURVATURE
        total[over] *= (CURVATURE / sharp[over]).astype(rows.dtype)[:, None]
    m[same[start]] = now[order[start]] + total


def sigmoid(f: np.ndarray) -> np.ndarray:
    """Exact inside [-6, 6], 0 or 1 outside."""
    s = 1 / (1 + np.exp(-np.clip(f, -SATURATION, SATURATION)))
    if not (np.abs(f) > SATURATION).any():
        return s
    return np.where(f > SATURATION, 1.0, np.where(f < -SATURATION, 0.0, s))


def logloss(f: np.ndarray, label: np.ndarray) -> np.ndarray:
    z = np.where(label > 0, f, -f)
    return np.where(z > SATURATION, 0.0, np.where(z < -SATURATION, MISS, np.log1p(np.exp(-np.clip(z, -SATURATION, SATURATION)))))


class Local:
    """The vectors of a partition and the training of its pairs."""

    def __init__(self, p: TrainParams, seed: tuple[int, ...], same_domain: bool) -> None:
        self.p, self.rng, self.same_domain = p, np.random.default_rng(seed), same_domain
        self.held: list[tuple[np.ndarray, ...]] = []
        self.ready = False
        self.loss = self.penalty = 0.0
        self.pairs = 0

    def load(self, side: np.ndarray, ids: np.ndarray, cn: np.ndarray, f: np.ndarray) -> None:
        self.held.append((side, ids, cn, f))

    def start(self) -> None:
        width = self.p.width
        none = (np.empty(0, bool), np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, width), np.float32))
        side, ids, cn, f = (np.concatenate(c) for c in zip(none, *self.held))
        self.held = []
        order = np.lexsort((ids, side))
        side, ids, cn, f = side[order], ids[order], cn[order], f[order]
        n = int((~side).sum())
        self.ids, self.cn, self.f = (ids[:n], ids[n:]), (cn[:n], cn[n:]), [f[:n].copy(), f[n:].copy()]
        mass = self.cn[1].astype(np.float64) ** self.p.pow
        self.cdf = np.cumsum(mass) / mass.sum() if len(mass) else mass
        self.places = [self._places(i) for i in self.ids]
        self.own = self.find(1, self.ids[0]) if self.same_domain else np.full(n, -1)
        self.mark = [np.empty(len(i), np.intp) for i in self.ids]
        self.ready = True

    @staticmethod
    def _places(ids: np.ndarray) -> np.ndarray | None:
        """Position of every number from the least id to the largest, -1 where there is none; None if few of them are ids."""
        if not len(ids) or int(ids[-1]) - int(ids[0]) >= SPAN * len(ids):
            return None
        out = np.full(int(ids[-1]) - int(ids[0]) + 1, -1, np.int32)
        out[ids - ids[0]] = np.arange(len(ids))
        return out

    def find(self, side: int, x: np.ndarray) -> np.ndarray:
        """Positions of ids, -1 for those without a vector."""
        ids, places = self.ids[side], self.places[side]
        if not len(ids):
            return np.full(len(x), -1)
        if places is not None:
            inside = (x >= ids[0]) & (x <= ids[-1])
            return np.where(inside, places[np.where(inside, x, ids[0]) - ids[0]], -1).astype(np.intp)
        k = np.minimum(np.searchsorted(ids, x), len(ids) - 1)
        return np.where(ids[k] == x, k, -1)

    def negatives(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One negative for every pair, and which of them count. ``own`` is the place of the pair's left id among the right
        ids, -1 if it has none: that one is never drawn, as if drawing went on until another came out.
        """
        n = len(self.ids[1])
        some = own >= 0
        if self.p.pow > 0:
            below = np.where(own > 0, self.cdf[np.maximum(own - 1, 0)], 0.0)
            width = np.where(some, self.cdf[own] - below, 0.0)
            u = self.rng.random(len(own)) * (1 - width)
            got = np.minimum(np.searchsorted(self.cdf, u + np.where(some & (u >= below), width, 0.0), side="right"), n - 1)
            near = some & (got == own)  # only by rounding
            got[near] = (own[near] + 1) % n
        else:
            got = self.rng.integers(0, np.maximum(n - some, 1))
            got += some & (got >= own) & (n > 1)
        return got, ~(some & (n == 1))

    def train(self, left: np.ndarray, right: np.ndarray, label: np.ndarray | None, weight: np.ndarray | None) -> None:
        """All pairs once, in the order given. Pairs with an id that has no vector are skipped."""
        if not self.ready:
            self.start()
        l, r = self.find(0, left), self.find(1, right)
        ok = (l >= 0) & (r >= 0)
        l, r = l[ok], r[ok]
        own = self.own[l]
        label = np.ones(len(l)) if label is None else label[ok]
        weight = np.ones(len(l)) if weight is None else weight[ok]
        size = max(1, min(self.p.batch_size, min(len(self.ids[0]), len(self.ids[1])) // 4))
        for k in range(0, len(l), size):
            s = slice(k, k + size)
            self.step(l[s], r[s], own[s], label[s], weight[s])
        self.pairs += len(l)

    def step(self, l: np.ndarray, r: np.ndarray, own: np.ndarray, label: np.ndarray, weight: np.ndarray) -> None:
        p, dim = self.p, self.p.vector_size
        a = np.take(self.f[0], l, axis=0)
        head = a[:, :dim]
        exact = head.astype(np.float64)
        gain, bend = np.zeros_like(a), np.zeros(len(l))
        length = np.einsum("ij,ij->i", a, a)
        told = []
        for d in range(p.negatives + 1):
            if d:
                target, ok = self.negatives(own)
                y, w = np.zeros(len(l)), p.gamma * weight * ok
            else:
                target, y, w = r, label, weight
            b = np.take(self.f[1], target, axis=0)
            f = np.einsum("ij,ij->i", exact, b[:, :dim].astype(np.float64))
            if p.use_bias:
                f = f + a[:, dim] + b[:, dim]
            rate = p.learning_rate * w
            g = ((y - sigmoid(f)) * p.learning_rate * w).astype(np.float32)[:, None]
            told.append((f, y, w))
            up = g * a
            if p.use_bias:
                gain[:, dim:] += g
                up[:, dim:] = g
            gain[:, :dim] += g * b[:, :dim]
            if not d and (p.lambda_l or p.lambda_r):
                lr = rate.astype(np.float32)[:, None]
                self.penalty += float((w * (p.lambda_l * (head**2).sum(1) + p.lambda_r * (b[:, :dim] ** 2).sum(1))).sum())
                gain[:, :dim] -= p.lambda_l * lr * head
                up[:, :dim] -= p.lambda_r * lr * b[:, :dim]
            bend += rate * np.einsum("ij,ij->i", b, b)
            scatter_add(self.f[1], target, up, rate * length, b, self.mark[1])
        scatter_add(self.f[0], l, gain, bend, a, self.mark[0])
        f, y, w = (np.concatenate(c) for c in zip(*told))
        self.loss += float((logloss(f, y) * w).sum())

    def rows(self) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray]]:
        if not self.ready:
            self.start()
        yield False, self.ids[0], self.cn[0], self.f[0]
        yield True, self.ids[1], self.cn[1], self.f[1]


OUT = "type boolean, id bigint, cn bigint, f array<float>, loss double, penalty double, pairs bigint"


def train_partition(batches: Iterator[pa.RecordBatch], p: TrainParams, seed: tuple[int, ...], same_domain: bool) -> Iterator[pa.RecordBatch]:
    """Rows ``bucket, part, type, id, cn, f, n, left, right, given``, vectors (bucket -1) before pieces of pairs, to trained vectors.

    The pairs are trained in the order of their keys. The last row has null for the vector and the partition's loss instead,
    NaN if a vector is no longer finite. A partition without pairs returns its vectors as they are, one without rows nothing.
    A null weight is 1; a pair with a null label is left out of explicit training.
    """
    local: Local | None = None

    def pieces() -> Iterator[pa.RecordBatch]:
        nonlocal local
        for b in batches:
            if not b.num_rows:
                continue
            local = local or Local(p, (*seed, b.column("part")[0].as_py()), same_domain)
            n = int((b.column("bucket").to_numpy() < 0).sum())
            if n:
                v = b.slice(0, n)
                f = v.column("f").flatten().to_numpy(zero_copy_only=False).reshape(n, p.width)
                local.load(v.column("type").to_numpy(zero_copy_only=False), v.column("id").to_numpy(), v.column("cn").to_numpy(), f)
            if n < b.num_rows:
                yield b.slice(n)

    for left, right, bits in ordered(pieces(), seed):
        if bits is None:
            known, given = np.full(len(left), p.implicit), np.ones(len(left))
        else:
            known, given = bits != NULL, np.where(bits == NULL, np.float32(1), bits.view(np.float32)).astype(np.float64)
        if not p.implicit:
            left, right, given = left[known], right[known], given[known]
        local.train(left, right, None if p.implicit else given, given if p.implicit else None)
    if local is None:
        return
    names = [c.split()[0] for c in OUT.split(", ")]
    for side, ids, cn, f in local.rows():
        if not np.isfinite(f).all():
            local.loss = float("nan")
        for k in range(0, len(ids), 20_000):
            m = len(ids[k : k + 20_000])
            vec = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * p.width), pa.array(f[k : k + m].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, side)), pa.array(ids[k : k + m]), pa.array(cn[k : k + m]), vec, pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.int64())], names)
    nulls = [pa.nulls(1, t) for t in (pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.float32()))]
    yield pa.RecordBatch.from_arrays([*nulls, pa.array([local.loss]), pa.array([local.penalty]), pa.array([local.pairs], pa.int64())], names)
