import numpy as np

from loomfit.llm import clusters, neighbours
from loomfit.llm import clusters as cl

SCHEMA = "type boolean, id bigint, cn bigint, f array<float>, h bigint, q string"


def data(spark):
    """Groups of near vectors, exact copies, scaled copies, repeated rows and unusable rows."""
    rng = np.random.default_rng(8)
    rows, i = [], 0
    for size in (3, 5, 9, 2, 1, 1, 1):
        c = rng.standard_normal(48)
        c /= np.linalg.norm(c)
        for _ in range(size):
            v = c + rng.standard_normal(48) * 0.02
            rows.append((True, i, v * rng.uniform(0.1, 30)))
            i += 1
    v = rng.standard_normal(48)
    rows += [(True, 100 + k, v * (1 + k % 2)) for k in range(9)]  # copies
    rows += [(False, k, rng.standard_normal(48)) for k in range(5)]
    good = [(t, k, 1, [*map(float, x), 0.5]) for t, k, x in rows]
    bad = [(True, 900, 1, None), (True, 901, 1, []), (True, 902, None, [1.0] * 48), (True, 903, 1, [float("nan")] + [1.0] * 48), (True, 904, 1, [float("inf")] + [1.0] * 48), (True, 905, 1, [0.0] * 48 + [1.0]), (None, 1, 1, [1.0] * 49), (True, None, 1, [1.0] * 49)]
    df = spark.createDataFrame([(*r, 1, "x") for r in good + good[:4] + bad], SCHEMA)
    return df, {(t, k): x / np.linalg.norm(x) for t, k, x in rows}


def test_neighbours_equal_brute_force(spark):
    df, vec = data(spark)
    got = {(r["type"], r["id"], r["other"]) for r in neighbours.most_similar(df).collect()}
    want = set()
    for t, k in vec:
        sims = sorted((-round(float(vec[t, k] @ vec[t, o]), 7), o) for s, o in vec if s == t and o != k)[:5]
        want |= {(t, k, o) for s, o in sims if -s >= 0.9}
    assert got == want
    assert neighbours.most_similar(df.limit(0)).count() == 0


def test_clusters(spark, rows, monkeypatch):
    df, _ = data(spark)
    right = df.where("type")
    want = sorted([tuple(range(3)), tuple(range(3, 8)), tuple(range(8, 17)), tuple(range(100, 109))])
    for block in (1024, 4):
        monkeypatch.setattr(cl, "BLOCK", block)
        by = {}
        for c, i in rows(clusters.tight_clusters(right)):
            by.setdefault(c, []).append(i)
        assert sorted(tuple(sorted(v)) for v in by.values()) == want
    assert {r["size"] for r in clusters.described(right).collect()} == {2, 3, 5, 9}
    assert clusters.pairs(clusters.tight_clusters(right)).count() == 3 + 10 + 36 + 36
    assert clusters.tight_clusters(right.limit(0)).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (100, 105), (103, 105)]
    got = {r["id"]: r["root"] for r in clusters.components(spark.createDataFrame(edges, "id_a bigint, id_b bigint")).collect()}
    assert {got[k] for k in range(41)} == {got[0]} and {got[k] for k in (100, 101, 103, 105)} == {got[100]} and got[0] != got[100] and len(got) == 45


def test_loose_component_is_split_around_its_hub(spark):
    a, b = np.eye(48)[:2]
    at = lambda deg: np.cos(np.radians(deg)) * a + np.sin(np.radians(deg)) * b
    rows = [(True, k, 1, [*map(float, at(d)), 0.0], 1, "x") for k, d in enumerate((0, 20, 40, 65))]
    df = spark.createDataFrame(rows, SCHEMA)
    assert clusters.tight_clusters(df).count() == 0
    assert sorted((r["medoid"], r["size"]) for r in clusters.described(df).collect()) == [(1, 3)]


def test_large_components_are_taken_apart_and_split_alike(spark, rows, monkeypatch):
    """A chain, a tight group on its side and one that all reach from the middle: as one block and by blocks of 8."""
    rng = np.random.default_rng(12)
    a, b = np.eye(48)[:2]
    at = lambda deg: np.cos(np.radians(deg)) * a + np.sin(np.radians(deg)) * b
    x = [at(d) for d in range(0, 170, 9)] + [np.eye(48)[7] + rng.standard_normal(48) * 0.02 for _ in range(12)]
    ball = rng.standard_normal((30, 48))
    x += [np.eye(48)[20] + v / np.linalg.norm(v) * 0.45 for v in ball] + [np.eye(48)[20]]
    df = spark.createDataFrame([(True, k, 1, [*map(float, v), 0.0], 1, "x") for k, v in enumerate(x)], SCHEMA)
    tight, split = rows(clusters.tight_clusters(df)), sorted((r["cluster"], r["size"], r["medoid"], tuple(r["typical"])) for r in clusters.described(df).collect())
    assert {i for _, i in tight} == set(range(19, 31))
    monkeypatch.setattr(cl, "BLOCK", 8)
    assert rows(clusters.tight_clusters(df)) == tight
    assert sorted((r["cluster"], r["size"], r["medoid"], tuple(r["typical"])) for r in clusters.described(df).collect()) == split


def test_chains_are_connected_without_all_pairs():
    """20,000 vectors in a chain, and two groups that no chain connects."""
    rng = np.random.default_rng(13)
    x = [rng.standard_normal(48)]
    for _ in range(19_999):
        x.append(x[-1] / np.linalg.norm(x[-1]) * 0.96 + rng.standard_normal(48) * 0.03)
    x = np.array(x)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    a, b = cl.chained(x, None, 0.9)
    assert len(a) < len(x) and len(set(cl.roots(len(x), a, b))) <= 3
    two = np.concatenate([np.eye(48)[k] + rng.standard_normal((300, 48)) * 0.03 for k in (0, 1)])
    two = (two / np.linalg.norm(two, axis=1, keepdims=True)).astype(np.float32)
    r = cl.roots(600, *cl.chained(two, None, 0.9))
    assert len(set(r[:300])) == len(set(r[300:])) == 1 and r[0] != r[300]


def test_neighbours_in_a_dense_group_are_found_whatever_the_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1, 48)) + rng.standard_normal((16_000, 48)) * 0.25  # near-equal: all about 0.94
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x[:500] @ x.T
    s[np.arange(500), np.arange(500)] = -1
    want = {(k, int(o)) for k, row in enumerate(s) for o in np.argsort(-row)[:5] if row[o] >= 0.9}
    df = spark.createDataFrame([(True, k, 1, [*map(float, v), 0.5], 1, "x") for k, v in enumerate(x)], SCHEMA).repartition(4)
    for block in (None, 5_000):
        if block:
            monkeypatch.setattr(neighbours, "BLOCK", block)
        got = {(r["id"], r["other"]) for r in neighbours.most_similar(df).where("id < 500").collect()}
        assert len(got & want) > 0.98 * len(want) and len(got & want) > 0.98 * len(got)


def test_trees_keep_the_misses_at_the_threshold_at_every_size():
    for rows in (10_000, 100_000, 100_000_000):
        bits, trees = neighbours.shape(rows, 0.9)
        assert (1 - neighbours.same_bit(0.9) ** bits * (1 - neighbours.UNSEEN)) ** trees <= neighbours.MISS
    small, large = neighbours.shape(100_000, 0.9), neighbours.shape(100_000_000, 0.9)
    assert large[0] > small[0] and large[1] > small[1]
    p = neighbours.level(0.9)
    assert 1 - (1 - neighbours.same_bit(0.9) ** p) ** neighbours.ARRAYS >= 1 - neighbours.UNSEEN
    assert abs(neighbours.same_bit(neighbours.cos_of(16)) ** 16 - neighbours.same_bit(neighbours.cos_of(20)) ** 20) < 1e-9


def recall(x, got, asked, least=0.9, top=5):
    s = x[:asked] @ x.T
    s[np.arange(asked), np.arange(asked)] = -1
    want = {(min(k, int(o)), max(k, int(o))) for k, row in enumerate(s) for o in np.argsort(-row)[:top] if row[o] >= least}
    return len(want & got) / len(want)


def test_climbing_meets_the_best_in_dense_and_sparse_places():
    rng = np.random.default_rng(6)
    cone = rng.standard_normal((1, 48)) + rng.standard_normal((20_000, 48)) * 0.33  # all about 0.9
    groups = np.repeat(rng.standard_normal((2_000, 48)), 7, 0) + rng.standard_normal((14_000, 48)) * 0.3
    tight = rng.standard_normal((1, 48)) + rng.standard_normal((500, 48)) * 0.02
    for x in (cone, groups, np.concatenate([tight, groups])):
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        a, b, s = neighbours.climb(x, None, 0.9, 6)
        assert (a < b).all() and (s >= 0.9).all() and len(set(zip(a, b))) == len(a)
        assert recall(x, set(zip(a.tolist(), b.tolist())), 600) > 0.97
    half = np.arange(len(x)) % 2
    a, b, _ = neighbours.climb(x, half, 0.9, 6)
    assert len(a) and (half[a] != half[b]).all()
    assert len(neighbours.climb(x[:1], None, 0.9, 6)[0]) == len(neighbours.climb(x[:0], None, 0.9, 6)[0]) == 0


def test_every_row_of_a_bucket_is_compared(spark, monkeypatch):
    """One bucket: many unlike rows between the members of a chain, a large near-equal group, and copies."""
    rng = np.random.default_rng(2)
    bits = rng.integers(0, 2, (900, 256), dtype=np.uint8)
    a = bits[0].copy()
    chain = [a]
    for k in range(5):  # neighbours differ in 30 sides (Jaccard 0.79), the next but one in 60 (0.62)
        a = a.copy()
        a[k * 30 : (k + 1) * 30] ^= 1
        chain.append(a)
    group = np.repeat(bits[1:2], 300, axis=0) ^ (rng.random((300, 256)) < 0.05).astype(np.uint8)
    for few, tile in ((256, 64), (2_000, 64), (256, 7)):
        monkeypatch.setattr(cl, "FEW", few)
        monkeypatch.setattr(cl, "TILE", tile)
        every = np.concatenate([np.array(chain), group, bits[2:], chain[2][None]])
        rows = [(7, k, np.packbits(r).tobytes()) for k, r in enumerate(every)]
        df = spark.createDataFrame(rows, "place bigint, id bigint, words binary").repartition(1).sortWithinPartitions("place", "words", "id")
        got = {r["id"]: r["root"] for r in cl.components(cl.candidates(df, 0.69).distinct()).collect()}
        members = lambda ids: {k for k, r in got.items() if r == got[ids[0]]} == set(ids)
        assert members([*range(6), len(every) - 1]) and members(list(range(6, 306))) and len(got) == 307


def test_crowded_buckets_are_dealt(spark, rows, monkeypatch):
    df, _ = data(spark)
    want = rows(clusters.tight_clusters(df.where("type")))
    monkeypatch.setattr(cl, "BUCKET", 2)
    assert rows(clusters.tight_clusters(df.where("type"))) == want


def test_pairs_at_the_threshold_become_candidates():
    """Of pairs at similarity exactly 0.9 nearly all share a band and pass the Jaccard bound."""
    rng = np.random.default_rng(4)
    n = 4_000
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = unit(rng.standard_normal((n, 48))), rng.standard_normal((n, 48))
    b = 0.9 * a + (1 - 0.81) ** 0.5 * unit(b - (a * b).sum(1, keepdims=True) * a)
    one, two = (list(cl.places(cl.binary(np.rint(x * 32_767).astype(np.int16)))) for x in (a, b))
    met = np.any([p == q for (p, _), (q, _) in zip(one, two)], axis=0)
    same = 256 - np.bitwise_count(one[0][1] ^ two[0][1]).sum(1, dtype=np.int64)
    passed = same >= cl.JACCARD * (512 - same)
    assert met.mean() > 0.99 and passed.mean() > 0.999
