import math
import random

import numpy as np
import pytest

from loomfit.operators.kernel import Local, scatter_add
from loomfit.params import TrainParams
from loomfit.plans.estimators import LogisticMF, SkipGram
from loomfit.sources import checkpoint


def local(p, l, r, same=False):
    x = Local(p, (1,), same)
    x.load(np.array([False] * len(l)), np.arange(len(l)), np.ones(len(l), np.int64), np.array(l, np.float32))
    x.load(np.array([True] * len(r)), np.arange(len(r)), np.ones(len(r), np.int64), np.array(r, np.float32))
    x.start()
    return x


def test_explicit_step_by_hand():
    p = TrainParams(vector_size=2, implicit=False, learning_rate=0.1, lambda_l=0.2, lambda_r=0.3, use_bias=True)
    a, b = np.array([0.5, -1.0, 0.1]), np.array([0.25, 0.75, -0.2])
    x = local(p, [a], [b])
    x.train(np.array([0]), np.array([0]), np.array([1.0]), None)
    f = a[:2] @ b[:2] + a[2] + b[2]
    g = 0.1 * (1 - 1 / (1 + math.exp(-f)))
    assert np.allclose(x.f[0][0], [*(a[:2] + g * b[:2] - 0.1 * 0.2 * a[:2]), a[2] + g], atol=1e-6)
    assert np.allclose(x.f[1][0], [*(b[:2] + g * a[:2] - 0.1 * 0.3 * b[:2]), b[2] + g], atol=1e-6)
    assert x.loss == pytest.approx(math.log1p(math.exp(-f)), abs=1e-6)


def test_gradient_is_the_slope_of_the_loss():
    p = TrainParams(vector_size=3, implicit=False, learning_rate=1e-3)
    a, b = np.array([0.3, -0.2, 0.9]), np.array([-0.4, 0.6, 0.2])
    x = local(p, [a], [b])
    x.train(np.array([0]), np.array([0]), np.array([0.0]), None)
    loss = lambda v: math.log1p(math.exp(v @ b))
    slope = [(loss(a + h) - loss(a - h)) / 2e-5 for h in np.eye(3) * 1e-5]
    assert np.allclose((x.f[0][0] - a) / -1e-3, slope, atol=1e-3)


def test_unknown_ids_and_empty_sides():
    x = local(TrainParams(vector_size=1), [[0.1]], [[0.2]])
    x.train(np.array([5, 0]), np.array([0, 7]), None, None)
    assert x.pairs == 0 and x.f[0][0][0] == np.float32(0.1)
    y = Local(TrainParams(vector_size=1, pow=1.0), (1,), True)
    y.train(np.array([1]), np.array([1]), None, None)
    assert y.pairs == 0


def test_scatter_add():
    m, at, g = np.zeros((3, 2)), np.array([2, 0, 2]), np.arange(6.0).reshape(3, 2)
    scatter_add(m, at, g)
    assert m.tolist() == [[2, 3], [0, 0], [4, 6]]


def corpus(spark, n=300, seed=4):
    rng = random.Random(seed)
    seqs = [[rng.randrange(10) + 100 * (k % 2) for _ in range(8)] for k in range(n)]
    return spark.createDataFrame([(s,) for s in seqs], "sequence array<bigint>")


def model():
    return SkipGram().setVectorSize(16).setWindowSize(2).setSamplingMode("WINDOW").setLearningRate(0.1).setNumPartitions(3).setBatchSize(64).setSeed(7)


def test_skipgram_learns_communities_and_is_reproducible(spark, rows):
    df = corpus(spark)
    m = model().setNumIterations(3)
    got = rows(m.fit(df))
    assert len(got) == 40 and all(len(r[3]) == 16 for r in got)
    r = m.metrics.rotations
    assert sum(x["pairs"] for x in r[:3]) == sum(x["pairs"] for x in r[3:6]) > 0
    assert sum(x["loss"] for x in r[-3:]) < sum(x["loss"] for x in r[:3])
    left = {r[1]: np.array(r[3]) for r in got if not r[0]}
    cos = lambda a, b: left[a] @ left[b] / np.linalg.norm(left[a]) / np.linalg.norm(left[b])
    inside = np.mean([cos(a, b) for a in range(10) for b in range(a)])
    across = np.mean([cos(a, b + 100) for a in range(10) for b in range(10)])
    assert inside > across + 0.3
    assert got == rows(model().setNumIterations(3).fit(df))


def test_resume_equals_an_uninterrupted_run(spark, rows, tmp_path):
    df = corpus(spark, 60)
    whole = rows(model().setNumIterations(2).fit(df))
    path = str(tmp_path / "ck")
    model().setNumIterations(1).setCheckpoint(path, 2).fit(df)
    assert checkpoint.latest_committed(spark, path) == (0, 2)
    assert rows(model().setNumIterations(2).setCheckpoint(path, 2).fit(df)) == whole
    assert checkpoint.latest_committed(spark, path) == (1, 3)
    assert checkpoint.latest_committed(spark, str(tmp_path / "none")) is None


def test_more_partitions_than_ids_and_empty_input(spark):
    df = spark.createDataFrame([([1, 2],)], "sequence array<bigint>")
    assert model().setNumPartitions(7).fit(df).count() == 4
    assert model().fit(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        SkipGram().fit(df)
    with pytest.raises(ValueError):
        SkipGram().setSamplingMode("CBOW")
    with pytest.raises(ValueError):
        SkipGram().setNegative(0)
    with pytest.raises(ValueError):
        TrainParams(checkpoint_path="x")


def test_factorization(spark):
    rows = [(u, i, float((u + i) % 2)) for u in range(12) for i in range(12) if (u * 7 + i * 3) % 5] + [(None, 1, 1.0), (1, 2, float("nan")), (1, None, 0.0)]
    df = spark.createDataFrame(rows, "user bigint, item bigint, rating float")
    m = LogisticMF().setVectorSize(8).setImplicitPref(False).setLearningRate(0.5).setNumIterations(25).setBatchSize(8).setUseBias(True)
    out = m.fit(df)
    assert out.count() == 24 and {len(r["f"]) for r in out.collect()} == {9}
    last = m.metrics.rotations[-1]
    assert last["loss"] / last["pairs"] < 0.6  # a constant guess has 0.69
    assert LogisticMF().setVectorSize(4).setMinUserCount(100).fit(df).where("NOT type").count() == 0
    with pytest.raises(ValueError, match="0 or 1"):
        m.fit(spark.createDataFrame([(1, 1, 0.5)], "user bigint, item bigint, rating float"))


def test_a_hot_user_with_large_weights_stays_finite(spark):
    """A third of the ratings by one user, weights to 45, default batch."""
    rng = np.random.default_rng(5)
    rows = [(0 if k % 3 == 0 else int(rng.integers(1, 200)), int(rng.zipf(2)) % 300, float(rng.integers(1, 46))) for k in range(9_000)]
    df = spark.createDataFrame(rows, "user bigint, item bigint, rating float")
    m = LogisticMF().setVectorSize(16).setLearningRate(0.01).setNumPartitions(2).setUseBias(True).setNumIterations(3).setSeed(1)
    f = np.array([r["f"] for r in m.fit(df).collect()])
    assert np.isfinite(f).all() and np.abs(f).max() < 50
    r = m.metrics.rotations
    assert sum(x["loss"] for x in r[-2:]) < sum(x["loss"] for x in r[:2]) and all(0 < x["largest"] <= x["pairs"] for x in r)


def test_a_hot_id_is_not_stepped_over_its_goal():
    m, at = np.zeros((3, 1)), np.array([0] * 100 + [1] * 2 + [2])
    scatter_add(m, at, np.ones((103, 1)), np.array([0.1] * 102 + [50.0]))
    assert m.ravel() == pytest.approx([20, 2, 1])  # 10 is too much for the first; the last is alone


def test_divergence_is_an_error(spark):
    df = spark.createDataFrame([(u, i, 1.0) for u in range(5) for i in range(5)], "user bigint, item bigint, rating float")
    with pytest.raises(ArithmeticError):
        LogisticMF().setVectorSize(4).setImplicitPref(False).setLearningRate(1e30).setLambdaL(1e30).setNumIterations(4).fit(df)


@pytest.mark.parametrize("power", [0.0, 0.75])
def test_negatives_are_never_the_left_id_and_follow_their_distribution(power):
    p = TrainParams(vector_size=1, pow=power)
    x = Local(p, (3,), True)
    cn = np.array([1, 2, 3, 10])
    x.load(np.full(4, True), np.arange(4), cn, np.zeros((4, 1), np.float32))
    x.start()
    for own in range(-1, 4):
        got, ok = x.negatives(np.full(40_000, own))
        share = np.bincount(got, minlength=4) / 40_000
        want = cn**power * (np.arange(4) != own)
        assert ok.all() and np.abs(share - want / want.sum()).max() < 0.02
    one = Local(p, (3,), True)
    one.load(np.array([True]), np.array([5]), np.array([1]), np.zeros((1, 1), np.float32))
    one.start()
    assert one.negatives(np.array([0, -1]))[1].tolist() == [False, True]


def test_null_weights_and_labels(spark):
    from loomfit.plans.trainer import train

    start = spark.createDataFrame([(t, k, 1, [0.5]) for t in (False, True) for k in range(2)], "type boolean, id bigint, cn bigint, f array<float>")
    made = spark.createDataFrame([(0, 0, None, 3.0), (1, 1, None, None)], "left bigint, right bigint, label float, weight float")
    _, m = train(start, lambda e: made, TrainParams(vector_size=1, negative=1, gamma=0.0, learning_rate=1e-9), same_domain=False)
    assert m.rotations[0]["loss"] == pytest.approx(4 * math.log1p(math.exp(-0.25)), abs=1e-5)
    _, m = train(start, lambda e: made, TrainParams(vector_size=1, implicit=False), same_domain=False)
    assert m.rotations[0]["pairs"] == 0


def test_setters_of_checkpoints_come_in_any_order(spark, tmp_path):
    df = corpus(spark, 20)
    model().setCheckpointInterval(3).setCheckpointPath(str(tmp_path)).setNumThread(2).setIntermediateRDDStorageLevel("DISK_ONLY").fit(df)
    assert checkpoint.latest_committed(spark, str(tmp_path)) == (0, 3)
    with pytest.raises(ValueError):
        model().setCheckpointPath(str(tmp_path)).fit(df)
    with pytest.raises(ValueError):
        model().setIntermediateRDDStorageLevel("NONE")


def test_pairs_of_an_epoch_are_made_once(spark, monkeypatch):
    calls, made = [], SkipGram.pairs
    monkeypatch.setattr(SkipGram, "pairs", lambda self, seqs, epoch: calls.append(epoch) or made(self, seqs, epoch))
    model().setNumPartitions(5).setNumIterations(2).fit(corpus(spark, 20))
    assert calls == [0, 1]


def test_implicit_query_trains_on_negative_and_absurd_ratings_too(spark, tmp_path):
    from loomfit.plans import queries

    rng = np.random.default_rng(1)
    rows = [(int(u), int(i), float(x)) for u, i, x in zip(rng.integers(0, 20, 300), rng.integers(0, 8, 300), rng.integers(1, 6, 300))]
    rows += [(100, 1, -25.0), (101, 2, 9999.0), (102, 3, float("inf")), (103, 4, None), (104, 5, float("nan"))]
    spark.createDataFrame(rows, "user bigint, item bigint, rating float").write.parquet(f"{tmp_path}/ratings.parquet")
    got = {r["id"]: r["f"] for r in queries.train_lmf_implicit(spark, str(tmp_path)).where("NOT type").collect()}
    assert {100, 101, 102} <= set(got) and not {103, 104} & set(got)
    assert all(np.isfinite(f).all() and np.abs(f).max() < 100 for f in got.values())


def test_roundtrip_query_goes_through_the_checkpoint_sink(spark, rows, monkeypatch):
    from loomfit.plans import queries

    folder, paths, write = "/root/testdata/sf0.001", [], checkpoint.write
    monkeypatch.setattr(checkpoint, "write", lambda df, path: paths.append(path) or write(df, path))
    got = queries.checkpoint_roundtrip(spark, folder)
    assert paths and all(p.rsplit("/", 1)[1] == "0_1" for p in paths)
    assert rows(got) == rows(queries.init_vectors(spark, folder).select("type", "id", "cn", "f"))
