import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomfit.operators import kernel, packed
from loomfit.operators.kernel import Local, scatter_add
from loomfit.params import TrainParams
from loomfit.plans import trainer

NAMES = ["rotation", "part", "left", "right", "label", "weight"]


def made(n, order, each, weight):
    rng = np.random.default_rng(2)
    left, right, cell = rng.integers(-50, 50, n), rng.integers(-(1 << 62), 1 << 62, n) % 40, rng.integers(0, 4, n)
    w = pa.array([None if k % 7 == 0 else float(k % 5) for k in left.tolist()] if weight else [None] * n, pa.float32()).take(order)
    whole = pa.RecordBatch.from_arrays([pa.array((cell // 2)[order].astype(np.int32)), pa.array((cell % 2)[order].astype(np.int32)), pa.array(left[order]), pa.array(right[order]), pa.nulls(n, pa.float32()), w], NAMES)
    return [whole.slice(k, each) for k in range(0, n, each)]


@pytest.mark.parametrize("weight", [False, True])
def test_pairs_are_packed_whole_and_come_in_one_order(monkeypatch, weight):
    """Whatever the order and size of batches, blocks and buckets: every pair once, nulls as nulls, one order."""
    seen = []
    for order, each, block, buckets in ((np.arange(3_000), 3_000, 1 << 20, 1), (np.random.default_rng(3).permutation(3_000), 170, 500, 5)):
        monkeypatch.setattr(packed, "BLOCK", block)
        rows = pa.Table.from_batches(packed.pack(iter(made(3_000, order, each, weight)), 2))
        assert max(rows["n"].to_pylist()) <= packed.PIECE and sum(rows["n"].to_pylist()) == 3_000
        mine = rows.filter((pa.compute.field("rotation") == 1) & (pa.compute.field("part") == 0)).rename_columns([*rows.column_names[:-1], "given"])
        if buckets > 1:
            mine = pa.Table.from_batches(packed.split(iter(mine.to_batches()), buckets, (1, 2, 3))).sort_by("bucket")
            assert set(mine["bucket"].to_pylist()) == set(range(buckets))
        else:
            mine = mine.append_column("bucket", pa.array(np.zeros(len(mine), np.int32)))
        got = list(packed.ordered(iter(mine.to_batches(max_chunksize=3)), (1, 2, 3)))
        assert len(got) == buckets
        left, right = (np.concatenate([g[k] for g in got]).tolist() for k in range(2))
        given = np.concatenate([np.full(len(g[0]), packed.NULL) if g[2] is None else g[2] for g in got])
        seen.append(list(zip(left, right, [None if x == packed.NULL else float(x.view(np.float32)) for x in given])))
    assert seen[0] == seen[1]
    whole = made(3_000, np.arange(3_000), 3_000, weight)[0].to_pylist()
    assert sorted(seen[0], key=str) == sorted(((r["left"], r["right"], r["weight"]) for r in whole if (r["rotation"], r["part"]) == (1, 0)), key=str)


def test_a_rotation_exchanges_pieces_not_pairs(spark):
    p = TrainParams(vector_size=2, num_partitions=2)
    pairs = spark.range(20_000).select((F.col("id") % 10).alias("left"), (F.col("id") % 7).alias("right"), F.lit(None).cast("float").alias("label"), F.lit(None).cast("float").alias("weight"))
    start = spark.range(10).select(F.explode(F.array(F.lit(False), F.lit(True))).alias("type"), "id", F.lit(1).cast("bigint").alias("cn"), F.array(F.lit(0.1), F.lit(0.2)).cast("array<float>").alias("f"))
    stored = trainer.epoch_pairs(pairs, 0, 2)
    most = trainer.most_pairs(stored.df)
    assert stored.df.agg(F.sum("n")).first()[0] == 20_000 and set(most) == {0, 1}
    assert trainer.exchange(start, stored.df.where("rotation = 0"), most[0], 0, 0, p).count() < 300


def test_batches_to_python_are_not_measured_row_by_row(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    with trainer.arrow(spark, 100):
        assert spark.conf.get(key) == str((1 << 31) - 1)
    assert spark.conf.get(key, None) == before


def test_ids_are_found_by_table_and_by_search(monkeypatch):
    ids, x = np.array([-5, 0, 3, 9]), np.array([-(1 << 62), -5, 1, 9, 10, 3, 1 << 62])
    for span in (packed.PIECE, 0):
        monkeypatch.setattr(kernel, "SPAN", span)
        k = Local(TrainParams(vector_size=1), (1,), False)
        k.load(np.full(4, True), ids, np.ones(4, np.int64), np.zeros((4, 1), np.float32))
        k.start()
        assert (k.places[1] is None) == (span == 0)
        assert k.find(1, x).tolist() == [-1, 0, -1, 3, -1, 2, -1] and k.find(0, x).tolist() == [-1] * 7


def test_scatter_add_equals_adding_one_by_one():
    rng = np.random.default_rng(4)
    for n in (3, 40, 5_000):
        at, rows, m = rng.integers(0, n, 300), rng.random((300, 2)), rng.random((n, 2))
        want = m.copy()
        np.add.at(want, at, rows)
        scatter_add(m, at, rows, np.zeros(300), m[at], np.empty(n, np.intp))
        assert np.allclose(m, want)
