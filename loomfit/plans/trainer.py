"""Block-stratified training: in every rotation each partition trains the pairs both of whose vectors it holds."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfit.functions.hashing import owners, partitions
from loomfit.operators.kernel import OUT, train_partition
from loomfit.operators.packed import BLOCK, PACKED, SPLIT, pack, split
from loomfit.params import TrainParams
from loomfit.session import Stored, ship, store, tasks
from loomfit.sources import checkpoint

#: All pairs of an epoch: ``left, right, label, weight``.
Pairs = Callable[[int], DataFrame]
PAIR = ("left", "right", "label", "weight")
#: Rows of a batch of vectors and pieces: a piece has up to 10 KB.
ROWS = 2_048


@dataclass
class Metrics:
    """Loss of every rotation: summed over its pairs and negatives, and its L2 term; pairs, and those of the largest partition."""

    rotations: list[dict[str, float]] = field(default_factory=list)


def dealt(vectors: DataFrame, epoch: int, rotation: int, n: int) -> DataFrame:
    """Adds ``part``, the partition that holds a vector in this rotation."""
    both = partitions(vectors, epoch, rotation, n, "id", "id")
    return both.withColumn("part", F.when(F.col("type"), F.col("right_part")).otherwise(F.col("left_part"))).drop("left_part", "right_part")


@contextmanager
def arrow(spark: SparkSession, rows: int | None = None) -> Iterator[None]:
    """Batches to Python of so many rows, or as many as the session says, and of any size unless the session limits it.

    With the limit 11.7 million pairs took about 1.6 s more to reach Python than to be made, without it 0.2 s: presumably a batch
    is measured after each of its rows. Rows here are of known length.
    """
    wanted = {"spark.sql.execution.arrow.maxBytesPerBatch": (1 << 31) - 1, "spark.sql.execution.arrow.maxRecordsPerBatch": rows}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        if v and (rows or before[k] is None):
            spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def epoch_pairs(pairs: DataFrame, epoch: int, n: int) -> Stored:
    """All pairs of an epoch, made once, packed and written by the rotation that owns them: each rotation reads its own only."""
    spark = pairs.sparkSession
    here = owners(pairs.select(*PAIR), epoch, n, *PAIR[:2]).select("rotation", "part", *PAIR)
    made = here.mapInArrow(lambda batches: pack(batches, n), PACKED)
    if n > 1:  # a rotation's rows into few files, but not into one task
        each = tasks(2 * spark.sparkContext.defaultParallelism, n)
        made = made.repartitionById(n * each, (F.col("rotation") * each + F.col("part") % each).cast("int"))
    with arrow(spark):
        return store(made, "pairs", by="rotation")


def most_pairs(packed: DataFrame) -> dict[int, int]:
    """Pairs of the largest partition of every rotation that has any."""
    each = packed.groupBy("rotation", "part").agg(F.sum("n").alias("n")).groupBy("rotation").agg(F.max("n").alias("n"))
    return {r["rotation"]: r["n"] for r in each.collect()}


def exchange(vectors: DataFrame, pairs: DataFrame, most: int, epoch: int, rotation: int, p: TrainParams) -> DataFrame:
    """Vectors and a rotation's packed pairs, ``most`` in a partition, in one shuffle: partition k holds its vectors first,
    then its pairs in ranges of their keys, so many that a range has about ``BLOCK`` pairs."""
    none = lambda kind: F.lit(None).cast(kind)
    mine = pairs.select("part", "n", "left", "right", F.col("weight" if p.implicit else "label").alias("given"))
    buckets, salt = tasks(most, BLOCK), p.salt(epoch, rotation)
    mine = mine.mapInArrow(lambda batches: split(batches, buckets, salt), SPLIT) if buckets > 1 else mine.withColumn("bucket", F.lit(0))
    held = dealt(vectors, epoch, rotation, p.num_partitions).select(F.lit(-1).alias("bucket"), "part", "type", "id", "cn", "f", none("bigint").alias("n"), *[none("binary").alias(c) for c in ("left", "right", "given")])
    mine = mine.select("bucket", "part", none("boolean").alias("type"), none("bigint").alias("id"), none("bigint").alias("cn"), none("array<float>").alias("f"), "n", "left", "right", "given")
    return held.unionByName(mine).repartitionById(p.num_partitions, "part").sortWithinPartitions("bucket")


def train(start: DataFrame, pairs: Pairs, p: TrainParams, same_domain: bool) -> tuple[DataFrame, Metrics]:
    """Train ``start`` (``type, id, cn, f``) for all epochs and rotations, and return the stored vectors.

    The pairs of an epoch are made in one scan. Each rotation is one shuffle and is written before the next begins, so
    lineage stays short and a lost executor costs one rotation. With a checkpoint path the latest committed state there is
    taken up instead of ``start``. A loss or vector that is not finite is an ArithmeticError.
    """
    spark, n = start.sparkSession, p.num_partitions
    ship(spark)
    found = checkpoint.latest_committed(spark, p.checkpoint_path) if p.checkpoint_path else None
    epoch0, done = found or (0, 0)
    kept: Stored | None = None
    if found:
        now = checkpoint.read(spark, f"{p.checkpoint_path}/{epoch0}_{done}")
    else:
        kept = store(start, "vectors")
        now = kept.df
    metrics = Metrics()
    for epoch in range(epoch0, p.num_iterations):
        first = done if epoch == epoch0 else 0
        made = epoch_pairs(pairs(epoch), epoch, n) if first < n else None
        most = most_pairs(made.df) if made else {}
        for rotation in range(first, n):

            def kernel(batches: Iterator[pa.RecordBatch], seed: tuple[int, ...] = p.salt(epoch, rotation)) -> Iterator[pa.RecordBatch]:
                return train_partition(batches, p, seed, same_domain)

            mine = made.df.where(F.col("rotation") == rotation)
            with arrow(spark, ROWS):
                out = store(exchange(now, mine, most.get(rotation, 0), epoch, rotation, p).mapInArrow(kernel, OUT), "vectors")
            told = out.df.where("type IS NULL").agg(F.sum("loss").alias("loss"), F.sum("penalty").alias("penalty"), F.sum("pairs").alias("pairs"), F.max("pairs").alias("largest")).first()
            metrics.rotations.append({"epoch": epoch, "rotation": rotation, **{k: told[k] or 0 for k in ("loss", "penalty", "pairs", "largest")}})
            if not math.isfinite(told["loss"] or 0):
                raise ArithmeticError(f"training diverged in rotation {rotation} of epoch {epoch}: lower the learning rate, the weights or the batch size")
            if kept:
                kept.drop()
            kept = out
            now = out.df.where("type IS NOT NULL").select("type", "id", "cn", "f")
            if p.checkpoint_interval and (epoch * n + rotation + 1) % p.checkpoint_interval == 0:
                now = checkpoint.write(now, f"{p.checkpoint_path}/{epoch}_{rotation + 1}")
                kept.drop()
                kept = None
        if made:
            made.drop()
    return now, metrics
