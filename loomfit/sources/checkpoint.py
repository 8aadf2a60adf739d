"""Parquet checkpoints ``<path>/<epoch>_<iteration>`` of trained vectors, and finding the latest committed one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "type boolean, id bigint, cn bigint, f array<float>"


def write(vectors: DataFrame, path: str) -> DataFrame:
    """Write the vectors, replacing what is there, and read them back: the result has no lineage."""
    vectors.select("type", "id", "cn", "f").write.mode("overwrite").parquet(path)
    return read(vectors.sparkSession, path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def listing(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """Names under ``path`` and whether each has a ``_SUCCESS`` file. A missing path is empty; other errors are raised."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return []
    found = [s.getPath() for s in fs.listStatus(root)]
    return sorted((p.getName(), fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))) for p in found)


def latest(names: DataFrame) -> DataFrame:
    """``epoch, iter`` of the latest of ``name, committed``: the largest pair of numbers; no row if there is none.

    Names are two whole numbers joined by ``_``; anything else, ``run_params`` included, and uncommitted ones are skipped.
    """
    whole = F.col("committed") & F.col("name").rlike(r"^\d+_\d+$")
    part = lambda k: F.split_part("name", F.lit("_"), F.lit(k)).cast("int")
    at = names.where(whole).select(F.struct(part(1).alias("epoch"), part(2).alias("iter")).alias("at")).agg(F.max("at").alias("at"))
    return at.where("at IS NOT NULL").select("at.epoch", "at.iter")


def latest_committed(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """Epoch and number of finished rotations of the latest checkpoint under ``path``."""
    names = listing(spark, path)
    row = latest(spark.createDataFrame(names, "name string, committed boolean")).first() if names else None
    return (row["epoch"], row["iter"]) if row else None
