"""Scans of the input tables and the sequences and ratings built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sequences(df: DataFrame) -> DataFrame:
    """The column ``sequence`` as ARRAY<BIGINT>. Narrower integer ids are widened, other columns are dropped."""
    return df.select(F.col("sequence").cast("array<bigint>").alias("sequence"))


def ratings(df: DataFrame) -> DataFrame:
    """The columns ``user, item, rating`` as BIGINT, BIGINT, FLOAT. A DOUBLE rating is refused: it would lose digits."""
    if dict(df.dtypes).get("rating") == "double":
        raise TypeError("rating must be FLOAT; cast it first")
    return df.select(F.col("user").cast("bigint").alias("user"), F.col("item").cast("bigint").alias("item"), F.col("rating").cast("float").alias("rating"))


def baskets(lineitem: DataFrame) -> DataFrame:
    """Orders as sequences of parts, in the order of ``(l_linenumber, l_partkey)``. Adds ``l_orderkey``."""
    line = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    return lineitem.groupBy("l_orderkey").agg(F.transform(line, lambda x: x["l_partkey"]).alias("sequence"))


def signed_baskets(lineitem: DataFrame) -> DataFrame:
    """Orders as two-role sequences: parts as ``l_partkey + 1``, then suppliers as ``-(l_suppkey + 1)``."""
    line = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    both = F.concat(F.transform("x", lambda x: x["l_partkey"] + 1), F.transform("x", lambda x: -(x["l_suppkey"] + 1)))
    return lineitem.groupBy("l_orderkey").agg(line.alias("x")).select("l_orderkey", both.alias("sequence"))


def basket_ratings(lineitem: DataFrame, orders: DataFrame, explicit: bool = False) -> DataFrame:
    """Customers' ratings of parts: the quantity, or with ``explicit`` 1 for returned lines and 0 for others."""
    rating = F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0) if explicit else F.col("l_quantity")
    lines = lineitem.select("l_orderkey", F.col("l_partkey").alias("item"), rating.cast("float").alias("rating"))
    return lines.join(orders.select("o_orderkey", F.col("o_custkey").alias("user")), F.col("l_orderkey") == F.col("o_orderkey")).select("user", "item", "rating")
