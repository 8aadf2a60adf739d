"""Queries on keys that hold most records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfit.operators.quantiles import keyed_quantiles
from loomfit.sources.tables import table

#: Share of the rows from which a key counts as hot.
HOT_SHARE = 0.01
PROBS = (0.25, 0.5, 0.75)


def keyed_values(spark: SparkSession, d: str) -> DataFrame:
    """``field, key, value``: ratings by user and by item, and the seconds of every sequence element by its id."""
    sides = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("key")) for c in ("user", "item")])).alias("x")
    rated = table(spark, d, "ratings").select(sides, F.col("rating").cast("double").alias("value")).select("x.field", "x.key", "value")
    seqs = table(spark, d, "item_seqs").select("secs", F.posexplode("sequence").alias("pos", "key")).where("key IS NOT NULL AND key <> 0")
    events = seqs.select(F.lit("sequence").alias("field"), "key", F.get("secs", "pos").cast("double").alias("value"))
    return rated.unionByName(events)


def p4_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Rows and quartiles of every key, each field's keys together."""
    return keyed_quantiles(keyed_values(spark, d), ["field", "key"], "value", PROBS).withColumnRenamed("key", "id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys with at least ``HOT_SHARE`` of their field's rows, from the merged counts."""
    per_key = p4_quantiles(spark, d)
    total = F.broadcast(per_key.groupBy("field").agg(F.sum("n").alias("total")))  # three rows
    hot = per_key.join(total, "field").where(F.col("id").isNotNull() & (F.col("n") >= F.col("total") * HOT_SHARE - 1e-9))
    return hot.select("field", "id")


KEYED = """WITH e AS (SELECT secs, sequence, unnest(range(1, len(sequence) + 1)) AS i FROM item_seqs),
 v AS (SELECT 'user' AS field, "user" AS id, CAST(rating AS DOUBLE) AS v FROM ratings
  UNION ALL SELECT 'item', item, CAST(rating AS DOUBLE) FROM ratings
  UNION ALL SELECT 'sequence', sequence[i], CAST(secs[i] AS DOUBLE) FROM e WHERE sequence[i] IS NOT NULL AND sequence[i] <> 0)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p4_found": p4_found, "p4_quantiles": p4_quantiles}

SQL = {
    "p4_found": KEYED + f", k AS (SELECT field, id, count(*) AS n FROM v GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY field) AS total FROM k)"
    f" SELECT field, id FROM t WHERE id IS NOT NULL AND n >= {HOT_SHARE} * total",
    "p4_quantiles": KEYED + """, g AS (SELECT field, id, CASE WHEN isfinite(v) THEN v END AS v FROM v),
 k AS (SELECT field, id, count(*) AS n, count(v) AS n_values FROM g GROUP BY ALL),
 r AS (SELECT field, id, v, row_number() OVER (PARTITION BY field, id ORDER BY v) AS r FROM g WHERE v IS NOT NULL)
SELECT k.field, k.id, n, n_values, max(CASE WHEN r = ceil(n_values * 0.25) THEN v END) AS q25,
 max(CASE WHEN r = ceil(n_values * 0.5) THEN v END) AS q50, max(CASE WHEN r = ceil(n_values * 0.75) THEN v END) AS q75
FROM k LEFT JOIN r ON k.field = r.field AND k.id IS NOT DISTINCT FROM r.id GROUP BY ALL""",
}
