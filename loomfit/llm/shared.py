"""Inputs that several operators of this subpackage read in the same way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_id(x: Column) -> Column:
    """An element that counts as an id: neither null nor 0."""
    return x.isNotNull() & (x != F.lit(0))


def counting_copies(seqs: DataFrame, *columns: str) -> DataFrame:
    """One row per ``seq_id``: the delivery with the latest ``loaded_at``.

    Columns: ``seq_id``, ``dup`` and the columns asked for. Rows with a null ``seq_id`` cannot be matched with
    each other, so each stays a sequence of its own; ``dup`` tells them apart (0 for all others). A null
    ``loaded_at`` is the earliest; on equal times the longer array counts, then the larger hash of the content.
    The top row is picked before the shuffle as well as after it, so many copies of one sequence stay cheap.
    """
    keep = list(dict.fromkeys(columns))
    content = [c for c in ("sequence", "secs") if c in keep]
    rows = seqs.select("seq_id", "loaded_at", *[c for c in keep if c not in ("seq_id", "loaded_at")])
    rows = rows.withColumn("dup", F.when(F.col("seq_id").isNull(), F.monotonically_increasing_id() + 1).otherwise(F.lit(0)))
    order = [F.col("loaded_at").desc_nulls_last()]
    if content:
        order += [F.size(content[0]).desc(), F.xxhash64(*content).desc()]
    w = Window.partitionBy("seq_id", "dup").orderBy(*order)
    return rows.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").select("seq_id", "dup", *[c for c in keep if c not in ("seq_id", "dup")])
