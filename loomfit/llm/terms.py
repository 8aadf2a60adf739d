"""Frequency of every distinct term: occurrences and records, by sorting (term, record) pairs.

Pairs are sorted and run-length scanned in blocks first, so a hot term leaves a task as one row per block. The
partial counts are range-partitioned by term, sorted by Spark's external sort and scanned once more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfit.session import store, tasks

#: (term, record) pairs sorted at once in a task.
BLOCK_PAIRS = 2_000_000
#: Partial counts that a task merges.
TASK = 500_000
SCHEMA = "term bigint, occurrences bigint, records bigint"


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Start positions of the runs of equal values."""
    return np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]) if len(sorted_values) else np.empty(0, np.int64)


def _partial(records: DataFrame) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms: list[np.ndarray] = []
        rows: list[np.ndarray] = []
        held = row = filled = 0

        def out() -> pa.RecordBatch:
            t, r = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (terms, rows))
            order = np.lexsort((r, t))
            t, r = t[order], r[order]
            starts = runs(t)
            new = np.r_[True, (t[1:] != t[:-1]) | (r[1:] != r[:-1])] if len(t) else np.empty(0, bool)
            n = np.diff(np.r_[starts, len(t)])
            rec = np.add.reduceat(new.astype(np.int64), starts) if len(t) else n
            term = pa.concat_arrays([pa.array(t[starts], pa.int64()), pa.nulls(1, pa.int64())])
            return pa.RecordBatch.from_arrays([term, pa.array(np.r_[n, 0].astype(np.int64)), pa.array(np.r_[rec, filled].astype(np.int64))], ["term", "occurrences", "records"])

        for b in batches:
            col = b.column(0)
            size = np.diff(np.asarray(col.offsets))
            flat = col.values.slice(col.offsets[0].as_py(), int(size.sum()))
            known = np.asarray(flat.is_valid())
            x = flat.fill_null(0).to_numpy(zero_copy_only=False)
            size = np.where(np.asarray(col.is_valid()), size, 0) if col.null_count else size
            r = np.repeat(np.arange(row, row + len(col)), size)
            ok = known & (x != 0)
            terms.append(x[ok])
            rows.append(r[ok])
            filled += int((size > 0).sum())
            row += len(col)
            held += int(ok.sum())
            if held >= BLOCK_PAIRS:
                yield out()
                terms.clear(), rows.clear()
                held = filled = 0
        if held or filled:
            yield out()

    return records.mapInArrow(scan, SCHEMA)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length scan over rows sorted by term; the last run of a batch is carried to the next."""
    last: tuple[int, int, int] | None = None

    def batch(t: np.ndarray, o: np.ndarray, r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(o, pa.int64()), pa.array(r, pa.int64())], ["term", "occurrences", "records"])

    for b in batches:
        if not b.num_rows:
            continue
        t, o, r = (b.column(k).to_numpy() for k in range(3))
        if last:
            t, o, r = np.r_[last[0], t], np.r_[last[1], o], np.r_[last[2], r]
        starts = runs(t)
        t, o, r = t[starts], np.add.reduceat(o, starts), np.add.reduceat(r, starts)
        last = (int(t[-1]), int(o[-1]), int(r[-1]))
        if len(t) > 1:
            yield batch(t[:-1], o[:-1], r[:-1])
    if last:
        yield batch(*(np.array([x]) for x in last))


def term_frequencies(records: DataFrame) -> tuple[DataFrame, int]:
    """Occurrences and records of every term, and the number of records with at least one element of any kind.

    ``records`` has one ARRAY<BIGINT> column, a record per row; null and 0 are no terms; null and empty arrays hold
    none. Columns: ``term, occurrences, records``; no rows for an empty input.
    """
    parts = store(_partial(records), "terms")
    told = parts.df.agg(F.sum(F.when(F.col("term").isNull(), F.col("records"))).alias("filled"), F.count("term").alias("n")).first()
    ordered = parts.df.where("term IS NOT NULL").repartitionByRange(tasks(told["n"], TASK), "term").sortWithinPartitions("term")
    counts = store(ordered.mapInArrow(_merge, SCHEMA), "term_counts").df
    parts.drop()
    return counts, told["filled"] or 0
