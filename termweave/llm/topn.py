"""The N best items of every group, by exact positions in a global sort.

Rows are range-partitioned and sorted by group, score and item over the whole cluster, so a group of any
size is spread over as many partitions as it needs. A partition numbers the rows of each group it holds
and passes on those within the first N of their part, since a row's position in the whole group is no
smaller than in the part. Only a partition's first and last group can reach into others; for these it
also tells how many rows it holds. Summing those counts over the partitions before gives exact positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _first_rows(n: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        names = ["grp", "score", "item", "part", "place", "held"]

        def count(group: str, held: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([group]), pa.array([None], pa.float64()), pa.array([None], pa.string()), pa.array([part], pa.int32()), pa.array([None], pa.int64()), pa.array([held], pa.int64())], names)

        current, held, in_first = None, 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column(0)
            starts = np.ones(batch.num_rows, bool)
            starts[1:] = pc.not_equal(group[1:], group[:-1]).to_numpy(zero_copy_only=False)
            if group[0].as_py() != current:
                if current is not None and in_first:
                    yield count(current, held)
                    in_first = False
                held = 0
            first = np.flatnonzero(starts)
            run = np.cumsum(starts) - 1
            place = np.arange(batch.num_rows) - first[run]
            place[run == 0] += held
            if len(first) > 1 and in_first:
                yield count(group[0].as_py(), held + int(first[1]))
                in_first = False
            current, held = group[-1].as_py(), int(place[-1]) + 1
            kept = np.flatnonzero(place < n)
            if len(kept):
                some = batch.take(pa.array(kept))
                size = len(kept)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.full(size, part, np.int32)), pa.array(place[kept] + 1), pa.nulls(size, pa.int64())], names)
        if current is not None:
            yield count(current, held)

    return scan


def top_n(rows: DataFrame, n: int) -> DataFrame:
    """(grp, item, score, position) of the n items with the lowest score in each group, from 1 on.

    rows: grp STRING, item STRING, score DOUBLE. Rows with a null in any of these, or a NaN score, are left
    out; an item that comes again in its group counts once, with its lowest score. Equal scores are
    taken in code-point order of the item; -0.0 equals 0.0. Other columns play no part. Groups with fewer
    items give all of them; no rows give none.
    """
    valid = rows.select("grp", "item", (F.col("score").cast("double") + F.lit(0.0)).alias("score")).where("grp IS NOT NULL AND item IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)")
    once = valid.groupBy("grp", "item").agg(F.min("score").alias("score")).select("grp", "score", "item")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = once.repartitionByRange(parts, "grp", "score", "item").sortWithinPartitions("grp", "score", "item")
    kept = ordered.mapInArrow(_first_rows(n), "grp string, score double, item string, part int, place long, held long")
    before = F.sum("held").over(Window.partitionBy("grp").orderBy("part").rangeBetween(Window.unboundedPreceding, -1))
    placed = kept.withColumn("position", F.col("place") + F.coalesce(before, F.lit(0)))
    return placed.where(F.col("item").isNotNull() & (F.col("position") <= n)).select("grp", "item", "score", "position")
