"""Joins and positions that keep no key and no group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.session import cut

#: Rows of one key that a task takes; a key with more is spread over several.
HOT_ROWS = 1_000_000
#: At most so many keys are spread: a key must hold more than a HOT_KEYS-th of all rows, too.
HOT_KEYS = 10_000
#: A table of at most so many short rows goes to all tasks in ``sent_join``; its rows are counted before.
SENT_ROWS = 500_000


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", counted_on: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right`` on ``keys``, where one key may hold any share of the rows of ``left``.

    A key with more than HOT_ROWS rows on the left is dealt to one task per HOT_ROWS rows, by a hash of the
    row, and its rows on the right go to each of these. The hot keys are counted first, unless all rows are no more than
    that, so ``left`` is best a table or a cheap plan; there are at most HOT_KEYS of them, and they are what is broadcast. how: 'inner',
    'left', 'left_semi' or 'left_anti'. Null keys match nothing. counted_on: a cheaper frame with about as many rows of each key.
    counts: the keys with n_of_key, their rows on the left, where these are known already; then nothing is counted.
    """
    keys, counted = list(keys), left if counted_on is None else counted_on
    if counts is None:
        if counted.count() <= HOT_ROWS:
            return left.join(right, keys, how)
        counts = counted.groupBy(*keys).agg(F.count("*").alias("n_of_key"))
    hot = counts.where(F.col("n_of_key") > HOT_ROWS).orderBy(F.col("n_of_key").desc()).limit(HOT_KEYS).collect()
    if not hot:
        return left.join(right, keys, how)
    kinds = dict(left.dtypes)
    rows = [(*[r[k] for k in keys], -(-r["n_of_key"] // HOT_ROWS)) for r in hot]
    shares = F.broadcast(left.sparkSession.createDataFrame(rows, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "n_tasks_of_key long"])))
    share = F.coalesce("n_tasks_of_key", F.lit(1).cast("long"))
    dealt = left.join(shares, keys, "left").withColumn("task_of_key", F.pmod(F.xxhash64(*left.columns), share)).drop("n_tasks_of_key")
    copied = right.join(shares, keys, "left").withColumn("task_of_key", F.explode(F.sequence(F.lit(0).cast("long"), share - 1))).drop("n_tasks_of_key")
    return dealt.join(copied, [*keys, "task_of_key"], how).drop("task_of_key")


def sent_join(left: DataFrame, right: DataFrame, keys: Sequence[str], n_right: int, counts: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right``, a table of ``n_right`` rows that goes to all tasks if these are at most SENT_ROWS; else see ``spread_join``."""
    return left.join(F.broadcast(right), list(keys)) if n_right <= SENT_ROWS else spread_join(left, right, keys, counts=counts)


def range_parts(rows: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """``rows`` as a table with ``part_of_range``, the number of the range of ``order`` that a row is in. A tie is not torn apart."""
    return cut(rows.repartitionByRange(partitions(rows), *order).withColumn("part_of_range", F.spark_partition_id()))


def parts_before(per_part: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """(group, part_of_range, name) of the groups in several parts: the sum of ``value`` over the parts before.

    per_part: group, part_of_range, value, a row per group and part. Only the first and last group of a part can
    reach into others, so there are at most two rows per part.
    """
    by_group = Window.partitionBy(group)
    before = F.sum(value).over(by_group.orderBy("part_of_range").rowsBetween(Window.unboundedPreceding, -1))
    return per_part.withColumn(name, F.coalesce(before, F.lit(0))).withColumn("n_parts", F.count("*").over(by_group)).where("n_parts > 1").select(group, "part_of_range", name)


def positions(rows: DataFrame, group: str, order: Sequence[Column], name: str) -> DataFrame:
    """``rows`` with ``name``: the place from 1 on of each row in its group.

    order must tell the rows of a group apart. The rows are range-sorted over the cluster; a part
    numbers its own, and the sizes of a group's parts before are added, so a group is never in one task.
    """
    placed = range_parts(rows, [F.col(group), *order])
    offsets = parts_before(placed.groupBy(group, "part_of_range").agg(F.count("*").alias("rows_in_part")), group, "rows_in_part", "rows_before_part")
    local = F.row_number().over(Window.partitionBy(group, "part_of_range").orderBy(*order))
    numbered = placed.withColumn(name, local).join(F.broadcast(offsets), [group, "part_of_range"], "left")
    return numbered.withColumn(name, (F.col(name) + F.coalesce("rows_before_part", F.lit(0))).cast("long")).drop("rows_before_part", "part_of_range")
