"""All similar pairs of set-valued records, by a size-aware overlap join.

Two sets of sizes s and t have Jaccard similarity num/den or more just where they share
o(s, t) = ceil(num (s + t) / (num + den)) values, so for each two compatible sizes there is one overlap to
reach. Small sets, of which all subsets of the needed sizes are few, are met by enumerating them: two
sets with the same o(s, t)-subset, under a key that holds both sizes, are a result, so nothing is joined
in vain. A pair with a large set is met by scanning inverted lists: of each set only its rarest
s - o(s, t) + 1 values are listed, since one of them must be shared, and the places of the shared value
in both bound the overlap that is still possible. Both lots of pairs are put together and filtered by
the exact overlap.

Records with the same set are one class throughout; pairs are between classes. Values, lists and classes that
hold a large share of the rows are met by several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.operators.spread import spread_join
from termweave.session import cut

#: A set is small if it has at most so many subsets to enumerate.
MAX_SUBSETS = 128
MASK = (1 << 64) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of each number, so that sums over different subsets differ but by chance."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Sizes:
    """Which sizes are compatible, the overlap each two need and which sizes are small."""

    def __init__(self, num: int, den: int, min_size: int):
        self.num, self.den, self.min_size = num, den, min_size
        size = min_size
        while self.subsets(size) <= MAX_SUBSETS:
            size += 1
        self.first_large = size

    def overlap(self, s: int, t: int) -> int:
        return -(-self.num * (s + t) // (self.num + self.den))

    def partners(self, s: int) -> range:
        return range(max(self.min_size, -(-self.num * s // self.den)), self.den * s // self.num + 1)

    def subsets(self, s: int) -> int:
        return sum(comb(s, self.overlap(s, t)) for t in self.partners(s))


def _by_size(batch: pa.RecordBatch):
    """(size, class numbers, matrix of values) of each size in a batch (class_no, items)."""
    numbers, lists = batch.column(0).to_numpy(), batch.column(1)
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    sizes = np.diff(offsets)
    for size in np.unique(sizes):
        of = np.flatnonzero(sizes == size)
        yield int(size), numbers[of], flat[offsets[of][:, None] + np.arange(size)]


def _subset_keys(sizes: Sizes, smaller: bool):
    """Rows (key, class_no) of small sets, in the role of the smaller or of the larger set of a pair."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, numbers, values in _by_size(batch):
                mixed = _mixed(values)
                total = mixed.sum(1, dtype=np.uint64)
                for t in sizes.partners(s):
                    if (t < s if smaller else t > s) or max(s, t) >= sizes.first_large:
                        continue
                    left_out = np.array(list(combinations(range(s), s - sizes.overlap(s, t))), np.int64)
                    lo, hi = min(s, t), max(s, t)
                    with np.errstate(over="ignore"):
                        kept = total[:, None] - mixed[:, left_out].sum(2, dtype=np.uint64)
                        keys = _mixed(kept ^ np.uint64((lo * 1_000_003 + hi) & MASK)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(numbers, keys.shape[1]))], ["key", "class_no"])

    return scan


def _listed(sizes: Sizes, smaller: bool):
    """Rows (value, lo, hi, place, class_no) of the listed values, for pairs with a large set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, numbers, values in _by_size(batch):
                for t in sizes.partners(s):
                    lo, hi = min(s, t), max(s, t)
                    if (t < s if smaller else t > s) or hi < sizes.first_large:
                        continue
                    listed = s - sizes.overlap(s, t) + 1
                    rows = len(numbers) * listed
                    columns = [values[:, :listed].ravel(), np.full(rows, lo, np.int32), np.full(rows, hi, np.int32), np.tile(np.arange(listed, dtype=np.int32), len(numbers)), np.repeat(numbers, listed)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["value", "lo", "hi", "place", "class_no"])

    return scan


def set_classes(rows: DataFrame, min_size: int) -> tuple[DataFrame, DataFrame]:
    """(members, classes) of rows (record STRING, value STRING).

    members: record, class_no. classes: class_no, class_id (its least record), items (numbers of its
    values, rarest first), size, n_records. Null records and values are left out, repeated values count
    once, and records with fewer than min_size values have no class.
    """
    held = cut(rows.select("record", "value").dropna().distinct())
    values = cut(held.groupBy("value").agg(F.count("*").alias("n")).select("value", F.monotonically_increasing_id().alias("value_no"), "n"))
    numbered = spread_join(held, values, ["value"]).groupBy("record").agg(F.array_sort(F.collect_list(F.struct("n", "value_no"))).alias("items"))
    sets = numbered.where(F.size("items") >= min_size).select("record", F.transform("items", lambda x: x["value_no"]).alias("items"))
    sets = cut(sets.withColumn("digest", F.sha2(F.array_join(F.transform("items", lambda x: x.cast("string")), ","), 256)))
    classes = sets.groupBy("digest").agg(F.min("record").alias("class_id"), F.first("items").alias("items"), F.count("*").alias("n_records"))
    classes = cut(classes.select("digest", F.monotonically_increasing_id().alias("class_no"), "class_id", "items", F.size("items").alias("size"), "n_records"))
    members = cut(spread_join(sets.select("record", "digest"), classes.select("digest", "class_no"), ["digest"]).select("record", "class_no"))
    return members, classes.drop("digest")


def similar_classes(classes: DataFrame, num: int, den: int, min_size: int) -> DataFrame:
    """(class_a, class_b, overlap, n_values): classes of similarity num/den or more, each pair once.

    overlap: values in both; n_values: different values in the two together.
    """
    sizes = Sizes(num, den, min_size)
    rows = classes.select("class_no", "items")
    small = rows.where(F.size("items") < sizes.first_large)
    keys = lambda smaller, name: small.mapInArrow(_subset_keys(sizes, smaller), f"key long, {name} long")
    met = keys(True, "class_a").join(keys(False, "class_b"), "key").select("class_a", "class_b")
    lists = lambda smaller, name: rows.mapInArrow(_listed(sizes, smaller), f"value long, lo int, hi int, {name}_place int, {name} long")
    # a value in the lists of a large share of all sets is met by several tasks
    scanned = spread_join(cut(lists(True, "class_a")), lists(False, "class_b"), ["value", "lo", "hi"])
    needed = F.ceil(F.lit(num) * (F.col("lo") + F.col("hi")) / F.lit(num + den))
    possible = F.least("class_a_place", "class_b_place") + 1 + F.least(F.col("lo") - F.col("class_a_place"), F.col("hi") - F.col("class_b_place")) - 1
    scanned = scanned.where(possible >= needed).select("class_a", "class_b")
    candidates = met.unionByName(scanned).where("class_a <> class_b").select(F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b")).distinct()
    side = lambda s: classes.select(F.col("class_no").alias(f"class_{s}"), F.col("items").alias(f"items_{s}"))
    candidates = cut(candidates)
    both = spread_join(spread_join(candidates, side("a"), ["class_a"]), side("b"), ["class_b"], counted_on=candidates).withColumn("overlap", F.size(F.array_intersect("items_a", "items_b")))
    both = both.withColumn("n_values", F.size("items_a") + F.size("items_b") - F.col("overlap"))
    return both.where(F.lit(den) * F.col("overlap") >= F.lit(num) * F.col("n_values")).select("class_a", "class_b", "overlap", "n_values")


def record_pairs(members: DataFrame, linked: DataFrame) -> DataFrame:
    """(record_a, record_b), record_a < record_b by code point: the pairs of classes and copies expanded."""
    side = lambda s: members.select(F.col("class_no").alias(f"class_{s}"), F.col("record").alias(f"record_{s}"))
    across = spread_join(spread_join(linked.select("class_a", "class_b"), side("a"), ["class_a"]), side("b"), ["class_b"], counted_on=linked)
    same = [members.select("class_no", F.col("record").alias(f"record_{s}")) for s in "ab"]
    copies = spread_join(*same, ["class_no"]).where("record_a < record_b")
    pairs = across.select("record_a", "record_b").unionByName(copies.select("record_a", "record_b"))
    return pairs.select(F.least("record_a", "record_b").alias("record_a"), F.greatest("record_a", "record_b").alias("record_b"))


def class_links(members: DataFrame, classes: DataFrame, linked: DataFrame) -> DataFrame:
    """One row per record with a class: record, class_id, class_size, n_links (other records as similar, copies too)."""
    sized = classes.select("class_no", "class_id", "n_records")
    ways = linked.select(F.col("class_a").alias("class_no"), F.col("class_b").alias("to")).unionByName(linked.select(F.col("class_b").alias("class_no"), F.col("class_a").alias("to")))
    links = ways.join(sized.select(F.col("class_no").alias("to"), "n_records"), "to").groupBy("class_no").agg(F.sum("n_records").alias("others"))
    rows = sized.join(links, "class_no", "left").withColumn("n_links", F.coalesce("others", F.lit(0)) + F.col("n_records") - 1)
    return spread_join(members, rows, ["class_no"]).select("record", "class_id", F.col("n_records").alias("class_size"), "n_links")
