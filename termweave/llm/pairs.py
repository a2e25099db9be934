"""Items that appear together: exact pair counts and how far they exceed chance.

Chance is the bipartite configuration model of largest entropy: record r holds item i with probability
x_r y_i / (1 + x_r y_i), with x and y fitted so that every record has its size and every item its
frequency on average. Records of one size share x and items of one frequency share y, so the fit needs
the two histograms only. Under this null the number of records with both items is Poisson-binomial; its
upper tail is the p value, and Benjamini-Hochberg gives q over all pairs of items, those that never meet included.

Pairs are enumerated within records, never within an item's records. A large record is split into blocks
of items, and each two of its blocks meet in a task of their own choice, so no record is held whole.
Asking for pairs in at least m records first drops items in fewer than m records, which loses no pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.operators.spread import partitions, range_parts, spread_join
from termweave.session import cut

#: Items of a block; records with more are split.
BLOCK = 64
#: Sizes and frequencies up to this are classes of their own; above, a class of items spans about 1/256 of its value and one of records 1/64.
EXACT_CLASSES, ITEM_STEPS, RECORD_STEPS = 512, 256, 64
#: An item's number holds its class above so many bits.
CLASS_BITS = 48
#: Steps of the fit, and the relative error at which it ends.
FIT_STEPS, FIT_ERROR = 500, 1e-9


def _size_class(value: Column, steps: int) -> Column:
    """Number of the class of a size or frequency; at most EXACT_CLASSES + steps ln(value / EXACT_CLASSES) of them."""
    return F.when(value <= EXACT_CLASSES, value).otherwise(EXACT_CLASSES + 1 + F.floor(F.log(value / EXACT_CLASSES) * steps)).cast("long")


def fit_null(sizes: pd.DataFrame, frequencies: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x per record class, y per item class and the records of each record class.

    Both frames have value (mean of the class) and n (its members); values are positive.
    """
    d, m = sizes["value"].to_numpy(float), sizes["n"].to_numpy(float)
    s, k = frequencies["value"].to_numpy(float), frequencies["n"].to_numpy(float)
    total = max((d * m).sum(), 1.0)
    x, y = d / math.sqrt(total), s / math.sqrt(total)
    for _ in range(FIT_STEPS):
        shared = 1 / (1 + np.outer(x, y))
        new_x = d / np.maximum((shared * (k * y)).sum(1), 1e-300)
        shared = 1 / (1 + np.outer(new_x, y))
        new_y = s / np.maximum((shared * (m * new_x)[:, None]).sum(0), 1e-300)
        new_x, new_y = np.minimum(new_x, 1e12), np.minimum(new_y, 1e12)
        moved = max(np.abs(new_x / x - 1).max(), np.abs(new_y / y - 1).max())
        x, y = new_x, new_y
        if moved < FIT_ERROR:
            break
    return x, y, m


def upper_tails(p: np.ndarray, weight: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and P(X >= count), of sums of independent trials: row i has weight[j] trials of chance p[i, j].

    Saddlepoint approximation for counts on a lattice; at a count near the mean the normal one with the
    skewness term, where the saddlepoint's is 0/0. A count of 0 has tail 1, one beyond all trials 0.
    """
    p = np.clip(p, 0.0, 1 - 1e-12)
    mean = p @ weight
    var = np.maximum((p * (1 - p)) @ weight, 1e-300)
    most = np.where(p > 0, weight, 0).sum(1)
    target = np.clip(count - 0.5, 0.05, np.maximum(most - 0.05, 0.05))
    t = np.log(np.maximum(target, 1e-12) / np.maximum(mean, 1e-300))
    for _ in range(40):
        e = p * np.exp(np.clip(t, -60, 60))[:, None]
        g = e / (1 - p + e)
        first, second = g @ weight, np.maximum((g * (1 - g)) @ weight, 1e-300)
        step = np.clip((first - target) / second, -2, 2)
        t -= step
        if np.abs(step).max() < 1e-10:
            break
    e = p * np.exp(np.clip(t, -60, 60))[:, None]
    g = e / (1 - p + e)
    curve = np.maximum((g * (1 - g)) @ weight, 1e-300)
    grown = np.log1p(p * np.expm1(np.clip(t, -60, 60))[:, None]) @ weight
    w = np.sign(t) * np.sqrt(np.maximum(2 * (t * target - grown), 0))
    u = 2 * np.sinh(t / 2) * np.sqrt(curve)
    density = lambda z: np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    beyond = lambda z: 0.5 * np.vectorize(math.erfc, otypes=[float])(z / math.sqrt(2))
    with np.errstate(all="ignore"):
        tail = beyond(w) + density(w) * (1 / u - 1 / w)
    z = (target - mean) / np.sqrt(var)
    skew = ((p * (1 - p) * (1 - 2 * p)) @ weight) / var**1.5
    near = beyond(z) + density(z) * skew * (z * z - 1) / 6
    tail = np.where((np.abs(w) < 1e-3) | ~np.isfinite(tail), near, tail)
    tail = np.where(count <= 0, 1.0, np.where(count > most, 0.0, tail))
    return mean, np.clip(tail, 0.0, 1.0)


def _tails(x: np.ndarray, y: dict[int, float], weight: np.ndarray):
    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            means, tails = [], []
            for start in range(0, len(frame), 4096):
                some = frame.iloc[start : start + 4096]
                a, b = (np.outer(some[c].map(y).to_numpy(float), x) for c in ("class_a", "class_b"))
                mean, tail = upper_tails(a / (1 + a) * (b / (1 + b)), weight, some["n_both"].to_numpy(float))
                means.append(mean)
                tails.append(tail)
            yield frame.assign(expected=np.concatenate(means) if means else [], p_value=np.concatenate(tails) if tails else [])

    return score


def adjusted(tests: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``tests`` (keys, n, p_value) with q_value: Benjamini-Hochberg where a row stands for n tests.

    total: all tests; those that no row stands for have p = 1 and rank last. Ranks come from a global
    range-partitioned sort on p_value: the sums of the partitions before a partition and the least value of those
    after it are one number each.
    """
    spark = tests.sparkSession
    placed = range_parts(tests, ["p_value"])
    here = Window.partitionBy("part_of_range")
    sums = {r["part_of_range"]: r["n"] for r in placed.groupBy("part_of_range").agg(F.sum("n").alias("n")).collect()}  # a row per partition
    before, offsets = 0, []
    for part in sorted(sums):
        offsets.append((part, before))
        before += sums[part]
    offset = spark.createDataFrame(offsets, "part_of_range int, rank_before long")
    up = here.orderBy("p_value").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = placed.join(F.broadcast(offset), "part_of_range").withColumn("rank", F.col("rank_before") + F.sum("n").over(up))
    raw = cut(ranked.withColumn("raw", F.col("p_value") * total / F.col("rank")))
    least = {r["part_of_range"]: r["raw"] for r in raw.groupBy("part_of_range").agg(F.min("raw").alias("raw")).collect()}
    after, rest = 1.0, []
    for part in sorted(least, reverse=True):
        rest.append((part, after))
        after = min(after, least[part])
    floor = spark.createDataFrame(rest, "part_of_range int, least_after double")
    down = here.orderBy(F.col("p_value").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return raw.join(F.broadcast(floor), "part_of_range").withColumn("q_value", F.least(F.min("raw").over(down), "least_after")).select(*keys, "n", *[c for c in tests.columns if c not in (*keys, "n")], "q_value")


def _pairs_within(baskets: DataFrame) -> DataFrame:
    """(a, b) of all a < b in the sorted array ``items``."""
    first = baskets.select("items", F.posexplode("items").alias("at", "a"))
    return first.select("a", F.explode(F.slice("items", F.col("at") + 2, F.greatest(F.size("items"), F.lit(1)))).alias("b"))


def _pair_counts(baskets: DataFrame) -> DataFrame:
    """(a, b, n_both) over rows (record, item LONG, size): number of records with both; a < b."""
    # With items known to be distinct per record; blocks of one record differ in n_blocks only by size.
    blocks = baskets.withColumn("n_blocks", F.ceil(F.col("size") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("item"), F.col("n_blocks")))
    whole = blocks.where("n_blocks = 1").groupBy("record").agg(F.array_sort(F.collect_list("item")).alias("items"))
    met = blocks.where("n_blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    met = met.groupBy("record", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")).agg(F.array_sort(F.collect_list(F.struct("item", "block"))).alias("items"))
    left = met.select("lo", "hi", "items", F.posexplode("items").alias("at", "a"))
    crossed = left.select("lo", "hi", "a", F.explode(F.slice("items", F.col("at") + 2, F.greatest(F.size("items"), F.lit(1)))).alias("b"))
    crossed = crossed.where("lo = hi OR a.block <> b.block").select(F.col("a.item").alias("a"), F.col("b.item").alias("b"))
    return _pairs_within(whole).unionByName(crossed).groupBy("a", "b").agg(F.count("*").alias("n_both"))


def cooccurrence(items: DataFrame, record_count: int, min_records: int = 1) -> DataFrame:
    """One row per pair of items in at least ``min_records`` records together.

    items: record STRING, item STRING; nulls in either are left out, repeats count once, other columns play
    no part. record_count: all records, those without items included. Gives item_a < item_b (by code
    point), n_a, n_b, n_both, lift (n_both over the number expected from the two frequencies alone),
    expected, p_value and q_value under the fitted null. q_value is over all pairs of items at any
    min_records; with more than 1 it is an upper bound, as rarer pairs get no rank. No items or no pairs give no rows.
    """
    held = cut(items.select("record", "item").dropna().distinct())
    supports = held.groupBy("item").agg(F.count("*").alias("support")).withColumn("class", _size_class(F.col("support"), ITEM_STEPS))
    number = F.shiftleft(F.col("class"), CLASS_BITS) + F.monotonically_increasing_id() % F.lit(1 << CLASS_BITS)
    catalog = cut(supports.select("item", number.alias("item_no"), "support", "class"))
    frequencies = catalog.groupBy("class").agg(F.avg("support").alias("value"), F.count("*").alias("n")).orderBy("class").toPandas()  # bounded by _size_class
    per_record = held.groupBy("record").agg(F.count("*").alias("size"))
    sizes = per_record.groupBy(_size_class(F.col("size"), RECORD_STEPS).alias("class")).agg(F.avg("size").alias("value"), F.count("*").alias("n")).orderBy("class").toPandas()
    x, y, weight = fit_null(sizes, frequencies) if len(sizes) else (np.zeros(1), np.zeros(0), np.zeros(1))
    common = spread_join(held, catalog.where(F.col("support") >= min_records).select("item", "item_no"), ["item"]).select("record", F.col("item_no").alias("item"))
    large = common.groupBy("record").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK)
    sized = common.join(large, "record", "left").withColumn("size", F.coalesce("size", F.lit(1)))
    counted = _pair_counts(sized).where(F.col("n_both") >= min_records)
    # the numbers tell the classes, so names and supports are joined last
    classes = [F.shiftright(F.col(c), CLASS_BITS) for c in "ab"]
    pairs = cut(counted.select("a", "b", "n_both", F.least(*classes).alias("class_a"), F.greatest(*classes).alias("class_b")))
    keys = ["class_a", "class_b", "n_both"]
    kinds = pairs.groupBy(*keys).agg(F.count("*").alias("n"))
    n_items = int(frequencies["n"].sum())
    by_class = dict(zip(frequencies["class"].tolist(), y.tolist()))
    scored = kinds.repartition(partitions(kinds), *keys).mapInPandas(_tails(x, by_class, weight), "class_a long, class_b long, n_both long, n long, expected double, p_value double")
    tested = adjusted(scored, keys, n_items * (n_items - 1) // 2).drop("n")
    side = lambda s: catalog.select(F.col("item_no").alias(s), F.col("item").alias(f"item_{s}"), F.col("support").alias(f"n_{s}"))
    out = spread_join(pairs, tested, keys).select("a", "b", "n_both", "expected", "p_value", "q_value")
    out = spread_join(spread_join(out, side("a"), ["a"], counted_on=pairs), side("b"), ["b"], counted_on=pairs)
    turned = F.col("item_a") > F.col("item_b")
    both = [F.when(turned, F.col(f"{c}_{q}")).otherwise(F.col(f"{c}_{p}")).alias(f"{c}_{p}") for c in ("item", "n") for p, q in ("ab", "ba")]
    lift = F.col("n_both") * F.lit(float(record_count)) / (F.col("n_a").cast("double") * F.col("n_b"))
    return out.select(*both, "n_both", lift.alias("lift"), "expected", "p_value", "q_value")
