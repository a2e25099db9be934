"""The frequency test by random draws: words of a set's texts against sets of the same size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions.text import ENGLISH_STOP_WORDS
from termweave.operators.spread import parts_before, positions, range_parts, spread_join
from termweave.session import cut, discard

# Punctuation that is deleted, and words that are never called significant.
PUNCTUATION = r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"
NOISE_WORDS = "protein proteincoding expressed proteins plants blast has source blink hits ncbi match contains best interpro involved functions plant encodes"


def frequency_words(text: Column) -> Column:
    """All words of a text, with repeats: punctuation deleted, lower case, three letters or more, no English stop words."""
    words = F.split(F.trim(F.lower(F.regexp_replace(text, PUNCTUATION, ""))), r"(?U)\s+")
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*ENGLISH_STOP_WORDS.split()))


def entity_words(texts: DataFrame) -> DataFrame:
    """(entity_id, word, n) of rows (entity_id, text)."""
    return texts.select("entity_id", F.explode(frequency_words(F.col("text"))).alias("word")).groupBy("entity_id", "word").agg(F.count("*").alias("n"))


def draws(universe: DataFrame, size: int, samples: int = 100, seed: int = 1) -> DataFrame:
    """(sample, entity_id, place): ``samples`` sets of ``size`` entities in order, the same on every run.

    A sample holds the entities with the least md5 of seed, sample and id, so it depends on nothing else, and its
    first n are the sample of size n. Lots beyond a bound that about a size-th of the universe and six standard deviations
    more fall under are left out at once; the bound is raised until every sample is full. Places are those of a sort over the cluster.
    """
    total = universe.count()
    if not size or not total:
        return universe.sparkSession.createDataFrame([], "sample int, entity_id string, place long")
    lot = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("sample").cast("string"), "entity_id"))
    every = universe.select("entity_id", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("sample")).withColumn("lot", lot)
    wanted, share = min(size, total), min(1.0, (size + 6 * size**0.5 + 10) / total)
    while True:
        under = every.where(F.col("lot") < f"{int(share * 16**12):012x}") if share < 1 else every
        under = cut(under)
        full = under.groupBy("sample").agg(F.count("*").alias("n")).where(F.col("n") >= wanted).count()
        if full == samples:
            break
        discard(under)
        share = min(1.0, share * 1.5)
    return positions(under, "sample", [F.col("lot"), F.col("entity_id")], "place").where(F.col("place") <= wanted).select("sample", "entity_id", "place")


def frequency_test(texts: DataFrame, study: DataFrame, background: DataFrame, samples: int = 100, seed: int = 1) -> DataFrame:
    """(set_id, word, freq, rdm, genome_count, enrich_ratio, significant) of every word of each set's texts.

    texts: entity_id, text; study: set_id, entity_id; background: entity_id. Only background entities with a text
    count. rdm is the number of random sets of the same size in which the word is as frequent; a word is significant where
    none is and it is no noise word. Sets without such entities give no rows; a missing background raises ValueError.

    The draws are made once, for the largest set: a word's occurrences are numbered through the places of a sample, so the
    place of the one that makes it as frequent as in a set tells at once whether a sample of the set's size gets there.
    """
    if background is None:
        raise ValueError("a background is required")
    inside = texts.where("text <> ''").join(background.select("entity_id"), "entity_id", "left_semi")
    words = cut(entity_words(inside))
    # entities whose texts have no words count in the universe, too
    universe = cut(inside.select("entity_id").distinct())
    chosen = cut(study.select("set_id", "entity_id").distinct().join(universe, "entity_id", "left_semi"))
    sizes = cut(chosen.groupBy("set_id").agg(F.count("*").alias("n_study")))
    n_all, largest = universe.count(), sizes.agg(F.max("n_study")).first()[0] or 0
    seen = cut(chosen.join(words, "entity_id").groupBy("set_id", "word").agg(F.sum("n").alias("freq")).join(sizes, "set_id"))
    most = seen.groupBy("word").agg(F.max("freq").alias("most"))
    counts = words.join(most, "word")
    overall = counts.groupBy("word").agg(F.sum("n").alias("genome_count"))
    drawn = cut(draws(universe, largest, samples, seed).join(counts, "entity_id").select("sample", "word", "place", "n", "most", F.concat_ws("|", "sample", "word").alias("series")))
    reached = _running(drawn)
    # one row per sample, word and frequency up to the greatest that any set has
    steps = reached.where("so_far - n < most").select("word", "place", F.explode(F.sequence(F.col("so_far") - F.col("n") + 1, F.least("so_far", "most"))).alias("freq"))
    needs = seen.select("word", "freq", "n_study").distinct()
    at_least = spread_join(cut(steps.groupBy("word", "freq", "place").agg(F.count("*").alias("times"))), needs, ["word", "freq"]).where("place <= n_study").groupBy("word", "freq", "n_study").agg(F.sum("times").alias("rdm"))
    out = seen.join(overall, "word").join(at_least, ["word", "freq", "n_study"], "left").withColumn("rdm", F.coalesce("rdm", F.lit(0)))
    ratio = (F.col("freq") / F.col("n_study")) / (F.col("genome_count") / F.lit(float(max(n_all, 1))))
    return out.select("set_id", "word", "freq", "rdm", "genome_count", ratio.alias("enrich_ratio"), ((F.col("rdm") == 0) & ~F.col("word").isin(*NOISE_WORDS.split())).alias("significant"))


def _running(drawn: DataFrame) -> DataFrame:
    """With so_far: a word's occurrences in its sample up to a place, that one included."""
    placed = range_parts(drawn, ["series", "place"])
    offsets = parts_before(placed.groupBy("series", "part_of_range").agg(F.sum("n").alias("n_here")), "series", "n_here", "n_before")
    local = F.sum("n").over(Window.partitionBy("series", "part_of_range").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = placed.withColumn("so_far", local).join(F.broadcast(offsets), ["series", "part_of_range"], "left")
    return summed.withColumn("so_far", F.col("so_far") + F.coalesce("n_before", F.lit(0))).drop("n_before", "part_of_range", "series")
