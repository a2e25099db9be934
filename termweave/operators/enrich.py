"""Over-representation of every concept in every set of entities, in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions import stats as S
from termweave.functions.ids import entity_id
from termweave.operators.spread import partitions, parts_before, positions, range_parts, sent_join, spread_join
from termweave.session import cut


@dataclass(frozen=True)
class Limits:
    """Parameters of the test; see ``enrich``."""

    min_genes: int = 2
    fdr: float = 0.05
    max_concept_frac: float = 0.25
    merge_jaccard: float = 0.75
    min_fold: float = 1.0
    trend_p: float = 0.01


def recognised(members: DataFrame, id_pattern: str) -> DataFrame:
    """(set_id, pos, entity_id): members as recognised ids in one spelling, each once per set at its first position.

    members: set_id, pos, entity_id. In each string the first match of the pattern counts, in any case; strings
    without one, comments and nulls are left out. Null set ids are left out too.
    """
    hit = F.regexp_extract(F.col("entity_id"), f"(?i)({id_pattern})", 1)
    found = members.where("set_id IS NOT NULL AND NOT startswith(ltrim(entity_id), '#')").select("set_id", "pos", entity_id(hit).alias("entity_id")).where("entity_id IS NOT NULL")
    return found.groupBy("set_id", "entity_id").agg(F.min("pos").alias("pos")).select("set_id", "pos", "entity_id")


def universe(index: DataFrame, background: DataFrame) -> DataFrame:
    """entity_id of the background's entities that have a concept."""
    return background.select("entity_id").distinct().join(index.select("entity_id"), "entity_id", "left_semi")


def false_discovery(tests: DataFrame) -> DataFrame:
    """With fdr: Benjamini-Hochberg over the tested rows of each set_id; 1 for the others.

    Equal p values get equal rates. Rows: set_id, p_value, tested; null sets and p values count as untested.
    The distinct p values of all sets are sorted by range over the cluster: a part ranks its own, and the counts
    of a set's parts before and the least raw rates of its parts after are added, a row per part.
    """
    tests = tests.withColumn("tested", F.coalesce(F.col("tested") & F.col("set_id").isNotNull() & F.col("p_value").isNotNull(), F.lit(False)))
    tests = cut(tests)
    steps = tests.where("tested").groupBy("set_id", "p_value").agg(F.count("*").alias("n_equal"))
    placed = range_parts(steps, ["set_id", "p_value"])
    per_part = placed.groupBy("set_id", "part_of_range").agg(F.sum("n_equal").alias("n_here"))
    by_set = Window.partitionBy("set_id")
    reach = per_part.withColumn("m", F.sum("n_here").over(by_set)).withColumn("n_parts", F.count("*").over(by_set)).where("n_parts > 1").select("set_id", "part_of_range", "m")
    reach = reach.join(parts_before(per_part, "set_id", "n_here", "n_before"), ["set_id", "part_of_range"])
    here = Window.partitionBy("set_id", "part_of_range")
    up = here.orderBy("p_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = placed.withColumn("rank", F.sum("n_equal").over(up)).withColumn("n_here", F.sum("n_equal").over(here)).join(F.broadcast(reach), ["set_id", "part_of_range"], "left")
    raw = F.col("p_value") * F.coalesce("m", "n_here") / (F.col("rank") + F.coalesce("n_before", F.lit(0)))
    down = here.orderBy(F.col("p_value").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rates = cut(ranked.withColumn("raw", raw).withColumn("least", F.min("raw").over(down)).select("set_id", "part_of_range", "p_value", "least", (F.col("m").isNotNull()).alias("torn")))
    later = Window.partitionBy("set_id").orderBy(F.col("part_of_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    floors = rates.where("torn").groupBy("set_id", "part_of_range").agg(F.min("least").alias("least")).withColumn("floor", F.min("least").over(later)).select("set_id", "part_of_range", "floor")
    rates = rates.join(F.broadcast(floors), ["set_id", "part_of_range"], "left").select("set_id", "p_value", F.least(F.lit(1.0), "least", "floor").alias("fdr"))
    done = spread_join(tests.where("tested"), rates, ["set_id", "p_value"])
    return done.select(*tests.columns, "fdr").unionByName(tests.where("NOT tested").withColumn("fdr", F.lit(1.0)))


def rank_order() -> list[Column]:
    """The order of results within a set: most significant first, ties by layer and concept, as concept_no counts them."""
    return [F.col("fdr"), F.col("p_value"), F.col("k_study").desc(), F.col("concept_no")]


def enrich(index: DataFrame, sets: DataFrame, background: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per set and concept of its members: counts, fold, p_value, tested, fdr, status and rank.

    index: entity_id, layer, concept, label, best a table, as it is read several times. sets: set_id, entity_id (each once per set; see ``recognised``).
    background: entity_id. Only entities of the background with a concept count; n_bg is their number,
    n_study that of the set's among them. Concepts in more than max_concept_frac of n_bg are left
    out; those in fewer than min_genes of the set stay untested with fdr 1. status is 'significant', 'trend' or
    ''. An empty background raises ValueError, and so do sets of which no member at all is usable; a set without a usable
    member beside others gives no rows.
    """
    if background is None:
        raise ValueError("a background is required: the entities that could have been in the sets")
    per_entity = cut(index.groupBy("entity_id").agg(F.count("*").alias("n_of_key")))
    inside = cut(universe(per_entity, background))
    n_bg = inside.count()
    if n_bg == 0:
        raise ValueError("no entity of the background has a concept")
    study = cut(sets.select("set_id", "entity_id").join(inside, "entity_id", "left_semi"))
    if study.isEmpty():
        raise ValueError("no member of any set is in the background and has a concept")
    sizes = cut(study.groupBy("set_id").agg(F.count("*").alias("n_study")).where("set_id IS NOT NULL").withColumn("set_no", F.monotonically_increasing_id()))
    held = index if per_entity.count() == n_bg else spread_join(index, inside, ["entity_id"], "left_semi", counts=per_entity)
    known = held.groupBy("layer", "concept", "label").agg(F.count("*").alias("k_bg")).where(F.col("k_bg") <= limits.max_concept_frac * n_bg)
    known = cut(known.orderBy("layer", "concept", "label").withColumn("concept_no", F.monotonically_increasing_id()))
    n_known, n_sets = known.count(), sizes.count()
    rows = cut(_counted(index, study.join(sizes, "set_id").select("entity_id", "set_no", "n_study"), known, n_known, per_entity))
    tests = _with_tails(rows, n_bg).withColumn("tested", F.col("k_study") >= limits.min_genes).withColumnRenamed("set_no", "set_id")
    tests = false_discovery(tests).withColumnRenamed("set_id", "set_no")
    tests = tests.withColumn("n_bg", F.lit(n_bg).cast("long")).withColumn("fold", (F.col("k_study") / F.col("n_study")) / (F.col("k_bg") / F.col("n_bg")))
    worthy = F.col("tested") & (F.col("fold") >= limits.min_fold)
    status = F.when(worthy & (F.col("fdr") <= limits.fdr), "significant").when(worthy & (F.col("p_value") <= limits.trend_p), "trend").otherwise("")
    placed = positions(tests, "set_no", rank_order(), "rank").withColumn("status", status)
    named = sent_join(placed, known.select("concept_no", "layer", "concept", "label"), ["concept_no"], n_known)
    named = sent_join(named, sizes.select("set_no", "set_id"), ["set_no"], n_sets)
    return named.select("set_id", "concept", "layer", "label", "k_study", "n_study", "k_bg", "n_bg", "fold", "p_value", "tested", "fdr", "status", "rank")


def _counted(index: DataFrame, study: DataFrame, known: DataFrame, n_known: int, per_entity: DataFrame) -> DataFrame:
    """(set_no, n_study, concept_no, k_bg, k_study) of the sets' known concepts. study: entity_id, set_no, n_study; per_entity: entity_id, n_of_key."""
    per_concept = known.groupBy("concept").agg(F.sum("k_bg").alias("n_of_key"))
    numbered = sent_join(index.select("entity_id", "concept"), known.select("concept", "concept_no", "k_bg"), ["concept"], n_known, per_concept).drop("concept")
    hits = spread_join(numbered, study, ["entity_id"], counts=per_entity)
    return hits.groupBy("set_no", "n_study", "concept_no", "k_bg").agg(F.count("*").alias("k_study"))


def _with_tails(rows: DataFrame, n_bg: int) -> DataFrame:
    """With p_value, computed once for each different line of counts. rows: a table with k_study, n_study and k_bg."""
    keys = ["k_study", "n_study", "k_bg"]
    tail = S.hypergeometric_tail(F.col("k_study"), F.col("n_study"), F.col("k_bg"), F.lit(n_bg).cast("long"))
    tails = cut(rows.select(*keys).distinct().repartition(4 * partitions(rows)).withColumn("p_value", tail))
    return sent_join(rows, tails, keys, tails.count())


def missing_entities(sets: DataFrame, inside: DataFrame) -> DataFrame:
    """(set_id, entity_id) of members outside the universe."""
    return sets.select("set_id", "entity_id").join(inside, "entity_id", "left_anti").select("set_id", "entity_id")
