"""Redundant concepts merged into representatives, and representatives named after shared phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions import text as X
from termweave.operators.enrich import Limits
from termweave.operators.spread import spread_join
from termweave.session import cut, discard


def candidate_hits(results: DataFrame, index: DataFrame, study: DataFrame) -> DataFrame:
    """(set_id, rank, concept, entity_id): the members of the set that carry each concept with a status."""
    chosen = results.where("status <> ''").select("set_id", "rank", "concept")
    held = spread_join(index.select("entity_id", "concept"), study.select("set_id", "entity_id"), ["entity_id"])
    return held.join(chosen, ["set_id", "concept"]).select("set_id", "rank", "concept", "entity_id")


def _stems(label: Column) -> Column:
    return F.array_distinct(F.transform(F.split(F.lower(label), r"(?U)\s+"), X.stem))


def _listed_together(listed: DataFrame, keys: list[str], share: float) -> DataFrame:
    """(set_id, rank, earlier) of rows (set_id, rank, size, keys) that meet under a key, the smaller size at least ``share`` of the larger."""
    other = listed.select("set_id", *keys, F.col("rank").alias("earlier"), F.col("size").alias("size_b"))
    met = listed.join(other, ["set_id", *keys]).where(F.col("earlier") < F.col("rank"))
    return met.where(F.least("size", "size_b") >= share * F.greatest("size", "size_b")).select("set_id", "rank", "earlier")


def close_pairs(results: DataFrame, hits: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(set_id, rank, earlier, shared): the candidates of a set that may stand for one another, the later one first.

    Two candidates are close if their members agree in merge_jaccard, or if the stems of one label are among
    the other's and they share half of the smaller one's members. Neither way needs all pairs of a member's
    candidates: of a candidate of n members only the rarest n - ceil(merge_jaccard n) + 1 are listed, since sets that
    agree so far meet in one of these; and a label is met under its rarest stem. What meets is counted exactly.
    """
    chosen = results.where("status <> ''").select("set_id", "rank", F.col("k_study").alias("size"), _stems(F.col("label")).alias("stems"))
    carried = cut(hits.select("set_id", "rank", "entity_id"))
    common = carried.groupBy("set_id", "entity_id").agg(F.count("*").alias("n"))
    by_rarity = Window.partitionBy("set_id", "rank").orderBy("n", "entity_id")
    placed = carried.join(common, ["set_id", "entity_id"]).withColumn("place", F.row_number().over(by_rarity)).join(chosen.select("set_id", "rank", "size"), ["set_id", "rank"])
    listed = cut(placed.where(F.col("place") <= F.col("size") - F.ceil(limits.merge_jaccard * F.col("size") - 1e-9) + 1).select("set_id", "rank", "size", "entity_id"))
    by_members = _listed_together(listed, ["entity_id"], limits.merge_jaccard)
    stems = cut(chosen.select("set_id", "rank", "stems", F.explode("stems").alias("stem")))
    rarity = stems.groupBy("set_id", "stem").agg(F.count("*").alias("n"))
    rarest = stems.join(rarity, ["set_id", "stem"]).groupBy("set_id", "rank").agg(F.min(F.struct("n", "stem"))["stem"].alias("stem"))
    inner = stems.join(rarest, ["set_id", "rank", "stem"]).select("set_id", "stem", F.col("rank").alias("rank_a"), F.col("stems").alias("stems_a"))
    outer = stems.select("set_id", "stem", F.col("rank").alias("rank_b"), F.col("stems").alias("stems_b"))
    nested = inner.join(outer, ["set_id", "stem"]).where((F.col("rank_a") != F.col("rank_b")) & (F.size(F.array_except("stems_a", "stems_b")) == 0))
    by_stems = nested.select("set_id", F.greatest("rank_a", "rank_b").alias("rank"), F.least("rank_a", "rank_b").alias("earlier"))
    may = by_members.withColumn("nested", F.lit(False)).unionByName(by_stems.withColumn("nested", F.lit(True))).groupBy("set_id", "rank", "earlier").agg(F.max("nested").alias("nested"))
    earlier = carried.select("set_id", F.col("rank").alias("earlier"), "entity_id")
    shared = cut(may).join(carried, ["set_id", "rank"]).join(earlier, ["set_id", "earlier", "entity_id"]).groupBy("set_id", "rank", "earlier", "nested").agg(F.count("*").alias("shared"))
    sized = shared.join(chosen.select("set_id", "rank", "size"), ["set_id", "rank"]).join(chosen.select("set_id", F.col("rank").alias("earlier"), F.col("size").alias("size_b")), ["set_id", "earlier"])
    alike = F.col("shared") / (F.col("size") + F.col("size_b") - F.col("shared")) >= limits.merge_jaccard
    return sized.where(alike | (F.col("nested") & (F.col("shared") / F.least("size", "size_b") >= 0.5))).select("set_id", "rank", "earlier", "shared")


def merge_groups(results: DataFrame, hits: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(set_id, rank, group_rank): the representative that each concept with a status belongs to; its own if it is one.

    In order of rank a candidate joins the first earlier representative that it is close to (``close_pairs``);
    otherwise it represents itself. The order is kept by rounds over the table of close pairs: who has no undecided
    earlier neighbour becomes a representative, who has one for an earlier neighbour is decided, and the pairs of
    the decided are dropped. merge_jaccard of 0 or less merges everything into the first.
    """
    chosen = results.where("status <> ''").select("set_id", "rank")
    if limits.merge_jaccard <= 0:
        first = chosen.groupBy("set_id").agg(F.min("rank").alias("group_rank"))
        return chosen.join(first, "set_id").select("set_id", "rank", "group_rank")
    edges = cut(close_pairs(results, hits, limits).select("set_id", "rank", "earlier"))
    # Only candidates with an earlier neighbour wait; the others are representatives from the start.
    key = ["set_id", "rank"]
    waiting = cut(edges.select(*key).distinct())
    ends = edges.select("set_id", F.col("earlier").alias("rank")).distinct()
    heads, open_edges, fresh = [], edges, ends.join(waiting, key, "left_anti")
    while True:
        fresh = cut(fresh)
        heads.append(fresh)
        new = fresh.select("set_id", F.col("rank").alias("earlier"))
        joined = open_edges.join(new, ["set_id", "earlier"], "left_semi").select(*key).distinct()
        decided = cut(joined.unionByName(fresh))
        gone = decided.select("set_id", F.col("rank").alias("earlier"))
        still = cut(waiting.join(decided, key, "left_anti"))
        left = cut(open_edges.join(decided, key, "left_anti").join(gone, ["set_id", "earlier"], "left_anti"))
        discard(waiting, decided, *([open_edges] if open_edges is not edges else []))
        waiting, open_edges = still, left
        if waiting.isEmpty():
            break
        fresh = waiting.join(open_edges, key, "left_anti")
    first = heads[0]
    for other in heads[1:]:
        first = first.unionByName(other)
    own = edges.join(first.select("set_id", F.col("rank").alias("earlier")), ["set_id", "earlier"]).groupBy(*key).agg(F.min("earlier").alias("group_rank"))
    own = own.join(first, key, "left_anti")
    return chosen.join(own, key, "left").select(*key, F.coalesce("group_rank", "rank").alias("group_rank"))


def display_phrases(results: DataFrame, groups: DataFrame, hits: DataFrame, index: DataFrame) -> DataFrame:
    """(set_id, rank, phrase) for representatives that are words: the phrase two thirds of their members share.

    Among the phrases with the word, held by at least max(2, two thirds) of the members with it: the most
    frequent there, then the rarest overall, then the first by alphabet.
    """
    heads = groups.where("rank = group_rank").select("set_id", "rank")
    words = results.where("layer = 'word'").join(heads, ["set_id", "rank"]).select("set_id", "rank", "label", "k_study")
    held = index.where("layer = 'phrase'").select("entity_id", F.col("label").alias("phrase"))
    rarity = held.groupBy("phrase").agg(F.count("*").alias("overall"))
    by_word = held.select("entity_id", "phrase", F.explode(F.array_distinct(F.split("phrase", " "))).alias("label"))
    carried = words.join(hits.select("set_id", "rank", "entity_id"), ["set_id", "rank"])
    votes = carried.join(by_word, ["entity_id", "label"]).groupBy("set_id", "rank", "k_study", "phrase").agg(F.count("*").alias("votes"))
    enough = votes.where(F.col("votes") >= F.greatest(F.lit(2), F.ceil(2 * F.col("k_study") / 3)))
    best = Window.partitionBy("set_id", "rank").orderBy(F.col("votes").desc(), F.col("overall"), F.col("phrase"))
    return enough.join(rarity, "phrase").withColumn("n", F.row_number().over(best)).where("n = 1").select("set_id", "rank", "phrase")


def described(results: DataFrame, index: DataFrame, study: DataFrame, symbols: DataFrame | None = None, limits: Limits = Limits()) -> DataFrame:
    """``results`` with representative, group, display and merged, and with the members that carry each concept.

    genes and symbols are sorted lists of the set's members with a status concept ('' for the others);
    symbols: id, symbol. Labels are shown with plain hyphens.
    """
    results = cut(results)
    hits = cut(candidate_hits(results, index, study))
    groups = cut(merge_groups(results, hits, limits))
    labels = results.select("set_id", F.col("rank").alias("group_rank"), F.col("label").alias("group"))
    grouped = groups.join(labels, ["set_id", "group_rank"])
    ordered = grouped.join(results.select("set_id", "rank", "label"), ["set_id", "rank"]).where("rank <> group_rank AND label <> group")
    merged = ordered.groupBy("set_id", F.col("group_rank").alias("rank")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]), ", ").alias("merged"))
    named = hits.withColumn("symbol", F.col("entity_id"))
    if symbols is not None:
        named = hits.join(symbols.select(F.col("id").alias("entity_id"), F.nullif("symbol", F.lit("")).alias("symbol")), "entity_id", "left").withColumn("symbol", F.coalesce("symbol", "entity_id"))
    members = named.groupBy("set_id", "rank").agg(F.array_sort(F.collect_list(F.struct("entity_id", "symbol"))).alias("members"))
    out = results.join(grouped.select("set_id", "rank", "group_rank", "group"), ["set_id", "rank"], "left")
    out = out.join(display_phrases(results, groups, hits, index), ["set_id", "rank"], "left").join(merged, ["set_id", "rank"], "left").join(members, ["set_id", "rank"], "left")
    joined = lambda field: F.coalesce(F.array_join(F.transform("members", lambda x: x[field]), ", "), F.lit(""))
    return out.select(
        *[c for c in results.columns if c != "label"],
        X.shown(F.col("label")).alias("label"),
        F.coalesce(F.col("rank") == F.col("group_rank"), F.lit(False)).alias("representative"),
        X.shown(F.coalesce("group", F.lit(""))).alias("group"),
        X.shown(F.coalesce("phrase", "label")).alias("display"),
        X.shown(F.coalesce("merged", F.lit(""))).alias("merged"),
        joined("entity_id").alias("genes"),
        joined("symbol").alias("symbols"),
    )
