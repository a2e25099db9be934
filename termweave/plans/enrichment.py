"""Queries of the enrichment analysis over the gene tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.functions import stats as S
from termweave.functions import text as X
from termweave.functions.ids import entity_id, term_id
from termweave.operators import compare as CMP
from termweave.operators import concepts as C
from termweave.operators import enrich as E
from termweave.operators import hierarchy as H
from termweave.operators import montecarlo as M
from termweave.operators import records as R
from termweave.operators import redundancy as D
from termweave.operators.spread import positions
from termweave.plans.hierarchies import ontology_graph
from termweave.session import cut, table

#: How ids look in the tables.
TABLES = C.Species("the tables", r"\bVX[1-5CM]G\d{9}\b")
#: Collocations need so many genes here.
LIMITS = E.Limits()


def resolved(spark: SparkSession, folder: str) -> DataFrame:
    return R.resolved_terms(table(spark, folder, "ontology"), table(spark, folder, "alt_term"))


def records(spark: SparkSession, folder: str) -> DataFrame:
    return cut(R.merged_records(table(spark, folder, "gene"), resolved(spark, folder), TABLES.id_pattern))


def names(spark: SparkSession, folder: str) -> DataFrame:
    return resolved(spark, folder).select("id", "term_name").distinct()


def texts(spark: SparkSession, folder: str, fields: tuple[str, ...] = C.TEXT_FIELDS) -> DataFrame:
    return C.text_fields(records(spark, folder), names(spark, folder), fields)


def tokens(spark: SparkSession, folder: str) -> DataFrame:
    return C.tokenised(texts(spark, folder), TABLES)


def index(spark: SparkSession, folder: str, layers: tuple[str, ...] = ("word", "phrase", "keyword")) -> DataFrame:
    reach = terms = None
    if "go" in layers:
        reach, terms = H.closure(ontology_graph(spark, folder)[1]), term_table(spark, folder)
    return C.concept_index(records(spark, folder), TABLES, layers, names(spark, folder), reach, terms)


def term_table(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "ontology").select(term_id(F.col("id")).alias("id"), "term_name", "term_namespace").where("id IS NOT NULL")
    return rows.groupBy("id").agg(F.min("term_name").alias("term_name"), F.min("term_namespace").alias("term_namespace"))


def sets(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "gene_list").select(F.col("set_name").alias("set_id"), F.col("pos_no").alias("pos"), "entity_id")
    return E.recognised(rows, TABLES.id_pattern)


def background(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "gene").select(entity_id(F.col("id")).alias("entity_id")).where("entity_id IS NOT NULL").distinct()


def results(spark: SparkSession, folder: str, layers: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, index, study) of all sets, materialised for the steps that use them again."""
    held = cut(index(spark, folder, layers))
    everyone = background(spark, folder)
    study = cut(sets(spark, folder).join(E.universe(held, everyone), "entity_id", "left_semi"))
    return cut(E.enrich(held, study, everyone, LIMITS)), held, study


def described(spark: SparkSession, folder: str, layers: tuple[str, ...] = ("word", "phrase", "keyword")) -> DataFrame:
    merged = records(spark, folder)
    held = cut(C.concept_index(merged, TABLES, layers, names(spark, folder)))
    everyone = background(spark, folder)
    study = cut(sets(spark, folder).join(E.universe(held, everyone), "entity_id", "left_semi"))
    return D.described(E.enrich(held, study, everyone, LIMITS), held, study, merged.select("id", "symbol"), LIMITS)


def rounded(rows: DataFrame) -> DataFrame:
    """p_value and fdr as -log10 to 6 digits, fold to 6 digits."""
    log = lambda c: F.round(-F.log10(F.greatest(F.col(c), F.lit(1e-300))), 6) + F.lit(0.0)
    return rows.withColumn("p_value", log("p_value")).withColumn("fdr", log("fdr")).withColumn("fold", F.round("fold", 6))


def normalise_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "gene").select("row_no", entity_id(F.col("id")).alias("gene"))


def recognised_members(spark: SparkSession, folder: str) -> DataFrame:
    return sets(spark, folder).select("set_id", "pos", "entity_id")


def set_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return sets(spark, folder).groupBy("set_id").agg(F.count("*").alias("n_ids"), F.min("entity_id").alias("first_id"))


def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "gene").select("row_no", X.clean_function(F.col("function_text")).alias("cleaned"))


def split_names(spark: SparkSession, folder: str) -> DataFrame:
    """Protein names written as one string, in brackets after the first, and taken apart again."""
    values = F.filter(F.coalesce("protein_names", F.array().cast("array<string>")), lambda x: F.coalesce(F.trim(x), F.lit("")) != "")
    whole = F.when(F.size(values) > 0, F.concat_ws("", F.get(values, F.lit(0)), F.array_join(F.transform(F.slice(values, F.lit(2), F.greatest(F.size(values), F.lit(1))), lambda x: F.concat(F.lit(" ("), x, F.lit(")"))), ""), F.lit(" (EC 1.2.3.4)")))
    return table(spark, folder, "gene").select("row_no", F.array_join(X.split_names(whole), "|").alias("parts"))


def lemma(spark: SparkSession, folder: str) -> DataFrame:
    """Lemma and stem of every word of the function texts."""
    words = table(spark, folder, "gene").select(F.explode(F.regexp_extract_all(F.lower("function_text"), F.lit("([a-z]+)"), F.lit(1))).alias("word")).distinct()
    return words.select("word", X.lemma(F.col("word")).alias("lemma"), X.stem(F.col("word")).alias("stem"))


def merge_records(spark: SparkSession, folder: str) -> DataFrame:
    rows = records(spark, folder)
    return rows.select("id", "symbol", "description", "function", *[F.array_join(c, "|").alias(c) for c in R.LISTS], "reviewed")


def text_fields(spark: SparkSession, folder: str) -> DataFrame:
    return texts(spark, folder)


def concepts_word(spark: SparkSession, folder: str) -> DataFrame:
    return C.entity_words(tokens(spark, folder))


def word_df(spark: SparkSession, folder: str) -> DataFrame:
    return concepts_word(spark, folder).groupBy("word").agg(F.count("*").alias("n"))


def bigram_df(spark: SparkSession, folder: str) -> DataFrame:
    return C.entity_bigrams(tokens(spark, folder)).groupBy("pair").agg(F.count("*").alias("n"))


def _phrases(spark: SparkSession, folder: str) -> DataFrame:
    held = cut(tokens(spark, folder))
    return C.phrases(C.entity_words(held), C.entity_bigrams(held), background(spark, folder).count())


def phrases_npmi(spark: SparkSession, folder: str) -> DataFrame:
    return _phrases(spark, folder).withColumn("npmi", F.round("npmi", 6))


def concepts_phrase(spark: SparkSession, folder: str) -> DataFrame:
    return index(spark, folder, ("phrase",))


def concepts_keyword(spark: SparkSession, folder: str) -> DataFrame:
    return C.keyword_concepts(records(spark, folder))


def concepts_ontology(spark: SparkSession, folder: str) -> DataFrame:
    return index(spark, folder, ("go",))


def concept_index(spark: SparkSession, folder: str) -> DataFrame:
    return index(spark, folder)


def concept_df(spark: SparkSession, folder: str) -> DataFrame:
    return index(spark, folder).groupBy("layer", "concept").agg(F.count("*").alias("n"))


def onto_resolve(spark: SparkSession, folder: str) -> DataFrame:
    return resolved(spark, folder)


def onto_ancestors(spark: SparkSession, folder: str) -> DataFrame:
    """Every term with itself and all terms above it."""
    nodes, edges = ontology_graph(spark, folder)
    above = H.closure(edges).select(F.col("src").alias("id"), F.col("dst").alias("ancestor_id"))
    return above.unionByName(nodes.select(F.col("node").alias("id"), F.col("node").alias("ancestor_id"))).distinct()


def universe(spark: SparkSession, folder: str) -> DataFrame:
    return E.universe(index(spark, folder, ("keyword",)), background(spark, folder))


def missing_entities(spark: SparkSession, folder: str) -> DataFrame:
    return E.missing_entities(sets(spark, folder), universe(spark, folder))


def hypergeom(spark: SparkSession, folder: str) -> DataFrame:
    """The tail for each distinct line of counts of the keyword layer, with the study's size as it is."""
    held = cut(index(spark, folder, ("keyword",)))
    everyone = background(spark, folder)
    rows = E.enrich(held, sets(spark, folder), everyone, LIMITS).select("k_study", "n_study", "k_bg", "n_bg").distinct()
    tail = S.hypergeometric_tail(*[F.col(c) for c in ("k_study", "n_study", "k_bg", "n_bg")])
    return rows.withColumn("log_p", F.round(-F.log10(F.greatest(tail, F.lit(1e-300))), 6) + F.lit(0.0))


def bh_fdr(spark: SparkSession, folder: str) -> DataFrame:
    """False discovery rates over the p values of the comparison table, set by set."""
    rows = table(spark, folder, "hormones_compare").where("set_name IS NOT NULL AND p_value IS NOT NULL AND NOT isnan(p_value)")
    tests = rows.select("row_no", F.col("set_name").alias("set_id"), "p_value", (F.coalesce("k_study", F.lit(0)) >= 2).alias("tested"))
    return E.false_discovery(tests).select("row_no", F.round("fdr", 9).alias("fdr"))


def _enriched(layers: tuple[str, ...], spark: SparkSession, folder: str) -> DataFrame:
    rows = E.enrich(cut(index(spark, folder, layers)), sets(spark, folder), background(spark, folder), LIMITS)
    # places of rows without a status depend on the last digits of p values near 1
    rows = rounded(rows.withColumn("place", F.when(F.col("status") != "", F.col("rank"))))
    return rows.select("set_id", "concept", "layer", "label", "k_study", "n_study", "k_bg", "n_bg", "fold", "p_value", "tested", "fdr", "status", "place")


def significant(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(described(spark, folder)).where("status = 'significant' AND representative").select("set_id", "concept", "display", "merged", "k_study", "fold", "p_value", "fdr", "genes", "symbols")


def top_concepts(spark: SparkSession, folder: str) -> DataFrame:
    """The words of each set's cloud: the first 60 significant ones and 25 trends."""
    rows = described(spark, folder).where("representative")
    rows = positions(rows.withColumn("kind", F.concat_ws("|", "status", "set_id")), "kind", [F.col("rank")], "place").drop("kind")
    return rounded(rows.where("place <= CASE status WHEN 'significant' THEN 60 ELSE 25 END")).select("set_id", "status", "place", "display", "fold", "fdr")


def merge_groups(spark: SparkSession, folder: str) -> DataFrame:
    rows, held, study = results(spark, folder, ("word", "phrase", "keyword"))
    groups = D.merge_groups(rows, D.candidate_hits(rows, held, study), LIMITS)
    labels = rows.select("set_id", "rank", "concept")
    return groups.join(labels, ["set_id", "rank"]).join(labels.select("set_id", F.col("rank").alias("group_rank"), F.col("concept").alias("group_concept")), ["set_id", "group_rank"]).select("set_id", "concept", "group_concept")


def display_phrase(spark: SparkSession, folder: str) -> DataFrame:
    return described(spark, folder).where("representative AND layer = 'word'").select("set_id", "concept", "display")


def overlap_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The candidates of a set that are close enough to stand for one another, with the members they share."""
    rows, held, study = results(spark, folder, ("word", "phrase", "keyword"))
    pairs = D.close_pairs(rows, D.candidate_hits(rows, held, study), LIMITS)
    side = lambda r, c: rows.select("set_id", F.col("rank").alias(r), F.col("concept").alias(c))
    named = pairs.join(side("rank", "a"), ["set_id", "rank"]).join(side("earlier", "b"), ["set_id", "earlier"])
    return named.select("set_id", F.least("a", "b").alias("concept_a"), F.greatest("a", "b").alias("concept_b"), "shared")


def compare_top(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(CMP.leading(described(spark, folder, ("keyword",)))).select("set_id", "place", "label", "fdr")


def compare_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Leading keywords of all sets, on every set that has them."""
    return rounded(CMP.comparison(described(spark, folder, ("keyword",))))


def legacy_freq(spark: SparkSession, folder: str) -> DataFrame:
    held = texts(spark, folder, C.TEXT_FIELDS[:-1])
    return M.entity_words(held).groupBy("word").agg(F.sum("n").alias("freq"))


def legacy_mc(spark: SparkSession, folder: str) -> DataFrame:
    """The frequency test of every set."""
    held = cut(texts(spark, folder, C.TEXT_FIELDS[:-1]))
    rows = M.frequency_test(held, sets(spark, folder), background(spark, folder))
    return rows.withColumn("enrich_ratio", F.round("enrich_ratio", 6))


QUERIES = {f.__name__: f for f in (
    normalise_ids, recognised_members, set_sizes, clean_text, split_names, lemma, merge_records, text_fields, concepts_word, word_df, bigram_df,
    phrases_npmi, concepts_phrase, concepts_keyword, concepts_ontology, concept_index, concept_df, onto_resolve, onto_ancestors, universe,
    missing_entities, hypergeom, bh_fdr, significant, top_concepts, merge_groups, display_phrase, overlap_pairs, compare_top, compare_grid,
    legacy_freq, legacy_mc,
)} | {f"enrich_{name}": partial(_enriched, layers) for name, layers in (("words", ("word",)), ("keywords", ("keyword",)), ("terms", ("go",)), ("multi", ("word", "phrase", "keyword")))}
