"""From records to concepts: texts, words, phrases, keywords and terms, one row per entity and concept."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.functions import stats as S
from termweave.functions import text as X
from termweave.operators.spread import spread_join
from termweave.session import cut

LAYERS = ("word", "phrase", "keyword", "go")
TEXT_FIELDS = ("names", "description", "protein_names", "function", "families", "go_names")
# Keywords that describe the record, not the entity; roots of the three ontologies; their short names.
TECHNICAL_KEYWORDS = ("Reference proteome", "Proteomics identification", "3D-structure", "Direct protein sequencing", "Alternative splicing", "Signal", "Phosphoprotein", "Acetylation")
ROOT_TERMS = ("GO:0008150", "GO:0003674", "GO:0005575")
NAMESPACES = {"biological_process": "BP", "molecular_function": "MF", "cellular_component": "CC"}


@dataclass(frozen=True)
class Species:
    """How a species' identifiers look, and words to leave out for it."""

    name: str
    id_pattern: str
    extra_stop_words: tuple[str, ...] = ()


SPECIES = {"arabidopsis": Species("Arabidopsis thaliana", r"\bAT[1-5CM]G\d{5}\b", ("arabidopsis", "thaliana", "tair"))}


def text_fields(records: DataFrame, names: DataFrame, fields: Sequence[str] = TEXT_FIELDS) -> DataFrame:
    """(entity_id, field_name, text): the non-empty texts of the chosen fields, one row each.

    records is best a table, as its terms are counted first. names: id, term_name, for the field go_names; a term without a name is given by its id. Unknown fields raise ValueError.
    """
    if unknown := set(fields) - set(TEXT_FIELDS):
        raise ValueError(f"unknown text fields {sorted(unknown)}; choose from {TEXT_FIELDS}")
    kinds = dict(records.dtypes)
    parts = [F.struct(F.lit(f).alias("field_name"), (F.col(f) if kinds[f].startswith("array") else F.array(f)).alias("texts")) for f in fields if f != "go_names"]
    out = None
    if parts:
        rows = records.select(F.col("id").alias("entity_id"), F.explode(F.array(*parts)).alias("f"))
        out = rows.select("entity_id", "f.field_name", F.explode("f.texts").alias("text"))
    if "go_names" in fields:
        go = records.select(F.col("id").alias("entity_id"), F.explode("go").alias("id"))
        named = spread_join(go, names.select("id", "term_name"), ["id"], "left").select("entity_id", F.lit("go_names").alias("field_name"), F.coalesce("term_name", "id").alias("text"))
        out = named if out is None else out.unionByName(named)
    return out.where("text <> ''")


def tokenised(texts: DataFrame, species: Species, keep_symbols: bool = False) -> DataFrame:
    """(entity_id, tokens) of each text; see functions.text.tokens."""
    return texts.select("entity_id", X.tokens(F.col("text"), species.id_pattern, species.extra_stop_words, keep_symbols).alias("tokens"))


def entity_words(tokens: DataFrame) -> DataFrame:
    """(entity_id, word), each once."""
    return tokens.select("entity_id", F.explode("tokens").alias("word")).where("word IS NOT NULL").distinct()


def entity_bigrams(tokens: DataFrame) -> DataFrame:
    """(entity_id, pair) of neighbouring tokens, each once."""
    return tokens.select("entity_id", F.explode(X.bigrams(F.col("tokens"))).alias("pair")).distinct()


def phrases(words: DataFrame, pairs: DataFrame, entity_count: int, min_entities: int = 5, min_npmi: float = 0.35, max_phrases: int = 20_000) -> DataFrame:
    """(pair, n_pair, n_a, n_b, npmi) of the collocations among the entities' pairs.

    Pairs of a word with itself, in fewer than min_entities, in all entities or below min_npmi are none. The
    max_phrases best by score are kept, equal scores by the pair from the end of the alphabet.
    """
    single = words.groupBy("word").agg(F.count("*").alias("n"))
    counted = pairs.groupBy("pair").agg(F.count("*").alias("n_pair")).where(F.col("n_pair") >= min_entities)
    split = counted.select("pair", "n_pair", F.substring_index("pair", " ", 1).alias("a"), F.substring_index("pair", " ", -1).alias("b")).where("a <> b")
    scored = split.join(single.select(F.col("word").alias("a"), F.col("n").alias("n_a")), "a").join(single.select(F.col("word").alias("b"), F.col("n").alias("n_b")), "b")
    scored = scored.withColumn("npmi", S.npmi(F.col("n_pair"), F.col("n_a"), F.col("n_b"), F.lit(entity_count)))
    best = scored.where(F.col("npmi") >= min_npmi).orderBy(F.col("npmi").desc(), F.col("a").desc(), F.col("b").desc()).limit(max_phrases)
    return best.select("pair", "n_pair", "n_a", "n_b", "npmi")


def keyword_concepts(records: DataFrame, left_out: Iterable[str] = TECHNICAL_KEYWORDS) -> DataFrame:
    """(entity_id, layer, concept, label) of the keywords that describe the entity."""
    rows = records.select(F.col("id").alias("entity_id"), F.explode("keywords").alias("label")).where(~F.col("label").isin(*left_out)).distinct()
    return rows.select("entity_id", F.lit("keyword").alias("layer"), F.concat(F.lit("k:"), "label").alias("concept"), "label")


def term_concepts(records: DataFrame, reach: DataFrame, terms: DataFrame, roots: Iterable[str] = ROOT_TERMS) -> DataFrame:
    """(entity_id, layer, concept, label) of an entity's terms and all their ancestors, without the roots.

    reach: src, dst of the hierarchy's closure; terms: id, term_name, term_namespace.
    """
    direct = records.select(F.col("id").alias("entity_id"), F.explode("go").alias("src"))
    above = spread_join(direct, reach.select("src", "dst"), ["src"]).select("entity_id", F.col("dst").alias("id"))
    held = direct.select("entity_id", F.col("src").alias("id")).unionByName(above).distinct().where(~F.col("id").isin(*roots))
    short = F.coalesce(*[F.when(F.col("term_namespace") == k, v) for k, v in NAMESPACES.items()], F.lit(""))
    return spread_join(cut(held), terms, ["id"]).select("entity_id", F.concat(F.lit("GO "), short).alias("layer"), F.concat(F.lit("g:"), "id").alias("concept"), F.coalesce("term_name", "id").alias("label"))


def concept_index(
    records: DataFrame,
    species: Species,
    layers: Sequence[str] = ("word", "phrase", "keyword"),
    names: DataFrame | None = None,
    reach: DataFrame | None = None,
    terms: DataFrame | None = None,
    fields: Sequence[str] = TEXT_FIELDS,
    keep_symbols: bool = False,
    min_entities: int = 5,
    min_npmi: float = 0.35,
    max_phrases: int = 20_000,
    roots: Iterable[str] = ROOT_TERMS,
) -> DataFrame:
    """(entity_id, layer, concept, label), each concept of an entity once, in the chosen layers.

    Without an ontology (names, reach and terms) the layer go is empty and go_names play no part. The layer phrase holds
    the max_phrases best pairs (see ``phrases``).
    Unknown layers raise ValueError.
    """
    if unknown := set(layers) - set(LAYERS):
        raise ValueError(f"unknown layers {sorted(unknown)}; choose from {LAYERS}")
    out = []
    if {"word", "phrase"} & set(layers):
        used = [f for f in fields if f != "go_names" or names is not None]
        tokens = cut(tokenised(text_fields(records, names, used), species, keep_symbols))
        words = entity_words(tokens)
        if "word" in layers:
            out.append(words.select("entity_id", F.lit("word").alias("layer"), F.concat(F.lit("w:"), "word").alias("concept"), F.col("word").alias("label")))
        if "phrase" in layers:
            pairs = entity_bigrams(tokens)
            kept = phrases(words, pairs, records.count(), min_entities, min_npmi, max_phrases)
            held = pairs.join(kept.select("pair"), "pair", "left_semi")
            out.append(held.select("entity_id", F.lit("phrase").alias("layer"), F.concat(F.lit("p:"), "pair").alias("concept"), F.col("pair").alias("label")))
    if "keyword" in layers:
        out.append(keyword_concepts(records))
    if "go" in layers and reach is not None and terms is not None:
        out.append(term_concepts(records, reach, terms, roots))
    index = out[0] if out else records.sparkSession.createDataFrame([], "entity_id string, layer string, concept string, label string")
    for other in out[1:]:
        index = index.unionByName(other)
    return index
