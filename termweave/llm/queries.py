"""Registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.functions.ids import latin_words, list_values
from termweave.llm import encode, frequency, genes, leaks, pairs, residue, similar, topn
from termweave.session import table


def p1_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every two items that the same genes carry, with counts and surprise."""
    return pairs.cooccurrence(genes.basket_items(spark, folder), genes.gene_count(spark, folder))


def p1_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Every two items that the same genes carry, with their counts and how often they meet against the two frequencies."""
    return p1_pairs(spark, folder).select("item_a", "item_b", "n_a", "n_b", "n_both", F.round("lift", 6).alias("lift"))


def p1_surprising(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs met more often than chance allows, at a false discovery rate of one in a hundred over all pairs."""
    rows = p1_pairs(spark, folder).where("q_value <= 0.01 AND n_both > expected")
    return rows.select("item_a", "item_b", "n_both", F.round("expected", 6).alias("expected"), F.round(-F.log10(F.greatest("p_value", F.lit(1e-300))), 6).alias("log_p"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs in at least 5 and a 2,000th of all genes, at least four times as often as by their frequencies."""
    n = genes.gene_count(spark, folder)
    rows = pairs.cooccurrence(genes.basket_items(spark, folder), n, max(5, -(-n // 2000)))
    return rows.where(f"n_both * {n} >= 4 * n_a * n_b").select("item_a", "item_b")


#: Similarity of p2: 7/10 or more between sets of four or more values.
ALIKE = {"num": 7, "den": 10, "min_size": 4}


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of genes whose sets of GO ids and keywords agree in 7 of 10 values."""
    members, classes = similar.set_classes(genes.set_values(spark, folder), ALIKE["min_size"])
    pairs_ = similar.record_pairs(members, similar.similar_classes(classes, **ALIKE))
    return pairs_.select(F.col("record_a").alias("gene_a"), F.col("record_b").alias("gene_b"))


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every gene with a set of four or more values: its class, the class's size and the gene's links."""
    members, classes = similar.set_classes(genes.set_values(spark, folder), ALIKE["min_size"])
    return similar.class_links(members, classes, similar.similar_classes(classes, **ALIKE)).withColumnRenamed("record", "gene")


def p2_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of classes with different sets that agree in 7 of 10 values, with the overlap."""
    _, classes = similar.set_classes(genes.set_values(spark, folder), ALIKE["min_size"])
    linked = similar.similar_classes(classes, **ALIKE)
    for s in "ab":
        linked = linked.join(classes.select(F.col("class_no").alias(f"class_{s}"), F.col("class_id").alias(f"id_{s}")), f"class_{s}")
    return linked.select(F.least("id_a", "id_b").alias("class_a"), F.greatest("id_a", "id_b").alias("class_b"), "overlap", "n_values")


def p3_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Every term of the three fields with its counts and mark."""
    fields = {"function_text": latin_words(F.col("function_text")), "description": latin_words(F.col("description")), "keywords": list_values(F.col("keywords"))}
    tokens = genes.gene_tokens(spark, folder, fields).withColumnRenamed("gene", "record")
    return frequency.marked(frequency.term_frequency(tokens), genes.gene_count(spark, folder))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of one gene, and of more than a quarter of all genes."""
    return p3_terms(spark, folder).where("mark IS NOT NULL").select("field_name", "term", "mark")


def p5_top(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 labels of each set with the lowest fdr, with their positions."""
    rows = table(spark, folder, "hormones_compare").where("label <> ''")
    best = topn.top_n(rows.select(F.col("set_name").alias("grp"), F.col("label").alias("item"), F.col("fdr").alias("score")), 5)
    return best.select(F.col("grp").alias("set_name"), F.col("item").alias("label"), F.col("score").alias("fdr"), "position")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 labels of each set with the lowest fdr."""
    return p5_top(spark, folder).select("set_name", "label")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of every document."""
    return encode.encode_texts(table(spark, folder, "documents"))


def p6_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each document's ids decode to its text again."""
    documents = table(spark, folder, "documents")
    decoded = encode.decode_ids(encode.encode_texts(documents)).withColumnRenamed("text", "decoded")
    return documents.select("doc_id", "text").join(decoded, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("exact"))


def p7_quotations(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the evaluation items they quote, how much of them and where."""
    return leaks.quotations(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the evaluation items they quote."""
    return p7_quotations(spark, folder).select("doc_id", "item_id").distinct()


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with template residue, filler, errors or script notices."""
    return residue.residue_documents(table(spark, folder, "documents"))


def p8_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The residue messages with their kind and how widely they recur."""
    return residue.recurring(table(spark, folder, "documents")).select("message", "kind", "n_documents", "n_sources")


GENES = """
gene_ AS (SELECT upper(split_part(trim(id, ' '), '.', 1)) AS gene, * FROM gene WHERE upper(split_part(trim(id, ' '), '.', 1)) <> ''),
all_ AS (SELECT count(DISTINCT gene) AS n FROM gene_)
"""
WORDS = "unnest(regexp_extract_all(lower({0}), '[a-z]{{3,}}'))"
VALUES = "unnest(list_filter(list_transform({0}, lambda x: lower(trim(x, ' '))), lambda x: x <> ''))"
ITEMS = f"""
items_ AS (SELECT DISTINCT gene, item FROM (
 SELECT gene, 'k:' || {VALUES.format("keywords")} AS item FROM gene_ UNION ALL
 SELECT gene, 'n:' || {VALUES.format("protein_names")} FROM gene_ UNION ALL
 SELECT gene, 'w:' || {WORDS.format("function_text")} FROM gene_)),
single_ AS (SELECT item, count(*) AS n FROM items_ GROUP BY item)
"""
SETS = f"""
values_ AS (SELECT DISTINCT gene, v FROM (SELECT gene, {VALUES.format("go_ids")} AS v FROM gene_ UNION ALL SELECT gene, {VALUES.format("keywords")} FROM gene_)),
sets_ AS (SELECT gene, count(*) AS size, md5(string_agg(v, '|' ORDER BY v)) AS content FROM values_ GROUP BY gene HAVING count(*) >= 4),
shared_ AS (SELECT a.gene AS gene_a, b.gene AS gene_b, count(*) AS overlap FROM values_ a JOIN values_ b ON a.v = b.v AND a.gene < b.gene GROUP BY ALL),
alike_ AS (SELECT gene_a, gene_b, overlap, x.size + y.size - overlap AS n_values FROM shared_ JOIN sets_ x ON x.gene = gene_a JOIN sets_ y ON y.gene = gene_b WHERE 10 * overlap >= 7 * (x.size + y.size - overlap)),
classes_ AS (SELECT content, min(gene) AS class_id, count(*) AS class_size FROM sets_ GROUP BY content)
"""
TERMS = f"""
tokens_ AS (
 SELECT gene, 'function_text' AS field_name, {WORDS.format("function_text")} AS term FROM gene_ UNION ALL
 SELECT gene, 'description', {WORDS.format("description")} FROM gene_ UNION ALL
 SELECT gene, 'keywords', {VALUES.format("keywords")} FROM gene_),
terms_ AS (SELECT field_name, term, count(*) AS occurrences, count(DISTINCT gene) AS records FROM tokens_ GROUP BY ALL),
marked_ AS (SELECT t.*, CASE WHEN records = 1 THEN 'rare' WHEN records * 4 > n THEN 'common' END AS mark FROM terms_ t, all_)
"""
TOP = """
best_ AS (SELECT set_name, label, min(fdr) AS fdr FROM hormones_compare WHERE set_name IS NOT NULL AND label <> '' AND fdr IS NOT NULL AND NOT isnan(fdr) GROUP BY ALL),
placed_ AS (SELECT *, row_number() OVER (PARTITION BY set_name ORDER BY fdr, label) AS position FROM best_)
"""
ORACLE = {
    "p1_found": f"""WITH {GENES}, {ITEMS},
frequent_ AS (SELECT i.* FROM items_ i JOIN single_ s USING (item), all_ WHERE s.n >= 5 AND 2000 * s.n >= all_.n),
both_ AS (SELECT a.item AS item_a, b.item AS item_b, count(*) AS n_both FROM frequent_ a JOIN frequent_ b ON a.gene = b.gene AND a.item < b.item GROUP BY ALL)
SELECT item_a, item_b FROM both_ JOIN single_ x ON x.item = item_a JOIN single_ y ON y.item = item_b, all_
WHERE n_both >= 5 AND 2000 * n_both >= all_.n AND n_both * all_.n >= 4 * x.n * y.n""",
    "p1_counts": f"""WITH {GENES}, {ITEMS},
met_ AS (SELECT a.item AS item_a, b.item AS item_b, count(*) AS n_both FROM items_ a JOIN items_ b ON a.gene = b.gene AND a.item < b.item GROUP BY ALL)
SELECT item_a, item_b, x.n AS n_a, y.n AS n_b, n_both, round(n_both * all_.n / (x.n * y.n), 6) AS lift FROM met_ JOIN single_ x ON x.item = item_a JOIN single_ y ON y.item = item_b, all_""",
    "p2_found": f"WITH {GENES}, {SETS} SELECT gene_a, gene_b FROM alike_",
    "p2_classes": f"""WITH {GENES}, {SETS}, ends_ AS (SELECT gene_a AS gene FROM alike_ UNION ALL SELECT gene_b FROM alike_)
SELECT s.gene, class_id, class_size, (SELECT count(*) FROM ends_ e WHERE e.gene = s.gene) AS n_links FROM sets_ s JOIN classes_ USING (content)""",
    "p2_pairs": f"""WITH {GENES}, {SETS}
SELECT gene_a AS class_a, gene_b AS class_b, overlap, n_values FROM alike_ JOIN classes_ c ON c.class_id = gene_a JOIN classes_ d ON d.class_id = gene_b""",
    "p3_terms": f"WITH {GENES}, {TERMS} SELECT field_name, term, occurrences, records, mark FROM marked_",
    "p3_found": f"WITH {GENES}, {TERMS} SELECT field_name, term, mark FROM marked_ WHERE mark IS NOT NULL",
    "p5_top": f"WITH {TOP} SELECT set_name, label, fdr, position FROM placed_ WHERE position <= 5",
    "p6_roundtrip": "SELECT doc_id, TRUE AS exact FROM documents",
    "p5_found": f"WITH {TOP} SELECT set_name, label FROM placed_ WHERE position <= 5",
}
QUERIES = {f.__name__: f for f in (p1_pairs, p1_counts, p1_surprising, p1_found, p2_pairs, p2_classes, p2_found, p3_terms, p3_found, p5_top, p5_found, p6_ids, p6_roundtrip, p7_quotations, p7_found, p8_found, p8_messages)}
