"""The gene table as tokens: one row per gene, field and value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.functions.ids import entity_id, latin_words, list_values
from termweave.session import table


def gene_count(spark: SparkSession, folder: str) -> int:
    """Number of genes, those without values included."""
    return table(spark, folder, "gene").select(entity_id(F.col("id")).alias("gene")).where("gene IS NOT NULL").distinct().count()


def gene_tokens(spark: SparkSession, folder: str, fields: dict[str, Column]) -> DataFrame:
    """(gene, field_name, term): every value of the given array expressions, repeats included."""
    named = F.array(*[F.struct(F.lit(name).alias("field_name"), values.alias("terms")) for name, values in fields.items()])
    rows = table(spark, folder, "gene").select(entity_id(F.col("id")).alias("gene"), F.explode(named).alias("f")).where("gene IS NOT NULL")
    return rows.select("gene", "f.field_name", F.explode("f.terms").alias("term"))


def basket_items(spark: SparkSession, folder: str) -> DataFrame:
    """(record, item): k: + keyword, n: + protein name and w: + function word of every gene, repeats included."""
    prefixed = lambda values, mark: F.transform(values, lambda x: F.concat(F.lit(mark), x))
    items = F.concat(
        prefixed(list_values(F.col("keywords")), "k:"),
        prefixed(list_values(F.col("protein_names")), "n:"),
        prefixed(F.array_distinct(latin_words(F.col("function_text"))), "w:"),
    )
    return table(spark, folder, "gene").select(entity_id(F.col("id")).alias("record"), F.explode(items).alias("item")).where("record IS NOT NULL")


def set_values(spark: SparkSession, folder: str) -> DataFrame:
    """(record, value): the GO ids and keywords of every gene, repeats included."""
    values = F.concat(list_values(F.col("go_ids")), list_values(F.col("keywords")))
    return table(spark, folder, "gene").select(entity_id(F.col("id")).alias("record"), F.explode(values).alias("value")).where("record IS NOT NULL")
