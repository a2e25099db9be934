"""Readers of the annotation formats: gene tables, protein tables, association files, ontologies, lists.

Each gives rows in the form that operators.records merges, with row_no in file order. Files compressed with
gzip, whatever their name, are read as one piece each, which keeps their order.
"""

from __future__ import annotations

import sys
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.functions import text as X
from termweave.functions.ids import entity_id
from termweave.operators.records import merged_records, resolved_terms
from termweave.session import shared_folder

CSV = {"sep": "\t", "header": True, "quote": '"', "escape": '"', "multiLine": True, "encoding": "UTF-8"}


def sniffed(spark: SparkSession, path: str) -> str:
    """The path of a file whose name tells whether it is compressed, as Spark goes by the name: the file's own, or that of a copy.

    A file of gzip's first two bytes without the name, or with the name and without the bytes, is copied to the
    shared folder under a name that fits. Folders and patterns are taken as they are.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(conf)
    if not files.exists(place) or not files.getFileStatus(place).isFile():
        return path
    stream = files.open(place)
    try:
        packed = stream.read() == 0x1F and stream.read() == 0x8B
    finally:
        stream.close()
    if packed == path.endswith(".gz"):
        return path
    copy = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/source-{uuid.uuid4().hex}{'.gz' if packed else ''}")
    target = copy.getFileSystem(conf)
    jvm.org.apache.hadoop.fs.FileUtil.copy(files, place, target, copy, False, conf)
    target.deleteOnExit(copy)
    return copy.toString()


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("row_no", F.monotonically_increasing_id())


def _first_id(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), f"(?i)({pattern})", 1), F.lit(""))


def _record(rows: DataFrame, **given: Column) -> DataFrame:
    """Rows of the merge's form, missing fields empty."""
    kinds = {"symbol": "string", "synonyms": "array<string>", "full_names": "array<string>", "description": "string", "protein_names": "array<string>", "function_text": "string", "keywords": "array<string>", "families": "array<string>", "go_ids": "array<string>", "reviewed": "boolean", "primary_symbol": "string", "other_names": "array<string>"}
    return rows.select("row_no", given["id"].alias("id"), *[given.get(f, F.lit(None)).cast(kind).alias(f) for f, kind in kinds.items()]).where("id IS NOT NULL")


def gene_rows(table: DataFrame, pattern: str) -> DataFrame:
    """Rows of a gene table with row_no, LocusTag, Synonyms, Symbol, description and the two columns of names.

    The id is the first match in LocusTag, else in Synonyms; rows without one are left out.
    """
    names = F.concat(F.split(F.coalesce("Full_name_from_nomenclature_authority", F.lit("")), r"\|"), F.split(F.coalesce("Other_designations", F.lit("")), r"\|"))
    found = F.coalesce(_first_id(F.col("LocusTag"), pattern), _first_id(F.col("Synonyms"), pattern))
    return _record(table, id=found, symbol=F.col("Symbol"), synonyms=F.split("Synonyms", r"\|"), description=F.col("description"), full_names=names)


def read_gene_table(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``gene_rows`` of a tab-separated file with a header, whose first name may begin with #."""
    table = spark.read.csv(sniffed(spark, path), **CSV)
    return gene_rows(_numbered(table.toDF(*[c.lstrip("#") for c in table.columns])), pattern)


def protein_rows(table: DataFrame, pattern: str) -> DataFrame:
    """Rows of a protein table: one per id in the column of ordered loci, each id once per row."""
    ids = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("Gene Names (ordered locus)", F.lit("")), F.lit(f"(?i)({pattern})"), F.lit(1)), lambda x: entity_id(x)))
    rows = table.withColumn("one_id", F.explode(ids))
    return _record(
        rows,
        id=F.col("one_id"),
        protein_names=X.split_names(F.coalesce("Protein names", F.lit(""))),
        function_text=F.col("Function [CC]"),
        keywords=F.split("Keywords", ";"),
        families=F.array("Protein families"),
        reviewed=F.coalesce(F.col("Reviewed") == "reviewed", F.lit(False)),
        primary_symbol=F.element_at(F.split(F.trim(F.coalesce("Gene Names (primary)", F.lit(""))), r"\s+"), 1),
    )


def read_protein_table(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``protein_rows`` of a tab-separated file with a header."""
    return protein_rows(_numbered(spark.read.csv(sniffed(spark, path), **CSV)), pattern)


def association_rows(lines: DataFrame, pattern: str) -> DataFrame:
    """Rows of an association file's lines (row_no, value).

    Comments (!), lines of fewer than 11 fields and negated ones are left out. The id is the first match in
    the synonyms, else in the symbol, else in the object id; one row per line with its term and name.
    """
    fields = lines.where("NOT startswith(value, '!')").select("row_no", F.split("value", "\t").alias("f"))
    at = lambda i: F.get("f", F.lit(i))
    fields = fields.where((F.size("f") >= 11) & ~F.contains(at(3), F.lit("NOT")))
    found = F.coalesce(*[_first_id(at(i), pattern) for i in (10, 2, 1)])
    return _record(fields, id=found, go_ids=F.array(at(4)), other_names=F.array(at(9)))


def read_associations(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``association_rows`` of a file."""
    return association_rows(_numbered(spark.read.text(sniffed(spark, path))), pattern)


def read_ontology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(terms, alternatives) of an OBO file: id, term_name, term_namespace, parents, obsolete; alt_id, term_id.

    Only [Term] stanzas count; parents are the targets of is_a and of part_of relationships.
    """
    stanzas = spark.read.option("lineSep", "\n\n").text(sniffed(spark, path)).where(F.regexp_like("value", F.lit(r"^\s*\[Term\]")))
    one = lambda key: F.nullif(F.regexp_extract("value", rf"(?m)^{key}: (.*)$", 1), F.lit(""))
    every = lambda pattern: F.regexp_extract_all("value", F.lit(rf"(?m)^{pattern}"), F.lit(1))
    rows = stanzas.select(
        one("id").alias("id"),
        one("name").alias("term_name"),
        one("namespace").alias("term_namespace"),
        F.concat(every(r"is_a: (\S+)"), every(r"relationship: part_of (\S+)")).alias("parents"),
        (one("is_obsolete") == "true").alias("obsolete"),
        every(r"alt_id: (\S+)").alias("alternatives"),
    ).where("id IS NOT NULL")
    terms = rows.select("id", "term_name", "term_namespace", "parents", F.coalesce("obsolete", F.lit(False)).alias("obsolete"))
    return terms, rows.select(F.explode("alternatives").alias("alt_id"), F.col("id").alias("term_id"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(row_no, value): the lines of a file, or of the standard input for '-', which a user types or pipes."""
    if path == "-":
        return spark.createDataFrame([(i, line.rstrip("\r\n")) for i, line in enumerate(sys.stdin)], "row_no long, value string")
    return _numbered(spark.read.text(path)).select("row_no", "value")


def read_ids(spark: SparkSession, path: str, set_id: str = "list") -> DataFrame:
    """(set_id, pos, entity_id) of a text file of ids between blanks, tabs or commas; # lines are comments. '-' is the standard input.

    pos orders the ids: the line's number and the place in it.
    """
    lines = _lines(spark, path).where("NOT startswith(ltrim(value), '#')")
    words = lines.select("row_no", F.posexplode(F.split(F.trim("value"), r"[,\s]+")).alias("at", "entity_id")).where("entity_id <> ''")
    return words.select(F.lit(set_id).alias("set_id"), F.struct("row_no", "at").alias("pos"), "entity_id")


def sniffed_separator(lines: list[str]) -> str:
    """Which of tab, comma and semicolon stands in the most lines, equally often in each if possible; the tab if none does."""

    def fitness(separator: str) -> tuple[int, bool]:
        counts = [line.count(separator) for line in lines if line.strip()]
        return sum(c > 0 for c in counts), len(set(counts)) == 1

    return max("\t,;", key=fitness)


def read_sets(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(set_id, pos, entity_id) of a file with an id and a set in the first two columns; a header row holds no id and drops out later.

    Without a separator it is found from the first 50 lines. '-' is the standard input.
    """
    lines = _lines(spark, path)
    if separator is None:
        separator = sniffed_separator([r["value"] for r in lines.orderBy("row_no").limit(50).collect()])
    cells = F.from_csv("value", F.lit("id string, name string"), {"sep": separator, "quote": '"', "escape": '"'})
    rows = lines.select("row_no", cells.alias("c"))
    return rows.select(F.trim("c.name").alias("set_id"), F.col("row_no").alias("pos"), F.trim("c.id").alias("entity_id")).where("set_id IS NOT NULL AND entity_id <> ''")


#: Names of the four source files in their folder.
FILES = {"genes": "gene_info.gz", "proteins": "uniprot.tsv.gz", "associations": "annotations.gaf.gz", "ontology": "go-basic.obo.gz"}
#: Rows of one source come before those of the next.
SOURCE_STEP = 1 << 52


def build_records(spark: SparkSession, folder: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    """(records, terms) of a folder with the four source files; see ``operators.records.merged_records``."""
    path = lambda kind: f"{folder}/{FILES[kind]}"
    terms, alternatives = read_ontology(spark, path("ontology"))
    sources = [read_gene_table(spark, path("genes"), pattern), read_protein_table(spark, path("proteins"), pattern), read_associations(spark, path("associations"), pattern)]
    rows = sources[0]
    for step, source in enumerate(sources[1:], 1):
        rows = rows.unionByName(source.withColumn("row_no", F.col("row_no") + step * SOURCE_STEP))
    return merged_records(rows, resolved_terms(terms, alternatives), pattern), terms
