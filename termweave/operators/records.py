"""One merged record per entity from deliveries in pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.functions import text as X
from termweave.functions.ids import entity_id, term_id
from termweave.operators.spread import spread_join
from termweave.session import cut

#: Fields of which only rows of reviewed entries count, where an entity has any.
REVIEWED_FIRST = ("protein_names", "function", "keywords", "families", "primary")
#: The fields that are lists in a record.
LISTS = ("synonyms", "names", "protein_names", "keywords", "families", "go")


def resolved_terms(terms: DataFrame, alternatives: DataFrame) -> DataFrame:
    """(given, id, term_name): every usable spelling of a term id: its own and alternative ones.

    terms: id, term_name, obsolete; alternatives: alt_id, term_id. A term that any row calls obsolete is none. One
    alternative hop is followed; an id that is both a term and an alternative is taken as the alternative.
    """
    rows = terms.select(term_id(F.col("id")).alias("id"), "term_name", F.coalesce("obsolete", F.lit(False)).alias("obsolete")).where("id IS NOT NULL")
    usable = rows.groupBy("id").agg(F.min("term_name").alias("term_name"), F.max("obsolete").alias("obsolete")).where("NOT obsolete").drop("obsolete")
    other = alternatives.select(term_id(F.col("alt_id")).alias("given"), term_id(F.col("term_id")).alias("id")).dropna().groupBy("given").agg(F.min("id").alias("id"))
    own = usable.select(F.col("id").alias("given"), "id").join(other.select("given"), "given", "left_anti")
    return own.unionByName(other).join(usable, "id").select("given", "id", "term_name")


def merged_records(rows: DataFrame, resolved: DataFrame | None = None, id_pattern: str | None = None) -> DataFrame:
    """One row per entity: id, symbol, synonyms, names, description, protein_names, function, keywords, families, go, reviewed.

    rows: row_no (the order), id, symbol, synonyms, full_names, description, protein_names, function_text,
    keywords, families, go_ids, reviewed. Ids are brought to one spelling; rows without one are left out.
    First symbol wins, last description wins, lists keep each value once in order of first delivery, and a
    function text is appended unless it is part of what is there. '-' and '' are missing values. Two columns are
    optional: primary_symbol takes the symbol's place where that is missing or holds a blank, and other_names are
    appended to names where neither names nor protein_names have them.

    An entity's deliveries are brought together in one shuffle; those of an entity with more than ENTITY_ROWS are first
    reduced to their different values, field by field, so that repeated deliveries don't pile up in one row.
    """
    cleaned = _cleaned(rows, id_pattern)
    counts = cleaned.groupBy("entity_id").agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > ENTITY_ROWS).select("entity_id")
    if (hot := cut(counts)).isEmpty():
        wide = _whole(cleaned)
    else:
        wide = _whole(cleaned.join(hot, "entity_id", "left_anti")).unionByName(_by_value(cleaned.join(hot, "entity_id", "left_semi")))
    go = F.coalesce("go", F.array().cast("array<string>"))
    if resolved is not None:
        wide = wide.drop("go").join(_resolved_go(cleaned, resolved), "entity_id", "left")
    function = F.aggregate("function", F.lit(""), lambda acc, x: F.when(F.contains(acc, x), acc).otherwise(F.trim(F.concat(acc, F.lit(" "), x))))
    symbol, primary = F.get("symbol", F.lit(0)), F.get("primary", F.lit(0))
    return wide.select(
        F.col("entity_id").alias("id"),
        F.when(~F.contains(symbol, F.lit(" ")), symbol).otherwise(F.coalesce(primary, symbol, F.lit(""))).alias("symbol"),
        F.coalesce("description", F.lit("")).alias("description"),
        function.alias("function"),
        "synonyms",
        F.concat("names", F.array_except("others", F.concat("names", "protein_names"))).alias("names"),
        "protein_names",
        "keywords",
        "families",
        go.alias("go"),
        "reviewed",
    )


#: Deliveries of an entity that are brought together as they are.
ENTITY_ROWS = 10_000
#: Fields of a cleaned delivery; each is a list of values in order.
FIELDS = ("symbol", "description", "function", "synonyms", "names", "protein_names", "keywords", "families", "go", "primary", "others")


def _cleaned(rows: DataFrame, id_pattern: str | None) -> DataFrame:
    """entity_id, row_no, reviewed and FIELDS of the deliveries that have an entity, with missing values left out."""
    none = F.array().cast("array<string>")
    listed = lambda c: F.filter(F.transform(F.coalesce(F.col(c), none), lambda x: X.present(x)), lambda x: x.isNotNull())
    single = lambda value: F.array_compact(F.array(value))
    no_id = lambda values: F.filter(values, lambda x: ~F.regexp_like(x, F.lit(f"^(?i:{id_pattern})\\z"))) if id_pattern else values
    fields = {
        "symbol": no_id(single(X.present(F.col("symbol")))),
        "description": single(X.present(F.col("description"))),
        "function": single(F.nullif(X.clean_function(F.col("function_text")), F.lit(""))),
        "synonyms": no_id(listed("synonyms")),
        "names": listed("full_names"),
        "protein_names": listed("protein_names"),
        "keywords": listed("keywords"),
        "families": listed("families"),
        "go": F.transform(listed("go_ids"), lambda x: F.upper(x)),
        "primary": single(X.present(F.col("primary_symbol"))) if "primary_symbol" in rows.columns else none,
        "others": listed("other_names") if "other_names" in rows.columns else none,
    }
    columns = [fields[name].alias(name) for name in FIELDS]
    return rows.select(entity_id(F.col("id")).alias("entity_id"), "row_no", F.coalesce("reviewed", F.lit(False)).alias("reviewed"), *columns).where("entity_id IS NOT NULL")


def _whole(cleaned: DataFrame) -> DataFrame:
    """Each field's values in order of first delivery, from all deliveries of an entity at once."""
    packed = cleaned.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("row_no", "reviewed", *FIELDS))).alias("d"), F.max("reviewed").alias("reviewed"))
    packed = packed.withColumn("r", F.when(F.col("reviewed"), F.filter("d", lambda x: x["reviewed"])).otherwise(F.col("d")))
    every = lambda name: F.flatten(F.transform("r" if name in REVIEWED_FIRST else "d", lambda x: x[name]))
    columns = [F.get(F.reverse(F.flatten(F.transform("d", lambda x: x["description"]))), F.lit(0)).alias(name) if name == "description" else F.array_distinct(every(name)).alias(name) for name in FIELDS]
    return packed.where("size(d) > 0").select("entity_id", "reviewed", *columns)


def _by_value(cleaned: DataFrame) -> DataFrame:
    """The same for entities of any number of deliveries: equal values are brought together before an entity's are."""
    parts = F.array(F.struct(F.lit("").alias("field"), F.array(F.lit("")).alias("parts")), *[F.struct(F.lit(name).alias("field"), F.col(name).alias("parts")) for name in FIELDS])
    long = cleaned.select("entity_id", "row_no", "reviewed", F.explode(parts).alias("f")).select("entity_id", "row_no", "reviewed", "f.field", F.posexplode("f.parts").alias("pos", "value"))
    at = F.struct("row_no", "pos")
    once = long.groupBy("entity_id", "field", "value").agg(F.min(at).alias("at"), F.min(F.when(F.col("reviewed"), at)).alias("reviewed_at"), F.max("row_no").alias("last"))
    per_entity = once.groupBy("entity_id").agg(F.collect_list(F.struct("field", "at", "reviewed_at", "last", "value")).alias("v"), F.max(F.col("reviewed_at").isNotNull()).alias("reviewed"))

    def values(name: str) -> Column:
        of = lambda place: F.transform(F.array_sort(F.transform(F.filter("v", lambda x: (x["field"] == name) & x[place].isNotNull()), lambda x: F.struct(x[place].alias("at"), x["value"].alias("value")))), lambda x: x["value"])
        if name == "description":
            return F.get(F.reverse(of("last")), F.lit(0))
        return F.when(F.col("reviewed"), of("reviewed_at")).otherwise(of("at")) if name in REVIEWED_FIRST else of("at")

    return per_entity.select("entity_id", "reviewed", *[values(name).alias(name) for name in FIELDS])


def _resolved_go(cleaned: DataFrame, resolved: DataFrame) -> DataFrame:
    """(entity_id, go): an entity's terms as they resolve, in order of first delivery."""
    given = cleaned.select("entity_id", "row_no", F.posexplode("go").alias("pos", "given"))
    known = spread_join(given, resolved.select("given", "id"), ["given"]).groupBy("entity_id", "id").agg(F.min(F.struct("row_no", "pos")).alias("at"))
    return known.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("go"))
