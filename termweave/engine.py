"""The analysis as two objects: an engine over built records, and the result of a run over any number of sets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.functions.ids import term_id
from termweave.operators import compare, concepts, enrich, hierarchy, montecarlo, redundancy
from termweave.operators.spread import positions
from termweave.render import page, svg, tables
from termweave.session import cut

#: Name of the only set where ids are given as a plain list.
ONLY = "list"


class Engine:
    """Concepts of the records in a folder that ``sources.annotation.build_records`` was written to, as records and terms."""

    def __init__(
        self,
        spark: SparkSession,
        annotation: str,
        species: str | concepts.Species = "arabidopsis",
        layers: Sequence[str] = ("word", "phrase", "keyword"),
        text_fields: Sequence[str] = concepts.TEXT_FIELDS,
        keep_symbols: bool = False,
        phrase_min_entities: int = 5,
        phrase_min_npmi: float = 0.35,
        max_phrases: int = 20_000,
    ):
        if unknown := set(layers) - set(concepts.LAYERS):
            raise ValueError(f"unknown layers {sorted(unknown)}; choose from {concepts.LAYERS}")
        self.spark, self.layers, self.text_fields = spark, tuple(layers), tuple(text_fields)
        self.species = concepts.SPECIES[species] if isinstance(species, str) else species
        self.records, self.terms = (spark.read.parquet(f"{annotation}/{name}") for name in ("records", "terms"))
        self.tuned = {"keep_symbols": keep_symbols, "min_entities": phrase_min_entities, "min_npmi": phrase_min_npmi, "max_phrases": max_phrases}

    @cached_property
    def index(self) -> DataFrame:
        """(entity_id, layer, concept, label), made once for all runs."""
        reach = None
        if "go" in self.layers:
            _, edges = hierarchy.parent_edges(self.terms, term_id(F.col("id")), F.transform("parents", lambda x: term_id(x)))
            reach = hierarchy.closure(edges)
        return cut(concepts.concept_index(self.records, self.species, self.layers, self.terms, reach, self.terms, self.text_fields, **self.tuned))

    def normalise(self, ids: DataFrame | Sequence[str]) -> DataFrame:
        """(set_id, pos, entity_id) of the recognised ids; ids: set_id, pos, entity_id, or a list of strings as one set."""
        if not isinstance(ids, DataFrame):
            if isinstance(ids, str):
                raise ValueError("a list of ids is wanted, not one string")
            ids = self.spark.createDataFrame([(ONLY, i, x) for i, x in enumerate(ids)], "set_id string, pos long, entity_id string")
        return enrich.recognised(ids, self.species.id_pattern)

    def symbol(self, entities: DataFrame) -> DataFrame:
        """``entities`` (entity_id, ...) with symbol: that of the record, else the id."""
        known = self.records.select(F.col("id").alias("entity_id"), F.nullif("symbol", F.lit("")).alias("symbol"))
        return entities.join(known, "entity_id", "left").withColumn("symbol", F.coalesce("symbol", "entity_id"))

    def _everyone(self, background: DataFrame | Sequence[str]) -> DataFrame:
        if background is None:
            raise ValueError("a background is required: the ids that could have been in the sets")
        everyone = cut(self.normalise(background).select("entity_id").distinct())
        if everyone.isEmpty():
            raise ValueError("no id of the background is recognised")
        return everyone

    def run(self, sets: DataFrame | Sequence[str], background: DataFrame | Sequence[str], limits: enrich.Limits = enrich.Limits()) -> Result:
        """The test of every set, in one job. Errors: see ``operators.enrich.enrich``."""
        everyone, members = self._everyone(background), cut(self.normalise(sets))
        inside = cut(enrich.universe(self.index, everyone))
        study = cut(members.join(inside, "entity_id", "left_semi"))
        tested = enrich.enrich(self.index, study, everyone, limits)
        table = redundancy.described(tested, self.index, study, self.records.select("id", "symbol"), limits)
        return Result(self, cut(table), members, study, inside.count(), limits)

    def legacy(self, sets: DataFrame | Sequence[str], background: DataFrame | Sequence[str], samples: int = 100, seed: int = 1) -> DataFrame:
        """The test by random draws; see ``operators.montecarlo.frequency_test``."""
        texts = cut(concepts.text_fields(self.records, self.terms, concepts.TEXT_FIELDS[:-1]))
        return montecarlo.frequency_test(texts, self.normalise(sets), self._everyone(background), samples, seed)


class Result:
    """What a run gave: ``table`` with a row per set and concept, the usable members of each set and the size of the background."""

    def __init__(self, engine: Engine, table: DataFrame, members: DataFrame, study: DataFrame, background_size: int, limits: enrich.Limits):
        self.engine, self.table, self.members, self.study, self.background_size, self.limits = engine, table, members, study, background_size, limits

    @property
    def significant(self) -> DataFrame:
        return self.table.where("status = 'significant' AND representative")

    @property
    def trend(self) -> DataFrame:
        return self.table.where("status = 'trend' AND representative")

    @property
    def missing(self) -> DataFrame:
        """(set_id, entity_id) of the members without a concept or outside the background."""
        return enrich.missing_entities(self.members, self.study.select("entity_id").distinct())

    @cached_property
    def names(self) -> list[str]:
        """The sets in order; more than compare.GRID_SETS raise ValueError, as no one looks at so many pictures."""
        names = [r["set_id"] for r in self.members.select("set_id").distinct().orderBy("set_id").limit(compare.GRID_SETS + 1).collect()]
        if len(names) > compare.GRID_SETS:
            raise ValueError(f"more than {compare.GRID_SETS} sets; use the table")
        return names

    def summary(self) -> str:
        n_used = self.study.count()
        return f"{self.significant.count()} significant concepts; {n_used} entities used, {self.members.count() - n_used} missing"

    def to_tsv(self, folder: str) -> None:
        """The table as tab-separated parts in order, with a folder for each set where there are several."""
        several = len(self.names) > 1
        tables.write_tsv(self.table.orderBy("set_id", "rank"), folder, by="set_id" if several else None)

    def entities(self) -> dict[str, tuple[int, list[dict]]]:
        """Of each set the number of its entities and the first page.ENTITIES, with symbol and a name."""
        name = F.coalesce(F.get("protein_names", F.lit(0)), F.nullif("description", F.lit("")), F.lit(""))
        named = self.study.join(self.engine.records.select(F.col("id").alias("entity_id"), "symbol", name.alias("name")), "entity_id")
        counts = {r["set_id"]: r["n"] for r in self.study.groupBy("set_id").agg(F.count("*").alias("n")).collect()}  # a row per set
        out: dict[str, tuple[int, list[dict]]] = {name: (n, []) for name, n in counts.items()}
        shown = positions(named, "set_id", [F.col("entity_id")], "place").where(F.col("place") <= page.ENTITIES)
        for r in shown.orderBy("set_id", "place").collect():
            out[r["set_id"]][1].append({"id": r["entity_id"], "symbol": r["symbol"], "name": r["name"]})
        return out

    def draw(self, stems: dict[str, str | Path], titles: dict[str, str] | None = None, formats: Sequence[str] = ("svg", "html"), theme: str = "light", top: int = svg.TOP, layers: Sequence[str] | None = None) -> None:
        """The cloud (svg) and the page (html) of each set, as files that begin with its stem."""
        shown = svg.cloud_rows(self.table, tuple(layers) if layers else None, top)
        entities = self.entities() if "html" in formats else {}
        for name, stem in stems.items():
            rows, title = shown.get(name, []), (titles or {}).get(name, name)
            picture = svg.cloud_svg(rows, title, theme=theme)
            if "svg" in formats:
                Path(f"{stem}.svg").write_text(picture)
            if "html" in formats:
                n, listed = entities.get(name, (0, []))
                Path(f"{stem}.html").write_text(page.page(title, picture, rows, listed, n))

    def comparison(self, per_set: int = 8) -> DataFrame:
        """The full grid of all sets and their leading labels."""
        return cut(compare.filled(compare.comparison(self.table, per_set), self.names))
