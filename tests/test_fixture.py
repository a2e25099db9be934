"""The moss from source files to tested concepts, tables, pictures and the command line."""

import io
import math
from pathlib import Path

import pytest
from conftest import N_MOSS, moss, moss_species
from pyspark.sql import functions as F

from termweave import Engine, cli
from termweave.operators import compare, concepts, enrich, hierarchy, montecarlo, records, redundancy
from termweave.session import cut
from termweave.sources import annotation

SPECIES = moss_species()
COPPER = [moss(i) for i in range(5)]
CONCEPTS = {
    "w:pump", "w:copper", "w:ions", "w:vacuole", "w:efflux", "w:atpase", "w:export", "w:metal",
    "p:pump copper", "p:copper ions", "p:copper efflux", "p:efflux atpase", "p:copper export", "p:metal pump",
    "k:Copper transport", "k:Ion pump", "k:Membrane", "g:GO:7000003", "g:GO:7000002",
}


@pytest.fixture(scope="module")
def built(spark, source_folder):
    rows, terms = annotation.build_records(spark, source_folder, SPECIES.id_pattern)
    return cut(rows), cut(terms)


@pytest.fixture(scope="module")
def index(built):
    rows, terms = built
    clean = lambda c: F.upper(F.trim(c))
    _, edges = hierarchy.parent_edges(terms, clean(F.col("id")), F.transform("parents", clean))
    return cut(concepts.concept_index(rows, SPECIES, concepts.LAYERS, terms, hierarchy.closure(edges), terms, min_entities=3))


def members(spark, ids, name="study"):
    return cut(enrich.recognised(spark.createDataFrame([(name, i, x) for i, x in enumerate(ids)], "set_id string, pos long, entity_id string"), SPECIES.id_pattern))


def everyone(spark, n=N_MOSS):
    return spark.createDataFrame([(moss(i),) for i in range(n)], "entity_id string")


def test_records(built):
    rows = {r.id: r for r in built[0].collect()}
    first = rows[moss(0)]
    assert len(rows) == N_MOSS and first.symbol == "CUP0" and first.reviewed and first.go == ["GO:7000003"]
    assert first.keywords == ["Copper transport", "Ion pump", "Membrane", "Proteomics identification"] and first.protein_names == ["Protein 0"]
    assert first.function == "Pumps copper ions out of the vacuole." and first.names == ["entity 0"] and first.families == ["Metal pumps"]
    assert rows[moss(3)].synonyms == ["x3"] and rows[moss(1)].go == ["GO:7000003"]
    assert rows[moss(5)].symbol == "CIL5" and rows[moss(5)].description == 'Shaft of "cilia"' and rows[moss(5)].go == ["GO:7000005"]
    assert rows[moss(9)].protein_names == rows[moss(10)].protein_names == ["Spore coat"] and rows[moss(10)].symbol == "" and rows[moss(10)].go == []


def test_concepts_of_the_five_entities(spark, index):
    out = enrich.enrich(index, members(spark, COPPER), everyone(spark)).collect()
    tested = [r for r in out if r.tested]
    assert {r.concept for r in tested} == CONCEPTS and all(r.k_study == r.k_bg == r.n_study == 5 and r.n_bg == N_MOSS for r in tested)
    assert all(math.isclose(r.fdr, 1 / math.comb(N_MOSS, 5), rel_tol=1e-8) and math.isclose(r.fold, N_MOSS / 5) for r in tested)
    assert sorted(r["rank"] for r in out) == list(range(1, len(out) + 1))


def test_one_representative(spark, built, index):
    study = members(spark, COPPER)
    rows = enrich.enrich(index, study, everyone(spark))
    out = redundancy.described(rows, index, study, built[0].select("id", "symbol")).where("representative").collect()
    assert len(out) == 1 and out[0].symbols.startswith("CUP0, CUP") and len(out[0].merged.split(", ")) >= 15


def test_small_background_and_few_members(spark, index):
    out = enrich.enrich(index, members(spark, [moss(0), moss(20)]), everyone(spark, 30)).collect()
    assert {r.n_bg for r in out} == {30} and all(r.fdr == 1 for r in out if r.k_study < 2)


def test_background_is_required(spark, index):
    study = members(spark, [moss(0)])
    with pytest.raises(ValueError):
        enrich.enrich(index, study, None)
    with pytest.raises(ValueError):
        enrich.enrich(index, study, spark.createDataFrame([("NOBODY",)], "entity_id string"))
    with pytest.raises(ValueError):
        enrich.enrich(index, members(spark, ["PP99G99999"]), everyone(spark))
    with pytest.raises(ValueError):
        concepts.concept_index(None, SPECIES, ("word", "colour"))


def test_phrase_cap_is_the_callers(built):
    rows, terms = built
    few = concepts.concept_index(rows, SPECIES, ("phrase",), terms, min_entities=3, max_phrases=2)
    assert few.select("concept").distinct().count() == 2


def test_recognised_ids(spark):
    got = members(spark, ["# pp01g00100", None, " pp01g00100.2", "PP01G00100", "xx;PP02G00103;", "none"]).orderBy("pos").collect()
    assert [(r.pos, r.entity_id) for r in got] == [(2, "PP01G00100"), (4, "PP02G00103")]


def test_comparison_and_its_grid(spark, index):
    study = members(spark, COPPER, "n").unionByName(members(spark, [moss(i) for i in range(5, 9)], "h")).unionByName(members(spark, [moss(40), moss(8)], "o"))
    rows = redundancy.described(enrich.enrich(index, study, everyone(spark)), index, study)
    sparse = compare.comparison(rows, 3)
    grid = compare.filled(sparse, ["n", "h", "o"]).collect()
    labels = {r.label for r in grid}
    assert len(grid) == 3 * len(labels) > 0 and all(r.fold is None and r.fdr == 1 for r in grid if r.k_study == 0)
    assert {tuple(r) for r in grid if r.k_study} == {tuple(r) for r in sparse.collect()}
    with pytest.raises(ValueError):
        compare.filled(sparse, [str(i) for i in range(compare.GRID_SETS + 1)])


def test_frequency_test(spark, built):
    texts = cut(concepts.text_fields(built[0], built[1], concepts.TEXT_FIELDS[:-1]))
    sets = members(spark, COPPER, "copper").unionByName(members(spark, [moss(i) for i in range(20, 30)], "none"))
    out = {(r.set_id, r.word): r for r in montecarlo.frequency_test(texts, sets, everyone(spark), samples=20).collect()}
    copper = out["copper", "copper"]
    assert copper.significant and copper.freq == 10 and copper.rdm == 0 and copper.genome_count == 10 and ("none", "copper") not in out
    assert not out["copper", "protein"].significant
    # against samples drawn one by one
    words = montecarlo.entity_words(texts).collect()
    ids = {r.entity_id for r in texts.collect()}
    for name, size in (("copper", 5), ("none", 10)):
        drawn = montecarlo.draws(spark.createDataFrame([(i,) for i in sorted(ids)], "entity_id string"), size, 20).collect()
        assert len(drawn) == 20 * size
        for word in {w for n, w in out if n == name}:
            freq = [sum(r.n for r in words if r.word == word and r.entity_id in {d.entity_id for d in drawn if d.sample == s}) for s in range(1, 21)]
            assert out[name, word].rdm == sum(f >= out[name, word].freq for f in freq)


def test_lists_and_sets_from_files_and_standard_input(spark, tmp_path, monkeypatch):
    (tmp_path / "ids.txt").write_text("# all\nA1, B2\tC3\n\nD4 A1\n")
    got = annotation.read_ids(spark, str(tmp_path / "ids.txt")).orderBy("pos").collect()
    assert [r.entity_id for r in got] == ["A1", "B2", "C3", "D4", "A1"]
    monkeypatch.setattr("sys.stdin", io.StringIO("# no\nX1,Y2\n"))
    assert [r.entity_id for r in annotation.read_ids(spark, "-").orderBy("pos").collect()] == ["X1", "Y2"]
    for separator in "\t,;":
        (tmp_path / "sets").write_text(f"gene{separator}set\nA1{separator} one\n\"B2\"{separator}two\n{separator}two\nlonely\n")
        rows = annotation.read_sets(spark, str(tmp_path / "sets")).orderBy("pos").collect()
        assert [(r.set_id, r.entity_id) for r in rows] == [("set", "gene"), ("one", "A1"), ("two", "B2")]


def test_compression_is_known_by_its_bytes(spark, source_folder, tmp_path):
    import gzip

    packed = Path(f"{source_folder}/annotations.gaf.gz").read_bytes()
    (tmp_path / "packed").write_bytes(packed)
    (tmp_path / "plain.gz").write_bytes(gzip.decompress(packed))
    wanted = annotation.read_associations(spark, f"{source_folder}/annotations.gaf.gz", SPECIES.id_pattern).drop("row_no").collect()
    for name in ("packed", "plain.gz"):
        assert sorted(map(str, annotation.read_associations(spark, str(tmp_path / name), SPECIES.id_pattern).drop("row_no").collect())) == sorted(map(str, wanted))
    assert len(wanted) == N_MOSS


def test_engine(spark, source_folder, tmp_path):
    rows, terms = annotation.build_records(spark, source_folder, SPECIES.id_pattern)
    rows.write.parquet(f"{tmp_path}/records")
    terms.write.parquet(f"{tmp_path}/terms")
    engine = Engine(spark, str(tmp_path), SPECIES, ("word", "keyword"))
    result = engine.run([*COPPER, "PP99G99999", "no id"], [moss(i) for i in range(N_MOSS)])
    assert result.background_size == N_MOSS and [r.entity_id for r in result.missing.collect()] == ["PP99G99999"]
    assert result.significant.count() == 1 and result.trend.count() == 0 and result.summary().startswith("1 significant concepts; 5 entities used, 1 missing")
    assert {r.symbol for r in engine.symbol(result.study.select("entity_id")).collect()} == {f"CUP{i}" for i in range(5)}
    for background in (None, "PP01G00100", [], ["nothing"]):
        with pytest.raises(ValueError):
            engine.run(COPPER, background)
    with pytest.raises(ValueError):
        Engine(spark, str(tmp_path), SPECIES, ("colour",))


def test_command_line_from_sources_to_outputs(spark, source_folder, tmp_path, monkeypatch, capsys):
    monkeypatch.setitem(concepts.SPECIES, "moss", SPECIES)
    told, background, sets, out = (tmp_path / n for n in ("told.txt", "all.txt", "sets.csv", "out"))
    told.write_text("# copper\n" + "\n".join(COPPER + ["PP99G99999"]))
    background.write_text("\n".join(moss(i) for i in range(N_MOSS)))
    sets.write_text("\n".join([*(f"{x},cu/1" for x in COPPER), *(f"{moss(i)},cu 1" for i in range(5, 9))]))
    cli.main(["build", "--species", "moss", "--sources", source_folder, "--out", f"{out}/built"])
    common = ["--species", "moss", "-a", f"{out}/built", "-b", str(background)]
    cli.main(["run", str(told), *common, "-o", f"{out}/run", "--title", "Copper <5>", "--theme", "dark", "--layers", "word,keyword,go"])
    assert "1 significant concepts; 5 entities used, 1 missing" in capsys.readouterr().out
    page = Path(f"{out}/run.html").read_text()
    assert "<svg" in page and "Copper &lt;5&gt;" in page and moss(4) in page and "CUP4" in page and "<svg" in Path(f"{out}/run.svg").read_text()
    lines = [line.split("\t") for f in Path(f"{out}/run.tsv").glob("part-*") for line in f.read_text().splitlines()]
    assert {"k", "n", "K", "N", "p", "fdr"} <= set(lines[0]) and len(lines) > 10 and all(len(line) == len(lines[0]) for line in lines)
    cli.main(["compare", str(sets), *common, "-o", f"{out}/two", "--per-set", "3"])
    assert {f.name for f in out.iterdir()} >= {"two_cu_1.svg", "two_cu_1_2.svg", "two_cu_1.html", "two_cu_1_2.html", "two_sets.tsv", "two_compare.tsv", "two_compare.svg"}
    cli.main(["legacy", str(told), *common, "-o", f"{out}/legacy.tsv", "--sampling", "10"])
    assert spark.read.csv(f"{out}/legacy.tsv", sep="\t", header=True).where("word = 'copper' AND significant").count() == 1
    with pytest.raises(SystemExit):
        cli.main(["run", str(told), *common, "-o", f"{out}/run", "--formats", "pdf"])


@pytest.mark.parametrize("at_once", [10_000, 1])
def test_merge_of_pieces(spark, monkeypatch, at_once):
    monkeypatch.setattr(records, "ENTITY_ROWS", at_once)
    rows = [
        (3, "g1", "-", ["b", "a"], None, "last", ["P (x)"], "Binds. Binds more.", ["k2"], None, ["go:2"], False),
        (1, " G1.1", "S1", ["a", None, "-"], ["n"], "first", None, "Binds.", ["k1", ""], [], [" GO:1"], False),
        (2, "G1", "S2", None, None, "-", None, "Binds.", [" k3 "], None, ["GO:9"], True),
        (4, None, "S9", None, None, None, None, None, None, None, None, True),
    ]
    names = "row_no long, id string, symbol string, synonyms array<string>, full_names array<string>, description string, protein_names array<string>, function_text string, keywords array<string>, families array<string>, go_ids array<string>, reviewed boolean"
    resolved = spark.createDataFrame([("GO:1", "GO:1"), ("GO:2", "GO:1")], "given string, id string")
    (got,) = records.merged_records(spark.createDataFrame(rows, names), resolved).collect()
    assert (got.id, got.symbol, got.description, got.synonyms, got.go) == ("G1", "S1", "last", ["a", "b"], ["GO:1"])
    assert got.keywords == ["k3"] and got.function == "Binds." and got.reviewed and got.protein_names == []
