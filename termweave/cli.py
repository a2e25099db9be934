"""Command line: build records from source files, test lists against a background, compare sets, draw lots."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from termweave import __version__
from termweave.engine import Engine
from termweave.operators import concepts, enrich
from termweave.render import svg, tables
from termweave.sources import annotation

FORMATS = ("tsv", "svg", "html")


def formats(text: str) -> tuple[str, ...]:
    chosen = tuple(text.split(","))
    if unknown := set(chosen) - set(FORMATS):
        raise argparse.ArgumentTypeError(f"unknown formats {sorted(unknown)}; choose from {','.join(FORMATS)}")
    return chosen


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="termweave")
    top.add_argument("--version", action="version", version=f"termweave {__version__}")
    commands = top.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="merge the source files of a folder into records")
    build.add_argument("--sources", required=True)
    build.add_argument("--out", required=True)
    build.add_argument("--species", default="arabidopsis", choices=sorted(concepts.SPECIES))
    for name, given, text in (("run", "genes", "one list to a table, a cloud and a page"), ("compare", "sets", "several sets side by side"), ("legacy", "genes", "the test by random draws")):
        command = commands.add_parser(name, help=text)
        command.add_argument(given, help="file; - for the standard input")
        command.add_argument("-a", "--annotation", required=True, help="folder that build wrote")
        command.add_argument("-b", "--background", required=True, help="file of all ids that could have been in the list")
        command.add_argument("-o", "--out", required=True)
        command.add_argument("--species", default="arabidopsis", choices=sorted(concepts.SPECIES))
        command.add_argument("--layers", default="word,phrase,keyword")
        command.add_argument("--title")
        command.add_argument("--theme", default="light", choices=sorted(svg.PAPER))
        command.add_argument("--formats", type=formats, default=FORMATS)
        for flag, kind, value in (("fdr", float, 0.05), ("min-genes", int, 2), ("max-frac", float, 0.25), ("merge", float, 0.75), ("min-fold", float, 1.0), ("trend-p", float, 0.01), ("top", int, 60), ("per-set", int, 8), ("sampling", int, 100), ("seed", int, 1)):
            command.add_argument(f"--{flag}", type=kind, default=value)
    return top


def main(arguments: list[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("termweave").getOrCreate()
    if args.command == "build":
        records, terms = annotation.build_records(spark, args.sources, concepts.SPECIES[args.species].id_pattern)
        records.orderBy("id").write.mode("overwrite").parquet(f"{args.out}/records")
        terms.write.mode("overwrite").parquet(f"{args.out}/terms")
        print(args.out)
        return
    engine = Engine(spark, args.annotation, args.species, args.layers.split(","))
    background, out = annotation.read_ids(spark, args.background), Path(args.out)
    if args.command == "legacy":
        tested = engine.legacy(annotation.read_ids(spark, args.genes), background, args.sampling, args.seed).drop("set_id")
        tables.write_tsv(tested.orderBy(F.desc("significant"), F.desc("freq"), "word"), args.out)
        print(args.out)
        return
    limits = enrich.Limits(args.min_genes, args.fdr, args.max_frac, args.merge, args.min_fold, args.trend_p)
    out.parent.mkdir(parents=True, exist_ok=True)
    if args.command == "compare":
        result = engine.run(annotation.read_sets(spark, args.sets), background, limits)
        taken: set[str] = set()
        stems = {name: f"{out}_{tables.file_stem(name, taken)}" for name in result.names}
        result.draw(stems, {name: f"{args.title}: {name}" if args.title else name for name in stems}, args.formats, args.theme, args.top)
        if "tsv" in args.formats:
            result.to_tsv(f"{out}_sets.tsv")
        grid = result.comparison(args.per_set).orderBy("label", "set_id")
        tables.write_tsv(grid, f"{out}_compare.tsv")
        Path(f"{out}_compare.svg").write_text(svg.dots_svg([r.asDict() for r in grid.collect()], args.theme))  # sets times their leading labels
        print(f"{len(stems)} sets -> {out}_*")
        return
    result = engine.run(annotation.read_ids(spark, args.genes), background, limits)
    if "tsv" in args.formats:
        result.to_tsv(f"{out}.tsv")
    name = result.names[0]
    result.draw({name: out}, {name: args.title or (Path(args.genes).stem if args.genes != "-" else name)}, args.formats, args.theme, args.top)
    print(f"{result.summary()} -> {out}.*")


if __name__ == "__main__":
    main()
