import gzip
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from termweave.session import local_session

    return local_session(4, 4, spark__driver__memory="6g")


N_MOSS = 48


def moss(i):
    """Ids of a made-up moss: chromosome, g, number."""
    return f"PP{1 + i % 7:02d}G{100 + 3 * i:05d}"


def moss_species():
    from termweave.operators.concepts import Species

    return Species("a made-up moss", r"\bPP\d{2}G\d{5}\b", ("moss",))


def gene_line(i):
    """Tax, symbol, locus, synonyms, description, two names; every fourth id stands among the synonyms only."""
    symbol = f"CUP{i}" if i < 5 else "-" if i % 2 else moss(i)
    told = "Copper efflux ATPase" if i < 5 else "\"Shaft of \"\"cilia\"\"\"" if i < 9 else "-"
    locus, others = ("-", f"x{i}|{moss(i).lower()}") if i % 4 == 3 else (moss(i), "-")
    return [f"99\t{symbol}\t{locus}\t{others}\t{told}\t-\t-"]


def protein_lines(i):
    """Entry, reviewed, loci, primary, names, function, keywords, families; unreviewed rows of reviewed entities must not count."""
    if i < 5:
        rows = [f"A{i}\treviewed\t{moss(i).lower()}\t\tProtein {i} (EC 7.2.2.8)\tFUNCTION: Pumps copper ions out of the vacuole. (PubMed:77) {{ECO:0000250}}\tCopper transport; Ion pump;Membrane;Proteomics identification\tMetal pumps"]
        return [*rows, f"B{i}\tunreviewed\t{moss(i)}\t\tWrong name\tFUNCTION: Wrong text.\tWrong keyword\tWrong kin"]
    if i < 9:
        return [f"A{i}\treviewed\t{moss(i)}\tCIL{i} old\tCiliary beam {i}\tFUNCTION: Holds the beat of the cilium (By similarity).\tMotility\t"]
    # two loci in one row
    return [f"A{i}\tunreviewed\t{moss(i)}; {moss(i + 1)}\t\tSpore coat\t\tDesiccation\t"] if i % 8 == 1 else []


def association_lines(i):
    term = ("GO:7999999" if i % 2 else "go:7000003") if i < 5 else "GO:7000005" if i < 9 else "GO:7000009" if i % 3 else "GO:0008150"
    place = ["", moss(i), ""] if i % 5 == 4 else [moss(i).lower(), f"s{i}", f"s{i}|{moss(i)}"]
    row = f"DB\t{place[0] or 'x'}\t{place[1]}\t{{}}\t{{}}\tREF\tIEA\t\tP\tentity {i}\t{place[2]}\tprotein"
    return [row.format("", term), row.format("NOT|part_of", "GO:7000005"), "too\tshort"]


TERMS = """
[Term]
id: GO:0008150
name: process

[Term]
id: GO:7000002
name: metal transport
namespace: biological_process
is_a: GO:0008150 ! process

[Term]
id: GO:7000003
name: copper export
namespace: biological_process
alt_id: GO:7999999
relationship: part_of GO:7000002 ! metal transport

[Term]
id: GO:7000005
name: ciliary beat
namespace: biological_process
is_a: GO:0008150

[Term]
id: GO:7000009
name: gone
is_obsolete: true

[Typedef]
id: part_of
name: part of
"""


@pytest.fixture(scope="session")
def source_folder(tmp_path_factory):
    """The moss in the four source formats: five entities of copper, four of cilia, the others of neither."""
    folder = tmp_path_factory.mktemp("moss")
    files = {
        "gene_info.gz": (["#tax_id\tSymbol\tLocusTag\tSynonyms\tdescription\tFull_name_from_nomenclature_authority\tOther_designations"], gene_line),
        "uniprot.tsv.gz": (["Entry\tReviewed\tGene Names (ordered locus)\tGene Names (primary)\tProtein names\tFunction [CC]\tKeywords\tProtein families"], protein_lines),
        "annotations.gaf.gz": (["!gaf-version: 2.2", "!generated for tests"], association_lines),
    }
    for name, (lines, of) in files.items():
        text = "\n".join([*lines, *(x for i in range(N_MOSS) for x in of(i))]) + "\n"
        (folder / name).write_bytes(gzip.compress(text.encode()))
    (folder / "go-basic.obo.gz").write_bytes(gzip.compress(f"format-version: 1.2\n{TERMS}\n".encode()))
    return str(folder)
