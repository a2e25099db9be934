"""Tables as tab-separated files, written by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Names of result columns in files for readers that tell k from K.
FILE_NAMES = {"k_study": "k", "n_study": "n", "k_bg": "K", "n_bg": "N", "p_value": "p", "set_id": "set"}


def file_stem(name: str, taken: set[str]) -> str:
    """A name of letters and digits for a file, other characters as _; with a number if it is taken, and taken from then on."""
    stem = plain = "".join(c if c.isalnum() else "_" for c in name) or "_"
    no = 1
    while stem in taken:
        no += 1
        stem = f"{plain}_{no}"
    taken.add(stem)
    return stem


def write_tsv(rows: DataFrame, folder: str, by: str | None = None) -> None:
    """``rows`` with file names as a folder of tab-separated parts in order; with ``by`` as a folder for each value of that column."""
    named = rows.toDF(*[FILE_NAMES.get(c, c) for c in rows.columns])
    writer = named.write.mode("overwrite").option("sep", "\t").option("header", True)
    (writer.partitionBy(FILE_NAMES.get(by, by)) if by else writer).csv(folder)
