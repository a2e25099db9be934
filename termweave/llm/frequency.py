"""Frequency of every distinct term: occurrences and records, by last-seen counters.

Tokens are dealt to partitions by a hash of the term (and of a salt taken from the record, so that a
term that holds a third of all tokens is spread) and ordered by record. A partition then needs one small
counter per term: occurrences, records and the last record seen. A record adds to the record count only
where it differs from the last one, so no set of records is ever held. Salted counters are added up,
since a record's tokens of one term share their salt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.operators.spread import partitions

#: Tokens that a task counts; the numbers of partitions and of parts of one term's counter follow from it.
TASK_TOKENS = 1_000_000


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats of a term in a record within a batch, as one row with their number."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).group_by(["field_name", "term", "record"]).aggregate([("term", "count")])
        yield from table.select(["field_name", "term", "record", "term_count"]).rename_columns(["field_name", "term", "record", "n"]).to_batches()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last-seen counters over one partition, whose rows come ordered by record."""
    place: dict[tuple[str, str], int] = {}
    occurrences, records, last = (np.zeros(1024, np.int64) for _ in range(3))
    record_no, previous = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        fields, terms = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
        names, words = fields.dictionary.to_pylist(), terms.dictionary.to_pylist()
        pair = fields.indices.to_numpy().astype(np.int64) * len(words) + terms.indices.to_numpy()
        distinct, code = np.unique(pair, return_inverse=True)
        at = np.array([place.setdefault((names[x // len(words)], words[x % len(words)]), len(place)) for x in distinct.tolist()])[code]
        while len(occurrences) < len(place):
            occurrences, records, last = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (occurrences, records, last))
        record = batch.column(2)
        changed = np.ones(batch.num_rows, bool)
        changed[1:] = pc.not_equal(record[1:], record[:-1]).to_numpy(zero_copy_only=False)
        changed[0] = record[0].as_py() != previous
        number = record_no + np.cumsum(changed)
        record_no, previous = int(number[-1]), record[-1].as_py()
        np.add.at(occurrences, at, batch.column(3).to_numpy())
        seen = np.unique(at * (batch.num_rows + 1) + (number - number[0]))
        term, in_record = seen // (batch.num_rows + 1), seen % (batch.num_rows + 1) + number[0]
        np.add.at(records, term, last[term] != in_record)
        np.maximum.at(last, term, in_record)
    keys = list(place)
    for start in range(0, len(keys), 50_000):
        some = keys[start : start + 50_000]
        columns = [pa.array([k[0] for k in some], pa.string()), pa.array([k[1] for k in some], pa.string()), pa.array(occurrences[start : start + len(some)]), pa.array(records[start : start + len(some)])]
        yield pa.RecordBatch.from_arrays(columns, ["field_name", "term", "occurrences", "records"])


def term_frequency(tokens: DataFrame) -> DataFrame:
    """(field_name, term, occurrences, records) of tokens (field_name, record, term), all STRING.

    Rows with a null in any of the three are left out; the empty string is a term like any other; other
    columns play no part. No tokens give no rows. The tokens are counted first: a task gets about TASK_TOKENS,
    also of a term that holds a third of all.
    """
    named = tokens.select("field_name", "term", "record").dropna()
    shares = -(-named.count() // TASK_TOKENS)
    combined = named.mapInArrow(_combine, "field_name string, term string, record string, n long")
    salted = combined.withColumn("salt", F.pmod(F.xxhash64("record"), F.lit(max(shares, 1))))
    ordered = salted.repartition(max(partitions(tokens), 2 * shares), "field_name", "term", "salt").select("field_name", "term", "record", "n").sortWithinPartitions("record")
    counted = ordered.mapInArrow(_count, "field_name string, term string, occurrences long, records long")
    return counted.groupBy("field_name", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked(frequencies: DataFrame, record_count: int, rare_to: int = 1, common_over: float = 0.25) -> DataFrame:
    """With mark: 'rare' up to rare_to records, 'common' over that share of all records, else null.

    A term that is both (of very few records) is 'rare' first.
    """
    return frequencies.withColumn("mark", F.when(F.col("records") <= rare_to, "rare").when(F.col("records") > common_over * record_count, "common"))
