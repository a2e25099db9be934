"""The keyword postings of a stream of deliveries: document frequencies kept up to date.

Whole-corpus statistics (phrase scores, background counts) are batch aggregates over the postings this
maintains. ``keyword_postings`` holds the pairs seen in the stream's state; ``merge_into`` holds them in a table instead, which
suits a stream of years: no state grows, and a micro-batch reads the table's pairs once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.utils import AnalysisException
from pyspark.sql import functions as F

from termweave.functions.ids import entity_id, list_values


def keyword_postings(deliveries: DataFrame, event_time: str = "loaded_at") -> DataFrame:
    """(entity_id, keyword, event time) of a stream of gene rows: each pair once, at whatever delay it comes again.

    The pairs seen stay in the state for good, a row each, as genes come again after months.
    """
    rows = deliveries.select(entity_id(F.col("id")).alias("entity_id"), F.explode(F.array_distinct(list_values(F.col("keywords")))).alias("keyword"), event_time)
    return rows.where("entity_id IS NOT NULL").dropDuplicates(["entity_id", "keyword"])


def keyword_counts(postings: DataFrame) -> DataFrame:
    """(keyword, n) over the postings so far; for output modes complete and update."""
    return postings.groupBy("keyword").agg(F.count("*").alias("n"))


def merge_into(folder: str) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``: the postings of a micro-batch of gene rows that the table in ``folder`` doesn't hold yet are added to it.

    Each micro-batch has a folder of its own, written anew if the batch is repeated after a failure, so a pair is there once.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = keyword_postings(batch).select("entity_id", "keyword")
        try:
            held = spark.read.parquet(folder).where(F.col("batch") != batch_id)
            fresh = fresh.join(held.select("entity_id", "keyword"), ["entity_id", "keyword"], "left_anti")
        except AnalysisException:  # the first batch
            pass
        fresh.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return merge
