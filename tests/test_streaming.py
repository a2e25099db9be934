"""The keyword stream over several micro-batches."""

from datetime import datetime

from termweave.streaming import postings

SCHEMA = "id string, keywords array<string>, loaded_at timestamp"


BATCHES = [
    [("g1", ["A", "b"], datetime(2024, 6, 1)), (None, ["a"], datetime(2024, 6, 1))],
    [("G1.2", [" a "], datetime(2024, 9, 1)), ("g2", ["a", "c"], datetime(2024, 9, 1))],
    [("g3", ["c"], datetime(2023, 1, 1)), ("g2", ["A", "a"], datetime(2025, 3, 1))],
]


def deliveries(spark, tmp_path):
    for n, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/b={n}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/b=*")


def test_pairs_count_once_at_any_delay(spark, tmp_path):
    counts = postings.keyword_counts(postings.keyword_postings(deliveries(spark, tmp_path)))
    query = counts.writeStream.outputMode("complete").format("memory").queryName("keyword_counts").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert {(r.keyword, r.n) for r in spark.table("keyword_counts").collect()} == {("a", 2), ("b", 1), ("c", 2)}


def test_postings_merged_into_a_table_survive_a_repeated_batch(spark, tmp_path):
    folder = f"{tmp_path}/postings"
    merge = postings.merge_into(folder)
    query = deliveries(spark, tmp_path).writeStream.foreachBatch(merge).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    wanted = {("G1", "a"), ("G1", "b"), ("G2", "a"), ("G2", "c"), ("G3", "c")}
    held = lambda: [(r.entity_id, r.keyword) for r in spark.read.parquet(folder).collect()]
    assert sorted(held()) == sorted(wanted)
    merge(spark.createDataFrame(BATCHES[1], SCHEMA), 1)
    assert sorted(held()) == sorted(wanted)
