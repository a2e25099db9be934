"""Session helpers: a local session for tests and the bench, tables, lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session on this machine, for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("termweave")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, or set on the context.

    A local session without one, as in tests, gets a folder of this machine. On a cluster that would be a different folder on
    every machine, so there a missing setting raises RuntimeError.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named
    if not re.match(r"local(\[[^-]*\])?$", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again, so that its lineage ends there.

    A checkpoint would end the lineage too, but hands on the estimated size of its plan. The estimates of
    joins multiply, so over a loop of joins they can grow without bound (not profiled); a table has the
    size that was measured. The tables go when the driver ends, or before by ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place, files = _place(spark, path)
    files.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the tables behind frames that ``cut`` gave and that nothing will read again, as the older rounds of a loop."""
    for frame in frames:
        place, files = _place(frame.sparkSession, frame.cut_path)
        files.delete(place, True)
