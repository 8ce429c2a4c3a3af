"""Yearly files as they arrive: the batch pipeline's keep-last rule as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.dedup import keep_best


def read_arrivals(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 16) -> DataFrame:
    """A stream over the files of a directory, a bounded number of files a step."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def first_arrivals(stream: DataFrame, keys: list[str], time: str, delay: str = "30 days") -> DataFrame:
    """Repeats of a key within ``delay`` dropped; state older than the watermark is forgotten."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, key: str, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Counts per window and key, late rows within ``delay`` included."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, window), key).agg(F.count(F.lit(1)).alias("n"))


def merge_latest(target: str, keys: list[str], order: str):  # noqa: ANN201
    """A ``foreachBatch`` function that keeps the latest row of each key in a table of alternating versions.

    The first batch has nothing to merge with; that is told by there being no
    version at all. A version that is missing or cannot be read later on is an
    error, since going on without it would lose the history.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(target)
        fs = root.getFileSystem(conf)
        older = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
        both = batch
        if any(v.startswith("v") and v != f"v{epoch}" for v in older):
            both = spark.read.parquet(f"{target}/v{epoch - 1}").unionByName(batch, allowMissingColumns=True)
        keep_best(both, keys, [F.negative(F.unix_micros(order))]).write.mode("overwrite").parquet(f"{target}/v{epoch}")

    return write
