"""Incremental ingest with Structured Streaming: an extension beside the batch pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..constants import TRIPLE_COLS, TRIPLES
from ..operators.store import conform
from ..sources.files import read_chunks


def triple_stream(spark: SparkSession, path: str, *, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of triples as they arrive."""
    return spark.readStream.schema(TRIPLES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


#: Parts of a store, by hash of the law; a batch is compared with those parts only that its laws fall into.
PARTS = 256


def _part(law_id: str = "law_id") -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col(law_id), F.lit(""))), F.lit(PARTS)).cast("int")


def append_new(store_path: str) -> Callable[[DataFrame, int], None]:
    """A batch sink that appends the rows a store does not hold yet, NULLs compared as equal; repeated batches add nothing.

    The store is partitioned by a hash of law_id; only the parts of the batch's laws (at most PARTS
    numbers, read to the driver) are scanned.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = conform(batch).dropDuplicates(TRIPLE_COLS).withColumn("part", _part())
        held = read_chunks(spark, store_path)
        if held is not None:
            held = held.where(F.col("part").isin([r[0] for r in new.select("part").distinct().collect()]))
            on = F.col("n.part") == F.col("h.part")
            for c in TRIPLE_COLS:
                same = F.col(f"n.{c}").eqNullSafe(F.col(f"h.{c}"))
                on = on & same
            new = new.alias("n").join(held.alias("h"), on, "left_anti")
        new.write.mode("append").partitionBy("part").parquet(store_path)

    return write


def ingest(stream: DataFrame, store_path: str, checkpoint: str) -> StreamingQuery:
    """Runs a triple stream into a store until it has caught up."""
    return stream.writeStream.foreachBatch(append_new(store_path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_arrivals(stream: DataFrame, event_time: str, loaded: str, *, watermark: str = "30 days", window: str = "1 day") -> DataFrame:
    """Statements per window of their extraction and the mean hours until they were loaded; later ones than the watermark are left to a batch correction."""
    late = (F.col(loaded).cast("timestamp").cast("double") - F.col(event_time).cast("timestamp").cast("double")) / 3600
    return stream.withWatermark(event_time, watermark).groupBy(F.window(event_time, window)).agg(F.count("*").alias("n"), F.avg(late).alias("mean_hours_late"))
