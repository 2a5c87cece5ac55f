"""Continuous collection: raw records as a stream of files, kept once per (source, native_id).

Times without zone or in several notations are normalised in each
batch, where the candidate sets of that batch fit the mixture of formats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_items(spark: SparkSession, folder: str, schema, files_per_batch: int = 50) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def hourly_counts(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Records by source and hour of capture, closed after the watermark."""
    timed = stream.withColumn("captured_ts", F.try_to_timestamp("captured_at")).withWatermark("captured_ts", late)
    return timed.groupBy(F.window("captured_ts", "1 hour"), "source").agg(F.count("*").alias("n"))


def collect_stream(stream: DataFrame, target: str, checkpoint: str, process=None) -> StreamingQuery:
    """Write new records in batches; ``process`` (a batch function) is applied to each before it is written.

    The keys of each batch are kept beside the checkpoint and compared exactly, so no record is too late.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        new, keys = batch.dropDuplicates(["source", "native_id"]), f"{checkpoint}/keys"
        if earlier := [f"{keys}/{i}" for i in range(batch_id)]:
            seen = batch.sparkSession.read.parquet(*earlier).select(F.col("source").alias("s"), F.col("native_id").alias("n"))
            new = new.join(seen, F.col("source").eqNullSafe(F.col("s")) & F.col("native_id").eqNullSafe(F.col("n")), "left_anti")
        new = new.persist()
        new.select("source", "native_id").write.mode("overwrite").parquet(f"{keys}/{batch_id}")
        out = process(new) if process else new
        out.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")  # a repeated batch replaces itself
        new.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
