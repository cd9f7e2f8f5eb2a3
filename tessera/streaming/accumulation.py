"""Accumulation of new acquisitions as they arrive.

Sums by block are algebraic, so a stream of samples keeps one running row for each date and block: the powers of a
date need no other date, and pairs are formed with all dates so far. The samples of a date may come in any number of
batches: each keeps its own part, which a batch that is run twice writes again, so nothing is lost or counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.blocks import accumulate_new, block_power

SAMPLES = "freq string, row int, col int, re double, im double, d string, batch long"


def accumulate_stream(samples: DataFrame, store: str, fy: int, fx: int, checkpoint: str) -> StreamingQuery:
    """Writes the samples (freq, d, row, col, re, im) of a stream to store/samples, by date and batch, the power of their
    dates to store/power, and the pairs of these dates with all dates to store/pairs.

    A batch reads the samples of its own dates and joins them to the stored samples of all dates, once; pairs of dates
    that it doesn't add to are neither formed nor written. Power is kept by date, so that of other dates is read as it
    stands. All three tables are replaced by partition (date and batch, date, pair), so a batch that runs again, or goes on after a failure at any
    point, leaves the same files.
    """

    def on_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        write = lambda df, name, *keys: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{store}/{name}")
        batch.persist()
        try:
            dates = [r["d"] for r in batch.select("d").distinct().collect()]  # the dates of one batch
            if not dates:
                return
            write(batch.select("freq", "row", "col", "re", "im", "d").withColumn("batch", F.lit(number).cast("long")), "samples", "d", "batch")
        finally:
            batch.unpersist()
        every = spark.read.schema(SAMPLES).parquet(f"{store}/samples").drop("batch")
        new = every.where(F.col("d").isin(dates))
        write(block_power(new, fy, fx).select("freq", "row", "col", "p", "ok", "d"), "power", "d")
        power = spark.read.schema("freq string, row int, col int, p double, ok long, d string").parquet(f"{store}/power")
        write(accumulate_new(new, every, power, fy, fx), "pairs", "d1", "d2")

    return samples.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
