"""Resumable tile sinks: a tile that is done is never computed again.

An extension of the batch sink to streams: new cells arrive in files, each
micro-batch writes the tiles it completes under its own id, and a batch that
runs again after a failure overwrites its own folder, so tiles come out once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remaining(cells: DataFrame, done: DataFrame) -> DataFrame:
    """Cells of tiles that the done-table lacks."""
    return cells.join(done.select("ty", "tx").distinct(), ["ty", "tx"], "left_anti")


def summarise(cells: DataFrame) -> DataFrame:
    return cells.groupBy("ty", "tx").agg(F.count("*").alias("n"), F.round(F.avg("z"), 6).alias("mean"), F.min("z").alias("low"), F.max("z").alias("high"))


def append_tiles(cells: DataFrame, path: str, most: int | None = None) -> None:
    """Summaries of tiles that path does not hold yet, at most `most` of them in order of their keys."""
    spark = cells.sparkSession
    if spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
        cells = remaining(cells, spark.read.parquet(path))
    if most is not None:
        cells = cells.join(cells.select("ty", "tx").distinct().orderBy("ty", "tx").limit(most), ["ty", "tx"], "left_semi")
    summarise(cells).write.mode("append").parquet(path)


def stream_tiles(cells: DataFrame, path: str, checkpoint: str):
    """Starts a stream over (ty, tx, z) that sums up each batch's tiles under path/batch=<id>, once however often it is retried."""

    def write(batch: DataFrame, number: int) -> None:
        summarise(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return cells.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
