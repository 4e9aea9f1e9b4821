"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only where that is unset and driver and executors are one machine, as in tests, a temporary folder."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="rillspark-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """df written once to shared storage and read from there: lineage ends here, whatever executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/rillspark/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.written_path = path
    return found


def counted(df: DataFrame, what: str, of: Column | None = None) -> tuple[DataFrame, int]:
    """df as `written` gives it, and how many of its rows (or of those where `of` holds) the write saw."""
    seen = Observation()
    found = written(df.observe(seen, F.count_if(F.lit(True) if of is None else of).alias("rows")), what)
    return found, seen.get["rows"]


def discard(*tables: DataFrame) -> None:
    """Deletes what `written` made, once all that was derived from it is written in its turn."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
