"""What the text and vector operators share: written tables (cut), batching, samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillspark.sources.shared import discard
from rillspark.sources.shared import written as cut

__all__ = ["cut", "discard", "labelled_sample", "labelled_texts", "only", "pieces", "slices", "table", "texts_of"]
#: Whole texts handled together inside a task, in characters: bounds a Python worker's memory.
SLICE_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(texts: list[str], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `most` characters each (one text at least)."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def pieces(batch: pa.RecordBatch, at: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in turn, about `most` bytes of the texts in column `at` together (one row at least)."""
    before = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy()) // most
    edges = [0, *(np.flatnonzero(np.diff(before)) + 1).tolist(), batch.num_rows]
    for x, y in zip(edges, edges[1:], strict=False):
        if x < y:
            yield batch.slice(x, y - x)


def texts_of(column: pa.Array) -> list[str]:
    """The texts, null as empty."""
    return ["" if t is None else t for t in column.to_pylist()]


def only(docs: DataFrame, id_col: str, text_col: str, whole: bool = False) -> DataFrame:
    """The two columns that an operator reads, and with `whole` each row as it came, in a struct `row`.

    All other columns, of any name, play no part.
    """
    row = [F.struct("*").alias("row")] if whole else []
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *row)


def labelled_sample(labels: DataFrame, label_col: str, limit: int, where: str = "true") -> DataFrame:
    """(doc_id, label) of at most `limit` labelled documents: those whose hashed id is smallest.

    Rows with a null id or label take no part. Where rows repeat, the largest
    label holds, so the sample is the same whatever the order of the rows.
    """
    return (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .where("doc_id is not null and label is not null").where(where)
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )


def labelled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """sample (doc_id, label, ...) with a text: the document's, and where rows share an id that of the smallest hash.

    So there are never more rows than the sample has, however often ids repeat.
    """
    text = F.coalesce("text", F.lit(""))
    one = docs.select("doc_id", text.alias("text")).join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return one.join(F.broadcast(sample), "doc_id")
