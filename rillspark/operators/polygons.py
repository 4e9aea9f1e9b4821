"""Polygons on a grid of cells: which cell centres lie inside, and areas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def edges(rings: DataFrame) -> DataFrame:
    """(poly, seq, x, y, x1, y1): each corner of rings (poly, seq, x, y) with the next; seq counts from 0 without gaps, the last meets the first."""
    n = rings.groupBy("poly").agg(F.count("*").alias("n"))
    following = rings.select("poly", F.col("seq").alias("to"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    return rings.join(n, "poly").withColumn("to", F.when(F.col("seq") + 1 < F.col("n"), F.col("seq") + 1).otherwise(0)).join(following, ["poly", "to"]).select("poly", "seq", "x", "y", "x1", "y1")


def areas(rings: DataFrame) -> DataFrame:
    """(poly, area) by the shoelace formula; positive where corners run from x to y."""
    return edges(rings).groupBy("poly").agg((F.sum(F.col("x") * F.col("y1") - F.col("x1") * F.col("y")) / 2).alias("area"))


def spans(rings: DataFrame) -> DataFrame:
    """(poly, r, c0, c1): runs of cells c0 to c1 - 1 of row r whose centres lie inside by the even-odd rule.

    An edge meets the rows whose centre line lies between its ends, the lower
    one included; crossings of a row, in order, open and close runs in turn. A
    centre on an edge counts as right of it. Nothing holds more than the
    crossings of one polygon with one row.
    """
    low, high = F.least("y", "y1"), F.greatest("y", "y1")
    first, last = F.ceil(low - 0.5), F.ceil(high - 0.5) - 1
    met = edges(rings).where(first <= last).withColumn("r", F.explode(F.sequence(first, last)))
    x = F.col("x") + (F.col("r") + 0.5 - F.col("y")) * (F.col("x1") - F.col("x")) / (F.col("y1") - F.col("y"))
    row = Window.partitionBy("poly", "r").orderBy("c0", "seq")
    crossed = met.select("poly", "r", "seq", F.ceil(x - 0.5).alias("c0"))
    paired = crossed.select("poly", "r", "c0", F.lead("c0").over(row).alias("c1"), F.row_number().over(row).alias("k"))
    return paired.where("k % 2 = 1 and c1 > c0").select("poly", "r", "c0", "c1")


def cells(rings: DataFrame, rows: int, columns: int) -> DataFrame:
    """(poly, r, c) of the cells of a grid whose centres lie inside."""
    run = F.sequence(F.greatest("c0", F.lit(0)), F.least("c1", F.lit(columns)) - 1)
    inside = spans(rings).where((F.col("r") >= 0) & (F.col("r") < rows) & (F.col("c1") > 0) & (F.col("c0") < columns))
    return inside.select("poly", "r", F.explode(run).alias("c"))
