"""Exact distance to the nearest masked cell."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _envelope(f: np.ndarray, at: np.ndarray) -> np.ndarray:
    """min over q of (p - at_q)^2 + f_q for each p in at: the lower envelope of parabolas."""
    hull, bounds = [0], [-np.inf]
    for q in range(1, len(f)):
        while True:
            v = hull[-1]
            s = (f[q] + at[q] ** 2 - f[v] - at[v] ** 2) / (2 * (at[q] - at[v]))
            if s > bounds[-1]:
                break
            hull.pop()
            bounds.pop()
        hull.append(q)
        bounds.append(s)
    return np.array(hull), np.array(bounds)


def nearest(grid: DataFrame, mask: str) -> DataFrame:
    """(cell, nearest, distance): the nearest cell where `mask` holds, of equally near ones the first by row and column, and
    the Euclidean distance in cells; null if there is none.

    Along rows a window finds the nearest masked cell on either side; along
    columns the squares of those distances are parabolas, whose lower envelope
    a column's task finds. A column is as long as the grid is high.
    """
    ahead = Window.partitionBy("r").orderBy("c")
    back = Window.partitionBy("r").orderBy(F.desc("c"))
    here = F.when(F.col(mask), F.struct("c", "cell"))
    left, right = F.last(here, ignorenulls=True).over(ahead), F.last(here, ignorenulls=True).over(back)
    sides = grid.select("cell", "r", "c", left.alias("left"), right.alias("right"))
    to_left, to_right = F.col("c") - F.col("left.c"), F.col("right.c") - F.col("c")
    is_left = F.coalesce(to_left <= F.coalesce(to_right, to_left), F.lit(False))
    near = sides.select("cell", "r", "c", F.least(to_left, to_right).cast("double").alias("g"), F.when(is_left, F.col("left.cell")).otherwise(F.col("right.cell")).alias("of"))

    def column(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("r")
        r, g = group.column("r").to_numpy().astype(float), group.column("g").to_numpy(zero_copy_only=False).astype(float)
        some = np.flatnonzero(~np.isnan(g))
        out, of = np.full(len(r), np.nan), pa.nulls(len(r), pa.int64())
        if len(some):
            hull, bounds = _envelope(g[some] ** 2, r[some])
            best = some[hull[np.searchsorted(bounds, r, side="left") - 1]]
            out, of = np.sqrt((r - r[best]) ** 2 + g[best] ** 2), group.column("of").take(pa.array(best))
        return pa.table({"cell": group.column("cell"), "nearest": of, "distance": pa.array(out, from_pandas=True)})

    return near.groupBy("c").applyInArrow(column, "cell long, nearest long, distance double")


def distances(grid: DataFrame, mask: str) -> DataFrame:
    """(cell, distance): Euclidean distance in cells to the nearest cell where `mask` holds; null if there is none."""
    return nearest(grid, mask).select("cell", "distance")
