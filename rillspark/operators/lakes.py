"""Level surfaces of lakes, completed within a lake and carried on to finer cells along its shore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillspark.operators import components, distance
from rillspark.operators.statistics import quantiles
from rillspark.sources.shared import counted, written

#: Halves of the four nearest neighbours.
NEAREST_FOUR = ((0, 1), (1, 0))


def _finite(x: Column) -> Column:
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def completed_surfaces(grid: DataFrame, lake: Column, surface: Column, terrain: Column | None = None) -> DataFrame:
    """(cell, r, c, patch, level, supplied) of lake cells: every lake of cells that touch by sides has one level.

    It is the median of the surfaces that are known in it, else (supplied is
    false) that of the terrain; null, NaN and infinite values aren't known. A
    lake with neither raises a ValueError. patch is the lake's smallest cell.
    A null `lake` is no lake.
    """
    own = written(grid.where(F.coalesce(lake, F.lit(False))).select("cell", "r", "c", _finite(surface).alias("surface"), (F.lit(None).cast("double") if terrain is None else _finite(terrain)).alias("terrain")), "lake-cells")
    cells = written(own.join(components.patches(own.select("cell", "r", "c"), NEAREST_FOUR), "cell"), "lakes")
    both = {name: quantiles(cells, ["patch"], name, {f"of_{name}": 0.5}, None) for name in ("surface", "terrain")}
    levels, unknown = counted(
        both["surface"].join(both["terrain"], "patch").select("patch", F.coalesce("of_surface", "of_terrain").alias("level"), F.col("of_surface").isNotNull().alias("supplied")), "levels", F.col("level").isNull()
    )
    if unknown:
        raise ValueError(f"{unknown} lakes have neither a surface nor terrain")
    return cells.join(levels, "patch").select("cell", "r", "c", "patch", "level", "supplied")


def refined_surfaces(grid: DataFrame, surfaces: DataFrame, fine: DataFrame, k: int, within: float | None = None) -> DataFrame:
    """fine with patch and level: those of the lake cell nearest to the coarse cell that holds a fine one.

    grid: all coarse cells; surfaces: what completed_surfaces() gives; fine:
    (r, c, ...) of fine lake cells, k to a coarse cell's side. Fine shores may
    lie in coarse cells that are no lake, so levels are carried on, no farther
    than `within` coarse cells where that is given; beyond, and without any
    lake, they are null. Of equally near cells the first by row and column gives
    the level.
    """
    if k < 1 or (within is not None and within < 0):
        raise ValueError("k must be positive and the distance not negative")
    wet = grid.select("cell", "r", "c").join(surfaces.select("cell", F.lit(True).alias("wet")), "cell", "left").withColumn("wet", F.coalesce("wet", F.lit(False)))
    near = distance.nearest(wet, "wet")
    if within is not None:
        near = near.where(F.col("distance") <= within)
    carried = near.join(surfaces.select(F.col("cell").alias("nearest"), "patch", "level"), "nearest").join(grid.select("cell", F.col("r").alias("of_r"), F.col("c").alias("of_c")), "cell")
    placed = fine.withColumns({"of_r": F.floor(F.col("r") / k), "of_c": F.floor(F.col("c") / k)})
    return placed.join(carried.select("of_r", "of_c", "patch", "level"), ["of_r", "of_c"], "left").drop("of_r", "of_c")
