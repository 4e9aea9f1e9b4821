"""Narrow cuts through what holds up large pits, in place of blanket filling.

Each pass floods the terrain, takes the patches that filling would raise too
far, and follows the water of the flood from a patch's deepest cell over its
sill to ground that is lower. A straight bed is cut along that way unless it
would lie too deep below the terrain as it was before any pass. All ways of a
pass are cut into the surface that the pass began with; where ways meet, the
lowest bed holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillspark.operators import components
from rillspark.operators.fill import TILE, route
from rillspark.sources.shared import counted, discard, written

_WALK = "path long, start double, part long, out boolean, seq long, cell long, z double, keep boolean, ty long, tx long"


def _walked(key: tuple, walkers: pa.Table, cells: pa.Table) -> pa.Table:
    """Cells that walkers pass in one tile, and where they go on: rows with a tile are still to be walked."""
    place = {c: i for i, c in enumerate(cells.column("cell").to_pylist())}
    z, land, keep, part, receiver, rty, rtx = (cells.column(x).to_pylist() for x in ("z", "land", "keep", "part", "receiver", "rty", "rtx"))
    rows = []
    for w in walkers.to_pylist():
        cell, seq, out = w["cell"], w["seq"], w["out"]
        while True:
            i = place[cell]
            rows.append((w["path"], w["start"], w["part"], out, seq, cell, z[i], keep[i], None, None))
            if seq:
                out = out or part[i] != w["part"]
                if keep[i] or (out and (not land[i] or z[i] < w["start"])):
                    break
            if receiver[i] is None:
                break
            cell, seq = receiver[i], seq + 1
            if cell not in place:
                rows.append((w["path"], w["start"], w["part"], out, seq, cell, None, None, rty[i], rtx[i]))
                break
    columns = list(zip(*rows, strict=True)) or [()] * 10
    types = [pa.int64(), pa.float64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.int64(), pa.int64()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["path", "start", "part", "out", "seq", "cell", "z", "keep", "ty", "tx"])


def escape_paths(cells: DataFrame, starts: DataFrame, tile: int = TILE) -> DataFrame:
    """(path, seq, cell, z, keep) of the way from each start to lower ground beyond its part.

    cells: (cell, r, c, z, land, keep, part, receiver); starts: (cell, part).
    A way follows receivers and ends at a kept cell, where nothing receives, or
    once it has left its part at a cell that is no land or lies lower than the
    start. Ways advance tile by tile: a round takes the tiles that some way has
    entered, and rounds follow the tiles that a way crosses.
    """
    at = lambda x: F.floor(F.col(x) / tile)
    to = cells.select(F.col("cell").alias("receiver"), at("r").alias("rty"), at("c").alias("rtx"))
    tiled = written(cells.join(to, "receiver", "left").select("cell", "z", "land", "keep", "part", "receiver", "rty", "rtx", at("r").alias("ty"), at("c").alias("tx")), "tiles")
    first = tiled.select("cell", F.col("z").alias("start"), "ty", "tx").join(starts.select("cell", "part"), "cell")
    walkers = written(first.select(F.col("cell").alias("path"), "start", "part", F.lit(False).alias("out"), F.lit(0).cast("long").alias("seq"), "cell", "ty", "tx"), "starts")
    rounds = []
    while True:
        here = tiled.join(walkers.select("ty", "tx").distinct(), ["ty", "tx"], "left_semi")
        passed, going = counted(walkers.groupBy("ty", "tx").cogroup(here.groupBy("ty", "tx")).applyInArrow(_walked, _WALK), "ways", F.col("ty").isNotNull())
        rounds.append(passed)
        if not going:
            break
        walkers = passed.where("ty is not null").drop("z", "keep")
    found = rounds[0].where("ty is null")
    for x in rounds[1:]:
        found = found.unionByName(x.where("ty is null"))
    ways = written(found.select("path", "seq", "cell", "z", "keep"), "ways")
    discard(tiled, *rounds)
    return ways


def straight_beds(ways: DataFrame, least_drop: float, original: DataFrame, deepest: float | None) -> tuple[DataFrame, DataFrame]:
    """Beds (path, cell, z, bed) of ways that may be cut, and for every way (path, used).

    A bed falls evenly from the first cell to the last, by `least_drop` a step
    at least; a kept cell at the end is left out, and so are ways of one cell.
    """
    last = ways.groupBy("path").agg(F.max("seq").alias("last"))
    own = ways.join(last, "path").where(~(F.col("keep") & (F.col("seq") == F.col("last"))))
    ends = own.groupBy("path").agg(F.max("seq").alias("n"), F.min_by("z", "seq").alias("top"), F.max_by("z", "seq").alias("low")).where("n >= 1")
    end = F.least(F.col("low"), F.col("top") - F.lit(least_drop) * F.col("n"))
    line = F.col("top") + (end - F.col("top")) * F.col("seq") / F.col("n")
    beds = written(own.join(ends, "path").select("path", "cell", "z", F.least(F.col("z"), line).alias("bed")), "beds")
    cut = beds.join(original.select("cell", F.col("z").alias("first_z")), "cell").groupBy("path").agg(F.max(F.col("first_z") - F.col("bed")).alias("cut"))
    judged = written(cut.select("path", (F.lit(True) if deepest is None else F.col("cut") <= deepest).alias("used")), "judged")
    return beds.join(judged.where("used").select("path"), "path", "left_semi"), judged


def breach(
    grid: DataFrame, z: str, land: Column, terminal: Column, cell_area: float, resolution: float, tolerance: float = 10.0, least_area: float = 10.0, least_depth: float = 50.0,
    least_slope: float = 1e-5, keep: Column | None = None, deepest: float | None = 800.0, zone: Column | None = None, passes: int = 2, tile: int = TILE,
) -> tuple[DataFrame, DataFrame]:
    """The flood over breached terrain, and a row of figures for each pass.

    First: what route() gives, with original (the height before) and breached.
    Second: (pass, n_candidates, n_paths, n_skipped, n_cells, deepest).
    Patches count that filling raises by more than `tolerance` (touching ones
    are one) and that cover `least_area` (in units of cell_area) or are raised
    by `least_depth` somewhere. Of equally deep cells of a patch the first is
    its pit. Kept cells are never cut. No pass follows one that cuts nothing.
    """
    if tolerance <= 0 or least_area <= 0 or least_depth <= tolerance or least_slope < 0 or passes <= 0 or (deepest is not None and deepest <= 0):
        raise ValueError("tolerance, least area and passes must be positive, the least depth beyond the tolerance, slope not negative")
    keep = F.lit(False) if keep is None else F.coalesce(keep, F.lit(False))
    own = grid.select("cell", F.coalesce(land, F.lit(False)).alias("land"), keep.alias("keep"))
    state = written(grid.withColumn(z, F.col(z).cast("double")).withColumns({"+land": land, "+leaves": terminal, "+zone": F.lit(0) if zone is None else zone}).select("cell", "r", "c", F.col(z).alias("z"), "+land", "+leaves", "+zone"), "terrain")
    original, figures = state.select("cell", "z"), []
    flood = lambda s: written(route(s, "z", F.col("+land"), F.col("+leaves"), F.col("+zone"), tile).join(own, "cell"), "flooded")
    routed = flood(state)
    for k in range(passes):
        raised = F.col("w") - F.col("z")
        problem = routed.where(F.col("land") & ~F.col("keep") & (raised > tolerance) & (F.col("w") < float("inf")))
        part = written(components.patches(problem.select("cell", "r", "c")).join(problem.select("cell", raised.alias("up")), "cell"), "parts")
        found = part.groupBy("patch").agg(F.count("*").alias("n"), F.max("up").alias("depth"), F.max_by("cell", F.struct("up", -F.col("cell"))).alias("pit"))
        picked, n = counted(found.where((F.col("n") * F.lit(cell_area) >= least_area) | (F.col("depth") >= least_depth)).select(F.col("pit").alias("cell"), F.col("patch").alias("part")), "pits")
        if not n:
            break
        cells = routed.join(part.select("cell", F.col("patch").alias("part")), "cell", "left")
        beds, judged = straight_beds(escape_paths(cells, picked, tile), least_slope * resolution, original, deepest)
        beds = beds.where("bed < z")
        cuts = written(beds.groupBy("cell").agg(F.min("bed").alias("bed"), (F.max(F.col("z")) - F.min("bed")).alias("depth")), "cuts")
        lost = F.col("z") - F.col("bed") > 1e-4
        figures.append(
            judged.agg(F.count_if(~F.col("used")).alias("n_skipped")).crossJoin(beds.where(lost).agg(F.countDistinct("path").alias("n_paths")))
            .crossJoin(cuts.where("depth > 1e-4").agg(F.count("*").alias("n_cells"), F.coalesce(F.max("depth"), F.lit(0.0)).alias("deepest")))
            .select(F.lit(k).alias("pass"), F.lit(n).cast("long").alias("n_candidates"), "n_paths", "n_skipped", "n_cells", "deepest")
        )
        state = written(state.join(cuts.select("cell", "bed"), "cell", "left").withColumn("z", F.least("z", "bed")).drop("bed"), "terrain")
        if cuts.where("depth > 1e-4").isEmpty():
            break
        discard(routed)
        routed = flood(state)
    first = original.select("cell", F.col("z").alias("original"))
    empty = grid.sparkSession.createDataFrame([], "pass int, n_candidates long, n_paths long, n_skipped long, n_cells long, deepest double")
    for f in figures:
        empty = empty.unionByName(f)
    return routed.join(first, "cell").withColumn("breached", F.col("original") - F.col("z") > 1e-4), empty
