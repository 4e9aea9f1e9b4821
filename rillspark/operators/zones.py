"""Zones in which every part of the land has somewhere to drain to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillspark.operators import components, flow
from rillspark.operators.fill import edge_cells
from rillspark.sources.shared import counted, discard, written

#: Rounds of repair before it counts as failed (fixed value).
ROUNDS = 8


def _reassigned(parts: DataFrame, touching: DataFrame, inner: DataFrame) -> DataFrame:
    """parts (part, zone) after the inner ones have taken, in order of part, the zone of most land cells around them.

    touching: (part, other, n): how many cells of `other` lie beside `part`.
    Parts that don't touch don't see each other, so a wave takes all that come
    before every inner part beside them that is still waiting.
    """
    now, left, n = parts, *counted(inner, "waiting")
    while n:
        beside = touching.join(left.select(F.col("part").alias("other")), "other", "left_semi").join(left, "part", "left_semi")
        held = beside.where("other < part").select("part").distinct()
        ready = written(left.join(held, "part", "left_anti"), "ready")
        votes = touching.join(ready, "part", "left_semi").join(now.select(F.col("part").alias("other"), F.col("zone").alias("of")), "other").join(now, "part").where(F.col("of") != F.col("zone"))
        won = votes.groupBy("part", "of").agg(F.sum("n").alias("n")).groupBy("part").agg(F.max_by("of", F.struct("n", -F.col("of"))).alias("to"))
        now = written(now.join(won, "part", "left").select("part", F.coalesce("to", "zone").alias("zone")), "zones")
        left, n = counted(left.join(ready, "part", "left_anti"), "waiting")
    return now


def with_terminals(grid: DataFrame, z: str, land: Column, zone: Column, terminal: Column) -> tuple[DataFrame, dict]:
    """(cell, zone, terminal) of land cells such that every eight-connected part of one zone holds a terminal, and figures.

    A part without one gets the lowest of its cells on the coast or the edge of
    the grid (of equally low ones the first). One that has no such cell takes the
    zone of most land cells around it, of equally common ones the smallest; such
    parts take their turn in order of their first cells. New zones join parts,
    so this is repeated; a RuntimeError follows if ROUNDS are not enough.
    """
    cells = edge_cells(grid.select("cell", "r", "c", F.col(z).alias("z"), F.coalesce(land, F.lit(False)).alias("land"), zone.cast("long").alias("zone"), F.coalesce(terminal, F.lit(False)).alias("terminal")))
    cells = written(cells, "zoned-cells")
    shore = flow.neighbours(cells.where("not land")).select("r", "c").distinct().withColumn("shore", F.lit(True))
    own = cells.where("land").join(shore, ["r", "c"], "left").select("cell", "r", "c", "z", "zone", "terminal", (F.coalesce("shore", F.lit(False)) | F.col("edge")).alias("coast"), "edge")
    state, figures = written(own, "zoned-land"), {"added_coastal_terminals": 0, "added_boundary_terminals": 0, "reassigned_parts": 0}
    for _ in range(ROUNDS):
        labels = written(components.patches(state.select("cell", "r", "c", "zone"), same="zone").withColumnRenamed("patch", "part").join(state, "cell"), "parts")
        lowest = F.min_by(F.struct("cell", "edge"), F.when(F.col("coast"), F.struct("z", "cell")))
        found = labels.groupBy("part").agg(F.max("terminal").alias("drains"), F.max("coast").alias("coastal"), F.min("zone").alias("zone"), lowest.alias("lowest"))
        missing, n = counted(found.where("not drains"), "missing")
        if not n:
            figures["parts"] = found.count()
            return state.select("cell", "zone", "terminal"), figures
        added = missing.where("coastal").select("lowest.cell", "lowest.edge")
        row = added.agg(F.count("*"), F.count_if("edge")).first()
        figures["added_coastal_terminals"] += row[0]
        figures["added_boundary_terminals"] += row[1]
        inner, n_inner = counted(missing.where("not coastal").select("part"), "inner")
        zones = found.select("part", "zone")
        if n_inner:
            around = flow.neighbours(labels.join(inner, "part", "left_semi"), "part").select("r", "c", "part").distinct()
            met = around.join(labels.select("r", "c", F.col("part").alias("other")), ["r", "c"]).where("other <> part")
            touching = written(met.groupBy("part", "other").agg(F.count("*").alias("n")), "touching")
            zones = _reassigned(written(zones, "zones"), touching, inner)
            figures["reassigned_parts"] += zones.join(found.select("part", F.col("zone").alias("was")), "part").where(F.col("zone") != F.col("was")).count()
        new = labels.drop("zone").join(zones, "part").join(added.select("cell", F.lit(True).alias("added")), "cell", "left")
        last, state = state, written(new.select("cell", "r", "c", "z", "zone", (F.col("terminal") | F.coalesce("added", F.lit(False))).alias("terminal"), "coast", "edge"), "zoned-land")
        discard(last, labels)
    raise RuntimeError("zones still have parts without a terminal")


