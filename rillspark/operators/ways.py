"""Cheapest ways through corridors, by tiles.

A way has a corridor of its own: the cells that it may pass, each with a toll.
Entering a cell costs the step, the toll and a part of the climb; where turns
cost too, what is searched are cells with the direction by which they were
entered. A round searches the tiles of ways that were entered more cheaply than
before, one task for each way and tile, and writes those alone; rounds follow
the tiles that ways cross.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillspark.operators.fill import GATHER, TILE, current, tiles_touched
from rillspark.operators.flow import D8
from rillspark.sources.shared import counted, discard, written

#: Steps by direction, and the direction of a start, which nothing was entered by.
STEPS = [(dr, dc, math.hypot(dr, dc)) for _, dr, dc in D8]
START = len(STEPS)
_KEY = ["path", "ty", "tx"]
_LABELS = "path long, ty long, tx long, r long, c long, z double, dir long, cost double, via long, changed boolean"
_WALK = "path long, back long, r long, c long, dir long, ty long, tx long"


def _searching(uphill: float, turn: float):
    """A function that searches the tile of a way from what is known of it and what enters it.

    A label is a cell, with turns also the direction of entry, and holds its
    least cost and the smallest direction that gives it: of entry, or with turns
    of the entry before.
    """
    of = START + 1 if turn else 1

    def search(key: tuple, group: pa.Table) -> pa.Table:
        rows = group.sort_by([("kind", "ascending"), ("r", "ascending"), ("c", "ascending")])
        kind, r, c = (rows.column(x).to_numpy() for x in ("kind", "r", "c"))
        n = int((kind == 0).sum())
        at = {(i, j): k for k, (i, j) in enumerate(zip(r[:n].tolist(), c[:n].tolist(), strict=True))}
        around = [[at.get((i + dr, j + dc), -1) for dr, dc, _ in STEPS] for i, j in at]
        z, toll, entry, cost, via = (rows.column(x).to_pylist() for x in ("z", "toll", "dir", "cost", "via"))
        best = [(math.inf, START)] * (n * of)
        heap = []

        def reach(k: int, d: int, paid: float, by: int, height: float) -> None:
            to = paid + (STEPS[d][2] + toll[k] + uphill * max(0.0, z[k] - height))
            if turn and by not in (START, d):
                to += turn
            s, label = (k * of + d, (to, by)) if turn else (k, (to, d))
            if label < best[s]:
                best[s] = label
                heapq.heappush(heap, (to, s))

        for q in np.flatnonzero(kind == 1).tolist():
            best[at[r[q], c[q]] * of + (entry[q] if turn else 0)] = (cost[q], via[q])
        before = [x for x, _ in best]
        for q in np.flatnonzero(kind == 2).tolist():
            if z[q] is None:  # the way starts here
                s = at[r[q], c[q]] * of + (START if turn else 0)
                best[s] = (0.0, START)
                heapq.heappush(heap, (0.0, s))
            else:
                for d, (dr, dc, _) in enumerate(STEPS):
                    k = at.get((r[q] + dr, c[q] + dc), -1)
                    if k >= 0:
                        reach(k, d, cost[q], entry[q], z[q])
        while heap:
            x, s = heapq.heappop(heap)
            if x > best[s][0]:
                continue
            k, by = divmod(s, of)
            for d, to in enumerate(around[k]):
                if to >= 0:
                    reach(to, d, x, by, z[k])
        found = [s for s, (x, _) in enumerate(best) if x < math.inf]
        k = np.array(found, dtype=np.int64) // of
        columns = [np.full(len(found), v.as_py()) for v in key]
        columns += [r[k], c[k], np.array(z[:n], dtype=float)[k], np.array(found, dtype=np.int64) % of, [best[s][0] for s in found], [best[s][1] for s in found], [best[s][0] != before[s] for s in found]]
        types = [pa.int64()] * 5 + [pa.float64(), pa.int64(), pa.float64(), pa.int64(), pa.bool_()]
        return pa.table([pa.array(v, t) for v, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in _LABELS.split(", ")])

    return search


def _retracing(turn: float, tile: int):
    """A function that walks back through the labels of one way in one tile; rows with a tile are still to be walked."""

    def retrace(key: tuple, walkers: pa.Table, labels: pa.Table) -> pa.Table:
        via = {(x["r"], x["c"], x["dir"] if turn else 0): x["via"] for x in labels.select(["r", "c", "dir", "via"]).to_pylist()}
        w = walkers.to_pylist()[0]
        path, back, r, c, entry = w["path"], w["back"], w["r"], w["c"], w["dir"]
        rows = []
        while True:
            if (r, c, entry if turn else 0) not in via:
                rows.append((path, back, r, c, entry, r // tile, c // tile))
                break
            rows.append((path, back, r, c, entry, None, None))
            by = via[r, c, entry if turn else 0]
            d = entry if turn else by
            if d == START:
                break
            r, c, entry, back = r - STEPS[d][0], c - STEPS[d][1], by, back + 1
        return pa.table([pa.array(v, pa.int64()) for v in zip(*rows, strict=True)], names=[x.split()[0] for x in _WALK.split(", ")])

    return retrace


def straight(ends: DataFrame) -> DataFrame:
    """(path, seq, r, c) of D8 ways from (r0, c0) to (r1, c1), diagonal first."""
    dr, dc = F.col("r1") - F.col("r0"), F.col("c1") - F.col("c0")
    steps = ends.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.abs(dr), F.abs(dc)))).alias("seq"))
    walk = lambda start, d: (F.col(start) + F.signum(d.cast("double")) * F.least(F.col("seq"), F.abs(d))).cast("long")
    return steps.select("path", "seq", walk("r0", dr).alias("r"), walk("c0", dc).alias("c"))


def segment_corridors(ends: DataFrame, reach: int) -> DataFrame:
    """(path, r, c, d2) of places within `reach` of the segment from (r0, c0) to (r1, c1), with their squared distance to it.

    Rows of a corridor give the columns that it may have there, so places grow
    with the length of a segment times `reach`, not with the box around it.
    """
    r0, c0, r1, c1 = (F.col(x) for x in ("r0", "c0", "r1", "c1"))
    dr, dc, r, c = r1 - r0, c1 - c0, F.col("r"), F.col("c")
    rows = ends.select("*", F.explode(F.sequence(F.least(r0, r1) - reach, F.greatest(r0, r1) + reach)).alias("r"))
    share = lambda y: F.when(dr == 0, F.lit(None)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (y - r0) / dr)))
    a, b = (c0 + F.coalesce(share(y), F.lit(t)) * dc for y, t in ((r - reach, 0.0), (r + reach, 1.0)))
    places = rows.select("*", F.explode(F.sequence(F.floor(F.least(a, b)) - reach, F.ceil(F.greatest(a, b)) + reach)).alias("c"))
    whole = dr * dr + dc * dc
    t = F.when(whole == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((r - r0) * dr + (c - c0) * dc) / F.greatest(whole, F.lit(1)))))
    off = lambda x, x0, dx: (x - (x0 + t * dx)) * (x - (x0 + t * dx))
    return places.select("path", "r", "c", (off(r, r0, dr) + off(c, c0, dc)).alias("d2")).where(F.col("d2") <= reach * reach)


def guide_corridors(guides: DataFrame, reach: int) -> DataFrame:
    """(path, r, c, d2) of places within `reach` of a cell of a guide (path, r, c), with the least squared distance."""
    disc = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(float(i * i + j * j)).alias("d2")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if i * i + j * j <= reach * reach))
    near = guides.select("path", "r", "c").distinct().select("path", "r", "c", F.explode(disc).alias("s"))
    return near.groupBy("path", (F.col("r") + F.col("s.i")).alias("r"), (F.col("c") + F.col("s.j")).alias("c")).agg(F.min("s.d2").alias("d2"))


def tolled(corridors: DataFrame, grid: DataFrame, z: str, lowland: Column, deviation: float, elevation: float) -> DataFrame:
    """(path, r, c, z, toll) of cells of corridors: tolls grow with d2, and with `lowland` above its least value in the corridor."""
    own = grid.select("r", "c", F.col(z).cast("double").alias("z"), lowland.cast("double").alias("low"))
    cells = corridors.join(own.where("z is not null and not isnan(z) and low is not null"), ["r", "c"])
    least = cells.groupBy("path").agg(F.min("low").alias("least"))
    return cells.join(least, "path").select("path", "r", "c", "z", (deviation * F.col("d2") + elevation * (F.col("low") - F.col("least"))).alias("toll"))


def cheapest(cells: DataFrame, ends: DataFrame, uphill: float = 0.0, turn: float = 0.0, tile: int = TILE) -> DataFrame:
    """(path, seq, r, c, cost, fallback): each way's cells in order, and what the way costs in all.

    cells: (path, r, c, z, toll) of corridors; ends: (path, r0, c0, r1, c1).
    A step costs its length in cells, the toll of the cell that it enters,
    `uphill` for each unit that it climbs, and `turn` where its direction is not
    that of the step before. Of equally cheap ways that holds whose last step,
    and then each one before, has the smallest direction. Where an end lies
    outside the corridor or can't be reached, the way is straight, its cost null
    and fallback true; a way from a cell to itself is that cell and costs
    nothing. Rows of ends with a null are left out, and of rows that share a
    path the smallest counts; cells without a height or toll take no part, and
    of rows that share a place the smallest counts.
    """
    if not (uphill >= 0 and turn >= 0):
        raise ValueError("what climbs and turns cost must not be negative")
    ends = written(ends.dropna(subset=["path", "r0", "c0", "r1", "c1"]).groupBy(F.col("path").cast("long").alias("path")).agg(F.min(F.struct(*(F.col(x).cast("long").alias(x) for x in ("r0", "c0", "r1", "c1")))).alias("e")).select("path", "e.*"), "ends")
    place = lambda r, c: (F.floor(F.col(r) / tile).alias("ty"), F.floor(F.col(c) / tile).alias("tx"))
    asked = ends.where("r0 <> r1 or c0 <> c1")
    own = cells.where("z is not null and toll is not null and not isnan(z) and not isnan(toll)").groupBy("path", "r", "c").agg(F.min(F.struct("z", "toll")).alias("v"))
    tiled, below = counted(own.join(asked.select("path"), "path", "left_semi").select("path", *place("r", "c"), "r", "c", "v.*"), "corridors", F.col("toll") < 0)
    if below:
        raise ValueError("tolls must not be negative")
    there = written(tiled.select(*_KEY).distinct(), "tiles")
    blank = {"z": "double", "toll": "double", "dir": "long", "cost": "double", "via": "long"}
    shaped = lambda df, kind: df.select(*_KEY, F.lit(kind).alias("kind"), F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), *(F.col(x).cast(t).alias(x) if x in df.columns else F.lit(None).cast(t).alias(x) for x, t in blank.items()))
    first = asked.select("path", F.col("r0").alias("r"), F.col("c0").alias("c"), *place("r0", "c0")).join(tiled.select("path", "r", "c"), ["path", "r", "c"], "left_semi")
    inbox, waiting = counted(first, "entries")
    tables, search, k = [], _searching(uphill, turn), 0
    while waiting:
        k += 1
        active = inbox.select(*_KEY).distinct()
        sent = shaped(tiled.join(active, _KEY, "left_semi"), 0).unionByName(shaped(inbox, 2))
        if tables:
            sent = sent.unionByName(shaped(current(tables, "path").join(active, _KEY, "left_semi"), 1))
        new = written(sent.groupBy(*_KEY).applyInArrow(search, _LABELS).withColumn("round", F.lit(k)), "labels")
        tables.append(new)
        entry = F.col("dir") if turn else F.col("via")
        beside = new.where("changed").select("path", "ty", "tx", "r", "c", "z", entry.alias("dir"), "cost", F.explode(tiles_touched(tile)).alias("to")).where("not to.own")
        last = inbox
        inbox, waiting = counted(beside.select("path", "to.ty", "to.tx", "r", "c", "z", "dir", "cost").join(there, _KEY, "left_semi"), "entries")
        discard(last)
        if len(tables) > GATHER:
            whole = written(current(tables, "path"), "labels")
            discard(*tables)
            tables = [whole]
    plain = straight(ends)
    if not tables:
        return plain.join(ends.select("path", ((F.col("r0") != F.col("r1")) | (F.col("c0") != F.col("c1"))).alias("fallback")), "path").select("path", "seq", "r", "c", F.when(~F.col("fallback"), F.lit(0.0)).alias("cost"), "fallback")
    labels = current(tables, "path")
    goals = asked.select("path", F.col("r1").alias("r"), F.col("c1").alias("c"), *place("r1", "c1"))
    least = labels.join(goals, [*_KEY, "r", "c"], "left_semi").groupBy("path", "ty", "tx", "r", "c").agg(F.min(F.struct("cost", "dir")).alias("least"))
    reached = written(least.select(*_KEY, "r", "c", "least.*"), "reached")
    walkers, rounds = reached.select("path", F.lit(0).cast("long").alias("back"), "r", "c", "dir", "ty", "tx"), []
    while True:
        here = labels.join(walkers.select(*_KEY), _KEY, "left_semi")
        walked, going = counted(walkers.groupBy(*_KEY).cogroup(here.groupBy(*_KEY)).applyInArrow(_retracing(turn, tile), _WALK), "walks", F.col("ty").isNotNull())
        rounds.append(walked)
        if not going:
            break
        walkers = walked.where("ty is not null")
    passed = rounds[0].where("ty is null")
    for x in rounds[1:]:
        passed = passed.unionByName(x.where("ty is null"))
    length = passed.groupBy("path").agg(F.max("back").alias("n"))
    found = passed.join(length, "path").join(reached.select("path", "cost"), "path").select("path", (F.col("n") - F.col("back")).alias("seq"), "r", "c", "cost", F.lit(False).alias("fallback"))
    other = plain.join(reached.select("path"), "path", "left_anti").join(ends.select("path", ((F.col("r0") != F.col("r1")) | (F.col("c0") != F.col("c1"))).alias("fallback")), "path")
    ways = written(found.unionByName(other.select("path", "seq", "r", "c", F.when(~F.col("fallback"), F.lit(0.0)).alias("cost"), "fallback")), "ways")
    discard(tiled, there, inbox, reached, *tables, *rounds)
    return ways
