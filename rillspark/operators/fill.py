"""Depression filling and routing over filled terrain, by tiles.

A cell's level is the least, over all ways to a terminal, of the greatest
height on the way; its steps are how many cells of that level lie before one
that is lower (0 where its own height sets the level). Water goes to the
neighbour of the smallest (level, steps, cell), which is the first that a flood
from the terminals reaches in that order, so filled flats drain too.

Levels take as many rounds as there are sizes of groups, whatever the terrain:
a tile is cut down to its border cells and the fewest links over which ways
between them cost the same; groups of tiles are joined from these, and again cut
down to the border of the group, until one group holds the grid. Then the levels
of borders are handed down again, and tiles settle their cells once. A task
holds the borders of a group's parts, which grow with its side.

Steps, and a watershed by image foresting, which is a flood with another cost of
ways, settle tile by tile from the cells around. A round runs the tiles beside
which something changed and writes those alone; rounds follow the tiles that a
lake, or a way, crosses. A task holds a tile's cells and one ring around them.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillspark.operators.flow import neighbours, outlets
from rillspark.sources.shared import counted, discard, written

TILE = 64
#: Parts to a side of a group.
GROUP = 8
#: Rounds after which the tiles written are gathered in one table.
GATHER = 8
_CELLS = ["cell", "r", "c", "z", "terminal", "zone", "w", "steps"]
_STATE = "ty long, tx long, cell long, r long, c long, z double, terminal boolean, zone long, w double, steps long, changed boolean"
_ROUTED = "ty long, tx long, cell long, r long, c long, z double, terminal boolean, zone long, w double, steps long, changed boolean, code int, receiver long"
#: Cells of a border (with r), and links: to another cell, or from where water leaves (without one).
_BORDER = "gy long, gx long, cell long, r long, c long, z double, zone long, other long, cost double"
#: Steps that aren't known yet.
_FAR = 1 << 62
#: Places of neighbours in order of the D8 codes 1 to 8.
_AROUND = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


def _links(r, c, z, zone, part=None) -> tuple:
    """Pairs of places of cells that lie side by side in one zone, and in two parts where these are given, and the greater of their heights."""
    wide = c.max() - c.min() + 2
    key = (r - r.min()) * wide + c - c.min()
    order = np.argsort(key)
    ranked, pairs = key[order], []
    for i, j in _AROUND[:4]:
        at = np.minimum(np.searchsorted(ranked, key + i * wide + j), len(key) - 1)
        here = np.flatnonzero(ranked[at] == key + i * wide + j)
        pairs.append((here, order[at[here]]))
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    met = zone[a] == zone[b]
    if part is not None:
        met &= part[a] != part[b]
    return a[met], b[met], np.maximum(z[a[met]], z[b[met]])


def _in_order(a, b, cost) -> zip:
    order = np.argsort(cost, kind="stable")
    return zip(a[order].tolist(), b[order].tolist(), cost[order].tolist(), strict=True)


def _fewest(n: int, a, b, cost, kept) -> tuple:
    """The fewest links between kept nodes and node n over which ways cost what they cost over all links."""
    up, stands, out = list(range(n + 1)), [*np.where(kept, np.arange(n), -1).tolist(), n], []
    for i, j, x in _in_order(a, b, cost):
        while up[i] != i:
            up[i] = i = up[up[i]]
        while up[j] != j:
            up[j] = j = up[up[j]]
        if i != j:
            p, q = stands[i], stands[j]
            if p >= 0 and q >= 0:
                out.append((min(p, q), max(p, q), x))
            up[j], stands[i] = i, max(p, q)
    return tuple(np.array(x, t) for x, t in zip(zip(*out, strict=True) if out else ((), (), ()), (np.int64, np.int64, float), strict=True))


def _costs(n: int, a, b, cost) -> np.ndarray:
    """What the cheapest way from each node to node n costs: the greatest cost of a link on it; infinite without a way."""
    up, nodes, out = list(range(n + 1)), [[k] for k in range(n + 1)], [np.inf] * n
    for i, j, x in _in_order(a, b, cost):
        while up[i] != i:
            up[i] = i = up[up[i]]
        while up[j] != j:
            up[j] = j = up[up[j]]
        if i == j:
            continue
        if j == n or (i != n and len(nodes[i]) < len(nodes[j])):
            i, j = j, i
        if i == n:
            for k in nodes[j]:
                out[k] = x
        else:
            nodes[i] += nodes[j]
        up[j], nodes[j] = i, ()
    return np.array(out)


def _graph(group: pa.Table, side: int | None, origin: tuple) -> tuple:
    """(cells as a table, links as places of cells; the place beyond the last is where water leaves). side: of a group's parts, None for a tile's cells."""
    numbers = lambda t, *names: (t.column(x).to_numpy() for x in names)
    if side is None:
        r, c, z, zone = numbers(group, "r", "c", "z", "zone")
        out = np.flatnonzero(group.column("terminal").to_numpy(zero_copy_only=False))
        known = (out, np.full(len(out), len(r)), z[out])
        cells, part = group, None
    else:
        is_cell = group.column("r").is_valid()
        cells, links = group.filter(is_cell), group.filter(pa.compute.invert(is_cell))
        r, c, z, zone, cell = numbers(cells, "r", "c", "z", "zone", "cell")
        order = np.argsort(cell)
        place = lambda x: order[np.searchsorted(cell[order], x)]
        leaves = links.column("other").is_null().to_numpy()
        other = links.column("other").fill_null(int(cell[0]) if len(cell) else 0).to_numpy()
        known = (place(links.column("cell").to_numpy()), np.where(leaves, len(r), place(other)), links.column("cost").to_numpy()) if len(cell) else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        part = (r - origin[0]) // side * (1 << 31) + (c - origin[1]) // side
    met = _links(r, c, z, zone, part) if len(r) else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    return cells, tuple(np.concatenate(x) for x in zip(known, met, strict=True))


def _upward(side: int, part: int | None, origin: tuple):
    """A function that cuts a tile (part is None), or a group of parts of that side, down to its border cells and the links that they need."""

    def up(key: tuple, group: pa.Table) -> pa.Table:
        cells, (a, b, cost) = _graph(group, part, origin)
        r, c = cells.column("r").to_numpy() - origin[0], cells.column("c").to_numpy() - origin[1]
        kept = (r % side == 0) | (r % side == side - 1) | (c % side == 0) | (c % side == side - 1)
        a, b, cost = _fewest(len(r), a, b, cost, kept)
        cell, border = cells.column("cell").to_numpy(), cells.filter(pa.array(kept))
        n, m = len(border), len(a)
        gy, gx = (int(i // side // GROUP) for i in (r[0], c[0]))
        none = lambda t: pa.nulls(m, t)
        other = pa.array(np.append(cell, 0)[b], pa.int64(), mask=b == len(cell))
        columns = [pa.concat_arrays([border.column(x).combine_chunks().cast(t), none(t)]) for x, t in (("r", pa.int64()), ("c", pa.int64()), ("z", pa.float64()), ("zone", pa.int64()))]
        columns = [pa.array(np.full(n + m, gy)), pa.array(np.full(n + m, gx)), pa.array(np.concatenate((cell[kept], cell[a]))), *columns, pa.concat_arrays([pa.nulls(n, pa.int64()), other]), pa.concat_arrays([pa.nulls(n, pa.float64()), pa.array(cost)])]
        return pa.table(columns, names=["gy", "gx", "cell", "r", "c", "z", "zone", "other", "cost"])

    return up


def _downward(part: int | None, origin: tuple):
    """A function that gives levels to a tile's cells (part is None), or to the border cells of a group's parts, from those of its own border."""

    def down(key: tuple, group: pa.Table, border: pa.Table) -> pa.Table:
        cells, links = _graph(group, part, origin)
        cell, n = cells.column("cell").to_numpy(), len(cells)
        order, of = np.argsort(cell), border.column("cell").to_numpy()
        at = (order[np.searchsorted(cell[order], of)], np.full(len(of), n), border.column("w").to_numpy())
        w = _costs(n, *(np.concatenate(x) for x in zip(links, at, strict=True)))
        if part is None:
            return cells.append_column("w", pa.array(w))
        gy, gx = ((cells.column(x).to_numpy() - o) // part for x, o in zip(("r", "c"), origin, strict=True))
        return pa.table([pa.array(gy), pa.array(gx), pa.array(cell), pa.array(w)], names=["gy", "gx", "cell", "w"])

    return down


def _levels(start: DataFrame, tile: int) -> DataFrame:
    """start (ty, tx, cell, r, c, z, terminal, zone), as written, with w; no row where start has none."""
    y0, y1, x0, x1 = start.agg(F.min("ty"), F.max("ty"), F.min("tx"), F.max("tx")).first()
    if y0 is None:
        return start.withColumn("w", F.lit(0.0))
    origin, parts = (y0 * tile, x0 * tile), max(y1 - y0, x1 - x0) + 1
    by = ["gy", "gx"]
    cells = start.withColumns({"gy": F.col("ty") - y0, "gx": F.col("tx") - x0})
    groups, side = [], tile
    while parts > 1:
        up = _upward(side, side // GROUP if groups else None, origin)
        groups.append((written((groups[-1][0] if groups else cells).groupBy(*by).applyInArrow(up, _BORDER), "borders"), side))
        parts, side = -(-parts // GROUP), side * GROUP
    known = start.sparkSession.createDataFrame([], "gy long, gx long, cell long, w double")
    for table, part in groups[::-1]:
        last, known = known, written(table.groupBy(*by).cogroup(known.groupBy(*by)).applyInArrow(_downward(part, origin), "gy long, gx long, cell long, w double"), "levels")
        discard(table, *([last] if part != groups[-1][1] else []))
    columns = "ty long, tx long, cell long, r long, c long, z double, terminal boolean, zone long, gy long, gx long, w double"
    found = written(cells.groupBy(*by).cogroup(known.groupBy(*by)).applyInArrow(_downward(None, origin), columns).drop(*by), "levels")
    if groups:
        discard(known)
    return found


def _cells_around(group: pa.Table, reach: tuple) -> np.ndarray:
    """Places of the cells around each one, -1 where there is none of its zone."""
    r, c, zone = (group.column(x).to_numpy() for x in ("r", "c", "zone"))
    at = np.full((int(r.max() - r.min()) + 3, int(c.max() - c.min()) + 3), -1)
    i, j = r - r.min() + 1, c - c.min() + 1
    at[i, j] = np.arange(len(r))
    around = np.stack([at[i + a, j + b] for a, b in reach], axis=1)
    return np.where((around >= 0) & (zone[around] == zone[:, None]), around, -1)


def _settled(key: tuple, group: pa.Table, own: np.ndarray, **found) -> pa.Table:
    out = group.select(["cell", "r", "c", "z", "terminal", "zone"])
    for name, v in found.items():
        out = out.append_column(name, v if isinstance(v, pa.Array) else pa.array(v))
    for k, name in enumerate(("ty", "tx")):
        out = out.add_column(k, name, pa.array(np.full(len(group), key[k].as_py())))
    return out.filter(pa.array(own))


def _stepping():
    """A function that gives one tile's cells their steps and receivers from levels, and from the steps around it."""

    def settle(key: tuple, group: pa.Table) -> pa.Table:
        own, terminal = (group.column(x).to_numpy(zero_copy_only=False) for x in ("own", "terminal"))
        cell, z, w, was = (group.column(x).to_numpy() for x in ("cell", "z", "w", "steps"))
        around = _cells_around(group, _AROUND)
        level, steps = np.append(w, np.inf), np.append(was, _FAR)
        mine = np.flatnonzero(own & ~terminal & (w < np.inf))
        lower = (level[around[mine]] < z[mine, None]).any(axis=1)
        steps[mine[lower]] = 0
        flat = mine[~lower]
        beside = np.where(level[around[flat]] == w[flat, None], around[flat], -1)
        while True:
            to = np.minimum(steps[flat], steps[beside].min(axis=1, initial=_FAR) + 1)
            if (to == steps[flat]).all():
                break
            steps[flat] = to
        # the first neighbour in order of level, steps and cell
        w8, s8, c8 = level[around], steps[around], np.append(cell, 0)[around]
        first = w8 == w8.min(axis=1, keepdims=True)
        s8 = np.where(first, s8, _FAR + 1)
        first &= s8 == s8.min(axis=1, keepdims=True)
        c8 = np.where(first, c8, np.iinfo(np.int64).max)
        to, rows = c8.argmin(axis=1), np.arange(len(cell))
        flows = ~terminal & (w8[rows, to] < np.inf)
        steps = steps[:-1]
        receiver = pa.array(c8[rows, to], pa.int64(), mask=~flows)
        return _settled(key, group, own, w=w, steps=steps, changed=steps != was, code=np.where(flows, to + 1, 0).astype(np.int32), receiver=receiver)

    return settle


def _settling():
    """A function that settles one tile from what is known of it and around it, where a way costs the greatest difference of heights and goes to the nearest four."""

    def settle(key: tuple, group: pa.Table) -> pa.Table:
        own = group.column("own").to_numpy(zero_copy_only=False)
        z, w, steps = (group.column(x).to_numpy() for x in ("z", "w", "steps"))
        stays = ~own | group.column("terminal").to_numpy(zero_copy_only=False)
        around = _cells_around(group, _AROUND[::2])
        around = np.where(~stays[around], around, -1).tolist()
        best, height = list(zip(w.tolist(), steps.tolist(), strict=True)), z.tolist()
        heap = [(x, s, k) for k, (x, s) in enumerate(best) if x < np.inf]
        heapq.heapify(heap)
        while heap:
            x, s, k = heapq.heappop(heap)
            if (x, s) > best[k]:
                continue
            for n in around[k]:
                if n >= 0:
                    h = abs(height[n] - height[k])
                    to = (h, 0) if h > x else (x, s + 1)
                    if to < best[n]:
                        best[n] = to
                        heapq.heappush(heap, (*to, n))
        level, count = (np.array(v) for v in zip(*best, strict=True))
        return _settled(key, group, own, w=level, steps=count, changed=(level != w) | (count != steps))

    return settle


def tiles_touched(tile: int) -> Column:
    """The tiles that hold a cell or one of its neighbours, as structs of ty, tx and own."""
    edge = {-1: lambda x: F.pmod(x, F.lit(tile)) == 0, 0: lambda x: F.lit(True), 1: lambda x: F.pmod(x, F.lit(tile)) == tile - 1}
    to = [F.when(edge[i](F.col("r")) & edge[j](F.col("c")), F.struct((F.col("ty") + i).alias("ty"), (F.col("tx") + j).alias("tx"), F.lit(i == 0 and j == 0).alias("own"))) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return F.filter(F.array(*to), lambda x: x.isNotNull())


def current(tables: list[DataFrame], *of: str) -> DataFrame:
    """The rows of each tile (and of each value of columns `of`) as they were written last."""
    keys = [*of, "ty", "tx"]
    if len(tables) == 1:
        return tables[0]
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    last = every.select(*keys, "round").distinct().groupBy(*keys).agg(F.max("round").alias("round"))
    return every.join(last, [*keys, "round"], "left_semi")


def _placed(grid: DataFrame, z: str, terminal: Column, tile: int, zone: Column) -> DataFrame:
    """Cells with a height, in tiles, written."""
    known = grid.where(F.col(z).isNotNull() & ~F.isnan(F.col(z).cast("double")))
    return written(known.select(
        F.floor(F.col("r") / tile).alias("ty"), F.floor(F.col("c") / tile).alias("tx"), "cell", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col(z).cast("double").alias("z"),
        F.coalesce(terminal, F.lit(False)).alias("terminal"), F.coalesce(zone.cast("long"), F.lit(-1)).alias("zone"),
    ), "cells")


def fill(grid: DataFrame, z: str, terminal: Column, tile: int = TILE, zone: Column | None = None) -> DataFrame:
    """(cell, r, c, z, terminal, zone, w): w is the level of each cell; infinite where no terminal can be reached.

    terminal: where water leaves, as at coasts or edges. zone: water stays in
    cells of one zone. Cells without a height, or with NaN, take no part and
    let nothing pass.
    """
    start = _placed(grid, z, terminal, tile, F.lit(0) if zone is None else zone)
    found = _levels(start, tile)
    if found is not start and hasattr(found, "written_path"):
        discard(start)
    return found.select(*_CELLS[:-1])


def _flood(start: DataFrame, tile: int, settle, schema: str = _STATE) -> DataFrame:
    """The cells of start (ty, tx, cell, r, c, z, terminal, zone, w, steps) as tiles settle them, until none has changed beside another."""
    columns = [x.split()[0] for x in schema.split(", ")]
    state = start.withColumns({"changed": F.lit(True), "round": F.lit(0)} | {x: F.lit(None).cast(t) for x, t in (y.split() for y in schema.split(", ")) if x not in (*start.columns, "changed")})
    tables, active, k = [written(state, "fill")], None, 0
    while True:
        k += 1
        cells = current(tables)
        if active is not None:
            side = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
            near = active.select("ty", "tx", side.alias("s")).select((F.col("ty") + F.col("s.i")).alias("ty"), (F.col("tx") + F.col("s.j")).alias("tx")).distinct()
            cells = cells.join(near, ["ty", "tx"], "left_semi")
        sent = cells.select(*_CELLS, F.explode(tiles_touched(tile)).alias("to")).select(*_CELLS, "to.*")
        if active is None:  # only tiles that have cells of their own
            sent = sent.join(tables[0].select("ty", "tx").distinct(), ["ty", "tx"], "left_semi")
        else:
            sent = sent.join(active, ["ty", "tx"], "left_semi")
        new = written(sent.groupBy("ty", "tx").applyInArrow(settle, schema).withColumn("round", F.lit(k)), "fill")
        tables.append(new)
        beside = new.where("changed").select(F.explode(tiles_touched(tile)).alias("to")).select("to.*").where("not own").select("ty", "tx").distinct()
        following, n = counted(beside.join(tables[0].select("ty", "tx").distinct(), ["ty", "tx"], "left_semi"), "tiles")
        if active is not None:
            discard(active)
        active = following
        if not n:
            break
        if k == 1:  # every tile has run
            discard(tables[0])
            tables = [new]
        if len(tables) > GATHER:
            whole = written(current(tables), "fill")
            discard(*tables)
            tables = [whole]
    return current(tables).select(*columns)


def route(grid: DataFrame, z: str, land: Column, terminal: Column, zone: Column | None = None, tile: int = TILE) -> DataFrame:
    """(cell, r, c, z, terminal, zone, w, steps, code, receiver) of land cells and terminals.

    Code 0 and no receiver at terminals and where no terminal can be reached
    (w is infinite there). Ocean that is no terminal takes no part.
    """
    start = _placed(grid.where(F.coalesce(land, F.lit(False)) | F.coalesce(terminal, F.lit(False))), z, terminal, tile, F.lit(0) if zone is None else zone)
    reached = F.col("w") < float("inf")
    state = _levels(start, tile).withColumn("steps", F.when(F.col("terminal") | ~reached, 0).otherwise(F.lit(_FAR)).cast("long"))
    return _flood(state, tile, _stepping(), _ROUTED).select(*_CELLS, "code", "receiver")


def watershed(grid: DataFrame, cost: str, marker: Column, tile: int = TILE) -> DataFrame:
    """(cell, level, label): each cell has the marker that the image forest of greatest differences leads to.

    A way costs the greatest difference of `cost` between two of its cells in a
    row (four neighbours). A cell belongs to the cheapest way from a marked
    cell, of equally cheap ones to that with the fewest cells since its cost
    last rose, then to that by the neighbour of the smallest (level, steps,
    cell). Cells without a cost, or with NaN, take no part and let nothing
    pass; level is infinite and label null where no marked cell is reached.
    """
    start = grid.where(F.col(cost).isNotNull() & ~F.isnan(F.col(cost).cast("double"))).select(
        F.floor(F.col("r") / tile).alias("ty"), F.floor(F.col("c") / tile).alias("tx"), "cell", "r", "c", F.col(cost).cast("double").alias("z"),
        marker.isNotNull().alias("terminal"), F.lit(0).cast("long").alias("zone"), F.when(marker.isNotNull(), 0.0).otherwise(float("inf")).alias("w"), F.lit(0).cast("long").alias("steps"),
    )
    levels = written(_flood(start, tile, _settling()).select(*_CELLS), "levels")
    sent = neighbours(levels.where(F.col("w") < float("inf")), "z", "w", "steps").where(F.col("code") % 2 == 1)
    met = levels.select("r", "c", F.struct("cell", "z", "w", "steps").alias("own"), F.lit(None).cast("struct<w: double, steps: bigint, cell: bigint, z: double>").alias("of")).unionByName(
        sent.select("r", "c", F.lit(None).cast("struct<cell: bigint, z: double, w: double, steps: bigint>").alias("own"), F.struct("w", "steps", F.col("from_cell").alias("cell"), "z").alias("of"))
    ).groupBy("r", "c").agg(F.max("own").alias("own"), F.collect_list("of").alias("of")).where("own is not null")  # at most four
    gap = lambda x: F.abs(x["z"] - F.col("own.z"))
    led = F.filter("of", lambda x: F.when(gap(x) > x["w"], (F.col("own.w") == gap(x)) & (F.col("own.steps") == 0)).otherwise((F.col("own.w") == x["w"]) & (F.col("own.steps") == x["steps"] + 1)))
    marked = grid.select("cell", marker.alias("label"))
    forest = met.select(F.col("own.cell").alias("cell"), F.array_min(led)["cell"].alias("led"), F.col("own.w").alias("level")).join(marked, "cell")
    forest = written(forest.select("cell", F.when(F.col("label").isNull(), F.col("led")).alias("receiver"), "level"), "image-forest")
    roots = outlets(forest.select("cell", "receiver")).join(marked.select(F.col("cell").alias("outlet"), "label"), "outlet")
    return forest.join(roots, "cell").select("cell", "level", "label")


def coastline(grid: DataFrame, land: Column) -> DataFrame:
    """(cell) of ocean cells with land among their eight neighbours."""
    around = neighbours(grid.where(land)).select("r", "c").distinct()
    return grid.where(~F.coalesce(land, F.lit(False))).join(around, ["r", "c"], "left_semi").select("cell")


def edge_cells(grid: DataFrame) -> DataFrame:
    """grid with edge: cells that lack one of their eight neighbours."""
    around = neighbours(grid).groupBy("r", "c").agg(F.count("*").alias("n_around"))
    return grid.join(around, ["r", "c"], "left").withColumn("edge", F.coalesce(F.col("n_around"), F.lit(0)) < 8).drop("n_around")
