"""Filling against a heap over the whole grid; tiles of any size give the same levels."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillspark.operators import fill
from rillspark.plans import drainage


def flood(z, terminal):
    level = np.where(terminal, z, np.inf)
    heap = [(level[i], i) for i in np.ndindex(z.shape) if terminal[i]]
    heapq.heapify(heap)
    while heap:
        w, (r, c) = heapq.heappop(heap)
        for i, j in np.ndindex(3, 3):
            n = (r + i - 1, c + j - 1)
            if 0 <= n[0] < z.shape[0] and 0 <= n[1] < z.shape[1] and not terminal[n] and max(z[n], w) < level[n]:
                level[n] = max(z[n], w)
                heapq.heappush(heap, (level[n], n))
    return level


def grid(spark, z, terminal):
    rows = [(r * z.shape[1] + c, r, c, z[r, c].item(), bool(terminal[r, c])) for r, c in np.ndindex(z.shape)]
    return spark.createDataFrame(rows, "cell long, r long, c long, h double, leaves boolean")


@pytest.mark.parametrize("tile", [5, 7, 64])
def test_levels_equal_a_flood_whatever_the_tiles(spark, tile):
    rng = np.random.default_rng(9)
    z, terminal = rng.random((23, 31)).round(3), np.zeros((23, 31), bool)
    terminal[0, :] = terminal[5, 7] = True
    got = {x.cell: x.w for x in fill.fill(grid(spark, z, terminal), "h", F.col("leaves"), tile).collect()}
    assert got == {r * 31 + c: w.item() for (r, c), w in np.ndenumerate(flood(z, terminal))}


def test_levels_pass_through_groups_of_groups_in_rounds_that_no_way_adds_to(spark, monkeypatch):
    """A winding valley crosses 50 tiles again and again; every written table is counted."""
    monkeypatch.setattr(fill, "GROUP", 2)
    made, write = [], fill.written
    monkeypatch.setattr(fill, "written", lambda df, what: made.append(what) or write(df, what))
    rng = np.random.default_rng(5)
    z, terminal, zone = rng.integers(0, 9, (15, 29)) + 0.5, np.zeros((15, 29), bool), np.zeros((15, 29), int)
    z[1::2], z[1::4, -1], z[3::4, 0] = 99.0, 3.0, 3.0
    zone[:, 20:] = 1
    terminal[0, 0] = True
    rows = [(r * 29 + c, r - 4, c - 7, z[r, c].item(), bool(terminal[r, c]), int(zone[r, c])) for r, c in np.ndindex(z.shape)]
    df = spark.createDataFrame(rows, "cell long, r long, c long, h double, leaves boolean, zone int")
    got = {x.cell: x.w for x in fill.fill(df, "h", F.col("leaves"), 3).collect()}
    assert got == {r * 29 + c: w.item() for (r, c), w in np.ndenumerate(flood(z, terminal))}
    assert len(made) == 1 + 4 + 4 + 1 and len(set(got.values())) > 3  # cells, four sizes of groups up and down, tiles
    apart = {x.cell: x.w for x in fill.fill(df, "h", F.col("leaves"), 3, F.col("zone")).collect()}
    assert {k for k, w in apart.items() if w == np.inf} == {r * 29 + c for r, c in np.ndindex(z.shape) if c >= 20}


def heap_route(z, land, terminal, zone):
    """A flood in order of (level, steps, cell): the first neighbour that it reaches receives."""
    cols = z.shape[1]
    heap = [(z[i], 0, i[0] * cols + i[1]) for i in np.ndindex(z.shape) if terminal[i]]
    done = {k: (w, s, None) for w, s, k in heap}
    heapq.heapify(heap)
    while heap:
        w, s, k = heapq.heappop(heap)
        r, c = divmod(k, cols)
        for i, j in np.ndindex(3, 3):
            n = (r + i - 1, c + j - 1)
            at = n[0] * cols + n[1]
            if 0 <= n[0] < z.shape[0] and 0 <= n[1] < cols and land[n] and zone[n] == zone[r, c] and at not in done:
                to = (z[n], 0) if z[n] > w else (w, s + 1)
                done[at] = (*to, k)
                heapq.heappush(heap, (*to, at))
    return done


@pytest.mark.parametrize("tile", [6, 64])
def test_receivers_equal_a_flood_on_flats_and_in_zones(spark, monkeypatch, tile):
    monkeypatch.setattr(fill, "GATHER", 2)
    rng = np.random.default_rng(4)
    z, land, zone = rng.integers(0, 4, (25, 29)).astype(float), rng.random((25, 29)) > 0.06, np.tile(np.arange(29) // 15, (25, 1))
    terminal = np.zeros((25, 29), bool)
    terminal[0, :] = terminal[20, 25] = True
    rows = [(r * 29 + c, r, c, z[r, c].item(), bool(land[r, c]), bool(terminal[r, c]), int(zone[r, c])) for r, c in np.ndindex(z.shape)]
    df = spark.createDataFrame(rows, "cell long, r long, c long, h double, land boolean, leaves boolean, zone int")
    got = {x.cell: (x.w, x.steps, x.receiver) for x in fill.route(df, "h", F.col("land"), F.col("leaves"), F.col("zone"), tile).where("w < double('inf')").collect()}
    assert got == heap_route(z, land, terminal, zone) and max(s for _, s, _ in got.values()) > 3


def test_nan_and_null_heights_take_no_part(spark):
    df = spark.createDataFrame([(0, 0, 0, 1.0), (1, 0, 1, float("nan")), (2, 0, 2, 5.0), (3, 1, 0, None), (4, 1, 1, 3.0)], "cell long, r long, c long, h double")
    got = {x.cell: (x.w, x.receiver) for x in fill.route(df, "h", F.lit(True), F.col("cell") == 0).collect()}
    assert got == {0: (1.0, None), 4: (3.0, 0), 2: (5.0, 4)}
    assert fill.route(df.limit(0), "h", F.lit(True), F.lit(True)).isEmpty()


def test_bowl_and_unreachable(spark):
    z = np.full((5, 5), 9.0)
    z[2, 2], z[1, 2], z[0, 2] = 1.0, 4.0, 3.0
    edge = np.ones((5, 5), bool)
    edge[1:-1, 1:-1] = False
    got = {x.cell: x.w for x in fill.fill(grid(spark, z, edge), "h", F.col("leaves")).collect()}
    assert got[12] == 4.0 and got[7] == 4.0 and got[11] == 9.0
    assert {x.w for x in fill.fill(grid(spark, z, edge & False), "h", F.col("leaves")).collect()} == {float("inf")}


def test_lakes_lie_above_the_ground(spark):
    lakes = drainage.depression_lakes(spark, "/root/testdata/sf0.001").collect()
    assert lakes and all(x.n >= 2 and x.depth > 5_000 for x in lakes)
    assert [x.used for x in sorted(lakes, key=lambda x: x.used)] == np.cumsum([x.n for x in sorted(lakes, key=lambda x: x.used)]).tolist()


def image_forest(cost, markers):
    """A flood in order of (level, steps, cell) over differences, with the first neighbour of that order that leads to a cell."""
    cols = cost.shape[1]
    best = {k: (0.0, 0) for k in markers}
    heap = [(0.0, 0, k) for k in markers]
    heapq.heapify(heap)
    order = []
    while heap:
        w, s, k = heapq.heappop(heap)
        if (w, s) > best[k]:
            continue
        order.append(k)
        r, c = divmod(k, cols)
        for n, i, j in ((k + 1, r, c + 1), (k - 1, r, c - 1), (k + cols, r + 1, c), (k - cols, r - 1, c)):
            if 0 <= i < cost.shape[0] and 0 <= j < cols and n not in markers and not np.isnan(cost[i, j]):
                h = abs(cost[i, j] - cost[r, c])
                to = (h, 0) if h > w else (w, s + 1)
                if to < best.get(n, (np.inf, 0)):
                    best[n] = to
                    heapq.heappush(heap, (*to, n))
    label = dict(markers)
    for k in sorted(best, key=lambda k: (*best[k], k)):
        r, c = divmod(k, cols)
        for n, i, j in ((k + 1, r, c + 1), (k - 1, r, c - 1), (k + cols, r + 1, c), (k - cols, r - 1, c)):
            if 0 <= i < cost.shape[0] and 0 <= j < cols and n in best and n not in label:
                h = abs(cost[i, j] - cost[r, c])
                if best[n] == ((h, 0) if h > best[k][0] else (best[k][0], best[k][1] + 1)):
                    label[n] = label[k]
    return {k: (best[k][0], label[k]) for k in best}


@pytest.mark.parametrize("tile", [6, 64])
def test_watershed_equals_a_flood_over_differences(spark, tile):
    rng = np.random.default_rng(8)
    cost = rng.integers(0, 6, (21, 26)).astype(float)
    cost[:, 20], cost[10, 20] = np.nan, 3.0  # a wall with one gate
    cost[0, 25] = np.nan
    markers = {30: 7, 31: 9, 200: 7, 333: 2}
    rows = [(r * 26 + c, r, c, cost[r, c].item(), markers.get(r * 26 + c)) for r, c in np.ndindex(cost.shape)]
    df = spark.createDataFrame(rows, "cell long, r long, c long, h double, mark long")
    got = {x.cell: (x.level, x.label) for x in fill.watershed(df, "h", F.col("mark"), tile).collect()}
    assert got == image_forest(cost, markers) and len({v[1] for v in got.values()}) == 3
    assert fill.watershed(df.limit(0), "h", F.col("mark")).isEmpty()
    none = fill.watershed(df, "h", F.lit(None).cast("long"), tile).distinct().select("level", "label").distinct().collect()
    assert [tuple(x) for x in none] == [(float("inf"), None)]
