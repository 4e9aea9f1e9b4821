"""Ways through corridors against a plain search over whole grids; smoothing against direct sums."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillspark.operators import focal, ways

AROUND = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def to_segment(r, c, r0, c0, r1, c1):
    dr, dc = r1 - r0, c1 - c0
    t = 0.0 if not (dr or dc) else min(1.0, max(0.0, ((r - r0) * dr + (c - c0) * dc) / (dr * dr + dc * dc)))
    return (r - r0 - t * dr) ** 2 + (c - c0 - t * dc) ** 2


def plain_cost(z, toll, start, end, uphill, turn):
    """Least cost from start to end by cells with the direction of entry, or None."""
    best, heap = {(start, None): 0.0}, [(0.0, start, -1)]
    while heap:
        cost, at, by = heapq.heappop(heap)
        if at == end:
            return cost
        if cost > best[at, None if by < 0 else by]:
            continue
        for d, (i, j) in enumerate(AROUND):
            to = (at[0] + i, at[1] + j)
            if to in toll:
                x = cost + math.hypot(i, j) + toll[to] + uphill * max(0.0, z[to] - z[at]) + (turn if by >= 0 and by != d else 0.0)
                if x < best.get((to, d), math.inf):
                    best[to, d] = x
                    heapq.heappush(heap, (x, to, d))
    return None


def cost_of(way, z, toll, uphill, turn):
    total, last = 0.0, None
    for a, b in zip(way, way[1:]):
        d = AROUND.index((b[0] - a[0], b[1] - a[1]))
        total += math.hypot(b[0] - a[0], b[1] - a[1]) + toll[b] + uphill * max(0.0, z[b] - z[a]) + (turn if last not in (None, d) else 0.0)
        last = d
    return total


def gathered(df):
    found = {}
    for x in df.orderBy("path", "seq").collect():
        way = found.setdefault(x.path, ([], x.cost, x.fallback))
        assert x.seq == len(way[0])
        way[0].append((x.r, x.c))
    return found


@pytest.mark.parametrize(("turn", "tile"), [(0.0, 11), (0.8, 11), (0.8, 64)])
def test_ways_cost_as_little_as_in_a_plain_search(spark, turn, tile):
    rng = np.random.default_rng(5)
    z = rng.integers(0, 40, (24, 31)).astype(float)
    gone = {(r, c) for r, c in np.ndindex(z.shape) if rng.random() < 0.15}
    grid = spark.createDataFrame([(r, c, None if (r, c) in gone else z[r, c].item()) for r, c in np.ndindex(z.shape)], "r long, c long, z double")
    ends = [(k, *map(int, (rng.integers(0, 24), rng.integers(0, 31), rng.integers(0, 24), rng.integers(0, 31)))) for k in range(14)] + [(90, 3, 4, 3, 4), (91, 2, 2, 200, 2), (92, None, 1, 2, 3)]
    asked = spark.createDataFrame(ends, "path long, r0 long, c0 long, r1 long, c1 long")
    reach, uphill = 4, 0.3
    cells = ways.tolled(ways.segment_corridors(asked.dropna(), reach), grid, "z", F.col("z"), 0.2, 0.05)
    got = gathered(ways.cheapest(cells, asked, uphill, turn, tile))
    assert set(got) == {k for k, *e in ends if None not in e}
    lost = 0
    for k, *e in ends[:14]:
        near = {p: to_segment(*p, *e) for p in np.ndindex(z.shape) if p not in gone}
        near = {p: d for p, d in near.items() if d <= reach * reach}
        least = min((z[p] for p in near), default=0.0)
        toll = {p: 0.2 * d + 0.05 * (z[p] - least) for p, d in near.items()}
        start, end = tuple(e[:2]), tuple(e[2:])
        want = plain_cost(z, toll, start, end, uphill, turn) if start in toll and end in toll else None
        way, cost, fallback = got[k]
        assert way[0] == start and way[-1] == end
        assert fallback == (want is None)
        if want is None:
            lost += 1
            assert cost is None and len(way) == 1 + max(abs(e[0] - e[2]), abs(e[1] - e[3]))
        else:
            assert cost == pytest.approx(want, abs=1e-9) and cost_of(way, z, toll, uphill, turn) == pytest.approx(want, abs=1e-9)
    assert 0 < lost < 14
    assert got[90] == ([(3, 4)], 0.0, False) and got[91][2] and len(got[91][0]) == 199


def test_a_way_may_leave_a_tile_and_come_back(spark):
    z = np.zeros((9, 12))
    wall = {(r, 5) for r in range(8)} | {(r, 9) for r in range(1, 9)}
    cells = [(1, r, c, z[r, c].item(), 0.0) for r, c in np.ndindex(z.shape) if (r, c) not in wall]
    df = spark.createDataFrame(cells + cells[:3] + [(1, 2, 5, None, 0.0), (2, 0, 0, 1.0, 1.0)], "path long, r long, c long, z double, toll double")
    asked = spark.createDataFrame([(1, 0, 0, 0, 11), (1, 0, 0, 0, 11)], "path long, r0 long, c0 long, r1 long, c1 long")
    whole, small = (gathered(ways.cheapest(df, asked, 1.0, 0.5, tile)) for tile in (64, 6))
    assert whole == small and not whole[1][2]
    assert (8, 5) in whole[1][0] and (0, 9) in whole[1][0]


def test_no_ways_and_bad_costs(spark):
    cells = spark.createDataFrame([(1, 0, 0, 1.0, -1.0)], "path long, r long, c long, z double, toll double")
    none = spark.createDataFrame([], "path long, r0 long, c0 long, r1 long, c1 long")
    assert ways.cheapest(cells, none).collect() == []
    with pytest.raises(ValueError, match="tolls"):
        ways.cheapest(cells, spark.createDataFrame([(1, 0, 0, 1, 1)], none.schema))
    with pytest.raises(ValueError, match="negative"):
        ways.cheapest(cells, none, uphill=-1.0)


def test_guides_have_corridors_around_all_their_cells(spark):
    guide = spark.createDataFrame([(7, 2, 2), (7, 2, 3), (7, 2, 3), (8, 0, 0)], "path long, r long, c long")
    got = {(x.path, x.r, x.c): x.d2 for x in ways.guide_corridors(guide, 2).collect()}
    want = {}
    for k, cells in ((7, [(2, 2), (2, 3)]), (8, [(0, 0)])):
        for r in range(-3, 8):
            for c in range(-3, 8):
                d = min((r - i) ** 2 + (c - j) ** 2 for i, j in cells)
                if d <= 4:
                    want[k, r, c] = d
    assert got == want


@pytest.mark.parametrize(("shape", "sigma"), [((9, 14), 1.3), ((3, 2), 2.0)])
def test_smoothing_equals_direct_sums_over_mirrored_grids(spark, shape, sigma):
    z = np.random.default_rng(2).random(shape) * 100
    reach = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    w /= w.sum()
    want = z
    for axis in (1, 0):
        wide = np.pad(want, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        want = np.apply_along_axis(lambda x: np.convolve(x, w, mode="valid"), axis, wide)
    df = spark.createDataFrame([(r, c, z[r, c].item()) for r, c in np.ndindex(shape)], "r long, c long, z double")
    got = focal.gaussian(df, "z", sigma, "smooth").collect()
    assert len(got) == z.size
    for x in got:
        assert x.smooth == pytest.approx(want[x.r, x.c], abs=1e-9) and x.z == z[x.r, x.c]


def test_cells_without_a_height_weigh_nothing(spark):
    df = spark.createDataFrame([(0, 0, 5.0), (0, 1, None), (0, 2, 5.0), (1, 1, 5.0)], "r long, c long, z double")
    got = {(x.r, x.c): x.s for x in focal.gaussian(df, "z", 1.0, "s").collect()}
    assert got.pop((0, 1)) is None and all(v == pytest.approx(5.0) for v in got.values()) and len(got) == 3
    with pytest.raises(ValueError, match="positive"):
        focal.gaussian(df, "z", 0.0, "s")
