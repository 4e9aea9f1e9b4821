"""Queries of smoothed heights, of ways through corridors, and of lake surfaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillspark.operators import focal, lakes, ways
from rillspark.plans.conditioning import _zoom_sql
from rillspark.sources.grids import GRID_SQL, order_grid
from rillspark.sources.shared import written

#: Deviation of the smoothing in cells.
SIGMA = 2.0
#: Edge of the blocks that ways cross, and half the width of a corridor, in cells.
BLOCK, REACH = 20, 3
#: What leaving the middle, height above the lowest, climbing and turning cost.
DEVIATION, ELEVATION, UPHILL, TURN = 0.15, 0.02, 0.08, 0.5

#: Edge of a coarse lake cell, and the mean price that makes it one.
LAKE_BLOCK, LAKE_PRICE = 3, 270_000.0


def smoothed_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights of the ramp smoothed by a Gaussian, and what is left."""
    g = focal.gaussian(order_grid(spark, sf_dir).select("cell", "r", "c", "z"), "z", SIGMA, "smooth")
    return g.select("cell", F.round("smooth", 4).alias("smooth"), F.round(F.col("z") - F.col("smooth"), 4).alias("relief"))


def _crossings(grid: DataFrame) -> DataFrame:
    """(path, r0, c0, r1, c1, rm, cm): in every block from the dearest cell to the cheapest (of equal ones the first), and the block's mean place."""
    own = F.struct("price", "cell", "r", "c")
    of = grid.groupBy(F.expr(f"(r div {BLOCK}) * 100000 + c div {BLOCK}").alias("path")).agg(
        F.max(F.struct("price", (-F.col("cell")).alias("k"), "r", "c")).alias("a"), F.min(own).alias("b"), F.floor(F.avg("r")).alias("rm"), F.floor(F.avg("c")).alias("cm")
    )
    return of.select("path", F.col("a.r").alias("r0"), F.col("a.c").alias("c0"), F.col("b.r").alias("r1"), F.col("b.c").alias("c1"), "rm", "cm")


def _listed(found: DataFrame, grid: DataFrame) -> DataFrame:
    cells = found.join(grid.select("r", "c", "cell"), ["r", "c"])
    return cells.select("path", "seq", "cell", F.round("cost", 4).alias("cost"), "fallback")


def corridor_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest ways near a straight line, from each block's dearest cell to its cheapest, over heights of the ramp."""
    grid = order_grid(spark, sf_dir).select("cell", "r", "c", "z", "price")
    ends = written(_crossings(grid), "crossings")
    cells = ways.tolled(ways.segment_corridors(ends, REACH), grid, "z", F.col("z"), DEVIATION, ELEVATION)
    return _listed(ways.cheapest(cells, ends, UPHILL), grid)


def guided_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest ways with few turns near a guide that bends in the middle of a block, low against smoothed heights."""
    grid = written(focal.gaussian(order_grid(spark, sf_dir).select("cell", "r", "c", "z", "price"), "z", max(1.0, REACH / 2), "smooth"), "smoothed")
    ends = written(_crossings(grid), "crossings")
    to = ways.straight(ends.select("path", "r0", "c0", F.col("rm").alias("r1"), F.col("cm").alias("c1")))
    on = ways.straight(ends.select("path", F.col("rm").alias("r0"), F.col("cm").alias("c0"), "r1", "c1"))
    cells = ways.tolled(ways.guide_corridors(to.unionByName(on), REACH), grid, "z", F.col("z") - F.col("smooth"), DEVIATION, ELEVATION)
    return _listed(ways.cheapest(cells, ends, UPHILL, TURN), grid)


def lake_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fine lake cells with the level of their lake: blocks of dear orders, refined three times by bilinear coverage."""
    blocks = order_grid(spark, sf_dir).groupBy(F.expr(f"r div {LAKE_BLOCK}").alias("r"), F.expr(f"c div {LAKE_BLOCK}").alias("c")).agg(F.min("cell").alias("cell"), F.avg("price").alias("price"), F.min("price").alias("low"), F.max("z").alias("z"))
    grid = written(blocks.select("cell", "r", "c", (F.col("price") > LAKE_PRICE).alias("wet"), F.when(F.col("r") % 3 == 0, F.col("low")).alias("surface"), "z"), "blocks")
    found = written(lakes.completed_surfaces(grid, F.col("wet"), F.col("surface"), F.col("z")), "surfaces")
    fine = focal.bilinear(grid.select("r", "c", F.col("wet").cast("double").alias("v")), "v", 3, ragged=False).where("v >= 0.5 - 1e-12").select("r", "c")
    level = F.round(F.col("level") * 1e4) / 1e4  # SQL rounds the double times 10,000, not its decimals
    return lakes.refined_surfaces(grid, found, fine, 3).select("r", "c", "patch", level.alias("level"))


def _smoothed_sql(sigma: float) -> str:
    """Common tables s (cell, r, c, z, price, smooth): every cell with the weights around it, places beyond an end mirrored."""
    w = focal.gaussian_weights(sigma)
    reach = len(w) - 1
    kernel = ",".join(f"({k}, {w[abs(k)]!r}::double)" for k in range(-reach, reach + 1))

    def inside(x: str, n: str) -> str:
        turned = f"(({x}) % (2 * {n}) + 2 * {n}) % (2 * {n})"
        return f"case when {turned} < {n} then {turned} else 2 * {n} - 1 - {turned} end"

    return f"""kn(k, w) as (values {kernel}), h as materialized (select *, max(r) over (partition by c) + 1 as nr, max(c) over (partition by r) + 1 as nc from g),
 h1 as materialized (select a.cell, sum(kn.w * b.z) as v from (select h.*, k, w, {inside("c + k", "nc")} as cc from h, kn) a join kn on kn.k = a.k join g b on b.r = a.r and b.c = a.cc group by a.cell),
 h2 as materialized (select a.cell, sum(kn.w * x.v) as smooth from (select h.*, k, {inside("r + k", "nr")} as rr from h, kn) a join kn on kn.k = a.k join g b on b.r = a.rr and b.c = a.c join h1 x on x.cell = b.cell group by a.cell),
 s as materialized (select g.cell, r, c, z, price, smooth from g join h2 using (cell))"""


_ENDS_SQL = f"""en as materialized (select path, a.r as r0, a.c as c0, b.r as r1, b.c as c1, rm, cm from (select (r // {BLOCK}) * 100000 + c // {BLOCK} as path,
 max(struct_pack(p := price, k := -cell, r := r, c := c)) as a, min(struct_pack(p := price, k := cell, r := r, c := c)) as b, cast(floor(avg(r)) as bigint) as rm, cast(floor(avg(c)) as bigint) as cm from g group by 1))"""


def _ways_sql(turn: float) -> str:
    """From co (path, cell, r, c, z, toll) and en: the ways, found by relaxing all states until none gets cheaper."""
    state = "d.d" if turn else "0"
    via = "lb.dir" if turn else "d.d"
    bent = f" + case when lb.dir not in (8, d.d) then {turn} else 0 end" if turn else ""
    step = "wk.dir" if turn else "lb.via"
    return f"""d(d, dr, dc, len) as (values (0,0,1,1.0::double),(1,1,1,sqrt(2.0)),(2,1,0,1.0),(3,1,-1,sqrt(2.0)),(4,0,-1,1.0),(5,-1,-1,sqrt(2.0)),(6,-1,0,1.0),(7,-1,1,sqrt(2.0))),
 lb(path, r, c, z, dir, cost, via) using key (path, r, c, dir) as (select path, r, c, z, {8 if turn else 0}, 0.0::double, 8 from en join co using (path) where r = r0 and c = c0
  union select x.path, x.r, x.c, x.z, x.dir, x.k.cost, x.k.via from (select co.path, co.r, co.c, co.z, {state} as dir, min(struct_pack(cost := lb.cost + (d.len + co.toll + {UPHILL} * greatest(0.0, co.z - lb.z)){bent}, via := {via})) as k
    from lb, d, co where co.path = lb.path and co.r = lb.r + d.dr and co.c = lb.c + d.dc group by all) x
   left join recurring.lb o on o.path = x.path and o.r = x.r and o.c = x.c and o.dir = x.dir where o.path is null or (x.k.cost, x.k.via) < (o.cost, o.via)),
 go as materialized (select path, r1 as r, c1 as c, min(struct_pack(cost := cost, dir := lb.dir)) as k from en join lb using (path) where lb.r = r1 and lb.c = c1 group by all),
 wk(path, back, r, c, dir, cost) as (select path, 0, r, c, k.dir, k.cost from go
  union all select wk.path, wk.back + 1, wk.r - d.dr, wk.c - d.dc, {"lb.via" if turn else "0"}, wk.cost from wk join lb on lb.path = wk.path and lb.r = wk.r and lb.c = wk.c and lb.dir = wk.dir join d on d.d = {step})
 select wk.path, cast(max(wk.back) over (partition by wk.path) - wk.back as bigint) as seq, g.cell, round(wk.cost, 4) as cost, false as fallback from wk join g on g.r = wk.r and g.c = wk.c"""


_LINE_SQL = """select path, cast(least(abs(y1 - y0), k) * sign(y1 - y0) + y0 as bigint) as r, cast(least(abs(x1 - x0), k) * sign(x1 - x0) + x0 as bigint) as c from (select *, unnest(range(0, greatest(abs(y1 - y0), abs(x1 - x0)) + 1)) as k from"""

_NEAR_SQL = f"""nr as materialized (select en.path, g.cell, g.r, g.c, g.z, case when (r1 - r0) * (r1 - r0) + (c1 - c0) * (c1 - c0) = 0 then 0.0 else least(1.0, greatest(0.0, ((g.r - r0) * (r1 - r0) + (g.c - c0) * (c1 - c0)) / cast((r1 - r0) * (r1 - r0) + (c1 - c0) * (c1 - c0) as double))) end as t, r0, c0, r1, c1
  from en join g on g.r between least(r0, r1) - {REACH} and greatest(r0, r1) + {REACH} and g.c between least(c0, c1) - {REACH} and greatest(c0, c1) + {REACH}),
 n2 as (select *, (r - (r0 + t * (r1 - r0))) * (r - (r0 + t * (r1 - r0))) + (c - (c0 + t * (c1 - c0))) * (c - (c0 + t * (c1 - c0))) as d2 from nr),
 co as materialized (select path, cell, r, c, z, {DEVIATION}::double * d2 + {ELEVATION}::double * (z - min(z) over (partition by path)) as toll from n2 where d2 <= {REACH * REACH})"""

_GUIDE_SQL = f"""gd as materialized ({_LINE_SQL} (select path, r0 as y0, c0 as x0, rm as y1, cm as x1 from en)) union {_LINE_SQL} (select path, rm as y0, cm as x0, r1 as y1, c1 as x1 from en))),
 n2 as materialized (select gd.path, s.cell, s.r, s.c, s.z, z - smooth as low, min((s.r - gd.r) * (s.r - gd.r) + (s.c - gd.c) * (s.c - gd.c)) as d2 from gd join s on s.r between gd.r - {REACH} and gd.r + {REACH} and s.c between gd.c - {REACH} and gd.c + {REACH} group by all),
 co as materialized (select path, cell, r, c, z, {DEVIATION}::double * d2 + {ELEVATION}::double * (low - min(low) over (partition by path)) as toll from n2 where d2 <= {REACH * REACH})"""

_LAKES_SQL = f"""b as materialized (select r // {LAKE_BLOCK} as r, c // {LAKE_BLOCK} as c, min(cell) as cell, (avg(price) > {LAKE_PRICE}) as wet, cast(avg(price) > {LAKE_PRICE} as integer)::double as v,
 case when (r // {LAKE_BLOCK}) % 3 = 0 then min(price) end as surface, max(z) as z from g group by 1, 2),
 e as materialized (select a.cell, o.cell as nbr from b a join b o on a.wet and o.wet and (abs(a.r - o.r) + abs(a.c - o.c)) = 1),
 lab(cell, patch) using key (cell) as (select cell, cell from b where wet union select x.cell, x.patch from (select e.nbr as cell, min(lab.patch) as patch from lab join e on e.cell = lab.cell group by e.nbr) x join recurring.lab o on o.cell = x.cell where x.patch < o.patch),
 lv as materialized (select patch, coalesce(median(surface), median(z)) as level from lab join b using (cell) group by patch)"""

QUERIES = {
    "smoothed_heights": (smoothed_heights, f"with {GRID_SQL}, {_smoothed_sql(SIGMA)} select cell, round(smooth, 4) as smooth, round(z - smooth, 4) as relief from s"),
    "corridor_paths": (corridor_paths, f"with recursive {GRID_SQL}, {_ENDS_SQL}, {_NEAR_SQL}, {_ways_sql(0.0)}"),
    "guided_paths": (guided_paths, f"with recursive {GRID_SQL}, {_smoothed_sql(max(1.0, REACH / 2))}, {_ENDS_SQL}, {_GUIDE_SQL}, {_ways_sql(TURN)}"),
    "lake_surfaces": (lake_surfaces, f"with recursive {GRID_SQL}, {_LAKES_SQL}, " + _zoom_sql(3, "b", "v") + """, fn as (select r, c from zm where v >= 0.5 - 1e-12),
 ne as (select fn.r, fn.c, min(struct_pack(d := (b.r - fn.r // 3) * (b.r - fn.r // 3) + (b.c - fn.c // 3) * (b.c - fn.c // 3), r := b.r, c := b.c, cell := b.cell)) as k from fn join b on b.wet and b.r between fn.r // 3 - 2 and fn.r // 3 + 2 and b.c between fn.c // 3 - 2 and fn.c // 3 + 2 group by all)
 select ne.r, ne.c, lab.patch, round(lv.level, 4) as level from ne join lab on lab.cell = ne.k.cell join lv on lv.patch = lab.patch"""),
}
