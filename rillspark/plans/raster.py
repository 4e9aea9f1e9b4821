"""Queries of raster algebra: focal windows, boundaries, blocks, refinement, prefix sums."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillspark.functions import hydrology as hy
from rillspark.operators import components, distance, flow, focal
from rillspark.sources.grids import GRID_SQL, RESOLUTION_M, order_grid
from rillspark.sources.shared import shared_dir
from rillspark.streaming import tiles

H = RESOLUTION_M
_G = f"with {GRID_SQL} "
_R, _C = "(partition by c order by r)", "(partition by r order by c)"


def _lag(x: str, over: str, lead: bool = False) -> str:
    return f"{'lead' if lead else 'lag'}({x}) over {over}"


def _gradient_sql(x: str, over: str) -> str:
    a, b = _lag(x, over), _lag(x, over, True)
    return f"case when {a} is null and {b} is null then 0.0 when {a} is null then ({b} - {x}) / {H} when {b} is null then ({x} - {a}) / {H} else ({b} - {a}) / {2 * H} end"


def _padded_sum_sql(x: str, part: str, order: str, k: int) -> str:
    w = f"partition by {part} order by {order}"
    whole = f"({w} rows between unbounded preceding and unbounded following)"
    return (f"sum({x}) over ({w} rows between {k} preceding and {k} following) + greatest(0, {k} - row_number() over ({w}) + 1) * first_value({x}) over {whole}"
            f" + greatest(0, {k} - count(*) over {whole} + row_number() over ({w})) * last_value({x}) over {whole}")  # fmt: skip


def terrain_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = order_grid(spark, sf_dir).withColumn("dx", focal.gradient("z", "c", H)).withColumn("dy", focal.gradient("z", "r", H))
    return g.select("cell", F.round("dx", 12).alias("dx"), F.round("dy", 12).alias("dy"), F.round(hy.hillshade(F.col("dx"), F.col("dy")), 6).alias("shade"))


def terrain_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = order_grid(spark, sf_dir).withColumn("dx", focal.gradient("z", "c", H)).withColumn("dy", focal.gradient("z", "r", H)).withColumn("lap", focal.laplacian("z", 900.0))
    s = F.hypot("dx", "dy")
    return g.groupBy("zone").agg(
        F.round(F.avg("z"), 6).alias("mean"), F.round(F.stddev_pop("z"), 6).alias("std"), F.min("z").alias("low"), F.max("z").alias("high"), F.round(F.max("z") - F.min("z"), 6).alias("range"),
        F.round(F.avg(s), 6).alias("slope_mean"), F.round(F.stddev_pop(s), 6).alias("slope_std"), F.round(F.sqrt(F.avg(s * s)), 6).alias("slope_rms"), F.round(F.sqrt(F.avg(F.col("lap") * F.col("lap"))), 6).alias("laplacian_rms"),
    )


def padded_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = order_grid(spark, sf_dir)
    return g.select("cell", F.round(focal.padded_gradient("z", "c", H), 12).alias("dx"), F.round(focal.padded_gradient("z", "r", H), 12).alias("dy"))


def local_relief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, position index, roughness and relief over three by three cells."""
    g = order_grid(spark, sf_dir).withColumn("zz", F.col("z") * F.col("z"))
    g = focal.padded_mean(focal.padded_mean(g, "z", 1, "mean"), "zz", 1, "square")
    g = focal.extreme(focal.extreme(g, "z", 1, F.max, "high"), "z", 1, F.min, "low")
    return g.select(
        "cell", F.round("mean", 6).alias("mean"), F.round(F.col("z") - F.col("mean"), 6).alias("tpi"), F.round(F.col("high") - F.col("low"), 6).alias("relief"),
        F.round(F.sqrt(F.greatest(F.lit(0.0), F.col("square") - F.col("mean") * F.col("mean"))), 3).alias("roughness"),
    )


def wide_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = focal.padded_mean(order_grid(spark, sf_dir), "z", 4, "mean")
    return focal.extreme(g, "z", 4, F.max, "high").select("cell", F.round("mean", 6).alias("mean"), "high")


def laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_grid(spark, sf_dir).select("cell", F.round(focal.laplacian("z", 900.0), 8).alias("laplacian"))


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone boundaries by rule: any cells, or both on land."""
    g = order_grid(spark, sf_dir)
    return g.select("cell", focal.boundary("zone").alias("any_cells"), focal.boundary("zone", F.col("land")).alias("both_land"))


def divides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land cells with a land cell of another zone among eight neighbours, and ocean cells with land around."""
    g = order_grid(spark, sf_dir)
    sent = flow.neighbours(g, "zone", "land").where("land").groupBy("r", "c").agg(F.min("zone").alias("low"), F.max("zone").alias("high"))
    met = g.join(sent, ["r", "c"], "left")
    other = F.coalesce((F.col("low") != F.col("zone")) | (F.col("high") != F.col("zone")), F.lit(False))
    return met.select("cell", (F.col("land") & other).alias("divide"), (~F.col("land") & F.col("low").isNotNull()).alias("coast"))


def dilation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dear cells grown by three by three cells; a window maximum of the mask."""
    g = order_grid(spark, sf_dir).withColumn("mask", (F.col("price") > 400_000).cast("int"))
    return focal.extreme(g, "mask", 1, F.max, "grown").select("cell", "mask", "grown")


def block_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = order_grid(spark, sf_dir)
    return focal.block(
        g, 8, F.count("*").alias("n"), F.round(F.avg("z"), 6).alias("mean"), F.max("z").alias("high"), F.bool_or("land").alias("some_land"),
        F.round(F.percentile("z", 0.05), 10).alias("p5"), F.round(F.median("z"), 10).alias("median"),
    )


def refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three by three bilinear refinement, corrected so that each parent keeps its mean."""
    g = order_grid(spark, sf_dir)
    fine = focal.bilinear3(g, "z", "v").join(g.select(F.col("r").alias("pr"), F.col("c").alias("pc"), "z"), ["pr", "pc"])
    return fine.select("r", "c", F.round("v", 6).alias("bilinear"), F.round(F.col("z") + focal.zero_mean("v"), 6).alias("exact"))


def parent_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far block means of the refined raster lie from their parents: nothing but rounding."""
    g = order_grid(spark, sf_dir)
    fine = focal.bilinear3(g, "z", "v").join(g.select(F.col("r").alias("pr"), F.col("c").alias("pc"), "z"), ["pr", "pc"])
    back = fine.withColumn("exact", F.col("z") + focal.zero_mean("v")).groupBy("pr", "pc").agg(F.avg("exact").alias("mean"), F.first("z").alias("z"), F.count("*").alias("n"))
    return back.agg(F.count("*").alias("n_parents"), F.sum("n").alias("n_children"), F.round(F.max(F.abs(F.col("mean") - F.col("z"))), 6).alias("error"))


def summed_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land cells above and to the left of each cell, itself included."""
    g = order_grid(spark, sf_dir).withColumn("x", F.col("land").cast("long"))
    rows = g.withColumn("s", F.sum("x").over(focal.along("c").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select("cell", "r", "c", F.sum("s").over(focal.along("r").rowsBetween(Window.unboundedPreceding, 0)).alias("sat"))


def box_land(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land share of boxes of 16 by 16 cells at a stride of 8, from four corners of the summed-area table."""
    s = summed_area(spark, sf_dir).select("r", "c", "sat")
    n = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(w).alias("w")) for i, j, w in ((16, 16, 1), (0, 16, -1), (16, 0, -1), (0, 0, 1))))
    corner = s.select("sat", (F.col("r") + 1).alias("r"), (F.col("c") + 1).alias("c"), F.explode(n).alias("k"))
    box = corner.select((F.col("r") - F.col("k.i")).alias("r"), (F.col("c") - F.col("k.j")).alias("c"), (F.col("sat") * F.col("k.w")).alias("part"), ((F.col("k.i") == 16) & (F.col("k.j") == 16)).alias("whole"))
    box = box.where("r >= 0 and c >= 0 and r % 8 = 0 and c % 8 = 0").groupBy("r", "c").agg(F.sum("part").alias("n_land"), F.bool_or("whole").alias("whole"))
    return box.where("whole").select("r", "c", "n_land", F.round(F.col("n_land") / 256, 6).alias("share"))


def finite_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = order_grid(spark, sf_dir).select(F.abs(focal.after("z", "c") - F.col("z")).alias("dx"), F.abs(focal.after("z", "r") - F.col("z")).alias("dy"))
    return g.agg(F.count("dx").alias("n_dx"), F.count("dy").alias("n_dy"), F.round(F.avg("dx") + F.avg("dy"), 6).alias("l1"))


def autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = order_grid(spark, sf_dir).withColumn("next", focal.after("price", "c")).where("next is not null")
    return g.groupBy("zone").agg(F.round(F.corr("price", "next"), 8).alias("lag1"))


def overlap_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 16 cells at a stride of 8 along each row, blended with linear ramps."""
    g = order_grid(spark, sf_dir).select("cell", "r", "c", "z")
    tile = F.explode(F.filter(F.array(F.floor(F.col("c") / 8), F.floor(F.col("c") / 8) - 1), lambda t: t >= 0)).alias("tile")
    cut = g.select("*", tile).withColumn("i", F.col("c") - 8 * F.col("tile"))
    v = F.avg("z").over(Window.partitionBy("r", "tile"))
    w = F.greatest(F.lit(1e-3), 1 - F.abs(F.col("i") - 7.5) / 8)
    return cut.select("cell", v.alias("v"), w.alias("w")).groupBy("cell").agg(F.round(F.sum(F.col("w") * F.col("v")) / F.sum("w"), 3).alias("blend"))


def dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of dear cells in row-major order. Rows are counted first, so no task orders them all: ids are the cells
    before a row (a running sum over one count for each row) and the place within it."""
    g = order_grid(spark, sf_dir).where("price > 400000").select("cell", "r", "c")
    per_row = g.groupBy("r").agg(F.count("*").alias("n"))
    start = per_row.select("r", (F.sum("n").over(Window.orderBy("r")) - F.col("n")).alias("start"))
    return g.join(start, "r").select("cell", (F.col("start") + F.row_number().over(focal.along("c")) - 1).alias("id"))


def strided_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previews: every fourth cell of every fourth row, by tile."""
    g = order_grid(spark, sf_dir).where("r % 4 = 0 and c % 4 = 0")
    return g.groupBy(F.floor(F.col("r") / 32).alias("ty"), F.floor(F.col("c") / 32).alias("tx")).agg(F.count("*").alias("n"), F.round(F.avg("z"), 6).alias("mean"))


def best_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box with most land in each strip of 32 rows, ties to the first in row-major order."""
    b = box_land(spark, sf_dir).withColumn("strip", F.floor(F.col("r") / 32))
    best = F.max(F.struct("n_land", (-F.col("r")).alias("r"), (-F.col("c")).alias("c")))
    return b.groupBy("strip").agg(best.alias("x")).select("strip", (-F.col("x.r")).alias("r"), (-F.col("x.c")).alias("c"), "x.n_land")


def coast_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of every cell to the nearest dear cell."""
    g = order_grid(spark, sf_dir).withColumn("dear", F.col("price") > 480_000)
    return distance.distances(g, "dear").select("cell", F.round("distance", 8).alias("distance"))


def dear_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight-connected patches of dear cells: size, box and lowest cell."""
    g = order_grid(spark, sf_dir).where("price > 380000").select("cell", "r", "c", "price")
    p = components.patches(g.select("cell", "r", "c")).join(g, "cell")
    return p.groupBy("patch").agg(F.count("*").alias("n"), F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.min(F.struct("price", "cell"))["cell"].alias("lowest"))


def resumed_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile summaries that one run begins and the next completes: tiles already done are left alone."""
    g = order_grid(spark, sf_dir).select(F.floor(F.col("r") / 16).alias("ty"), F.floor(F.col("c") / 16).alias("tx"), "z")
    path = f"{shared_dir(spark)}/rillspark/tiles-{uuid.uuid4().hex}"
    tiles.append_tiles(g, path, most=3)
    tiles.append_tiles(g, path)
    return spark.read.parquet(path)


def longitudinal_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = order_grid(spark, sf_dir)
    width = g.agg((F.max("c") + 1).alias("width"))
    kept = F.col("c") < F.round(F.col("width") * 0.8)
    return g.join(F.broadcast(width)).groupBy(kept.alias("train")).agg(F.count("*").alias("n"), F.round(F.avg("z"), 6).alias("mean"))


def _fine_sql() -> str:
    def along(x: str, over: str, phase: int) -> str:
        return x if phase == 0 else f"(2 * {x} + coalesce({_lag(x, over, phase > 0)}, {x})) / 3"

    three = ", ".join(f"{along('z', _C, j)} as x{j + 1}" for j in (-1, 0, 1))
    nine = ", ".join(f"{along(f'x{j + 1}', _R, i)} as y{i + 1}{j + 1}" for i in (-1, 0, 1) for j in (-1, 0, 1))
    union = " union all ".join(f"select 3 * r + {1 + i} as r, 3 * c + {1 + j} as c, r as pr, c as pc, z, y{i + 1}{j + 1} as v from y" for i in (-1, 0, 1) for j in (-1, 0, 1))
    return _G + f", x as (select r, c, z, {three} from g), y as materialized (select r, c, z, {nine} from x), f as materialized ({union}) "


_D8 = "d(dr, dc) as (values (0,1),(1,1),(1,0),(1,-1),(0,-1),(-1,-1),(-1,0),(-1,1))"
_DXY = f"select *, {_gradient_sql('z', _C)} as dx, {_gradient_sql('z', _R)} as dy from g"
_LAP = f"(coalesce({_lag('z', _R)}, z) + coalesce({_lag('z', _R, True)}, z) + coalesce({_lag('z', _C)}, z) + coalesce({_lag('z', _C, True)}, z) - 4 * z) / 900.0"


def _edge_sql(extra: str) -> str:
    return " or ".join(f"coalesce({_lag('zone', o, d)} <> zone {extra.format(_lag('land', o, d))}, false)" for o in (_R, _C) for d in (False, True))


def _mean_sql(x: str, k: int, frm: str, name: str) -> str:
    return f"select * exclude (rs), ({_padded_sum_sql('rs', 'c', 'r', k)}) / {(2 * k + 1) ** 2} as {name} from (select *, {_padded_sum_sql(x, 'r', 'c', k)} as rs from {frm})"


def _extreme_sql(x: str, k: int, f: str, frm: str, name: str) -> str:
    w = f"rows between {k} preceding and {k} following"
    return f"select * exclude (rs), {f}(rs) over (partition by c order by r {w}) as {name} from (select *, {f}({x}) over (partition by r order by c {w}) as rs from {frm})"


QUERIES = {
    "terrain_gradient": (terrain_gradient, _G + f", x as ({_DXY}) select cell, round(dx, 12) as dx, round(dy, 12) as dy, round(least(greatest(0.7071067811865476 * cos(atan(sqrt(dx * dx + dy * dy))) + 0.7071067811865476 * sin(atan(sqrt(dx * dx + dy * dy))) * cos(5.497787143782138 - atan2(-dx, dy)), 0.0), 1.0), 6) as shade from x"),
    "terrain_statistics": (terrain_statistics, _G + f""", x as (select *, {_LAP} as lap, sqrt(dx * dx + dy * dy) as s from ({_DXY})) select zone, round(avg(z), 6) as mean, round(stddev_pop(z), 6) as std, min(z) as low, max(z) as high,
 round(max(z) - min(z), 6) as range, round(avg(s), 6) as slope_mean, round(stddev_pop(s), 6) as slope_std, round(sqrt(avg(s * s)), 6) as slope_rms, round(sqrt(avg(lap * lap)), 6) as laplacian_rms from x group by zone"""),
    "padded_gradient": (padded_gradient, _G + f" select cell, round((coalesce({_lag('z', _C, True)}, z) - coalesce({_lag('z', _C)}, z)) / {2 * H}, 12) as dx, round((coalesce({_lag('z', _R, True)}, z) - coalesce({_lag('z', _R)}, z)) / {2 * H}, 12) as dy from g"),
    "local_relief": (local_relief, _G + f""", a as (select *, z * z as zz from g), b as ({_mean_sql('z', 1, 'a', 'mean')}), s as ({_mean_sql('zz', 1, 'b', 'square')}), h as ({_extreme_sql('z', 1, 'max', 's', 'high')}), l as ({_extreme_sql('z', 1, 'min', 'h', 'low')})
 select cell, round(mean, 6) as mean, round(z - mean, 6) as tpi, round(high - low, 6) as relief, round(sqrt(greatest(0.0, square - mean * mean)), 3) as roughness from l"""),
    "wide_mean": (wide_mean, _G + f", b as ({_mean_sql('z', 4, 'g', 'mean')}), h as ({_extreme_sql('z', 4, 'max', 'b', 'high')}) select cell, round(mean, 6) as mean, high from h"),
    "laplacian": (laplacian, _G + f" select cell, round({_LAP}, 8) as laplacian from g"),
    "boundaries": (boundaries, _G + f" select cell, {_edge_sql('')} as any_cells, {_edge_sql('and land and {}')} as both_land from g"),
    "divides": (divides, _G + f""", {_D8}, m as (select t.r + dr as r, t.c + dc as c, min(zone) as low, max(zone) as high from g t, d where land group by 1, 2)
 select cell, land and coalesce(low <> zone or high <> zone, false) as divide, not land and low is not null as coast from g left join m using (r, c)"""),
    "dilation": (dilation, _G + f", a as (select *, cast(price > 400000 as integer) as mask from g), b as ({_extreme_sql('mask', 1, 'max', 'a', 'grown')}) select cell, mask, grown from b"),
    "block_statistics": (block_statistics, _G + " select r // 8 as br, c // 8 as bc, count(*) as n, round(avg(z), 6) as mean, max(z) as high, bool_or(land) as some_land, round(quantile_cont(z, 0.05), 10) as p5, round(median(z), 10) as median from g group by 1, 2"),
    "refined": (refined, _fine_sql() + "select r, c, round(v, 6) as bilinear, round(z + v - avg(v) over (partition by pr, pc), 6) as exact from f"),
    "parent_error": (parent_error, _fine_sql() + ", e as (select pr, pc, z, z + v - avg(v) over (partition by pr, pc) as exact from f), b as (select pr, pc, avg(exact) as mean, any_value(z) as z, count(*) as n from e group by pr, pc) select count(*) as n_parents, cast(sum(n) as bigint) as n_children, round(max(abs(mean - z)), 6) as error from b"),
    "summed_area": (summed_area, _G + " select cell, r, c, cast(sum(s) over (partition by c order by r) as bigint) as sat from (select *, sum(cast(land as bigint)) over (partition by r order by c) as s from g)"),
    "box_land": (box_land, _G + """, b as (select br * 8 as r, bc * 8 as c from (select distinct r // 8 as br, c // 8 as bc from g)), x as (select b.r, b.c, count(*) filter (land) as n_land from b join g on g.r between b.r and b.r + 15 and g.c between b.c and b.c + 15 group by 1, 2)
 select x.r, x.c, n_land, round(n_land / 256, 6) as share from x join g e on e.r = x.r + 15 and e.c = x.c + 15"""),
    "best_crop": (best_crop, _G + """, b as (select br * 8 as r, bc * 8 as c from (select distinct r // 8 as br, c // 8 as bc from g)), x as (select b.r, b.c, count(*) filter (land) as n_land from b join g on g.r between b.r and b.r + 15 and g.c between b.c and b.c + 15 group by 1, 2),
 y as (select x.* from x join g e on e.r = x.r + 15 and e.c = x.c + 15) select r // 32 as strip, r, c, n_land from (select *, row_number() over (partition by r // 32 order by n_land desc, r, c) as k from y) where k = 1"""),
    "coast_distance": (coast_distance, _G + ", m as materialized (select r, c from g where price > 480000) select cell, round(sqrt(min((g.r - m.r) * (g.r - m.r) + (g.c - m.c) * (g.c - m.c))), 8) as distance from g, m group by cell"),
    "dear_patches": (dear_patches, f"with recursive {GRID_SQL}, x as materialized (select cell, r, c, price from g where price > 380000), {_D8}, l as materialized (select x.cell as a, y.cell as b from x, d, x y where y.r = x.r + dr and y.c = x.c + dc)," + """
 w(origin, cell) as (select cell, cell from x union select w.origin, l.b from w join l on w.cell = l.a), p as (select cell, min(origin) as patch from w group by cell)
 select patch, count(*) as n, min(r) as r0, max(r) as r1, min(c) as c0, max(c) as c1, min(struct_pack(p := price, k := cell)).k as lowest from p join x using (cell) group by patch"""),
    "resumed_tiles": (resumed_tiles, _G + " select r // 16 as ty, c // 16 as tx, count(*) as n, round(avg(z), 6) as mean, min(z) as low, max(z) as high from g group by 1, 2"),
    "finite_differences": (finite_differences, _G + f", x as (select abs({_lag('z', _C, True)} - z) as dx, abs({_lag('z', _R, True)} - z) as dy from g) select count(dx) as n_dx, count(dy) as n_dy, round(avg(dx) + avg(dy), 6) as l1 from x"),
    "autocorrelation": (autocorrelation, _G + f", x as (select zone, price, {_lag('price', _C, True)} as nxt from g) select zone, round(corr(price, nxt), 8) as lag1 from x where nxt is not null group by zone"),
    "overlap_blend": (overlap_blend, _G + """, t as (select cell, r, c, z, c // 8 as tile from g union all select cell, r, c, z, c // 8 - 1 from g where c // 8 >= 1),
 x as (select cell, avg(z) over (partition by r, tile) as v, greatest(1e-3, 1 - abs(c - 8 * tile - 7.5) / 8) as w from t) select cell, round(sum(w * v) / sum(w), 3) as blend from x group by cell"""),
    "dense_ids": (dense_ids, _G + " select cell, row_number() over (order by cell) - 1 as id from g where price > 400000"),
    "strided_window": (strided_window, _G + " select r // 32 as ty, c // 32 as tx, count(*) as n, round(avg(z), 6) as mean from g where r % 4 = 0 and c % 4 = 0 group by 1, 2"),
    "longitudinal_holdout": (longitudinal_holdout, _G + ", w as (select max(c) + 1 as width from g) select c < round(width * 0.8) as train, count(*) as n, round(avg(z), 6) as mean from g, w group by 1"),
}
