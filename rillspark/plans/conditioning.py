"""Queries of model conditioning: vectors, encodings, composition, refinement stacks, crops and tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillspark.functions import hydrology as hy
from rillspark.operators import focal
from rillspark.plans.raster import summed_area
from rillspark.sources.grids import GRID_SQL, RESOLUTION_M, columns, order_grid, table

H = RESOLUTION_M
_G = f"with {GRID_SQL} "
#: Normalisation constants of two channels of the test grids: mean and spread.
_NORM = {"z": (1200.0, 700.0), "precip": (1450.0, 430.0)}


def flow_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors of D8 codes and the codes they give back; every fifth vector is too weak to give one."""
    code = F.pmod("cell", F.lit(9)).cast("int")
    east, south = hy.flow_vector(code)
    weak = F.when(F.col("cell") % 5 == 0, 0.1).otherwise(1.0)
    g = order_grid(spark, sf_dir).select("cell", code.alias("code"), east.alias("east"), south.alias("south"), weak.alias("weak"))
    return g.select("cell", "code", F.round("east", 9).alias("east"), F.round("south", 9).alias("south"), hy.flow_code(F.col("east") * F.col("weak"), F.col("south") * F.col("weak")).alias("back"))


def decoder_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage, bed offset, normalised channels and clean precipitation of every cell."""
    z, p = F.col("z"), F.col("precip")
    distance, width = F.pmod(F.col("cell") * 37, F.lit(200)), 2.0 + F.pmod("cell", F.lit(118))
    odd = F.when(F.col("cell") % 7 == 0, F.lit(float("nan"))).when(F.col("cell") % 11 == 0, F.lit(float("inf"))).otherwise(p)
    scaled = [(c - m) / s for c, (m, s) in ((z, _NORM["z"]), (p, _NORM["precip"]))]
    return order_grid(spark, sf_dir).select(
        "cell", F.round(hy.coverage(width, distance, 10.0), 9).alias("coverage"), F.round(hy.bed_offset(z - F.pmod("cell", F.lit(40)), z, hy.corridor(distance)) + F.lit(0.0), 9).alias("bed_offset"),
        F.round(scaled[0], 9).alias("z_scaled"), F.round(scaled[1], 9).alias("precip_scaled"), F.round(scaled[0] * _NORM["z"][1] + _NORM["z"][0], 6).alias("z_back"), hy.clean_precipitation(odd, F.col("land")).alias("precip"),
    )


def composed_terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a refinement may change: residuals off anchors, terrain between base and candidate, lake caps, cuts that never raise."""
    z = F.col("z")
    anchor, lake = F.col("cell") % 6 == 0, ~F.col("land")
    applied, suppressed = hy.supported(F.col("price") / 1e6 - 0.2, anchor | lake)
    freedom, candidate = F.pmod("cell", F.lit(5)) / 4, z + F.pmod("cell", F.lit(13)) - 6
    cut, raised = hy.incised(z, F.pmod("cell", F.lit(4)).cast("double"), anchor, F.when(F.col("cell") % 12 != 0, z - 3 + F.pmod("cell", F.lit(30)) / 7))
    return order_grid(spark, sf_dir).select(
        "cell", F.round(applied, 9).alias("applied"), F.round(suppressed, 9).alias("suppressed"), F.round(hy.constrained(z, candidate, freedom, lake, z), 6).alias("composed"), F.round(cut, 6).alias("cut"), raised.alias("raised"),
    )


def safe_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in text, read as floats, whole numbers, finite numbers and positive ones."""
    forms = F.array(*map(F.lit, ("12.75", "x", "", " 7 ", "-3.5", "1e400", "0")), F.lit(None).cast("string"), F.concat(F.col("p_size").cast("string"), F.lit(".5")))
    t = table(spark, sf_dir, "part").select("p_brand", F.element_at(forms, F.pmod("p_partkey", F.lit(9)).cast("int") + 1).alias("x"))
    x = F.col("x")
    return t.groupBy("p_brand").agg(
        F.count("*").alias("n"), F.count(hy.numeric(x)).alias("n_numeric"), F.count(hy.positive(x)).alias("n_positive"), F.round(F.sum(hy.numeric(x)), 4).alias("total"), F.sum(hy.as_int(x)).alias("whole"),
        F.round(F.min(hy.as_float(x)), 4).alias("least"), F.count_if(x.isin("x", "0")).alias("n_listed"),
    )


def seed_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of seeds in text: their numbers, and whether any comes twice."""
    k = F.col("s_suppkey")
    text = F.concat_ws(",", (k % 7).cast("string"), F.lit(" "), F.concat(F.lit(" "), (k % 5).cast("string"), F.lit(" ")), F.lit(""), (k % 3 + 10).cast("string"))
    seeds = F.transform(F.filter(F.transform(F.split(text, ","), lambda s: F.trim(s)), lambda s: s != ""), lambda s: s.cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.size(seeds).alias("n"), (F.size(F.array_distinct(seeds)) < F.size(seeds)).alias("repeats"), F.aggregate(seeds, F.lit(0), lambda a, b: a + b).alias("total"))


def origins(length: Column, tile: int, stride: int) -> Column:
    """Starts of tiles along a length, the last one forced to end with it."""
    return F.array_union(F.sequence(F.lit(0).cast("long"), length - tile, F.lit(stride).cast("long")), F.array(length - tile))


def tile_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "customer").select("c_custkey", origins(F.lit(40) + F.pmod("c_custkey", F.lit(60)), 32, 24).alias("at"))
    return t.select("c_custkey", F.posexplode("at").alias("k", "origin"))


def whole_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int]:
    """The order grid without its short last row, and its height and width."""
    n = columns(spark, sf_dir)
    height = table(spark, sf_dir, "orders").count() // n
    return order_grid(spark, sf_dir).where(F.col("r") < height), height, n


def dihedral_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 16 by 16 cells flipped and turned in all eight ways, each summed up by the order of its cells."""
    g, height, width = whole_rows(spark, sf_dir)
    g = g.where((F.col("r") < height // 16 * 16) & (F.col("c") < width // 16 * 16))
    r, c, last = F.pmod("r", F.lit(16)), F.pmod("c", F.lit(16)), F.lit(15)
    ways = []
    for t in range(8):
        i, j = r, last - c if t >= 4 else c
        for _ in range(t % 4):
            i, j = last - j, i
        ways.append(F.struct(F.lit(t).alias("way"), (i * 16 + j).alias("at")))
    x = g.select(F.floor(F.col("r") / 16).alias("br"), F.floor(F.col("c") / 16).alias("bc"), "price", F.explode(F.array(*ways)).alias("w"))
    return x.groupBy("br", "bc", "w.way").agg(F.round(F.sum(F.col("price") * F.col("w.at")), 2).alias("total"), F.round(F.max(F.when(F.col("w.at") == 0, F.col("price"))), 2).alias("first"))


def forced_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land share of boxes of 16 by 16 cells at a stride of 8, with those that end in the last row and column, and its class."""
    _, height, width = whole_rows(spark, sf_dir)
    s = summed_area(spark, sf_dir).where(F.col("r") < height).select("r", "c", "sat")
    n = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(w).alias("w")) for i, j, w in ((16, 16, 1), (0, 16, -1), (16, 0, -1), (0, 0, 1))))
    box = s.select("sat", F.explode(n).alias("k"), (F.col("r") + 1).alias("r"), (F.col("c") + 1).alias("c")).select((F.col("r") - F.col("k.i")).alias("r"), (F.col("c") - F.col("k.j")).alias("c"), (F.col("sat") * F.col("k.w")).alias("part"))
    start = lambda x, most: F.col(x).between(0, most) & ((F.col(x) % 8 == 0) | (F.col(x) == most))
    box = box.where(start("r", height - 16) & start("c", width - 16)).groupBy("r", "c").agg(F.sum("part").alias("n_land"))
    share = F.col("n_land") / 256
    return box.select("r", "c", "n_land", F.round(share, 6).alias("share"), sum((share >= b).cast("int") for b in (0.9, 0.96, 0.98)).alias("class"))


def best_mountain_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over every position of 8 by 8 cells, the best by relief, range and gradient in each strip of 32 rows; ties to the first in row-major order."""
    g, height, width = whole_rows(spark, sf_dir)
    g = g.select("r", "c", (F.col("price") / 1e3).alias("m"), (F.col("precip") / 100).alias("relief"))
    right, down = F.lead("m").over(focal.along("c")), F.lead("m").over(focal.along("r"))
    g = g.select("*", ((right - F.col("m")) * (right - F.col("m"))).alias("dx"), ((down - F.col("m")) * (down - F.col("m"))).alias("dy"))

    def over(axis: str, short: str) -> DataFrame:
        w = {n: focal.along(axis).rowsBetween(0, n) for n in (6, 7)}
        named = [(F.sum, "relief", 7), (F.max, "high", 7), (F.min, "low", 7), (F.sum, "dx", 6 if short == "dx" else 7), (F.sum, "dy", 6 if short == "dy" else 7)]
        return [f(n).over(w[k]).alias(n) for f, n, k in named]

    g = g.withColumns({"high": F.col("m"), "low": F.col("m")}).select("r", "c", *over("c", "dx"))
    g = g.select("r", "c", *over("r", "dy")).where((F.col("r") <= height - 8) & (F.col("c") <= width - 8))
    score = F.round(F.col("relief") / 64 + 0.5 * (F.col("high") - F.col("low")) + 0.5 * F.sqrt((F.col("dx") + F.col("dy")) / 112), 6)
    best = g.groupBy(F.floor(F.col("r") / 32).alias("strip")).agg(F.max(F.struct(score.alias("score"), (-F.col("r")).alias("r"), (-F.col("c")).alias("c"))).alias("x"))
    return best.select("strip", (-F.col("x.r")).alias("r"), (-F.col("x.c")).alias("c"), "x.score")


def sine_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 16 cells at a stride of 8 along each row, each with its own offset, blended by squared sines."""
    g = order_grid(spark, sf_dir).select("cell", "c", "z")
    t = g.select("cell", "c", "z", F.explode(F.array(F.floor(F.col("c") / 8), F.floor(F.col("c") / 8) - 1)).alias("tile")).where("tile >= 0")
    s = F.sin(F.lit(3.141592653589793) * (F.col("c") - 8 * F.col("tile") + 0.5) / 16)
    w = 1e-3 + 0.999 * s * s
    return t.groupBy("cell").agg(F.round(F.sum(w * (F.col("z") + F.pmod("tile", F.lit(3)))) / F.sum(w), 6).alias("blended"))


def coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(r, c, v, wet): means of 16 by 16 blocks of the order grid, and whether much of a block is ocean."""
    return focal.block(order_grid(spark, sf_dir), 16, F.avg("precip").alias("v"), (F.count_if(~F.col("land")) > 6).alias("wet")).select(F.col("br").alias("r"), F.col("bc").alias("c"), "v", "wet")


def zoomed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block means refined eight times by bilinear interpolation between centres, clamped at edges and at 0."""
    return focal.bilinear(coarse(spark, sf_dir).withColumn("v", F.col("v") - 1400), "v", 8).select("r", "c", F.round(F.greatest("v", F.lit(0.0)), 6).alias("v"))


def lake_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coarse lake mask refined three times: bilinear coverage, and lake from a half on."""
    fine = focal.bilinear(coarse(spark, sf_dir).withColumn("v", F.col("wet").cast("double")), "v", 3)
    return fine.select("r", "c", F.round("v", 9).alias("coverage"), (F.col("v") >= 0.5 - 1e-12).alias("lake"))


def hydrology_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven hydrology channels refined three times: logs and vectors bilinearly, masks and orders by their parent."""
    code = F.pmod("cell", F.lit(9)).cast("int")
    east, south = hy.flow_vector(code)
    g = order_grid(spark, sf_dir).select(
        "r", "c", (F.col("price") > 300000).cast("int").alias("channel"), F.log1p("price").alias("log_area"), F.log1p(F.col("precip") / 1e3).alias("log_q"), east.alias("east"), south.alias("south"),
        (F.pmod("cell", F.lit(4)) + 1).cast("int").alias("stream_order"), (~F.col("land")).cast("int").alias("lake"),
    )
    smooth = focal.bilinear3_all(g, ["log_area", "log_q", "east", "south"])
    kept = g.select(F.col("r").alias("pr"), F.col("c").alias("pc"), "channel", "stream_order", "lake")
    return smooth.join(kept, ["pr", "pc"]).select("r", "c", "channel", *(F.round(x, 7).alias(x) for x in ("log_area", "log_q", "east", "south")), "stream_order", "lake")


def terrain_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirteen terrain channels of nine children of each cell: exact and repeated parent, gradients, position indices,
    relief and roughness over 3 and 9 cells, the child's place, and curvature."""
    g = order_grid(spark, sf_dir).select("r", "c", "z").withColumn("zz", F.col("z") * F.col("z"))
    # all windows along rows first, then all along columns: two shuffles
    windows, whole = ((1, "3"), (4, "9")), {"mean": ("z", focal.padded_sum), "square": ("zz", focal.padded_sum), "high": ("z", F.max), "low": ("z", F.min)}

    def over(x: str, f, axis: str, k: int) -> Column:
        return f(x, axis, k) if f is focal.padded_sum else f(x).over(focal.along(axis).rowsBetween(-k, k))

    sides = {"west": F.coalesce(focal.before("z", "c"), F.col("z")), "east": F.coalesce(focal.after("z", "c"), F.col("z"))}
    g = g.withColumns({f"{what}{name}": over(x, f, "c", k) for k, name in windows for what, (x, f) in whole.items()} | {"dx": focal.padded_gradient("z", "c", H)} | sides)
    area = lambda f, k: (2 * k + 1) ** 2 if f is focal.padded_sum else 1
    north, south = F.coalesce(focal.before("z", "r"), F.col("z")), F.coalesce(focal.after("z", "r"), F.col("z"))
    curvature = (north + south + F.col("west") + F.col("east") - 4 * F.col("z")) / 900.0
    g = g.withColumns({f"{what}{name}": over(f"{what}{name}", f, "r", k) / area(f, k) for k, name in windows for what, (_, f) in whole.items()} | {"dy": focal.padded_gradient("z", "r", H), "curvature": curvature})
    parts = {x: F.col(x) for x in ("dx", "dy", "curvature")}
    for name in ("3", "9"):
        parts |= {f"tpi{name}": F.col("z") - F.col(f"mean{name}"), f"relief{name}": F.col(f"high{name}") - F.col(f"low{name}")}
        parts[f"rough{name}"] = F.sqrt(F.greatest(F.col(f"square{name}") - F.col(f"mean{name}") * F.col(f"mean{name}"), F.lit(0.0)))
    g = g.select("r", "c", "z", F.col("z").alias("parent"), *(v.alias(k) for k, v in parts.items()))
    fine = focal.bilinear3_all(g, ["z", *parts], ("parent",), ("z",))
    exact = F.col("parent") + (F.col("z") - F.col("mean_z"))
    return fine.select(
        "r", "c", F.round(exact, 6).alias("exact"), "parent", *((F.round(k, 6) + 0.0).alias(k) for k in parts),  # no zero with a sign
        (F.pmod("c", F.lit(3)) - 1).alias("phase_x"), (F.pmod("r", F.lit(3)) - 1).alias("phase_y"),
    )


_D8_SQL = "d(code, dr, dc) as (values (1,0,1),(2,1,1),(3,1,0),(4,1,-1),(5,0,-1),(6,-1,-1),(7,-1,0),(8,-1,1))"
_VEC = "coalesce(d.dc / sqrt(d.dr * d.dr + d.dc * d.dc), 0.0) as east, coalesce(d.dr / sqrt(d.dr * d.dr + d.dc * d.dc), 0.0) as south"
_WHOLE = _G + ", hw as (select max(n) as w, count(*) // max(n) as h from g, n), "


def _zoom_sql(k: int, frm: str, x: str) -> str:
    """Bilinear interpolation of a table (r, c, x) by k; coordinates are clamped to the table."""
    def at(axis: str) -> str:
        s = f"(({axis}.i + 0.5) / {k} - 0.5)"
        return f"cast(floor({s}) as bigint) as lo, {s} - floor({s}) as f"

    return f"""lim as (select max(r) as mr, max(c) as mc from {frm}),
 rr as (select i, least(greatest(lo, 0), mr) as a, least(greatest(lo + 1, 0), mr) as b, f from (select i.i, {at('i')} from lim, range((mr + 1) * {k}) i(i)), lim),
 cc as (select i, least(greatest(lo, 0), mc) as a, least(greatest(lo + 1, 0), mc) as b, f from (select i.i, {at('i')} from lim, range((mc + 1) * {k}) i(i)), lim),
 zm as (select rr.i as r, cc.i as c, (1 - rr.f) * ((1 - cc.f) * p.{x} + cc.f * q.{x}) + rr.f * ((1 - cc.f) * s.{x} + cc.f * t.{x}) as v from rr, cc
  join {frm} p on p.r = rr.a and p.c = cc.a join {frm} q on q.r = rr.a and q.c = cc.b join {frm} s on s.r = rr.b and s.c = cc.a join {frm} t on t.r = rr.b and t.c = cc.b)"""


def _fine_sql(xs: list[str], kept: list[str]) -> str:
    """From a table s(r, c, xs, kept): all nine children, xs bilinear, kept from the parent."""
    def along(x: str, over: str, phase: int) -> str:
        return x if phase == 0 else f"(2 * {x} + coalesce({'lead' if phase > 0 else 'lag'}({x}) over {over}, {x})) / 3"

    rows, cols = "(partition by c order by r)", "(partition by r order by c)"
    three = ", ".join(f"{along(x, cols, j)} as {x}_{j + 1}" for x in xs for j in (-1, 0, 1))
    nine = ", ".join(f"{along(f'{x}_{j + 1}', rows, i)} as {x}_{i + 1}{j + 1}" for x in xs for i in (-1, 0, 1) for j in (-1, 0, 1))
    k = "".join(f", {x}" for x in kept)
    union = " union all ".join(f"select 3 * r + {1 + i} as r, 3 * c + {1 + j} as c, r as pr, c as pc{k}, " + ", ".join(f"{x}_{i + 1}{j + 1} as {x}" for x in xs) + " from y" for i in (-1, 0, 1) for j in (-1, 0, 1))
    return f"x as materialized (select r, c{k}, {three} from s), y as materialized (select r, c{k}, {nine} from x), fine as materialized ({union})"


def _stack_sql() -> str:
    from rillspark.plans.raster import _extreme_sql, _mean_sql, _LAP

    steps, frm = [], "z0"
    for k, name in ((1, "3"), (4, "9")):
        for what, sql in ((f"mean{name}", _mean_sql("z", k, frm, f"mean{name}")), (f"square{name}", None), (f"high{name}", None), (f"low{name}", None)):
            if sql is None:
                sql = _mean_sql("zz", k, frm, what) if what.startswith("square") else _extreme_sql("z", k, "max" if what.startswith("high") else "min", frm, what)
            frm = f"t_{what}"
            steps.append(f"{frm} as materialized ({sql})")
    side = lambda x, over: f"coalesce(lead({x}) over {over}, {x}) - coalesce(lag({x}) over {over}, {x})"
    rows, cols = "(partition by c order by r)", "(partition by r order by c)"
    parts = {"dx": f"({side('z', cols)}) / {2 * H}", "dy": f"({side('z', rows)}) / {2 * H}", "curvature": _LAP}
    for name in ("3", "9"):
        parts |= {f"tpi{name}": f"z - mean{name}", f"relief{name}": f"high{name} - low{name}", f"rough{name}": f"sqrt(greatest(square{name} - mean{name} * mean{name}, 0.0))"}
    s = "s as materialized (select r, c, z, z as parent, " + ", ".join(f"{v} as {k}" for k, v in parts.items()) + f" from {frm})"
    rounded = ", ".join(f"round({k}, 6) + 0.0 as {k}" for k in parts)
    return _G + ", z0 as (select *, z * z as zz from g), " + ", ".join(steps) + f", {s}, " + _fine_sql(["z", *parts], ["parent"]) + f" select r, c, round(parent + z - avg(z) over (partition by pr, pc), 6) as exact, parent, {rounded}, c % 3 - 1 as phase_x, r % 3 - 1 as phase_y from fine"


QUERIES = {
    "flow_vectors": (flow_vectors, f"with {GRID_SQL}, {_D8_SQL}, v as (select g.cell, cast(g.cell % 9 as integer) as code, {_VEC}, case when g.cell % 5 = 0 then 0.1 else 1.0 end as weak from g left join d on g.cell % 9 = d.code) select v.cell, v.code, round(east, 9) as east, round(south, 9) as south, cast(case when abs(east * weak) + abs(south * weak) < 0.25 then 0 else v.code end as integer) as back from v"),
    "decoder_fields": (decoder_fields, _G + f""", x as (select *, (cell * 37) % 200 as d, 2.0 + cell % 118 as w from g) select cell, round(least(greatest((0.5 * w + 5.0 - d) / 10.0, 0.0), 1.0), 9) as coverage,
 round(tanh(-(cell % 40) / 32.0) * case when d <= 150 then exp(-0.5 * (d / 60.0) * (d / 60.0)) else 0.0 end + 0.0, 9) as bed_offset, round((z - {_NORM['z'][0]}) / {_NORM['z'][1]}, 9) as z_scaled, round((precip - {_NORM['precip'][0]}) / {_NORM['precip'][1]}, 9) as precip_scaled,
 round((z - {_NORM['z'][0]}) / {_NORM['z'][1]} * {_NORM['z'][1]} + {_NORM['z'][0]}, 6) as z_back, case when cell % 7 = 0 or cell % 11 = 0 or not land then 0.0 else cast(precip as double) end as precip from x"""),
    "composed_terrain": (composed_terrain, _G + """, x as (select *, cell % 6 = 0 as anchor, not land as lake, price / 1e6 - 0.2 as res, z + (cell % 4) / 4.0 * 0 as base, cast(case when cell % 12 <> 0 then z - 3 + (cell % 30) / 7.0 end as double) as target from g),
 y as (select *, z + (cell % 5) / 4.0 * (z + cell % 13 - 6 - z) as moved, case when anchor and target is not null then target else z - cell % 4 end as new from x)
 select cell, round(case when anchor or lake then 0.0 else res end, 9) as applied, round(case when anchor or lake then res else 0.0 end, 9) as suppressed, round(case when lake then least(moved, z - 1.0) else moved end, 6) as composed,
 round(least(new, z), 6) as cut, new > z + greatest(1e-5, 2 * pow(2.0, floor(log2(abs(z))) - 23)) as raised from y"""),
    "safe_casts": (safe_casts, """with t as (select p_brand, case p_partkey % 9 when 0 then '12.75' when 1 then 'x' when 2 then '' when 3 then ' 7 ' when 4 then '-3.5' when 5 then '1e400' when 6 then '0' when 8 then p_size::varchar || '.5' end as x from part),
 n as (select p_brand, x, case when isfinite(try_cast(trim(x) as double)) then try_cast(trim(x) as double) end as v from t)
 select p_brand, count(*) as n, count(v) as n_numeric, count(*) filter (v > 0) as n_positive, round(sum(v), 4) as total, cast(sum(coalesce(trunc(v), 0)) as bigint) as whole, round(min(coalesce(v, case when x = '1e400' then 1e308 else 0.0 end)), 4) as least, count(*) filter (x in ('x', '0')) as n_listed from n group by p_brand"""),
    "seed_lists": (seed_lists, "with s as (select s_suppkey, [s_suppkey % 7, s_suppkey % 5, s_suppkey % 3 + 10] as l from supplier) select s_suppkey, cast(len(l) as integer) as n, len(list_distinct(l)) < len(l) as repeats, cast(list_sum(l) as integer) as total from s"),
    "tile_origins": (tile_origins, "with t as (select c_custkey, 40 + c_custkey % 60 - 32 as most from customer), o as (select distinct c_custkey, unnest(list_append(range(0, most + 1, 24), most)) as origin from t) select c_custkey, cast(row_number() over (partition by c_custkey order by origin) - 1 as integer) as k, origin from o"),
    "dihedral_blocks": (dihedral_blocks, _WHOLE + "b as (select r // 16 as br, c // 16 as bc, r % 16 as r, c % 16 as c, price from g, hw where r < h // 16 * 16 and c < w // 16 * 16), " + "f as (select br, bc, price, r, c, 0 as way from b union all select br, bc, price, r, 15 - c, 4 from b), "
     "e as (select br, bc, price, way, r, c from f union all select br, bc, price, way + 1, 15 - c, r from f union all select br, bc, price, way + 2, 15 - r, 15 - c from f union all select br, bc, price, way + 3, c, 15 - r from f) "
     "select br, bc, cast(way as integer) as way, round(sum(price * (r * 16 + c)), 2) as total, round(max(price) filter (r = 0 and c = 0), 2) as first from e group by br, bc, way"),
    "forced_boxes": (forced_boxes, _WHOLE + """br as (select distinct unnest(list_append(range(0, h - 15, 8), h - 16)) as r from hw), bc as (select distinct unnest(list_append(range(0, w - 15, 8), w - 16)) as c from hw),
 x as (select br.r, bc.c, count(*) filter (g.land) as n_land from br, bc, g where g.r between br.r and br.r + 15 and g.c between bc.c and bc.c + 15 group by br.r, bc.c)
 select r, c, n_land, round(n_land / 256, 6) as share, cast((n_land / 256 >= 0.9)::int + (n_land / 256 >= 0.96)::int + (n_land / 256 >= 0.98)::int as integer) as class from x"""),
    "best_mountain_crop": (best_mountain_crop, _WHOLE + """m as materialized (select r, c, price / 1e3 as m, precip / 100 as relief from g, hw where r < h),
 e as materialized (select *, lead(m) over (partition by r order by c) - m as dx, lead(m) over (partition by c order by r) - m as dy from m),
 a as materialized (select r, c, sum(relief) over w7 as relief, max(m) over w7 as high, min(m) over w7 as low, sum(dx * dx) over w6 as dx, sum(dy * dy) over w7 as dy from e
  window w7 as (partition by r order by c rows between current row and 7 following), w6 as (partition by r order by c rows between current row and 6 following)),
 b as (select r, c, sum(relief) over w7 as relief, max(high) over w7 as high, min(low) over w7 as low, sum(dx) over w7 as dx, sum(dy) over w6 as dy from a
  window w7 as (partition by c order by r rows between current row and 7 following), w6 as (partition by c order by r rows between current row and 6 following)),
 s as (select r, c, round(relief / 64 + 0.5 * (high - low) + 0.5 * sqrt((dx + dy) / 112), 6) as score from b, hw where r <= h - 8 and c <= w - 8)
 select r // 32 as strip, r, c, score from s qualify row_number() over (partition by r // 32 order by score desc, r, c) = 1"""),
    "sine_blend": (sine_blend, _G + """, t as (select cell, c, z, c // 8 as tile from g union all select cell, c, z, c // 8 - 1 from g where c >= 8), v as (select *, sin(pi() * (c - 8 * tile + 0.5) / 16) as s from t)
 select cell, round(sum((1e-3 + 0.999 * s * s) * (z + tile % 3)) / sum(1e-3 + 0.999 * s * s), 6) as blended from v group by cell"""),
    "zoomed": (zoomed, _G + ", b as (select r // 16 as r, c // 16 as c, avg(precip) - 1400 as v from g group by 1, 2), " + _zoom_sql(8, "b", "v") + " select r, c, round(greatest(v, 0.0), 6) as v from zm"),
    "lake_coverage": (lake_coverage, _G + ", b as (select r // 16 as r, c // 16 as c, cast(count(*) filter (not land) > 6 as integer)::double as v from g group by 1, 2), " + _zoom_sql(3, "b", "v") + " select r, c, round(v, 9) as coverage, v >= 0.5 - 1e-12 as lake from zm"),
    "hydrology_stack": (hydrology_stack, f"with {GRID_SQL}, {_D8_SQL}, s as materialized (select g.r, g.c, cast(price > 300000 as integer) as channel, ln(1 + price) as log_area, ln(1 + precip / 1e3) as log_q, {_VEC}, cast(cell % 4 + 1 as integer) as stream_order, cast(not land as integer) as lake from g left join d on g.cell % 9 = d.code), "
     + _fine_sql(["log_area", "log_q", "east", "south"], ["channel", "stream_order", "lake"]) + " select r, c, channel, round(log_area, 7) as log_area, round(log_q, 7) as log_q, round(east, 7) as east, round(south, 7) as south, stream_order, lake from fine"),
    "terrain_stack": (terrain_stack, _stack_sql()),
}
