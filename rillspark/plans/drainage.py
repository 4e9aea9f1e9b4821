"""Queries over flow forests: receivers, accumulation, catchments, orders, networks, slopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillspark.functions import hydrology as hy
from rillspark.functions import identity
from rillspark.operators import components, fill, flow, relational
from rillspark.operators import statistics as st
from rillspark.sources.grids import GRID_SQL, RESOLUTION_M, order_grid
from rillspark.sources.shared import written

AREA = RESOLUTION_M * RESOLUTION_M
#: Channel threshold of the ramp grids, which are smaller than a planner region.
CHANNEL_M2 = 8 * AREA

FLOW_SQL = f"""with recursive {GRID_SQL},
d(code, dr, dc) as (values (1,0,1),(2,1,1),(3,1,0),(4,1,-1),(5,0,-1),(6,-1,-1),(7,-1,0),(8,-1,1)),
s as materialized (select g.cell, g.z, g.r + d.dr as r, g.c + d.dc as c, d.code from g, d),
m as materialized (select s.cell, any_value(s.z) as z, count(*) as n, min(struct_pack(h := t.z, cell := t.cell, code := s.code)) as low
 from s join g t on s.r = t.r and s.c = t.c group by s.cell),
f as materialized (select g.*, case when m.n = 8 and (m.low.h, m.low.cell) < (g.z, g.cell) then m.low.cell end as receiver,
 case when m.n = 8 and (m.low.h, m.low.cell) < (g.z, g.cell) then m.low.code else 0 end as code from g left join m on g.cell = m.cell),
up as (select cell as origin, cell, 0 as steps from f union all select up.origin, f.receiver, up.steps + 1 from up join f on up.cell = f.cell where f.receiver is not null),
a as materialized (select up.cell, count(*) * {AREA} as area, sum(o.precip / 1000.0 * {hy.RUNOFF_RATIO} * {AREA} / {hy.SECONDS_PER_YEAR}) as q from up join g o on up.origin = o.cell group by up.cell),
o as materialized (select origin as cell, max_by(cell, steps) as outlet, max(steps) as steps from up group by origin)"""


def forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(flow.receivers(order_grid(spark, sf_dir)), "forest")


def areas(f: DataFrame) -> DataFrame:
    """The forest with accumulated area and discharge."""
    weights = f.withColumns({"w_area": F.lit(AREA), "w_q": hy.local_discharge(F.col("precip"), RESOLUTION_M)})
    return f.join(flow.accumulate(weights, area=F.col("w_area"), q=F.col("w_q")), "cell")


def d8_receivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.receivers(order_grid(spark, sf_dir)).select("cell", "code", "receiver")


def flow_accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return areas(forest(spark, sf_dir)).select("cell", "area")


def mean_discharge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return areas(forest(spark, sf_dir)).select("cell", F.round("q", 6).alias("q"), F.round(hy.hydraulic_width(F.col("q")), 5).alias("width"))


def catchments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.outlets(forest(spark, sf_dir)).groupBy("outlet").agg(F.count("*").alias("n_cells"), F.max("steps").alias("longest"))


def flow_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.outlets(forest(spark, sf_dir)).select("cell", "outlet", "steps")


def channel_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells over the threshold, plainly and where they also flow on over land."""
    a = areas(forest(spark, sf_dir))
    over = F.col("area") >= CHANNEL_M2
    return a.groupBy("zone").agg(F.count_if(over).alias("n_over"), F.count_if(over & F.col("code").between(1, 8)).alias("n_flowing"), F.count_if(over & F.col("land")).alias("n_land"))


def area_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What terminals collect against the area of all cells."""
    a = areas(forest(spark, sf_dir))
    return a.agg(F.sum(F.when(F.col("receiver").isNull(), F.col("area"))).alias("collected"), (F.count("*") * AREA).alias("area"))


def stream_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.strahler(forest(spark, sf_dir)).groupBy("stream_order").agg(F.count("*").alias("n_cells"))


def channel_network(f: DataFrame) -> DataFrame:
    """(cell, code, receiver, area, q, z, upstream, kind) of channel cells; kind is null between nodes."""
    ch = written(areas(f).where((F.col("area") >= CHANNEL_M2) & F.col("code").between(1, 8)), "channels")
    ups = ch.groupBy(F.col("receiver").alias("cell")).agg(F.count("*").alias("upstream"))
    downs = ch.select(F.col("cell").alias("receiver"), F.lit(True).alias("flows_on"))
    ch = ch.join(ups, "cell", "left").join(downs, "receiver", "left").withColumns({"upstream": F.coalesce("upstream", F.lit(0)), "flows_on": F.coalesce("flows_on", F.lit(False))})
    return ch.withColumn("kind", F.when(~F.col("flows_on"), "outlet").when(F.col("upstream") == 0, "source").when(F.col("upstream") > 1, "junction"))


def river_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channel_network(forest(spark, sf_dir)).where("kind is not null").select("cell", "kind", "upstream")


def river_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains between nodes as one edge each: the node it ends in, its cells, length, and discharge where it ends.

    A chain's cells all reach the same next node first; cutting the forest at
    nodes makes that node their outlet, found by pointer doubling.
    """
    ch = channel_network(forest(spark, sf_dir))
    ch = written(ch.select("cell", "code", "receiver", "q", "kind"), "network")
    cut_at = ch.select("cell", F.when(F.col("kind").isNull(), F.col("receiver")).alias("receiver"))
    ends = flow.outlets(cut_at).select("cell", F.col("outlet").alias("ends"))
    # an edge starts at a node and takes the way of the node's receiver
    begins = ch.where("kind is not null and kind <> 'outlet'").select(F.col("cell").alias("begins"), F.col("receiver").alias("cell"), flow.step_length(F.col("code"), RESOLUTION_M).alias("first"))
    last = ch.select(F.col("cell").alias("ends"), F.col("q").alias("end_q"))
    inner = ch.where("kind is null").select("cell", flow.step_length(F.col("code"), RESOLUTION_M).alias("len"))
    chain = inner.join(ends, "cell")
    # of a chain's cells exactly those upstream of its node belong to the edge that enters there: split by the first cell
    tops = begins.join(ends, "cell")
    ups = ch.where("kind is null").select("cell", F.col("receiver").alias("to"))
    heads = flow.outlets(
        ups.join(begins.select("cell", F.lit(True).alias("head")), "cell", "left").select(F.col("to").alias("cell"), F.col("cell").alias("receiver"))
        .unionByName(begins.select("cell", F.lit(None).cast("long").alias("receiver"))).groupBy("cell").agg(F.max("receiver").alias("receiver"))
    ).select("cell", F.col("outlet").alias("head"))
    lengths = chain.join(heads, "cell").groupBy("head").agg(F.sum("len").alias("len"), F.count("*").alias("n_inner"))
    edges = tops.withColumnRenamed("cell", "head").join(lengths, "head", "left").join(last, "ends")
    return edges.select("begins", "ends", F.coalesce("n_inner", F.lit(0)).alias("n_inner"), F.round(F.col("first") + F.coalesce("len", F.lit(0.0)), 3).alias("length_m"), F.round("end_q", 6).alias("q"))


def drainage_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = areas(forest(spark, sf_dir))
    is_channel = (F.col("area") >= CHANNEL_M2) & F.col("code").between(1, 8)
    km = F.sum(F.when(is_channel, flow.step_length(F.col("code"), RESOLUTION_M))) / 1e3
    return a.groupBy("zone").agg(F.round(km, 3).alias("channel_km"), F.round(km / (F.count_if("land") * AREA / 1e6), 6).alias("density"))


def slopes(f: DataFrame) -> DataFrame:
    """Longitudinal slope of channel cells whose receiver is a channel too."""
    ch = areas(f).where((F.col("area") >= CHANNEL_M2) & F.col("code").between(1, 8))
    down = ch.select(F.col("cell").alias("receiver"), F.col("z").alias("z_down"))
    drop = F.greatest(F.lit(0.0), F.col("z") - F.col("z_down")) / flow.step_length(F.col("code"), RESOLUTION_M)
    return ch.join(down, "receiver").select("cell", "z", "area", drop.alias("slope"))


def band_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope distribution of channels by elevation band."""
    s = written(slopes(forest(spark, sf_dir)).select(hy.elevation_band(F.col("z")).alias("band"), "slope"), "slopes")
    means = s.groupBy("band").agg(F.count("*").alias("n"), F.round(F.avg("slope"), 8).alias("mean"))
    return st.beside(means, st.quantiles(s, ["band"], "slope", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, 8), ["band"])


def divide_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D8 links that cross a zone boundary, and how large the crossing areas are."""
    a = areas(forest(spark, sf_dir)).select("cell", "receiver", "zone", "area")
    down = a.select(F.col("cell").alias("receiver"), F.col("zone").alias("to_zone"))
    x = a.join(down, "receiver").where("zone <> to_zone")
    return x.agg(F.count("*").alias("n"), F.max("area").alias("largest"), *(F.count_if(F.col("area") >= k * AREA).alias(f"over_{k}") for k in (4, 16, 64)))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel length by area threshold, for all thresholds in one pass."""
    a = areas(forest(spark, sf_dir)).where(F.col("code").between(1, 8)).select("area", flow.step_length(F.col("code"), RESOLUTION_M).alias("len"))
    steps = F.explode(F.filter(F.array(*(F.lit(AREA * 2.0**k) for k in range(10))), lambda t: t <= F.col("area")))
    return a.select("len", steps.alias("threshold")).groupBy("threshold").agg(F.count("*").alias("n"), F.round(F.sum("len") / 1e3, 3).alias("km"))


def channel_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lowest relief upstream of a cell, and the highest on the way to its outlet: what beds are cut to and floors raised to."""
    f = forest(spark, sf_dir)
    bed, sill = flow.accumulate(f, F.min, bed=F.col("price")), flow.downstream(f, F.greatest, sill=F.col("price"))
    return bed.join(sill, "cell")


def network_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants of a channel network in one pass: what flows out of range, uphill, into itself, and degrees by kind."""
    f = forest(spark, sf_dir)
    ch = channel_network(f)
    down = f.select(F.col("cell").alias("receiver"), F.col("z").alias("z_down"))
    return ch.join(down, "receiver", "left").groupBy(F.coalesce("kind", F.lit("between")).alias("kind")).agg(
        F.count("*").alias("n"), F.count_if(F.col("z_down") > F.col("z")).alias("n_uphill"), F.count_if(F.col("cell") == F.col("receiver")).alias("n_loops"),
        F.min("upstream").alias("least_in"), F.max("upstream").alias("most_in"), F.count_if(F.col("z_down").isNull()).alias("n_lost"),
    )


def coastal_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The random grid with terminal: ocean beside land, and the edges of the grid."""
    g = fill.edge_cells(order_grid(spark, sf_dir))
    coast = fill.coastline(g, F.col("land")).withColumn("coast", F.lit(True))
    return g.join(coast, "cell", "left").withColumn("terminal", F.col("edge") | F.coalesce("coast", F.lit(False)))


def routed(spark: SparkSession, sf_dir: str, zone: bool = True) -> DataFrame:
    return fill.route(coastal_grid(spark, sf_dir), "price", F.col("land"), F.col("terminal"), F.col("zone") if zone else None)


def routed_receivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels and receivers over terrain full of pits, from coasts and edges, within zones."""
    return routed(spark, sf_dir).select("cell", F.col("w").alias("level"), "steps", "code", "receiver")


def routed_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area that drains through each terminal of the routed grid, with what enters from outside at every 97th cell."""
    f = written(routed(spark, sf_dir, zone=False).select("cell", "receiver", "terminal"), "routed")
    inflow = F.when(F.col("cell") % 97 == 0, F.lit(5.0 * AREA)).otherwise(0.0)
    a = flow.accumulate(f.withColumn("w", F.lit(AREA) + inflow), area=F.col("w"))
    return f.where("terminal").select("cell").join(a, "cell")


def routed_catchments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by zone and terminal; zones are the catchments of a zoned flood."""
    f = written(routed(spark, sf_dir), "routed")
    o = flow.outlets(f.select("cell", "receiver")).join(f.select("cell", "zone"), "cell")
    return o.groupBy("zone").agg(F.count("*").alias("n_cells"), F.countDistinct("outlet").alias("n_outlets"), F.max("steps").alias("longest"))


def filled_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels at which the pits of the random grid spill, with its edges as terminals."""
    g = fill.edge_cells(order_grid(spark, sf_dir))
    return fill.fill(g, "price", F.col("edge")).select("cell", "z", F.col("w").alias("level"))


def depression_lakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lakes: patches that filling raised, with area, depth and level; small ones first while half of their cells lasts."""
    g = fill.edge_cells(order_grid(spark, sf_dir))
    deep = fill.fill(g, "price", F.col("edge")).where("w - z > 5000")
    p = components.patches(deep.select("cell", "r", "c")).join(deep.select("cell", "z", "w"), "cell")
    lakes = p.groupBy("patch").agg(F.count("*").alias("n"), F.max(F.col("w") - F.col("z")).alias("depth"), F.avg("w").alias("level")).where("n >= 2")
    lakes = written(lakes.select(F.col("patch").alias("id"), "n", identity.probe_key(F.col("patch")).alias("key"), "depth", "level"), "lakes")
    budget = lakes.agg((F.sum("n") / 2).alias("budget"))
    s = relational.running_small_first(lakes, "n", "key").crossJoin(F.broadcast(budget))  # one row
    return s.where("used <= budget").select(F.col("id").alias("patch"), "n", F.round("depth", 2).alias("depth"), F.round("level", 4).alias("level"), "used")


#: Levels, steps and receivers of the flood: a keyed recursion that improves (level, steps) until nothing changes.
ROUTE_SQL = """with recursive {grid},
d(code, dr, dc) as (values (1,0,1),(2,1,1),(3,1,0),(4,1,-1),(5,0,-1),(6,-1,-1),(7,-1,0),(8,-1,1)),
pair as materialized (select a.cell, b.cell as nbr, a.code from (select g.cell, g.r + d.dr as r, g.c + d.dc as c, d.code from g, d) a join g b on a.r = b.r and a.c = b.c),
seen as materialized (select pair.cell, count(*) as n, count(*) filter (b.land) as n_land from pair join g b on pair.nbr = b.cell group by pair.cell),
t as materialized (select g.*, {terminal} as terminal, {routable} as routable from g join seen using (cell)),
nb as materialized (select pair.*, a.price as h, a.terminal from pair join t a on pair.cell = a.cell join t b on pair.nbr = b.cell
 where ({zoned}) and (a.routable or a.terminal) and (b.routable or b.terminal)),
lv(cell, w, s) using key (cell) as (select cell, price, cast(0 as bigint) from t where terminal
 union select x.cell, x.k.w, x.k.s from (select nb.cell, min(struct_pack(w := greatest(nb.h, lv.w), s := case when nb.h > lv.w then 0 else lv.s + 1 end)) as k
  from lv join nb on nb.nbr = lv.cell where not nb.terminal group by nb.cell) x left join recurring.lv o on o.cell = x.cell
 where o.cell is null or (x.k.w, x.k.s) < (o.w, o.s)),
rc as materialized (select nb.cell, min(struct_pack(w := lv.w, s := lv.s, cell := lv.cell, code := nb.code)) as f from nb join lv on nb.nbr = lv.cell where not nb.terminal group by nb.cell),
f as materialized (select lv.cell, lv.w, lv.s, coalesce(rc.f.code, 0) as code, rc.f.cell as receiver, t.terminal, t.zone, t.price as z from lv join t using (cell) left join rc using (cell))"""
_COAST = {"terminal": "seen.n < 8 or (not g.land and seen.n_land > 0)", "routable": "g.land"}
ZONED_SQL = ROUTE_SQL.format(grid=GRID_SQL, zoned="a.zone = b.zone", **_COAST)
COAST_SQL = ROUTE_SQL.format(grid=GRID_SQL, zoned="true", **_COAST)
EDGES_SQL = ROUTE_SQL.format(grid=GRID_SQL, zoned="true", terminal="seen.n < 8", routable="true")
_UP = ", up as (select cell as origin, cell, 0 as steps from f union all select up.origin, f.receiver, up.steps + 1 from up join f on up.cell = f.cell where f.receiver is not null)"
#: Orders rise until no cell asks for a larger one.
_ORDERS = """, st(cell, k) using key (cell) as (select cell, 1 from f
 union select x.cell, x.k from (select c.receiver as cell, c.top + cast(count(*) filter (o.k = c.top) > 1 as integer) as k
   from (select f.receiver, max(p.k) as top from f join recurring.st p on p.cell = f.cell where f.receiver is not null group by f.receiver) c
   join f on f.receiver = c.receiver join recurring.st o on o.cell = f.cell group by c.receiver, c.top) x join recurring.st b on b.cell = x.cell where x.k > b.k)"""

_STEP = f"case when code % 2 = 0 then {RESOLUTION_M} * sqrt(2) else {RESOLUTION_M} end"
_CH = f", ch as materialized (select f.*, a.area, a.q from f join a using (cell) where a.area >= {CHANNEL_M2} and f.code between 1 and 8)"
_NODES = (
    _CH + """, w as materialized (select ch.*, coalesce(u.n, 0) as upstream, dn.cell is not null as flows_on from ch
 left join (select receiver as cell, count(*) as n from ch group by receiver) u on ch.cell = u.cell left join ch dn on ch.receiver = dn.cell),
nodes as materialized (select *, case when not flows_on then 'outlet' when upstream = 0 then 'source' when upstream > 1 then 'junction' end as kind from w)"""
)

QUERIES = {
    "d8_receivers": (d8_receivers, FLOW_SQL + " select cell, cast(code as integer) as code, receiver from f"),
    "flow_accumulation": (flow_accumulation, FLOW_SQL + " select cell, cast(area as double) as area from a"),
    "mean_discharge": (mean_discharge, FLOW_SQL + " select cell, round(q, 6) as q, round(least(greatest(2.5 * sqrt(q), 2.0), 120.0), 5) as width from a"),
    "catchments": (catchments, FLOW_SQL + " select outlet, count(*) as n_cells, cast(max(steps) as bigint) as longest from o group by outlet"),
    "flow_levels": (flow_levels, FLOW_SQL + " select cell, outlet, cast(steps as bigint) as steps from o"),
    "channel_cells": (channel_cells, FLOW_SQL + f""" select zone, count(*) filter (area >= {CHANNEL_M2}) as n_over,
 count(*) filter (area >= {CHANNEL_M2} and code between 1 and 8) as n_flowing, count(*) filter (area >= {CHANNEL_M2} and land) as n_land from f join a using (cell) group by zone"""),
    "area_conservation": (area_conservation, FLOW_SQL + f" select cast(sum(area) filter (receiver is null) as double) as collected, cast(count(*) * {AREA} as double) as area from f join a using (cell)"),
    "stream_orders": (stream_orders, FLOW_SQL + _ORDERS + " select cast(k as integer) as stream_order, count(*) as n_cells from st group by k"),
    "filled_surface": (filled_surface, EDGES_SQL + " select cell, z, w as level from f"),
    "routed_receivers": (routed_receivers, ZONED_SQL + " select cell, w as level, s as steps, cast(code as integer) as code, receiver from f"),
    "routed_areas": (routed_areas, COAST_SQL + _UP + f" select up.cell, cast(sum({AREA} + case when up.origin % 97 = 0 then {5 * AREA} else 0 end) as double) as area from up join f on up.cell = f.cell where f.terminal group by up.cell"),
    "routed_catchments": (routed_catchments, ZONED_SQL + _UP + ", o as (select origin as cell, max_by(cell, steps) as outlet, max(steps) as steps from up group by origin) select zone, count(*) as n_cells, count(distinct outlet) as n_outlets, cast(max(o.steps) as bigint) as longest from o join f using (cell) group by zone"),
    "depression_lakes": (depression_lakes, EDGES_SQL + """, dp as materialized (select f.cell, f.w, f.z, g.r, g.c from f join g using (cell) where f.w - f.z > 5000),
 e as materialized (select a.cell, b.cell as nbr from (select dp.cell, dp.r + d.dr as r, dp.c + d.dc as c from dp, d) a join dp b on a.r = b.r and a.c = b.c),
 lab(cell, patch) using key (cell) as (select cell, cell from dp union select x.cell, x.patch from (select e.nbr as cell, min(lab.patch) as patch from lab join e on e.cell = lab.cell group by e.nbr) x join recurring.lab o on o.cell = x.cell where x.patch < o.patch),
 lk as materialized (select patch, count(*) as n, max(w - z) as depth, avg(w) as level from lab join dp using (cell) group by patch having count(*) >= 2),
 u as (select *, cast(sum(n) over (order by n, ((patch + 1) * 2654435761) & 4294967295, patch rows unbounded preceding) as bigint) as used from lk)
 select patch, n, round(depth, 2) as depth, round(level, 4) as level, used from u where used <= (select sum(n) / 2 from lk)"""),
    "river_nodes": (river_nodes, FLOW_SQL + _NODES + " select cell, kind, upstream from nodes where kind is not null"),
    "river_edges": (river_edges, FLOW_SQL + _NODES + f""", walk as (select cell as begins, receiver as cell, {_STEP} as len, 0 as n_inner from nodes where kind is not null and kind <> 'outlet'
 union all select walk.begins, nodes.receiver, walk.len + {_STEP}, walk.n_inner + 1 from walk join nodes on walk.cell = nodes.cell where nodes.kind is null)
 select begins, nodes.cell as ends, cast(n_inner as bigint) as n_inner, round(len, 3) as length_m, round(q, 6) as q from walk join nodes on walk.cell = nodes.cell where nodes.kind is not null"""),
    "channel_bed": (channel_bed, FLOW_SQL + ", bd as (select up.cell, min(o.price) as bed from up join g o on up.origin = o.cell group by up.cell), sl as (select up.origin as cell, max(o.price) as sill from up join g o on up.cell = o.cell group by up.origin) select cell, bed, sill from bd join sl using (cell)"),
    "network_checks": (network_checks, FLOW_SQL + _NODES + " select coalesce(nodes.kind, 'between') as kind, count(*) as n, count(*) filter (f.z > nodes.z) as n_uphill, count(*) filter (nodes.cell = nodes.receiver) as n_loops, min(upstream) as least_in, max(upstream) as most_in, count(*) filter (f.cell is null) as n_lost from nodes left join f on nodes.receiver = f.cell group by 1"),
    "drainage_density": (drainage_density, FLOW_SQL + f""", x as (select zone, land, case when area >= {CHANNEL_M2} and code between 1 and 8 then {_STEP} end as len from f join a using (cell))
 select zone, round(sum(len) / 1e3, 3) as channel_km, round(sum(len) / 1e3 / (count(*) filter (land) * {AREA} / 1e6), 6) as density from x group by zone"""),
    "band_slopes": (band_slopes, FLOW_SQL + _CH + f""", sl as (select ch.z, greatest(0.0, ch.z - dn.z) / (case when ch.code % 2 = 0 then {RESOLUTION_M} * sqrt(2) else {RESOLUTION_M} end) as slope from ch join ch dn on ch.receiver = dn.cell)
 select case when z < 500 then '0-500' when z < 1000 then '500-1000' when z < 2000 then '1000-2000' else '2000+' end as band, count(*) as n, round(avg(slope), 8) as mean,
 round(quantile_cont(slope, 0.1), 8) as p10, round(quantile_cont(slope, 0.5), 8) as p50, round(quantile_cont(slope, 0.9), 8) as p90 from sl group by 1"""),
    "divide_crossings": (divide_crossings, FLOW_SQL + f""", x as (select a.area from f join a using (cell) join f t on f.receiver = t.cell where f.zone <> t.zone)
 select count(*) as n, cast(max(area) as double) as largest, count(*) filter (area >= {4 * AREA}) as over_4, count(*) filter (area >= {16 * AREA}) as over_16, count(*) filter (area >= {64 * AREA}) as over_64 from x"""),
    "threshold_sweep": (threshold_sweep, FLOW_SQL + f""", t as (select {AREA} * 2.0 ** k as threshold from range(10) x(k))
 select cast(threshold as double) as threshold, count(*) as n, round(sum({_STEP}) / 1e3, 3) as km from f join a using (cell) join t on a.area >= t.threshold where code between 1 and 8 group by threshold"""),
}
