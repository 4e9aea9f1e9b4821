"""Queries of fitted thresholds, channel beds, lake passages, nearest cells, geometry of paths, states and regions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillspark.functions import hydrology as hy
from rillspark.operators import distance, flow
from rillspark.plans.drainage import _CH, _STEP, AREA, CHANNEL_M2, FLOW_SQL, areas, forest
from rillspark.sources.grids import GRID_SQL, RESOLUTION_M, order_grid, table
from rillspark.sources.shared import shared_dir, written

_G = f"with {GRID_SQL} "
#: Thresholds tried in square kilometres: from the least to the largest in equal ratios; halvings of that range (fixed values).
LEAST_KM2, MOST_KM2, TRIALS, HALVINGS = 0.25, 1024.0, 49, 24
#: Channel density that the test grids are fitted to, in km per square km.
DENSITY = 0.9
#: Elevation bands' factors, floors and ceilings of channel grades, and the deepest cut in metres, for the test grids.
GRADES = ((0.8, 0.001, 0.05), (0.9, 0.002, 0.08), (1.0, 0.004, 0.12), (1.1, 0.006, 0.2))
DEEPEST = 25.0
#: Beds are whole numbers of this part of a metre, so that sums are exact in any order.
LATTICE = 100_000


def _density(reaches: DataFrame, land_km2: float, thresholds: list[float]) -> list[float]:
    """Channel km per square km of land at each threshold in square km, in one pass."""
    row = reaches.agg(*(F.coalesce(F.sum(F.when(F.col("area") >= t * 1e6, F.col("len"))), F.lit(0.0)).alias(f"t{i}") for i, t in enumerate(thresholds))).first()
    return [v / 1e3 / land_km2 for v in row]


def threshold_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area threshold whose channel density is nearest to a target: of a sweep in equal ratios, and by halving the range.

    Halving looks three steps ahead: a pass measures the seven middles that the
    next three can need.
    """
    a = written(areas(forest(spark, sf_dir)).select("area", "code", "land", flow.step_length(F.col("code"), RESOLUTION_M).alias("len")), "reaches")
    land = a.where("land").count() * AREA / 1e6
    reaches = a.where(F.col("code").between(1, 8)).select("area", "len")
    sweep = [LEAST_KM2 * (MOST_KM2 / LEAST_KM2) ** (i / (TRIALS - 1)) for i in range(TRIALS)]
    error = [round(abs(d - DENSITY), 9) for d in _density(reaches, land, sweep)]
    found = [("sweep", sweep[error.index(min(error))], min(error))]
    low, high, trials = LEAST_KM2, MOST_KM2, []
    for _ in range(HALVINGS // 3):
        middles = [low + (high - low) * k / 8 for k in range(1, 8)]
        density = dict(zip(range(1, 8), _density(reaches, land, middles), strict=True))
        lo, hi = 0, 8
        for _ in range(3):
            k = (lo + hi) // 2
            trials.append((middles[k - 1], density[k]))
            lo, hi = (k, hi) if density[k] > DENSITY else (lo, k)
        low, high = low + (high - low) * lo / 8, low + (high - low) * hi / 8
    trials += zip((low, high), _density(reaches, land, [low, high]), strict=True)
    best = min(trials, key=lambda t: round(abs(t[1] - DENSITY), 9))
    found.append(("halving", best[0], abs(best[1] - DENSITY)))
    return spark.createDataFrame(found, "method string, km2 double, error double").select("method", F.round("km2", 4).alias("km2"), F.round("error", 8).alias("error"))


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel cells of the ramp with the height of their receiver and the grade that their band asks for."""
    a = written(areas(forest(spark, sf_dir)).select("cell", "code", "receiver", "z", "area", "land"), "areas")
    ch = a.where((F.col("area") >= CHANNEL_M2) & F.col("code").between(1, 8))
    down = a.select(F.col("cell").alias("receiver"), F.col("z").alias("z_down"))
    length = flow.step_length(F.col("code"), RESOLUTION_M)
    grade = F.greatest(F.lit(0.0), (F.col("z") - F.col("z_down")) / length)
    band = F.when(F.col("z") < 500, 0).when(F.col("z") < 1000, 1).when(F.col("z") < 2000, 2).otherwise(3)
    asked = F.element_at(F.array(*(F.least(F.lit(most), F.greatest(F.lit(least), F.col("grade") * factor)) for factor, least, most in GRADES)), F.col("band") + 1)
    return ch.join(down, "receiver").withColumns({"grade": grade, "band": band, "len": length}).withColumn("asked", asked)


def channel_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of channels and what their elevation bands ask for, between a floor and a ceiling."""
    return _channels(spark, sf_dir).select("cell", F.round("grade", 9).alias("grade"), F.round("asked", 9).alias("asked"))


def target_beds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beds that fall by the grade asked for from each channel cell to the next, cut no deeper than a limit and never raised."""
    unit = lambda x: F.round(x * LATTICE).cast("long")
    ch = written(_channels(spark, sf_dir).select("cell", "receiver", unit(F.col("z")).alias("z"), unit(F.col("asked") * F.col("len")).alias("drop")), "grades")
    inner = ch.join(ch.select(F.col("cell").alias("receiver"), F.lit(True).alias("on")), "receiver", "left")
    beds = flow.carved(inner.select("cell", F.when(F.col("on"), F.col("receiver")).alias("receiver"), "z", "drop"), DEEPEST * LATTICE)
    return beds.select("cell", (F.col("bed") / LATTICE).alias("bed"))


def lake_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of a river network with lakes: where channels enter and leave one (first of all), end, begin and meet.

    Cells on ocean status stand in for lakes, one for each zone.
    """
    a = areas(forest(spark, sf_dir)).select("cell", "code", "receiver", "area", F.when(~F.col("land"), F.col("zone")).alias("lake"))
    a = written(a, "lake-areas")
    ch = a.where((F.col("area") >= CHANNEL_M2) & F.col("code").between(1, 8)).select("cell", "receiver", "lake")
    to = a.select(F.col("cell").alias("receiver"), F.col("lake").alias("lake_down"))
    ch = ch.join(to, "receiver")
    ups = ch.groupBy(F.col("receiver").alias("cell")).agg(F.least(F.count("*"), F.lit(255)).alias("upstream"), F.count_if(F.col("lake_down").isNotNull() & ~F.col("lake").eqNullSafe(F.col("lake_down"))).alias("n_from_outside"))
    downs = ch.select(F.col("cell").alias("receiver"), F.lit(True).alias("flows_on"))
    x = ch.join(ups, "cell", "left").join(downs, "receiver", "left")
    up, on = F.coalesce("upstream", F.lit(0)), F.coalesce("flows_on", F.lit(False))
    leaves = F.col("lake").isNotNull() & ~F.col("lake").eqNullSafe(F.col("lake_down"))
    enters = F.col("lake").isNotNull() & (F.coalesce("n_from_outside", F.lit(0)) > 0)
    kind = F.when(leaves, "lake_outlet").when(enters, "lake_inlet").when(~on, "outlet").when(up == 0, "source").when(up > 1, "junction")
    return x.select("cell", "lake", kind.alias("kind"), up.alias("upstream")).where("kind is not null")


def nested_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catchments snapped whole to the zone of their pour point: cells that change zone by it."""
    f = forest(spark, sf_dir)
    x = f.select("cell", "zone").join(flow.outlets(f.select("cell", "receiver")), "cell")
    pour = f.select(F.col("cell").alias("outlet"), F.col("zone").alias("parent"))
    return x.join(pour, "outlet").groupBy("parent").agg(F.countDistinct("outlet").alias("n_units"), F.count("*").alias("n_cells"), F.count_if(F.col("zone") != F.col("parent")).alias("n_moved"))


def nearest_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every cell the nearest dear cell (ties to the smaller), how far it is, and its zone, which unassigned cells take."""
    g = order_grid(spark, sf_dir).withColumn("dear", F.col("price") > 480000)
    near = distance.nearest(g, "dear")
    return near.join(g.select(F.col("cell").alias("nearest"), F.col("zone").alias("label")), "nearest").select("cell", "nearest", F.round("distance", 9).alias("distance"), "label")


def cross_dilation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dear cells grown three times by their four neighbours: what lies within three steps along rows and columns."""
    g = order_grid(spark, sf_dir)
    reach = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-3, 4) for j in range(-3, 4) if abs(i) + abs(j) <= 3))
    grown = g.where("price > 480000").select("r", "c", F.explode(reach).alias("s")).select((F.col("r") + F.col("s.i")).alias("r"), (F.col("c") + F.col("s.j")).alias("c")).distinct()
    return g.join(grown, ["r", "c"], "left_semi").select("cell")


def _segment_distance(r: Column, c: Column, r0: Column, c0: Column, r1: Column, c1: Column) -> Column:
    """Squared distance of a point to a segment."""
    dr, dc = r1 - r0, c1 - c0
    whole = dr * dr + dc * dc
    at = F.when(whole == 0, F.lit(0.0)).otherwise(hy.clip(((r - r0) * dr + (c - c0) * dc) / F.greatest(whole, F.lit(1)), 0.0, 1.0))
    return F.pow(r - (r0 + at * dr), F.lit(2.0)) + F.pow(c - (c0 + at * dc), F.lit(2.0))


def _at_boundary(start: tuple[Column, Column], outside: tuple[Column, Column], shape: tuple[int, int]) -> tuple[Column, Column]:
    """Where a ray from inside leaves a raster: the first side that it meets within it, else the point clamped."""
    places = []
    for axis in (0, 1):
        delta = outside[axis] - start[axis]
        side = F.when(delta > 0, F.lit(shape[axis] - 1)).otherwise(F.lit(0))
        at = (side - start[axis]) / F.when(delta != 0, delta)
        other = start[1 - axis] + at * (outside[1 - axis] - start[1 - axis])
        places.append(F.when((at >= 0) & (at <= 1) & (other >= 0) & (other <= shape[1 - axis] - 1), at))
    first = F.least(*places)
    return tuple(F.when(first.isNotNull(), F.rint(s + first * (o - s))).otherwise(F.least(F.lit(n - 1), F.greatest(F.lit(0), o))).cast("long") for s, o, n in zip(start, outside, shape, strict=True))


def path_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances to segments, where rays leave a raster of 40 by 60 cells, and the edge or middle of a refined cell that a step points to."""
    k = F.col("c_custkey")
    p = {n: F.pmod(k * m, F.lit(q)) for n, m, q in (("r", 1, 50), ("c", 3, 37), ("r0", 5, 11), ("c0", 7, 13), ("r1", 11, 29), ("c1", 13, 31))}
    t = table(spark, sf_dir, "customer").select("c_custkey", *(v.alias(n) for n, v in p.items()))
    c = {n: F.col(n) for n in p}
    out = _at_boundary((F.pmod(c["r"], F.lit(40)), c["c"]), (c["r1"] * 4 - 30, c["c1"] * 5 - 40), (40, 60))
    edge = lambda x, d: x * 8 + F.when(d < 0, 0).when(d > 0, 7).otherwise(4)
    return t.select(
        "c_custkey", F.round(_segment_distance(c["r"], c["c"], c["r0"], c["c0"], c["r1"], c["c1"]), 6).alias("d2"), out[0].alias("row"), out[1].alias("col"),
        edge(c["r0"], c["r1"] - c["c1"]).alias("edge_row"), edge(c["c0"], c["r"] - c["c"]).alias("edge_col"),
    )


def straight_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of straight D8 paths, diagonal first, in order."""
    k = F.col("s_suppkey")
    p = {n: F.pmod(k * m, F.lit(q)) for n, m, q in (("r0", 5, 11), ("c0", 7, 13), ("r1", 11, 29), ("c1", 13, 31))}
    t = table(spark, sf_dir, "supplier").select("s_suppkey", *(v.alias(n) for n, v in p.items()))
    dr, dc = F.col("r1") - F.col("r0"), F.col("c1") - F.col("c0")
    steps = t.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.abs(dr), F.abs(dc)))).alias("k"))
    walk = lambda start, d: (F.col(start) + F.signum(d.cast("double")) * F.least(F.col("k"), F.abs(d))).cast("long")
    return steps.select("s_suppkey", "k", walk("r0", dr).alias("row"), walk("c0", dc).alias("col"))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In every block of 8 by 8 cells the cell of least height plus weighted distance from its centre; then by distance, row and column."""
    g = order_grid(spark, sf_dir)
    mid = lambda x: F.floor(F.col(x) / 8) * 8 + 4
    d2 = (F.col("r") - mid("r")) * (F.col("r") - mid("r")) + (F.col("c") - mid("c")) * (F.col("c") - mid("c"))
    best = g.groupBy(F.floor(F.col("r") / 8).alias("br"), F.floor(F.col("c") / 8).alias("bc")).agg(F.min(F.struct((F.col("price") / 1e4 + 0.5 * d2).alias("score"), d2.alias("d2"), "r", "c")).alias("x"))
    return best.select("br", "bc", "x.r", "x.c", F.round("x.score", 6).alias("score"))


#: What may follow each state of a region (fixed values).
STATES = {"registered": "surface_complete", "surface_complete": "routed", "routed": "validated", "validated": "published"}


def guarded_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of regions after their events in order: only the state that may follow is taken, and a path once given stays unless another comes."""
    e = table(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(40)).alias("region"), "event_id", F.pmod(F.col("event_id") * 7, F.lit(5)).cast("int").alias("k"), F.when(F.col("value") > 50, F.round("value", 2)).alias("path"))
    names = ["registered", *STATES.values()]
    steps = e.groupBy("region", F.floor(F.col("event_id") / 64).alias("part")).agg(F.array_sort(F.collect_list(F.struct("event_id", "k", "path"))).alias("events"))

    # what a part of the events makes of each state that it may start in: parts are short, and are applied in turn
    def run(start: int) -> Column:
        def step(at: Column, x: Column) -> Column:
            takes = x["k"] == at["state"] + 1
            return F.struct(F.when(takes, x["k"]).otherwise(at["state"]).alias("state"), (at["n"] + F.when(takes, 0).otherwise(1)).alias("n"), F.when(takes, F.coalesce(x["path"], at["path"])).otherwise(at["path"]).alias("path"))

        return F.aggregate("events", F.struct(F.lit(start).alias("state"), F.lit(0).alias("n"), F.lit(None).cast("double").alias("path")), step)

    made = steps.select("region", "part", F.array(*(run(s) for s in range(len(names)))).alias("made"))
    parts = made.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("part", "made"))).alias("parts"))

    def then(at: Column, x: Column) -> Column:
        m = F.get(x["made"], at["state"])
        return F.struct(m["state"].alias("state"), (at["n"] + m["n"]).alias("n"), F.coalesce(m["path"], at["path"]).alias("path"))

    end = F.aggregate("parts", F.struct(F.lit(0).alias("state"), F.lit(0).alias("n"), F.lit(None).cast("double").alias("path")), then)
    return parts.select("region", end.alias("x")).select("region", F.element_at(F.array(*map(F.lit, names)), F.col("x.state") + 1).alias("state"), F.col("x.n").alias("refused"), "x.path")


def tile_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds of tiles, mixed from a base seed and both coordinates in 64 bits without a sign."""
    word, mix = F.lit("18446744073709551616").cast("decimal(38,0)"), F.lit(0x9E3779B9).cast("decimal(20,0)")
    u32 = lambda x: F.pmod(x, F.lit(1 << 32)).cast("decimal(20,0)")
    k = F.col("c_custkey")
    first = F.pmod((F.pmod(k * 1000003, F.lit(1 << 40)).cast("decimal(20,0)") * mix + u32(k % 91 - 40)).cast("decimal(38,0)"), word)
    return table(spark, sf_dir, "customer").select("c_custkey", first.cast("decimal(20,0)").alias("h")).select("c_custkey", F.pmod((F.col("h") * mix + u32(F.col("c_custkey") % 53 - 20)).cast("decimal(38,0)"), word).cast("string").alias("seed"))


def mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window put together from regions of 16 by 16 cells, with what is missing of each; a window counts only if nothing is."""
    g = order_grid(spark, sf_dir).where("r between 5 and 60 and c between 9 and 30")
    rows = lambda x, low, high: F.least(F.lit(high), F.col(x) * 16 + 15) - F.greatest(F.lit(low), F.col(x) * 16) + 1
    want = spark.range(0, 4).select(F.col("id").alias("rr")).select("rr", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("rc")).select("rr", "rc", (rows("rr", 5, 60) * rows("rc", 9, 30)).alias("wanted"))
    have = g.groupBy(F.floor(F.col("r") / 16).alias("rr"), F.floor(F.col("c") / 16).alias("rc")).agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"))
    return want.join(have, ["rr", "rc"], "left").select("rr", F.col("rc").cast("long").alias("rc"), F.coalesce("n", F.lit(0)).alias("n"), "total", (F.coalesce("n", F.lit(0)) == F.col("wanted")).alias("complete"))


def split_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples stored by their split: a reader of one split opens its folder alone."""
    path = f"{shared_dir(spark)}/rillspark/splits-{uuid.uuid4().hex}"
    split = F.when(F.col("c") % 5 == 0, "validation").otherwise("train")
    order_grid(spark, sf_dir).select("cell", "zone", "price", split.alias("split")).write.partitionBy("split").parquet(path)
    return spark.read.parquet(path).where("split = 'validation'").groupBy("zone").agg(F.count("*").alias("n"), F.round(F.avg("price"), 4).alias("mean"))


def source_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight windows drawn for every source by hashes of source and attempt, so that they come out alike anywhere."""
    hashed = lambda salt, n: F.pmod(((F.col("s_suppkey") * 64 + F.col("attempt")) * 2654435761 + salt * 40503).bitwiseAND(F.lit(0xFFFFFFFF)), n)
    t = table(spark, sf_dir, "supplier").select("s_suppkey", (F.lit(300) + F.col("s_nationkey") * 10).alias("height"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("attempt"))
    return t.select("s_suppkey", "attempt", hashed(1, F.col("height") - 255).alias("row"), hashed(2, F.lit(345)).alias("col"))


def geojson_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of GeoJSON files: properties, and length and box of their lines."""
    path = f"{shared_dir(spark)}/rillspark/geojson-{uuid.uuid4().hex}"
    c = table(spark, sf_dir, "customer").where("c_custkey < 200")
    xy = F.transform(F.sequence(F.lit(0).cast("long"), F.pmod("c_custkey", F.lit(4)) + 1), lambda i: F.array((F.col("c_custkey") % 10 + i * 3).cast("double"), (i * 4).cast("double")))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), xy.alias("coordinates")).alias("geometry"), F.struct("c_custkey", "c_mktsegment").alias("properties"))
    c.groupBy("c_nationkey").agg(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features")).drop("c_nationkey").write.json(path)
    schema = "type string, features array<struct<type string, geometry struct<type string, coordinates array<array<double>>>, properties struct<c_custkey long, c_mktsegment string>>>"
    f = spark.read.schema(schema).json(path).select(F.explode("features").alias("f")).select("f.properties.*", F.col("f.geometry.coordinates").alias("xy"))
    part = F.zip_with(F.slice("xy", 1, F.size("xy") - 1), F.slice("xy", 2, F.size("xy") - 1), lambda a, b: F.hypot(b[0] - a[0], b[1] - a[1]))
    return f.select("c_custkey", "c_mktsegment", F.size("xy").alias("n_points"), F.round(F.aggregate(part, F.lit(0.0), lambda a, b: a + b), 6).alias("length"), F.array_max(F.transform("xy", lambda p: p[0])).alias("x_max"))


_BAND = "case when z < 500 then {0} when z < 1000 then {1} when z < 2000 then {2} else {3} end"
_ASKED = "least(" + _BAND.format(*(g[2] for g in GRADES)) + ", greatest(" + _BAND.format(*(g[1] for g in GRADES)) + ", grade * " + _BAND.format(*(g[0] for g in GRADES)) + "))"
_GRADED = _CH + f""", gr as materialized (select cell, receiver, z, code, greatest(0.0, (z - z_down) / len) as grade, len from (select ch.*, t.z as z_down, {_STEP.replace('code', 'ch.code')} as len from ch join f t on ch.receiver = t.cell)),
 ga as materialized (select *, {_ASKED} as asked from gr)"""
_RATIO = (MOST_KM2 / LEAST_KM2) ** (1 / (TRIALS - 1))

QUERIES = {
    "threshold_fit": (threshold_fit, FLOW_SQL + f""", rch as materialized (select cast(area as double) as area, {_STEP} as len from f join a using (cell) where code between 1 and 8), lnd as (select count(*) * {AREA} / 1e6 as km2 from g where land),
 sw as (select k, {LEAST_KM2} * pow({MOST_KM2 / LEAST_KM2}, k / {TRIALS - 1}.0) as t from range({TRIALS}) x(k)), sd as (select k, t, abs(coalesce(sum(len), 0) / 1e3 / any_value(km2) - {DENSITY}) as error from sw left join rch on rch.area >= t * 1e6, lnd group by k, t),
 bi(i, lo, hi) as (select 0, {LEAST_KM2}::double, {MOST_KM2}::double union all select i + 1, case when d > {DENSITY} then (lo + hi) / 2 else lo end, case when d > {DENSITY} then hi else (lo + hi) / 2 end
  from (select i, lo, hi, coalesce(sum(len), 0) / 1e3 / any_value(km2) as d from bi left join rch on rch.area >= (lo + hi) / 2 * 1e6, lnd where i < {HALVINGS} group by i, lo, hi)),
 bt as (select i, (lo + hi) / 2 as t from bi where i < {HALVINGS} union all select {HALVINGS}, lo from bi where i = {HALVINGS} union all select {HALVINGS + 1}, hi from bi where i = {HALVINGS}),
 bd as (select i, t, abs(coalesce(sum(len), 0) / 1e3 / any_value(km2) - {DENSITY}) as error from bt left join rch on rch.area >= t * 1e6, lnd group by i, t)
 select 'sweep' as method, round(t, 4) as km2, round(error, 8) as error from (select * from sd order by round(error, 9), k limit 1) union all select 'halving', round(t, 4), round(error, 8) from (select * from bd order by round(error, 9), i limit 1)"""),
    "channel_grades": (channel_grades, FLOW_SQL + _GRADED + " select cell, round(grade, 9) as grade, round(asked, 9) as asked from ga"),
    "target_beds": (target_beds, FLOW_SQL + _GRADED + f""", gl as materialized (select cell, receiver, cast(round(z * {LATTICE}) as bigint) as z, cast(round(asked * len * {LATTICE}) as bigint) as dropped from ga),
 st(cell, bed) using key (cell) as (select cell, z from gl union select x.cell, x.bed from (select n.cell, min(greatest(n.z - {int(DEEPEST * LATTICE)}, st.bed - u.dropped)) as bed from st join gl u on u.cell = st.cell join gl n on n.cell = u.receiver group by n.cell) x join recurring.st o on o.cell = x.cell where x.bed < o.bed)
 select cell, bed / {float(LATTICE)} as bed from st"""),
    "lake_passages": (lake_passages, FLOW_SQL + _CH + """, lk as materialized (select cell, case when not land then zone end as lake from f), w as materialized (select ch.cell, ch.receiver, a.lake, b.lake as lake_down from ch join lk a on ch.cell = a.cell join lk b on ch.receiver = b.cell),
 up as (select receiver as cell, least(count(*), 255) as upstream, count(*) filter (lake_down is not null and lake is distinct from lake_down) as outside from w group by receiver),
 x as (select w.*, coalesce(up.upstream, 0) as upstream, coalesce(up.outside, 0) as outside, d.cell is not null as flows_on from w left join up on up.cell = w.cell left join w d on d.cell = w.receiver),
 y as (select cell, lake, upstream, case when lake is not null and lake is distinct from lake_down then 'lake_outlet' when lake is not null and outside > 0 then 'lake_inlet' when not flows_on then 'outlet' when upstream = 0 then 'source' when upstream > 1 then 'junction' end as kind from x)
 select cell, lake, kind, upstream from y where kind is not null""".replace("up as (select receiver", "ups as (select receiver").replace("up.upstream, 0", "ups.upstream, 0").replace("up.outside, 0", "ups.outside, 0").replace("left join up on up.cell", "left join ups on ups.cell")),
    "nested_units": (nested_units, FLOW_SQL + " select p.zone as parent, count(distinct o.outlet) as n_units, count(*) as n_cells, count(*) filter (f.zone <> p.zone) as n_moved from o join f using (cell) join f p on p.cell = o.outlet group by 1"),
    "nearest_cells": (nearest_cells, _G + ", m as materialized (select cell, r, c, zone from g where price > 480000), x as (select g.cell, min(struct_pack(d := (g.r - m.r) * (g.r - m.r) + (g.c - m.c) * (g.c - m.c), cell := m.cell, zone := m.zone)) as b from g, m group by g.cell) select cell, b.cell as nearest, round(sqrt(b.d), 9) as distance, b.zone as label from x"),
    "cross_dilation": (cross_dilation, _G + ", m as (select r, c from g where price > 480000), s as (select i - 3 as i, j - 3 as j from range(7) a(i), range(7) b(j) where abs(i - 3) + abs(j - 3) <= 3), t as (select distinct m.r + i as r, m.c + j as c from m, s) select cell from g join t using (r, c)"),
    "path_geometry": (path_geometry, """with p as (select c_custkey, c_custkey % 50 as r, c_custkey * 3 % 37 as c, c_custkey * 5 % 11 as r0, c_custkey * 7 % 13 as c0, c_custkey * 11 % 29 as r1, c_custkey * 13 % 31 as c1 from customer),
 q as (select *, r1 - r0 as dr, c1 - c0 as dc, r % 40 as sr, c as sc, r1 * 4 - 30 as er, c1 * 5 - 40 as ec from p),
 w as (select *, case when dr * dr + dc * dc = 0 then 0.0 else least(1.0, greatest(0.0, ((r - r0) * dr + (c - c0) * dc) / greatest(dr * dr + dc * dc, 1))) end as pos,
  case when er <> sr then ((case when er > sr then 39 else 0 end) - sr) / (er - sr) end as a0, case when ec <> sc then ((case when ec > sc then 59 else 0 end) - sc) / (ec - sc) end as a1 from q),
 v as (select *, case when a0 between 0 and 1 and sc + a0 * (ec - sc) between 0 and 59 then a0 end as b0, case when a1 between 0 and 1 and sr + a1 * (er - sr) between 0 and 39 then a1 end as b1 from w), u as (select *, least(b0, b1) as b from v)
 select c_custkey, round(pow(r - (r0 + pos * dr), 2) + pow(c - (c0 + pos * dc), 2), 6) as d2, cast(case when b is not null then round_even(sr + b * (er - sr), 0) else least(39, greatest(0, er)) end as bigint) as row,
 cast(case when b is not null then round_even(sc + b * (ec - sc), 0) else least(59, greatest(0, ec)) end as bigint) as col, r0 * 8 + case when r1 < c1 then 0 when r1 > c1 then 7 else 4 end as edge_row, c0 * 8 + case when r < c then 0 when r > c then 7 else 4 end as edge_col from u"""),
    "straight_paths": (straight_paths, """with p as (select s_suppkey, s_suppkey * 5 % 11 as r0, s_suppkey * 7 % 13 as c0, s_suppkey * 11 % 29 as r1, s_suppkey * 13 % 31 as c1 from supplier), q as (select *, unnest(range(0, greatest(abs(r1 - r0), abs(c1 - c0)) + 1)) as k from p)
 select s_suppkey, k, r0 + sign(r1 - r0) * least(k, abs(r1 - r0)) as row, c0 + sign(c1 - c0) * least(k, abs(c1 - c0)) as col from q"""),
    "anchors": (anchors, _G + ", x as (select r, c, price / 1e4 + 0.5 * d2 as score, d2 from (select *, (r - r // 8 * 8 - 4) * (r - r // 8 * 8 - 4) + (c - c // 8 * 8 - 4) * (c - c // 8 * 8 - 4) as d2 from g)) select r // 8 as br, c // 8 as bc, r, c, round(score, 6) as score from x qualify row_number() over (partition by r // 8, c // 8 order by score, d2, r, c) = 1"),
    "guarded_states": (guarded_states, """with recursive e as materialized (select user_id % 40 as region, event_id * 7 % 5 as k, case when value > 50 then round(value, 2) end as path, row_number() over (partition by user_id % 40 order by event_id) as i from events),
 s(region, i, state, n, path) as (select distinct region, cast(0 as bigint), cast(0 as bigint), cast(0 as bigint), cast(null as double) from e union all
  select s.region, e.i, case when e.k = s.state + 1 then e.k else s.state end, s.n + case when e.k = s.state + 1 then 0 else 1 end, case when e.k = s.state + 1 then coalesce(e.path, s.path) else s.path end from s join e on e.region = s.region and e.i = s.i + 1)
 select region, ['registered', 'surface_complete', 'routed', 'validated', 'published'][state + 1] as state, cast(n as integer) as refused, path from s qualify row_number() over (partition by region order by i desc) = 1"""),
    "tile_seeds": (tile_seeds, "with x as (select c_custkey, (((c_custkey * 1000003) % 1099511627776)::hugeint * 2654435769 + (c_custkey % 91 - 40 + 4294967296) % 4294967296) % 18446744073709551616::hugeint as h from customer) select c_custkey, ((h * 2654435769 + (c_custkey % 53 - 20 + 4294967296) % 4294967296) % 18446744073709551616::hugeint)::varchar as seed from x"),
    "mosaic": (mosaic, _G + """, want as (select rr, rc, (least(60, rr * 16 + 15) - greatest(5, rr * 16) + 1) * (least(30, rc * 16 + 15) - greatest(9, rc * 16) + 1) as wanted from range(4) a(rr), range(2) b(rc)),
 have as (select r // 16 as rr, c // 16 as rc, count(*) as n, round(sum(price), 2) as total from g where r between 5 and 60 and c between 9 and 30 group by 1, 2) select rr, rc, coalesce(n, 0) as n, total, coalesce(n, 0) = wanted as complete from want left join have using (rr, rc)"""),
    "split_scan": (split_scan, _G + "select zone, count(*) as n, round(avg(price), 4) as mean from g where c % 5 = 0 group by zone"),
    "source_windows": (source_windows, "with t as (select s_suppkey, s_nationkey, cast(k as integer) as attempt from supplier, range(8) x(k)) select s_suppkey, attempt, (((s_suppkey * 64 + attempt) * 2654435761 + 40503) & 4294967295) % (300 + s_nationkey * 10 - 255) as row, (((s_suppkey * 64 + attempt) * 2654435761 + 81006) & 4294967295) % 345 as col from t"),
    "geojson_features": (geojson_features, "select c_custkey, c_mktsegment, cast(c_custkey % 4 + 2 as integer) as n_points, round((c_custkey % 4 + 1) * 5.0, 6) as length, cast(c_custkey % 10 + (c_custkey % 4 + 1) * 3 as double) as x_max from customer where c_custkey < 200"),
}
