"""Queries of stores and reports: codes, identities, appends, logs, budgets, checks over networks."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillspark.functions import hydrology as hy
from rillspark.functions import identity
from rillspark.operators import components, flow, relational
from rillspark.operators import statistics as st
from rillspark.plans.calibration import _summary_sql
from rillspark.plans.drainage import _CH, _ORDERS, _STEP, _UP, AREA, CHANNEL_M2, COAST_SQL, FLOW_SQL, areas, forest, routed
from rillspark.sources.grids import GRID_SQL, RESOLUTION_M, order_grid, table
from rillspark.sources.shared import shared_dir, written

_G = f"with {GRID_SQL} "


def probed_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of parts: a hash in twice as many slots, and the next free one where that is taken by an earlier part."""
    p = table(spark, sf_dir, "part").select("p_partkey", identity.probe_key(F.col("p_partkey")).alias("h"))
    return relational.probe_slots(p, "p_partkey", "h", 2 * p.count()).select(F.col("id").alias("p_partkey"), "slot")


def heaviest_inflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code that a group inherits: that of its heaviest inflow (the last of equals), else its own; and how often inflows disagree on the way."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice", F.substring("o_orderpriority", 1, 1).cast("int").alias("code"))
    first = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.pmod("c_custkey", F.lit(5)).cast("int") + 1).alias("own"))
    before = F.lag("code").over(relational.Window.partitionBy("c_custkey").orderBy("o_totalprice", "o_orderkey"))
    x = o.join(first, "c_custkey", "right").withColumn("known", F.coalesce(before, F.col("own")))
    return x.groupBy("c_custkey").agg(
        F.coalesce(F.max_by("code", F.struct("o_totalprice", "o_orderkey")), F.first("own")).alias("code"), F.count_if(F.col("code") != F.col("known")).alias("conflicts")
    )


def context_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every context with every seed, and what was measured for the pair, if anything was."""
    contexts = table(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    every = contexts.select("c_mktsegment", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("seed"))
    have = table(spark, sf_dir, "customer").where("c_custkey % 7 <> 3 or c_nationkey % 2 = 0").groupBy("c_mktsegment", F.pmod("c_custkey", F.lit(7)).cast("int").alias("seed")).agg(F.round(F.avg("c_acctbal"), 4).alias("mean"))
    return every.join(have, ["c_mktsegment", "seed"], "left")


def size_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of suppliers by number of lines, then key. Sizes are counted first, so no task orders all rows."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    sizes = n.groupBy("n").agg(F.count("*").alias("same"))
    larger = sizes.select("n", (F.sum("same").over(relational.Window.orderBy(F.desc("n"))) - F.col("same")).alias("larger"))  # a row for each size
    place = F.row_number().over(relational.Window.partitionBy("n").orderBy("l_suppkey"))
    return n.join(larger, "n").select("l_suppkey", "n", (F.col("larger") + place).alias("place"))


def appended_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers appended to the suppliers' table: their ids go on from the largest, by nation and key."""
    old = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    start = old.agg((F.coalesce(F.max("id"), F.lit(-1)) + 1).alias("start"))
    new = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.col("c_name").alias("name"))
    n = new.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    n = n.select("c_nationkey", (F.sum("n").over(relational.Window.orderBy("c_nationkey")) - F.col("n")).alias("before"))  # a row for each nation
    rank = F.row_number().over(relational.Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    new = new.withColumn("k", rank).join(F.broadcast(n), "c_nationkey").crossJoin(F.broadcast(start)).select((F.col("start") + F.col("before") + F.col("k") - 1).alias("id"), "name")
    return old.unionByName(new)


def graph_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges of a flow graph as JSON documents."""
    f = forest(spark, sf_dir).where("receiver is not null")
    return f.select("cell", F.to_json(F.struct(F.col("cell").alias("source"), F.col("receiver").alias("target"), F.col("code"))).alias("edge"))


def logged_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics appended by epoch as JSON lines, read back with the columns that only some epochs have."""
    path = f"{shared_dir(spark)}/rillspark/metrics-{uuid.uuid4().hex}"
    o = table(spark, sf_dir, "orders")
    for epoch in range(3):
        m = o.where(F.col("o_orderkey") % 3 == epoch).groupBy(F.col("o_orderstatus").alias("status")).agg(F.round(F.avg("o_totalprice"), 4).alias("loss"), *([F.count("*").alias("n")] if epoch == 2 else []))
        m.withColumn("epoch", F.lit(epoch)).write.mode("append").json(path)
    return spark.read.schema("epoch int, status string, loss double, n long").json(path)


def stored_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles written once, a folder each row of tiles: a second writer is refused, and a reader of one row reads its folder alone."""
    path = f"{shared_dir(spark)}/rillspark/tiles-{uuid.uuid4().hex}"
    g = order_grid(spark, sf_dir).select(F.floor(F.col("r") / 16).alias("ty"), F.floor(F.col("c") / 16).alias("tx"), "cell", "price")
    g.write.partitionBy("ty").mode("errorifexists").parquet(path)
    refused = False
    try:
        g.limit(1).write.partitionBy("ty").mode("errorifexists").parquet(path)
    except AnalysisException:
        refused = True
    return spark.read.parquet(path).where("ty = 1").groupBy("tx").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"), F.lit(refused).alias("refused"))


def csv_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with different columns in one CSV file under the union of their keys."""
    path = f"{shared_dir(spark)}/rillspark/csv-{uuid.uuid4().hex}"
    a = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n_customers")).select(F.col("c_nationkey").alias("nation"), "n_customers")
    b = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.round(F.max("s_acctbal"), 2).alias("balance")).select(F.col("s_nationkey").alias("nation"), "balance")
    a.unionByName(b, allowMissingColumns=True).write.option("header", True).csv(path)
    return spark.read.option("header", True).schema("nation int, n_customers long, balance double").csv(path)


def any_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any stored window meets a new one: the scan ends at the first that does."""
    o = table(spark, sf_dir, "orders")
    rows = []
    for name, low, high in (("inside", 1000.0, 600000.0), ("beyond", 1e9, 2e9)):
        hit = o.where(~((F.col("o_totalprice") > high) | (F.col("o_totalprice") + 10 < low))).limit(1)
        rows.append(hit.agg((F.count("*") > 0).alias("meets")).select(F.lit(name).alias("window"), "meets"))
    return rows[0].unionByName(rows[1])


def greedy_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers within a budget of half of all lines: small ones first for seven tenths of it, then in hash order whichever still fits."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")).select(F.col("l_suppkey").alias("id"), "n", identity.probe_key(F.col("l_suppkey")).alias("key"))
    return picked(written(n, "sizes"), n.agg(F.sum("n")).first()[0] // 2).select(F.col("id").alias("l_suppkey"), "n", "phase")


def picked(groups: DataFrame, budget: int, small_share: float = 0.7) -> DataFrame:
    """groups (id, n, key) within a budget, with phase: 1 taken small first, 2 in order of key.

    Sizes are added up size by size; within the one size that the small budget
    ends in, groups are ordered by ranges of the key.
    """
    small = int(budget * small_share)
    sizes = groups.groupBy("n").agg(F.sum("n").alias("all"))
    upto = sizes.select("n", "all", F.sum("all").over(relational.Window.orderBy("n")).alias("upto"))  # a row for each size
    whole = upto.where(F.col("upto") <= small).select("n")
    edge = upto.where((F.col("upto") > small) & (F.col("upto") - F.col("all") < small)).select("n", (F.col("upto") - F.col("all")).alias("used")).first()
    first = groups.join(F.broadcast(whole), "n", "left_semi").select("id")
    if edge:
        at = relational.running(groups.where(F.col("n") == edge["n"]), "n", "key").where(F.col("used") + edge["used"] <= small)
        first = first.unionByName(at.select("id"))
    first = written(first, "small-groups")
    used = groups.join(first, "id", "left_semi").agg(F.sum("n")).first()[0] or 0
    second = relational.greedy_fit(groups.join(first, "id", "left_anti"), "n", "key", budget - used)
    taken = first.withColumn("phase", F.lit(1)).unionByName(second.withColumn("phase", F.lit(2)))
    return groups.join(taken, "id")


def stream_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel length by stream order, orders counted on channels alone and no higher than 255."""
    ch = written(areas(forest(spark, sf_dir)).where((F.col("area") >= CHANNEL_M2) & F.col("code").between(1, 8)).select("cell", "code", "receiver"), "channels")
    own = ch.select("cell", "code", F.col("receiver").alias("down")).join(ch.select(F.col("cell").alias("down"), F.lit(True).alias("on")), "down", "left")
    inner = own.select("cell", "code", F.when(F.col("on"), F.col("down")).alias("receiver"))
    orders = flow.strahler(inner.select("cell", "receiver")).select("cell", F.least("stream_order", F.lit(255)).alias("stream_order"))
    return inner.join(orders, "cell").groupBy("stream_order").agg(F.count("*").alias("n"), F.round(F.sum(flow.step_length(F.col("code"), RESOLUTION_M)) / 1e3, 3).alias("km"))


def world_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of verdicts over a plan: area is conserved, no cell flows uphill, no cycle, every flow ends in a terminal."""
    f = forest(spark, sf_dir)
    try:  # before anything is summed, as sums raise on a cycle too
        ends, acyclic = flow.outlets(f.select("cell", "receiver")), True
    except ValueError:
        ends, acyclic = f.select("cell", F.col("cell").alias("outlet")), False
    own = areas(f) if acyclic else f.withColumn("area", F.lit(AREA))
    a = written(own.select("cell", "receiver", "z", "area"), "areas")
    down = a.select(F.col("cell").alias("receiver"), F.col("z").alias("z_down"), F.lit(True).alias("there"))
    x = a.join(down, "receiver", "left").join(ends.select("cell", "outlet"), "cell")
    total, collected = F.count("*") * F.lit(AREA), F.sum(F.when(F.col("receiver").isNull(), F.col("area")))
    return x.agg(
        (F.abs(collected - total) <= 1e-10 * total).alias("conserved"), F.round(F.max(F.greatest(F.col("z_down") - F.col("z"), F.lit(0.0))), 6).alias("largest_rise"), F.lit(acyclic).alias("acyclic"),
        F.count_if(F.col("receiver").isNotNull() & F.col("there").isNull()).alias("n_lost"), F.countDistinct("outlet").alias("n_outlets"),
    )


def basin_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catchments of terminals in classes of size: how many, their cells, how much of them filling raised and how far."""
    f = written(routed(spark, sf_dir, zone=False).select("cell", "receiver", "w", "z"), "routed")
    up = F.col("w") - F.col("z")
    b = f.join(flow.outlets(f.select("cell", "receiver")), "cell").groupBy("outlet").agg(F.count("*").alias("n"), F.count_if(up > 0.05).alias("raised"), F.max(up).alias("depth"))
    return b.groupBy(F.floor(F.log2("n")).alias("size_class")).agg(F.count("*").alias("n_basins"), F.sum("n").alias("n_cells"), F.sum("raised").alias("n_raised"), F.round(F.max("depth"), 4).alias("depth"))


def unit_maturity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of units that reach a quarter of their target, as a distribution, and how many fall short."""
    u = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum("l_quantity"), 2).alias("size"), F.count("*").alias("n"))
    ripe = F.when(F.col("size") >= 0.25 * 60000 * F.col("n") / 1000, F.col("size"))
    u = written(u.select(ripe.alias("ripe")), "units")
    return st.beside(st.summary(u, [], "ripe", 4), u.agg(F.count_if(F.col("ripe").isNull()).alias("n_short")), [])


def channel_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels by zone: length, and distribution of area, discharge and specific runoff in litres per second and square kilometre."""
    ch = written(areas(forest(spark, sf_dir)).where((F.col("area") >= CHANNEL_M2) & F.col("code").between(1, 8)).select("zone", "code", "area", "q"), "channels")
    of = ch.groupBy("zone").agg(
        F.count("*").alias("n"), F.round(F.sum(flow.step_length(F.col("code"), RESOLUTION_M)) / 1e3, 3).alias("km"),
        F.round(F.max("q"), 6).alias("most_q"), F.round(F.avg(F.col("q") / F.col("area") * 1e9), 6).alias("specific_runoff"), F.round(F.max(F.col("q") / (F.col("area") / 1e6) * hy.SECONDS_PER_YEAR / 1e3), 4).alias("runoff_mm"),
    )
    return st.beside(of, st.quantiles(ch, ["zone"], "area", {"area_p50": 0.5, "area_p90": 0.9}, 4), ["zone"])


def epoch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors averaged within samples, then over them; and the largest error of a sample's mean against its parent."""
    x = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_extendedprice") / 1000).alias("got"), F.col("l_quantity").alias("target"))
    d = F.col("got") - F.col("target")
    s = x.groupBy("l_suppkey").agg(F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.abs(F.avg("got") - F.avg("target")).alias("parent"))
    return s.agg(F.count("*").alias("n"), F.round(F.avg("mae"), 6).alias("mae"), F.round(F.avg("rmse"), 6).alias("rmse"), F.round(F.max("parent"), 6).alias("parent_error"))


def ring_inflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What enters each window of 16 by 16 cells from the ring around it: cells whose receiver lies inside, and the area they bring."""
    a = areas(forest(spark, sf_dir)).select("cell", "r", "c", "receiver", "area")
    to = a.select(F.col("cell").alias("receiver"), F.floor(F.col("r") / 16).alias("wr"), F.floor(F.col("c") / 16).alias("wc"))
    x = a.where("receiver is not null").join(to, "receiver").where((F.floor(F.col("r") / 16) != F.col("wr")) | (F.floor(F.col("c") / 16) != F.col("wc")))
    return x.groupBy("wr", "wc").agg(F.count("*").alias("n"), F.countDistinct("receiver").alias("n_entries"), F.sum("area").alias("area"), F.max_by("cell", F.struct("area", -F.col("cell"))).alias("largest"))


def zone_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight-connected patches of one order status within one zone: boxes, and whether a patch touches the edge of the grid."""
    g = order_grid(spark, sf_dir).withColumn("dear", F.col("price") > 300000)
    edge = g.agg(F.max("r").alias("mr"), F.max("c").alias("mc"))
    p = components.patches(g.select("cell", "r", "c", F.concat_ws("/", "zone", "dear").alias("kind")), same="kind").join(g, "cell")
    box = p.groupBy("patch").agg(F.count("*").alias("n"), F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.first("zone").alias("zone"))
    closed = (F.col("r0") > 0) & (F.col("c0") > 0) & (F.col("r1") < F.col("mr")) & (F.col("c1") < F.col("mc"))
    return box.join(F.broadcast(edge)).select("patch", "n", "r0", "r1", "c0", "c1", "zone", closed.alias("closed"))


def lakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lakes of the routed grid: patches that filling raised, large and deep enough but not too large, within a budget of
    cells: small ones first, then in hash order whichever still fits. A lake's level is the mean of its filled cells."""
    f = written(routed(spark, sf_dir, zone=False).select("cell", "r", "c", "z", "w", "terminal"), "routed")
    up = F.col("w") - F.col("z")
    p = components.patches(f.where(~F.col("terminal") & (up > 0.05)).select("cell", "r", "c")).join(f.select("cell", "z", "w"), "cell")
    lake = p.groupBy("patch").agg(F.count("*").alias("n"), F.max(up).alias("depth"), F.avg("w").alias("level")).where("n between 2 and 40 and depth >= 2000")
    lake = written(lake.select(F.col("patch").alias("id"), "n", identity.probe_key(F.col("patch")).alias("key"), "depth", "level"), "lakes")
    budget = int(f.count() * 0.03)
    return picked(lake, budget).select(F.col("id").alias("patch"), "n", F.round("depth", 2).alias("depth"), F.round("level", 4).alias("level"), "phase")


def _picked_sql(sizes: str, budget: str) -> str:
    """Rows of `sizes` (id, n, key) taken one by one in both phases; the counter k walks over the rows in order."""
    return f"""{sizes}, bud as (select {budget} as budget), o1 as materialized (select *, row_number() over (order by n, key, id) as k from sz),
 w1(k, used, id, got) as (select 0, cast(0 as bigint), cast(-1 as bigint), false union all select o1.k, w1.used + case when w1.used + o1.n <= floor(bud.budget * 0.7) then o1.n else 0 end, o1.id, w1.used + o1.n <= floor(bud.budget * 0.7) from w1 join o1 on o1.k = w1.k + 1, bud),
 u1 as (select max(used) as used from w1), o2 as materialized (select *, row_number() over (order by key, id) as k from sz where id not in (select id from w1 where got)),
 w2(k, used, id, got) as (select 0, u1.used, cast(-1 as bigint), false from u1 union all select o2.k, w2.used + case when w2.used + o2.n <= bud.budget then o2.n else 0 end, o2.id, w2.used + o2.n <= bud.budget from w2 join o2 on o2.k = w2.k + 1, bud),
 pk as (select id, 1 as phase from w1 where got union all select id, 2 from w2 where got)"""


_KEY = "(({} + 1) * 2654435761) & 4294967295"
QUERIES = {
    "probed_codes": (probed_codes, """with recursive m as (select 2 * count(*) as m from part), p(round, p_partkey, slot, busy) as (
 select 0, p_partkey, (((p_partkey + 1) * 2654435761) & 4294967295) % m, true from part, m
 union all select round + 1, p_partkey, case when rn = 1 then slot else (slot + 1) % m end, moved > 0 from (
  select *, count(*) filter (rn > 1) over () as moved from (select p.*, row_number() over (partition by slot order by p_partkey) as rn from p where busy) x) y, m where moved > 0)
 select p_partkey, slot from p where round = (select max(round) from p)"""),
    "heaviest_inflow": (heaviest_inflow, """with o as (select o_custkey as c_custkey, o_orderkey, o_totalprice, cast(o_orderpriority[1] as integer) as code from orders),
 x as (select c.c_custkey, o.code, o.o_totalprice, o.o_orderkey, case when c.c_custkey % 2 = 0 then cast(c.c_custkey % 5 as integer) + 1 end as own, lag(o.code) over (partition by c.c_custkey order by o.o_totalprice, o.o_orderkey) as before from customer c left join o using (c_custkey))
 select c_custkey, coalesce(max(struct_pack(p := o_totalprice, k := o_orderkey, code := code)) filter (code is not null).code, any_value(own)) as code, count(*) filter (code <> coalesce(before, own)) as conflicts from x group by c_custkey"""),
    "context_matrix": (context_matrix, """with e as (select c_mktsegment, cast(s as integer) as seed from (select distinct c_mktsegment from customer), range(7) t(s)),
 h as (select c_mktsegment, cast(c_custkey % 7 as integer) as seed, round(avg(c_acctbal), 4) as mean from customer where c_custkey % 7 <> 3 or c_nationkey % 2 = 0 group by 1, 2) select e.c_mktsegment, e.seed, mean from e left join h using (c_mktsegment, seed)"""),
    "size_ranks": (size_ranks, "select l_suppkey, count(*) as n, row_number() over (order by count(*) desc, l_suppkey) as place from lineitem group by l_suppkey"),
    "appended_ids": (appended_ids, "select s_suppkey as id, s_name as name from supplier union all select (select coalesce(max(s_suppkey), -1) + 1 from supplier) + row_number() over (order by c_nationkey, c_custkey) - 1, c_name from customer"),
    "graph_json": (graph_json, FLOW_SQL + " select cell, '{\"source\":' || cell || ',\"target\":' || receiver || ',\"code\":' || code || '}' as edge from f where receiver is not null"),
    "logged_metrics": (logged_metrics, "select cast(o_orderkey % 3 as integer) as epoch, o_orderstatus as status, round(avg(o_totalprice), 4) as loss, case when o_orderkey % 3 = 2 then count(*) end as n from orders group by o_orderkey % 3, o_orderstatus"),
    "stored_tiles": (stored_tiles, _G + "select c // 16 as tx, count(*) as n, round(sum(price), 2) as total, true as refused from g where r // 16 = 1 group by 1"),
    "csv_union": (csv_union, "select c_nationkey as nation, count(*) as n_customers, cast(null as double) as balance from customer group by 1 union all select s_nationkey, null, round(max(s_acctbal), 2) from supplier group by 1"),
    "any_overlap": (any_overlap, "select 'inside' as \"window\", exists (select 1 from orders where not (o_totalprice > 600000 or o_totalprice + 10 < 1000)) as meets union all select 'beyond', exists (select 1 from orders where not (o_totalprice > 2e9 or o_totalprice + 10 < 1e9))"),
    "greedy_budget": (greedy_budget, "with recursive " + _picked_sql(f"sz as materialized (select l_suppkey as id, count(*) as n, {_KEY.format('l_suppkey')} as key from lineitem group by l_suppkey)", "(select count(*) // 2 from lineitem)") + " select id as l_suppkey, n, phase from pk join sz using (id)"),
    "stream_lengths": (stream_lengths, FLOW_SQL.replace("f as materialized (", "f0 as materialized (").replace(" from f ", " from f0 ").replace("join f on up.cell", "join f0 on up.cell").replace(" f.receiver", " f0.receiver").replace("up.cell = f.cell", "up.cell = f0.cell")
     + f", ch as materialized (select f0.cell, f0.code, f0.receiver from f0 join a using (cell) where a.area >= {CHANNEL_M2} and f0.code between 1 and 8), f as materialized (select ch.cell, ch.code, d.cell as receiver from ch left join ch d on ch.receiver = d.cell)" + _ORDERS + f" select cast(k as integer) as stream_order, count(*) as n, round(sum({_STEP}) / 1e3, 3) as km from st join f using (cell) group by k"),
    "world_checks": (world_checks, FLOW_SQL + f""", x as (select f.cell, f.receiver, f.z, a.area, t.z as z_down, t.cell as there, o.outlet from f join a using (cell) join o using (cell) left join f t on f.receiver = t.cell)
 select abs(sum(area) filter (receiver is null) - count(*) * {AREA}) <= 1e-10 * count(*) * {AREA} as conserved, round(max(greatest(z_down - z, 0.0)), 6) as largest_rise, true as acyclic, count(*) filter (receiver is not null and there is null) as n_lost, count(distinct outlet) as n_outlets from x"""),
    "basin_inventory": (basin_inventory, COAST_SQL + _UP + """, o as (select origin as cell, max_by(cell, steps) as outlet from up group by origin), b as (select outlet, count(*) as n, count(*) filter (w - z > 0.05) as raised, max(w - z) as depth from o join f using (cell) group by outlet)
 select cast(floor(log2(n)) as bigint) as size_class, count(*) as n_basins, cast(sum(n) as bigint) as n_cells, cast(sum(raised) as bigint) as n_raised, round(max(depth), 4) as depth from b group by 1"""),
    "unit_maturity": (unit_maturity, f"with u as (select l_suppkey, round(sum(l_quantity), 2) as size, count(*) as n from lineitem group by 1), r as (select case when size >= 0.25 * 60000 * n / 1000 then size end as ripe from u) select {_summary_sql('ripe', 4)}, count(*) filter (ripe is null) as n_short from r"),
    "channel_report": (channel_report, FLOW_SQL + _CH + f""" select zone, count(*) as n, round(sum({_STEP}) / 1e3, 3) as km, round(quantile_cont(cast(area as double), 0.5), 4) as area_p50, round(quantile_cont(cast(area as double), 0.9), 4) as area_p90, round(max(q), 6) as most_q,
 round(avg(q / area * 1e9), 6) as specific_runoff, round(max(q / (area / 1e6) * {hy.SECONDS_PER_YEAR} / 1e3), 4) as runoff_mm from ch group by zone"""),
    "epoch_metrics": (epoch_metrics, "with x as (select l_suppkey, l_extendedprice / 1000 as got, l_quantity as target from lineitem), s as (select avg(abs(got - target)) as mae, sqrt(avg((got - target) * (got - target))) as rmse, abs(avg(got) - avg(target)) as parent from x group by l_suppkey) select count(*) as n, round(avg(mae), 6) as mae, round(avg(rmse), 6) as rmse, round(max(parent), 6) as parent_error from s"),
    "ring_inflow": (ring_inflow, FLOW_SQL + """ select t.r // 16 as wr, t.c // 16 as wc, count(*) as n, count(distinct f.receiver) as n_entries, cast(sum(area) as double) as area, max(struct_pack(p := area, k := -f.cell)).k * -1 as largest
 from f join a using (cell) join f t on f.receiver = t.cell where f.r // 16 <> t.r // 16 or f.c // 16 <> t.c // 16 group by 1, 2"""),
    "zone_patches": (zone_patches, f"""with recursive {GRID_SQL}, q as materialized (select *, concat(zone, '/', price > 300000) as kind from g), s(dr, dc) as (values (0,1),(1,1),(1,0),(1,-1),(0,-1),(-1,-1),(-1,0),(-1,1)),
 e as materialized (select a.cell, b.cell as nbr from (select q.cell, q.kind, q.r + dr as r, q.c + dc as c from q, s) a join q b on a.r = b.r and a.c = b.c and a.kind = b.kind),
 lab(cell, patch) using key (cell) as (select cell, cell from q union select x.cell, x.patch from (select e.nbr as cell, min(lab.patch) as patch from lab join e on e.cell = lab.cell group by e.nbr) x join recurring.lab o on o.cell = x.cell where x.patch < o.patch),
 m as (select max(r) as mr, max(c) as mc from g) select patch, count(*) as n, min(r) as r0, max(r) as r1, min(c) as c0, max(c) as c1, any_value(zone) as zone, min(r) > 0 and min(c) > 0 and max(r) < any_value(mr) and max(c) < any_value(mc) as closed from lab join q using (cell), m group by patch"""),
    "lakes": (lakes, COAST_SQL + f""", dp as materialized (select f.cell, f.w, f.z, g.r, g.c from f join g using (cell) where not f.terminal and f.w - f.z > 0.05),
 e as materialized (select a.cell, b.cell as nbr from (select dp.cell, dp.r + d.dr as r, dp.c + d.dc as c from dp, d) a join dp b on a.r = b.r and a.c = b.c),
 lab(cell, patch) using key (cell) as (select cell, cell from dp union select x.cell, x.patch from (select e.nbr as cell, min(lab.patch) as patch from lab join e on e.cell = lab.cell group by e.nbr) x join recurring.lab o on o.cell = x.cell where x.patch < o.patch),
 lk as materialized (select patch, count(*) as n, max(w - z) as depth, avg(w) as level from lab join dp using (cell) group by patch having count(*) between 2 and 40 and max(w - z) >= 2000), """
     + _picked_sql(f"sz as materialized (select patch as id, n, {_KEY.format('patch')} as key from lk)", "(select cast(floor(count(*) * 0.03) as bigint) from f)") + " select patch, n, round(depth, 2) as depth, round(level, 4) as level, phase from pk join lk on pk.id = lk.patch"),
}
