"""Queries in the shapes of the catalog and river-graph store: joins, upserts, set operations, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillspark.functions import identity
from rillspark.operators import flow
from rillspark.operators import relational as rel
from rillspark.plans.drainage import FLOW_SQL
from rillspark.sources.grids import GRID_SQL, order_grid, table


def major_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equi-join with a range filter."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.where("c_acctbal >= 5000").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "c_acctbal")


def window_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a rectangle, by ranges of rows and columns that the scan can prune by."""
    return order_grid(spark, sf_dir).where("r between 3 and 17 and c between 5 and 21").select("cell", "r", "c", "price")


def overlapping_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of intervals on one part's shelf that overlap: a range join within bins, so no cross join."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.unix_date(F.to_date("l_shipdate")).cast("long").alias("lo"), F.col("l_quantity").cast("long").alias("len"))
    spans = li.select("l_partkey", "l_orderkey", "l_linenumber", "lo", (F.col("lo") + F.col("len")).alias("hi"))
    return rel.overlaps(spans, "l_partkey", ["l_orderkey", "l_linenumber"], 64).groupBy("l_partkey").agg(F.count("*").alias("n"))


def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("big", F.when(F.col("value") > 10, F.col("value")))
    return e.agg(F.count("*").alias("n"), F.count_if(F.col("big").isNull()).alias("n_null"), F.count("big").alias("n_set"), (F.coalesce(F.max("event_id"), F.lit(-1)) + 1).alias("next_id"))


def fill_from_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing value takes the smallest of its group, where the group has one."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).alias("price"))
    return rel.fill_by_group(o, "o_custkey", "price")


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows replace old ones by key and others stay."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.lit(1).alias("version"))
    new = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal")).withColumn("version", F.lit(2))
    return rel.upsert(c, new, ["c_custkey"])


def immutable_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows offered again with another value than the stored one."""
    old = table(spark, sf_dir, "part").select("p_partkey", F.floor("p_retailprice").alias("value"))
    new = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.floor(F.col("l_extendedprice") / F.col("l_quantity")).alias("value")).distinct()
    return rel.conflicts(old, new, ["p_partkey"], "value")


def present_and_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with orders, without, and orders without a customer."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    key = F.col("c_custkey") == F.col("o_custkey")
    parts = {"with": c.join(o, key, "left_semi"), "without": c.join(o, key, "left_anti"), "orphans": o.join(c, key, "left_anti")}
    counted = [d.agg(F.lit(k).alias("what"), F.count("*").alias("n")) for k, d in parts.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


def required_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of 16 by 16 cells and their neighbours across edges and corners, minus those that exist."""
    g = order_grid(spark, sf_dir).select(F.floor(F.col("r") / 16).alias("rr"), F.floor(F.col("c") / 16).alias("rc")).distinct()
    near = [F.struct((F.col("rr") + i).alias("rr"), (F.col("rc") + j).alias("rc")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    around = g.select(F.explode(F.array(*near)).alias("x")).select("x.*").distinct()
    return around.join(g, ["rr", "rc"], "left_anti")


def region_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between neighbours in a row that cross from one region of 16 columns into another."""
    g = order_grid(spark, sf_dir).select("r", "c", "price")
    right = g.select("r", (F.col("c") - 1).alias("c"), F.col("price").alias("next"))
    x = g.join(right, ["r", "c"]).where(F.floor(F.col("c") / 16) != F.floor((F.col("c") + 1) / 16))
    return x.groupBy(F.floor(F.col("c") / 16).alias("region")).agg(F.count("*").alias("n"), F.round(F.sum(F.abs(F.col("next") - F.col("price"))), 2).alias("step"))


def best_in_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each dear cell the dearest other cell within four rows and columns: a band join on tiles, then an arg max."""
    g = order_grid(spark, sf_dir).select("cell", "r", "c", "price")
    return rel.best_within(g.where("price > 450000"), g, 4, "price")


def default_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return s.join(n, "s_suppkey", "left").select("s_suppkey", "s_nationkey", F.coalesce("n", F.lit(-1)).alias("n"))


def key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys on one side only, both ways."""
    a = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("k")).distinct()
    b = table(spark, sf_dir, "lineitem").where("l_discount > 0.09").select(F.col("l_partkey").alias("k")).distinct()
    return a.exceptAll(b).select(F.lit("first").alias("side"), "k").unionByName(b.exceptAll(a).select(F.lit("second").alias("side"), "k"))


def column_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n_customers")).withColumnRenamed("c_nationkey", "nation")
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n_suppliers")).withColumnRenamed("s_nationkey", "nation")
    return c.unionByName(s, allowMissingColumns=True)


def state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose lines went through: a state moves on only along allowed transitions, and dates once set stay."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_and(F.col("l_linestatus") == "F").alias("done"), F.max("l_shipdate").alias("shipped"))
    o = table(spark, sf_dir, "orders").join(li, "o_orderkey", "left")
    state = F.when((F.col("o_orderstatus") == "O") & F.col("done"), "F").otherwise(F.col("o_orderstatus"))
    return o.groupBy(F.col("o_orderstatus").alias("was"), state.alias("now")).agg(F.count("*").alias("n"), F.max(F.coalesce("shipped", "o_orderdate")).alias("last"))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured fields of a JSON column with an explicit schema; what fails to parse is missing."""
    e = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k long")["k"])
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("most"))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of a canonical text of each row's key fields."""
    n = table(spark, sf_dir, "customer")
    return n.select("c_custkey", F.sha2(F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name", F.col("c_nationkey").cast("string"), "c_mktsegment"), 256).alias("sha256"))


def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stable identifier and a file name for every region of 16 by 16 cells."""
    g = order_grid(spark, sf_dir).select((F.floor(F.col("r") / 16) - 2).alias("rr"), (F.floor(F.col("c") / 16) - 2).alias("rc")).distinct()
    return g.select("rr", "rc", identity.stable_id(F.lit("region"), F.col("rr"), F.col("rc")).alias("id"), identity.region_file(F.col("rr"), F.col("rc")).alias("file"))


def boundary_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow links between cells of adjacent regions, as contracts of the pair: how many, and that corners are not adjacent."""
    g = order_grid(spark, sf_dir)
    rr, rc = (F.floor(F.col(x) / 16) for x in ("r", "c"))
    f = flow.receivers(g).select("cell", "receiver", rr.alias("ar"), rc.alias("ac"))
    to = g.select(F.col("cell").alias("receiver"), rr.alias("br"), rc.alias("bc"))
    x = f.join(to, "receiver").where("ar <> br or ac <> bc")
    apart = F.abs(F.col("ar") - F.col("br")) + F.abs(F.col("ac") - F.col("bc"))
    return x.groupBy("ar", "ac", "br", "bc").agg(F.count("*").alias("n"), F.max(apart == 1).alias("adjacent"))


_G = f"with {GRID_SQL} "
QUERIES = {
    "major_groups": (major_groups, "select c_custkey, n_name, c_acctbal from customer join nation on c_nationkey = n_nationkey where c_acctbal >= 5000"),
    "window_scan": (window_scan, _G + "select cell, r, c, price from g where r between 3 and 17 and c between 5 and 21"),
    "overlapping_windows": (overlapping_windows, """with s as (select l_partkey, l_orderkey, l_linenumber, date_diff('day', date '1970-01-01', cast(l_shipdate as date)) as lo, date_diff('day', date '1970-01-01', cast(l_shipdate as date)) + cast(l_quantity as bigint) as hi from lineitem)
 select a.l_partkey, count(*) as n from s a join s b on a.l_partkey = b.l_partkey and (a.l_orderkey, a.l_linenumber) < (b.l_orderkey, b.l_linenumber) and a.lo <= b.hi and b.lo <= a.hi group by 1"""),
    "null_counts": (null_counts, "select count(*) as n, count(*) filter (not value > 10 or value is null) as n_null, count(*) filter (value > 10) as n_set, coalesce(max(event_id), -1) + 1 as next_id from events"),
    "fill_from_group": (fill_from_group, "with o as (select o_orderkey, o_custkey, case when o_orderstatus = 'O' then o_totalprice end as price from orders) select o_orderkey, o_custkey, coalesce(price, (select min(p.price) from o p where p.o_custkey = o.o_custkey)) as price from o"),
    "upserted": (upserted, "with u as (select o_custkey as c_custkey, max(o_totalprice) as c_acctbal from orders group by 1) select coalesce(u.c_custkey, c.c_custkey) as c_custkey, case when u.c_custkey is null then c.c_acctbal else u.c_acctbal end as c_acctbal, case when u.c_custkey is null then 1 else 2 end as version from customer c full join u on c.c_custkey = u.c_custkey"),
    "immutable_conflicts": (immutable_conflicts, "with x as (select distinct l_partkey as p_partkey, cast(floor(l_extendedprice / l_quantity) as bigint) as offered from lineitem) select p_partkey, cast(floor(p_retailprice) as bigint) as stored, offered from part join x using (p_partkey) where cast(floor(p_retailprice) as bigint) is distinct from offered"),
    "present_and_missing": (present_and_missing, "select 'with' as what, count(*) as n from customer where c_custkey in (select o_custkey from orders) union all select 'without', count(*) from customer where not exists (select 1 from orders where o_custkey = c_custkey) union all select 'orphans', count(*) from orders where not exists (select 1 from customer where o_custkey = c_custkey)"),
    "required_regions": (required_regions, _G + ", x as (select distinct r // 16 as rr, c // 16 as rc from g), y as (select distinct rr + i as rr, rc + j as rc from x, (select unnest([-1, 0, 1]) as i), (select unnest([-1, 0, 1]) as j)) select rr, rc from y except select rr, rc from x"),
    "region_crossings": (region_crossings, _G + "select a.c // 16 as region, count(*) as n, round(sum(abs(b.price - a.price)), 2) as step from g a join g b on a.r = b.r and b.c = a.c + 1 where a.c // 16 <> b.c // 16 group by 1"),
    "best_in_reach": (best_in_reach, _G + "select a.cell, max(struct_pack(p := b.price, k := -b.cell)).k * -1 as best, max(b.price) as price from g a join g b on b.r between a.r - 4 and a.r + 4 and b.c between a.c - 4 and a.c + 4 and b.cell <> a.cell where a.price > 450000 group by a.cell"),
    "default_join": (default_join, "select s_suppkey, s_nationkey, coalesce(n, -1) as n from supplier left join (select l_suppkey, count(*) as n from lineitem where l_returnflag = 'R' and l_quantity > 45 group by 1) on l_suppkey = s_suppkey"),
    "key_sets": (key_sets, "with a as (select distinct l_partkey as k from lineitem where l_quantity > 49), b as (select distinct l_partkey as k from lineitem where l_discount > 0.09) select 'first' as side, k from (from a except from b) union all select 'second', k from (from b except from a)"),
    "column_union": (column_union, "select c_nationkey as nation, count(*) as n_customers, cast(null as bigint) as n_suppliers from customer group by 1 union all select s_nationkey, null, count(*) from supplier group by 1"),
    "state_changes": (state_changes, """with x as (select l_orderkey, bool_and(l_linestatus = 'F') as done, max(l_shipdate) as shipped from lineitem group by 1) select o_orderstatus as was, case when o_orderstatus = 'O' and done then 'F' else o_orderstatus end as now, count(*) as n, max(coalesce(shipped, o_orderdate)) as last
 from orders left join x on l_orderkey = o_orderkey group by 1, 2"""),
    "json_props": (json_props, "with x as (select event_type, try_cast(json_extract_string(props, '$.k') as bigint) as k from events) select event_type, count(k) as n, cast(sum(k) as bigint) as total, max(k) as most from x group by 1"),
    "stable_ids": (stable_ids, None),
    "boundary_contracts": (boundary_contracts, FLOW_SQL + " select f.r // 16 as ar, f.c // 16 as ac, t.r // 16 as br, t.c // 16 as bc, count(*) as n, abs(f.r // 16 - t.r // 16) + abs(f.c // 16 - t.c // 16) = 1 as adjacent from f join f t on f.receiver = t.cell where f.r // 16 <> t.r // 16 or f.c // 16 <> t.c // 16 group by all"),
    "fingerprints": (fingerprints, "select c_custkey, sha256(concat_ws('|', c_custkey::varchar, c_name, c_nationkey::varchar, c_mktsegment)) as sha256 from customer"),
}
