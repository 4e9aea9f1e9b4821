"""Join and update shapes of a catalog that Spark has no single operation for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and those of old whose keys new lacks. Keys are unique on both sides."""
    new = new.select(*old.columns)
    return old.join(new, keys, "left_anti").unionByName(new)


def conflicts(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of new whose key is stored with another value; equal rows may be offered again."""
    both = old.withColumnRenamed(value, "stored").join(new.withColumnRenamed(value, "offered"), keys)
    return both.where(~F.col("stored").eqNullSafe(F.col("offered"))).select(*keys, "stored", "offered")


def fill_by_group(df: DataFrame, group: str, value: str) -> DataFrame:
    """A null takes the smallest value of its group. The group's value is summed up before it is joined back, so a large group is no burden."""
    least = df.groupBy(group).agg(F.min(value).alias("_least"))
    filled = df.join(least, group, "left").withColumn(value, F.coalesce(value, "_least"))
    return filled.select(*df.columns)


def overlaps(spans: DataFrame, group: str, key: list[str], width: int) -> DataFrame:
    """Pairs (in order of key) of spans lo..hi of one group that overlap, ends included.

    Spans meet in bins of `width` that both touch; the bin that holds the larger
    of the two starts keeps the pair, so each comes once.
    """
    binned = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    a, b = binned.alias("a"), binned.alias("b")
    meets = (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("a._bin") == F.col("b._bin"))
    order = F.struct(*(F.col(f"a.{k}") for k in key)) < F.struct(*(F.col(f"b.{k}") for k in key))
    touch = (F.col("a.lo") <= F.col("b.hi")) & (F.col("b.lo") <= F.col("a.hi"))
    once = F.col("a._bin") == F.floor(F.greatest("a.lo", "b.lo") / width)
    return a.join(b, meets & order & touch & once).select(F.col(f"a.{group}").alias(group), *(F.col(f"{s}.{k}").alias(f"{s}_{k}") for s in "ab" for k in key))


def best_within(probes: DataFrame, cells: DataFrame, reach: int, value: str) -> DataFrame:
    """(cell, best, value): for each probe the other cell with the largest value within `reach` rows and columns, ties to the
    smaller cell. Probes go to each tile their square touches and meet the tile's cells there; a tile holds reach ** 2 cells
    at most, so no key is crowded."""
    near = F.sequence(F.lit(-1), F.lit(1))
    tile = lambda x: F.floor(F.col(x) / reach)
    sent = probes.select(F.col("cell").alias("probe"), F.col("r").alias("pr"), F.col("c").alias("pc"), F.explode(F.transform(near, lambda i: tile("r") + i)).alias("tr"))
    sent = sent.select("probe", "pr", "pc", "tr", F.explode(F.transform(near, lambda j: F.floor(F.col("pc") / reach) + j)).alias("tc"))
    tiled = cells.select("cell", "r", "c", value, tile("r").alias("tr"), tile("c").alias("tc"))
    met = sent.join(tiled, ["tr", "tc"]).where((F.abs(F.col("r") - F.col("pr")) <= reach) & (F.abs(F.col("c") - F.col("pc")) <= reach) & (F.col("cell") != F.col("probe")))
    best = met.groupBy(F.col("probe").alias("cell")).agg(F.max(F.struct(F.col(value), (-F.col("cell")).alias("k"))).alias("x"))
    return best.select("cell", (-F.col("x.k")).alias("best"), F.col(f"x.{value}").alias(value))


def probe_slots(ids: DataFrame, id_col: str, start: str, modulus: int) -> DataFrame:
    """(id, slot): each id's first free slot from `start` on, as if ids came in their order (linear probing).

    Rounds of offers: a slot keeps the smallest id that asks for it, others go
    on to the next. All slots prefer smaller ids, so what rounds end in is what
    inserting one by one gives. Collisions are few, and so are rounds.
    """
    from rillspark.sources.shared import discard, written

    now = written(ids.select(F.col(id_col).alias("id"), F.pmod(F.col(start), F.lit(modulus)).cast("long").alias("slot")), "slots")
    while True:
        first = now.groupBy("slot").agg(F.min("id").alias("first"), F.count("*").alias("n"))
        if first.where("n > 1").isEmpty():
            return now
        moved = now.join(first, "slot").select("id", F.when(F.col("id") == F.col("first"), F.col("slot")).otherwise(F.pmod(F.col("slot") + 1, F.lit(modulus))).alias("slot"))
        last, now = now, written(moved, "slots")
        discard(last)


#: Ranges that a key of 32 bits is cut into for running sums, so no task orders all rows.
RANGES = 256


def running(df: DataFrame, size: str, key: str) -> DataFrame:
    """df with used: sums of size in the order of a 32-bit key, itself included; equal keys go by id."""
    part = F.shiftright(F.col(key), 24)
    cut = df.withColumn("_part", part)
    sums = cut.groupBy("_part").agg(F.sum(size).alias("_sum"))
    before = sums.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))  # at most RANGES rows
    own = F.sum(size).over(Window.partitionBy("_part").orderBy(key, "id").rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn("used", F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def running_small_first(groups: DataFrame, size: str, key: str) -> DataFrame:
    """groups (id, size, key, ...) with used: sums of size in the order of size, 32-bit key and id, itself included.

    Sizes are summed up first; only groups of one size and range of keys are
    ordered by one task.
    """
    cut = groups.withColumn("_part", F.shiftright(F.col(key), 24))
    sizes = groups.groupBy(size).agg(F.sum(size).alias("_sum"))
    smaller = sizes.select(size, (F.sum("_sum").over(Window.orderBy(size)) - F.col("_sum")).alias("_smaller"))  # a row for each size
    parts = cut.groupBy(size, "_part").agg(F.sum(size).alias("_sum"))
    before = parts.select(size, "_part", (F.sum("_sum").over(Window.partitionBy(size).orderBy("_part")) - F.col("_sum")).alias("_before"))
    own = F.sum(size).over(Window.partitionBy(size, "_part").orderBy(key, "id").rowsBetween(Window.unboundedPreceding, 0))
    found = cut.withColumn("_own", own).join(before, [size, "_part"]).join(smaller, size)
    return found.withColumn("used", F.col("_own") + F.col("_before") + F.col("_smaller")).drop("_part", "_own", "_before", "_smaller")


def greedy_fit(items: DataFrame, size: str, key: str, budget: int) -> DataFrame:
    """(id): items taken in the order of a 32-bit key (then id), each that still fits into the budget.

    items: (id, size, key). A round takes the items before the first that
    doesn't fit and drops that one and all that no longer can; what is left
    goes on. Rounds follow the items that don't fit though later ones do.
    """
    from rillspark.sources.shared import discard, written

    left, taken = written(items.select("id", size, key).where(F.col(size) <= budget), "items"), []
    while not left.isEmpty():
        sums = written(running(left, size, key), "sums")
        stop = sums.where(F.col("used") > budget).agg(F.min(F.struct(key, "id")).alias("at")).first()["at"]
        at = None if stop is None else F.struct(F.lit(stop[key]).cast("long").alias(key), F.lit(stop["id"]).cast("long").alias("id"))
        own = F.struct(F.col(key).cast("long").alias(key), F.col("id").cast("long").alias("id"))
        fits = sums if stop is None else sums.where(own < at)
        taken.append(written(fits.select("id"), "taken"))
        budget -= fits.agg(F.sum(size)).first()[0] or 0
        later = sums.limit(0) if stop is None else sums.where((own > at) & (F.col(size) <= budget))
        last, left = left, written(later.select("id", size, key), "items")
        discard(last, sums)
    found = items.select("id").limit(0)
    for t in taken:
        found = found.unionByName(t)
    return found
