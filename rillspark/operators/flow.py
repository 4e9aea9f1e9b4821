"""Drainage over D8 flow forests, by pointer doubling.

A forest is a table (cell, receiver): receiver is NULL at a terminal. A cycle
raises a ValueError, as no pointer of it ever ends. Walking
2^k receivers at once takes rounds in proportion to the logarithm of the
longest path, each of them an equi-join and a sum, where a walk cell by cell
would take one round for every step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillspark.sources.shared import counted, discard, written

#: D8 codes with their steps (fixed values): code, row step, column step.
D8 = ((1, 0, 1), (2, 1, 1), (3, 1, 0), (4, 1, -1), (5, 0, -1), (6, -1, -1), (7, -1, 0), (8, -1, 1))


def neighbours(grid: DataFrame, *values: str) -> DataFrame:
    """(r, c, code, from_cell, values...): each cell's values sent to its eight neighbours; code points back to the sender."""
    steps = F.array(*(F.struct(F.lit(k).alias("code"), F.lit(-dr).alias("dr"), F.lit(-dc).alias("dc")) for k, dr, dc in D8))
    sent = grid.select("cell", "r", "c", *values, F.explode(steps).alias("s"))
    return sent.select((F.col("r") + F.col("s.dr")).alias("r"), (F.col("c") + F.col("s.dc")).alias("c"), F.col("s.code").alias("code"), F.col("cell").alias("from_cell"), *values)


def receivers(grid: DataFrame, z: str = "z") -> DataFrame:
    """grid with code and receiver: the lowest neighbour (then the smallest cell) that lies lower.

    Cells that lack one of eight neighbours are terminals, as are pits. One
    shuffle: each cell sends its height around, and heights meet by position.
    """
    own = grid.select("r", "c", F.lit(0).alias("code"), F.col("cell").alias("from_cell"), F.col(z).alias("h"))
    sent = neighbours(grid.select("cell", "r", "c", F.col(z).alias("h")), "h")
    lowest = F.min(F.when(F.col("code") > 0, F.struct("h", "from_cell", "code")))
    met = own.unionByName(sent).groupBy("r", "c").agg(
        F.max(F.when(F.col("code") == 0, F.struct("from_cell", "h"))).alias("own"), lowest.alias("low"), F.count_if(F.col("code") > 0).alias("n")
    )
    flows = (F.col("n") == 8) & (F.struct(F.col("low.h"), F.col("low.from_cell")) < F.struct(F.col("own.h"), F.col("own.from_cell")))
    down = met.where(F.col("own").isNotNull()).select(
        F.col("own.from_cell").alias("cell"), F.when(flows, F.col("low.code")).otherwise(0).alias("code"), F.when(flows, F.col("low.from_cell")).alias("receiver")
    )
    return grid.join(down, "cell")


def step_length(code: Column, resolution_m: float) -> Column:
    return F.when(code % 2 == 0, F.lit(resolution_m * 2**0.5)).otherwise(F.lit(resolution_m))


def _rounds(rows: int):
    """Rounds of pointer doubling that a forest of so many rows can need; more are a cycle."""
    yield from range(max(1, rows).bit_length() + 1)
    raise ValueError("the flow has a cycle")


def accumulate(forest: DataFrame, by=F.sum, **weights: Column) -> DataFrame:
    """(cell, name...): for each weight the sum (or by: F.min, F.max) over a cell and all that drains through it.

    After round k a cell with a pointer holds what lies fewer than 2^k steps
    upstream; what its 2^k-step senders hold comes next. A round reads and
    writes only cells that still have a pointer and what reaches others; those
    rows add up at the end.
    """
    plus = {F.min: F.least, F.max: F.greatest}.get(by, lambda a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))
    total = [plus(F.col(n), F.col(f"+{n}")).alias(n) for n in weights]
    now, rows = counted(forest.select("cell", F.col("receiver").alias("to"), *(w.cast("double").alias(n) for n, w in weights.items())), "accumulate")
    tables = [now]
    for _ in _rounds(rows):
        moving = now.where("to is not null")
        sent = moving.groupBy(F.col("to").alias("cell")).agg(*(by(n).alias(f"+{n}") for n in weights))
        jumps = moving.select(F.col("cell").alias("to"), F.col("to").alias("next"))
        now, rows = counted(moving.join(sent, "cell", "full").join(jumps, "to", "left").select("cell", F.col("next").alias("to"), *total), "accumulate")
        if not rows:
            break
        tables.append(now)
    whole = written(_ended(tables, weights).groupBy("cell").agg(*(by(n).alias(n) for n in weights)), "accumulated")
    discard(*tables, now)
    return whole


def _ended(tables: list[DataFrame], columns) -> DataFrame:
    """Rows without a pointer, of all tables."""
    ended = tables[0].where("to is null").select("cell", *columns)
    for t in tables[1:]:
        ended = ended.unionByName(t.where("to is null").select("cell", *columns))
    return ended


def downstream(forest: DataFrame, by=F.greatest, **values: Column) -> DataFrame:
    """(cell, name...): the largest value (or by: F.least) on the way from a cell to its outlet, both included."""
    own = forest.select("cell", F.col("receiver").alias("to"), *(v.cast("double").alias(n) for n, v in values.items()))
    return _led(own, {n: lambda n=n: by(n, f"+{n}") for n in values}, "downstream")


def outlets(forest: DataFrame) -> DataFrame:
    """(cell, outlet, steps): the terminal that a cell drains to and how many receivers away it is."""
    own = forest.select("cell", F.col("receiver").alias("to"), F.coalesce("receiver", "cell").alias("outlet"), F.col("receiver").isNotNull().cast("long").alias("steps"))
    return _led(own, {"outlet": lambda: F.col("+outlet"), "steps": lambda: F.col("steps") + F.col("+steps")}, "outlets")


def _led(own: DataFrame, then: dict, what: str) -> DataFrame:
    """own without its pointers `to`, each column joined by `then` with what lies ahead (+column) until the way ends.

    Cells whose way has ended are written once and looked up from there.
    """
    now, rows = counted(own, what)
    tables = [now]
    for _ in _rounds(rows):
        moving = now.where("to is not null")
        known = moving.select("cell", "to", *then).unionByName(_ended(tables, then), allowMissingColumns=True)
        ahead = known.select(F.col("cell").alias("to"), F.col("to").alias("next"), *(F.col(n).alias(f"+{n}") for n in then))
        now, rows = counted(moving.join(ahead, "to", "left").select("cell", F.col("next").alias("to"), *(F.when(F.col(f"+{n}").isNull(), F.col(n)).otherwise(f()).alias(n) for n, f in then.items())), what)
        if not rows:
            break
        tables.append(now)
    whole = written(_ended(tables, then), what)
    discard(*tables, now)
    return whole


def carved(forest: DataFrame, deepest: float) -> DataFrame:
    """(cell, bed): heights cut so that a cell lies at least `drop` below each that drains into it, by no more than `deepest`.

    forest: (cell, receiver, z, drop) and perhaps floor; drop is what the way to
    the receiver falls, and no bed is cut below its floor, or at all where the
    height itself lies below it. A step takes a bed x to x - drop, held between
    the lowest and z of the receiver; such steps in a row are one of their kind,
    so pointers double. Whole numbers stay exact.
    """
    low = F.col("z") - deepest
    if "floor" in forest.columns:
        low = F.greatest(low, F.least("z", F.coalesce("floor", low)))
    own = forest.select("cell", F.col("receiver").alias("to"), F.col("z").cast("double").alias("z"), F.col("drop").cast("double").alias("drop"), low.cast("double").alias("low"))
    ahead = own.select(F.col("cell").alias("to"), "low", F.col("z").alias("high"))
    own = own.drop("low")
    now, rows = counted(own.join(ahead, "to", "left").select("cell", "to", F.col("z").alias("bed"), "drop", "low", "high"), "carved")
    left = rows
    held = lambda x: F.least(F.col("high"), F.greatest(F.col("low"), x - F.col("drop")))
    for _ in _rounds(rows):
        if not left:
            return now.select("cell", "bed")
        moving = now.where("to is not null")
        sent = moving.groupBy(F.col("to").alias("cell")).agg(F.min(held(F.col("bed"))).alias("+bed"))
        jumps = moving.select(F.col("cell").alias("to"), F.col("to").alias("next"), *(F.col(x).alias(f"+{x}") for x in ("drop", "low", "high")))
        then = lambda x: F.least(F.col("+high"), F.greatest(F.col("+low"), x - F.col("+drop")))
        step = now.join(sent, "cell", "left").join(jumps, "to", "left").select(
            "cell", F.col("next").alias("to"), F.least("bed", F.coalesce("+bed", "bed")).alias("bed"), (F.col("drop") + F.col("+drop")).alias("drop"), then(F.col("low")).alias("low"), then(F.col("high")).alias("high")
        )
        last = now
        now, left = counted(step, "carved", F.col("to").isNotNull())
        discard(last)


def strahler(forest: DataFrame) -> DataFrame:
    """(cell, stream_order): 1 at sources, one more where two or more equal largest orders meet.

    Of cells that all have order k or more, one with no such cell upstream has
    order k, one with a single such sender has the sender's order, and one with
    more has at least k + 1. So chains of single senders take the order of
    their top cell; the tops with more senders, fewer than half of all cells,
    are the forest of the next order.
    """
    level, levels = forest.select("cell", "receiver"), []
    while True:
        senders = level.where("receiver is not null").groupBy(F.col("receiver").alias("cell")).agg(F.min("cell").alias("sender"), F.count("*").alias("n"))
        above, _ = counted(level.join(senders, "cell", "left").select("cell", "receiver", F.when(F.col("n") == 1, F.col("sender")).alias("sender"), (F.coalesce("n", F.lit(0)) > 1).alias("meets")), "senders")
        tops = outlets(above.select("cell", F.col("sender").alias("receiver"))).select("cell", F.col("outlet").alias("top"))
        # a chain leaves where its lowest cell does: at a cell whose receiver is a meeting or is none
        meets = above.select(F.col("cell").alias("top"), F.col("meets").alias("top_meets"))
        of, _ = counted(tops.join(meets, "top"), "tops")
        levels.append(of)
        leaves = above.join(of.where("top_meets"), "cell").join(above.where("meets").select(F.col("cell").alias("receiver"), F.lit(True).alias("ends")), "receiver", "left")
        level, rows = counted(leaves.where("receiver is null or ends").select(F.col("top").alias("cell"), "receiver"), "orders")
        if not rows:
            break
    order = None
    for k in range(len(levels), 0, -1):
        own = F.when(F.col("top_meets"), F.coalesce("+order", F.lit(k + 1))).otherwise(k) if order is not None else F.lit(k)
        found = levels[k - 1] if order is None else levels[k - 1].join(order.select(F.col("cell").alias("top"), F.col("stream_order").alias("+order")), "top", "left")
        order = found.select("cell", own.alias("stream_order"))
    return order
