"""Connected components of a link table, by alternating stars, and patches of cells, joined within tiles first."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.sources.shared import discard, written


#: Edge of the tiles within which cells are joined first.
TILE = 64


def _least(links: DataFrame) -> DataFrame:
    """(u, least): the smallest neighbour of each node. Sums up before it shuffles, so a hub is no burden."""
    return links.groupBy("u").agg(F.min("v").alias("least"))


def components(links: DataFrame, what: str) -> DataFrame:
    """(node, root) of every linked node; root is the smallest node of its component.

    links: (a, b) of longs in any order; self-links, nulls and repeats play no
    part. Each round hangs neighbours on the smallest node around (large star,
    then small star) and ends in a written table; rounds grow with the
    logarithm of the longest path.
    """
    edges = written(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        what,
    )
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("least", "u").alias("v"))
        large = large.where("u <> v").distinct()
        small = large.join(_least(large), "u")
        last, edges = edges, written(
            small.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(small.select("u", F.col("least").alias("v")))
            .where("u <> v").distinct(),
            what,
        )
        discard(last)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _joining(reach: tuple, same: str | None):
    """A function that gives each cell of a tile the smallest cell that neighbours within the tile reach, as root."""

    def join(key: tuple, group: pa.Table) -> pa.Table:
        r, c, cell = (group.column(x).to_numpy() for x in ("r", "c", "cell"))
        alike = None if same is None else group.column(same).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        wide = c.max() - c.min() + 1 + max(abs(j) for _, j in reach)
        place = (r - r.min()) * wide + c - c.min()
        order = np.argsort(place)
        ranked, up = place[order], list(range(len(cell)))
        for i, j in reach:
            at = np.minimum(np.searchsorted(ranked, place + i * wide + j), len(cell) - 1)
            a = np.flatnonzero(ranked[at] == place + i * wide + j)
            b = order[at[a]]
            if same is not None:
                met = (alike[a] == alike[b]) & (alike[a] >= 0)
                a, b = a[met], b[met]
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                while up[x] != x:
                    up[x] = x = up[up[x]]
                while up[y] != y:
                    up[y] = y = up[up[y]]
                up[y] = x
        for k in range(len(up)):
            x = k
            while up[x] != x:
                up[x] = x = up[up[x]]
            up[k] = x
        least = np.full(len(cell), np.iinfo(np.int64).max)
        np.minimum.at(least, up, cell)
        return group.append_column("root", pa.array(least[up]))

    return join


def patches(grid: DataFrame, reach: tuple = ((0, 1), (1, -1), (1, 0), (1, 1)), same: str | None = None) -> DataFrame:
    """(cell, patch) of a table of masked cells (cell, r, c): patch is the smallest cell that neighbours reach.

    reach: half of the neighbourhood, as steps in rows and columns; the default
    is all eight neighbours, ((0, 1), (1, 0)) the four nearest. same: a column
    that neighbours of one patch share. Tiles join their own cells, so the
    rounds of stars take only parts that meet across tiles.
    """
    by = ["r", "c", *([same] if same else [])]
    own = grid.select(F.col("cell").cast("long").alias("cell"), F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), *by[2:])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields) + ", root long"
    tiles = [F.floor(F.col(x) / TILE) for x in ("r", "c")]
    parts = written(own.groupBy(*tiles).applyInArrow(_joining(reach, same), schema), "parts")
    far = max(max(abs(i), abs(j)) for i, j in reach)
    inside = [F.pmod(x, F.lit(TILE)).between(far, TILE - 1 - far) for x in ("r", "c")]
    border = parts.where(~(inside[0] & inside[1]))
    steps = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in reach)))
    sent = border.select(F.col("root").alias("a"), *by, steps.alias("s")).select("a", *by[2:], (F.col("r") + F.col("s.i")).alias("r"), (F.col("c") + F.col("s.j")).alias("c"))
    links = sent.join(border.select(F.col("root").alias("b"), *by), by).select("a", "b")
    found = components(links, "patches").select(F.col("node").alias("root"), F.col("root").alias("patch"))
    return parts.select("cell", "root").join(found, "root", "left").select("cell", F.coalesce("patch", "root").alias("patch"))
