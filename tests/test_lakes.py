"""Lake surfaces against a plain walk over the lakes."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rillspark.operators import components, lakes
from rillspark.plans import registry


def test_levels_are_medians_of_lakes_and_reach_the_nearest_shore(spark):
    rng = np.random.default_rng(8)
    shape = (13, 17)
    wet, z = rng.random(shape) < 0.35, rng.integers(0, 50, shape).astype(float)
    known = np.where(rng.random(shape) < 0.2, rng.integers(0, 50, shape).astype(float), np.nan)
    lake, level = {}, {}
    for start in np.ndindex(shape):
        if wet[start] and start not in lake:
            cells, stack = [], [start]
            lake[start] = start
            while stack:
                r, c = stack.pop()
                cells.append((r, c))
                for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                    if 0 <= n[0] < shape[0] and 0 <= n[1] < shape[1] and wet[n] and n not in lake:
                        lake[n] = start
                        stack.append(n)
            has = [known[p] for p in cells if not math.isnan(known[p])]
            level[start] = (float(np.median(has or [z[p] for p in cells])), bool(has))
    assert {s for _, s in level.values()} == {True, False}
    rows = [(r * 17 + c, r, c, bool(wet[r, c]), known[r, c].item(), z[r, c].item()) for r, c in np.ndindex(shape)]
    grid = spark.createDataFrame(rows, "cell long, r long, c long, wet boolean, known double, z double")
    found = lakes.completed_surfaces(grid, F.col("wet"), F.col("known"), F.col("z"))
    got = {(x.r, x.c): (x.patch, x.level, x.supplied) for x in found.collect()}
    assert got == {p: (s[0] * 17 + s[1], *level[s]) for p, s in lake.items()}

    fine = spark.createDataFrame([(r, c) for r in range(0, 26, 3) for c in range(0, 34, 2)], "r long, c long")
    for within in (None, 1.0):
        for x in lakes.refined_surfaces(grid, found, fine, 2, within).collect():
            d, p = min(((r - x.r // 2) ** 2 + (c - x.c // 2) ** 2, (r, c)) for r, c in lake)
            assert x.level == (level[lake[p]][0] if within is None or d <= within**2 else None)


def test_lakes_without_any_level_are_refused_and_no_lakes_are_none(spark):
    grid = spark.createDataFrame([(0, 0, 0, True, None), (1, 0, 1, None, 2.0), (2, 0, 2, True, float("inf"))], "cell long, r long, c long, wet boolean, known double")
    with pytest.raises(ValueError, match="2 lakes"):
        lakes.completed_surfaces(grid, F.col("wet"), F.col("known"))
    none = lakes.completed_surfaces(grid, F.lit(False), F.col("known"))
    assert none.collect() == []
    assert [x.level for x in lakes.refined_surfaces(grid, none, grid.select("r", "c"), 1).collect()] == [None] * 3


def test_surfaces_equal_their_sql_where_the_last_row_of_blocks_is_short(spark, tmp_path):
    """Also where the decimals of a level lie halfway between two roundings and the double times 10,000 doesn't."""
    wet = {(2, 0): 292_826.0, (2, 1): 369_389.0, (2, 3): 400_000.0}  # blocks of three by three; the last row has five of eleven cells
    rows = [(i, "F", wet.get((i // 11 // 3, i % 11 // 3), 100_000.0)) for i in range(9 * 11 + 5)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.sql(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    got = registry.queries()["lake_surfaces"](spark, str(tmp_path)).select("r", "c", "patch", "level").collect()
    expected = con.sql(f"select r, c, patch, level from ({registry.oracle_sql()['lake_surfaces']})").fetchall()
    assert {x.patch for x in got} == {66, 75} and sorted(map(tuple, got)) == sorted(expected)


def test_only_parts_that_meet_across_tiles_take_part_in_rounds_of_stars(spark, monkeypatch):
    monkeypatch.setattr(components, "TILE", 5)
    linked, star = [], components.components
    monkeypatch.setattr(components, "components", lambda links, what: linked.append(links.count()) or star(links, what))
    rng = np.random.default_rng(2)
    mask, kind = rng.random((19, 23)) < 0.5, rng.integers(0, 2, (19, 23))
    for reach, same in ((((0, 1), (1, -1), (1, 0), (1, 1)), None), (((0, 1), (1, 0)), "kind")):
        df = spark.createDataFrame([(r * 23 + c, r - 3, c, [None, "a", "b"][kind[r, c] + 1]) for r, c in np.ndindex(mask.shape) if mask[r, c]], "cell long, r int, c int, kind string")
        patch = {}
        for start in np.ndindex(mask.shape):
            if mask[start] and start not in patch:
                stack, patch[start] = [start], start[0] * 23 + start[1]
                while stack:
                    r, c = stack.pop()
                    for i, j in (*reach, *((-i, -j) for i, j in reach)):
                        n = (r + i, c + j)
                        if 0 <= n[0] < 19 and 0 <= n[1] < 23 and mask[n] and n not in patch and (same is None or kind[n] == kind[r, c]):
                            patch[n] = patch[start]
                            stack.append(n)
        assert {x.cell: x.patch for x in components.patches(df, reach, same).collect()} == {r * 23 + c: p for (r, c), p in patch.items()}
    assert linked[0] < mask.sum()
