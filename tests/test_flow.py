"""Flow forests on networks worked by hand and on seeded random ones."""

import random
import time

import pytest
from pyspark.sql import functions as F

from rillspark.operators import flow, relational

#: Two sources meet in 3, two more in 6, both join in 7, which ends in 8; 9 stands alone.
TREE = [(1, 3), (2, 3), (3, 7), (4, 6), (5, 6), (6, 7), (7, 8), (8, None), (9, None)]


def frame(spark, tree):
    return spark.createDataFrame(tree, "cell long, receiver long")


def test_accumulation_sums_all_upstream(spark):
    got = {r.cell: r.n for r in flow.accumulate(frame(spark, TREE), n=F.lit(1.0)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 1, 6: 3, 7: 7, 8: 8, 9: 1}


def test_outlets_and_steps(spark):
    got = {r.cell: (r.outlet, r.steps) for r in flow.outlets(frame(spark, TREE)).collect()}
    assert got[1] == (8, 3) and got[7] == (8, 1) and got[8] == (8, 0) and got[9] == (9, 0)


def test_strahler_rises_where_equal_orders_meet(spark):
    got = {r.cell: r.stream_order for r in flow.strahler(frame(spark, TREE)).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 1, 5: 1, 6: 2, 7: 3, 8: 3, 9: 1}


def test_random_forest_against_walks(spark):
    rng = random.Random(3)
    tree = [(i, rng.randrange(i) if i and rng.random() > 0.05 else None) for i in range(300)]
    up = dict(tree)
    total = dict.fromkeys(up, 0)
    for i in up:
        j = i
        while j is not None:
            total[j] += 1
            j = up[j]
    assert {r.cell: r.n for r in flow.accumulate(frame(spark, tree), n=F.lit(1.0)).collect()} == total
    children = {}
    for i, j in tree:
        children.setdefault(j, []).append(i)
    order = {}
    for i in sorted(up, reverse=True):
        below = sorted((order[c] for c in children.get(i, [])), reverse=True)
        order[i] = 1 if not below else below[0] + (len(below) > 1 and below[0] == below[1])
    assert {r.cell: r.stream_order for r in flow.strahler(frame(spark, tree)).collect()} == order


def test_a_cycle_raises(spark):
    ring = frame(spark, [(1, 2), (2, 3), (3, 1), (4, 1), (5, None)])
    for walk in (lambda: flow.outlets(ring), lambda: flow.accumulate(ring, n=F.lit(1.0)), lambda: flow.downstream(ring, n=F.lit(1.0)), lambda: flow.strahler(ring)):
        with pytest.raises(ValueError, match="cycle"):
            walk()


def test_empty_forest(spark):
    empty = frame(spark, [])
    assert flow.accumulate(empty, n=F.lit(1.0)).isEmpty() and flow.outlets(empty).isEmpty() and flow.strahler(empty).isEmpty()


def test_bowl_and_plane(spark):
    bowl = [(r * 3 + c, r, c, 0.0 if (r, c) == (1, 1) else 5.0) for r in range(3) for c in range(3)]
    got = {x.cell: (x.code, x.receiver) for x in flow.receivers(spark.createDataFrame(bowl, "cell long, r long, c long, z double")).collect()}
    assert set(got.values()) == {(0, None)}  # the pit and the edge
    plane = [(r * 5 + c, r, c, float(r)) for r in range(5) for c in range(5)]
    got = {x.cell: (x.code, x.receiver) for x in flow.receivers(spark.createDataFrame(plane, "cell long, r long, c long, z double")).collect()}
    assert got[12] == (6, 6) and got[0] == (0, None)  # of three equally low neighbours the first cell


def test_overlaps_meet_once(spark):
    spans = [(1, 1, 0, 300), (1, 2, 10, 20), (1, 3, 290, 400), (1, 4, 401, 410), (2, 5, 0, 5)]
    got = relational.overlaps(spark.createDataFrame(spans, "g long, k long, lo long, hi long"), "g", ["k"], 16).collect()
    assert sorted((r.a_k, r.b_k) for r in got) == [(1, 2), (1, 3)]


def test_downstream_maximum_and_upstream_minimum(spark):
    high = frame(spark, TREE).withColumn("v", (F.col("cell") * 7) % 10)
    got = {r.cell: r.v for r in flow.downstream(high, v=F.col("v")).collect()}
    assert got == {1: 9, 2: 9, 3: 9, 4: 9, 5: 9, 6: 9, 7: 9, 8: 6, 9: 3}
    got = {r.cell: r.v for r in flow.accumulate(high, F.min, v=F.col("v")).collect()}
    assert got == {1: 7, 2: 4, 3: 1, 4: 8, 5: 5, 6: 2, 7: 1, 8: 1, 9: 3}


def test_long_chain_with_tributaries(spark):
    """One river of 20,000 cells with a source beside every tenth: two orders, in rounds that follow the logarithm of its length."""
    n = 20_000
    river = spark.range(n).select(F.col("id").alias("cell"), F.when(F.col("id") < n - 1, F.col("id") + 1).alias("receiver"))
    forest = river.unionByName(river.where("cell % 10 = 5").select((F.col("cell") + n).alias("cell"), F.col("cell").alias("receiver")))
    start = time.time()
    got = {r.stream_order: (r.n, r.least) for r in flow.strahler(forest).groupBy("stream_order").agg(F.count("*").alias("n"), F.min("cell").alias("least")).collect()}
    assert got == {1: (5 + 2_000, 0), 2: (n - 5, 5)} and time.time() - start < 60
