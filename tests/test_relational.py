"""Greedy fits, running sums, probing and refinement against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from rillspark.operators import focal, relational


def items(spark, n, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(1, 40), rng.randrange(2**32)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, n long, key long")


@pytest.mark.parametrize("budget", [0, 60, 500, 10_000])
def test_greedy_fit_skips_what_does_not_fit(spark, budget):
    rows, df = items(spark, 80, budget)
    left, want = budget, set()
    for i, n, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        if n <= left:
            left -= n
            want.add(i)
    assert {r.id for r in relational.greedy_fit(df, "n", "key", budget).collect()} == want


def test_running_sums_small_first(spark):
    rows, df = items(spark, 200, 5)
    total, want = 0, {}
    for i, n, key in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        total += n
        want[i] = total
    assert {r.id: r.used for r in relational.running_small_first(df, "n", "key").collect()} == want
    assert relational.running_small_first(df.limit(0), "n", "key").isEmpty()


def test_probing_equals_insertion_one_by_one(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([3, 4, 96, 98, 99])) for i in range(60)]
    taken, want = set(), {}
    for i, slot in rows:
        while slot in taken:
            slot = (slot + 1) % 100
        taken.add(slot)
        want[i] = slot
    got = relational.probe_slots(spark.createDataFrame(rows, "part long, h long"), "part", "h", 100).collect()
    assert {r.id: r.slot for r in got} == want


def test_bilinear_by_any_factor(spark):
    v = {(r, c): float((r * 7 + c * 5) % 11) for r in range(4) for c in range(3)}
    df = spark.createDataFrame([(r, c, x) for (r, c), x in v.items()], "r long, c long, v double")
    for k in (2, 3, 8):
        got = {(x.r, x.c): x.v for x in focal.bilinear(df, "v", k).collect()}
        assert len(got) == 12 * k * k
        for (i, j), x in got.items():
            s, t = max(0.0, min(3.0, (i + 0.5) / k - 0.5)), max(0.0, min(2.0, (j + 0.5) / k - 0.5))
            a, b = min(int(s), 2), min(int(t), 1)
            p, q = s - a, t - b
            want = (1 - p) * ((1 - q) * v[a, b] + q * v[a, b + 1]) + p * ((1 - q) * v[a + 1, b] + q * v[a + 1, b + 1])
            assert abs(x - want) < 1e-9
    assert {x.v for x in focal.bilinear(df.where((F.col("r") == 0) & (F.col("c") == 0)), "v", 3).collect()} == {0.0}


def test_a_terrain_stack_shuffles_parents_alone(spark):
    from rillspark.plans import registry

    plan = registry.queries()["terrain_stack"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in plan and "Exchange" not in plan[: plan.index("Generate explode")]
