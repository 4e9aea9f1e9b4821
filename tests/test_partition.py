"""Flow units against the sequential cut; repaired beds against the sequential walk."""

import random

import pytest
from pyspark.sql import functions as F

from rillspark.operators import flow, partition


def sequential(tree, weight, target):
    """Cells from sources on; a cell that gathers the target, or has no receiver, is cut."""
    up, rest, cuts = dict(tree), dict(weight), set()
    waiting = {c: 0 for c in up}
    for r in up.values():
        if r is not None:
            waiting[r] += 1
    ready = [c for c, n in waiting.items() if not n]
    while ready:
        c = ready.pop()
        if rest[c] >= target or up[c] is None:
            cuts.add(c)
        else:
            rest[up[c]] += rest[c]
        if up[c] is not None:
            waiting[up[c]] -= 1
            if not waiting[up[c]]:
                ready.append(up[c])
    return cuts


def trees():
    rng = random.Random(5)
    yield [(i, rng.randrange(max(0, i - 4), i) if i and rng.random() > 0.02 else None) for i in range(400)], 7
    yield [(i, rng.randrange(i) if i else None) for i in range(300)], 25
    chain = [(i, i + 1 if i < 299 else None) for i in range(300)]
    yield chain + [(300 + i, 3 * i) for i in range(100)], 11


@pytest.mark.parametrize("k", range(3))
def test_units_equal_the_sequential_cut(spark, monkeypatch, k):
    monkeypatch.setattr(partition, "SEGMENT", 16)
    tree, target = list(trees())[k]
    rng = random.Random(k)
    weight = {c: rng.choice((1, 1, 1, 2, 30)) for c, _ in tree}
    df = spark.createDataFrame([(c, r, weight[c]) for c, r in tree], "cell long, receiver long, weight long")
    cuts, up = sequential(tree, weight, target), dict(tree)
    want = {}
    for c in up:
        u = c
        while u not in cuts:
            u = up[u]
        want[c] = u
    assert {r.cell: r.unit for r in partition.flow_units(df, target).collect()} == want


def test_units_refuse_weights_below_one_and_take_empty_tables(spark):
    df = spark.createDataFrame([(1, None, 0)], "cell long, receiver long, weight long")
    with pytest.raises(ValueError, match="weights"):
        partition.flow_units(df, 5)
    assert partition.flow_units(df.limit(0), 5).isEmpty()


def test_beds_equal_the_sequential_walk(spark):
    rng = random.Random(2)
    tree = [(i, rng.randrange(max(0, i - 5), i) if i and rng.random() > 0.03 else None) for i in range(300)]
    z, drop, floor = ({c: rng.randrange(n) for c, _ in tree} for n in (900, 9, 700))
    bed, deepest = dict(z), 150
    for c, r in sorted(tree, reverse=True):
        if r is not None:
            low = max(z[r] - deepest, min(floor[r], z[r]))
            bed[r] = min(bed[r], max(low, bed[c] - drop[c]))
    df = spark.createDataFrame([(c, r, z[c], drop[c], floor[c]) for c, r in tree], "cell long, receiver long, z long, drop long, floor long")
    assert {r.cell: r.bed for r in flow.carved(df, deepest).collect()} == bed
    assert {r.cell for r in flow.carved(df, deepest).join(df, "cell").where(F.col("bed") < F.least("floor", "z")).collect()} == set()
