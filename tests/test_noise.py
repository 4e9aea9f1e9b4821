"""Noise against the plain generator, polygons against a count of crossings for every cell."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from rillspark.operators import noise, polygons


def plain(seed, n):
    state, out = seed, []

    def draw():
        nonlocal state
        state = (state * noise.MULTIPLIER + noise.INCREMENT) % 2**64
        x, turn = ((state >> 18 ^ state) >> 27) & 0xFFFFFFFF, state >> 59
        return (x >> turn | x << (32 - turn & 31)) & 0xFFFFFFFF

    while len(out) < n:
        v1, v2 = (2.0 * (draw() + 1.0) / 4294967296.0 - 1.0 for _ in range(2))
        s = v1 * v1 + v2 * v2
        if 0 < s < 1:
            f = math.sqrt(-2.0 * math.log(s) / s)
            out += [v1 * f, v2 * f]
    return out[:n]


def test_streams_equal_the_plain_generator(spark, monkeypatch):
    monkeypatch.setattr(noise, "BLOCK", 64)
    seeds = {0: 0, 1: 12345, 2: 2**64 - 1, 3: 0x9E3779B97F4A7C15}
    df = spark.createDataFrame([(t, str(s)) for t, s in seeds.items()], "tile long, seed string")
    got = {}
    for r in noise.noise(df, 900).collect():
        got.setdefault(r.tile, {})[r.place] = r.value
    for t, s in seeds.items():
        values = [got[t][i] for i in range(900)]
        assert len(got[t]) == 900 and np.allclose(values, plain(s, 900), rtol=0, atol=1e-12)


def test_a_tile_of_few_values_draws_what_it_needs_and_shuffles_no_values(spark):
    df = spark.createDataFrame([(5, "77"), (6, "78")], "tile long, seed string")
    few = noise.noise(df, 256)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan
    got = {(r.tile, r.place): r.value for r in few.collect()}
    assert len(got) == 512 and all(np.allclose([got[t, i] for i in range(256)], plain(s, 256), rtol=0, atol=1e-12) for t, s in ((5, 77), (6, 78)))


def test_jumps_equal_single_steps():
    state = 987654321
    for n in (0, 1, 2, 7, 1000):
        s = state
        for _ in range(n):
            s = (s * noise.MULTIPLIER + noise.INCREMENT) % 2**64
        a, c = noise.jump(n)
        assert (state * a + c) % 2**64 == s


def test_cells_inside_equal_a_count_of_crossings(spark):
    rng = random.Random(4)
    rings = [(p, k, float(rng.randrange(-3, 24)), float(rng.randrange(-3, 20))) for p in range(6) for k in range(3 + p)]
    df = spark.createDataFrame(rings, "poly long, seq long, x double, y double")
    want = set()
    for p in range(6):
        ring = [(x, y) for q, _, x, y in rings if q == p]
        for r in range(18):
            for c in range(22):
                hits = 0
                for (x, y), (x1, y1) in zip(ring, [*ring[1:], ring[0]], strict=True):
                    if (y <= r + 0.5) != (y1 <= r + 0.5) and x + (r + 0.5 - y) * (x1 - x) / (y1 - y) <= c + 0.5:
                        hits += 1
                if hits % 2:
                    want.add((p, r, c))
    assert {tuple(x) for x in polygons.cells(df, 18, 22).collect()} == want
    square = spark.createDataFrame([(9, k, *xy) for k, xy in enumerate([(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)])], "poly long, seq long, x double, y double")
    assert polygons.areas(square).first().area == 12.0 and polygons.cells(square, 9, 9).count() == 12
    assert polygons.cells(square.where(F.lit(False)), 9, 9).isEmpty()
