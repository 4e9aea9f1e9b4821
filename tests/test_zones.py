"""Terminals for every part of a zone, against a plain walk in order of parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillspark.operators import zones


def label(land, zone):
    part, out = {}, []
    for start in np.ndindex(land.shape):
        if land[start] and start not in part:
            cells, stack = [], [start]
            part[start] = len(out)
            while stack:
                r, c = stack.pop()
                cells.append((r, c))
                for i, j in np.ndindex(3, 3):
                    n = (r + i - 1, c + j - 1)
                    if 0 <= n[0] < land.shape[0] and 0 <= n[1] < land.shape[1] and land[n] and zone[n] == zone[start] and n not in part:
                        part[n] = len(out)
                        stack.append(n)
            out.append(sorted(cells))
    return out


def plain(z, land, zone, terminal):
    zone, terminal = zone.copy(), terminal.copy()
    rows, cols = z.shape
    around = lambda r, c: [(r + i - 1, c + j - 1) for i, j in np.ndindex(3, 3) if 0 <= r + i - 1 < rows and 0 <= c + j - 1 < cols and (i, j) != (1, 1)]
    coast = {k for k in np.ndindex(z.shape) if land[k] and (k[0] in (0, rows - 1) or k[1] in (0, cols - 1) or any(not land[n] for n in around(*k)))}
    moved = 0
    for _ in range(8):
        parts = label(land, zone)
        missing = [p for p in parts if not any(terminal[k] for k in p)]
        if not missing:
            return zone, terminal, moved, len(parts)
        inner = []
        for p in missing:
            shore = [k for k in p if k in coast]
            if shore:
                terminal[min(shore, key=lambda k: (z[k], k))] = True
            else:
                inner.append(p)
        for p in inner:
            near = {n for k in p for n in around(*k) if land[n]} - set(p)
            votes = [zone[n] for n in near if zone[n] != zone[p[0]]]
            if votes:
                to = min(set(votes), key=lambda v: (-votes.count(v), v))
                moved += 1
                for k in p:
                    zone[k] = to
    raise RuntimeError


@pytest.mark.parametrize("seed", [1, 3])
def test_every_part_drains_as_in_a_plain_walk(spark, seed):
    rng = np.random.default_rng(seed)
    z, land = rng.integers(0, 30, (16, 19)).astype(float), rng.random((16, 19)) > 0.03
    zone, terminal = rng.integers(1, 4, (16, 19)), np.zeros((16, 19), bool)
    zone[5:11, 5:14] = rng.integers(1, 6, (6, 9))
    terminal[0, 3] = land[0, 3] = True
    rows = [(r * 19 + c, r, c, z[r, c].item(), bool(land[r, c]), int(zone[r, c]), bool(terminal[r, c])) for r, c in np.ndindex(z.shape)]
    df = spark.createDataFrame(rows, "cell long, r long, c long, h double, l boolean, q long, t boolean")
    got, figures = zones.with_terminals(df, "h", F.col("l"), F.col("q"), F.col("t"))
    want_zone, want_terminal, moved, n = plain(z, land, zone, terminal)
    assert {x.cell: (x.zone, x.terminal) for x in got.collect()} == {r * 19 + c: (want_zone[r, c], want_terminal[r, c]) for r, c in np.ndindex(z.shape) if land[r, c]}
    assert figures["reassigned_parts"] == moved > 0 and figures["parts"] == n
