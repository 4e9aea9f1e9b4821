"""Breaches against plain floods and walks on random terrain, in tiles of several sizes."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillspark.operators import breach

AREA, TOLERANCE, LEAST_AREA, LEAST_DEPTH, DROP, DEEPEST = 1.0, 0.7, 2.0, 2.0, 0.05, 9.0


def flood(z, land, terminal):
    """Levels and receivers in order of (level, steps, cell)."""
    cols = z.shape[1]
    best = {r * cols + c: (z[r, c], 0) for r, c in np.ndindex(z.shape) if terminal[r, c]}
    heap, receiver = [(*v, k) for k, v in best.items()], {}
    heapq.heapify(heap)
    done = set(best)
    while heap:
        w, s, k = heapq.heappop(heap)
        r, c = divmod(k, cols)
        for i, j in np.ndindex(3, 3):
            a, b = r + i - 1, c + j - 1
            n = a * cols + b
            if 0 <= a < z.shape[0] and 0 <= b < cols and land[a, b] and n not in done:
                done.add(n)
                best[n], receiver[n] = ((z[a, b], 0) if z[a, b] > w else (w, s + 1)), k
                heapq.heappush(heap, (*best[n], n))
    return {k: v[0] for k, v in best.items()}, receiver


def plain(z, land, terminal, keep, passes):
    cols, first, z = z.shape[1], z.copy(), z.copy()
    at = lambda k: divmod(k, cols)
    figures = []
    for _ in range(passes):
        level, receiver = flood(z, land, terminal)
        up = {k: w - z[at(k)] for k, w in level.items()}
        deep = {k for k in up if land[at(k)] and not keep[at(k)] and up[k] > TOLERANCE}
        part, parts = {}, []
        for k in sorted(deep):
            if k not in part:
                stack, cells = [k], []
                part[k] = len(parts)
                while stack:
                    m = stack.pop()
                    cells.append(m)
                    r, c = at(m)
                    for i, j in np.ndindex(3, 3):
                        n = (r + i - 1) * cols + c + j - 1
                        if 0 <= c + j - 1 < cols and n in deep and n not in part:
                            part[n] = len(parts)
                            stack.append(n)
                parts.append(cells)
        picked = [p for p, cells in enumerate(parts) if len(cells) * AREA >= LEAST_AREA or max(up[k] for k in cells) >= LEAST_DEPTH]
        if not picked:
            break
        new, skipped, used = z.copy(), 0, 0
        for p in picked:
            pit = max(parts[p], key=lambda k: (up[k], -k))
            way, out, k = [pit], False, pit
            while k in receiver:
                k = receiver[k]
                way.append(k)
                if keep[at(k)]:
                    way.pop()
                    break
                out = out or part.get(k) != p
                if out and (not land[at(k)] or z[at(k)] < z[at(pit)]):
                    break
            if len(way) < 2:
                continue
            top, n = z[at(pit)], len(way) - 1
            end = min(z[at(way[-1])], top - DROP * n)
            bed = [min(z[at(k)], top + (end - top) * i / n) for i, k in enumerate(way)]
            if max(first[at(k)] - b for k, b in zip(way, bed, strict=True)) > DEEPEST:
                skipped += 1
                continue
            used += any(z[at(k)] - b > 1e-4 for k, b in zip(way, bed, strict=True))
            for k, b in zip(way, bed, strict=True):
                new[at(k)] = min(new[at(k)], b)
        figures.append((len(picked), used, skipped, int((z - new > 1e-4).sum())))
        cut = (z - new > 1e-4).any()
        z = new
        if not cut:
            break
    level, _ = flood(z, land, terminal)
    return {k: (round(float(z[at(k)]), 6), round(float(w), 6)) for k, w in level.items()}, figures


@pytest.mark.parametrize(("seed", "tile"), [(1, 6), (2, 64)])
def test_breaches_equal_plain_walks(spark, seed, tile):
    rng = np.random.default_rng(seed)
    shape = (22, 26)
    z = (rng.random(shape) * 8 + np.add.outer(np.arange(22), np.zeros(26)) * 0.3).round(3)
    z[8:13, 8:14] -= 9  # a deep pit
    land, keep, terminal = rng.random(shape) > 0.04, rng.random(shape) > 0.97, np.zeros(shape, bool)
    terminal[0, :] = terminal[-1, :] = terminal[:, 0] = terminal[:, -1] = True
    want, figures = plain(z, land, terminal, keep, 2)
    rows = [(r * 26 + c, r, c, z[r, c].item(), bool(land[r, c]), bool(keep[r, c]), bool(terminal[r, c])) for r, c in np.ndindex(shape)]
    df = spark.createDataFrame(rows, "cell long, r long, c long, h double, land boolean, kept boolean, leaves boolean")
    routed, passes = breach.breach(df, "h", F.col("land"), F.col("leaves"), AREA, 1.0, TOLERANCE, LEAST_AREA, LEAST_DEPTH, DROP, F.col("kept"), DEEPEST, passes=2, tile=tile)
    assert {x.cell: (round(x.z, 6), round(x.w, 6)) for x in routed.collect()} == want
    got = sorted(passes.collect())
    assert [(x.n_candidates, x.n_paths, x.n_skipped, x.n_cells) for x in got] == figures and figures[0][1] > 1
    with pytest.raises(ValueError, match="tolerance"):
        breach.breach(df, "h", F.col("land"), F.col("leaves"), AREA, 1.0, tolerance=0)
