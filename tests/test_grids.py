"""Distances, patches, resumable tiles, streams and identifiers on small grids."""

import hashlib
import json
import uuid

import numpy as np
from pyspark.sql import functions as F

from rillspark.functions import identity
from rillspark.operators import components, distance
from rillspark.sources.shared import shared_dir
from rillspark.streaming import tiles


def grid(spark, values):
    rows = [(r * values.shape[1] + c, r, c, v.item()) for (r, c), v in np.ndenumerate(values)]
    return spark.createDataFrame(rows, f"cell long, r long, c long, v {'boolean' if values.dtype == bool else 'double'}")


def test_distance_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    for share in (0.02, 0.3):
        m = rng.random((23, 31)) < share
        at = np.argwhere(m)
        want = {r * 31 + c: np.sqrt(((at - (r, c)) ** 2).sum(1).min()) for r, c in np.ndindex(m.shape)}
        got = {x.cell: x.distance for x in distance.distances(grid(spark, m), "v").collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert distance.distances(grid(spark, np.zeros((3, 3), bool)), "v").where("distance is not null").isEmpty()


def test_patches_by_neighbourhood(spark):
    m = np.array([[1, 0, 0, 1], [0, 1, 0, 0], [0, 0, 0, 1], [0, 0, 1, 1]], bool)
    g = grid(spark, m).where("v").select("cell", "r", "c")
    assert {x.cell: x.patch for x in components.patches(g).collect()} == {0: 0, 5: 0, 3: 3, 11: 11, 14: 11, 15: 11}
    assert {x.cell: x.patch for x in components.patches(g, ((0, 1), (1, 0))).collect()} == {0: 0, 5: 5, 3: 3, 11: 11, 14: 11, 15: 11}
    assert components.patches(g.limit(0)).isEmpty()


def test_tiles_resume_and_stay(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 0, 3.0), (0, 1, 5.0)], "ty long, tx long, z double")
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    tiles.append_tiles(cells, path, most=1)
    assert spark.read.parquet(path).count() == 1
    tiles.append_tiles(cells.withColumn("z", F.col("z") * 0), path)
    assert sorted((r.ty, r.tx, r.n, r["mean"]) for r in spark.read.parquet(path).collect()) == [(0, 0, 2, 2.0), (0, 1, 1, 0.0)]


def test_stream_of_tiles(spark):
    root = f"{shared_dir(spark)}/s-{uuid.uuid4().hex}"
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 0, 3.0), (2, 1, 5.0)], "ty long, tx long, z double")
    cells.write.parquet(f"{root}/in")
    for _ in range(2):  # started again, it finds nothing new
        q = tiles.stream_tiles(spark.readStream.schema(cells.schema).parquet(f"{root}/in"), f"{root}/out", f"{root}/state")
        q.awaitTermination(60)
    assert sorted((r.ty, r.tx, r.n) for r in spark.read.parquet(f"{root}/out").collect()) == [(0, 0, 2), (2, 1, 1)]


def test_stable_id(spark):
    df = spark.createDataFrame([(-3, "é"), (7, None)], "a long, b string")
    got = [r.id for r in df.select(identity.stable_id(F.lit("k"), F.col("a"), F.col("b")).alias("id")).collect()]
    assert got == [hashlib.blake2b(json.dumps(["k", a, b], separators=(",", ":")).encode(), digest_size=16).hexdigest() for a, b in ((-3, "é"), (7, None))]
