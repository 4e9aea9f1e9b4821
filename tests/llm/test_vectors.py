"""The multi-index against brute force, with copies, ties and unusable vectors."""

import numpy as np
from pyspark.sql import functions as F

from rillspark.llm import multi_index


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        score = (x * x[ids.index(q)]).sum(1)
        order = sorted((-s, i) for s, i in zip(score.tolist(), ids, strict=True) if i != q)[:k]
        out[q] = [(i, -s) for s, i in order]
    return out


def found(df, k, **more):
    out = {}
    for r in multi_index.search(df, F.col("vec_id") % 20 == 0, k=k, **more).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_walks_through_all_cells_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "ASKED", 4)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 9)).round(3)
    x[50:90] = x[0]  # copies, ties among them go to the smaller id
    rows = [(i, v.tolist(), 0, 1.0) for i, v in enumerate(x)]
    rows += [(1_000, None, 0, 1.0), (1_020, [0.0] * 9, 0, 1.0), (1_040, [float("nan")] * 9, 0, 1.0), (1_060, [None, *[1.0] * 8], 0, 1.0), (1_080, [], 0, 1.0), (1_100, [1.0, 2.0], 0, 1.0), (None, [1.0] * 9, 0, 1.0), rows[20]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score double")
    got, want = found(df, 20, probe_share=1.0), brute(list(range(300)), x, range(0, 300, 20), 20)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-12)


def test_crowded_cells_and_recall(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK", 64)
    monkeypatch.setattr(multi_index, "ASKED", 40)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3_000, 16))
    x[:1_000] = 3 + rng.normal(size=(1_000, 16)) * 0.01
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got, want = found(df, 10), brute(list(range(3_000)), x, range(0, 3_000, 20), 10)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert all(len(got[q]) == 10 for q in want) and hits >= 0.9 * 10 * len(want)


def test_recall_on_the_given_table_while_cells_are_left_out(spark):
    from rillspark.llm.common import table
    from rillspark.llm.queries import op1_multi_index

    rows = table(spark, "/root/testdata/sf0.1", "embeddings").orderBy("vec_id").toPandas()
    ids, x = rows["vec_id"].to_list(), np.array(rows["embedding"].to_list(), np.float64)
    want = brute(ids, x, [i for i in ids if i % 20 == 0], 20)
    got = {}
    for r in op1_multi_index(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = np.mean([len(got[q] & {i for i, _ in want[q]}) / 20 for q in want])
    share, expected = multi_index.least_share(multi_index.Codebooks(x), x, 20)
    print(f"recall {recall:.3f}, share {share}, expected {expected:.3f}")
    assert recall >= 0.9 and share < 0.7


def test_measured_share_is_the_least_that_reaches_the_recall():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(30, 8))[rng.integers(0, 30, 900)] * 4 + rng.normal(size=(900, 8)) * 0.1  # clusters need few cells
    books = multi_index.Codebooks(x)
    share, recall = multi_index.least_share(books, x, 10)
    cell, least = books.cells(x), {}
    for s in (share, multi_index.SHARES[max(multi_index.SHARES.index(share) - 1, 0)]):
        hits = []
        for q in range(multi_index.PROBES):
            score = x @ x[q]
            score[q] = -np.inf
            near, count, seen = set(np.argsort(-score)[:10].tolist()), 0, set()
            for c in books.walk(x[q]):
                if count >= max(1, int(s * 900)):
                    break
                here = np.flatnonzero(cell == c)
                count += len(here)
                seen |= set(here.tolist())
            hits.append(len(near & seen) / 10)
        least[s] = np.mean(hits)
    assert share <= 0.2 and abs(least[share] - recall) < 1e-9 and recall >= multi_index.RECALL
    assert all(r < multi_index.RECALL for s, r in least.items() if s < share)


def test_few_candidates_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert found(df, 20) == {0: [(1, 4.0)]}
    few = spark.createDataFrame([(i, [float(i % 7 + 1), float(i % 5)]) for i in range(25)], "vec_id long, embedding array<double>")
    assert {q: len(r) for q, r in found(few, 20).items()} == {0: 20, 20: 20}  # however few cells a share asks for
    assert multi_index.search(df.limit(0), F.lit(True)).isEmpty()


def test_walk_falls_and_covers_all_cells():
    rng = np.random.default_rng(6)
    books = multi_index.Codebooks(rng.normal(size=(200, 6)), centroids=5)
    q = rng.normal(size=6)
    a, b = books.first @ q[:3], books.second @ q[3:]
    sums = [a[c // 5] + b[c % 5] for c in books.walk(q)]
    assert len(sums) == 25 and sorted(sums, reverse=True) == sums
