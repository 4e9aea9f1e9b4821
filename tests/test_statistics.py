"""Exact quantiles by rank against numpy."""

import duckdb
import numpy as np
import pytest

from rillspark.operators import statistics as st

OF = {"p00": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}


def test_quantiles_equal_those_of_whole_groups(spark):
    rng = np.random.default_rng(4)
    rows = [("hot", float(v)) for v in rng.integers(0, 7, 3000)] + [("wide", float(v)) for v in rng.normal(size=1500)] + [(None, 2.0), (None, 3.0), ("one", 5.0), ("one", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {q.g: q for q in st.quantiles(df, ["g"], "x", OF, 9).collect()}
    assert set(got) == {"hot", "wide", None, "one", "none"}
    for g, q in got.items():
        values = [x for k, x in rows if k == g and x is not None]
        for name, p in OF.items():
            assert q[name] == (pytest.approx(np.quantile(values, p), abs=1e-8) if values else None)
    whole = st.summary(df, [], "x").first()
    values = [x for _, x in rows if x is not None]
    assert whole.n == len(values) and whole.p50 == pytest.approx(np.quantile(values, 0.5), abs=1e-6) and whole.most == max(values)


def test_an_empty_table_has_one_row_of_nulls_or_no_groups(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert st.quantiles(df, ["g"], "x", OF).collect() == []
    assert [tuple(r) for r in st.quantiles(df, [], "x", OF).collect()] == [(None,) * len(OF)]
    with pytest.raises(ValueError, match="between"):
        st.quantiles(df, [], "x", {"p": 1.5})


@pytest.mark.parametrize("n", [2, 8, 1502, 90_000])
def test_quantiles_of_decimals_are_cut_to_their_places(spark, n):
    df = spark.range(n).selectExpr("700.0D + (id * 104729) % 1500 as x")
    sql = f"select quantile_cont(x, 0.1), quantile_cont(x, 0.5), quantile_cont(x, 0.9) from (select 700.0 + (i * 104729) % 1500 as x from range({n}) r(i))"
    got = st.quantiles(df, [], "x", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, 12, places=1).first()
    assert tuple(got) == tuple(map(float, duckdb.connect().sql(sql).fetchall()[0]))
