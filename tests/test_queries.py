"""Every query with SQL against DuckDB on the smallest tables; units worked by hand."""

import duckdb
import pytest

from rillspark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(found):
    def plain(v):
        return round(v, 8) if isinstance(v, float) else v

    return sorted((tuple(map(plain, r)) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    sql = registry.oracle_sql()[name]
    assert sorted(con.sql(sql).columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert rows(df.select(columns).collect()) == rows(con.sql(f"select {quoted} from ({sql})").fetchall())
