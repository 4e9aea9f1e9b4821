"""Rasters as cell tables, and the grids that are derived from the relational tables.

A cell is a row (cell, r, c, channels...) with cell = r * columns + c, which is
also the order in which ties are broken. A missing value is NULL.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edge of a ramp or random cell in metres.
RESOLUTION_M = 240.0
#: Contiguous zones across a grid.
ZONES = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(spark: SparkSession, sf_dir: str) -> int:
    """Columns of the nearly square grid that holds all orders; its last row may be short."""
    return math.ceil(math.sqrt(table(spark, sf_dir, "orders").count()))


def order_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, r, c, price, z, land, zone, precip) of every order.

    z: a ramp of 20 m a row with the price as relief; price: without the ramp,
    full of pits; zone: contiguous strips; precip: millimetres a year.
    """
    n = columns(spark, sf_dir)
    key = F.col("o_orderkey")
    r, c = F.expr(f"o_orderkey div {n}"), F.pmod(key, F.lit(n))
    return table(spark, sf_dir, "orders").select(
        key.alias("cell"), r.alias("r"), c.alias("c"), F.col("o_totalprice").alias("price"),
        ((r * F.lit(1e6) + F.col("o_totalprice")) / F.lit(5e4)).alias("z"), (F.col("o_orderstatus") != "P").alias("land"),
        F.floor(c / -(-n // ZONES)).cast("int").alias("zone"), (F.lit(700.0) + F.pmod(key * 104729, F.lit(1500))).alias("precip"),
    )


#: The same grid for DuckDB: common tables n and g.
GRID_SQL = """n as (select cast(ceil(sqrt(count(*))) as bigint) as n from orders),
g as materialized (select o_orderkey as cell, o_orderkey // n as r, o_orderkey % n as c, o_totalprice as price,
 ((o_orderkey // n) * 1e6 + o_totalprice) / 5e4 as z, o_orderstatus <> 'P' as land,
 cast((o_orderkey % n) // ((n + 3) // 4) as integer) as zone, 700.0 + (o_orderkey * 104729) % 1500 as precip
 from orders, n)"""
