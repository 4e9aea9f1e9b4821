"""All registered queries of the terrain engine, and their SQL."""

from __future__ import annotations

from rillspark.plans import calibration, catalog, conditioning, corridors, drainage, paths, raster, tables, terrain

_ALL = {**drainage.QUERIES, **raster.QUERIES, **calibration.QUERIES, **catalog.QUERIES, **conditioning.QUERIES, **tables.QUERIES, **paths.QUERIES, **terrain.QUERIES, **corridors.QUERIES}


def queries() -> dict:
    return {name: q for name, (q, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
