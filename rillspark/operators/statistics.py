"""Exact distributions, regressions and decompositions over groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillspark.sources.shared import written

#: Quantiles of a distribution and their names (fixed values).
QUANTILES = {"p01": 0.01, "p05": 0.05, "p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99}


def quantiles(df: DataFrame, by: list[str], x: str, of: dict[str, float], digits: int | None = 6, places: int | None = None) -> DataFrame:
    """(by..., names of `of`...): exact quantiles of x in each group, linear between neighbouring ranks, rounded unless digits is None.

    Values are counted first, then lie in ranges over (group, value): counts of
    a group's ranges say which of them hold the ranks asked for, and those alone
    are numbered. So no task holds a group, and equal values are one row. Nulls
    don't count; a group without a value has nulls; NaN is the largest value.
    Groups by null are groups as others are; without `by` there is one group.
    places: x are decimals of so many places, and so are quantiles: what lies
    between two ranks is cut to them from the lower, as SQL does with decimals.
    """
    if not of or any(not 0 <= q <= 1 for q in of.values()):
        raise ValueError("quantiles lie between 0 and 1")
    group = F.struct(*map(F.col, by)) if by else F.struct(F.lit(0).alias("one"))
    counts = df.select(group.alias("k"), F.col(x).cast("double").alias("x")).groupBy("k", "x").agg(F.count("*").alias("n"))
    placed = written(counts.where("x is not null").repartitionByRange("k", "x").withColumn("part", F.spark_partition_id()), "ranges")
    parts = placed.groupBy("k", "part").agg(F.min("x").alias("first"), F.sum("n").alias("m"))
    ordered, whole = Window.partitionBy("k").orderBy("first"), Window.partitionBy("k")
    parts = parts.select("k", "part", "m", (F.sum("m").over(ordered) - F.col("m")).alias("before"), F.sum("m").over(whole).alias("total"))
    at = lambda q: F.lit(float(q)) * (F.col("total") - 1)
    ranks = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), (f(at(q)).cast("long") - F.col("before")).alias("rank")) for name, q in of.items() for side, f in (("low", F.floor), ("high", F.ceil))))
    asked = parts.select("k", "part", F.filter(ranks, lambda p: (p["rank"] >= 0) & (p["rank"] < F.col("m"))).alias("asked")).where(F.size("asked") > 0)
    up_to = F.sum("n").over(Window.partitionBy("k", "part").orderBy("x"))
    numbered = placed.join(asked, ["k", "part"]).withColumn("to", up_to)
    hit = numbered.select("k", "x", F.explode(F.filter("asked", lambda p: (p["rank"] >= F.col("to") - F.col("n")) & (p["rank"] < F.col("to")))).alias("p"))
    value = lambda name, side: F.max(F.when((F.col("p.name") == name) & (F.col("p.side") == side), F.col("x"))).alias(f"{name} {side}")
    found = hit.groupBy("k").agg(*(value(name, side) for name in of for side in ("low", "high"))).join(parts.select("k", "total").distinct(), "k")

    def between(name: str, q: float) -> Column:
        low, high = F.col(f"{name} low"), F.col(f"{name} high")
        exact = F.when(low == high, low).otherwise((F.ceil(at(q)) - at(q)) * low + (at(q) - F.floor(at(q))) * high)
        if places is not None:
            unit = 10.0**places
            exact = low + F.floor(F.round((high - low) * unit) * (at(q) - F.floor(at(q)))) / unit
        return (exact if digits is None else F.round(exact, digits)).alias(name)

    every = counts.select("k").distinct() if by else counts.sparkSession.range(1).select(group.alias("k"))
    return every.join(found, "k", "left").select(*(F.col("k")[name].alias(name) for name in by), *(between(name, q) for name, q in of.items()))


def summary(df: DataFrame, by: list[str], x: str, digits: int = 6) -> DataFrame:
    """By group n, least, mean, most and exact quantiles with linear interpolation."""
    known = df.groupBy(*by).agg(F.count(x).alias("n"), F.min(x).alias("least"), F.round(F.avg(x), digits).alias("mean"), F.max(x).alias("most"))
    return beside(known, quantiles(df, by, x, QUANTILES, digits), by)


def beside(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """The rows of two tables that hold one row for each group, in one table; groups by null meet as others do."""
    if not by:
        return a.crossJoin(F.broadcast(b))  # one row each
    met = a.alias("a").join(b.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in by])
    return met.select("a.*", *(f"b.{k}" for k in b.columns if k not in by))


def value_counts(df: DataFrame, x: str) -> DataFrame:
    """Rows by value; null and empty values count as unknown."""
    return df.groupBy(F.coalesce(F.nullif(F.col(x), F.lit("")), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))


def power_law(x: Column, y: Column, digits: int = 8) -> list[Column]:
    """Least squares in logs: y = factor * x ** exponent, with the share of variance explained and the residual in logs."""
    lx, ly = F.log(x), F.log(y)
    left = F.var_pop(ly) * (1 - F.regr_r2(ly, lx))
    return [
        F.count("*").alias("n"), F.round(F.regr_slope(ly, lx), digits).alias("exponent"), F.round(F.exp(F.regr_intercept(ly, lx)), digits).alias("factor"),
        F.round(F.regr_r2(ly, lx), digits).alias("r2"), F.round(F.sqrt(F.greatest(left, F.lit(0.0))), digits).alias("rmse"),
    ]


def two_way(df: DataFrame, a: str, b: str, x: str) -> DataFrame:
    """Population variance of cell values split into both factors and what remains, for a full a by b table."""
    mean = df.agg(F.avg(x).alias("m"))  # one row
    m = df.select(F.col(x).alias("x"), F.avg(x).over(Window.partitionBy(a)).alias("ma"), F.avg(x).over(Window.partitionBy(b)).alias("mb")).crossJoin(F.broadcast(mean))
    sq = lambda v: F.avg(v * v)
    c = F.col
    return m.agg(sq(c("x") - c("m")).alias("total"), sq(c("ma") - c("m")).alias("first"), sq(c("mb") - c("m")).alias("second"), sq(c("x") - c("ma") - c("mb") + c("m")).alias("interaction"))


def errors(target: Column, got: Column) -> list[Column]:
    d = got - target
    r = F.when((F.stddev_pop(target) > 0) & (F.stddev_pop(got) > 0), F.corr(target, got))
    return [F.count(d).alias("n"), F.round(F.avg(d), 6).alias("bias"), F.round(F.avg(F.abs(d)), 6).alias("mae"), F.round(F.sqrt(F.avg(d * d)), 6).alias("rmse"), F.round(r, 8).alias("pearson")]
