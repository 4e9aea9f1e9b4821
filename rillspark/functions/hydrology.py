"""Scalar expressions of hydrology and terrain, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds in a year; the profile's channel threshold in square kilometres, runoff ratio, reference precipitation in mm.
SECONDS_PER_YEAR = 31_557_600
CHANNEL_KM2, RUNOFF_RATIO, REFERENCE_MM = 11.875, 0.628448430696258, 1350.0


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def signed_sqrt(z: Column) -> Column:
    return F.signum(z) * F.sqrt(F.abs(z))


def signed_square(s: Column) -> Column:
    return F.signum(s) * s * s


def calibrated_precipitation(p: Column, scale: float, offset: float, low: float, high: float) -> Column:
    return clip(p * scale + offset, low, high)


def local_discharge(p_mm: Column, resolution_m: float, ratio: float = RUNOFF_RATIO) -> Column:
    """Mean discharge of one cell in cubic metres a second."""
    return p_mm / 1000.0 * ratio * (resolution_m * resolution_m) / SECONDS_PER_YEAR


def log_area(area_m2: Column) -> Column:
    return clip(F.log1p(area_m2 / 1e6) / F.log1p(F.lit(1000.0)), 0.0, 1.0)


def hydraulic_width(q: Column) -> Column:
    return clip(2.5 * F.sqrt(q), 2.0, 120.0)


def valley_half_width(area_m2: Column, threshold_m2: float) -> Column:
    return clip(60 + 35 * F.log10(F.greatest(area_m2 / threshold_m2, F.lit(1.0))), 60.0, 600.0)


def proximity(distance: Column, scale: float) -> Column:
    return F.exp(-distance / scale)


def corridor(distance: Column, sigma: float = 60.0, reach: float = 150.0) -> Column:
    return F.when(distance <= reach, F.exp(-0.5 * (distance / sigma) * (distance / sigma))).otherwise(0.0)


def elevation_band(z: Column) -> Column:
    """Half-open bands from 0, 500, 1000 and 2000 m."""
    return F.when(z < 500, "0-500").when(z < 1000, "500-1000").when(z < 2000, "1000-2000").otherwise("2000+")


def hillshade(dx: Column, dy: Column) -> Column:
    """Light from 315 degrees at 45 degrees."""
    slope, aspect = F.atan(F.hypot(dx, dy)), F.atan2(-dx, dy)
    turn, root = F.lit(5.497787143782138), F.lit(0.7071067811865476)
    return clip(root * F.cos(slope) + root * F.sin(slope) * F.cos(turn - aspect), 0.0, 1.0)


#: D8 codes with their steps south and east (fixed values).
_D8 = ((1, 0, 1), (2, 1, 1), (3, 1, 0), (4, 1, -1), (5, 0, -1), (6, -1, -1), (7, -1, 0), (8, -1, 1))


def flow_vector(code: Column) -> tuple[Column, Column]:
    """East and south parts of a unit vector; zero where there is no flow."""
    east = F.element_at(F.array(F.lit(0.0), *(F.lit(c / (r * r + c * c) ** 0.5) for _, r, c in _D8)), code + 1)
    south = F.element_at(F.array(F.lit(0.0), *(F.lit(r / (r * r + c * c) ** 0.5) for _, r, c in _D8)), code + 1)
    return east, south


def flow_code(east: Column, south: Column, least: float = 0.25) -> Column:
    """The D8 code of the signs of a vector; 0 if its parts add up to less than `least`."""
    found = F.lit(0)
    for code, r, c in _D8:
        found = F.when((F.signum(south) == r) & (F.signum(east) == c), code).otherwise(found)
    return F.when(F.abs(east) + F.abs(south) < least, 0).otherwise(found)


def coverage(width: Column, distance: Column, resolution: float) -> Column:
    """Share of a fine cell that a river of some width covers."""
    return clip((0.5 * width + 0.5 * resolution - distance) / resolution, 0.0, 1.0)


def bed_offset(bed: Column, z: Column, corridor: Column, scale: float = 32.0) -> Column:
    return F.tanh((bed - z) / scale) * corridor


def clean_precipitation(p: Column, land: Column) -> Column:
    """0 where it isn't finite or not on land."""
    finite = p.isNotNull() & ~F.isnan(p) & (F.abs(p) < float("inf"))
    return F.when(finite & land, p).otherwise(0.0)


def supported(residual: Column, immutable: Column) -> tuple[Column, Column]:
    """The residual that is applied, and what is suppressed on cells that must stay."""
    return F.when(immutable, 0.0).otherwise(residual), F.when(immutable, residual).otherwise(0.0)


def constrained(base: Column, candidate: Column, freedom: Column, lake: Column, surface: Column, least_depth: float = 1.0) -> Column:
    """base, moved towards the candidate as far as it is free to; lake beds stay below their surface."""
    moved = base + freedom * (candidate - base)
    return F.when(lake, F.least(moved, surface - least_depth)).otherwise(moved)


def float_step(x: Column) -> Column:
    """Distance from a single-precision number to the next."""
    return F.when(x == 0, 2.0**-149).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(F.abs(x))) - 23))


def incised(z: Column, correction: Column, channel: Column, target: Column) -> tuple[Column, Column]:
    """Height cut to the bed, never raised; and whether the bed would have raised it by more than rounding."""
    new = F.when(channel & target.isNotNull(), target).otherwise(z - correction)
    return F.least(new, z), new > z + F.greatest(F.lit(1e-5), 2 * float_step(z))


def as_float(x: Column) -> Column:
    """A number, or 0.0."""
    return F.coalesce(x.try_cast("double"), F.lit(0.0))


def numeric(x: Column) -> Column:
    """A finite number, or null."""
    n = x.try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)


def as_int(x: Column) -> Column:
    """The whole part of a finite number, or 0."""
    return F.coalesce(F.when(numeric(x) < 0, F.ceil(numeric(x))).otherwise(F.floor(numeric(x))), F.lit(0)).cast("long")


def positive(x: Column) -> Column:
    """A finite number above 0, or null."""
    return F.when(numeric(x) > 0, numeric(x))
