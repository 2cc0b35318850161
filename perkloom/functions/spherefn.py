"""Distances on the globe and the grid used to join places.

The grid is laid over 3-D space, not over latitude and longitude: a point is
placed on the sphere in metres and falls in one cube. A cube edge is the same
length everywhere, so neither the poles, nor the date line, nor the highest
latitude in use matter, and a straight (chord) distance is never longer than
the distance along the ground.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from perkloom.functions.fixed_values import EARTH_RADIUS_M

# Rounding slack, far above double error and far below any radius in use.
SLACK_M = 0.01
AXES = ("x", "y", "z")
# Cell indexes are shifted into [0, 2**21) and three are packed in one bigint.
_AXIS_BITS = 21


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle metres."""
    a = F.sin(F.radians(lat2 - lat1) / 2)
    b = F.sin(F.radians(lng2 - lng1) / 2)
    h = a * a + b * b * F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def axes(lat: Column, lng: Column) -> dict[str, Column]:
    """Metres from the planet's corner, each in [0, 2R]."""
    r = F.lit(EARTH_RADIUS_M)
    return {
        "x": r * F.cos(F.radians(lat)) * F.cos(F.radians(lng)) + r,
        "y": r * F.cos(F.radians(lat)) * F.sin(F.radians(lng)) + r,
        "z": r * F.sin(F.radians(lat)) + r,
    }


def axis_cell(coord: Column, side_m: Column | float) -> Column:
    side = side_m if isinstance(side_m, Column) else F.lit(float(side_m))
    return F.floor(coord / side).cast("bigint")


def pack(cx: Column, cy: Column, cz: Column) -> Column:
    """One bigint for a cube; the indexes are non-negative and below 2**21."""
    return F.shiftleft(cx, 2 * _AXIS_BITS) + F.shiftleft(cy, _AXIS_BITS) + cz


def cell_of(lat: Column, lng: Column, side_m: float) -> Column:
    """The cube a point lies in."""
    at = axes(lat, lng)
    return pack(*(axis_cell(at[a], side_m) for a in AXES))


def cells_within(lat: Column, lng: Column, radius_m: Column, side_m: float) -> Column:
    """Array of the cubes a ball around the point reaches."""
    at = axes(lat, lng)
    reach = radius_m + F.lit(SLACK_M)
    span = {
        a: F.sequence(
            F.greatest(F.lit(0).cast("bigint"), axis_cell(at[a] - reach, side_m)),
            axis_cell(at[a] + reach, side_m),
        )
        for a in AXES
    }
    return F.flatten(
        F.transform(
            span["x"],
            lambda x: F.flatten(
                F.transform(
                    span["y"], lambda y: F.transform(span["z"], lambda z: pack(x, y, z))
                )
            ),
        )
    )
