"""Great-circle distance and exact neighbourhood cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Straight-line km; the clamp protects asin at antipodes."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2
    )
    half = F.sqrt(h)  # not least(): it would skip a NULL and turn "unknown" into the antipode
    return F.lit(2 * EARTH_KM) * F.asin(F.when(half > 1, F.lit(1.0)).otherwise(half))


def rounded(km: Column) -> Column:
    return F.round(km, 1)


def sphere_cell(lat: Column, lon: Column, km: float) -> Column:
    """struct(x, y, z) cell of edge ``km`` on the sphere in 3-D.

    A chord is never longer than its arc, so two points within ``km`` always
    fall in the same or an adjacent cell. No special case at poles or at 180°.
    """
    phi, lam = F.radians(lat), F.radians(lon)

    def index(axis: Column) -> Column:
        return F.floor(axis * EARTH_KM / km).cast("int")

    return F.struct(
        index(F.cos(phi) * F.cos(lam)).alias("x"),
        index(F.cos(phi) * F.sin(lam)).alias("y"),
        index(F.sin(phi)).alias("z"),
    )


def adjacent_cells(cell: Column) -> Column:
    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    return F.array(
        *[
            F.struct(
                (cell["x"] + i).alias("x"), (cell["y"] + j).alias("y"), (cell["z"] + k).alias("z")
            )
            for i, j, k in steps
        ]
    )


def valid_point(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))
