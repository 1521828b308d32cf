"""Geometry on nested lon/lat arrays: polygons are array<ring>, rings array<[lon, lat]>."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_RADIUS_M = 6_371_008.8
SQUARE_METRES_PER_ACRE = 4046.8564224
MERCATOR_LIMIT = 85.05112878
MERCATOR_RADIUS = 6378137.0


def _lon(point: Column) -> Column:
    return F.get(point, F.lit(0))


def _lat(point: Column) -> Column:
    return F.get(point, F.lit(1))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def ring_square_metres(ring: Column) -> Column:
    """Shoelace area on a local equirectangular projection at the ring's mean latitude."""
    degree = EARTH_RADIUS_M * math.pi / 180
    lat0 = F.radians(_total(F.transform(ring, _lat)) / F.size(ring))
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, following, lambda p, q: _lon(p) * _lat(q) - _lon(q) * _lat(p))
    return F.abs(_total(cross)) * F.cos(lat0) * (degree * degree) / 2


def multipolygon_acres(polys: Column) -> Column:
    """Acres of every polygon's outer ring less its holes."""
    def polygon(rings: Column) -> Column:
        holes = F.slice(rings, 2, F.greatest(F.size(rings), F.lit(1)))
        return ring_square_metres(F.get(rings, F.lit(0))) - _total(F.transform(holes, ring_square_metres))

    return _total(F.transform(polys, polygon)) / SQUARE_METRES_PER_ACRE


def first_coordinate(polys: Column) -> Column:
    return polys[0][0][0]


def points(polys: Column) -> Column:
    return F.flatten(F.flatten(polys))


def bounding_box(polys: Column) -> Column:
    lons, lats = F.transform(points(polys), _lon), F.transform(points(polys), _lat)
    return F.struct(F.array_min(lons).alias("lon_min"), F.array_min(lats).alias("lat_min"),
                    F.array_max(lons).alias("lon_max"), F.array_max(lats).alias("lat_max"))


def centroid(polys: Column) -> Column:
    """Mean vertex of the first outer ring, without its closing point."""
    ring = polys[0][0]
    open_ring = F.slice(ring, F.lit(1), F.size(ring) - 1)
    return F.struct((_total(F.transform(open_ring, _lon)) / F.size(open_ring)).alias("lon"),
                    (_total(F.transform(open_ring, _lat)) / F.size(open_ring)).alias("lat"))


def web_mercator(lon: Column, lat: Column) -> Column:
    clamped = F.greatest(F.least(lat, F.lit(MERCATOR_LIMIT)), F.lit(-MERCATOR_LIMIT))
    return F.struct((F.radians(lon) * MERCATOR_RADIUS).alias("x"),
                    (F.log(F.tan(F.lit(math.pi / 4) + F.radians(clamped) / 2)) * MERCATOR_RADIUS).alias("y"))


def project_multipolygon(polys: Column) -> Column:
    """Every vertex in web mercator metres, same nesting."""
    def vertex(point: Column) -> Column:
        xy = web_mercator(_lon(point), _lat(point))
        return F.array(xy["x"], xy["y"])

    return F.transform(polys, lambda rings: F.transform(rings, lambda ring: F.transform(ring, vertex)))


def edges(polys: Column) -> Column:
    """Every ring's edges as (y1, y2, x1, slope), prepared once per polygon for point tests."""
    def ring_edges(ring: Column) -> Column:
        following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
        return F.zip_with(ring, following, lambda p, q: F.struct(
            _lat(p).alias("y1"), _lat(q).alias("y2"), _lon(p).alias("x1"),
            F.try_divide(_lon(q) - _lon(p), _lat(q) - _lat(p)).alias("slope")))

    # Level edges never cross a ray.
    return F.filter(F.flatten(F.transform(F.flatten(polys), ring_edges)), lambda e: e["slope"].isNotNull())


def edge_boxes(polys: Column) -> Column:
    """The box of every ring's edges, level ones too."""
    def of_ring(ring: Column) -> Column:
        following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
        return F.zip_with(ring, following, lambda p, q: F.struct(
            F.least(_lon(p), _lon(q)).alias("x_min"), F.greatest(_lon(p), _lon(q)).alias("x_max"),
            F.least(_lat(p), _lat(q)).alias("y_min"), F.greatest(_lat(p), _lat(q)).alias("y_max")))
    return F.flatten(F.transform(F.flatten(polys), of_ring))


def inside(polygon_edges: Column, lon: Column, lat: Column) -> Column:
    """Even-odd ray test of a point against prepared edges."""
    crossed = F.filter(polygon_edges, lambda e: ((e["y1"] > lat) != (e["y2"] > lat))
                       & (lon < e["x1"] + e["slope"] * (lat - e["y1"])))
    return F.size(crossed) % 2 == 1


def contains(polys: Column, lon: Column, lat: Column) -> Column:
    return inside(edges(polys), lon, lat)
