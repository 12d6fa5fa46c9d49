"""Points, polygons and distances, with grid cells so that joins are by key."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Earth radii, and metres in a degree of longitude at the equator and of latitude.
MILES, METRES = 3958.7613, 6371000.0
DEGREE_X, DEGREE_Y = 111320.0, 110540.0
BEARINGS, RADII, EARTH = 8, (5, 15, 30), 6371008.8


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = MILES) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _around(ring: Column) -> Column:
    """A ring's points, each in the place of the one after it."""
    n = F.size(ring)
    return F.concat(F.slice(ring, n, F.lit(1)), F.slice(ring, F.lit(1), n - 1))


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd test of a point against a ring of [x, y] points, closed or not. A point on the ring itself isn't in it."""

    def crosses(a: Column, b: Column, p: Column) -> Column:
        over = (a[1] > p["y"]) != (b[1] > p["y"])
        return F.when(over, p["x"] < (b[0] - a[0]) * (p["y"] - a[1]) / F.nullif(b[1] - a[1], F.lit(0.0)) + a[0]).otherwise(False)

    def touches(a: Column, b: Column, p: Column) -> Column:
        within = lambda i, c: c.between(F.least(a[i], b[i]), F.greatest(a[i], b[i]))
        return within(0, p["x"]) & within(1, p["y"]) & ((b[0] - a[0]) * (p["y"] - a[1]) == (b[1] - a[1]) * (p["x"] - a[0]))

    def inside(p: Column) -> Column:
        odd = F.aggregate(F.zip_with(ring, _around(ring), lambda a, b: crosses(a, b, p)), F.lit(False), lambda so_far, c: so_far != c)
        return odd & ~F.exists(F.zip_with(ring, _around(ring), lambda a, b: touches(a, b, p)), lambda on: on)

    return _once(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")), inside)


def in_polygon(rings: Column, x: Column, y: Column, origins: tuple[Column, Column] | None = None) -> Column:
    """Inside the first ring and in none of the others; on a hole's edge is inside, on the first ring isn't. origins: where the first ring's points, and each other's, are offsets from."""
    holes = F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0)))
    if origins is None:
        return in_ring(F.element_at(rings, 1), x, y) & ~F.exists(holes, lambda r: in_ring(r, x, y))
    first, others = origins
    return in_ring(F.element_at(rings, 1), x - first["x"], y - first["y"]) & ~F.exists(F.zip_with(holes, others, lambda r, o: in_ring(r, x - o["x"], y - o["y"])), lambda inside: inside)


def to_ring(ring: Column, x: Column, y: Column, latitude: Column | None = None) -> Column:
    """Metres from a point to the nearest segment of a ring, on a local plane at the latitude (y, if none is given)."""
    here = F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), F.cos(F.radians(y if latitude is None else latitude)).alias("narrow"))
    local = lambda h: F.transform(ring, lambda p: F.struct(((p[0] - h["x"]) * DEGREE_X * h["narrow"]).alias("x"), ((p[1] - h["y"]) * DEGREE_Y).alias("y")))

    def segment(a: Column, d: Column) -> Column:
        place = lambda length: F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(a["x"] * d["x"] + a["y"] * d["y"]) / F.nullif(length, F.lit(0.0))))).otherwise(0.0)
        nearest = lambda t: F.struct((a["x"] + t * d["x"]).alias("x"), (a["y"] + t * d["y"]).alias("y"))
        return _once(_once(_once(d["x"] * d["x"] + d["y"] * d["y"], place), nearest), lambda q: F.sqrt(q["x"] * q["x"] + q["y"] * q["y"]))

    def least(points: Column) -> Column:
        return F.array_min(F.zip_with(points, _around(points), lambda a, b: _once(F.struct((b["x"] - a["x"]).alias("x"), (b["y"] - a["y"]).alias("y")), lambda d: segment(a, d))))

    return _once(_once(here, local), least)


def to_boundary(rings: Column, x: Column, y: Column, origins: tuple[Column, Column] | None = None) -> Column:
    """Metres from a point to the nearest segment of any ring, holes among them. origins: as in :func:`in_polygon`."""
    if origins is None:
        return F.array_min(F.transform(rings, lambda ring: to_ring(ring, x, y)))
    first, others = origins
    holes = F.zip_with(F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0))), others, lambda ring, o: to_ring(ring, x - o["x"], y - o["y"], y))
    return F.array_min(F.concat(F.array(to_ring(F.element_at(rings, 1), x - first["x"], y - first["y"], y)), holes))


def origins_of(polygons: DataFrame) -> tuple[Column, Column] | None:
    return (F.col("origin"), F.col("hole_origins")) if "origin" in polygons.columns else None


def ambiguity(points: DataFrame, polygons: DataFrame, point_id: str, edge: float = 75.0) -> DataFrame:
    """For each point the polygons that it lies in, whether it lies in none or several, and whether a boundary of theirs is within `edge` metres."""
    hit = point_polygon_join(points, polygons).select(point_id, to_boundary(F.col("rings"), F.col("lon"), F.col("lat"), origins_of(polygons)).alias("_m"))
    near = hit.groupBy(point_id).agg(F.count("*").alias("polygons"), F.min("_m").alias("_m"))
    out = points.select(point_id).join(near, point_id, "left").withColumn("polygons", F.coalesce("polygons", F.lit(0).cast("long")))
    return out.select(point_id, "polygons", (F.col("polygons") > 1).alias("overlap"), (F.col("polygons") == 0).alias("gap"), F.coalesce(F.col("_m") <= edge, F.lit(False)).alias("near_boundary"), F.col("_m").alias("min_boundary_distance_m"))


def centroid(ring: Column) -> Column:
    """The mean of a ring's vertices."""
    mean = lambda i: F.aggregate(ring, F.lit(0.0), lambda a, p: a + p[i]) / F.size(ring)
    return F.struct(mean(0).alias("lon"), mean(1).alias("lat"))


def cell(x: Column, y: Column, size: float) -> list[Column]:
    return [F.floor(x / size).alias("cell_x"), F.floor(y / size).alias("cell_y")]


def _in_cells(polygons: DataFrame, size: float) -> DataFrame:
    """Each polygon in every grid cell of its box."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size))
    return polygons.withColumn("cell_x", F.explode(span("x0", "x1"))).withColumn("cell_y", F.explode(span("y0", "y1")))


def point_polygon_join(points: DataFrame, polygons: DataFrame, size: float = 0.1) -> DataFrame:
    """Points with the polygons they lie in. polygons: feature_id, rings, x0, y0, x1, y1 (their box), and origin (x, y)
    and hole_origins if rings are offsets: a point on an edge is told by its offset then, in the offset's own type.

    A polygon stands in every grid cell of its box, a point in one, so the join is by cell and large layers are never
    held against each other whole.
    """
    spread = _in_cells(polygons, size)
    placed = points.select("*", *cell(F.col("lon"), F.col("lat"), size))
    inside = F.col("lon").between(F.col("x0"), F.col("x1")) & F.col("lat").between(F.col("y0"), F.col("y1"))
    return placed.join(spread, ["cell_x", "cell_y"]).filter(inside).filter(in_polygon(F.col("rings"), F.col("lon"), F.col("lat"), origins_of(polygons))).drop("cell_x", "cell_y")


def nearest(centres: DataFrame, sites: DataFrame, radius_miles: float, k: int, centre_id: str, site_id: str) -> DataFrame:
    """The k nearest sites within the radius of each centre, at any latitude and over the date line.

    Cells are rows of the radius' height; a row is cut into equal cells, as wide as the radius reaches in longitude at
    the highest latitude of the row and its neighbours. A centre stands in its cell, a site in the three cells around it
    in each of three rows. Sites of one place meet a centre as one, by their k least ids, and the k nearest places hold
    the k nearest sites, so places where very many stand make no pairs of their own.
    """
    angle = math.degrees(radius_miles / MILES)
    row = lambda lat: F.floor((lat + 90) / angle)
    # the highest latitude from the row below to the row above, and how far the radius reaches there in longitude
    high = lambda r: F.least(F.lit(90.0), F.greatest(F.abs((r - 1) * angle - 90), F.abs((r + 2) * angle - 90)))
    reach = lambda r: F.when(high(r) + angle >= 90, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), math.sin(math.radians(angle)) / F.cos(F.radians(high(r)))))))
    cells = lambda r: F.greatest(F.lit(1), F.floor(360 / (reach(r) * (1 + 1e-9)))).cast("long")
    column = lambda lon, r: F.pmod(F.floor(F.pmod(lon + 180, F.lit(360.0)) / 360 * cells(r)), cells(r))
    c = centres.select(centre_id, "lon", "lat", row(F.col("lat")).alias("cell_y")).withColumn("cell_x", column(F.col("lon"), F.col("cell_y")))
    s = sites.filter("lon is not null and lat is not null").select(F.col(site_id).alias("_site"), F.col("lon").alias("site_lon"), F.col("lat").alias("site_lat"))
    s = s.withColumn("_n", F.row_number().over(Window.partitionBy("site_lon", "site_lat").orderBy("_site"))).filter(F.col("_n") <= k)
    s = s.groupBy("site_lon", "site_lat").agg(F.sort_array(F.collect_list("_site")).alias("_sites")).withColumn("cell_y", F.explode(F.array(*[row(F.col("site_lat")) + i for i in (-1, 0, 1)])))
    around = F.array_distinct(F.array(*[F.pmod(column(F.col("site_lon"), F.col("cell_y")) + i, cells(F.col("cell_y"))) for i in (-1, 0, 1)]))
    s = s.withColumn("cell_x", F.explode(around))
    near = c.join(s, ["cell_x", "cell_y"]).withColumn("miles", haversine(F.col("lon"), F.col("lat"), F.col("site_lon"), F.col("site_lat"))).filter(F.col("miles") <= radius_miles)
    places = Window.partitionBy(centre_id).orderBy("miles", F.col("_sites")[0])
    near = near.withColumn("_n", F.row_number().over(places)).filter(F.col("_n") <= k).select(centre_id, "miles", F.explode("_sites").alias(site_id))
    w = Window.partitionBy(centre_id).orderBy("miles", site_id)
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(centre_id, site_id, "miles", "rank")


OFFSETS = [(0, 0)] + [(r, b) for r in RADII for b in range(BEARINGS)]


def _places(lon: Column, lat: Column) -> Column:
    """The place itself and rings of bearings around it, as structs of radius, bearing, lon and lat."""
    angle = lambda o: 2 * 3.141592653589793 * o["bearing"] / BEARINGS
    offsets = F.array(*[F.struct(F.lit(r).alias("radius"), F.lit(b).alias("bearing")) for r, b in OFFSETS])
    return F.transform(offsets, lambda o: F.struct(
        o["radius"].alias("radius"), o["bearing"].alias("bearing"), (lon + F.degrees(o["radius"] * F.sin(angle(o)) / (EARTH * F.greatest(F.lit(1e-9), F.cos(F.radians(lat)))))).alias("lon"), (lat + F.degrees(o["radius"] * F.cos(angle(o)) / EARTH)).alias("lat"),
    ))


def perturbed(points: DataFrame) -> DataFrame:
    """Each point with its centre and rings of bearings around it."""
    rows = points.withColumn("_o", F.explode(_places(F.col("lon"), F.col("lat"))))
    return rows.withColumns({c: F.col(f"_o.{c}") for c in ("radius", "bearing", "lon", "lat")}).drop("_o")


def _judged(out: DataFrame) -> DataFrame:
    label = F.when(F.col("reference").isNull(), "unstable").when((F.col("stable_fraction") >= 0.95) & (F.col("unresolved") == 0), "stable").when(F.col("stable_fraction") >= 0.75, "boundary-sensitive").when(F.col("stable_fraction") >= 0.5, "fragile").otherwise("unstable")
    return out.withColumns({"status": label, "score": F.col("stable_fraction") * (1 - 0.5 * F.col("unresolved"))})


def stability(resolved: DataFrame, point_id: str) -> DataFrame:
    """Share of the places around a point that resolve as the point itself does, with a label; an unresolved point is unstable.

    resolved: point_id, radius (0: the point itself), bearing, answer (null: none).
    """
    centre = resolved.filter("radius = 0").select(point_id, F.col("answer").alias("reference"))
    both = resolved.filter("radius > 0").join(centre, point_id)
    return _judged(both.groupBy(point_id).agg(F.first("reference").alias("reference"), (F.count_if(F.col("answer") == F.col("reference")) / F.count("*")).alias("stable_fraction"), (F.count_if(F.col("answer").isNull()) / F.count("*")).alias("unresolved")))


def polygon_stability(points: DataFrame, polygons: DataFrame, point_id: str, size: float = 0.1) -> DataFrame:
    """`stability` of the least polygon at each of the `perturbed` places of a point.

    A point meets the polygons of the cells that its places touch (four at most, in most cases one), and a row tells all
    its places at once, so no row is made for each place.
    """
    places = _places(F.col("lon"), F.col("lat"))
    touched = F.array_distinct(F.transform(places, lambda p: F.struct(*cell(p["lon"], p["lat"], size))))
    placed = points.select(point_id, "lon", "lat", F.explode(touched).alias("_c")).select(point_id, "lon", "lat", "_c.*")
    met = placed.join(_in_cells(polygons, size), ["cell_x", "cell_y"], "left")
    inside = lambda p: p["lon"].between(F.col("x0"), F.col("x1")) & p["lat"].between(F.col("y0"), F.col("y1")) & in_polygon(F.col("rings"), p["lon"], p["lat"], origins_of(polygons))
    met = met.select(point_id, F.transform(places, lambda p: F.when(inside(p), F.col("feature_id"))).alias("_a"))
    n = len(OFFSETS)
    found = met.groupBy(point_id).agg(*[F.min(F.col("_a")[i]).alias(f"_a{i}") for i in range(n)])
    share = lambda test: sum((F.when(test(F.col(f"_a{i}")), 1).otherwise(0) for i in range(1, n)), F.lit(0)) / (n - 1)
    return _judged(found.select(point_id, F.col("_a0").alias("reference"), share(lambda a: a == F.col("_a0")).alias("stable_fraction"), share(lambda a: a.isNull()).alias("unresolved")))
