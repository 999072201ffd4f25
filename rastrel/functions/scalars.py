"""Scalar functions on labels, numbers, rings and grid transforms, all as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label aliases, material ids and priors of the classifier's output.
ALIASES = {"asphalt": "tar_paper", "bitumen": "tar_paper", "tile": "roof_tiles", "tiles": "roof_tiles", "clay_tiles": "roof_tiles", "slate": "roof_tiles"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def label(c: Column | str) -> Column:
    """Trimmed lower case, hyphens and spaces as underscores."""
    return F.regexp_replace(F.lower(F.trim(_col(c))), "[- ]", "_")


def canonical_label(c: Column | str) -> Column:
    """label with aliases resolved."""
    table = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    return F.coalesce(F.element_at(table, label(c)), label(c))


def slug(c: Column | str, default: str = "city") -> Column:
    """Runs of other characters than letters and digits as one underscore, none at the ends."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(_col(c), "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit(default))


def first_value(c: Column | str) -> Column:
    """The first element of a stringified list, or the string; trimmed lower case. An empty list is null."""
    c = _col(c)
    parsed = F.from_json(c, "array<string>", {"allowSingleQuotes": "true"})
    listed = F.trim(c).startswith("[")
    return F.lower(F.trim(F.when(listed & parsed.isNotNull(), F.get(parsed, F.lit(0))).otherwise(c)))


def first_number(c: Column | str) -> Column:
    """first_value as a double; null where it is none or not finite."""
    number = first_value(c).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def shoelace(ring: str) -> Column:
    """Area of a ring of struct<x, y>, closed or not."""
    return F.expr(f"abs(aggregate(transform({ring}, (p, i) -> p.x * {ring}[(i + 1) % size({ring})].y - {ring}[(i + 1) % size({ring})].x * p.y), 0D, (a, v) -> a + v)) / 2")


def centroid(ring: str, axis: str) -> Column:
    """x or y of a ring's centroid; null for a ring without area."""
    cross = f"(p.x * {ring}[(i + 1) % size({ring})].y - {ring}[(i + 1) % size({ring})].x * p.y)"
    top = f"aggregate(transform({ring}, (p, i) -> (p.{axis} + {ring}[(i + 1) % size({ring})].{axis}) * {cross}), 0D, (a, v) -> a + v)"
    twice = f"aggregate(transform({ring}, (p, i) -> {cross}), 0D, (a, v) -> a + v)"
    return F.expr(f"try_divide({top}, 3 * {twice})")


def newell_slope(ring: str) -> Column:
    """Slope in degrees of the plane of a ring of struct<x, y, z>, from its Newell normal; null without one."""

    def part(a: str, b: str) -> str:
        n = f"{ring}[(i + 1) % size({ring})]"
        return f"aggregate(transform({ring}, (p, i) -> (p.{a} - {n}.{a}) * (p.{b} + {n}.{b})), 0D, (s, v) -> s + v)"

    x, y, z = part("y", "z"), part("z", "x"), part("x", "y")
    norm = f"sqrt(pow({x}, 2) + pow({y}, 2) + pow({z}, 2))"
    return F.expr(f"degrees(acos(least(1D, abs(try_divide({z}, {norm})))))").alias("slope")


def mercator(lon: Column | str, lat: Column | str) -> tuple[Column, Column]:
    """EPSG:3857 coordinates of degrees."""
    r = 6378137.0
    return F.radians(_col(lon)) * r, F.log(F.tan(F.lit(0.7853981633974483) + F.radians(_col(lat)) / 2)) * r


def affine_of_worldfile(a: str, d: str, b: str, e: str, c: str, f: str) -> tuple[Column, Column]:
    """Outer corner of the upper left pixel from a world file's centre."""
    return F.col(c) - F.col(a) / 2 - F.col(b) / 2, F.col(f) - F.col(d) / 2 - F.col(e) / 2


def ring_holds(ring: Column, x: Column, y: Column) -> Column:
    """Whether a ring of struct<x, y>, closed or not, holds a point, by the edges that a ray to the right crosses."""
    n = F.size(ring)

    def crosses(p: Column, i: Column) -> Column:
        q = F.get(ring, (i + 1) % n)
        # multiplied by q.y - p.y and compared by its sign, so that nothing is divided
        side = (x - p["x"]) * (q["y"] - p["y"]) - (q["x"] - p["x"]) * (y - p["y"])
        met = ((p["y"] > y) != (q["y"] > y)) & F.when(q["y"] > p["y"], side < 0).otherwise(side > 0)
        return F.when(met, 1).otherwise(0)

    return F.aggregate(F.transform(ring, crosses), F.lit(0), lambda a, v: a + v) % 2 == 1


def ring_touches(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point lies on an edge or a corner of a ring of struct<x, y>, closed or not."""
    n = F.size(ring)

    def meets(p: Column, i: Column) -> Column:
        q = F.get(ring, (i + 1) % n)
        side = (x - p["x"]) * (q["y"] - p["y"]) - (q["x"] - p["x"]) * (y - p["y"])
        return (side == 0) & x.between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & y.between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))

    return F.coalesce(F.exists(F.transform(ring, meets), lambda v: v), F.lit(False))


def utm_zone(lon: Column | str) -> Column:
    """The UTM zone, 1 to 60, of a longitude."""
    return F.least(F.lit(60), F.floor((_col(lon) + 180) / 6).cast("int") + 1)


def utm(lon: Column | str, lat: Column | str, zone: Column | int) -> tuple[Column, Column]:
    """Easting and northing on WGS 84 in a zone, by the Krüger series to the third power of the flattening.

    The northing of southern latitudes has 10,000 km added.
    """
    lon, lat, zone = _col(lon), _col(lat), F.lit(zone) if isinstance(zone, int) else zone
    f = 1 / 298.257223563
    n = f / (2 - f)
    radius = 0.9996 * 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    s, away = F.sin(F.radians(lat)), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for k, a in enumerate(series, 1):
        x = x + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        y = y + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return 500_000 + radius * x, radius * y + F.when(lat < 0, 10_000_000.0).otherwise(0.0)


def polygons_area(polygons: Column | str) -> Column:
    """Area of polygons, arrays of rings of struct<x, y> of which the first is the exterior; holes are taken off, to 0 at least."""

    def twice(ring: Column) -> Column:
        n = F.size(ring)
        cross = F.transform(ring, lambda p, i: p["x"] * F.get(ring, (i + 1) % n)["y"] - F.get(ring, (i + 1) % n)["x"] * p["y"])
        return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, v: a + v))

    one = lambda rings: F.greatest(F.lit(0.0), F.aggregate(F.transform(rings, lambda r, i: F.when(i == 0, twice(r)).otherwise(-twice(r))), F.lit(0.0), lambda a, v: a + v))
    return F.aggregate(F.transform(_col(polygons), one), F.lit(0.0), lambda a, v: a + v) / 2


def moved(polygons: Column | str, move) -> Column:
    """polygons with each point (x, y) replaced by move(x, y), a pair of columns."""

    def point(p: Column) -> Column:
        x, y = move(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(_col(polygons), lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, point)))


def crop_world_file(x: Column, y: Column, side: Column, pad: float = 0.1, size: int = 512) -> tuple[Column, ...]:
    """(a, d, b, e, c, f) of the world file of a square crop around a centre: its outer corner is written where a centre is read."""
    half = side * (1 + pad) / 2
    pixel = half * 2 / size
    zero = F.lit(0.0)
    return pixel, zero, zero, -pixel, x - half, y + half


def first_token(c: Column | str) -> Column:
    """What stands before the first comma, trimmed; null stays null."""
    return F.trim(F.split(_col(c).cast("string"), ",")[0])


def patch_name(number: Column | str, x: Column | str) -> Column:
    """patch_ and a number of six digits, with the column where it starts."""
    return F.concat(F.lit("patch_"), F.lpad(_col(number).cast("string"), 6, "0"), F.lit("_x"), _col(x).cast("int").cast("string"))


def chip_name(stem: Column | str, building: Column | str, part: Column | str) -> Column:
    """A chip's name: the image's stem, _b, and a thousand times the building's place plus the part's, three digits at least."""
    number = _col(building).cast("long") * 1000 + _col(part)
    return F.format_string("%s_b%03d", _col(stem), number)


def crop_name(city: Column | str, number: Column | str, material: Column | str, shape: Column | str) -> Column:
    """A crop's name: slugs of city, material and shape around a number of six digits."""
    return F.concat_ws("_", slug(city), F.lpad(_col(number).cast("string"), 6, "0"), slug(material, "unknown"), slug(shape, "unknown"))
