"""Distances, bearings, tiles and polygons as trigonometric expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

#: The mean radius of the earth, and the points of the compass.
EARTH_M = 6_371_008.8
POINTS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_M) -> Column:
    """Metres between two points."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees from north at the first point, 0 to 360."""
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def compass(degrees: Column) -> Column:
    at = F.pmod(F.floor(degrees / 22.5 + 0.5), F.lit(16)).cast("int")
    return F.element_at(F.array(*map(F.lit, POINTS)), at + 1)


def naismith_minutes(metres: Column, climb: Column) -> Column:
    """5 km an hour and ten minutes for 100 m of climb; one minute at least, none for no distance. Descents count nothing."""
    minutes = F.ceil(metres / 5000 * 60 + F.greatest(F.lit(0.0), climb) / 10)
    return F.when(metres > 0, F.greatest(F.lit(1), minutes)).otherwise(0).cast("long")


def tile(lat: Column, lon: Column, zoom: int) -> Column:
    n = float(1 << zoom)
    x = F.floor((lon + 180) / 360 * n).cast("long")
    y = F.floor((1 - F.ln(F.tan(F.radians(lat)) + 1 / F.cos(F.radians(lat))) / F.pi()) / 2 * n).cast("long")
    return F.struct(x.alias("x"), y.alias("y"))


def in_polygon(lat: Column, lon: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a ring of (lat, lon): an odd number of edges is crossed."""
    crossings = F.lit(0)
    for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]):
        if a == c:
            continue
        crosses = ((F.lit(a) > lat) != (F.lit(c) > lat)) & (lon < F.lit((d - b) / (c - a)) * (lat - F.lit(a)) + F.lit(b))
        crossings = crossings + crosses.cast("int")
    return crossings % 2 == 1


def boxes_meet(a: Column, b: Column) -> Column:
    """Whether two boxes (west, south, east, north) share a point."""
    return (a["west"] <= b["east"]) & (b["west"] <= a["east"]) & (a["south"] <= b["north"]) & (b["south"] <= a["north"])


def box_holds(box: Column, lat: Column, lon: Column) -> Column:
    return lat.between(box["south"], box["north"]) & lon.between(box["west"], box["east"])


def height_tile(lat: Column, lon: Column) -> Column:
    """The name of the one-degree tile of heights that a point lies in."""
    part = lambda x, up, down, n: F.concat(F.when(x >= 0, up).otherwise(down), F.lpad(F.abs(F.floor(x)).cast("string"), n, "0"))
    return F.concat(part(lat, "N", "S", 2), part(lon, "E", "W", 3))


def grid_letters(easting: Column, northing: Column) -> Column:
    """The two letters of a 100 km square of the national grid; null outside it. Letters run from A at the north-west without I."""
    e, n = F.floor(easting / 100_000).cast("int"), F.floor(northing / 100_000).cast("int")
    letter = lambda x, y: F.substr(F.lit("ABCDEFGHJKLMNOPQRSTUVWXYZ"), (4 - y) * 5 + x + 1, F.lit(1))
    five = lambda x: F.floor(x / 5).cast("int")
    inside = (easting >= 0) & (easting < 700_000) & (northing >= 0) & (northing < 1_300_000)
    return F.when(inside, F.concat(letter(five(e) + 2, five(n) + 1), letter(e % 5, n % 5)))


def grid_reference(easting: Column, northing: Column, digits: int = 3) -> Column:
    """Letters and digits, such as TQ 301 805."""
    part = lambda x: F.lpad(F.floor(F.pmod(x, F.lit(100_000)) / 10 ** (5 - digits)).cast("string"), digits, "0")
    return F.concat_ws(" ", grid_letters(easting, northing), F.when(grid_letters(easting, northing).isNotNull(), part(easting)), F.when(grid_letters(easting, northing).isNotNull(), part(northing)))


def parse_grid(reference: Column) -> Column:
    """(easting, northing) of the south-west corner of a reference of letters and an even number of digits; null for others."""
    r = F.upper(F.regexp_replace(reference, r"\s+", ""))
    digits = F.regexp_extract(r, r"^[A-HJ-Z]{2}((?:\d\d){1,5})$", 1)
    half = (F.char_length(digits) / 2).cast("int")
    place = lambda i: F.position(F.substr(r, F.lit(i), F.lit(1)), F.lit("ABCDEFGHJKLMNOPQRSTUVWXYZ")) - 1
    x = lambda i: place(i) % 5
    y = lambda i: 4 - F.floor(place(i) / 5)
    metres = lambda s: s.try_cast("double") * F.pow(F.lit(10.0), 5 - half)
    e = ((x(1) - 2) * 5 + x(2)) * 100_000 + metres(F.left(digits, half))
    n = ((y(1) - 1) * 5 + y(2)) * 100_000 + metres(F.right(digits, half))
    return F.when(digits != "", F.struct(e.cast("double").alias("easting"), n.cast("double").alias("northing")))


#: Ellipsoid axes; scale, origin and false origin of the grid; shift, rotation (arc seconds) and scale (millionths) from the datum to WGS 84.
GRIDS = {
    "british": dict(a=6377563.396, b=6356256.909, scale=0.9996012717, lat=49.0, lon=-2.0, east=400000.0, north=-100000.0, shift=(446.448, -125.157, 542.06, 0.1502, 0.247, 0.8421, -20.4894)),
    "irish": dict(a=6377340.189, b=6356034.447938534, scale=1.000035, lat=53.5, lon=-8.0, east=200000.0, north=250000.0, shift=(482.5, -130.6, 564.6, -1.042, -0.214, -0.631, 8.15)),
}
WGS84 = (6378137.0, 6356752.314245179)


def _xyz(lat: Column, lon: Column, a: float, b: float) -> tuple[Column, Column, Column]:
    e2 = 1 - b * b / (a * a)
    v = a / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    return v * F.cos(lat) * F.cos(lon), v * F.cos(lat) * F.sin(lon), v * (1 - e2) * F.sin(lat)


def _lat_lon(x: Column, y: Column, z: Column, a: float, b: float, steps: int = 5) -> tuple[Column, Column]:
    """Radians on an ellipsoid; each step gains some three digits."""
    e2 = 1 - b * b / (a * a)
    p = F.sqrt(x * x + y * y)
    sine = lambda tan: tan / F.sqrt(1 + tan * tan)
    step = lambda sin: (z + e2 * (a / F.sqrt(1 - e2 * sin * sin)) * sin) / p
    tan = F.aggregate(F.array_repeat(F.lit(0), steps), z / (p * (1 - e2)), lambda tan, _: step(sine(tan)))
    return F.atan(tan), F.atan2(y, x)


def _turned(xyz, shift, back: bool):
    """From a datum to WGS 84, or back."""
    dx, dy, dz, *r, s = shift
    rx, ry, rz = (math.radians(x / 3600) for x in r)
    m = 1 + s / 1e6
    if back:
        x, y, z = ((c - d) / m for c, d in zip(xyz, (dx, dy, dz)))
        return x + rz * y - ry * z, y - rz * x + rx * z, z + ry * x - rx * y
    x, y, z = xyz
    return m * (x - rz * y + ry * z) + dx, m * (y + rz * x - rx * z) + dy, m * (z - ry * x + rx * y) + dz


def _meridian(lat: Column, g: dict) -> Column:
    """Scaled length along the meridian from the grid's origin."""
    n, at = (g["a"] - g["b"]) / (g["a"] + g["b"]), math.radians(g["lat"])
    d, s = lat - at, lat + at
    terms = (
        (1 + n + 1.25 * n**2 + 1.25 * n**3) * d - (3 * n + 3 * n**2 + 21 / 8 * n**3) * F.sin(d) * F.cos(s)
        + (15 / 8 * n**2 + 15 / 8 * n**3) * F.sin(2 * d) * F.cos(2 * s) - 35 / 24 * n**3 * F.sin(3 * d) * F.cos(3 * s)
    )
    return g["b"] * g["scale"] * terms


def _radii(lat: Column, g: dict) -> tuple[Column, Column, Column]:
    e2 = 1 - g["b"] ** 2 / g["a"] ** 2
    w = 1 - e2 * F.sin(lat) * F.sin(lat)
    v, r = g["a"] * g["scale"] / F.sqrt(w), g["a"] * g["scale"] * (1 - e2) / (w * F.sqrt(w))
    return v, r, v / r - 1


def projected(lat: Column, lon: Column, g: dict) -> tuple[Column, Column]:
    """Easting and northing of radians on the grid's own ellipsoid, by the transverse Mercator series."""
    v, r, h2 = _radii(lat, g)
    t2, c, d = F.pow(F.tan(lat), 2), F.cos(lat), lon - math.radians(g["lon"])
    north = _meridian(lat, g) + g["north"] + v * F.sin(lat) * c / 2 * d**2 + v * F.sin(lat) * c**3 / 24 * (5 - t2 + 9 * h2) * d**4 + v * F.sin(lat) * c**5 / 720 * (61 - 58 * t2 + t2 * t2) * d**6
    east = g["east"] + v * c * d + v * c**3 / 6 * (v / r - t2) * d**3 + v * c**5 / 120 * (5 - 18 * t2 + t2 * t2 + 14 * h2 - 58 * t2 * h2) * d**5
    return east, north


def unprojected(east: Column, north: Column, g: dict, steps: int = 6) -> tuple[Column, Column]:
    """Radians on the grid's own ellipsoid; the latitude of the foot point by so many steps, each of which gains two digits or more."""
    first = (north - g["north"]) / (g["a"] * g["scale"]) + math.radians(g["lat"])
    foot = F.aggregate(F.array_repeat(F.lit(0), steps), first, lambda f, _: f + (north - g["north"] - _meridian(f, g)) / (g["a"] * g["scale"]))
    both = F.transform(F.array(foot), lambda f: F.array(*_beside(f, east - g["east"], g)))[0]
    return both[0], both[1]


def _beside(foot: Column, d: Column, g: dict) -> tuple[Column, Column]:
    """Radians of a point d metres east of the grid's meridian, by the latitude of its foot point."""
    v, r, h2 = _radii(foot, g)
    t, sec = F.tan(foot), 1 / F.cos(foot)
    t2 = t * t
    lat = foot - t / (2 * r * v) * d**2 + t / (24 * r * v**3) * (5 + 3 * t2 + h2 - 9 * t2 * h2) * d**4 - t / (720 * r * v**5) * (61 + 90 * t2 + 45 * t2 * t2) * d**6
    lon = math.radians(g["lon"]) + sec / v * d - sec / (6 * v**3) * (v / r + 2 * t2) * d**3 + sec / (120 * v**5) * (5 + 28 * t2 + 24 * t2 * t2) * d**5
    return lat, lon - sec / (5040 * v**7) * (61 + 662 * t2 + 1320 * t2 * t2 + 720 * t2**3) * d**7


def to_grid(rows: DataFrame, lat: str, lon: str, grid: str) -> DataFrame:
    """rows with east and north, in metres, of degrees on WGS 84."""
    g = GRIDS[grid]
    x = rows.withColumn("xyz_", F.array(*_turned(_xyz(F.radians(lat), F.radians(lon), *WGS84), g["shift"], back=True)))
    own = _lat_lon(*(F.get("xyz_", F.lit(i)) for i in range(3)), g["a"], g["b"])
    x = x.withColumn("own_", F.array(*own))
    east, north = projected(F.get("own_", F.lit(0)), F.get("own_", F.lit(1)), g)
    return x.withColumn("east", east).withColumn("north", north).drop("xyz_", "own_")


def from_grid(rows: DataFrame, east: str, north: str, grid: str) -> DataFrame:
    """rows with lat and lon, degrees on WGS 84, of metres on a grid."""
    g = GRIDS[grid]
    foot = rows.withColumn("own_", F.array(*unprojected(F.col(east), F.col(north), g)))
    xyz = _turned(_xyz(F.get("own_", F.lit(0)), F.get("own_", F.lit(1)), g["a"], g["b"]), g["shift"], back=False)
    x = foot.withColumn("xyz_", F.array(*xyz))
    lat, lon = _lat_lon(*(F.get("xyz_", F.lit(i)) for i in range(3)), *WGS84)
    return x.withColumn("lat", F.degrees(lat)).withColumn("lon", F.degrees(lon)).drop("own_", "xyz_")


def irish_letter(east: Column, north: Column) -> Column:
    """The letter of a 100 km square of the Irish grid; null outside it."""
    i = (4 - F.floor(north / 100_000)) * 5 + F.floor(east / 100_000)
    inside = (east >= 0) & (east < 500_000) & (north >= 0) & (north < 500_000)
    return F.when(inside, F.get(F.split(F.lit("A,B,C,D,E,F,G,H,J,K,L,M,N,O,P,Q,R,S,T,U,V,W,X,Y,Z"), ","), i.cast("int")))


def parsed_ref(ref: Column) -> Column:
    """(grid, east, north): the middle of the square that a reference names, "SU 3728 1551", "J338740"; null if it is none. Three figures or more each."""
    t = F.regexp_replace(F.upper(F.trim(ref)), r"\s+", " ")
    letters = F.regexp_extract(t, r"^([A-HJ-Z]{1,2}) ?[0-9 ]+$", 1)
    groups = F.filter(F.split(F.regexp_extract(t, r"^[A-HJ-Z]{1,2} ?([0-9 ]+)$", 1), " "), lambda x: x != "")
    run = F.when(F.size(groups) == 1, groups[0]).when((F.size(groups) == 2) & (F.char_length(F.get(groups, F.lit(0))) == F.char_length(F.get(groups, F.lit(1)))), F.array_join(groups, ""))
    k = (F.char_length(run) / 2).cast("int")
    fits = (letters != "") & (F.char_length(run) % 2 == 0) & k.between(3, 5)
    size = F.pow(F.lit(10.0), 5 - k)
    part = lambda from_: F.substr(run, from_, k).try_cast("double") * size + size / 2
    at = lambda i: F.instr(F.lit("ABCDEFGHJKLMNOPQRSTUVWXYZ"), F.substr(letters, F.lit(i), F.lit(1))) - 1
    british = F.char_length(letters) == 2
    e100 = F.when(british, F.pmod(at(1) - 2, F.lit(5)) * 5 + at(2) % 5).otherwise(at(1) % 5)
    n100 = F.when(british, 19 - F.floor(at(1) / 5) * 5 - F.floor(at(2) / 5)).otherwise(4 - F.floor(at(1) / 5))
    known = fits & F.when(british, e100.between(0, 6) & n100.between(0, 12)).otherwise(True)
    told = F.struct(F.when(british, "british").otherwise("irish").alias("grid"), (e100 * 100_000 + part(F.lit(1))).alias("east"), (n100 * 100_000 + part(k + 1)).alias("north"))
    return F.when(known, told)
