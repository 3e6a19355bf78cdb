"""Reprojection between EPSG frames as closed formulas, the same for Columns and NumPy arrays, x (east) before y (north).

Frames: 4326 and 4269 in degrees, 3857, UTM zones (326zz, 327zz, 269zz) and Texas state plane zones. NAD83 and WGS 84 are
taken as equal, which moves a point by no more than two metres. Transverse Mercator is Krüger's series to the fourth
order in n, below a micrometre inside a zone; Lambert's conformal conic has two standard parallels. Formulas are those of
IOGP's guidance note 373-7-2."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..errors import require
from ..layers import frame_of, in_frame
from . import wkb

#: Semi-axis and inverse flattening of the ellipsoids, metres of a US survey foot.
WGS84, GRS80, FOOT = (6378137.0, 298.257223563), (6378137.0, 298.257222101), 1200 / 3937
#: Fixed values of Texas state plane zones on NAD83 in US survey feet: name, two parallels, origin (degrees), false easting
#: and northing (metres).
STATE_PLANE = {
    2276: ("NAD83 / Texas North Central (ftUS)", 33 + 58 / 60, 32 + 8 / 60, 31 + 40 / 60, -98.5, 600_000.0, 2_000_000.0),
    2277: ("NAD83 / Texas Central (ftUS)", 31 + 53 / 60, 30 + 7 / 60, 29 + 40 / 60, -(100 + 20 / 60), 700_000.0, 3_000_000.0),
    2278: ("NAD83 / Texas South Central (ftUS)", 30 + 17 / 60, 28 + 23 / 60, 27 + 50 / 60, -99.0, 600_000.0, 4_000_000.0),
}
GEOGRAPHIC = {4326: ("WGS 84", WGS84), 4269: ("NAD83", GRS80)}
#: Steps of the fixed point from isometric to geographic latitude; each gains more than two digits.
LATITUDE_STEPS = 7


def _names(of) -> dict:
    pick = lambda *names: next(getattr(of, n) for n in names if hasattr(of, n))
    one = {n: pick(n) for n in ("sin", "cos", "tan", "sinh", "cosh", "tanh", "exp", "log", "sqrt")}
    return one | {n: pick(n, "arc" + n[1:]) for n in ("asin", "atan", "atan2", "asinh", "atanh")}


class _Maths:
    def __init__(self, of):
        for name, f in _names(of).items():
            setattr(self, name, f)


COLUMNS, ARRAYS = _Maths(F), _Maths(np)


@dataclass(frozen=True)
class Mercator:
    a: float = WGS84[0]

    def forward(self, lon, lat, m):
        return lon * self.a, m.asinh(m.tan(lat)) * self.a

    def inverse(self, x, y, m):
        return x / self.a, m.atan(m.sinh(y / self.a))


def _isometric(lat, e: float, m):
    return m.asinh(m.tan(lat)) - e * m.atanh(e * m.sin(lat))


def _latitude(psi, e: float, m):
    s = m.tanh(psi)
    for _ in range(LATITUDE_STEPS):
        s = m.tanh(psi + e * m.atanh(e * s))
    return m.asin(s)


def _eccentricity(inverse_flattening: float) -> float:
    f = 1 / inverse_flattening
    return math.sqrt(f * (2 - f))


@dataclass(frozen=True)
class TransverseMercator:
    a: float
    rf: float
    lon0: float
    lat0: float = 0.0
    k0: float = 0.9996
    fe: float = 500_000.0
    fn: float = 0.0

    def _series(self) -> tuple:
        n = 1 / (2 * self.rf - 1)
        up = (
            n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
            61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280,
        )
        down = (
            n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
            17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280,
        )
        return up, down, self.k0 * self.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    def _origin(self) -> float:
        """The meridian arc from the equator to the origin's latitude."""
        if self.lat0 == 0:
            return 0.0
        up, _, scale = self._series()
        chi = math.atan(math.sinh(_isometric(np.float64(math.radians(self.lat0)), _eccentricity(self.rf), ARRAYS)))
        return scale * (chi + sum(c * math.sin(2 * j * chi) for j, c in enumerate(up, 1)))

    def forward(self, lon, lat, m):
        up, _, scale = self._series()
        t, off = m.sinh(_isometric(lat, _eccentricity(self.rf), m)), lon - math.radians(self.lon0)
        xi, eta = m.atan2(t, m.cos(off)), m.asinh(m.sin(off) / m.sqrt(t * t + m.cos(off) * m.cos(off)))
        north, east = xi, eta
        for j, c in enumerate(up, 1):
            north = north + c * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
            east = east + c * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
        return east * scale + self.fe, north * scale + (self.fn - self._origin())

    def inverse(self, x, y, m):
        _, down, scale = self._series()
        xi0, eta0 = (y - (self.fn - self._origin())) / scale, (x - self.fe) / scale
        xi, eta = xi0, eta0
        for j, c in enumerate(down, 1):
            xi = xi - c * m.sin(2 * j * xi0) * m.cosh(2 * j * eta0)
            eta = eta - c * m.cos(2 * j * xi0) * m.sinh(2 * j * eta0)
        psi = m.asinh(m.sin(xi) / m.sqrt(m.sinh(eta) * m.sinh(eta) + m.cos(xi) * m.cos(xi)))
        return m.atan2(m.sinh(eta), m.cos(xi)) + math.radians(self.lon0), _latitude(psi, _eccentricity(self.rf), m)


@dataclass(frozen=True)
class LambertConic:
    a: float
    rf: float
    lat1: float
    lat2: float
    lat0: float
    lon0: float
    fe: float
    fn: float

    def _cone(self) -> tuple[float, float, float]:
        """(n, a F, radius at the origin)."""
        e = _eccentricity(self.rf)
        at = lambda d: float(_isometric(np.float64(math.radians(d)), e, ARRAYS))
        width = lambda d: math.log(math.cos(math.radians(d)) / math.sqrt(1 - (e * math.sin(math.radians(d))) ** 2))
        n = (width(self.lat1) - width(self.lat2)) / (at(self.lat2) - at(self.lat1))
        size = self.a * math.exp(width(self.lat1) + n * at(self.lat1)) / n
        return n, size, size * math.exp(-n * at(self.lat0))

    def forward(self, lon, lat, m):
        n, size, r0 = self._cone()
        r, turn = m.exp(_isometric(lat, _eccentricity(self.rf), m) * -n) * size, (lon - math.radians(self.lon0)) * n
        return r * m.sin(turn) + self.fe, r * m.cos(turn) * -1 + (self.fn + r0)

    def inverse(self, x, y, m):
        n, size, r0 = self._cone()
        east, south = x - self.fe, y * -1 + (self.fn + r0)
        psi = m.log(m.sqrt(east * east + south * south) / size) / -n
        return m.atan2(east, south) / n + math.radians(self.lon0), _latitude(psi, _eccentricity(self.rf), m)


def _zone(srid: int) -> int | None:
    """The zone of a UTM frame."""
    zone = srid % 100
    return zone if (srid // 100 in (326, 327) and 1 <= zone <= 60) or (srid // 100 == 269 and 1 <= zone <= 23) else None


def projection(srid: int) -> tuple[object, float]:
    """(projection, metres of its unit) of a projected frame; None for degrees."""
    if srid in GEOGRAPHIC:
        return None, 1.0
    if srid == 3857:
        return Mercator(), 1.0
    if srid in STATE_PLANE:
        _, one, two, lat0, lon0, fe, fn = STATE_PLANE[srid]
        return LambertConic(*GRS80, one, two, lat0, lon0, fe, fn), FOOT
    zone = _zone(srid)
    require(zone is not None, f"EPSG:{srid} is not a known frame; known are 4326, 4269, 3857, UTM zones and {', '.join(map(str, STATE_PLANE))}")
    return TransverseMercator(*(GRS80 if srid // 100 == 269 else WGS84), 6.0 * zone - 183, fn=1e7 if srid // 100 == 327 else 0.0), 1.0


def _convert(x, y, src: int, dst: int, m):
    (source, unit), (target, out) = projection(src), projection(dst)
    if src == dst:
        return x, y
    lon, lat = (x * (math.pi / 180), y * (math.pi / 180)) if source is None else source.inverse(x * unit, y * unit, m)
    if target is None:
        return lon * (180 / math.pi), lat * (180 / math.pi)
    east, north = target.forward(lon, lat, m)
    return (east, north) if out == 1.0 else (east / out, north / out)


def transform_points(x, y, src: int, dst: int):
    """x and y in another frame: Columns give Columns, arrays arrays. The same frame gives what came in, untouched."""
    return _convert(x, y, src, dst, ARRAYS if isinstance(x, np.ndarray | float) else COLUMNS)


def reproject(points: DataFrame, dst: int, src: int | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """A layer of points in another frame; its own is read from the layer unless src is given. Null coordinates stay null."""
    src = src or frame_of(points)
    require(src is not None, "the layer's frame is unknown; give src")
    to = transform_points(F.col(x).cast("double"), F.col(y).cast("double"), src, dst)
    return in_frame(points.withColumns({x: to[0], y: to[1]}), dst)


def _moved(kind: str, coords, src: int, dst: int):
    if kind == "Point":
        return tuple(float(v[0]) for v in _convert(np.array([coords[0]]), np.array([coords[1]]), src, dst, ARRAYS))
    if kind == "LineString":
        a = np.asarray(coords, float)
        return np.stack(_convert(a[:, 0], a[:, 1], src, dst, ARRAYS), axis=1)
    inner = "LineString" if kind == "Polygon" else kind.removeprefix("Multi")
    return [_moved(inner, c, src, dst) for c in coords]


def transform_geometries(layer: DataFrame, dst: int, src: int | None = None, geometry: str = "geometry") -> DataFrame:
    """A layer of WKB geometries in another frame, vertex for vertex; null geometries stay null."""
    src = src or frame_of(layer)
    require(src is not None, "the layer's frame is unknown; give src")
    projection(src), projection(dst)
    if src == dst:
        return in_frame(layer, dst)

    @pandas_udf("binary")
    def move(g):
        return g.map(lambda b: None if b is None else wkb.encode(*((k := wkb.decode(b))[0], _moved(*k, src, dst))))

    return in_frame(layer.withColumn(geometry, move(F.col(geometry))), dst)


def transform_bbox(bbox: tuple, src: int, dst: int, densify: int = 21) -> tuple:
    """(west, south, east, north) that covers a box in another frame: its edges at densify points each, and for a conic or
    transverse frame a grid of as many inside, as extremes need not lie on an edge's ends."""
    if src == dst:
        return tuple(bbox)
    gx, gy = np.meshgrid(np.linspace(bbox[0], bbox[2], densify), np.linspace(bbox[1], bbox[3], densify))
    x, y = _convert(gx.ravel(), gy.ravel(), src, dst, ARRAYS)
    require(bool(np.isfinite(x).all() and np.isfinite(y).all()), f"the box {tuple(bbox)} of EPSG:{src} has no finite bound in EPSG:{dst}")
    # what lies between two samples reaches beyond them by less than an eighth of their second difference
    x, y = x.reshape(densify, densify), y.reshape(densify, densify)
    slack = lambda v: max(float(np.abs(np.diff(v, 2, axis=i)).max()) for i in (0, 1)) / 4
    return float(x.min() - slack(x)), float(y.min() - slack(y)), float(x.max() + slack(x)), float(y.max() + slack(y))


def is_geographic(srid: int) -> bool:
    return srid in GEOGRAPHIC


def axis_units(srid: int) -> str:
    """m or usft, of a projected frame."""
    require(not is_geographic(srid), f"EPSG:{srid} is geographic, its axes are degrees; choose a projected frame such as a State Plane or UTM zone")
    return "usft" if projection(srid)[1] == FOOT else "m"


def crs_definition(srid: int) -> str:
    """The frame as WKT, version 1."""
    plane = projection(srid)[0]
    base = srid if plane is None else 4269 if srid in STATE_PLANE or srid // 100 == 269 else 4326
    name, (a, rf) = GEOGRAPHIC[base]
    geographic = f'GEOGCS["{name}",DATUM["{"North_American_Datum_1983" if base == 4269 else "WGS_1984"}",SPHEROID["{"GRS 1980" if base == 4269 else "WGS 84"}",{a:.0f},{rf}]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433],AUTHORITY["EPSG","{base}"]]'
    if plane is None:
        return geographic
    if isinstance(plane, LambertConic):
        title, kind = STATE_PLANE[srid][0], "Lambert_Conformal_Conic_2SP"
        values = {"latitude_of_origin": plane.lat0, "central_meridian": plane.lon0, "standard_parallel_1": plane.lat1, "standard_parallel_2": plane.lat2, "false_easting": plane.fe / FOOT, "false_northing": plane.fn / FOOT}
    elif isinstance(plane, TransverseMercator):
        title, kind = f"{name} / UTM zone {_zone(srid)}{'S' if plane.fn else 'N'}", "Transverse_Mercator"
        values = {"latitude_of_origin": plane.lat0, "central_meridian": plane.lon0, "scale_factor": plane.k0, "false_easting": plane.fe, "false_northing": plane.fn}
    else:
        title, kind, values = "WGS 84 / Pseudo-Mercator", "Mercator_1SP", {"central_meridian": 0, "scale_factor": 1, "false_easting": 0, "false_northing": 0}
    unit = f'UNIT["US survey foot",{FOOT!r}]' if axis_units(srid) == "usft" else 'UNIT["metre",1]'
    return f'PROJCS["{title}",{geographic},PROJECTION["{kind}"],{",".join(f"PARAMETER[\"{k}\",{v:.15g}]" for k, v in values.items())},{unit},AUTHORITY["EPSG","{srid}"]]'


def epsg_from_user_input(description: str) -> int | None:
    """The known frame that a code, an EPSG: name, a title or a WKT means; None where that isn't clear."""
    text = description.strip()
    m = re.fullmatch(r"(?:EPSG:+)?(\d+)", text, re.IGNORECASE) or re.search(r'(?:AUTHORITY\["EPSG",\s*"?|ID\["EPSG",\s*)(\d+)"?\]\s*\]\s*$', text)
    if m:
        try:
            projection(int(m[1]))
        except ValueError:
            return None
        return int(m[1])
    title = re.match(r'(?:PROJC(?:S|RS)|GEOGC(?:S|RS))\["([^"]+)"', text)
    wanted = (title[1] if title else text).casefold()
    known = {n.casefold(): s for s, (n, *_) in (STATE_PLANE | GEOGRAPHIC).items()} | {"wgs 84 / pseudo-mercator": 3857}
    zone = re.fullmatch(r"(wgs 84|nad83) / utm zone (\d+)([ns])", wanted)
    if zone:
        known[wanted] = (26900 if zone[1] == "nad83" else 32600 if zone[3] == "n" else 32700) + int(zone[2])
    found = known.get(wanted)
    return found if found in GEOGRAPHIC or found in STATE_PLANE or found == 3857 or (found and _zone(found)) else None
