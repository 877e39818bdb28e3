"""Sky positions, projections and pixel numbers as column expressions; degrees unless stated."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .photometry import clip

# The rotation from ICRS to Galactic axes (J2000), the mean obliquity, and two sky cones (l, b, radius).
ICRS_TO_GALACTIC = (
    (-0.0548755604162154, -0.8734370902348850, -0.4838350155487132),
    (0.4941094278755837, -0.4448296299600112, 0.7469822444972189),
    (-0.8676661490190047, -0.1980763734312015, 0.4559837761750669),
)
OBLIQUITY = 23.439291111
MAGELLANIC = ((280.4652, -32.8884, 12.0), (302.8084, -44.3277, 8.0))


def valid_position(l: Column, b: Column) -> Column:
    return l.isNotNull() & b.isNotNull() & (b >= -90.0) & (b <= 90.0)


def centred(l: Column) -> Column:
    """Longitude in (-180, 180], 180 kept, not yet negated."""
    return F.when(l > 180.0, l - 360.0).otherwise(l)


def offset_longitude(l: Column, centre: float) -> Column:
    """Longitude relative to a centre, in [-180, 180)."""
    return F.pmod(l - centre + 180.0, F.lit(360.0)) - 180.0


def _bin(c: Column, count: int) -> Column:
    return F.least(F.greatest(F.floor(c), F.lit(0)), F.lit(count - 1)).cast("long")


def allsky_cell(l: Column, b: Column, width: int, height: int) -> tuple[Column, Column]:
    """(x, y) on the all-sky grid: longitude grows to the left, y with latitude. Null outside the sphere."""
    ok = valid_position(l, b)
    x = _bin((-centred(l) + 180.0) * (width / 360.0), width)
    y = _bin((b + 90.0) * (height / 180.0), height)
    return F.when(ok, x), F.when(ok, y)


@dataclass(frozen=True)
class Region:
    """A rectangle on the sky; y grows downwards and longitude to the left."""

    l_centre: float = 3.23
    b_centre: float = 0.59
    width: float = 112.70
    height: float = 56.38

    def __post_init__(self):
        if not (0 < self.width <= 360 and 0 < self.height <= 180 and -90 <= self.b_low and self.b_high <= 90):
            raise ValueError("region outside the sphere")

    @property
    def b_low(self) -> float:
        return self.b_centre - self.height / 2

    @property
    def b_high(self) -> float:
        return self.b_centre + self.height / 2

    def inside(self, l: Column, b: Column) -> Column:
        """The latitude bounds are plain comparisons, so that a scan can skip row groups."""
        return (b >= self.b_low) & (b <= self.b_high) & (F.abs(offset_longitude(l, self.l_centre)) <= self.width / 2)

    def pixel(self, l: Column, b: Column, width: int, height: int) -> tuple[Column, Column]:
        x = (self.width / 2 - offset_longitude(l, self.l_centre)) * (width / self.width)
        return x, (self.b_high - b) * (height / self.height)

    def cell(self, l: Column, b: Column, width: int, height: int) -> tuple[Column, Column]:
        x, y = self.pixel(l, b, width, height)
        return _bin(x, width), _bin(y, height)


def hammer_xy(l: Column, b: Column) -> tuple[Column, Column]:
    """The Hammer projection in units of the image, each in [0, 1]; y grows downwards."""
    lon, lat = -F.radians(offset_longitude(l, 0.0)), F.radians(b)
    depth = F.sqrt(F.greatest(1.0 + F.cos(lat) * F.cos(lon * 0.5), F.lit(2.2250738585072014e-308)))
    return (F.cos(lat) * F.sin(lon * 0.5) / depth + 1.0) * 0.5, (1.0 - F.sin(lat) / depth) * 0.5


def hammer_cell(l: Column, b: Column, width: int, height: int) -> tuple[Column, Column]:
    """Integer Hammer pixel; the edge of the ellipse falls into the nearest one. Null outside the sphere."""
    x, y = hammer_xy(l, b)
    ok = valid_position(l, b)
    return F.when(ok, _bin(x * width, width)), F.when(ok, _bin(y * height, height))


def hammer_inverse(px: Column, py: Column, width: int, height: int) -> tuple[Column, Column, Column]:
    """(l, b, valid) at the centre of a Hammer pixel; only pixels inside the ellipse are valid."""
    x = ((px + 0.5) / width * 2.0 - 1.0) * (2.0 * math.sqrt(2.0))
    y = (1.0 - (py + 0.5) / height * 2.0) * math.sqrt(2.0)
    z2 = 1.0 - x * x / 16.0 - y * y / 4.0
    z = F.sqrt(F.greatest(z2, F.lit(0.0)))
    lon = 2.0 * F.atan2(z * x, 2.0 * (2.0 * z * z - 1.0))
    lat = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z * y)))
    return F.pmod(-F.degrees(lon), F.lit(360.0)), F.degrees(lat), z2 >= 0.5


def distance_cosine(l: Column, b: Column, l0: float, b0: float) -> Column:
    """Cosine of the angle to a fixed position."""
    lat, lat0 = F.radians(b), math.radians(b0)
    return F.sin(lat) * math.sin(lat0) + F.cos(lat) * math.cos(lat0) * F.cos(F.radians(l) - math.radians(l0))


def in_cones(l: Column, b: Column, cones: Sequence[tuple[float, float, float]] = MAGELLANIC) -> Column:
    out = F.lit(False)
    for l0, b0, radius in cones:
        out = out | (distance_cosine(l, b, l0, b0) >= math.cos(math.radians(radius)))
    return F.coalesce(out, F.lit(False))


def magellanic_member(l: Column, b: Column, parallax: Column | None = None, most: float = 0.020) -> Column:
    """Inside a cone, or with a parallax (mas) between 0 and `most`."""
    inside = in_cones(l, b)
    return inside if parallax is None else inside | F.coalesce((parallax >= 0.0) & (parallax <= most), F.lit(False))


def sky_zone(l: Column, b: Column) -> Column:
    """centre, disk, mid or halo."""
    return F.when((F.abs(b) <= 12.0) & (F.abs(offset_longitude(l, 0.0)) <= 25.0), "centre").when(F.abs(b) <= 15.0, "disk").when(F.abs(b) <= 45.0, "mid").otherwise("halo")


def observability(dec: Column, latitude: float = 52.0, margin: float = 10.0) -> Column:
    """never, low or good: whether a declination rises above the horizon of a place."""
    limit = latitude - 90.0
    return F.when(dec < limit, "never").when(dec < limit + margin, "low").when(dec.isNotNull(), "good")


def _rotate(lon: Column, lat: Column, matrix) -> tuple[Column, Column]:
    a, d = F.radians(lon), F.radians(lat)
    v = (F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d))
    x, y, z = (sum((v[j] * row[j] for j in (1, 2)), v[0] * row[0]) for row in matrix)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0)), F.degrees(F.asin(clip(z, -1.0, 1.0)))


def icrs_to_galactic(ra: Column, dec: Column) -> tuple[Column, Column]:
    return _rotate(ra, dec, ICRS_TO_GALACTIC)


def galactic_to_icrs(l: Column, b: Column) -> tuple[Column, Column]:
    return _rotate(l, b, tuple(zip(*ICRS_TO_GALACTIC)))


def ecliptic_to_icrs(lon: Column, lat: Column) -> tuple[Column, Column]:
    c, s = math.cos(math.radians(OBLIQUITY)), math.sin(math.radians(OBLIQUITY))
    return _rotate(lon, lat, ((1.0, 0.0, 0.0), (0.0, c, -s), (0.0, s, c)))


def icrs_to_ecliptic(ra: Column, dec: Column) -> tuple[Column, Column]:
    c, s = math.cos(math.radians(OBLIQUITY)), math.sin(math.radians(OBLIQUITY))
    return _rotate(ra, dec, ((1.0, 0.0, 0.0), (0.0, c, s), (0.0, -s, c)))


# Names of coordinate frames.
FRAMES = {"g": "galactic", "gal": "galactic", "galactic": "galactic", "c": "icrs", "celestial": "icrs", "equatorial": "icrs", "j2000": "icrs", "icrs": "icrs", "fk5": "fk5", "e": "ecliptic", "ecliptic": "ecliptic", "geocentrictrueecliptic": "ecliptic"}


def frame_name(name: str | None) -> str:
    """The frame that a name stands for; galactic without one."""
    value = (name or "galactic").strip().lower()
    return FRAMES.get(value, value)


def guess_frame(header: dict[str, str] | None = None, columns: Sequence[str] = (), fallback: str = "galactic") -> str:
    """The frame of a file, by its header's COORDSYS, COORDTYPE or CTYPE, or by its columns' names."""
    header = header or {}
    if code := str(header.get("COORDSYS") or header.get("COORDTYPE") or "").strip():
        return frame_name(code)
    axes = " ".join(str(header.get(k, "")).upper() for k in ("CTYPE1", "CTYPE2"))
    names = {c.lower() for c in columns}
    if "GLON" in axes or "GLAT" in axes or names & {"l", "glon", "galactic_longitude"}:
        return "galactic"
    if "RA" in axes or "DEC" in axes or names & {"ra", "ra_deg", "raj2000", "dec", "dec_deg"}:
        return "icrs"
    if "ELON" in axes or "ELAT" in axes or names & {"elon", "elat", "ecl_lon"}:
        return "ecliptic"
    return frame_name(fallback)


def to_galactic(lon: Column, lat: Column, frame: str) -> tuple[Column, Column]:
    """Galactic coordinates of positions in a named frame; FK5 counts as ICRS."""
    kind = frame_name(frame)
    if kind == "galactic":
        return lon, lat
    if kind in ("icrs", "fk5"):
        return icrs_to_galactic(lon, lat)
    if kind == "ecliptic":
        return icrs_to_galactic(*ecliptic_to_icrs(lon, lat))
    raise ValueError(f"unknown frame: {frame}")


def _quarters(l: Column) -> Column:
    return F.pmod(F.radians(l), F.lit(2.0 * math.pi)) / (0.5 * math.pi)


def sphere(l: Column, b: Column) -> tuple[Column, Column]:
    """Longitude in quarter turns and sine of latitude, from which HEALPix pixels follow."""
    return _quarters(l), F.sin(F.radians(b))


def _div(a: Column, n: int) -> Column:
    return F.floor(a / n)


def healpix_ring(nside: int, l: Column, b: Column) -> Column:
    """HEALPix pixel in RING order."""
    if nside < 1:
        raise ValueError("nside must be positive")
    t, z = _quarters(l), F.sin(F.radians(b))
    cap, total = 2 * nside * (nside - 1), 12 * nside * nside
    up = F.floor(nside * (t + 0.5) - nside * z * 0.75)
    down = F.floor(nside * (t + 0.5) + nside * z * 0.75)
    ring = nside + 1 + up - down
    place = F.pmod(F.floor((up + down - nside + (F.lit(1) - F.pmod(ring, F.lit(2))) + 1) / 2), F.lit(4 * nside))
    belt = cap + (ring - 1) * (4 * nside) + place
    part = t - F.floor(t)
    radius = nside * F.sqrt(3.0 * (1.0 - F.abs(z)))
    cap_ring = F.floor(part * radius) + F.floor((1.0 - part) * radius) + 1
    cap_place = F.pmod(F.floor(t * cap_ring), 4 * cap_ring)
    pole = F.when(z >= 0, 2 * cap_ring * (cap_ring - 1) + cap_place).otherwise(total - 2 * cap_ring * (cap_ring + 1) + cap_place)
    return F.when(F.abs(z) <= 2.0 / 3.0, belt).otherwise(pole).cast("long")


def _spread(c: Column) -> Column:
    """The bits of a number that isn't negative, each followed by a zero: its binary digits, read to the base of four.

    The argument stands there once, so a long one is evaluated once.
    """
    return F.conv(F.bin(c), 4, 10).cast("long")


def nested_place(nside: int, t: Column, z: Column) -> tuple[Column, Column, Column]:
    """(face, x, y) of the NESTED pixel at a longitude in quarter turns and a sine of latitude."""
    if nside < 1 or nside & (nside - 1):
        raise ValueError("nside must be a power of two")
    up = F.floor(nside * (t + 0.5) - nside * z * 0.75).cast("long")
    down = F.floor(nside * (t + 0.5) + nside * z * 0.75).cast("long")
    face_up, face_down = _div(up, nside), _div(down, nside)
    belt_face = F.when(face_up == face_down, F.pmod(face_up, F.lit(4)) + 4).when(face_up < face_down, face_up).otherwise(face_down + 8)
    quarter = F.least(F.floor(t), F.lit(3))
    radius = nside * F.sqrt(3.0 * (1.0 - F.abs(z)))
    a = F.least(F.floor((t - quarter) * radius), F.lit(nside - 1)).cast("long")
    d = F.least(F.floor((1.0 - (t - quarter)) * radius), F.lit(nside - 1)).cast("long")
    belt, north = F.abs(z) <= 2.0 / 3.0, z >= 0
    face = F.when(belt, belt_face).when(north, quarter).otherwise(quarter + 8).cast("long")
    x = F.when(belt, F.pmod(down, F.lit(nside))).when(north, nside - 1 - d).otherwise(a).cast("long")
    y = F.when(belt, nside - 1 - F.pmod(up, F.lit(nside))).when(north, nside - 1 - a).otherwise(d).cast("long")
    return face, x, y


def nested_pixel(nside: int, face: Column, x: Column, y: Column) -> Column:
    """The NESTED pixel at a place (x, y) on a face."""
    return (face * (nside * nside) + _spread(x) + 2 * _spread(y)).cast("long")


def healpix_nested(nside: int, l: Column, b: Column) -> Column:
    """HEALPix pixel in NESTED order; nside is a power of two."""
    return nested_pixel(nside, *nested_place(nside, *sphere(l, b)))


def sexagesimal(text: Column) -> Column:
    """Degrees (or hours) from one to three fields separated by blanks or colons; the sign covers all of them."""
    parts = F.split(F.regexp_replace(F.trim(text), "^[+-]", ""), "[:\\s]+")
    field = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("double")
    known = (F.size(parts) <= 3) & field(1).isNotNull() & (F.size(parts) == F.size(F.filter(parts, lambda p: p.try_cast("double").isNotNull())))
    value = field(1) + F.coalesce(field(2), F.lit(0.0)) / 60.0 + F.coalesce(field(3), F.lit(0.0)) / 3600.0
    return F.when(known, F.when(F.trim(text).startswith("-"), -value).otherwise(value))
