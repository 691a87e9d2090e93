"""Planar spatial functions on WKT texts.

Geometry is parsed in Arrow batches; an unreadable text gives NULL. ``SRID=n;`` may stand before it.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import scalar, vectorized

KINDS = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "boolean": T.BooleanType()}
_NAMES = {n.upper(): n for n in ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")}
_TOKEN = re.compile(r"\s*([A-Za-z]+|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[(),])")


class Geometry:
    """kind; parts: a point (x, y), a list of points, of rings, or of geometries; srid."""

    def __init__(self, kind: str, parts, srid: int = 0):
        self.kind, self.parts, self.srid = kind, parts, srid

    @property
    def members(self) -> list[Geometry]:
        return [m for p in self.parts or [] for m in p.members] if self.kind.startswith(("Multi", "Geom")) else [self]

    @property
    def empty(self) -> bool:
        return not self.parts or self.kind.startswith(("Multi", "Geom")) and all(m.empty for m in self.members)

    @property
    def points(self) -> list[tuple]:
        if self.kind == "Point":
            return [self.parts] if self.parts else []
        if self.kind == "LineString":
            return list(self.parts or [])
        if self.kind == "Polygon":
            return [p for ring in self.parts or [] for p in ring]
        return [p for m in self.members for p in m.points]

    @property
    def paths(self) -> list[list]:
        """Lines and rings."""
        return [path for m in self.members for path in ([m.parts] if m.kind == "LineString" else m.parts if m.kind == "Polygon" else []) if path]

    @property
    def edges(self) -> list[tuple]:
        return [e for path in self.paths for e in zip(path, path[1:])]

    @property
    def polygons(self) -> list[list]:
        return [m.parts for m in self.members if m.kind == "Polygon" and m.parts]


def parse(text: str) -> Geometry:
    srid = 0
    if m := re.match(r"\s*SRID\s*=\s*(\d+)\s*;", text, re.I):
        srid, text = int(m[1]), text[m.end() :]
    tokens, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(text)
        tokens.append(m[1])
        at = m.end()
    tokens.reverse()

    def expect(t):
        if not tokens or tokens.pop() != t:
            raise ValueError(text)

    def listed(item):
        expect("(")
        out = [item()]
        while tokens and tokens[-1] == ",":
            tokens.pop()
            out.append(item())
        expect(")")
        return out

    def pair():
        return (float(tokens.pop()), float(tokens.pop()))

    def loose():
        if tokens[-1] == "(":
            expect("(")
            p = pair()
            expect(")")
            return Geometry("Point", p)
        return Geometry("Point", pair())

    def geometry():
        kind = _NAMES[tokens.pop().upper()]
        if tokens and tokens[-1].upper() == "EMPTY":
            tokens.pop()
            return Geometry(kind, None if kind == "Point" else [])
        if kind == "Point":
            expect("(")
            p = pair()
            expect(")")
            return Geometry(kind, p)
        item = {
            "LineString": pair, "Polygon": lambda: listed(pair), "MultiPoint": loose, "MultiLineString": lambda: Geometry("LineString", listed(pair)),
            "MultiPolygon": lambda: Geometry("Polygon", listed(lambda: listed(pair))), "GeometryCollection": geometry,
        }[kind]
        return Geometry(kind, listed(item))

    try:
        g = geometry()
    except (KeyError, IndexError) as e:
        raise ValueError(text) from e
    if tokens:
        raise ValueError(text)
    g.srid = srid
    return g


def _n(v: float) -> str:
    return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)


def wkt(g: Geometry) -> str:
    xy = lambda p: f"{_n(p[0])} {_n(p[1])}"
    ring = lambda r: "(" + ", ".join(map(xy, r)) + ")"

    def inside(g: Geometry) -> str:
        if g.kind == "Point":
            return f"({xy(g.parts)})"
        if g.kind == "LineString":
            return ring(g.parts)
        if g.kind == "Polygon":
            return "(" + ", ".join(map(ring, g.parts)) + ")"
        return "(" + ", ".join(wkt(m) if g.kind == "GeometryCollection" else inside(m) for m in g.parts) + ")"

    return g.kind.upper() + (" EMPTY" if not g.parts else inside(g))


def box(g: Geometry) -> tuple[float, float, float, float]:
    xs, ys = [p[0] for p in g.points], [p[1] for p in g.points]
    return min(xs), min(ys), max(xs), max(ys)


def rectangle(x0, y0, x1, y1) -> Geometry:
    return Geometry("Polygon", [[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]])


def _signed(ring) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


def _length(path) -> float:
    return sum(math.dist(a, b) for a, b in zip(path, path[1:]))


def area(g: Geometry) -> float:
    return sum(abs(_signed(p[0])) - sum(abs(_signed(h)) for h in p[1:]) for p in g.polygons)


def _turn(a, b, c) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _on(p, a, b) -> bool:
    return abs(_turn(a, b, p)) < 1e-12 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def _in_ring(p, ring) -> int:
    """1 inside, 0 on the line, -1 outside."""
    inside = False
    for a, b in zip(ring, ring[1:]):
        if _on(p, a, b):
            return 0
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < a[0] + (p[1] - a[1]) * (b[0] - a[0]) / (b[1] - a[1]):
            inside = not inside
    return 1 if inside else -1


def place(p, g: Geometry) -> int:
    """Of a point as against a geometry: 1 inside, 0 on its line or a point of it, -1 outside."""
    best = -1
    for rings in g.polygons:
        at = _in_ring(p, rings[0])
        for hole in rings[1:] if at == 1 else ():
            at = min(at, -_in_ring(p, hole))
        best = max(best, at)
    if best < 0 and (any(_on(p, a, b) for a, b in g.edges) or any(p == q for m in g.members if m.kind == "Point" for q in m.points)):
        return 0
    return best


def _meet(e, f) -> bool:
    (a, b), (c, d) = e, f
    if any((_on(c, a, b), _on(d, a, b), _on(a, c, d), _on(b, c, d))):
        return True
    return _turn(a, b, c) * _turn(a, b, d) < 0 and _turn(c, d, a) * _turn(c, d, b) < 0


def contains(g: Geometry, h: Geometry) -> bool:
    return bool(h.points) and all(place(p, g) >= 0 for p in h.points)


def _apart(g: Geometry, h: Geometry) -> bool:
    a, b = box(g), box(h)
    return a[2] < b[0] or b[2] < a[0] or a[3] < b[1] or b[3] < a[1]


def intersects(g: Geometry, h: Geometry) -> bool:
    if g.empty or h.empty or _apart(g, h):
        return False
    return any(place(p, h) >= 0 for p in g.points) or any(place(p, g) >= 0 for p in h.points) or any(_meet(e, f) for e in g.edges for f in h.edges)


def dimension(g: Geometry) -> int:
    return max(({"Point": 0, "LineString": 1, "Polygon": 2}[m.kind] for m in g.members), default=0)


def _to_edge(p, a, b) -> float:
    size = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
    t = 0 if not size else max(0.0, min(1.0, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / size))
    return math.dist(p, (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))


def distance(g: Geometry, h: Geometry) -> float:
    if intersects(g, h):
        return 0.0
    one = lambda p, g: min([_to_edge(p, a, b) for a, b in g.edges] + [math.dist(p, q) for q in g.points])
    return min([one(p, h) for p in g.points] + [one(p, g) for p in h.points])


def centroid(g: Geometry) -> Geometry:
    total = x = y = 0.0
    for rings in g.polygons:
        for i, ring in enumerate(rings):
            sign = (1 if i == 0 else -1) * (1 if _signed(ring) >= 0 else -1)
            for a, b in zip(ring, ring[1:]):
                k = sign * (a[0] * b[1] - b[0] * a[1])
                total, x, y = total + k / 2, x + (a[0] + b[0]) * k / 6, y + (a[1] + b[1]) * k / 6
    if total:
        return Geometry("Point", (x / total, y / total))
    points = g.points
    return Geometry("Point", (sum(p[0] for p in points) / len(points), sum(p[1] for p in points) / len(points)) if points else None)


def buffer(g: Geometry, d: float) -> Geometry:
    """32 corners about a point; for other kinds the wider envelope."""
    if d <= 0 or g.empty:
        return g
    if g.kind == "Point":
        x, y = g.parts
        ring = [(x + d * math.cos(2 * math.pi * i / 32), y + d * math.sin(2 * math.pi * i / 32)) for i in range(32)]
        return Geometry("Polygon", [[*ring, ring[0]]])
    x0, y0, x1, y1 = box(g)
    return rectangle(x0 - d, y0 - d, x1 + d, y1 + d)


def valid(g: Geometry) -> bool:
    ok = lambda m: m.kind == "Point" or m.kind == "LineString" and len(m.parts) != 1 or m.kind == "Polygon" and all(len(r) >= 4 and r[0] == r[-1] for r in m.parts)
    return all(ok(m) for m in g.members)


def _udf(names: str, f, result: str, geometries: int = 1):
    dtype = {"string": "object", "double": "float64", "int": "Int32", "boolean": "boolean"}[result]

    @vectorized
    @F.pandas_udf(KINDS[result])
    def g(*columns: pd.Series) -> pd.Series:
        out = []
        for row in zip(*columns):
            try:
                out.append(None if any(v is None for v in row) else f(*(parse(v) if i < geometries else v for i, v in enumerate(row))))
            except ValueError:
                out.append(None)
        return pd.Series(out, dtype=dtype)

    scalar(*names.split())(lambda *a: g(*a))


def _text(f):
    return lambda *a: wkt(f(*a))


scalar("st_point")(lambda x, y: F.concat(F.lit("POINT("), _num(x), F.lit(" "), _num(y), F.lit(")")))


def _num(x: Column) -> Column:
    x = x.cast("double")
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


@scalar("st_makeenvelope")
def st_makeenvelope(x0, y0, x1, y1):
    p = lambda a, b: F.concat(_num(a), F.lit(" "), _num(b))
    return F.concat(F.lit("POLYGON(("), F.concat_ws(", ", p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1), p(x0, y0)), F.lit("))"))


_udf("st_geomfromtext st_astext st_aswkt", _text(lambda g: g), "string")
_udf("st_x", lambda g: g.parts[0] if g.kind == "Point" and g.parts else None, "double")
_udf("st_y", lambda g: g.parts[1] if g.kind == "Point" and g.parts else None, "double")
scalar("st_srid")(lambda g: F.when(g.isNotNull(), F.coalesce(F.nullif(F.regexp_extract(g, r"(?i)^\s*SRID\s*=\s*(\d+)", 1), F.lit("")).cast("int"), F.lit(0))))
_udf("st_geometrytype", lambda g: g.kind, "string")
_udf("st_dimension", dimension, "int")
_udf("st_isempty", lambda g: g.empty, "boolean")
_udf("st_isvalid", valid, "boolean")
_udf("st_numpoints", lambda g: len(g.points), "int")
_udf("st_envelope", lambda g: wkt(rectangle(*box(g))) if g.points else wkt(g), "string")
_udf("st_distance", lambda g, h: distance(g, h) if g.points and h.points else None, "double", 2)
_udf("st_area", area, "double")
_udf("st_length", lambda g: float(sum(_length(m.parts) for m in g.members if m.kind == "LineString" and m.parts)), "double")
_udf("st_perimeter", lambda g: float(sum(_length(r) for rings in g.polygons for r in rings)), "double")
_udf("st_centroid", _text(centroid), "string")
_udf("st_contains", contains, "boolean", 2)
_udf("st_within", lambda g, h: contains(h, g), "boolean", 2)
_udf("st_intersects", intersects, "boolean", 2)
_udf("st_disjoint", lambda g, h: not intersects(g, h), "boolean", 2)
_udf("st_equals", lambda g, h: g.kind == h.kind and g.points == h.points, "boolean", 2)
_udf("st_touches", lambda g, h: intersects(g, h) and not any(place(p, h) == 1 for p in g.points) and not any(place(p, g) == 1 for p in h.points), "boolean", 2)
_udf("st_overlaps", lambda g, h: dimension(g) == dimension(h) and intersects(g, h) and not contains(g, h) and not contains(h, g), "boolean", 2)
_udf("st_crosses", lambda g, h: any(_meet(e, f) for e in g.edges for f in h.edges), "boolean", 2)
_udf("st_buffer", lambda g, d: wkt(buffer(g, d)), "string")
_udf("st_union", lambda g, h: wkt(Geometry("GeometryCollection", [g, h])), "string", 2)
