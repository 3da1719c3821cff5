"""Geometries of areas and features: read from and written to GeoJSON, counted, projected, simplified and tested against boxes and points.

A geometry is a list of parts: (`polygon`, rings), (`line`, [points]) or (`point`, [points]); points are arrays of shape (n, 2), and rings are
closed. Parts of one geometry are a union: every test is true if it is for one of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from . import crs as C

#: Boxes and edges that are tested together.
PAIRS = 2_000_000


def _ring(points) -> np.ndarray:
    a = np.array([p[:2] for p in points], float).reshape(-1, 2)
    return np.vstack([a, a[:1]]) if len(a) and not np.array_equal(a[0], a[-1]) else a


class Geometry:
    def __init__(self, parts: list[tuple[str, list[np.ndarray]]]) -> None:
        self.parts = [(k, [r for r in rings if len(r)]) for k, rings in parts]
        self.parts = [(k, rings) for k, rings in self.parts if rings]

    @staticmethod
    def read(g: dict | None) -> Geometry:
        """From GeoJSON: a geometry, a Feature or a FeatureCollection. Kinds that GeoJSON doesn't know are empty."""
        g = g or {}
        kind, c = g.get("type"), g.get("coordinates") or []
        if kind == "FeatureCollection":
            return union(Geometry.read(f) for f in g.get("features") or [])
        if kind == "Feature":
            return Geometry.read(g.get("geometry"))
        if kind == "GeometryCollection":
            return union(Geometry.read(x) for x in g.get("geometries") or [])
        if kind == "Polygon":
            return Geometry([("polygon", [_ring(r) for r in c])])
        if kind == "MultiPolygon":
            return Geometry([("polygon", [_ring(r) for r in p]) for p in c])
        line = lambda p: np.array([q[:2] for q in p], float).reshape(-1, 2)
        if kind in ("LineString", "LinearRing"):
            return Geometry([("line", [line(c)])])
        if kind == "MultiLineString":
            return Geometry([("line", [line(p)]) for p in c])
        if kind == "Point":
            return Geometry([("point", [line([c])])] if c else [])
        if kind == "MultiPoint":
            return Geometry([("point", [line([p])]) for p in c])
        return Geometry([])

    def to_json(self) -> dict:
        """GeoJSON of the simplest kind that holds all parts."""
        kinds = {k for k, _ in self.parts}
        shapes = [{"polygon": [r.tolist() for r in rings], "line": rings[0].tolist(), "point": rings[0][0].tolist()}[k] for k, rings in self.parts]
        if len(kinds) != 1:
            return {"type": "GeometryCollection", "geometries": [Geometry([p]).to_json() for p in self.parts]}
        one, many = {"polygon": ("Polygon", "MultiPolygon"), "line": ("LineString", "MultiLineString"), "point": ("Point", "MultiPoint")}[kinds.pop()]
        return {"type": one, "coordinates": shapes[0]} if len(shapes) == 1 else {"type": many, "coordinates": shapes}

    @property
    def empty(self) -> bool:
        return not self.parts

    def vertices(self) -> int:
        """Coordinates in all rings, the closing ones included."""
        return sum(len(r) for _, rings in self.parts for r in rings)

    def bounds(self) -> tuple[float, float, float, float]:
        every = np.vstack([r for _, rings in self.parts for r in rings])
        return (*every.min(axis=0).tolist(), *every.max(axis=0).tolist())

    def moved(self, f: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Geometry:
        return Geometry([(k, [np.column_stack(f(r[:, 0], r[:, 1])) for r in rings]) for k, rings in self.parts])

    def project(self, source: str | None, target: str) -> Geometry:
        """Each vertex in another coordinate system; no source means geographic."""
        if C.code(source) == C.code(target):
            return self
        return self.moved(lambda x, y: C.transform(source, target, x, y))

    def simplified(self, most: int, tries: int = 40, factor: float = 2.0) -> Geometry:
        """At most `most` vertices: ever coarser, from a ten-thousandth of the span. A ring keeps four vertices and its place; where
        that isn't enough, ValueError."""
        if self.empty or self.vertices() <= most:
            return self
        xmin, ymin, xmax, ymax = self.bounds()
        tolerance, best = max(max(xmax - xmin, ymax - ymin) * 1e-4, 1e-9), self.vertices()
        for _ in range(tries):
            found = Geometry([(k, [_thinned(r, tolerance, 4 if k == "polygon" else 2) for r in rings]) for k, rings in self.parts])
            best = min(best, found.vertices())
            if best <= most:
                return found
            tolerance *= factor
        raise ValueError(f"Unable to simplify geometry to <= {most} vertices (best achieved {best}).")

    def edges(self) -> np.ndarray:
        """All segments as rows x0, y0, x1, y1; a point is a segment without length."""
        out = [np.hstack([r[:-1], r[1:]]) if len(r) > 1 else np.hstack([r, r]) for _, rings in self.parts for r in rings]
        return np.vstack(out) if out else np.zeros((0, 4))

    def holds(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which points lie inside a polygon: an odd number of its edges to the right."""
        inside = np.zeros(len(x), bool)
        for kind, rings in self.parts:
            if kind != "polygon":
                continue
            e = np.vstack([np.hstack([r[:-1], r[1:]]) for r in rings])
            odd = np.zeros(len(x), bool)
            for low in range(0, len(x), step := max(1, PAIRS // max(1, len(e)))):
                px, py = x[low : low + step, None], y[low : low + step, None]
                cross = (e[:, 1] > py) != (e[:, 3] > py)
                with np.errstate(divide="ignore", invalid="ignore"):
                    at = e[:, 0] + (py - e[:, 1]) * (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
                odd[low : low + step] = (cross & (px < at)).sum(axis=1) % 2 == 1
            inside |= odd
        return inside

    def touches(self, xmin: np.ndarray, ymin: np.ndarray, xmax: np.ndarray, ymax: np.ndarray) -> np.ndarray:
        """Which boxes share a point with the geometry, borders included: an edge crosses the box, or the box lies inside."""
        out = self.holds(xmin, ymin)
        e = self.edges()
        for low in range(0, len(xmin), step := max(1, PAIRS // max(1, len(e)))):
            s = slice(low, low + step)
            first, last = np.zeros((len(xmin[s]), len(e))), np.ones((len(xmin[s]), len(e)))
            for a, b, low_side, high_side in ((e[:, 0], e[:, 2], xmin[s], xmax[s]), (e[:, 1], e[:, 3], ymin[s], ymax[s])):
                d = b - a
                with np.errstate(divide="ignore", invalid="ignore"):
                    t, u = (low_side[:, None] - a) / d, (high_side[:, None] - a) / d
                flat, within = d == 0, (a >= low_side[:, None]) & (a <= high_side[:, None])
                first = np.maximum(first, np.where(flat, np.where(within, 0, 2), np.minimum(t, u)))
                last = np.minimum(last, np.where(flat, np.where(within, 1, -1), np.maximum(t, u)))
            out[s] |= (first <= last).any(axis=1)
        return out


def union(many: Iterator[Geometry]) -> Geometry:
    return Geometry([p for g in many for p in g.parts])


def box(xmin: float, ymin: float, xmax: float, ymax: float) -> Geometry:
    return Geometry([("polygon", [_ring([(xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax)])])])


def _thinned(points: np.ndarray, tolerance: float, least: int) -> np.ndarray:
    """Only the vertices farther than the tolerance from the line through their neighbours that stay, and at least `least`."""
    n = len(points)
    if n <= least:
        return points
    keep = np.zeros(n, bool)
    keep[[0, n - 1]] = True
    if least == 4:  # a ring: its ends are one point, so it is cut at the farthest vertices too
        far = int(np.argmax(((points - points[0]) ** 2).sum(axis=1)))
        keep[far] = True
        a, d = points[0], points[far] - points[0]
        off = np.abs(d[0] * (points[:, 1] - a[1]) - d[1] * (points[:, 0] - a[0]))
        off[keep] = -1
        keep[int(np.argmax(off))] = True
    marks = np.flatnonzero(keep).tolist()
    waiting = list(zip(marks[:-1], marks[1:], strict=True))
    while waiting:
        i, j = waiting.pop()
        if j - i < 2:
            continue
        a, d = points[i], points[j] - points[i]
        p = points[i + 1 : j] - a
        length = float(d @ d)
        t = np.clip(p @ d / length, 0, 1) if length else np.zeros(len(p))
        off = np.hypot(*(p - t[:, None] * d).T)
        k = int(np.argmax(off))
        if off[k] > tolerance:
            keep[i + 1 + k] = True
            waiting += [(i, i + 1 + k), (i + 1 + k, j)]
    return points[keep]


def touches_box(area: Geometry) -> Callable[..., Column]:
    """A test of boxes given by four columns. A rectangle is compared with plain columns, anything else in Arrow batches."""
    if len(area.parts) == 1 and area.parts[0][0] == "polygon" and area.vertices() == 5:
        r = area.parts[0][1][0]
        if len({*r[:4, 0]}) == 2 and len({*r[:4, 1]}) == 2 and all((r[k] == r[k + 1]).any() for k in range(4)):
            a, b, c, d = area.bounds()
            return lambda xmin, ymin, xmax, ymax: (F.col(xmin) <= c) & (F.col(xmax) >= a) & (F.col(ymin) <= d) & (F.col(ymax) >= b)

    @F.pandas_udf("boolean")
    def test(xmin: pd.Series, ymin: pd.Series, xmax: pd.Series, ymax: pd.Series) -> pd.Series:
        return pd.Series(area.touches(xmin.to_numpy(), ymin.to_numpy(), xmax.to_numpy(), ymax.to_numpy()))

    return test


@F.pandas_udf(BooleanType())
def geojson_touches_box(geometry: pd.Series, xmin: pd.Series, ymin: pd.Series, xmax: pd.Series, ymax: pd.Series) -> pd.Series:
    """Whether each row's geometry (GeoJSON text, in the boxes' coordinates) touches its box."""
    import json

    code, texts = pd.factorize(geometry)
    sides = [s.to_numpy(float) for s in (xmin, ymin, xmax, ymax)]
    out = np.zeros(len(code), bool)
    order = np.argsort(code, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):  # a geometry's boxes together
        if len(own) and code[own[0]] >= 0 and texts[code[own[0]]]:
            out[own] = Geometry.read(json.loads(texts[code[own[0]]])).touches(*(s[own] for s in sides))
    return pd.Series(out, dtype=bool)


@F.pandas_udf(StructType([StructField("vertices", IntegerType()), *(StructField(c, DoubleType()) for c in ("xmin", "ymin", "xmax", "ymax"))]))
def measures(texts: pd.Series) -> pd.DataFrame:
    """A geometry's number of vertices (closing ones included) and bounds; null bounds where it is empty."""
    import json

    rows = []
    for text in texts:
        g = Geometry.read(json.loads(text)) if text else Geometry([])
        rows.append((g.vertices(), *((None,) * 4 if g.empty else g.bounds())))
    return pd.DataFrame(rows, columns=["vertices", "xmin", "ymin", "xmax", "ymax"])


def projected_geojson(source: str | None, target: str) -> Callable[[Column], Column]:
    """GeoJSON text in another coordinate system, with its bounds: a struct (json, xmin, ymin, xmax, ymax); null where empty or unreadable."""

    @F.pandas_udf("json string, xmin double, ymin double, xmax double, ymax double")
    def project(texts: pd.Series) -> pd.DataFrame:
        import json

        rows = []
        for text in texts:
            try:
                g = Geometry.read(json.loads(text)) if text else Geometry([])
            except (ValueError, TypeError, KeyError):
                g = Geometry([])
            g = g.project(source, target)
            rows.append((None,) * 5 if g.empty else (json.dumps(g.to_json()), *g.bounds()))
        return pd.DataFrame(rows, columns=["json", "xmin", "ymin", "xmax", "ymax"])

    return project
