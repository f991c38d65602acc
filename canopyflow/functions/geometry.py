"""Polygon measures on rings (array<struct<x, y>>): Column expressions where SQL can say it, NumPy kernels else.

Rings are simple polygons without holes; the closing vertex may be repeated or left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"


# ---- Column expressions -------------------------------------------------------------------------


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _rotated(ring: Column) -> Column:
    return F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))


def _cross(ring: Column) -> Column:
    return F.zip_with(ring, _rotated(ring), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])


def area(ring: Column) -> Column:
    """Shoelace area."""
    return F.abs(_sum(_cross(ring))) / 2.0


def perimeter(ring: Column) -> Column:
    """Length of the boundary."""
    return _sum(F.zip_with(ring, _rotated(ring), lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"])))


def centroid(ring: Column) -> Column:
    """struct(x, y) of the area's centre; the mean vertex of a ring without area."""
    twice = _sum(_cross(ring))
    moment = lambda axis: _sum(F.zip_with(ring, _rotated(ring), lambda p, q: (p[axis] + q[axis]) * (p["x"] * q["y"] - q["x"] * p["y"])))
    mean = lambda axis: _sum(F.transform(ring, lambda p: p[axis])) / F.size(ring)
    at = lambda axis: F.when(F.abs(twice) > 1e-12, moment(axis) / (3.0 * F.nullif(twice, F.lit(0.0)))).otherwise(mean(axis))
    return F.struct(at("x").alias("x"), at("y").alias("y"))


def bounds(ring: Column) -> Column:
    """struct(minx, miny, maxx, maxy)."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def compactness(ring: Column) -> Column:
    """4 pi area / perimeter ** 2, 0 for a perimeter of 0."""
    p = perimeter(ring)
    return F.when(p > 0, 4 * math.pi * area(ring) / (p * p)).otherwise(0.0)


def aspect_ratio(ring: Column) -> Column:
    """C4: height over width of the bounds, 1 for a width of 0."""
    b = bounds(ring)
    return F.when(b["maxx"] > b["minx"], (b["maxy"] - b["miny"]) / (b["maxx"] - b["minx"])).otherwise(1.0)


def affine(ring: Column, a: float | Column, b: float | Column, c: float | Column, d: float | Column, e: float | Column, f: float | Column) -> Column:
    """x' = a x + b y + c, y' = d x + e y + f for every vertex."""
    a, b, c, d, e, f = (v if isinstance(v, Column) else F.lit(float(v)) for v in (a, b, c, d, e, f))
    return F.transform(ring, lambda p: F.struct((a * p["x"] + b * p["y"] + c).alias("x"), (d * p["x"] + e * p["y"] + f).alias("y")))


def affine_inverse(a: float, b: float, c: float, d: float, e: float, f: float) -> tuple[float, ...]:
    """Inverse of a 6-parameter map; of a singular one the inverse of its translation."""
    det = a * e - b * d
    if abs(det) < 1e-15:
        return 1.0, 0.0, -c, 0.0, 1.0, -f
    return e / det, -b / det, (b * f - e * c) / det, -d / det, a / det, (d * c - a * f) / det


def affine_compose(second: tuple[float, ...], first: tuple[float, ...]) -> tuple[float, ...]:
    """Second after first."""
    a, b, c, d, e, f = second
    g, h, i, j, k, m = first
    return a * g + b * j, a * h + b * k, a * i + b * m + c, d * g + e * j, d * h + e * k, d * i + e * m + f


def translate(ring: Column, dx: float | Column, dy: float | Column) -> Column:
    """C9."""
    return affine(ring, 1, 0, dx, 0, 1, dy)


def largest(rings: Column) -> Column:
    """The ring of largest area of an array of rings; the first on ties."""
    rated = F.transform(rings, lambda r, i: F.struct(area(r).alias("a"), (-i).alias("i"), r.alias("r")))
    return F.element_at(F.array_sort(rated, lambda p, q: F.when(p["a"] > q["a"], -1).when(p["a"] < q["a"], 1).otherwise(q["i"] - p["i"])), 1)["r"]


def in_disc(x: Column, y: Column, cx: Column, cy: Column, radius: float | Column) -> Column:
    """C14: the point lies in the disc around (cx, cy)."""
    r = radius if isinstance(radius, Column) else F.lit(float(radius))
    return (x - cx) * (x - cx) + (y - cy) * (y - cy) <= r * r


def contains_point(ring: Column, x: Column, y: Column) -> Column:
    """C14: ray casting; points on the boundary may fall either way."""
    crossed = F.zip_with(ring, _rotated(ring), lambda p, q: F.when(((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"]), 1).otherwise(0))
    return F.aggregate(crossed, F.lit(0), lambda a, v: a + v) % 2 == 1


def flat_rings(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Points and offsets of an Arrow column of rings; null is a ring without vertices."""
    points, size = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    xy = np.stack([points.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y")], 1) if len(points) else np.zeros((0, 2))
    return xy, np.concatenate([[0], np.cumsum(size)])


def is_box(ring: Column) -> Column:
    """Rings that are their own bounds: a corner each, and an area."""
    b = bounds(ring)
    corner = F.forall(ring, lambda p: ((p["x"] == b["minx"]) | (p["x"] == b["maxx"])) & ((p["y"] == b["miny"]) | (p["y"] == b["maxy"])))
    return F.coalesce(corner & (F.size(F.array_distinct(ring)) == 4) & (area(ring) > 0), F.lit(False))


def world_to_pixel(ring: Column, origin_x: float, origin_y: float, size_x: float, size_y: float) -> Column:
    """Column and row of map coordinates; rows grow downwards."""
    return F.transform(ring, lambda p: F.struct(((p["x"] - origin_x) / size_x).alias("x"), ((origin_y - p["y"]) / size_y).alias("y")))


def expanded(box: Column, pad: float = 0.25) -> Column:
    """C17: bounds grown on every side by a fraction of the longer side."""
    m = pad * F.greatest(box["maxx"] - box["minx"], box["maxy"] - box["miny"])
    return F.struct((box["minx"] - m).alias("minx"), (box["miny"] - m).alias("miny"), (box["maxx"] + m).alias("maxx"), (box["maxy"] + m).alias("maxy"))


def is_polygon(ring: Column) -> Column:
    """Not null and with at least three vertices that differ from the one before."""
    moved = F.zip_with(ring, _rotated(ring), lambda p, q: (p["x"] != q["x"]) | (p["y"] != q["y"]))
    return F.coalesce(F.size(F.filter(moved, lambda m: m)) >= 3, F.lit(False))


def geometry_key(ring: Column, digits: int = 9) -> Column:
    """Equal for equal rings, whatever vertex or direction they begin with.

    The vertices are rounded, a repeated closing vertex is dropped, and the least of all rotations in both
    directions is hashed.
    """
    pts = F.transform(ring, lambda p: F.struct(F.round(p["x"], digits).alias("x"), F.round(p["y"], digits).alias("y")))
    open_ = F.when((F.size(pts) > 1) & (F.element_at(pts, 1) == F.element_at(pts, -1)), F.slice(pts, 1, F.size(pts) - 1)).otherwise(pts)
    turns = lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.concat(F.slice(p, i, F.size(p)), F.slice(p, 1, i - 1)))
    return F.sha2(F.to_json(F.struct(F.array_min(F.concat(turns(open_), turns(F.reverse(open_)))).alias("ring"))), 256)


def pair_similarity(a: dict[str, Column], b: dict[str, Column], iou: Column, weights: dict[str, float] | None = None, max_dist: float = 100.0) -> dict[str, Column]:
    """Spatial, area, shape and iou similarity and their weighted sum of two crowns.

    a, b: x, y (centroid), area, compactness, eccentricity.
    """
    w = {"spatial": 0.4, "area": 0.2, "shape": 0.2, "iou": 0.2} | (weights or {})
    dx, dy = a["x"] - b["x"], a["y"] - b["y"]
    dist = F.sqrt(dx * dx + dy * dy)
    parts = {
        "spatial": F.greatest(F.lit(0.0), 1.0 - dist / max_dist),
        "area": F.coalesce(F.least(a["area"], b["area"]) / F.nullif(F.greatest(a["area"], b["area"]), F.lit(0.0)), F.lit(0.0)),
        "shape": (2.0 - F.abs(a["compactness"] - b["compactness"]) - F.abs(a["eccentricity"] - b["eccentricity"])) / 2.0,
        "iou": iou,
    }
    return parts | {"similarity": sum((w[k] * c for k, c in list(parts.items())[1:]), w["spatial"] * parts["spatial"])}


# ---- transverse Mercator (C15) ------------------------------------------------------------------


def utm(lon: Column, lat: Column, zone: int, south: bool = False) -> Column:
    """struct(x, y) in metres of WGS84 degrees, by the series in the third flattening (under a millimetre inside a zone)."""
    n = 0.0033528106647474805 / (2 - 0.0033528106647474805)
    big = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    k, e = 0.9996, 2 * math.sqrt(n) / (1 + n)
    s, d = F.sin(F.radians(lat)), F.radians(lon - (6.0 * zone - 183.0))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1.0 + t * t))
    x = eta + sum(a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(alpha, 1))
    y = xi + sum(a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(alpha, 1))
    return F.struct((500000.0 + k * big * x).alias("x"), ((10000000.0 if south else 0.0) + k * big * y).alias("y"))


def utm_inverse(x: Column, y: Column, zone: int, south: bool = False) -> Column:
    """struct(lon, lat) in degrees of UTM metres."""
    n = 0.0033528106647474805 / (2 - 0.0033528106647474805)
    big = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    xi, eta = (y - (10000000.0 if south else 0.0)) / (0.9996 * big), (x - 500000.0) / (0.9996 * big)
    u = xi - sum(b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(beta, 1))
    v = eta - sum(b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(beta, 1))
    chi = F.asin(F.sin(u) / F.cosh(v))
    lat = chi + sum(d * F.sin(2 * j * chi) for j, d in enumerate(delta, 1))
    return F.struct((F.degrees(F.atan2(F.sinh(v), F.cos(u))) + (6.0 * zone - 183.0)).alias("lon"), F.degrees(lat).alias("lat"))


# ---- NumPy kernels ------------------------------------------------------------------------------


def as_points(ring) -> np.ndarray:
    """(n, 2) vertices of a ring as Spark hands it over, without a repeated closing vertex."""
    pts = np.array([(p["x"], p["y"]) for p in ring], dtype=np.float64).reshape(-1, 2)
    return pts[:-1] if len(pts) > 1 and (pts[0] == pts[-1]).all() else pts


def signed_area(p: np.ndarray) -> float:
    x, y = p[:, 0], p[:, 1]
    return float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2 if len(p) > 2 else 0.0


def _clip(subject: np.ndarray, triangle: np.ndarray) -> np.ndarray:
    """The convex subject inside the counter-clockwise triangle."""
    out = subject
    for k in range(3):
        if len(out) == 0:
            break
        a, b = triangle[k], triangle[(k + 1) % 3]
        side = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        nxt, s2 = np.roll(out, -1, axis=0), np.roll(side, -1)
        pieces = []
        for p, q, s, t in zip(out, nxt, side, s2):
            if s >= 0:
                pieces.append(p)
            if (s > 0 > t) or (s < 0 < t):
                pieces.append(p + (q - p) * (s / (s - t)))
        out = np.array(pieces).reshape(-1, 2)
    return out


def intersection_area(p: np.ndarray, q: np.ndarray) -> float:
    """Exact for simple rings, convex or not: signed triangles fanned from the first vertices, pairwise clipped."""
    if len(p) < 3 or len(q) < 3 or (p.max(0) < q.min(0)).any() or (q.max(0) < p.min(0)).any():
        return 0.0

    def fans(r: np.ndarray) -> list[tuple[float, np.ndarray]]:
        out = []
        for i in range(1, len(r) - 1):
            t = r[[0, i, i + 1]]
            a = signed_area(t)
            if a != 0:
                out.append((math.copysign(1, a), t if a > 0 else t[::-1]))
        return out

    second, total = fans(q), 0.0
    for s, t in fans(p):
        low, high = t.min(0), t.max(0)
        for z, u in second:
            if (u.max(0) > low).all() and (high > u.min(0)).all():
                c = _clip(t, u)
                if len(c) > 2:
                    total += s * z * abs(signed_area(c))
    return abs(total)


def ring_batch(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rings, most vertices, 2) anticlockwise, the last vertex repeated up to the width, and the numbers of vertices.

    values: (vertices, 2) of all rings, one after another; a closing vertex that repeats the first one is left out.
    """
    n = np.diff(offsets)
    if not len(values):
        return np.zeros((len(n), 1, 2)), n
    first, last = values[np.minimum(offsets[:-1], len(values) - 1)], values[np.maximum(offsets[1:] - 1, 0)]
    n = n - ((n > 1) & (first == last).all(1))
    at = np.minimum(np.arange(max(int(n.max(initial=1)), 1)), np.maximum(n - 1, 0)[:, None])
    out = values[np.minimum(offsets[:-1, None] + at, len(values) - 1)]
    clockwise = batch_areas(out) < 0
    back = np.maximum(n - 1, 0)[:, None] - at
    out[clockwise] = np.take_along_axis(out, back[:, :, None], 1)[clockwise]
    return out, n


def batch_areas(rings: np.ndarray) -> np.ndarray:
    """Signed areas of padded rings."""
    d = rings - rings[:, :1]
    after = np.roll(d, -1, axis=1)
    return ((d[:, :, 0] * after[:, :, 1] - after[:, :, 0] * d[:, :, 1]).sum(1)) / 2


def batch_convex(rings: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether each padded anticlockwise ring is a convex polygon: it turns left at every vertex, and once around in all."""
    k = np.arange(rings.shape[1])
    after = np.take_along_axis(rings, np.where(k + 1 < n[:, None], k + 1, 0)[:, :, None], 1)
    side = after - rings
    onward = np.take_along_axis(side, np.where(k + 1 < n[:, None], k + 1, 0)[:, :, None], 1)
    turn = side[:, :, 0] * onward[:, :, 1] - side[:, :, 1] * onward[:, :, 0]
    angle = np.arctan2(turn, (side * onward).sum(2))
    real = k < n[:, None]
    scale = np.abs(rings - rings[:, :1]).max(axis=(1, 2)) ** 2
    return (n >= 3) & ((turn >= -1e-12 * scale[:, None]) | ~real).all(1) & (np.abs(np.where(real, angle, 0).sum(1) - 2 * math.pi) < 1e-6)


def batch_intersections(p: np.ndarray, np_: np.ndarray, q: np.ndarray, nq: np.ndarray) -> np.ndarray:
    """Areas shared by pairs of padded anticlockwise rings. Convex pairs are clipped all together, edge by edge; pairs whose
    bounds are apart are 0; the rest is done pair by pair."""
    out = np.zeros(len(p))
    meet = (np_ > 2) & (nq > 2) & (np.minimum(p.max(1), q.max(1)) > np.maximum(p.min(1), q.min(1))).all(1)
    convex = meet.copy()
    convex[meet] = batch_convex(p[meet], np_[meet]) & batch_convex(q[meet], nq[meet])
    for i in np.flatnonzero(meet & ~convex):
        out[i] = intersection_area(p[i, : np_[i]], q[i, : nq[i]])
    at = np.flatnonzero(convex)
    for some in np.array_split(at, len(at) // 20_000 + 1):
        shift = p[some, :1]
        poly, n, clip, m = p[some] - shift, np_[some].copy(), q[some] - shift, nq[some]
        for k in range(clip.shape[1]):
            a, b = clip[:, k], clip[np.arange(len(some)), np.where(k + 1 < m, k + 1, 0)]
            own = np.arange(poly.shape[1])
            after = np.take_along_axis(poly, np.where(own + 1 < n[:, None], own + 1, 0)[:, :, None], 1)
            edge = (b - a)[:, None]
            height = lambda v: edge[:, :, 0] * (v[:, :, 1] - a[:, None, 1]) - edge[:, :, 1] * (v[:, :, 0] - a[:, None, 0])  # noqa: B023, E731
            h0, h1 = height(poly), height(after)
            real = own < n[:, None]
            skip = (k >= m)[:, None]  # this ring has no such edge
            stays = real & ((h0 >= 0) | skip)
            cuts = real & ((h0 >= 0) != (h1 >= 0)) & ~skip
            t = h0 / np.where(cuts, h0 - h1, 1.0)
            both = np.stack([poly, poly + (after - poly) * t[:, :, None]], 2).reshape(len(some), 2 * poly.shape[1], 2)
            kept = np.stack([stays, cuts], 2).reshape(len(some), 2 * poly.shape[1])
            n = kept.sum(1)
            order = np.argsort(~kept, axis=1, kind="stable")[:, : max(int(n.max(initial=1)), 1)]
            poly = np.take_along_axis(both, order[:, :, None], 1)
        real = np.arange(poly.shape[1]) < n[:, None]
        poly = np.where(real[:, :, None], poly, poly[:, :1])
        out[some] = np.where(n > 2, np.maximum(batch_areas(poly), 0.0), 0.0)
    return out


def convex_hull(p: np.ndarray) -> np.ndarray:
    """Counter-clockwise hull by monotone chains."""
    pts = np.unique(p, axis=0)
    if len(pts) < 3:
        return pts

    def half(points) -> list:
        out: list = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def eccentricity(p: np.ndarray) -> float:
    """Shorter over longer side of the least rectangle around the ring; 1 for a degenerate ring."""
    hull = convex_hull(p)
    if len(hull) < 3:
        return 1.0
    edges = np.roll(hull, -1, axis=0) - hull
    best, ratio = math.inf, 1.0
    for u in edges / np.linalg.norm(edges, axis=1, keepdims=True):
        w, h = np.ptp(hull @ u), np.ptp(hull @ np.array([-u[1], u[0]]))
        if w * h < best:
            best, ratio = w * h, min(w, h) / max(w, h) if max(w, h) > 0 else 1.0
    return float(ratio)


def inside(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which points x lie in ring p."""
    a, b = p, np.roll(p, -1, axis=0)
    dy = np.where(b[:, 1] == a[:, 1], 1.0, b[:, 1] - a[:, 1])
    up = (a[None, :, 1] > x[:, 1:]) != (b[None, :, 1] > x[:, 1:])
    at = (b[:, 0] - a[:, 0]) * (x[:, 1:] - a[:, 1]) / dy + a[:, 0]
    return (up & (x[:, :1] < at)).sum(1) % 2 == 1


def boundary_distance(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distance of the points x to the boundary of ring p."""
    a, d = p, np.roll(p, -1, axis=0) - p
    n = np.maximum((d * d).sum(1), 1e-300)
    t = np.clip(((x[:, None] - a) * d).sum(2) / n, 0, 1)
    return np.sqrt((((a + t[..., None] * d) - x[:, None]) ** 2).sum(2)).min(1)


def covered_within(inner: np.ndarray, outer: np.ndarray, buffer: float = 0.0) -> bool:
    """Inner lies in outer grown by buffer: every vertex is inside or within that distance of the boundary."""
    out = ~inside(outer, inner)
    return not out.any() or bool((boundary_distance(outer, inner[out]) <= buffer + 1e-9).all())


def raster_area(parts: list[np.ndarray], rule, cell: float) -> float:
    """Area, on a grid of cell size, of the points whose signed distances to the rings satisfy the rule."""
    every = np.concatenate(parts)
    low, high = every.min(0) - 4 * cell, every.max(0) + 4 * cell
    xs, ys = np.arange(low[0], high[0], cell) + cell / 2, np.arange(low[1], high[1], cell) + cell / 2
    grid = np.array(np.meshgrid(xs, ys)).reshape(2, -1).T
    signed = [np.where(inside(p, grid), -1.0, 1.0) * boundary_distance(p, grid) for p in parts]
    return float(rule(np.stack(signed)).sum()) * cell * cell


def simplify(p: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on the closed ring, from its first vertex and the one furthest from it."""

    def keep(a: int, b: int) -> list[int]:
        if b <= a + 1:
            return []
        d = pts[b] - pts[a]
        n = np.linalg.norm(d)
        mid = pts[a + 1 : b] - pts[a]
        dist = np.abs(d[0] * mid[:, 1] - d[1] * mid[:, 0]) / n if n > 0 else np.linalg.norm(mid, axis=1)
        k = int(dist.argmax())
        return [] if dist[k] <= tolerance else [*keep(a, a + 1 + k), a + 1 + k, *keep(a + 1 + k, b)]

    if len(p) < 4:
        return p
    pts = np.vstack([p, p[:1]])
    far = int(((p - p[0]) ** 2).sum(1).argmax())
    return pts[[0, *keep(0, far), far, *keep(far, len(p))]]
