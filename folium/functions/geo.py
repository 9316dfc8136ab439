"""Column functions on geometries: lists of polygons of rings of [lon, lat]."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

RINGS = "array<array<array<array<double>>>>"


def parse_geometry(raw: Column) -> Column:
    """struct(type, point, polygons) of GeoJSON text: Point, Polygon and MultiPolygon."""
    kind = F.get_json_object(raw, "$.type")
    at = F.get_json_object(raw, "$.coordinates")
    point = F.when(kind == "Point", F.from_json(at, "array<double>"))
    polygons = F.when(kind == "Polygon", F.array(F.from_json(at, "array<array<array<double>>>"))).when(kind == "MultiPolygon", F.from_json(at, RINGS))
    return F.struct(kind.alias("type"), point.alias("point"), polygons.alias("polygons"))


def _inside(v: Column, box: tuple[float, float, float, float]) -> Column:
    w, s, e, n = box
    return F.get(v, F.lit(0)).between(w, e) & F.get(v, F.lit(1)).between(s, n)


def in_bbox(geometry: Column, box: tuple[float, float, float, float]) -> Column:
    """Inclusive: a point inside, or any vertex of an outer ring; no true intersection."""
    vertex = F.exists(geometry["polygons"], lambda p: F.exists(F.get(p, F.lit(0)), lambda v: _inside(v, box)))
    return F.coalesce(_inside(geometry["point"], box), vertex, F.lit(False))


def in_bbox_first_vertex(geometry: Column, box: tuple[float, float, float, float]) -> Column:
    """The first vertex of the first outer ring alone decides."""
    return F.coalesce(_inside(geometry["point"], box), _inside(F.get(F.get(F.get(geometry["polygons"], F.lit(0)), F.lit(0)), F.lit(0)), box), F.lit(False))


def to_point(pair: Column) -> Column:
    """[lat, lng] to a GeoJSON point's [lng, lat]; null unless both are there."""
    return F.when(F.size(pair) == 2, F.array(pair[1], pair[0]))


def circle(lon: Column, lat: Column, km: Column, n: int = 64) -> Column:
    """A closed ring of n + 1 vertices; one degree is 111 km, longitude scaled by the cosine of the latitude."""
    angle = lambda i: 2 * F.lit(np.pi) * (i % n) / n
    dx = km / (111.0 * F.cos(F.radians(lat)))
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.array(lon + dx * F.cos(angle(i)), lat + km / 111.0 * F.sin(angle(i))))


#: Points that are tested one by one; numpy takes over above.
FEW = 24


class _Vertices:
    """The vertices that are left of a geometry's rings, found by place."""

    def __init__(self, points: list[tuple[float, float]]) -> None:
        xs, ys = [p[0] for p in points], [p[1] for p in points]
        self.points, self.x, self.y = points, min(xs), min(ys)
        self.side = max(max(max(xs) - self.x, max(ys) - self.y) / max(1.0, math.sqrt(len(points))), 1e-12)
        self.cells: dict[tuple[int, int], set[int]] = {}
        for i, (x, y) in enumerate(points):
            self.cells.setdefault(self._cell(x, y), set()).add(i)

    def _cell(self, x: float, y: float) -> tuple[int, int]:
        return math.floor((x - self.x) / self.side), math.floor((y - self.y) / self.side)

    def remove(self, i: int) -> None:
        self.cells[self._cell(*self.points[i])].discard(i)

    def inside(self, corners: tuple[int, int, int]) -> bool:
        """Whether a vertex that isn't a corner lies in the triangle of three, or on its border."""
        (ax, ay), (bx, by), (cx, cy) = (self.points[i] for i in corners)
        low_x, high_x, low_y, high_y = min(ax, bx, cx), max(ax, bx, cx), min(ay, by, cy), max(ay, by, cy)
        (x0, y0), (x1, y1) = self._cell(low_x, low_y), self._cell(high_x, high_y)
        spots = [(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)] if (x1 - x0 + 1) * (y1 - y0 + 1) <= len(self.cells) else [c for c in self.cells if x0 <= c[0] <= x1 and y0 <= c[1] <= y1]
        for c in spots:
            for i in self.cells.get(c, ()):
                x, y = self.points[i]
                if i in corners or not (low_x <= x <= high_x and low_y <= y <= high_y):
                    continue
                one = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
                two = (cx - bx) * (y - by) - (cy - by) * (x - bx)
                three = (ax - cx) * (y - cy) - (ay - cy) * (x - cx)
                if (one >= 0 and two >= 0 and three >= 0) or (one <= 0 and two <= 0 and three <= 0):
                    return True
        return False


def _deviation(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    """Greatest distance of points to a segment."""
    d = b - a
    along = np.clip(((p - a) @ d) / (float(d @ d) or 1.0), 0, 1)
    return float(np.sqrt((((p - a) - along[:, None] * d) ** 2).sum(axis=1)).max())


def _deviation_of_few(points: list[tuple[float, float]], a: tuple[float, float], b: tuple[float, float]) -> float:
    """_deviation() without arrays, which cost more than the sums for a few points."""
    (ax, ay), dx, dy = a, b[0] - a[0], b[1] - a[1]
    length, most = dx * dx + dy * dy or 1.0, 0.0
    for px, py in points:
        x, y = px - ax, py - ay
        along = min(max((x * dx + y * dy) / length, 0.0), 1.0)
        x, y = x - along * dx, y - along * dy
        most = max(most, x * x + y * y)
    return math.sqrt(most)


def simplified(polygons: list[list[list[list[float]]]], tolerance: float) -> list[list[list[list[float]]]]:
    """The rings with fewer vertices, none of the old ones further than the tolerance from the new ring.

    Vertices go in the order of how little they matter, each only if the triangle
    with its neighbours holds no other vertex of the geometry: so rings that don't
    cross themselves or each other never come to, and holes stay inside. A ring
    keeps its first vertex and at least two more; short or open ones stay as they are.
    """
    rings = [[(v[0], v[1]) for v in r] for p in polygons for r in p if r]
    shrinks = [len(r) > 4 and r[0] == r[-1] for r in rings]
    if not any(shrinks) or not all(c is not None and math.isfinite(c) for r in rings for v in r for c in v):
        return polygons
    bodies = [r[:-1] if s else r for r, s in zip(rings, shrinks, strict=True)]
    points = [v for body in bodies for v in body]
    left = _Vertices(points)
    kept, first = [True] * len(points), 0
    for body, shrink in zip(bodies, shrinks, strict=True):
        if shrink:
            _shrink(points, left, kept, first, len(body), tolerance)
        first += len(body)
    at, first, out = 0, 0, []
    for p in polygons:
        out.append([])
        for r in p:
            if not r:
                out[-1].append(r)
                continue
            body, shrink = bodies[at], shrinks[at]
            own = [list(v) for v, k in zip(r, kept[first : first + len(body)], strict=False) if k]
            out[-1].append([*own, list(r[-1])] if shrink else [list(v) for v in r])
            at, first = at + 1, first + len(body)
    return out


def _shrink(points: list[tuple[float, float]], left: _Vertices, kept: list[bool], first: int, n: int, tolerance: float) -> None:
    before, after = [(i - 1) % n for i in range(n)], [(i + 1) % n for i in range(n)]
    ring = points[first : first + n]
    twice = np.array(ring + ring) if n > FEW else None

    def matters(i: int) -> float:
        a, b = before[i], after[i]
        end = b if b > a else b + n
        if end - a - 1 > FEW:
            return _deviation(twice[a + 1 : end], twice[a], twice[b])
        return _deviation_of_few(ring[a + 1 : end] if end <= n else ring[a + 1 :] + ring[:b], ring[a], ring[b])

    queue = [(matters(i), i) for i in range(1, n)]
    heapq.heapify(queue)
    latest = {i: d for d, i in queue}
    size = n
    while queue and size > 3:
        d, i = heapq.heappop(queue)
        if latest.get(i) != d:
            continue
        if d > tolerance:
            break
        a, b = before[i], after[i]
        if left.inside((first + a, first + i, first + b)):
            continue  # it may go once a neighbour has changed
        kept[first + i] = False
        left.remove(first + i)
        del latest[i]
        after[a], before[b], size = b, a, size - 1
        for j in (a, b):
            if j:
                latest[j] = matters(j)
                heapq.heappush(queue, (latest[j], j))


def simplify_rings(tolerance: float = 0.01):
    """A vectorised function of polygons: simplified() of each; null stays null."""

    kind = pa.list_(pa.list_(pa.list_(pa.list_(pa.float64()))))

    @arrow_udf(RINGS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for polygons in batches:
            yield pa.array([None if g is None else simplified(g, tolerance) for g in polygons.to_pylist()], kind)

    return run


# ------------------------------------------------------------------ places of geometries in a table

#: Finest level of the quadtree whose cells a table of geometries is laid out in: 2 to this power squared.
FINEST = 6


def bounds(geometry: Column) -> Column:
    """struct(w, s, e, n) of a point or of all outer rings; null without vertices."""
    own = F.when(geometry["point"].isNotNull(), F.array(geometry["point"]))
    rings = F.flatten(F.filter(F.transform(geometry["polygons"], lambda p: F.get(p, F.lit(0))), lambda r: r.isNotNull()))
    v = F.coalesce(own, rings)
    x, y = F.transform(v, lambda p: F.get(p, F.lit(0))), F.transform(v, lambda p: F.get(p, F.lit(1)))
    return F.when(F.size(v) > 0, F.struct(F.array_min(x).alias("w"), F.array_min(y).alias("s"), F.array_max(x).alias("e"), F.array_max(y).alias("n")))


def _grid(level: int, x: float | Column, y: float | Column) -> tuple:
    """Column and row of a place among the 2**level squared cells of the world; places beyond it belong to the outermost."""
    most = (1 << level) - 1
    if isinstance(x, Column):
        clip = lambda c: F.greatest(F.lit(0), F.least(F.lit(most), F.floor(c).cast("int")))
    else:
        clip = lambda c: int(max(0, min(most, np.floor(c))))
    return clip((x + 180) / 360 * (most + 1)), clip((y + 90) / 180 * (most + 1))


def quad_cell(box: Column, finest: int = FINEST) -> Column:
    """struct(level, cx, cy): the smallest quadtree cell that holds a box whole; level -1 without a box."""
    out = F.struct(F.lit(0).alias("level"), F.lit(0).alias("cx"), F.lit(0).alias("cy"))
    for level in range(1, finest + 1):
        (x, y), (x2, y2) = _grid(level, box["w"], box["s"]), _grid(level, box["e"], box["n"])
        out = F.when((x == x2) & (y == y2), F.struct(F.lit(level).alias("level"), x.alias("cx"), y.alias("cy"))).otherwise(out)
    return F.when(box.isNull(), F.struct(F.lit(-1).alias("level"), F.lit(0).alias("cx"), F.lit(0).alias("cy"))).otherwise(out)


def cells_of_box(box: tuple[float, float, float, float], finest: int = FINEST) -> Column:
    """The rows (level, cx, cy) whose cells touch a box: one range of columns and rows a level."""
    found = F.lit(False)
    for level in range(finest + 1):
        (x, y), (x2, y2) = _grid(level, box[0], box[1]), _grid(level, box[2], box[3])
        found = found | ((F.col("level") == level) & F.col("cx").between(x, x2) & F.col("cy").between(y, y2))
    return found
