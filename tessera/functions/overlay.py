"""Overlay of polygons with holes by a sweep line.

A shape is an array of parts, a part an array of rings: what an odd number of its rings hold belongs to it, so the first ring is a shell and the others
its holes, whichever way they turn. The sweep goes from one x of a vertex to the next. Its status is the list of edges that stand in between, ordered by y;
where the order at the right differs from that at the left, the edges that changed places cross, and the strip is cut there. Within a strip nothing
crosses, so that walking its edges upwards tells which parts hold each gap: gaps add up to areas, and the borders of wanted gaps, joined over
the strips, are the rings of a union, an intersection or a repaired shape. Edges that lie on each other and parts that touch need no cases of their own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.rings import moments

POINT = "struct<x:double,y:double>"
SHAPE = f"array<array<array<{POINT}>>>"
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_SHAPE = pa.list_(pa.list_(pa.list_(_POINT)))
#: Points closer than this share of the extent are one.
SNAP = 1e-10

Ring = list[tuple[float, float]]
Part = list[Ring]


def parts_of(value) -> list[Part]:
    """Parts of a ring, a part's rings or a shape as Spark gives them; rings of under three points go."""
    if value is None or not len(value):
        return []
    if isinstance(value[0], dict) or hasattr(value[0], "asDict"):
        ring = [(float(p["x"]), float(p["y"])) for p in value]
        return [[ring]] if len(ring) > 2 else []
    parts = []
    for part in value:
        rings = [r for own in part if own is not None for p in parts_of(own) for r in p] if part is not None and len(part) else []
        if rings:
            parts.append(rings)
    return parts


def as_value(parts: list[Part]) -> list:
    return [[[{"x": x, "y": y} for x, y in ring] for ring in part] for part in parts]


def ring_area(ring: Ring) -> float:
    """Signed, about the first point."""
    ox, oy = ring[0]
    return sum((ax - ox) * (by - oy) - (bx - ox) * (ay - oy) for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


# ---- the sweep

Strip = tuple[float, float, list[tuple[float, float, int]]]


def _snapped(values: list[float], eps: float) -> dict[float, float]:
    """Each value's stand-in: the first of those that lie within eps of their neighbours."""
    out: dict[float, float] = {}
    first = last = None
    for v in sorted(set(values)):
        if first is None or v - last > eps:
            first = v
        out[v] = first
        last = v
    return out


def strips(parts: list[Part]) -> Iterator[Strip]:
    """(left, right, edges by y as (y at left, y at right, part)) of each strip in which no edges cross."""
    points = [p for part in parts for ring in part for p in ring]
    if not points:
        return
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    eps = SNAP * max(max(xs) - min(xs), max(ys) - min(ys), 1e-12)
    at = _snapped(xs, eps)
    begins: dict[float, list] = {}
    for k, part in enumerate(parts):
        for ring in part:
            for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
                ax, bx = at[ax], at[bx]
                if ax != bx:  # upright edges follow from the strips beside them
                    begins.setdefault(min(ax, bx), []).append((ax, ay, bx, by, k) if ax < bx else (bx, by, ax, ay, k))

    def y(e: tuple, x: float) -> float:
        return e[1] if x == e[0] else e[3] if x == e[2] else e[1] + (e[3] - e[1]) * ((x - e[0]) / (e[2] - e[0]))

    events, active = sorted(set(at.values())), []
    for left, right in zip(events, events[1:], strict=False):
        active = [e for e in active if e[2] > left] + begins.get(left, [])
        if not active:
            continue
        status = sorted((y(e, left), y(e, right), e[4], e) for e in active)
        cuts = []
        order = list(status)
        for j in range(1, len(order)):
            i = j
            while i and order[i - 1][1] > order[i][1] + eps:
                (a0, a1, *_), (b0, b1, *_) = order[i - 1], order[i]
                if b0 - a0 > eps:
                    cuts.append(left + (right - left) * ((b0 - a0) / ((b0 - a0) - (b1 - a1))))
                order[i - 1], order[i] = order[i], order[i - 1]
                i -= 1
        if not cuts:
            yield left, right, sorted(((a, b, k) for a, b, k, _ in status), key=lambda s: (s[0] + s[1], s))
            continue
        bounds = [left]
        for x in sorted(cuts):
            if bounds[-1] + eps < x < right - eps:
                bounds.append(x)
        for a, b in zip(bounds, [*bounds[1:], right], strict=True):
            yield a, b, sorted(((y(e, a), y(e, b), e[4]) for e in active), key=lambda s: (s[0] + s[1], s))


def areas(first: list[Part], second: list[Part]) -> tuple[float, float, float]:
    """(area of the first, of the second, of what they share); parts of one side that overlap count once."""
    sides = (1 << len(first)) - 1
    a = b = both = 0.0
    for left, right, edges in strips(first + second):
        mask = 0
        for (y0, y1, k), (z0, z1, _) in zip(edges, edges[1:], strict=False):
            mask ^= 1 << k
            if mask:
                area = (z0 - y0 + z1 - y1) * (right - left) / 2
                own, other = mask & sides, mask & ~sides
                a += area if own else 0.0
                b += area if other else 0.0
                both += area if own and other else 0.0
    return a, b, both


def region(parts: list[Part], wanted: Callable[[int], bool] = bool) -> list[Part]:
    """Parts (shell against the clock first, then holes) of where wanted(bits of the parts that hold a point) is true; a union by default."""
    found, heights = [], {}
    for left, right, edges in strips(parts):
        mask, gaps = 0, []
        for (y0, y1, k), (z0, z1, _) in zip(edges, edges[1:], strict=False):
            mask ^= 1 << k
            if wanted(mask):
                gaps.append((y0, y1, z0, z1))
        found.append((left, right, gaps))
        for y0, y1, z0, z1 in gaps:
            heights.setdefault(left, []).extend((y0, z0))
            heights.setdefault(right, []).extend((y1, z1))
    if not heights:
        return []
    points = [p for part in parts for ring in part for p in ring]
    scale = max(max(p[i] for p in points) - min(p[i] for p in points) for i in (0, 1))
    at = {x: _snapped(ys, 4 * SNAP * scale) for x, ys in heights.items()}
    outs: dict[tuple, list[tuple]] = {}
    beside: dict[float, tuple[dict, dict]] = {x: ({}, {}) for x in heights}  # changes of cover along an upright line, at its left and right
    for left, right, gaps in found:
        merged: list[list[float]] = []
        for y0, y1, z0, z1 in gaps:
            gap = [at[left][y0], at[right][y1], at[left][z0], at[right][z1]]
            if gap[:2] == gap[2:]:
                continue
            if merged and merged[-1][2:] == gap[:2]:
                merged[-1][2:] = gap[2:]
            else:
                merged.append(gap)
        for y0, y1, z0, z1 in merged:
            outs.setdefault((left, y0), []).append((right, y1))
            outs.setdefault((right, z1), []).append((left, z0))
            for cover, low, high in ((beside[left][1], y0, z0), (beside[right][0], y1, z1)):
                cover[low] = cover.get(low, 0) + 1
                cover[high] = cover.get(high, 0) - 1
    for x, (lefts, rights) in beside.items():
        ys, held = sorted(set(lefts) | set(rights)), [0, 0]
        for low, high in zip(ys, ys[1:], strict=False):
            held[0] += lefts.get(low, 0)
            held[1] += rights.get(low, 0)
            if held[0] and not held[1]:
                outs.setdefault((x, low), []).append((x, high))
            elif held[1] and not held[0]:
                outs.setdefault((x, high), []).append((x, low))
    return _nested([r for loop in _loops(outs) for r in _simple(loop, scale)])


def _loops(outs: dict[tuple, list[tuple]]) -> Iterator[Ring]:
    """Closed walks along directed edges, turning left as far as can be."""

    def turn(a: tuple, b: tuple, c: tuple) -> float:
        ux, uy, vx, vy = b[0] - a[0], b[1] - a[1], c[0] - b[0], c[1] - b[1]
        return math.atan2(ux * vy - uy * vx, ux * vx + uy * vy)

    left = {(a, b) for a, ends in outs.items() for b in ends}
    for a in sorted(outs):
        for b in sorted(outs[a]):
            loop = []
            while (a, b) in left:
                left.remove((a, b))
                loop.append(a)
                a, b = b, max(outs[b], key=lambda c, a=a, b=b: turn(a, b, c))
            if loop:
                yield loop


def _simple(loop: Ring, scale: float) -> list[Ring]:
    """Rings that meet no point twice, without points that lie on a line with those beside them."""
    rings, walked, place = [], [], {}
    for p in [*loop, loop[0]]:
        if p in place:
            start = place[p]
            rings.append(walked[start:])
            for q in walked[start + 1 :]:
                del place[q]
            del walked[start + 1 :]
        else:
            place[p] = len(walked)
            walked.append(p)
    out = []
    for ring in rings:
        kept: Ring = []
        for i, (bx, by) in enumerate(ring):
            ax, ay = kept[-1] if kept else ring[i - 1]
            cx, cy = ring[(i + 1) % len(ring)]
            far = max(abs(cx - ax), abs(cy - ay))
            if abs((bx - ax) * (cy - ay) - (by - ay) * (cx - ax)) > 16 * SNAP * scale * far:
                kept.append((bx, by))
        if len(kept) > 2 and abs(ring_area(kept)) > SNAP * scale * scale:
            least = kept.index(min(kept))
            out.append(kept[least:] + kept[:least])
    return out


def _holds(ring: Ring, x: float, y: float) -> bool:
    inside = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            inside = not inside
    return inside


def _nested(rings: list[Ring]) -> list[Part]:
    """Shells, each with its holes (rings that turn with the clock); a hole belongs to the smallest shell around it."""
    shells = sorted((ring_area(r), r) for r in rings if ring_area(r) > 0)
    parts: list[Part] = [[r] for _, r in shells]
    for hole in sorted(r for r in rings if ring_area(r) < 0):
        (ax, ay), (bx, by) = hole[0], hole[1]
        for part in parts:
            if _holds(part[0], (ax + bx) / 2, (ay + by) / 2):
                part.append(hole)
                break
    return sorted(parts)


def parts_area(parts: list[Part]) -> float:
    """The area of parts that overlap nothing: shells less holes."""
    return sum(abs(ring_area(p[0])) - sum(abs(ring_area(h)) for h in p[1:]) for p in parts)


def parts_centroid(parts: list[Part]) -> tuple[float, float]:
    """Of shells less holes; the mean of the points where there is no area."""
    points = [p for part in parts for ring in part for p in ring]
    ox, oy = points[0]
    total = mx = my = 0.0
    for part in parts:
        for i, ring in enumerate(part):
            sign = (1 if ring_area(ring) > 0 else -1) * (-1 if i else 1)
            for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
                ax, ay, bx, by = ax - ox, ay - oy, bx - ox, by - oy
                c = sign * (ax * by - bx * ay)
                total, mx, my = total + c / 2, mx + (ax + bx) * c / 6, my + (ay + by) * c / 6
    if abs(total) < 1e-12:
        return sum(p[0] for p in points) / len(points), sum(p[1] for p in points) / len(points)
    return mx / total + ox, my / total + oy


def overlap_ratio(first: list[Part], second: list[Part], aligned: bool) -> float:
    """Shared area over joint area, the second moved to the first's centroid if aligned; 0 without joint area."""
    if not first or not second:
        return 0.0
    if aligned:
        (ax, ay), (bx, by) = parts_centroid(first), parts_centroid(second)
        second = [[[(x + ax - bx, y + ay - by) for x, y in ring] for ring in part] for part in second]
    a, b, both = areas(first, second)
    return both / (a + b - both) if a + b - both > 0 else 0.0


# ---- upright rectangles, a batch at once


def upright(start: np.ndarray, end: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which rings are the border of an upright rectangle walked once, their boxes as xmin, ymin, xmax, ymax); ring i has the points from start[i] to end[i].

    It may turn either way, be closed or not, and have points between its corners; those that aren't such have no box.
    """
    found, boxes = np.zeros(len(start), bool), np.full((len(start), 4), np.nan)
    rows = np.flatnonzero(end - start >= 4)
    if not len(rows):
        return found, boxes
    sizes = end[rows] - start[rows]
    first = np.cumsum(sizes) - sizes
    flat = np.arange(sizes.sum()) + np.repeat(start[rows] - first, sizes)
    x, y = xs[flat], ys[flat]
    box = np.column_stack([f.reduceat(v, first) for f in (np.minimum, np.maximum) for v in (x, y)])
    x0, y0, x1, y1 = np.repeat(box, sizes, axis=0).T
    following = np.arange(1, len(flat) + 1)
    following[first + sizes - 1] = first
    with np.errstate(divide="ignore", invalid="ignore"):  # the place along the border, whole at the corners
        at = np.select([y == y0, x == x1, y == y1, x == x0], [(x - x0) / (x1 - x0), 1 + (y - y0) / (y1 - y0), 2 + (x1 - x) / (x1 - x0), 3 + (y1 - y) / (y1 - y0)], np.nan)
    ok = np.zeros(len(rows), bool)
    for place in (at, np.where(at > 0, 4 - at, at)):
        after = place[following]
        round_ = (after == 0) & (place >= 3)
        step = round_ | ((after >= place) & (after <= np.floor(place) + 1))  # edges stay on a side
        ok |= np.logical_and.reduceat(step, first) & (np.add.reduceat(round_.astype(int), first) == 1)
    ok &= (box[:, 2] > box[:, 0]) & (box[:, 3] > box[:, 1]) & np.isfinite(box).all(axis=1)
    found[rows[ok]], boxes[rows[ok]] = True, box[ok]
    return found, boxes


def upright_rows(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As upright, of rings or shapes; a shape must be one part of one ring."""
    ok, start, end, inner = values.is_valid().to_numpy(zero_copy_only=False), values.offsets.to_numpy()[:-1], values.offsets.to_numpy()[1:], values.values
    while not pa.types.is_struct(inner.type):
        ok = ok & (end - start == 1)
        if not ok.any():
            return upright(np.zeros(len(ok), int), np.zeros(len(ok), int), np.zeros(0), np.zeros(0))
        own = np.where(ok, start, start[ok][0])
        ok = ok & inner.is_valid().to_numpy(zero_copy_only=False)[own]
        start, end, inner = inner.offsets.to_numpy()[own], inner.offsets.to_numpy()[own + 1], inner.values
    xs, ys = (inner.field(c).to_numpy(zero_copy_only=False) for c in "xy")
    if inner.null_count:
        here = inner.is_valid().to_numpy(zero_copy_only=False)
        xs, ys = np.where(here, xs, np.nan), np.where(here, ys, np.nan)
    return upright(np.where(ok, start, 0), np.where(ok, end, 0), xs, ys)


# ---- columns


def as_shape(ring: Column) -> Column:
    """A ring as a shape of one part."""
    return F.array(F.array(ring))


def shape_area(shape: Column) -> Column:
    """The area of a valid shape, in columns: each part's first ring less the others."""
    size = lambda r: F.abs(moments(_near(r))["a"])
    part = lambda p: F.aggregate(p, F.struct(F.lit(0.0).alias("a"), F.lit(0).alias("i")), lambda s, r: F.struct((s["a"] + F.when(s["i"] == 0, size(r)).otherwise(-size(r))).alias("a"), (s["i"] + 1).alias("i")))["a"]
    return F.aggregate(shape, F.lit(0.0), lambda s, p: s + part(p))


def largest_part(shape: Column) -> Column:
    """The part of the largest area, as a shape of one part; null without parts."""
    sized = F.transform(shape, lambda p: F.struct(shape_area(F.array(p)).alias("area"), p.alias("part")))
    return F.when(F.size(shape) > 0, F.array(F.element_at(F.array_sort(sized), -1)["part"]))


def _near(ring: Column) -> Column:
    """The ring about its first point, which keeps small shapes far from the origin exact."""
    first = F.get(ring, F.lit(0))
    return F.transform(ring, lambda p: F.struct((p["x"] - first["x"]).alias("x"), (p["y"] - first["y"]).alias("y")))


def by_row(run: Callable, kind: str, arrow: pa.DataType, *columns: Column, boxes: Callable | None = None) -> Column:
    """run of each row's values, in Arrow batches. Where all of a row's values are upright rectangles, boxes gives the result from their boxes, for a batch at once."""

    def slow(values: list[pa.Array]) -> pa.Array:
        return pa.array([run(*row) for row in zip(*(v.to_pylist() for v in values), strict=True)], arrow)

    def batches(*values: pa.Array) -> pa.Array:
        if boxes is None:
            return slow(values)
        known = [upright_rows(v) for v in values]
        sure = np.logical_and.reduce([k for k, _ in known])
        quick = boxes(*(b[sure] for _, b in known))
        if sure.all():
            return quick
        rest = slow([v.filter(pa.array(~sure)) for v in values])
        place = np.where(sure, np.cumsum(sure) - 1, len(quick) + np.cumsum(~sure) - 1)
        return pa.concat_arrays([quick, rest]).take(pa.array(place))

    # the number of arguments is read from the signature
    one, two = (lambda a: batches(a)), (lambda a, b: batches(a, b))
    f = one if len(columns) == 1 else two
    f.__annotations__ = {name: pa.Array for name in ("a", "b", "return")[: len(columns)]} | {"return": pa.Array}
    return F.arrow_udf(f, kind)(*columns)


def _columns_of(arrow: pa.DataType, *values: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(v) for v in values], fields=list(arrow))


def shape_extent(shape: Column) -> Column:
    """struct(area, west, east, south, north, upright): the area, how far a ring or a shape reaches from its centroid, and whether it is an upright rectangle; null without parts."""

    def run(value):
        parts = parts_of(value)
        if not parts:
            return None
        (cx, cy), points = parts_centroid(parts), [p for part in parts for ring in part for p in ring]
        xs, ys = [p[0] for p in points], [p[1] for p in points]
        return {"area": areas(parts, [])[0], "west": cx - min(xs), "east": max(xs) - cx, "south": cy - min(ys), "north": max(ys) - cy, "upright": False}

    def boxes(b: np.ndarray) -> pa.Array:
        w, h = b[:, 2] - b[:, 0], b[:, 3] - b[:, 1]
        return _columns_of(arrow, w * h, w / 2, w / 2, h / 2, h / 2, np.ones(len(b), bool))

    names = ("area", "west", "east", "south", "north")
    arrow = pa.struct([*[(n, pa.float64()) for n in names], ("upright", pa.bool_())])
    return by_row(run, f"struct<{','.join(f'{n}:double' for n in names)},upright:boolean>", arrow, shape, boxes=boxes)


def overlap_bound(a: Column, b: Column) -> Column:
    """What shape_overlap of two aligned shapes can't exceed, by their extents: they share no more than either's area, nor than their boxes share. Of two upright rectangles it is the overlap."""
    side = lambda low, high: F.greatest(F.least(a[low], b[low]) + F.least(a[high], b[high]), F.lit(0.0))
    shared = F.least(a["area"], b["area"], side("west", "east") * side("south", "north"))
    return F.coalesce(F.least(shared / F.nullif(a["area"] + b["area"] - shared, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def shape_centroid(shape: Column) -> Column:
    """struct(x, y) of the area; null without parts."""

    def run(value):
        parts = parts_of(value)
        return dict(zip("xy", parts_centroid(parts), strict=True)) if parts else None

    def boxes(b: np.ndarray) -> pa.Array:
        return _columns_of(_POINT, b[:, 0] + (b[:, 2] - b[:, 0]) / 2, b[:, 1] + (b[:, 3] - b[:, 1]) / 2)

    return by_row(run, POINT, _POINT, shape, boxes=boxes)


def repair_shape(shape: Column) -> Column:
    """struct(shape, repaired): what an odd number of a part's rings hold, as valid parts, of a ring, a part or a shape; repaired tells whether the area or the number of rings changed.

    Parts that overlap are joined; null, empty and flat ones give no parts.
    """

    def run(value):
        given = parts_of(value)
        made = region(given)
        changed = sum(map(len, made)) != sum(map(len, given)) or abs(parts_area(made) - parts_area(given)) > 1e-6 * max(parts_area(made), 1e-12)
        return {"shape": as_value(made), "repaired": changed}

    return by_row(run, f"struct<shape:{SHAPE},repaired:boolean>", pa.struct([("shape", _SHAPE), ("repaired", pa.bool_())]), shape)


def union_shapes(shapes: Column) -> Column:
    """The union of an array of shapes, as a shape; null gives no parts."""
    return by_row(lambda own: as_value(region([p for s in own or [] for p in parts_of(s)])), SHAPE, _SHAPE, shapes)


def shape_overlap(a: Column, b: Column, aligned: bool = False) -> Column:
    """Shared over joint area of rings or shapes; aligned moves b to a's centroid."""

    def boxes(p: np.ndarray, q: np.ndarray) -> pa.Array:
        own, other = p[:, 2:] - p[:, :2], q[:, 2:] - q[:, :2]
        sides = np.minimum(own, other) if aligned else np.maximum(np.minimum(p[:, 2:], q[:, 2:]) - np.maximum(p[:, :2], q[:, :2]), 0.0)
        both = sides.prod(axis=1)
        return pa.array(both / (own.prod(axis=1) + other.prod(axis=1) - both))

    return by_row(lambda x, y: overlap_ratio(parts_of(x), parts_of(y), aligned), "double", pa.float64(), a, b, boxes=boxes)
