"""Polygon kernels in numpy, applied by pandas and Arrow UDFs: long axis, contact and groups that touch. Rings are arrays of (x, y); overlay.py has repair, union and overlap."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.overlay import by_row, parts_of, upright

RING = "array<struct<x:double,y:double>>"


def as_array(ring) -> np.ndarray:
    if ring is None or not len(ring):
        return np.zeros((0, 2))
    return as_points(np.array([(p["x"], p["y"]) for p in ring], float))


def as_points(pts: np.ndarray) -> np.ndarray:
    """Points without those that repeat the one before, or at the end the first."""
    if len(pts) > 1 and (pts[0] == pts[-1]).all():
        pts = pts[:-1]
    keep = np.ones(len(pts), bool)
    keep[1:] = (pts[1:] != pts[:-1]).any(axis=1)
    return pts[keep]


def signed_area(p: np.ndarray) -> float:
    if len(p) < 3:
        return 0.0
    q = np.roll(p, -1, axis=0)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2)


def convex_hull(p: np.ndarray) -> np.ndarray:
    pts = sorted(set(map(tuple, p)))
    if len(pts) < 3:
        return np.array(pts, float).reshape(-1, 2)

    def half(points):
        out: list = []
        for a in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (a[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (a[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(a)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]), float)


def long_axis(p: np.ndarray) -> tuple[float, float] | None:
    """(degrees of the long side of the smallest rectangle around a ring, 1 - short / long)."""
    hull = convex_hull(p)
    if len(hull) < 3:
        return None
    d = np.roll(hull, -1, axis=0) - hull
    best = None
    for angle in np.arctan2(d[:, 1], d[:, 0]):
        c, s = math.cos(angle), math.sin(angle)
        u, v = hull @ (c, s), hull @ (-s, c)
        w, h = np.ptp(u), np.ptp(v)
        if best is None or w * h < best[0] - 1e-12:
            best = (w * h, w, h, angle)
    _, w, h, angle = best
    degrees = math.degrees(angle if w >= h else angle + math.pi / 2) % 180.0
    return degrees, 1 - min(w, h) / max(w, h)


def rings_touch(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two simple rings' polygons share a point, borders included."""
    if len(a) < 3 or len(b) < 3 or (a.max(0) < b.min(0)).any() or (b.max(0) < a.min(0)).any():
        return False
    p, q, r, s = a, np.roll(a, -1, axis=0), b, np.roll(b, -1, axis=0)
    turn = lambda o, x, y: (x[..., 0] - o[..., 0]) * (y[..., 1] - o[..., 1]) - (x[..., 1] - o[..., 1]) * (y[..., 0] - o[..., 0])
    P, Q, R, S = p[:, None], q[:, None], r[None], s[None]
    d1, d2, d3, d4 = turn(P, Q, R), turn(P, Q, S), turn(R, S, P), turn(R, S, Q)
    box = (np.minimum(P, Q) <= np.maximum(R, S)).all(-1) & (np.minimum(R, S) <= np.maximum(P, Q)).all(-1)
    if (box & (d1 * d2 <= 0) & (d3 * d4 <= 0)).any():
        return True

    def inside(x, ring):
        n = np.roll(ring, -1, axis=0)
        cross = (ring[:, 1] > x[1]) != (n[:, 1] > x[1])
        with np.errstate(divide="ignore", invalid="ignore"):
            at = (n[:, 0] - ring[:, 0]) * (x[1] - ring[:, 1]) / (n[:, 1] - ring[:, 1]) + ring[:, 0]
        return bool((cross & (x[0] < at)).sum() % 2)

    return inside(a[0], b) or inside(b[0], a)


def upright_boxes(at: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Which rings are upright rectangles; ring i has the points from at[i] to at[i + 1]."""
    return upright(at[:-1], at[1:], xs, ys)[0]


def joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels (each the smallest place of its group) after the groups of a[i] and b[i] have become one."""
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return labels
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        to = np.arange(len(labels))
        np.minimum.at(to, np.maximum(la, lb), np.minimum(la, lb))
        while (to[to] != to).any():
            to = to[to]
        labels = to[labels]


def touching_labels(boxes: np.ndarray, upright: np.ndarray, ring_of: Callable[[int], np.ndarray], block: int = 1_000_000) -> np.ndarray:
    """The smallest place in each one's group of polygons that touch; boxes (xmin, ymin, xmax, ymax) ascend by xmin, upright tells which polygons are their boxes.

    Pairs whose boxes meet are made block by block; those of upright rectangles touch, others are tested as long as they stand in different groups.
    """
    x0, y0, x1, y1 = boxes.T
    labels = np.arange(len(boxes))
    ends = np.searchsorted(x0, x1, "right")  # those from the next one to here begin before a box ends
    counts = np.maximum(ends - np.arange(len(boxes)) - 1, 0)
    before = np.concatenate([[0], np.cumsum(counts)])
    first = 0
    while first < len(boxes):
        last = max(first + 1, int(np.searchsorted(before, before[first] + block, "right")) - 1)
        n = counts[first:last]
        a = np.repeat(np.arange(first, last), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(before[first:last] - before[first], n)
        meet = (y0[a] <= y1[b]) & (y0[b] <= y1[a])
        a, b = a[meet], b[meet]
        sure = upright[a] & upright[b]
        labels = joined(labels, a[sure], b[sure])
        for i, j in zip(a[~sure], b[~sure], strict=True):
            if labels[i] != labels[j] and rings_touch(ring_of(i), ring_of(j)):
                low, high = sorted((labels[i], labels[j]))
                labels[labels == high] = low
        first = last
    return labels


def orientation_elongation(ring: Column) -> Column:
    """struct(orientation, elongation) of the smallest rectangle around a ring or a shape; nulls for a degenerate one."""
    arrow = pa.struct([("orientation", pa.float64()), ("elongation", pa.float64())])

    def run(value):
        points = np.array([p for part in parts_of(value) for p in part[0]], float).reshape(-1, 2)
        return dict(zip(("orientation", "elongation"), long_axis(points) or (None, None), strict=True))

    def boxes(b: np.ndarray) -> pa.Array:
        w, h = b[:, 2] - b[:, 0], b[:, 3] - b[:, 1]
        return pa.StructArray.from_arrays([pa.array(np.where(w >= h, 0.0, 90.0)), pa.array(1 - np.minimum(w, h) / np.maximum(w, h))], fields=list(arrow))

    return by_row(run, "struct<orientation:double,elongation:double>", arrow, ring, boxes=boxes)


def touches(a: Column, b: Column) -> Column:
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([rings_touch(as_array(x), as_array(y)) for x, y in zip(a, b, strict=True)], dtype=bool)

    return F.pandas_udf(run, "boolean")(a, b)
