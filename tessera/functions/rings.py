"""Polygon rings as arrays of points, by higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICRONS_PER_PIXEL = 0.2125


def build_polygon(vertices: DataFrame) -> DataFrame:
    """wsi, cell_id, ring: vertices of each cell in the order of seq, the closing repeat dropped; rings of under three points go."""
    ring = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col("vertex_x").alias("x"), F.col("vertex_y").alias("y")))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    rows = vertices.filter(F.col("vertex_x").isNotNull() & F.col("vertex_y").isNotNull()).groupBy("wsi", "cell_id").agg(ring.alias("ring"))
    closed = (F.size("ring") > 1) & (F.element_at("ring", 1) == F.element_at("ring", -1))
    return rows.withColumn("ring", F.when(closed, F.slice("ring", F.lit(1), F.size("ring") - 1)).otherwise(F.col("ring"))).filter(F.size("ring") >= 3)


def affine(ring: Column, inverse: Column, mpp: float = MICRONS_PER_PIXEL) -> Column:
    """inverse @ (x, y, mpp) of each point, divided by mpp."""
    at = lambda i, j: F.get(F.get(inverse, F.lit(i)), F.lit(j))
    axis = lambda p, i: (at(i, 0) * p["x"] + at(i, 1) * p["y"] + at(i, 2) * mpp) / mpp
    return F.transform(ring, lambda p: F.struct(axis(p, 0).alias("x"), axis(p, 1).alias("y")))


def to_crop_frame(ring: Column, x0: Column, y0: Column, scale) -> Column:
    return F.transform(ring, lambda p: F.struct(((p["x"] - x0) * scale).alias("x"), ((p["y"] - y0) * scale).alias("y")))


def bbox(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def edges(ring: Column) -> Column:
    """array of (p, q): each point with the next, the last with the first."""
    turned = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, turned, lambda p, q: F.struct(p.alias("p"), q.alias("q")))


_NAMES = ("a", "mx", "my", "ixx", "iyy", "ixy")


def moments(ring: Column) -> Column:
    """Signed area, first and second moments about the origin. Moments of holes (opposite turn) subtract when added."""

    def step(s: Column, e: Column) -> Column:
        x1, y1, x2, y2 = e["p"]["x"], e["p"]["y"], e["q"]["x"], e["q"]["y"]
        c = x1 * y2 - x2 * y1
        terms = (
            c / 2, (x1 + x2) * c / 6, (y1 + y2) * c / 6, (y1 * y1 + y1 * y2 + y2 * y2) * c / 12, (x1 * x1 + x1 * x2 + x2 * x2) * c / 12,
            (x1 * y2 + 2 * x1 * y1 + 2 * x2 * y2 + x2 * y1) * c / 24,
        )
        return F.struct(*[(s[n] + t).alias(n) for n, t in zip(_NAMES, terms, strict=True)])

    return F.aggregate(edges(ring), F.struct(*[F.lit(0.0).alias(n) for n in _NAMES]), step)


def descriptors(m: Column) -> Column:
    """struct(area, eccentricity, orientation) of moments: the axis in degrees from 0 to 180; 0, 0 for symmetric shapes; null without area."""
    cx, cy = m["mx"] / m["a"], m["my"] / m["a"]
    xx, yy, xy = m["iyy"] - m["a"] * cx * cx, m["ixx"] - m["a"] * cy * cy, m["ixy"] - m["a"] * cx * cy
    common, both = F.hypot(xx - yy, 2 * xy), xx + yy
    symmetric = (both <= 1e-9) | (common < 1e-9)
    ecc = F.sqrt(F.greatest(F.lit(0.0), 1 - (both - common) / (both + common)))
    axis = F.pmod(F.degrees(F.atan2(2 * xy, xx - yy) / 2), F.lit(180.0))
    out = F.struct(F.abs(m["a"]).alias("area"), F.when(symmetric, F.lit(0.0)).otherwise(ecc).alias("eccentricity"), F.when(symmetric, F.lit(0.0)).otherwise(axis).alias("orientation"))
    return F.when(F.abs(m["a"]) >= 1e-6, out)


def centroid(m: Column) -> Column:
    return F.struct((m["mx"] / m["a"]).alias("x"), (m["my"] / m["a"]).alias("y"))


def shape_descriptors(df: DataFrame, ring: str = "ring") -> DataFrame:
    """df with area, eccentricity, orientation, cx, cy. Moments are taken about the ring's first point, which keeps small shapes far from the origin exact."""
    rows = df.withColumn("_o", F.get(ring, F.lit(0)))
    near = F.transform(F.col(ring), lambda p: F.struct((p["x"] - F.col("_o.x")).alias("x"), (p["y"] - F.col("_o.y")).alias("y")))
    rows = rows.withColumn("_m", moments(near)).withColumn("_d", descriptors(F.col("_m"))).withColumn("_c", centroid(F.col("_m")))
    return rows.select(*df.columns, "_d.area", "_d.eccentricity", "_d.orientation", (F.col("_c.x") + F.col("_o.x")).alias("cx"), (F.col("_c.y") + F.col("_o.y")).alias("cy"))


def point_in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule."""

    def crosses(e: Column) -> Column:
        x1, y1, x2, y2 = e["p"]["x"], e["p"]["y"], e["q"]["x"], e["q"]["y"]
        return ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)

    return F.size(F.filter(edges(ring), crosses)) % 2 == 1


def ring_meets_box(ring: Column, bx0: Column, by0: Column, bx1: Column, by1: Column) -> Column:
    """Whether a ring's polygon and a closed box share a point: a corner of the box inside, or an edge that enters it."""

    def enters(e: Column) -> Column:  # slab test of a segment against the box
        x1, y1, dx, dy = e["p"]["x"], e["p"]["y"], e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]

        def slab(p, d, low, high):
            a, b = (low - p) / d, (high - p) / d
            inside = (p >= low) & (p <= high)
            return F.when(d != 0, F.least(a, b)).when(inside, F.lit(0.0)).otherwise(F.lit(2.0)), F.when(d != 0, F.greatest(a, b)).when(inside, F.lit(1.0)).otherwise(F.lit(-1.0))

        ax, bx = slab(x1, dx, bx0, bx1)
        ay, by = slab(y1, dy, by0, by1)
        return F.greatest(ax, ay, F.lit(0.0)) <= F.least(bx, by, F.lit(1.0))

    return F.exists(edges(ring), enters) | point_in_ring(ring, bx0, by0)


def token_overlap(df: DataFrame, keys: list[str], token: float, side: int, ring: str = "ring", x0: str = "x0", y0: str = "y0") -> DataFrame:
    """keys, row, col of each token of the side x side grid at (x0, y0) whose closed box meets the polygon. Only tokens of the polygon's box are tried."""
    rows = df.withColumn("_b", bbox(F.col(ring)))
    low = lambda v, o: F.greatest(F.lit(0), F.floor((v - F.col(o)) / token).cast("int"))
    high = lambda v, o: F.least(F.lit(side - 1), F.floor((v - F.col(o)) / token).cast("int"))
    span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("row", F.explode(span(low(F.col("_b.ymin"), y0), high(F.col("_b.ymax"), y0)))).withColumn("col", F.explode(span(low(F.col("_b.xmin"), x0), high(F.col("_b.xmax"), x0))))
    bx, by = F.col(x0) + F.col("col") * float(token), F.col(y0) + F.col("row") * float(token)
    return rows.filter(ring_meets_box(F.col(ring), bx, by, bx + token, by + token)).select(*keys, "row", "col")


def nearest_token(cx: Column, cy: Column, x0: Column, y0: Column, token: float, side: int) -> Column:
    at = lambda c, o: F.greatest(F.lit(0), F.least(F.lit(side - 1), F.bround((c - o) / token - 0.5, 0).cast("int")))
    return F.struct(at(cy, y0).alias("row"), at(cx, x0).alias("col"))
