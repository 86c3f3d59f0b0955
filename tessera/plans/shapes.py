"""Queries over polygons with holes: overlay, repair, matching by shape, nested geometry files; and their SQL in closed form on rectangles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import overlay, polygons, rings
from tessera.operators import space
from tessera.plans import domain as d
from tessera.plans.domain import POLY
from tessera.plans.queries import query, r6, rounded
from tessera.sources import readers, sinks
from tessera.sources.storage import scratch, stored


def _rectangle(x0, y0, w, h):
    at = lambda dx, dy: F.struct((x0 + dx).alias("x"), (y0 + dy).alias("y"))
    zero = F.lit(0.0)
    return F.array(at(zero, zero), at(w, zero), at(w, h), at(zero, h))


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rectangles, so close that many touch, in fields of 2,000 keys."""
    key = F.col("key")
    rows = d.polygons(spark, sf_dir).withColumns({"x0": (key * 37 % 401).cast("double"), "y0": (key * 91 % 199 + 200 * F.floor(key / 2000)).cast("double")})
    return rows.withColumn("ring", _rectangle(F.col("x0"), F.col("y0"), F.col("w"), F.col("h")))


DENSE = f"{POLY}, dense AS (SELECT wsi, key, cell_id, w, h, CAST(key * 37 % 401 AS DOUBLE) AS x0, CAST(key * 91 % 199 + 200 * (key // 2000) AS DOUBLE) AS y0 FROM poly)"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rectangles of even and of odd keys, with centres and long axes; the odd ones turn the other way and have one more point."""
    rows = d.polygons(spark, sf_dir).withColumns({"x": F.col("x0") + F.col("w") / 2, "y": F.col("y0") + F.col("h") / 2})
    middle = F.array(F.struct(F.col("x").alias("x"), F.col("y0").alias("y")))
    turned = rows.withColumn("ring", F.when(F.col("key") % 2 == 0, F.col("ring")).otherwise(F.reverse(F.concat(F.slice("ring", 1, 1), middle, F.slice("ring", 2, 3)))))
    turned = turned.withColumn("axis", polygons.orientation_elongation(F.col("ring"))).select("*", "axis.*")
    return turned.filter("key % 2 = 0"), turned.filter("key % 2 = 1")


_SIDES = f"""{POLY}, sides AS (SELECT *, x0 + w / 2 AS x, y0 + h / 2 AS y, CAST(CASE WHEN w >= h THEN 0 ELSE 90 END AS DOUBLE) AS o, 1 - least(w, h) / greatest(w, h) AS e FROM poly),
near AS (SELECT a.wsi, a.key % 2 AS odd, a.cell_id, b.cell_id AS other_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS dist, b.x - a.x AS dx, b.y - a.y AS dy, abs(a.o - b.o) AS angle, least(a.e, b.e) AS el,
  least(a.w, b.w) * least(a.h, b.h) / (a.w * a.h + b.w * b.h - least(a.w, b.w) * least(a.h, b.h)) AS iou FROM sides a JOIN sides b ON a.wsi = b.wsi AND a.key % 2 <> b.key % 2 AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 10000)"""


@query(f"""WITH {_SIDES}, w(name, wd, wo, wi) AS (VALUES ('even', 1.0, 1.0, 1.0), ('shape', 1.0, 1.2, 5.0)),
s AS (SELECT near.*, name, 1 / (1 + dist / 15) AS ds, 1 - angle / 90 AS os, wd / (1 + dist / 15) + wo * (1 - angle / 90) + wi * iou AS score,
  row_number() OVER (PARTITION BY wsi, cell_id, name ORDER BY round(wd / (1 + dist / 15) + wo * (1 - angle / 90) + wi * iou, 10) DESC, other_id) AS r FROM near, w WHERE odd = 0 AND dist <= 80)
SELECT p.wsi, p.cell_id, w.name, other_id, round(ds, 6) AS distance_score, round(os, 6) AS orientation_score, round(iou, 6) AS iou_score, round(score, 6) AS score
FROM sides p CROSS JOIN w LEFT JOIN s ON s.wsi = p.wsi AND s.cell_id = p.cell_id AND s.name = w.name AND r = 1 WHERE p.key % 2 = 0""")
def j1_match_with_shapes(spark, sf_dir):
    even, odd = _sides(spark, sf_dir)
    weightings = spark.createDataFrame([("even", 1.0, 1.0, 1.0), ("shape", 1.0, 1.2, 5.0)], "name string, w_distance double, w_orientation double, w_iou double")
    return rounded(space.match_by_radius(even, odd, weightings, shapes=True), "distance_score", "orientation_score", "iou_score", "score")


@query(f"""WITH {_SIDES}, s AS (SELECT *, iou - 0.5 * least(dist / 100, 1) - 0.5 * el * least(angle / 90, 1) AS score,
  row_number() OVER (PARTITION BY wsi, cell_id ORDER BY round(iou - 0.5 * least(dist / 100, 1) - 0.5 * el * least(angle / 90, 1), 10) DESC, other_id) AS r FROM near WHERE odd = 1)
SELECT p.wsi, p.cell_id, other_id, round(iou, 6) AS iou, round(dist, 6) AS distance, round(angle, 6) AS angle, round(score, 6) AS score, dx, dy FROM sides p LEFT JOIN s ON s.wsi = p.wsi AND s.cell_id = p.cell_id AND r = 1 WHERE p.key % 2 = 1""")
def j2_match_merged(spark, sf_dir):
    even, odd = _sides(spark, sf_dir)
    return rounded(space.match_merged(odd, even), "iou", "distance", "angle", "score")


_GROUPS = f"""{DENSE}, p AS (SELECT a.wsi, a.cell_id AS a, b.cell_id AS b FROM dense a JOIN dense b ON a.wsi = b.wsi AND a.cell_id <> b.cell_id AND a.x0 <= b.x0 + b.w AND b.x0 <= a.x0 + a.w AND a.y0 <= b.y0 + b.h AND b.y0 <= a.y0 + a.h),
r AS (SELECT wsi, cell_id, cell_id AS c FROM dense UNION SELECT r.wsi, r.cell_id, p.b FROM r JOIN p ON p.wsi = r.wsi AND p.a = r.c),
l AS (SELECT wsi, cell_id, min(c) AS component FROM r GROUP BY wsi, cell_id), m AS (SELECT * FROM l JOIN dense USING (wsi, cell_id))"""


@query(f"""WITH RECURSIVE {_GROUPS}, units AS (SELECT DISTINCT wsi, component, x, y FROM (SELECT wsi, component, y0, h, unnest(range(CAST(x0 AS BIGINT), CAST(x0 + w AS BIGINT))) AS x FROM m), LATERAL (SELECT unnest(range(CAST(y0 AS BIGINT), CAST(y0 + h AS BIGINT))) AS y)),
u AS (SELECT wsi, component, CAST(count(*) AS DOUBLE) AS area, avg(x + 0.5) AS cx, avg(y + 0.5) AS cy FROM units GROUP BY ALL), g AS (SELECT wsi, component, count(*) AS n_members FROM m GROUP BY ALL)
SELECT wsi, component, n_members, area, round(cx, 4) AS cx, round(cy, 4) AS cy FROM g JOIN u USING (wsi, component)""")
def g9_merged_shapes(spark, sf_dir):
    merged = space.merged_shapes(_dense(spark, sf_dir).select("wsi", "cell_id", "ring"))
    found = merged.withColumn("c", overlay.shape_centroid(F.col("shape")))
    return found.select("wsi", "component", "n_members", r6(overlay.shape_area(F.col("shape"))).alias("area"), F.round("c.x", 4).alias("cx"), F.round("c.y", 4).alias("cy"))


@query(f"""WITH RECURSIVE {_GROUPS}, box AS (SELECT wsi, component, min(x0) AS x0, min(y0) AS y0, max(x0 + w) - min(x0) AS w, max(y0 + h) - min(y0) AS h FROM m GROUP BY ALL),
b AS (SELECT *, x0 + w / 2 AS x, y0 + h / 2 AS y, CAST(CASE WHEN w >= h THEN 0 ELSE 90 END AS DOUBLE) AS o, 1 - least(w, h) / greatest(w, h) AS e FROM box),
c AS (SELECT wsi, 'n' || cell_id AS other_id, x0 + 9 + w / 2 AS x, y0 - 4 + h / 2 AS y, w, h, CAST(CASE WHEN w >= h THEN 0 ELSE 90 END AS DOUBLE) AS o, 1 - least(w, h) / greatest(w, h) AS e FROM dense WHERE key % 3 = 0),
near AS (SELECT b.wsi, component, other_id, c.x - b.x AS dx, c.y - b.y AS dy, least(b.w, c.w) * least(b.h, c.h) / (b.w * b.h + c.w * c.h - least(b.w, c.w) * least(b.h, c.h))
  - 0.5 * least(sqrt((b.x - c.x) ** 2 + (b.y - c.y) ** 2) / 100, 1) - 0.5 * least(b.e, c.e) * abs(b.o - c.o) / 90 AS score FROM b JOIN c ON b.wsi = c.wsi AND (b.x - c.x) ** 2 + (b.y - c.y) ** 2 <= 10000),
s AS (SELECT *, row_number() OVER (PARTITION BY wsi, component ORDER BY round(score, 10) DESC, other_id) AS r FROM near)
SELECT l.wsi, l.cell_id, dx, dy, dx IS NOT NULL AS matched FROM l LEFT JOIN s ON s.wsi = l.wsi AND s.component = l.component AND r = 1""")
def j9_broadcast_offsets(spark, sf_dir):
    """Groups that touch are matched by their boxes with nuclei that lie off by (9, -4); members get their group's offset."""
    shapes = _dense(spark, sf_dir)
    groups = stored(space.touching_groups(shapes.select("wsi", "cell_id", "ring")), "groups")
    box = shapes.select("wsi", "cell_id", rings.bbox(F.col("ring")).alias("b")).join(groups, ["wsi", "cell_id"]).groupBy("wsi", F.col("component").alias("cell_id"))
    boxes = box.agg(F.struct(*[f(f"b.{c}").alias(c) for f, c in ((F.min, "xmin"), (F.min, "ymin"), (F.max, "xmax"), (F.max, "ymax"))]).alias("b")).select("wsi", "cell_id", _rectangle(F.col("b.xmin"), F.col("b.ymin"), F.col("b.xmax") - F.col("b.xmin"), F.col("b.ymax") - F.col("b.ymin")).alias("ring"))
    moved = shapes.filter("key % 3 = 0").select("wsi", F.concat(F.lit("n"), "cell_id").alias("cell_id"), _rectangle(F.col("x0") + 9, F.col("y0") - 4, F.col("w"), F.col("h")).alias("ring"))

    def side(rows):
        rows = rows.withColumn("axis", polygons.orientation_elongation(F.col("ring"))).withColumn("c", overlay.shape_centroid(overlay.as_shape(F.col("ring"))))
        return rows.select("wsi", "cell_id", "ring", "axis.*", F.col("c.x").alias("x"), F.col("c.y").alias("y"))

    found = space.broadcast_offsets(groups, space.match_merged(side(boxes), side(moved)))
    return found.select("wsi", "cell_id", (F.round("dx", 4) + 0.0).alias("dx"), (F.round("dy", 4) + 0.0).alias("dy"), "matched")


@query(f"""WITH {DENSE} SELECT a.wsi, a.cell_id AS a, b.cell_id AS b, round(i / (a.w * a.h + b.w * b.h - i), 6) AS iou FROM dense a JOIN dense b ON a.wsi = b.wsi AND a.cell_id < b.cell_id
  AND a.x0 <= b.x0 + b.w AND b.x0 <= a.x0 + a.w AND a.y0 <= b.y0 + b.h AND b.y0 <= a.y0 + a.h,
  LATERAL (SELECT (least(a.x0 + a.w, b.x0 + b.w) - greatest(a.x0, b.x0)) * (least(a.y0 + a.h, b.y0 + b.h) - greatest(a.y0, b.y0)) AS i)""")
def j3_g6_overlap_of_pairs(spark, sf_dir):
    shapes = _dense(spark, sf_dir).select("wsi", "cell_id", "ring")
    return space.touching_pairs(shapes, rings=True).select("wsi", "a", "b", r6(overlay.shape_overlap(F.col("ring_a"), F.col("ring_b"))).alias("iou"))


@query(f"""WITH {POLY} SELECT wsi, cell_id, CASE key % 3 WHEN 0 THEN 2 ELSE 1 END AS parts, CASE key % 3 WHEN 1 THEN 1 ELSE 0 END AS holes, CASE key % 3 WHEN 0 THEN w * h / 2 WHEN 1 THEN w * h * 0.75 ELSE w * h * 1.5 END AS area, key % 3 <> 1 AS repaired,
  CASE key % 3 WHEN 0 THEN w * h / 4 WHEN 1 THEN w * h * 0.75 ELSE w * h * 1.5 END AS largest FROM poly""")
def g2_repair_shapes(spark, sf_dir):
    """A ring that crosses itself, a part with a hole, and two parts that overlap by half."""
    x0, y0, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    crossed = F.array(F.array(F.array(*[F.get(_rectangle(x0, y0, w, h), F.lit(i)) for i in (0, 2, 1, 3)])))
    holed = F.array(F.array(_rectangle(x0, y0, w, h), _rectangle(x0 + w / 4, y0 + h / 4, w / 2, h / 2)))
    double = F.array(F.array(_rectangle(x0, y0, w, h)), F.array(_rectangle(x0 + w / 2, y0, w, h)))
    shape = F.when(F.col("key") % 3 == 0, crossed).when(F.col("key") % 3 == 1, holed).otherwise(double)
    rows = d.polygons(spark, sf_dir).select("wsi", "cell_id", overlay.repair_shape(shape).alias("v"))
    area = lambda s: r6(overlay.shape_area(s))
    largest = area(overlay.largest_part(F.col("v.shape"))).alias("largest")
    return rows.select("wsi", "cell_id", F.size("v.shape").alias("parts"), F.aggregate("v.shape", F.lit(0), lambda n, p: n + F.size(p) - 1).alias("holes"), area(F.col("v.shape")).alias("area"), "v.repaired", largest)


@query(f"""WITH {POLY} SELECT wsi, cell_id, 1 AS parts, false AS repaired, CAST(CASE WHEN h > w THEN 90 ELSE 0 END AS DOUBLE) AS orientation, round(1 - least(w, h) / greatest(w, h), 6) AS elongation, round((w - least(w, 1) / 2) * h / (w * h + least(w, 1) / 2 * h), 6) AS iou FROM poly""")
def g2_g5_polygons(spark, sf_dir):
    """Each rectangle against itself, moved aside by half a pixel."""
    moved = F.transform("ring", lambda p: F.struct((p["x"] + 0.5).alias("x"), p["y"].alias("y")))
    found = d.polygons(spark, sf_dir).withColumn("v", overlay.repair_shape(F.col("ring"))).withColumn("o", polygons.orientation_elongation(F.col("ring"))).withColumn("iou", overlay.shape_overlap(F.col("ring"), moved))
    return found.select("wsi", "cell_id", F.size("v.shape").alias("parts"), "v.repaired", r6("o.orientation").alias("orientation"), r6("o.elongation").alias("elongation"), r6("iou").alias("iou"))


def _geojson(spark: SparkSession, sf_dir: str) -> str:
    """Files of 20,000 keys' features each, in the order of their names, from the rectangles: polygons, polygons with a hole, multi-polygons with an empty part, collections in collections with points and lines."""
    x0, y0, w, h, key = (F.col(c) for c in ("x0", "y0", "w", "h", "key"))
    point = lambda x, y: F.concat(F.lit("["), x.cast("string"), F.lit(","), y.cast("string"), F.lit("]"))

    def ring(x, y, w, h):
        corners = [point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h), point(x, y)]
        return F.concat(F.lit("["), F.concat_ws(",", *corners), F.lit("]"))

    def geometry(kind, body):
        return F.concat(F.lit(f'{{"type":"{kind}","coordinates":['), body, F.lit("]}"))

    whole, inner = ring(x0, y0, w, h), ring(x0 + w / 4, y0 + h / 4, w / 2, h / 2)
    plain, holed = geometry("Polygon", whole), geometry("Polygon", F.concat_ws(",", whole, inner))
    multi = geometry("MultiPolygon", F.concat(F.lit("["), whole, F.lit("],[],["), ring(x0 + 100, y0, w, h), F.lit("]")))
    nested = F.concat(F.lit('{"type":"GeometryCollection","geometries":['), geometry("Point", F.lit("1,2")), F.lit(',{"type":"GeometryCollection","geometries":['), holed, F.lit(","), geometry("Polygon", F.lit("")), F.lit("]},"), multi, F.lit("]}"))
    body = F.when(key % 4 == 0, plain).when(key % 4 == 1, holed).when(key % 4 == 2, multi).otherwise(nested)
    name = F.when(key % 5 > 0, F.concat(F.lit('{"classification":{"name":"k'), (key % 5).cast("string"), F.lit('"}}'))).otherwise("{}")
    feature = F.concat(F.lit('{"type":"Feature","properties":'), name, F.lit(',"geometry":'), body, F.lit("}"))
    file = F.lpad(F.floor(key / 20_000).cast("string"), 12, "0").alias("keys")
    rows = d.polygons(spark, sf_dir).groupBy(file).agg(F.array_sort(F.collect_list(F.struct("key", feature.alias("f")))).alias("fs"))
    path = scratch(spark, "geojson")
    rows.select("keys", F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform("fs", lambda f: f["f"]), ","), F.lit("]}")).alias("value")).write.partitionBy("keys").text(path)
    return path


@query(f"""WITH {POLY}, one AS (SELECT key, CASE WHEN key % 5 > 0 THEN 'k' || key % 5 END AS label, 0 AS i, CASE WHEN key % 2 = 0 THEN w * h ELSE w * h * 0.75 END AS area, CASE WHEN key % 2 = 0 THEN 1 ELSE 2 END AS n_rings FROM poly
  UNION ALL SELECT key, CASE WHEN key % 5 > 0 THEN 'k' || key % 5 END, i, w * h, 1 FROM poly, (VALUES (1), (2)) t(i) WHERE (key % 4 = 2 AND i = 1) OR key % 4 = 3)
SELECT 's' AS wsi, 's_cvit_' || (row_number() OVER (ORDER BY key, i) - 1) AS cell_id, label, n_rings, area FROM one""")
def s6_nested_geometry(spark, sf_dir):
    found = readers.geojson_shapes(spark, _geojson(spark, sf_dir), "s")
    return found.select("wsi", "cell_id", "label", F.size(F.get("shape", F.lit(0))).alias("n_rings"), r6(overlay.shape_area(F.col("shape"))).alias("area"))


@query(f"WITH {POLY} SELECT type, count(*) AS n FROM poly, (VALUES ('Point'), ('Polygon')) t(type) WHERE key % 4 = 3 GROUP BY type")
def s6_skipped_geometry(spark, sf_dir):
    return readers.geojson_skipped(spark, _geojson(spark, sf_dir))
