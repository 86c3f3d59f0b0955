"""Overlay of shapes with holes against unit cells, point parity and inclusion-exclusion."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import overlay
from tessera.operators import space
from tessera.sources import readers

BOX = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def holds(parts, x, y):
    return any(sum(overlay._holds(r, x, y) for r in p) % 2 for p in parts)


def test_union_of_rectangles_is_their_unit_cells():
    rng = random.Random(1)
    for _ in range(150):
        boxes = [(rng.randrange(12), rng.randrange(12), rng.randrange(1, 6), rng.randrange(1, 6)) for _ in range(rng.randrange(1, 12))]
        cells = {(i, j) for x, y, w, h in boxes for i in range(x, x + w) for j in range(y, y + h)}
        made = overlay.region([[BOX(*map(float, b))] for b in boxes])
        assert abs(overlay.parts_area(made) - len(cells)) < 1e-9
        assert all(overlay.ring_area(p[0]) > 0 and all(overlay.ring_area(h) < 0 for h in p[1:]) for p in made)
        assert all(len(set(r)) == len(r) for p in made for r in p)
        assert overlay.region(made) == made


def test_regions_keep_point_parity():
    rng = random.Random(2)
    point = lambda: (rng.random() * 10, rng.random() * 10)
    for _ in range(80):
        parts = [[[point() for _ in range(rng.randrange(3, 9))] for _ in range(rng.randrange(1, 3))] for _ in range(rng.randrange(1, 4))]
        made = overlay.region(parts)
        assert all(holds(parts, *p) == holds(made, *p) for p in (point() for _ in range(60)))
        a, b, both = overlay.areas(parts[:1], parts[1:])
        assert abs(overlay.parts_area(made) - (a + b - both)) < 1e-6


def test_holes_touching_points_and_collinear_edges():
    frame = overlay.region([[BOX(0, 0, 4, 1)], [BOX(0, 3, 4, 1)], [BOX(0, 0, 1, 4)], [BOX(3, 0, 1, 4)]])
    assert [len(p) for p in frame] == [2] and overlay.parts_area(frame) == 12
    assert len(overlay.region([[BOX(0, 0, 1, 1)], [BOX(1, 1, 1, 1)]])) == 2  # one point in common
    assert overlay.region([[BOX(0, 0, 1, 1)], [BOX(1, 0, 1, 1)]]) == [[BOX(0, 0, 2, 1)]]
    star = [(math.cos(math.pi / 2 + 4 * math.pi * k / 5), math.sin(math.pi / 2 + 4 * math.pi * k / 5)) for k in range(5)]
    assert len(overlay.region([[star]])) == 5 and overlay.region([[[(0, 0), (1, 1), (2, 2)]]]) == [] and overlay.region([]) == []
    assert abs(overlay.overlap_ratio([[BOX(0, 0, 4, 4), BOX(1, 1, 2, 2)]], [[BOX(50, 50, 4, 4)]], True) - 0.75) < 1e-9


def shape_of(parts):
    return [[[{"x": float(x), "y": float(y)} for x, y in r] for r in p] for p in parts]


def test_odd_shapes_as_columns(spark):
    rows = [("a", shape_of([[BOX(0, 0, 4, 4), BOX(1, 1, 2, 2)]])), ("b", None), ("c", []), ("d", [[]]), ("e", shape_of([[[(0, 0), (2, 2), (2, 0), (0, 2)]]])), ("f", shape_of([[[(0, 0), (1, 1)]]]))]
    df = spark.createDataFrame(rows, f"id string, shape {overlay.SHAPE}").withColumn("v", overlay.repair_shape(F.col("shape")))
    got = {r["id"]: (r["n"], r["a"], r["repaired"], r["i"], r["c"] and r["c"]["x"]) for r in df.select("id", F.size("v.shape").alias("n"), overlay.shape_area(F.col("v.shape")).alias("a"), "v.repaired", overlay.shape_overlap(F.col("shape"), F.col("v.shape")).alias("i"), overlay.shape_centroid(F.col("v.shape")).alias("c")).collect()}
    assert got["a"][:4] == (1, 12.0, False, 1.0) and abs(got["a"][4] - 2) < 1e-9 and got["e"][:4] == (2, 2.0, True, 1.0)
    assert all(got[k] == (0, 0.0, False, 0.0, None) for k in "bcd") and got["f"][0] == 0


def test_concave_shapes_match_by_brute_force(spark):
    rng, made = random.Random(5), {}
    for side in "dr":
        for i in range(12):
            w, h, a, b = rng.uniform(4, 12), rng.uniform(4, 12), rng.uniform(0.2, 0.8), rng.uniform(0.2, 0.8)
            x, y = rng.uniform(0, 60), rng.uniform(0, 60)
            made[side, f"{side}{i}"] = [(x, y), (x + w, y), (x + w, y + b * h), (x + a * w, y + b * h), (x + a * w, y + h), (x, y + h)]

    def frame(side):
        rows = [("s", k, *overlay.parts_centroid([[r]]), 0.0, [{"x": px, "y": py} for px, py in r]) for (s, k), r in made.items() if s == side]
        return spark.createDataFrame(rows, f"wsi string, cell_id string, x double, y double, orientation double, ring array<{overlay.POINT}>")

    weights = spark.createDataFrame([("shape", 1.0, 1.2, 5.0)], "name string, w_distance double, w_orientation double, w_iou double")
    got = {r["cell_id"]: (r["other_id"], r["iou_score"]) for r in space.match_by_radius(frame("d"), frame("r"), weights, shapes=True).collect()}

    def sampled(a, b):
        (ax, ay), (bx, by) = overlay.parts_centroid([[a]]), overlay.parts_centroid([[b]])
        b = [(x + ax - bx, y + ay - by) for x, y in b]
        grid = [(ax - 14 + 0.14 * i, ay - 14 + 0.14 * j) for i in range(200) for j in range(200)]
        ins = [(overlay._holds(a, *p), overlay._holds(b, *p)) for p in grid]
        return sum(x and y for x, y in ins) / sum(x or y for x, y in ins)

    for (side, k), ring in made.items():
        if side == "d":
            scores = {}
            for (other, j), b in made.items():
                (ax, ay), (bx, by) = overlay.parts_centroid([[ring]]), overlay.parts_centroid([[b]])
                if other == "r" and math.hypot(ax - bx, ay - by) <= 80:
                    scores[j] = 1 / (1 + math.hypot(ax - bx, ay - by) / 15) + 1.2 + 5 * overlay.overlap_ratio([[ring]], [[b]], True)
            assert got[k][0] == max(scores, key=scores.get)
    some = [k for k in got][:4]
    assert all(abs(got[k][1] - sampled(made["d", k], made["r", got[k][0]])) < 0.05 for k in some)


@pytest.mark.parametrize("fan", [2, 64])
def test_groups_merge_in_rounds(spark, fan):
    boxes = [("s", f"c{i:02d}", float(3 * i), 0.0, 4.0, 2.0) for i in range(20)] + [("s", "far", 500.0, 500.0, 1.0, 1.0), ("t", "c00", 0.0, 0.0, 1.0, 1.0)]
    rows = [(w, c, [{"x": px, "y": py} for px, py in BOX(x, y, a, b)]) for w, c, x, y, a, b in boxes]
    df = spark.createDataFrame(rows, f"wsi string, cell_id string, ring array<{overlay.POINT}>")
    got = {(r["wsi"], r["component"]): (r["n_members"], r["area"], r["parts"]) for r in space.merged_shapes(df, tile=8.0, fan=fan).select("wsi", "component", "n_members", overlay.shape_area(F.col("shape")).alias("area"), F.size("shape").alias("parts")).collect()}
    assert got == {("s", "c00"): (20, 122.0, 1), ("s", "far"): (1, 1.0, 1), ("t", "c00"): (1, 1.0, 1)}
    assert space.merged_shapes(df.limit(0)).count() == 0


def test_nested_collections_are_opened(spark, tmp_path):
    path = tmp_path / "n.geojson"
    ring = "[[0,0],[4,0],[4,4],[0,4],[0,0]]"
    hole = "[[1,1],[2,1],[2,2],[1,2],[1,1]]"
    inner = f'{{"type":"GeometryCollection","geometries":[{{"type":"Point","coordinates":[1,2]}},{{"type":"GeometryCollection","geometries":[{{"type":"Polygon","coordinates":[{ring},{hole}]}}]}}]}}'
    multi = f'{{"type":"MultiPolygon","coordinates":[[{ring}],[],[{ring},{hole}]]}}'
    parts = [f'{{"properties":{{"classification":{{"name":"N"}}}},"geometry":{inner}}}', f'{{"properties":{{}},"geometry":{multi}}}', '{"properties":{},"geometry":null}', '{"properties":{},"geometry":{"type":"Polygon","coordinates":[]}}']
    path.write_text('{"features":[' + ",".join(parts) + "]}")
    got = [tuple(r) for r in readers.geojson_shapes(spark, str(path), "s").select("cell_id", "label", overlay.shape_area(F.col("shape")), F.size(F.col("shape")[0])).orderBy("cell_id").collect()]
    assert got == [("s_cvit_0", "N", 15.0, 2), ("s_cvit_1", None, 16.0, 1), ("s_cvit_2", None, 15.0, 2)]
    assert {tuple(r) for r in readers.geojson_skipped(spark, str(path)).collect()} == {("Point", 1), ("none", 1), ("Polygon", 1)}
