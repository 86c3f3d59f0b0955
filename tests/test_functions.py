import math

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import labels, polygons, rings, scalars, vectors


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def ring(*points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def test_clamp_and_density(spark):
    r = one(spark, scalars.clamp_origin(F.lit(-5), 0, 1000, 224), scalars.clamp_origin(F.lit(900), 0, 1000, 224), scalars.density(F.lit(8), 200))
    assert tuple(r) == (0, 776, 2.0)


def test_scores_and_angles(spark):
    r = one(spark, scalars.distance_score(F.lit(15.0)), scalars.angle_difference(F.lit(175.0), F.lit(5.0)), scalars.split_index(F.lit("split_3")), scalars.split_index(F.lit("same")))
    assert tuple(r) == (0.5, 10.0, 3, -1)


def test_central_block():
    assert scalars.central_block(224, 14, 3) == (6, 84)
    assert scalars.block_tokens(4, 2) == [5, 6, 9, 10]


def test_labels(spark):
    r = one(spark, labels.map_label(F.lit("Neural/Glial"), "simplified_broad"), labels.map_label(F.lit("Neural/Glial"), "identity"), labels.map_label(F.lit("Unknown"), "malignant_vs_rest"), labels.map_label(F.lit(None).cast("string"), "identity"))
    assert tuple(r) == ("Stromal", "Unknown", "non_malignant", "Unknown")


def test_vectors(spark):
    a, b = F.array(*map(F.lit, [1.0, 2.0, 3.0])), F.array(*map(F.lit, [2.0, 4.0, 6.5]))
    r = one(spark, vectors.pearson(a, b), vectors.cosine_similarity(a, b), vectors.argmax(b), vectors.softmax(a), vectors.pearson(a, F.array_repeat(F.lit(1.0), 3)))
    x, y = np.array([1, 2, 3.0]), np.array([2, 4, 6.5])
    assert math.isclose(r[0], np.corrcoef(x, y)[0, 1]) and math.isclose(r[1], x @ y / np.linalg.norm(x) / np.linalg.norm(y)) and r[2] == 2 and r[4] is None
    assert np.allclose(r[3], np.exp(x) / np.exp(x).sum())


def test_shapes(spark):
    rect, square = ring((0, 0), (4, 0), (4, 2), (0, 2)), ring((5, 5), (6, 5), (6, 6), (5, 6))
    rows = spark.range(1).select(rect.alias("ring")).unionByName(spark.range(1).select(square.alias("ring")))
    a, b = sorted(rings.shape_descriptors(rows).collect(), key=lambda r: -r["area"])
    assert (a["area"], round(a["eccentricity"], 6), a["orientation"], a["cx"], a["cy"]) == (8.0, 0.866025, 0.0, 2.0, 1.0)
    assert (b["area"], b["eccentricity"], b["orientation"]) == (1.0, 0.0, 0.0)


def test_token_overlap_touches(spark):
    rows = spark.range(1).select(F.lit("s").alias("wsi"), ring((14, 0), (20, 0), (20, 10), (14, 10)).alias("ring"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"))
    assert [tuple(r) for r in rings.token_overlap(rows, ["wsi"], 14.0, 4).collect()] == [("s", 0, 1)]


def test_polygon_kernels():
    square = np.array([(0, 0), (1, 0), (1, 1), (0, 1)], float)
    angle, elongation = polygons.long_axis(np.array([(0, 0), (4, 0), (4, 2), (0, 2)], float))
    assert math.isclose(angle % 180, 0, abs_tol=1e-9) and math.isclose(elongation, 0.5)
    assert polygons.rings_touch(square, square + (1, 0)) and not polygons.rings_touch(square, square + (1.01, 0))


def test_build_polygon_drops_closing_and_short(spark):
    rows = [("s", "a", 0, 0.0, 0.0), ("s", "a", 1, 1.0, 0.0), ("s", "a", 2, 1.0, 1.0), ("s", "a", 3, 0.0, 0.0), ("s", "b", 0, 0.0, 0.0), ("s", "b", 1, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "wsi string, cell_id string, seq long, vertex_x double, vertex_y double")
    assert [(r["cell_id"], len(r["ring"])) for r in rings.build_polygon(df).collect()] == [("a", 3)]
