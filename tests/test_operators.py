import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import joins, models, sampling, space, stats, tables
from tessera.sources import readers, sinks


@pytest.fixture(scope="module")
def cells(spark):
    rng = random.Random(3)
    rows = [(f"s{i % 2}", f"c{i}", rng.randrange(500), rng.randrange(500), rng.choice("ABC")) for i in range(200)]
    return spark.createDataFrame([*rows, ("s0", "edge", 0, 0, "A"), ("s0", "in", 112, 112, "A"), ("s1", "lone", 9000, 9000, "B"), ("s1", "lost", None, None, "B")], "wsi string, cell_id string, x int, y int, cell_type string")


def local(cells):
    return [r for r in cells.collect() if r["x"] is not None]


def test_window_join_is_brute_force(cells):
    rows = local(cells)
    want = {(a["cell_id"], b["cell_id"]) for a in rows for b in rows if a["wsi"] == b["wsi"] and abs(a["x"] - b["x"]) <= 112 and abs(a["y"] - b["y"]) <= 112}
    got = [(r["cell_id"], r["other_id"]) for r in space.window_join(cells, cells, 224).collect()]
    assert len(got) == len(set(got)) and set(got) == want and ("edge", "in") in want


def test_knn_is_brute_force(cells):
    rows = local(cells)
    got = {}
    for r in space.knn_join(cells, 4).collect():
        got.setdefault(r["cell_id"], []).append((r["rank"], r["other_id"]))
    for a in rows:
        near = sorted((math.hypot(a["x"] - b["x"], a["y"] - b["y"]), b["cell_id"]) for b in rows if a["wsi"] == b["wsi"] and a["cell_id"] != b["cell_id"])[:4]
        assert [x for _, x in sorted(got[a["cell_id"]])] == [x for _, x in near]
    assert space.knn_join(cells, 1, parity=True).count() == 0


def test_window_stats_unknown_position_and_isolated(cells):
    rows = {r["cell_id"]: r for r in space.window_stats(cells, cells, 224, ["A", "B"], include_self=False).collect()}
    assert rows["lone"]["n"] == 0 and rows["lost"]["n"] is None
    types = {r["cell_id"]: r for r in space.neighbor_type_stats(cells, 224).collect()}
    assert types["lone"]["isolated"] and types["lone"]["heterotypic"] is None and types["lost"]["n"] is None


def test_majority_tie_is_alphabetical(spark):
    rows = [("s", "a", 0, 0, "X"), ("s", "b", 1, 0, "B"), ("s", "c", 0, 1, "A")]
    df = spark.createDataFrame(rows, "wsi string, cell_id string, x int, y int, true_label string")
    got = {r["cell_id"]: r["majority"] for r in space.majority_label(df.union(df), 5).collect()}
    assert got["a"] == "A" and len(got) == 3


def test_tiles_hold_each_cell_once(cells):
    tiles = space.tile_groups(cells.filter("x IS NOT NULL"), 20000, 20000)
    assert sorted(r["c"]["cell_id"] for r in tiles.select(F.explode("cells").alias("c")).collect()) == sorted(r["cell_id"] for r in local(cells))


def test_connected_chain(spark):
    nodes = spark.createDataFrame([("s", f"n{i:02d}") for i in range(20)], "wsi string, cell_id string")
    links = spark.createDataFrame([("s", f"n{i:02d}", f"n{i + 1:02d}") for i in range(15)], "wsi string, a string, b string")
    got = {r["cell_id"]: r["component"] for r in space.connected_labels(nodes, links).collect()}
    assert set(got[f"n{i:02d}"] for i in range(16)) == {"n00"} and got["n19"] == "n19"


def test_metrics_and_weights(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a")]
    df = spark.createDataFrame(pairs, "true_label string, predicted_label string")
    r = tables.classification_report(tables.confusion_matrix(df, ["a", "b", "c", "d"])).first()
    assert math.isclose(r["accuracy"], 0.6) and math.isclose(r["macro_f1"], (0.5 + 0.8) / 4) and math.isclose(r["balanced_accuracy"], 0.5)
    rows = spark.createDataFrame([("s", "A"), ("s", "A"), ("s", "B")], "wsi string, label string")
    assert sorted(round(x["weight"], 6) for x in tables.sample_weights(rows, 2, by_wsi=False).collect()) == [0.75, 0.75, 1.5]


def test_r2_of_constants(spark):
    df = spark.createDataFrame([("x", 1.0, 1.0), ("x", 1.0, 1.0), ("y", 1.0, 2.0)], "g string, t double, p double")
    assert {r["g"]: r["r2"] for r in tables.r2_score(df, "t", "p", ["g"]).collect()} == {"x": 0.0, "y": float("-inf")}


def test_paired_diff(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (2, "a", 0.7), (2, "b", 0.6)], "split_idx int, condition string, m double")
    r = tables.paired_diff(df, ["split_idx"], "condition", "a", "b", "m").first()
    assert (round(r["mean"], 9), r["std"], r["n"]) == (0.1, 0.0, 1)


def test_average_rank_pooled_and_grouped(spark):
    values = [random.Random(1).randrange(30) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    ordered = sorted(values)
    want = {v: np.mean([i + 1 for i, x in enumerate(ordered) if x == v]) for v in set(values)}
    assert all(math.isclose(r["rank"], want[r["v"]]) for r in tables.average_rank(df, "v").collect())


def test_cliffs_delta_and_permutation(spark):
    rows = [("s", 3.0, True, False, 1), ("s", 4.0, True, False, 2), ("s", 1.0, False, True, 3), ("s", 2.0, False, True, 4)]
    df = spark.createDataFrame(rows, "wsi string, v double, a boolean, b boolean, key int")
    assert stats.cliffs_delta(df, "v", "a", "b").first()["delta"] == 1.0
    big = spark.createDataFrame([(f"s{i % 3}", float(i), float(i), i) for i in range(90)], "wsi string, x double, y double, key int")
    r = stats.block_permutation_spearman(big, "x", "y", "key", n_perm=19).first()
    assert math.isclose(r["rho"], 1.0) and math.isclose(r["p_value"], 0.05)


def test_bootstrap_draws_sum_to_slides(spark):
    rows = stats.bootstrap_draws(spark, ["a", "b", "c"], 50).collect()
    per = {}
    for r in rows:
        per.setdefault((r["multiset"], r["times"]), 0)
        per[r["multiset"], r["times"]] += r["multiplicity"]
    assert set(per.values()) == {3} and sum(t for _, t in per) == 50


def test_sampling(spark, cells):
    want = spark.createDataFrame([("s0", 0.05), ("s1", 0.001)], "wsi string, proportion double")
    n = {r["wsi"]: r["count"] for r in cells.groupBy("wsi").count().collect()}
    got = {r["wsi"]: r["count"] for r in sampling.sample_proportion(cells, want).groupBy("wsi").count().collect()}
    assert got == {"s0": max(1, int(n["s0"] * 0.05)), "s1": 1}
    with pytest.raises(Exception, match="no usable cells"):
        sampling.sample_proportion(cells, spark.createDataFrame([("none", 0.5)], "wsi string, proportion double")).collect()
    sides = {r["side"]: r["count"] for r in sampling.random_split(cells, ["wsi", "cell_id"], {"train": 0.7, "val": 0.15, "test": 0.15}).groupBy("side").count().collect()}
    assert sides == {"train": int(204 * 0.7), "val": int(204 * 0.85) - int(204 * 0.7), "test": 204 - int(204 * 0.85)}
    folds = sampling.loso_folds(spark, ["a", "b", "c"]).collect()
    assert {(r["split_idx"], r["wsi"]) for r in folds if r["side"] == "test"} == {(0, "a"), (1, "b"), (2, "c")}


def test_ridge_closed_form(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(60, 4)), rng.normal(size=(60, 2))
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y, strict=True)], "x array<double>, y array<double>")
    w, b = models.ridge_fit(models.gram(df), [0.5])[0.5]
    xc, yc = x - x.mean(0), y - y.mean(0)
    want = np.linalg.solve(xc.T @ xc + 0.5 * np.eye(4), xc.T @ yc)
    assert np.allclose(w, want) and np.allclose(b, y.mean(0) - x.mean(0) @ want)


def test_probe_skips_without_validation(spark):
    df = spark.createDataFrame([([1.0], 1.0, True)] * 12, "x array<double>, target double, valid boolean")
    assert models.run_probe(df, df.limit(0), df, [1.0])["skipped"]


def test_align_predictions_raises_on_other_truth(spark):
    a = spark.createDataFrame([("s", "c", "x", True)], "wsi string, cell_id string, true_label string, correct boolean")
    assert joins.align_predictions(a, a).first()["quadrant"] == "both"
    with pytest.raises(Exception, match="true labels differ"):
        joins.align_predictions(a, a.withColumn("true_label", F.lit("y"))).collect()


def test_readers_and_sinks(spark, tmp_path):
    cells = spark.createDataFrame([("a", "a_1", 0, 0, "X"), ("a", "a_2", 1, 1, "Y"), ("b", "3", 1, 1, "Y")], "wsi string, cell_id string, x_start int, y_start int, cell_type string")
    path = str(tmp_path / "cells")
    sinks.write_cells(cells, path)
    truth = {r["cell_id"]: (r["native_cell_id"], r["x"]) for r in readers.read_ground_truth(spark, path).collect()}
    assert truth == {"a_1": ("1", 112), "a_2": ("2", 113), "3": ("3", 113)}
    with pytest.raises(Exception, match="lacks a value"):
        sinks.write_cells(cells.withColumn("x_start", F.lit(None).cast("int")), str(tmp_path / "bad"))
    geo = tmp_path / "n.geojson"
    geo.write_text('{"features": [{"geometry": {"type": "Polygon", "coordinates": [[[0,0],[1,0],[1,1],[0,0]]]}, "properties": {"classification": {"name": "N"}}},'
                   '{"geometry": {"type": "MultiPolygon", "coordinates": [[[[0,0],[1,0],[1,1]]], [[[2,2],[3,2],[3,3]]]]}, "properties": {}}, {"geometry": {"type": "Polygon", "coordinates": []}, "properties": {}}]}')
    assert [(r["cell_id"], r["label"]) for r in readers.read_geojson_nuclei(spark, str(geo), "s").orderBy("cell_id").collect()] == [("s_cvit_0", "N"), ("s_cvit_1", None), ("s_cvit_2", None)]
    align = tmp_path / "m.csv"
    align.write_text("2,0,4\n0,2,6\n0,0,1\n")
    assert np.allclose(readers.read_alignment(spark, str(align), "a").first()["inverse"], [[0.5, 0, -2], [0, 0.5, -3], [0, 0, 1]])
    table, stale = sinks.cache_with_meta(spark, str(tmp_path / "cache"), {"p": 1}, lambda: cells)
    assert not stale and table.count() == 3
    assert sinks.cache_with_meta(spark, str(tmp_path / "cache"), {"p": 2}, lambda: cells.limit(1))[1]


def test_no_nested_loops_in_spatial_plans(spark, cells):
    for df in (space.window_join(cells, cells, 224), space.radius_join(cells, cells, 50)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_boundary_tokens_fall_back(spark):
    from tessera.operators import readouts

    ring = lambda x, y: [(x, y), (x + 2.0, y), (x + 2.0, y + 2.0), (x, y + 2.0)]
    flat = [float(i) for i in range(8)]
    rows = [(1, flat, ring(1.0, 1.0), 0.0, 0.0), (2, flat, ring(9.0, 1.0), 0.0, 0.0), (3, flat, ring(500.0, 500.0), 0.0, 0.0), (4, flat, None, 0.0, 0.0), (5, flat, ring(-50.0, 1.0), 0.0, 0.0)]
    df = spark.createDataFrame(rows, "k int, flat array<double>, ring array<struct<x:double,y:double>>, x0 double, y0 double")
    got = {r["k"]: (r["pooled"], r["n_tokens"], r["source"]) for r in readouts.pool_boundary_tokens(df, ["k"], 10.0, 2, 2).collect()}
    assert got == {1: ([0.0, 1.0], 1, "overlap"), 2: ([1.0, 2.0], 2, "overlap"), 3: ([6.0, 7.0], 0, "nearest"), 4: ([0.0, 0.0], 0, "missing"), 5: ([0.0, 1.0], 0, "nearest")}
    rate = readouts.fallback_rate(readouts.pool_boundary_tokens(df, ["k"], 10.0, 2, 2)).first()
    assert (rate["n"], rate["missing_share"], rate["nearest_share"]) == (5, 0.2, 0.4)


def test_masking_divergence_interval(spark):
    from tessera.operators import readouts, stats

    rows = [(f"s{i % 4}", str(i), "only_a" if i % 3 == 0 else "both" if i % 3 == 1 else "neither") for i in range(60)]
    aligned = spark.createDataFrame(rows, "wsi string, cell_id string, quadrant string")
    divergence = spark.createDataFrame([(w, c, 5.0 if q == "only_a" else 1.0) for w, c, q in rows], "wsi string, cell_id string, divergence double")
    found = readouts.masking_divergence_interval(aligned, divergence, stats.bootstrap_draws(spark, ["s0", "s1", "s2", "s3"], 20)).first()
    assert (found["n_a"], found["n_b"], found["median_diff"], found["ci_lo"], found["ci_hi"]) == (20, 20, 4.0, 4.0, 4.0)


def test_quantiles_are_those_of_percentile(spark):
    rng = np.random.default_rng(5)
    values = [*rng.normal(size=300).tolist(), *[0.0] * 150, *rng.integers(-3, 4, 200).astype(float).tolist(), None, None]
    rows = [(None if i % 7 == 0 else f"g{i % 3}", v) for i, v in enumerate(values)] + [("one", 2.5), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    points = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    exact = F.percentile("v", F.array(*map(F.lit, points))).alias("q")
    want = {r["g"]: r["q"] for r in df.groupBy("g").agg(exact).collect() if r["q"] is not None}
    assert {r["g"]: r["q"] for r in tables.quantiles(df, "v", points, ["g"]).collect()} == want
    assert tables.quantiles(df, "v", points).first()["q"] == df.agg(exact).first()["q"]
    assert tables.quantiles(df.limit(0), "v", [0.5]).first()["q"] == [None] and not tables.quantiles(df.limit(0), "v", [0.5], ["g"]).count()
    medians = {r["g"]: r["median"] for r in tables.describe_by_group(df, "g", "v").collect()}
    assert medians == {g: want[g][3] if g in want else None for g in {None, "g0", "g1", "g2", "one", "none"}}


def test_robust_scaling(spark):
    df = spark.createDataFrame([(float(i), 3.0) for i in range(9)], "a double, b double")
    (got,) = models.scale_columns(df, ["a", "b"], True)
    assert sorted(tuple(r) for r in got.collect()) == [((i - 4) / 4, 0.0) for i in range(9)]


def test_bootstrap_of_medians_is_that_of_expanded_rows(spark):
    rng = np.random.default_rng(8)
    slides, draws = ["a", "b", "c"], [["a", "a", "c"], ["a", "b", "c"], ["b", "b", "b"], ["c", "c", "b"]]
    rows = [(slides[i % 3], float(v), bool(i % 3 != 1 and i % 2), bool(i % 5 < 3)) for i, v in enumerate(np.round(rng.normal(size=400), 1))] + [("a", None, True, True)]
    df = spark.createDataFrame(rows, "wsi string, v double, p boolean, q boolean")
    drawn = spark.createDataFrame([(m, 1 + m, s, d.count(s)) for m, d in enumerate(draws) for s in set(d)], "multiset int, times int, wsi string, multiplicity int")
    medians = stats._drawn_medians(df.filter("v IS NOT NULL").select("wsi", F.col("v").alias("_v"), F.explode(F.expr("array_compact(array(if(p, 'a', null), if(q, 'b', null)))")).alias("side")), drawn)
    got = {(r["side"], r["multiset"]): r["median"] for r in medians.collect()}
    want = {(side, m): float(np.median(own)) for m, d in enumerate(draws) for side, at in (("a", 2), ("b", 3)) if (own := [r[1] for s in d for r in rows if r[0] == s and r[1] is not None and r[at]])}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want) and ("a", 2) not in got
    found = stats.cluster_bootstrap_median_diff(df, "v", "p", "q", drawn).first()
    assert found["n_valid"] == 1 + 2 + 4  # the draw of b alone has no row of the first group
