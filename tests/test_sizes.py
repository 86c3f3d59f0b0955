"""Faults that only larger tables showed."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.functions import overlay, polygons
from tessera.operators import expression, models, resampling, space, stats, tables
from tessera.operators import readouts as readout
from tessera.plans import domain, readouts, shapes
from tessera.sources import readers


@pytest.mark.parametrize("name", ["t1_pool_tokens", "t2_t4_tokens", "t7_neighbor_max_pool"])
def test_rounded_zeros_keep_their_sign(spark, tmp_path, name):
    tiny = lambda i: [(-1e-7 if (i + k) % 3 else 1e-7) if k % 2 else 0.5 - k / 100 for k in range(64)]
    spark.createDataFrame([(i, tiny(i), i % 2) for i in range(40)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = entry.queries()[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert "-0.0," in str(want) and sorted(str(tuple(r)) for r in got.collect()) == sorted(map(str, want))


@pytest.mark.parametrize("n", [10, 130, 1000, 1001])
def test_segments_make_permutations_without_rest(n):
    for p in range(3):
        to, walked = np.full(n, -1), 0
        for a, b, c, d in [(a, min(n, a + 300), c, min(n, c + 400)) for a in range(0, n, 300) for c in range(0, n, 400)]:
            for first, _, found in resampling._moves(a, b, c, d, n, 12345, 0, np.array([p]), 64):
                inside = (found[0] >= c) & (found[0] < d)
                to[first : first + found.shape[1]][inside] = found[0][inside]
                walked += found.shape[1]
        assert sorted(to) == list(range(n)) and (walked <= 2.5 * n or n < 400)  # a row is sent once, whatever the number of blocks


def test_permutations_of_segments_agree_with_whole_ones(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{i % 2}", i, float(x), float(0.02 * x + y)) for i, (x, y) in enumerate(rng.normal(size=(2000, 2)))]
    df = spark.createDataFrame(rows, "wsi string, key long, x double, y double")
    p = [stats.block_permutation_spearman(df, "x", "y", "key", n_perm=500, block=b, segment=s).first()["p_value"] for b, s in ((10_000, 10_000), (10_000, 100), (700, 100))]
    assert max(p) - min(p) < 0.1


def test_overlaps_are_worked_out_for_contenders_only(spark, monkeypatch):
    boxes = [(f"c{i}", float(i % 20 * 9), float(i // 20 * 9), 2.0 + i % 5, 3.0 + i % 3) for i in range(200)]
    rows = [("s", c, x, y, 0.0, 0.5, [{"x": x + a * w / 2, "y": y + b * h / 2} for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))]) for c, x, y, w, h in boxes]
    df = spark.createDataFrame(rows, f"wsi string, cell_id string, x double, y double, orientation double, elongation double, ring array<{overlay.POINT}>")
    seen, ratio = spark.sparkContext.accumulator(0), overlay.shape_overlap
    monkeypatch.setattr(overlay, "shape_overlap", lambda a, b, aligned: ratio(counted(a), b, aligned))

    def counted(a):
        def run(v):
            seen.add(len(v))
            return v

        return F.pandas_udf(run, f"array<{overlay.POINT}>")(a)

    got = space.match_merged(df.filter("cell_id like '%1'"), df.filter("cell_id not like '%1'")).collect()
    assert len(got) == 20 and all(r["other_id"] for r in got) and seen.value < 400  # of some 2,000 pairs

    def best(c):
        own = next(b for b in boxes if b[0] == c)
        def score(b):
            shared = min(own[3], b[3]) * min(own[4], b[4])
            return round(shared / (own[3] * own[4] + b[3] * b[4] - shared) - 0.5 * min(np.hypot(own[1] - b[1], own[2] - b[2]) / 100, 1), 10)
        return min((b for b in boxes if not b[0].endswith("1")), key=lambda b: (-score(b), b[0]))[0]

    assert all(r["other_id"] == best(r["cell_id"]) for r in got)


def test_features_of_several_files_are_numbered_without_one_task(spark, tmp_path):
    spark.createDataFrame([(k, 1 + k % 9) for k in range(19_990, 20_010)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    path = shapes._geojson(spark, str(tmp_path))
    assert spark.read.text(path).select("keys").distinct().count() == 2
    plan = readers.geojson_shapes(spark, path, "s").select("cell_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("windowspecdefinition(file") == 2  # within files, and over a row a file
    got = entry.queries()["s6_nested_geometry"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()['s6_nested_geometry']})").fetchall()
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(map(str, want))


def test_polygons_are_dealt_over_tasks(spark):
    assert domain.polygons(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_dense_groups_keep_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    ring = lambda x, y, w, h, kind: [[(x, y), (x + w, y), (x + w, y + h), (x, y + h)], [(x, y), (x + w, y), (x, y + h)], [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)], [(x + w, y), (x, y), (x, y + h), (x + w, y + h)]][kind]
    made = {(f"s{i % 2}", i): ring(*map(float, (rng.integers(0, 200), rng.integers(0, 100), rng.integers(1, 40), rng.integers(1, 4))), i % 4) for i in range(300)}
    made |= {("s0", 1000 + i): ring(500.0 + i % 5, 500.0 + i % 7, 200.0, 90.0, i % 4) for i in range(30)}  # wider than a bin, all touch
    df = spark.createDataFrame([(w, i, [{"x": x, "y": y} for x, y in r]) for (w, i), r in made.items()], f"wsi string, cell_id long, ring array<{overlay.POINT}>")
    odd = spark.createDataFrame([("s0", 5000, None), ("s0", 5001, [])], df.schema)
    up = {k: k for k in made}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    points = {k: polygons.as_points(np.array(r)) for k, r in made.items()}
    for a in made:
        for b in made:
            if a[0] == b[0] and a[1] < b[1] and polygons.rings_touch(points[a], points[b]):
                low, high = sorted((top(a), top(b)))
                up[high] = low
    want = {k: top(k)[1] for k in made} | {("s0", 5000): 5000, ("s0", 5001): 5001}
    monkeypatch.setattr(space, "touching_pairs", None)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for rows in (7, 10_000):  # a bin is cut over batches, or stands in one
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        assert {(r["wsi"], r["cell_id"]): r["component"] for r in space.touching_groups(df.union(odd)).collect()} == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    merged = space.merge_touching(df)
    assert sum(len(r["members"]) == len(r["rings"]) and r["members"] == sorted(r["members"]) for r in merged.collect()) == len(set((k[0], want[k]) for k in made))
    plan = merged.select("members")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(cell_id" in plan and "collect_list(struct" not in plan and "collect_list(named_struct" not in plan


def test_r2_sends_sums_only(spark):
    rows = [("a", 1e9 + x, 1e9 + x * 0.9) for x in range(50)] + [("b", 0.1, 0.1)] * 3 + [("c", 0.1, 0.2)] * 3 + [("a", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, t double, p double")
    got = {r["g"]: (r["n"], r["r2"]) for r in tables.r2_score(df, "t", "p", ["g"]).collect()}
    res, tot = sum((x * 0.1) ** 2 for x in range(50)), sum((x - 24.5) ** 2 for x in range(50))
    assert got["a"][0] == 50 and abs(got["a"][1] - (1 - res / tot)) < 1e-6 and got["b"] == (3, 0.0) and got["c"] == (3, float("-inf"))
    for group in (["g"], None):
        plan = tables.r2_score(df, "t", "p", group)._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Join" not in plan  # rows of a group don't meet in one task


def test_nearest_cells_in_more_tasks_than_a_shuffle_has(spark, monkeypatch):
    rng, tasks, join = np.random.default_rng(4), [], space.near_join
    at = rng.integers(0, 600, (400, 2)).astype(float)
    df = spark.createDataFrame([(f"s{i % 2}", f"c{i:03d}", float(x), float(y)) for i, (x, y) in enumerate(at)], "wsi string, cell_id string, x double, y double")
    monkeypatch.setattr(space, "CELLS", 20)
    monkeypatch.setattr(space, "near_join", lambda *a, **k: tasks.append(k["tasks"]) or join(*a, **k))
    got = {(r["cell_id"], r["rank"]): r["other_id"] for r in space.knn_join(df, 3, start=40.0).collect()}
    assert set(tasks) == {20} and len(tasks) > 1 and len(got) == 1200
    for i in range(400):
        others = sorted((float(np.hypot(*(at[i] - at[j]))), f"c{j:03d}") for j in range(i % 2, 400, 2) if j != i)
        assert [got[f"c{i:03d}", r] for r in (1, 2, 3)] == [o for _, o in others[:3]]


def test_pairs_that_touch_bring_their_rings(spark, monkeypatch):
    monkeypatch.setattr(space, "POLYGONS", 10)
    shapes_ = shapes._dense(spark, "/root/testdata/sf0.001").select("wsi", "cell_id", "ring")
    pairs = space.touching_pairs(shapes_, rings=True)
    assert f"REPARTITION_BY_NUM, {-(-shapes_.count() // 10)}" in pairs._jdf.queryExecution().executedPlan().toString() or pairs.rdd.getNumPartitions() == -(-shapes_.count() // 10)
    of = {(r["wsi"], r["cell_id"]): r["ring"] for r in shapes_.collect()}
    found = pairs.collect()
    assert found and all(of[r["wsi"], r["a"]] == r["ring_a"] and of[r["wsi"], r["b"]] == r["ring_b"] for r in found)


def test_a_slide_of_expression_is_written_by_several_tasks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(readouts, "scratch", lambda spark, name: f"{tmp_path}/out")
    was = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2k")
    try:
        readouts.s9_expression_there_and_back(spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", was)
    assert all(len(list((tmp_path / "out" / f"wsi=s{i}").glob("*.parquet"))) > 1 for i in range(7))


def test_divergence_sends_a_row_a_pair(spark):
    rng = np.random.default_rng(6)
    v = {(b, g): float(rng.integers(1, 9)) for b in range(12) for g in range(8) if rng.random() < 0.5 and b not in (3, 7)}
    near = {b: [o for o in range(12) if o != b and rng.random() < 0.5] for b in range(11)} | {7: [3], 8: [3, 7, 9]}
    expr = spark.createDataFrame([("s", str(b), f"g{g}", x) for (b, g), x in v.items()], "wsi string, barcode string, gene string, value double")
    pairs = spark.createDataFrame([("s", str(b), str(o)) for b, own in near.items() for o in own], "wsi string, barcode string, other string")
    found = expression.expression_divergence(expr, pairs, 8)
    want = {}
    for b, own in near.items():
        if own and any(k[0] in [b, *own] for k in v):
            a, m = (np.array([v.get((b, g), 0.0) for g in range(8)]), np.mean([[v.get((o, g), 0.0) for g in range(8)] for o in own], axis=0))
            full = len(own) >= 3 and a.std() > 0 and m.std() > 0
            want[str(b)] = (len(own), np.corrcoef(a, m)[0, 1] if full else None, a @ m / np.sqrt(a @ a * (m @ m)) if full else None)
    got = {r["barcode"]: (r["n"], r["pearson"], r["cosine"]) for r in found.collect()}
    assert got.keys() == want.keys() and "7" not in got
    assert all(g[0] == w[0] and all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-9) for x, y in zip(g[1:], w[1:], strict=True)) for g, w in ((got[b], want[b]) for b in want))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_pooling_sends_a_row_a_pair(spark):
    features = spark.createDataFrame([("s", "a", [1.0, 5.0]), ("s", "b", [2.0, -3.0]), ("s", "c", [0.0, 9.0])], "wsi string, cell_id string, x array<double>")
    near = spark.createDataFrame([("s", "a", "b"), ("s", "a", "c"), ("s", "b", "a"), ("s", "c", "z")], "wsi string, cell_id string, other_id string")
    found = models.neighbour_pool(features, near)
    assert {r["cell_id"]: r["pooled"] for r in found.collect()} == {"a": [2.0, 9.0], "b": [1.0, 5.0]}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("posexplode") < plan.index("Join")  # vectors are opened after they have met


def test_done_groups_are_not_merged_again(spark, monkeypatch):
    ring = lambda x, y, w, h: [{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]
    made = {f"lone{i}": ring(500 + 20 * i, 500, 5, 5) for i in range(20)} | {f"row{i}": ring(9 * i - 45, -3, 10, 5) for i in range(10)} | {"none": None, "flat": []}
    df = spark.createDataFrame([("s0", c, r) for c, r in made.items()], f"wsi string, cell_id string, ring array<{overlay.POINT}>")
    stored, rounds = space.stored, []

    def kept(rows, name, **options):
        out = stored(rows, name, **options)
        if name == "merged":
            rounds.append({r["component"] for r in out.collect()})
        return out

    monkeypatch.setattr(space, "stored", kept)
    found = space.merged_shapes(df, tile=8.0).select("component", "n_members", overlay.shape_area(F.col("shape")).alias("area")).collect()
    assert {r["component"]: (r["n_members"], round(r["area"], 6)) for r in found} == {c: (1, 25.0) for c in made if c.startswith("lone")} | {"row0": (10, 455.0), "none": (1, 0.0), "flat": (1, 0.0)}
    assert len(rounds[0]) == 23 and 2 < len(rounds) < 9 and all(r == {"row0"} for r in rounds[1:])  # the row lies on both sides of 0


def test_radii_share_one_join(spark, monkeypatch):
    rng, joins, join = np.random.default_rng(6), [], space.near_join
    at, names = rng.integers(0, 100, (200, 2)).astype(float), ["A", "B", "C", None]
    rows = [(f"s{i % 2}", f"c{i:03d}", float(x), float(y), names[i * 7 % 5 % 4], "A") for i, (x, y) in enumerate(at)] + [("s0", "lost", None, None, "A", "A")]
    df = spark.createDataFrame(rows, "wsi string, cell_id string, x double, y double, true_label string, predicted_label string")
    monkeypatch.setattr(space, "CELLS", 20)
    monkeypatch.setattr(space, "near_join", lambda *a, **k: joins.append(k.get("tasks")) or join(*a, **k))

    def majority(i, radius):
        own = [rows[j][4] for j in range(i % 2, 200, 2) if j != i and np.hypot(*(at[i] - at[j])) <= radius]
        most = [n for n in set(own) if own.count(n) == max(map(own.count, own))]
        return min([n for n in most if n], default=None)

    got = {r["cell_id"]: (r["majority_0"], r["majority_1"]) for r in space.majority_labels(df.union(df), [7.0, 15.0]).collect()}
    assert joins == [11] and got == {f"c{i:03d}": (majority(i, 7.0), majority(i, 15.0)) for i in range(200)} | {"lost": (None, None)}
    found = {r["name"]: r["coverage"] for r in readout.neighbor_baseline(df, [7.0, 15.0], ["A", "B", "C"]).collect()}
    assert len(joins) == 2 and found["model"] == 1.0 and all(abs(found[f"neighbours_{r}"] - sum(v[i] is not None for v in got.values()) / 201) < 1e-12 for i, r in enumerate((7, 15)))


def test_windows_are_counted_in_their_bins(spark, monkeypatch):
    rng, tasks, join = np.random.default_rng(9), [], space.near_join
    at = rng.integers(-200, 200, (300, 2))
    df = spark.createDataFrame([(f"s{i % 2}", f"c{i:03d}", int(x), int(y), "AB"[i % 3 % 2]) for i, (x, y) in enumerate(at)] + [("s0", "lost", None, None, "A")], "wsi string, cell_id string, x int, y int, cell_type string")
    monkeypatch.setattr(space, "CELLS", 20)
    monkeypatch.setattr(space, "near_join", lambda *a, **k: tasks.append(k.get("tasks")) or join(*a, **k))
    found = space.window_stats(df, df, 50, ["A", "B"], include_self=False)
    assert tasks == [16]  # 301 rows, more tasks than a shuffle has
    got = {r["cell_id"]: (r["n"], r["n_A"], r["n_B"]) for r in found.collect()}
    near = lambda i: ["AB"[j % 3 % 2] for j in range(i % 2, 300, 2) if j != i and np.abs(at[i] - at[j]).max() <= 25]
    assert got == {f"c{i:03d}": (len(near(i)), near(i).count("A"), near(i).count("B")) for i in range(300)} | {"lost": (None, None, None)}


def test_more_polygons_are_dealt_over_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(domain, "POLYGONS", 10)
    n = domain.table(spark, "/root/testdata/sf0.001", "part").count()
    found = domain.polygons(spark, "/root/testdata/sf0.001")
    assert found.rdd.getNumPartitions() == -(-n // 10) > int(spark.conf.get("spark.sql.shuffle.partitions")) and found.count() == n


def test_places_of_a_block_are_worked_out_at_once(monkeypatch):
    rng = np.random.default_rng(2)
    counts, block = rng.integers(0, 3, (5000, 3)).astype(float), np.sort(rng.integers(0, 4, 5000))
    total = np.cumsum(counts, axis=0)
    before = np.array([counts[block < b].sum(axis=0) for b in block])
    nested = lambda v: pa.array(list(v), pa.list_(pa.float64()))
    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(5000.0)), pa.array(block.astype(np.int32)), nested(counts), nested(before)], ["value", "block", "counts", "before"])
    calls, cumsum = [], np.cumsum
    monkeypatch.setattr(np, "cumsum", lambda *a, **k: calls.append(1) or cumsum(*a, **k))
    found = list(resampling._running(3)(iter([rows.slice(0, 0), *(rows.slice(i, 700) for i in range(0, 5000, 700))])))
    got = np.array([p for b in found for p in b.column("places").to_pylist()])
    assert np.array_equal(got, total - counts / 2) and [v for b in found for v in b.column("value").to_pylist()] == list(range(5000))
    assert 4 <= len(calls) <= 12  # a block or what of it a batch holds, not a value, at a time


def test_upright_rectangles_are_told_from_other_rings():
    box = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    yes = [box(0, 0, 4, 2), [*box(0, 0, 4, 2), (0, 0)], box(0, 0, 4, 2)[::-1], [(0, 0), (1, 0), (4, 0), (4, 2), (0, 2)], [(4, 1), (4, 2), (0, 2), (0, 0), (4, 0)], [(0, 0), (0, 2), (4, 2), (4, 0), (1.3, 0)]]
    no = [box(0, 0, 4, 2) * 2, box(0, 0, 4, 0), [(0, 0), (4, 0), (4, 2)], [(0, 0), (4, 2), (4, 0), (0, 2)], [(0, 1), (1, 0), (2, 1), (1, 2)], [(0, 0), (4, 0), (4, 2), (2, 1), (0, 2)], [(0, 0), (4, 0), (2, 0), (4, 0), (4, 2), (0, 2)], [(0, 0), (4, 0), (4, 1), (2, 1), (2, 2), (0, 2)], [(0, 0), (4, 0), (4, 2), (1, 2), (0, 1)], None, []]
    rings = pa.array([r and [{"x": float(x), "y": float(y)} for x, y in r] for r in yes + no], pa.list_(overlay._POINT))
    want = [True] * len(yes) + [False] * len(no)
    assert overlay.upright_rows(rings)[0].tolist() == want and overlay.upright_rows(rings.slice(3, 6))[0].tolist() == want[3:9]
    more = pa.array([*([[r]] for r in rings.to_pylist()), [], [[]], None, [rings.slice(0, 2).to_pylist()]], overlay._SHAPE)
    assert overlay.upright_rows(more)[0].tolist() == want + [False] * 4


@pytest.mark.parametrize(("near", "odd"), [(64, 0), (1, 3)])
def test_rectangles_are_matched_without_their_rings(spark, monkeypatch, near, odd):
    rng = np.random.default_rng(12)
    monkeypatch.setattr(space, "NEAR", near)
    monkeypatch.setattr(space, "POLYGONS", 20)
    parts, stored = [], space.stored
    monkeypatch.setattr(space, "stored", lambda df, name, **o: (name == "shapes" and parts.append(df.rdd.getNumPartitions())) or stored(df, name, **o))
    made = {}
    for i in range(300):
        x, y, w, h = (float(v) for v in (*rng.integers(0, 300, 2), *rng.integers(2, 12, 2)))
        ring = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
        ring = ring[1:] if odd and i % odd == 0 else ring if i % 2 else [ring[0], (x + 1, y), *ring[1:]][::-1]
        made[f"c{i:03d}"] = (x + w / 2, y + h / 2, ring)
    rows = [("s", c, x, y, 0.0, 0.5, [{"x": a, "y": b} for a, b in r]) for c, (x, y, r) in made.items()] + [("s", "z1", 9000.0, 9000.0, 0.0, 0.5, [{"x": 1.0, "y": 1.0}]), ("s", "y0", 150.0, 150.0, None, None, None)]
    df = spark.createDataFrame(rows, f"wsi string, cell_id string, x double, y double, orientation double, elongation double, ring array<{overlay.POINT}>")
    df = df.filter("ring is not null and size(ring) > 1") if not odd else df
    calls, ratio = spark.sparkContext.accumulator(0), overlay.overlap_ratio

    def counted(a, b, aligned):
        return overlay.by_row(lambda x, y: (calls.add(1), ratio(overlay.parts_of(x), overlay.parts_of(y), aligned))[1], "double", pa.float64(), a, b)

    monkeypatch.setattr(overlay, "shape_overlap", counted)
    got = {r["cell_id"]: (r["other_id"], r["iou"]) for r in space.match_merged(df.filter("cell_id like '%1'"), df.filter("cell_id not like '%1'")).collect()}

    def best(c):
        x, y, ring = made[c]
        near_ = {o: (np.hypot(a - x, b - y), ratio([[ring]], [[r]], True)) for o, (a, b, r) in made.items() if not o.endswith("1") and np.hypot(a - x, b - y) <= 100}
        other = min(near_, key=lambda o: (-round(near_[o][1] - 0.5 * near_[o][0] / 100, 10), o))
        return other, near_[other][1]

    for c in (c for c in made if c.endswith("1")):
        assert got[c][0] == best(c)[0] and abs(got[c][1] - best(c)[1]) < 1e-9
    assert parts == [4, 14]  # as many as the polygons ask for
    assert calls.value > 0 if odd else calls.value == 0
