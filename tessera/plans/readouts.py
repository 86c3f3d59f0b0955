"""Further registered queries: read-outs of tokens, comparisons, writers and readers there and back; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import rings, scalars, vectors
from tessera.operators import expression, joins, readouts, sampling, space, stats, tables
from tessera.plans import domain as d
from tessera.plans.domain import CELLS, CLASSES, EMB, EXPR, POLY, PRED, RUNS
from tessera.plans.queries import _DRAW, _NEAR, query, r6, rounded, signed6
from tessera.sources import readers, sinks
from tessera.sources.storage import scratch

# ---- read-outs of tokens

_CROPS = f"""WITH {POLY}, {EMB}, crops AS (SELECT e.wsi, e.cell_id, e.vector, p.x0 AS px, p.y0 AS py, p.w, p.h, p.x0 - (e.key % 9) * 10 + e.key % 2 AS ox, p.y0 - (e.key % 3) * 10 AS oy FROM emb e LEFT JOIN poly p USING (key)),
met AS (SELECT c.*, r.r, q.q FROM crops c, range(4) r(r), range(4) q(q) WHERE r.r BETWEEN floor((py - oy) / 14) AND floor((py + h - oy) / 14) AND q.q BETWEEN floor((px - ox) / 14) AND floor((px + w - ox) / 14)),
n AS (SELECT wsi, cell_id, count(*) AS n_tokens, list(r * 4 + q ORDER BY r * 4 + q) AS ids, min(CASE WHEN r BETWEEN 1 AND 2 AND q BETWEEN 1 AND 2 THEN 1 ELSE 0 END) AS central FROM met GROUP BY ALL),
each AS (SELECT c.wsi, c.cell_id, vector, coalesce(n_tokens, 0) AS n_tokens, CASE WHEN px IS NULL THEN 'missing' WHEN ids IS NULL THEN 'nearest' ELSE 'overlap' END AS source, central,
  coalesce(ids, [CAST(greatest(0, least(3, round_even((py + h / 2 - oy) / 14 - 0.5, 0))) * 4 + greatest(0, least(3, round_even((px + w / 2 - ox) / 14 - 0.5, 0))) AS BIGINT)]) AS tokens
  FROM crops c LEFT JOIN n ON n.wsi = c.wsi AND n.cell_id = c.cell_id)"""


def _crops(spark, sf_dir):
    shapes = d.polygons(spark, sf_dir).select("key", "ring", "x0", "y0")
    rows = d.embeddings(spark, sf_dir).select("wsi", "cell_id", "key", F.col("vector").alias("flat")).join(shapes, "key", "left")
    return rows.withColumns({"ox": F.col("x0") - (F.col("key") % 9) * 10 + F.col("key") % 2, "oy": F.col("y0") - (F.col("key") % 3) * 10})


def _pooled(spark, sf_dir):
    return readouts.pool_boundary_tokens(_crops(spark, sf_dir), ["wsi", "cell_id"], 14.0, 4, 4, x0="ox", y0="oy")


@query(_CROPS + " SELECT wsi, cell_id, n_tokens, source, list_transform(range(4), lambda k: CASE WHEN source = 'missing' THEN 0.0 ELSE round(list_sum(list_transform(tokens, lambda t: vector[t * 4 + k + 1])) / len(tokens), 6) END) AS pooled FROM each")
def t3_pool_boundary_tokens(spark, sf_dir):
    return _pooled(spark, sf_dir).withColumn("pooled", F.transform("pooled", signed6))


@query(_CROPS + " SELECT count(*) AS n, round(avg(n_tokens), 6) AS mean_tokens, median(n_tokens) AS median_tokens, round(avg(central), 6) AS central_share FROM n")
def a30_token_overlap_summary(spark, sf_dir):
    rows = _crops(spark, sf_dir).filter(F.col("ring").isNotNull())
    met = rings.token_overlap(rows, ["wsi", "cell_id"], 14.0, 4, "ring", "ox", "oy")
    return rounded(readouts.token_overlap_summary(met, ["wsi", "cell_id"], 1, 2), "mean_tokens", "central_share")


@query(_CROPS + " SELECT count(*) AS n, round(avg(CASE WHEN source = 'missing' THEN 1 ELSE 0 END), 6) AS missing_share, round(avg(CASE WHEN source = 'nearest' THEN 1 ELSE 0 END), 6) AS nearest_share FROM each")
def a31_fallback_rate(spark, sf_dir):
    return rounded(readouts.fallback_rate(_pooled(spark, sf_dir)), "missing_share", "nearest_share")


def _report_sql(name: str, rows: str, guess: str) -> str:
    """The rows of a classification report of rows (t, guess), of the classes that domain lists."""
    names = ", ".join(f"('{c}')" for c in CLASSES)
    return f"""(WITH k AS (SELECT * FROM {rows} WHERE {guess} IS NOT NULL), f AS (SELECT l, (SELECT count(*) FROM k WHERE t = l) AS s, (SELECT count(*) FROM k WHERE {guess} = l AND t IN ({", ".join(f"'{c}'" for c in CLASSES)})) AS p, (SELECT count(*) FROM k WHERE t = l AND {guess} = l) AS tp FROM (VALUES {names}) v(l))
  SELECT '{name}' AS name, round((SELECT avg(CASE WHEN {guess} IS NULL THEN 0.0 ELSE 1.0 END) FROM {rows}), 6) AS coverage, round(sum(tp) / (SELECT sum(s) FROM f), 6) AS accuracy, round(avg(CASE WHEN s + p > 0 THEN 2.0 * tp / (s + p) ELSE 0 END), 6) AS macro_f1,
  round(sum(CASE WHEN s + p > 0 THEN 2.0 * tp / (s + p) ELSE 0 END * s) / sum(s), 6) AS weighted_f1, round(avg(CASE WHEN s > 0 THEN tp * 1.0 / s END), 6) AS balanced_accuracy FROM f)"""


_MAJORITY = """v{r} AS (SELECT wsi, cell_id, other_type, count(*) AS n FROM near WHERE cell_id <> other_id AND distance <= {r} GROUP BY ALL),
 b{r} AS (SELECT c.cell_type AS t, m.other_type AS guess FROM cells c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY wsi, cell_id ORDER BY n DESC, other_type) AS r FROM v{r}) m ON m.wsi = c.wsi AND m.cell_id = c.cell_id AND m.r = 1 WHERE c.cell_type <> 'Unknown')"""
_KNOWN_NEAR = _NEAR.replace("abs(a.y - b.y) <= 112)", "abs(a.y - b.y) <= 112 AND a.cell_type <> 'Unknown' AND b.cell_type <> 'Unknown')")
_GUESS = "CASE WHEN key % 4 = 0 THEN 'Stromal' ELSE cell_type END"


@query(_KNOWN_NEAR + ", " + ", ".join(_MAJORITY.format(r=r) for r in (40, 80)) + f", own AS (SELECT cell_type AS t, {_GUESS} AS guess FROM cells WHERE cell_type <> 'Unknown') SELECT * FROM " + _report_sql("model", "own", "guess") + " UNION ALL SELECT * FROM " + _report_sql("neighbours_40", "b40", "guess") + " UNION ALL SELECT * FROM " + _report_sql("neighbours_80", "b80", "guess"))
def a32_neighbor_baseline(spark, sf_dir):
    cells = d.cells(spark, sf_dir).filter("cell_type <> 'Unknown'").withColumn("guess", F.when(F.col("key") % 4 == 0, "Stromal").otherwise(F.col("cell_type")))
    found = readouts.neighbor_baseline(cells, [40.0, 80.0], CLASSES, "cell_type", "guess")
    return rounded(found, *found.columns[1:])


# ---- comparisons

@query(f"""WITH {PRED}, k AS (SELECT split_idx, l.label, count(*) FILTER (true_label = l.label) AS s, count(*) FILTER (predicted_label = l.label) AS p, count(*) FILTER (true_label = l.label AND predicted_label = l.label) AS tp, count(*) AS whole FROM pred, (VALUES ('q0'), ('q1')) l(label) GROUP BY split_idx, l.label)
SELECT label, round(avg(s), 6) AS mean_n, round(avg(s / whole), 6) AS mean_proportion, round(avg(CASE WHEN s + p > 0 THEN 2.0 * tp / (s + p) ELSE 0 END), 6) AS mean_f1, count(*) AS n_rows FROM k GROUP BY label""")
def a36_availability_summary(spark, sf_dir):
    rows = d.predictions(spark, sf_dir)
    f1 = tables.per_class_f1(tables.confusion_matrix(rows, ["q0", "q1", "q2"], group=["split_idx"]), ["split_idx"])
    whole = rows.groupBy("split_idx").agg(F.count("*").alias("whole"))
    rows = f1.join(whole, "split_idx").filter(F.col("label").isin("q0", "q1")).withColumns({"n": F.col("support"), "proportion": F.col("support") / F.col("whole")})
    return rounded(readouts.availability_summary(rows), "mean_n", "mean_proportion", "mean_f1")


@query(f"WITH {RUNS}, r AS (SELECT condition, CASE WHEN split_idx = 7 THEN -1 ELSE split_idx END AS split_idx, metric FROM runs WHERE NOT (split_idx = 7 AND condition = 'click')) SELECT condition, round(avg(metric) FILTER (split_idx >= 0), 6) AS mean, round(stddev_samp(metric) FILTER (split_idx >= 0), 6) AS std, count(*) FILTER (split_idx >= 0) AS n, max(metric) FILTER (split_idx = -1) AS pooled FROM r GROUP BY condition")
def j28_folds_against_pooled(spark, sf_dir):
    rows = d.runs(spark, sf_dir).filter("NOT (split_idx = 7 AND condition = 'click')").withColumn("split_idx", F.when(F.col("split_idx") == 7, -1).otherwise(F.col("split_idx")))
    return rounded(readouts.folds_against_pooled(rows, ["condition"], "metric"), "mean", "std")


@query(f"""WITH {CELLS}, m AS (SELECT *, CASE WHEN key % 10 > 0 THEN CAST(key % 97 AS DOUBLE) END AS v, 1.0 + key % 5 AS area FROM cells),
j AS (SELECT a.wsi, a.cell_id, b.v, row_number() OVER (PARTITION BY a.wsi, a.cell_id ORDER BY md5('0|' || b.cell_id), b.cell_id) AS r FROM m a JOIN m b ON a.wsi = b.wsi AND a.cell_id <> b.cell_id AND b.v IS NOT NULL AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 80 * 80),
u AS (SELECT wsi, cell_id, avg(v) AS around, count(*) AS n_used FROM j WHERE r <= 4 GROUP BY ALL)
SELECT m.wsi, m.cell_id, coalesce(n_used, 0) AS n_used, round(v - around, 6) AS relative, v * area AS integrated FROM m LEFT JOIN u ON u.wsi = m.wsi AND u.cell_id = m.cell_id""")
def a38_dapi_relative(spark, sf_dir):
    key = F.col("key")
    rows = d.cells(spark, sf_dir).withColumns({"mean_intensity": F.when(key % 10 > 0, (key % 97).cast("double")), "area": 1.0 + key % 5})
    return rounded(readouts.dapi_relative(rows, 80.0, 4), "relative")


@query(f"""WITH {PRED}, q AS (SELECT wsi, key, CASE WHEN correct AND key % 3 = 0 THEN 'both' WHEN correct THEN 'only_a' END AS quadrant, CAST(key * 37 % 1009 AS DOUBLE) AS v FROM pred)
SELECT quadrant, count(*) AS n, round(avg(v), 6) AS mean, median(v) AS median FROM q WHERE quadrant IS NOT NULL GROUP BY quadrant""")
def x10_masking_divergence(spark, sf_dir):
    a = d.predictions(spark, sf_dir)
    aligned = joins.align_predictions(a, a.withColumn("correct", F.col("key") % 3 == 0))
    return rounded(readouts.masking_divergence(aligned, a.withColumn("divergence", (F.col("key") * 37 % 1009).cast("double"))), "mean")


@query(f"WITH {CELLS}, {POLY} SELECT c.wsi, 'n' || p.key AS cell_id, c.x, c.y, p.x0, p.w FROM cells c JOIN poly p ON p.key = c.key ORDER BY c.key LIMIT 25")
def l4_first_n_boundary_cells(spark, sf_dir):
    cells = d.cells(spark, sf_dir).withColumn("cell_id", F.concat(F.lit("n"), F.col("key").cast("string")))
    shapes = d.polygons(spark, sf_dir).withColumn("cell_id", F.concat(F.lit("n"), F.col("cell_id"))).join(cells.select("key", F.col("wsi").alias("at")), "key").withColumn("wsi", F.col("at"))
    found = readouts.first_n_boundary_cells(cells, shapes, 25, "key")
    box = rings.bbox(F.col("ring"))
    return found.select("wsi", "cell_id", "x", "y", box["xmin"].alias("x0"), (box["xmax"] - box["xmin"]).alias("w"))


_SPECS = "e(encoder, side, token, center) AS (VALUES " + ", ".join(f"('{n}', {s}, {t}, {c})" for n, s, t, _, c, _ in scalars.ENCODERS) + ")"


@query(f"""WITH {CELLS}, {_SPECS}, m(mode, crop) AS (VALUES ('native', NULL), ('resized', 112), ('tile', 224)), s AS (SELECT encoder, mode, coalesce(crop, side * token) AS crop_px, side * token AS input_px, (side - center) // 2 AS first_token, center AS center_tokens, token FROM e, m)
SELECT wsi, encoder, mode, crop_px, input_px, round(input_px / crop_px, 6) AS scale, first_token, center_tokens, first_token * token AS first_px, count(*) AS n, CAST(sum(greatest(0, least(x - crop_px // 2, 2000 - crop_px))) AS BIGINT) AS x0 FROM s, cells GROUP BY ALL""")
def f5_crop_specs(spark, sf_dir):
    specs = F.broadcast(readouts.crop_specs(spark))  # an encoder and mode each
    rows = d.cells(spark, sf_dir).crossJoin(specs)
    origin = scalars.clamp_origin(F.col("x"), -F.floor(F.col("crop_px") / 2), F.lit(2000), F.col("crop_px"))
    keys = ["wsi", "encoder", "mode", "crop_px", "input_px", r6("scale").alias("scale"), "first_token", "center_tokens", "first_px"]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(origin).cast("long").alias("x0"))


# ---- scalars, rings and joins

@query("""SELECT o_orderkey, greatest(0, least(o_custkey - 112, 5000 - 224)) AS p3, round((o_orderkey % 10) / 10.0 - 0.5 * greatest(0.0, least(1.0, (o_custkey % 170) / 100.0)) - 0.5 * least((o_orderkey % 7) / 7.0, (o_orderkey % 5) / 5.0) * greatest(0.0, least(1.0, (o_orderkey % 90) / 90.0)), 6) + 0.0 AS p16,
CAST(greatest(0, least(15, round_even((o_orderkey % 3000) * 0.01, 0))) AS INTEGER) AS p13, CASE WHEN o_orderkey % 3 = 0 THEN 'pcc' ELSE 'pcc@' || (o_orderkey % 4) END AS p26,
CASE WHEN o_orderkey % 4 = 0 THEN 'default' WHEN o_orderkey % 4 = 1 THEN 'cls' ELSE 'cls_top_left' END AS p24, CASE WHEN o_orderkey % 9 + o_custkey % 3 = 0 THEN 'missing' WHEN o_custkey % 3 = 8 THEN 'skipped' WHEN o_orderkey % 9 + o_custkey % 3 < 8 THEN 'partial' ELSE 'done' END AS p25,
round((o_custkey % 13) / nullif(o_orderkey % 6, 0), 6) AS p27, CASE WHEN o_orderkey % 2 = 0 THEN (o_custkey % 100) * (o_orderkey % 50) * 3 ELSE (o_custkey % 100) * 7 * 2 END AS p31, CAST(least(abs(o_orderkey % 360 - o_custkey % 180) % 180, 180 - abs(o_orderkey % 360 - o_custkey % 180) % 180) AS DOUBLE) AS p17 FROM orders""")
def p_scalars_more(spark, sf_dir):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    keys = F.when(key % 4 == 0, F.array().cast("array<string>")).when(key % 4 == 1, F.array(F.lit("cls"))).otherwise(F.array(F.lit("top_left"), F.lit("cls")))
    even = key % 2 == 0
    return d.table(spark, sf_dir, "orders").select(
        "o_orderkey", scalars.fixed_crop_origin(cust, 224, 5000).alias("p3"),
        (r6(scalars.penalty_score((key % 10) / 10.0, (cust % 170).cast("double"), (key % 90).cast("double"), (key % 7) / 7.0, (key % 5) / 5.0)) + 0.0).alias("p16"),
        scalars.relative_position((key % 3000).cast("double"), 0.01, 16).alias("p13"), scalars.probe_key(F.lit("pcc"), F.when(key % 3 != 0, key % 4)).alias("p26"),
        scalars.tokens_segment(keys).alias("p24"), scalars.completeness(key % 9, cust % 3, 8).alias("p25"), r6(scalars.tissue_fraction(cust % 13, key % 6)).alias("p27"),
        scalars.image_bytes(F.when(even, cust % 100), F.when(even, key % 50), F.concat_ws(",", (cust % 100).cast("string"), F.lit("7"), F.lit("2"))).alias("p31"),
        r6(scalars.angle_difference((key % 360).cast("double"), (cust % 180).cast("double"))).alias("p17"),
    )


@query(f"""WITH {POLY} SELECT wsi, cell_id, round((x0 - 5) * 0.5, 6) AS fx, round((y0 - 7) * 0.5, 6) AS fy, round((2 * x0 + 3 * 0.2125) / 0.2125, 4) AS ax, round((y0 - 1 * 0.2125) / 0.2125, 4) AS ay,
CAST(greatest(0, least(15, round_even((y0 + h / 2 - 100.3) / 100 - 0.5, 0))) AS INTEGER) AS near_row, CAST(greatest(0, least(15, round_even((x0 + w / 2 - 50.3) / 100 - 0.5, 0))) AS INTEGER) AS near_col FROM poly""")
def p11_p12_g8_rings(spark, sf_dir):
    rows = d.polygons(spark, sf_dir)
    m = F.array(*[F.array(*map(F.lit, row)) for row in ([2.0, 0.0, 3.0], [0.0, 1.0, -1.0], [0.0, 0.0, 1.0])])
    first = lambda ring: F.get(ring, F.lit(0))
    frame, moved, at = first(rings.to_crop_frame(F.col("ring"), F.lit(5.0), F.lit(7.0), 0.5)), first(rings.affine(F.col("ring"), m)), rings.centroid(rings.moments(F.col("ring")))
    near = rings.nearest_token(at["x"], at["y"], F.lit(50.3), F.lit(100.3), 100.0, 16)
    return rows.select("wsi", "cell_id", r6(frame["x"]).alias("fx"), r6(frame["y"]).alias("fy"), F.round(moved["x"], 4).alias("ax"), F.round(moved["y"], 4).alias("ay"), near["row"].alias("near_row"), near["col"].alias("near_col"))


@query(f"""WITH {EMB}, p AS (SELECT wsi, cell_id, vector[1:16] AS a, vector[17:32] AS b FROM emb), u AS (SELECT wsi, cell_id, unnest(a) AS x, unnest(b) AS y FROM p)
SELECT wsi, cell_id, round(corr(x, y), 5) AS r, round((max(CASE WHEN x IS NOT NULL THEN 0 END) + first(x) - 0.5) / (2 + 1e-8), 5) AS z FROM (SELECT wsi, cell_id, x, y FROM u) GROUP BY wsi, cell_id""".replace("first(x)", "min_by(x, i)").replace("unnest(b) AS y FROM p", "unnest(b) AS y, unnest(range(16)) AS i FROM p").replace("SELECT wsi, cell_id, x, y FROM u", "SELECT wsi, cell_id, x, y, i FROM u"))
def t6_t8_vectors(spark, sf_dir):
    rows = d.embeddings(spark, sf_dir).select("wsi", "cell_id", F.slice("vector", 1, 16).alias("a"), F.slice("vector", 17, 16).alias("b"))
    z = vectors.z_score(F.col("a"), F.array_repeat(F.lit(0.5), 16), F.array_repeat(F.lit(2.0), 16))
    return rows.select("wsi", "cell_id", F.round(vectors.pearson(F.col("a"), F.col("b")), 5).alias("r"), F.round(F.get(z, F.lit(0)), 5).alias("z"))


@query(f"WITH {CELLS}, b AS (SELECT wsi, cell_id, key % 2 = 0 AS hit, cell_type FROM cells WHERE key % 5 < 3) SELECT b.wsi, cell_type, count(*) FILTER (hit) AS n_attached, count(*) FILTER (NOT hit) AS n_unmatched FROM b GROUP BY ALL")
def j7_attach_ground_truth(spark, sf_dir):
    cells = d.cells(spark, sf_dir)
    best = cells.filter(F.col("key") % 5 < 3).select("wsi", F.col("cell_id").alias("other_id"), F.concat(F.lit("d"), "cell_id").alias("cell_id"))
    truth = cells.filter(F.col("key") % 2 == 0).withColumn("native_cell_id", F.col("cell_id"))
    lost = best.join(cells.select("wsi", F.col("cell_id").alias("other_id"), "cell_type", "key"), ["wsi", "other_id"])
    attached = joins.attach_ground_truth(best, truth).groupBy("wsi", "cell_type").agg(F.count("*").alias("n_attached"))
    return lost.groupBy("wsi", "cell_type").agg(F.count_if(F.col("key") % 2 != 0).alias("n_unmatched")).join(attached, ["wsi", "cell_type"], "left").select("wsi", "cell_type", F.coalesce("n_attached", F.lit(0)).alias("n_attached"), "n_unmatched")


@query(f"WITH {CELLS} SELECT DISTINCT cell_type AS sample FROM cells WHERE cell_type NOT IN (SELECT cell_type FROM cells WHERE key % 12 < 4)")
def j26_validate_samples(spark, sf_dir):
    cells = d.cells(spark, sf_dir)
    return joins.validate_samples(cells.select(F.col("cell_type").alias("sample")).distinct(), cells.filter(F.col("key") % 12 < 4).select(F.col("cell_type").alias("sample")).distinct())


@query("SELECT round(avg(least(abs(l_quantity * 7 - l_tax * 900) % 180, 180 - abs(l_quantity * 7 - l_tax * 900) % 180)), 4) AS mean_error, -round(avg(least(abs(l_quantity * 7 - l_tax * 900) % 180, 180 - abs(l_quantity * 7 - l_tax * 900) % 180)), 4) AS selection FROM lineitem")
def a25_angular_error(spark, sf_dir):
    rows = d.table(spark, sf_dir, "lineitem").withColumns({"t": F.col("l_quantity") * 7, "p": F.col("l_tax") * 900})
    found = tables.angular_error(rows, "t", "p")
    return found.select(F.round("mean_error", 4).alias("mean_error"), F.round("selection", 4).alias("selection"))


@query("WITH g AS (SELECT p_partkey AS gene, CASE WHEN p_partkey % 4 > 0 THEN p_retailprice END AS rank, CASE WHEN p_partkey % 9 > 0 THEN CAST(p_size AS DOUBLE) END AS pearson, row_number() OVER (ORDER BY CASE WHEN p_partkey % 4 > 0 THEN p_retailprice END NULLS LAST, p_partkey) AS r FROM part) SELECT t.top_n, count(pearson) AS n, round(avg(pearson), 6) AS mean, median(pearson) AS median FROM g, (VALUES (10), (100), (100000)) t(top_n) WHERE r <= t.top_n GROUP BY t.top_n")
def a27_gene_interval_stats(spark, sf_dir):
    key = F.col("p_partkey")
    genes = d.table(spark, sf_dir, "part").select(key.alias("gene"), F.when(key % 4 > 0, F.col("p_retailprice")).alias("rank"), F.when(key % 9 > 0, F.col("p_size").cast("double")).alias("pearson"))
    return rounded(tables.gene_interval_stats(genes, [10, 100, 100000]), "mean")


@query("SELECT count(*) AS n, round(avg(CASE WHEN o_orderkey % 4 > 0 THEN 1 ELSE 0 END), 6) AS matched_share, count(*) FILTER (o_totalprice > 100000) AS n_above, round(median(sqrt((o_custkey % 30) ** 2 + (o_orderkey % 40) ** 2)), 6) AS median_offset FROM orders")
def a35_match_report(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = d.table(spark, sf_dir, "orders").select(F.when(key % 4 > 0, key).alias("other_id"), F.col("o_totalprice").alias("score"), (F.col("o_custkey") % 30).cast("double").alias("dx"), (key % 40).cast("double").alias("dy"))
    return rounded(tables.match_report(rows, 100000.0), "matched_share", "median_offset")


@query(_NEAR + ", k AS (SELECT wsi, cell_id, key FROM cells) SELECT n.wsi, n.cell_id, round(avg(k.key % 100), 6) AS smoothed FROM near n JOIN k ON k.wsi = n.wsi AND k.cell_id = n.other_id WHERE distance <= 60 GROUP BY n.wsi, n.cell_id")
def m11_spatial_smooth(spark, sf_dir):
    cells = d.cells(spark, sf_dir)
    return rounded(sampling.spatial_smooth(cells.withColumn("v", F.col("key") % 100), space.radius_join(cells, cells, 60.0), "v"), "smoothed")


@query(f"WITH {CELLS}, j AS (SELECT a.wsi, a.cell_id, b.cell_id AS other_id, row_number() OVER (PARTITION BY a.wsi, a.cell_id ORDER BY md5('3|' || b.cell_id), b.cell_id) AS r FROM cells a JOIN cells b ON a.wsi = b.wsi AND a.cell_id <> b.cell_id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 80 * 80) SELECT wsi, cell_id, other_id FROM j WHERE r <= 3")
def w6_cap_neighbors(spark, sf_dir):
    cells = d.cells(spark, sf_dir)
    return tables.cap_per_key(space.radius_join(cells, cells, 80.0), ["wsi", "cell_id"], 3, 3, "other_id").select("wsi", "cell_id", "other_id")


@query(f"WITH {PRED}, t(lr, depth, fixed) AS (VALUES (0.1, 1.0, 7.0), (0.1, 2.0, 7.0), (0.01, 1.0, 7.0), (0.01, 2.0, 7.0)) SELECT lr, depth, fixed, count(*) FILTER (correct) AS n FROM t, pred GROUP BY ALL")
def m10_expand_grid(spark, sf_dir):
    grid = sampling.expand_grid(spark, {"lr": [0.1, 0.01], "depth": [1, 2]}, {"fixed": [7, 8]}).drop("trial_idx")
    return d.predictions(spark, sf_dir).filter("correct").crossJoin(F.broadcast(grid)).groupBy("lr", "depth", "fixed").agg(F.count("*").alias("n"))  # four trials


# ---- written and read back

@query(f"WITH {CELLS} SELECT wsi, cell_id, x_start, y_start, cell_type, x, y FROM cells WHERE wsi IN ('s1', 's4')")
def s1_k1_cells_there_and_back(spark, sf_dir):
    path = scratch(spark, "cells")
    sinks.write_cells(d.cells(spark, sf_dir).select("wsi", "cell_id", "x_start", "y_start", "cell_type"), path)
    return readers.read_cells(spark, path, ["s1", "s4"]).select("wsi", "cell_id", "x_start", "y_start", "cell_type", "x", "y")


def _written_embeddings(spark, sf_dir):
    path = scratch(spark, "embeddings")
    rows = d.embeddings(spark, sf_dir).withColumns({"model": F.when(F.col("key") % 2 == 0, "a").otherwise("b"), "correction": F.lit("none"), "cell_label": F.col("label"), "matching": F.col("key") % 3 > 0, "x_centroid": F.col("key") * 2.0, "y_centroid": F.col("key") * 3.0})
    sinks.write_embeddings(rows.select("model", "correction", "wsi", "cell_id", "cell_label", "matching", "x_centroid", "y_centroid", "tokens"), path)
    return path


_MEAN4 = "list_transform(range(1, 17), lambda i: round((vector[i] + vector[i + 16] + vector[i + 32] + vector[i + 48]) / 4, 6)) AS vector"


@query(f"WITH {EMB} SELECT wsi, cell_id, label, {_MEAN4} FROM emb WHERE key % 2 = 0 AND key % 3 > 0 AND wsi IN ('s0', 's2')")
def s2_k2_p9_embeddings_there_and_back(spark, sf_dir):
    found = readers.read_embeddings(spark, _written_embeddings(spark, sf_dir), "a", "none", ["s0", "s2"], matching=True)
    return found.select("wsi", "cell_id", "label", F.transform("vector", signed6).alias("vector"))


@query(f"WITH {EMB} SELECT wsi, cell_id, label, round((vector[1] + vector[49]) / 2, 6) AS first, key * 2.0 AS x_centroid, key * 3.0 AS y_centroid, key % 3 > 0 AS matching FROM emb WHERE key % 2 = 1")
def s3_embeddings_with_coords(spark, sf_dir):
    found = readers.read_embeddings_with_coords(spark, _written_embeddings(spark, sf_dir), "b", "none", tokens=["top_left", "cls"])
    return found.select("wsi", "cell_id", "label", r6(F.get("vector", F.lit(0))).alias("first"), "x_centroid", "y_centroid", "matching")


@query(f"WITH {EXPR} SELECT wsi, barcode, gene, CAST(count AS DOUBLE) AS count FROM expr WHERE wsi = 's3' AND gene IN ('g1', 'g7')")
def s9_expression_there_and_back(spark, sf_dir):
    path = scratch(spark, "expression")
    d.expression(spark, sf_dir).hint("rebalance", "wsi").write.partitionBy("wsi").parquet(path)
    return readers.read_expression(spark, path, ["s3"], ["g1", "g7"]).select("wsi", "barcode", "gene", F.col("count").cast("double").alias("count"))


@query("SELECT p_partkey AS gene_name, CAST(CASE WHEN p_partkey % 3 > 0 THEN p_partkey END AS VARCHAR) AS highly_variable_rank, p_partkey % 5 > 0 AS present_in_test, row_number() OVER (ORDER BY CASE WHEN p_partkey % 3 > 0 THEN p_partkey END NULLS LAST, p_partkey) <= 20 AS top, 'x' AS made_of FROM part WHERE p_partkey % 5 > 0")
def s10_k10_hvgs_there_and_back(spark, sf_dir):
    key, path = F.col("p_partkey"), scratch(spark, "hvgs")
    rows = d.table(spark, sf_dir, "part").select(key.alias("gene_name"), F.when(key % 3 > 0, key).alias("highly_variable_rank"), (key % 5 > 0).alias("present_in_test"), F.lit("all").alias("split_label"))
    sinks.write_hvgs(rows, path, {"made_of": "x"})
    return readers.read_hvg_table(spark, path, 20).drop("split_label").withColumn("highly_variable_rank", F.col("highly_variable_rank").cast("string"))


@query("SELECT 'c' || c_custkey AS sample, c_custkey % 2 = 0 AS converted FROM customer WHERE c_custkey % 3 > 0")
def s11_k12_manifest_there_and_back(spark, sf_dir):
    key, path = F.col("c_custkey"), scratch(spark, "manifest")
    rows = d.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), key.cast("string")).alias("sample"), F.when(key % 2 == 0, " Yes ").otherwise("no").alias("converted"), F.when(key % 3 > 0, "OK").otherwise("failed").alias("status"))
    sinks.write_csv(rows, path)
    return readers.read_manifest(spark, path).select("sample", "converted")


@query(f"WITH {PRED} SELECT split_idx, cell_id, true_label, predicted_label FROM pred")
def s16_k7_predictions_there_and_back(spark, sf_dir):
    path = scratch(spark, "predictions")
    sinks.write_predictions(d.predictions(spark, sf_dir).select("split_idx", "cell_id", "true_label", "predicted_label"), path)
    return spark.read.parquet(path).select("split_idx", "cell_id", "true_label", "predicted_label")


@query(f"WITH {PRED} SELECT CASE WHEN key % 2 = 0 THEN 'val' ELSE 'test' END AS side, cell_id, CAST(CASE WHEN key % 2 = 0 THEN key END AS VARCHAR) AS only_val FROM pred")
def k8_probe_results_there_and_back(spark, sf_dir):
    rows, path = d.predictions(spark, sf_dir), scratch(spark, "probe")
    sinks.write_probe_results(rows.filter("key % 2 = 0").select("cell_id", F.col("key").cast("string").alias("only_val")), rows.filter("key % 2 = 1").select("cell_id"), path)
    return spark.read.parquet(path).select("side", "cell_id", "only_val")


@query(f"WITH {CELLS} SELECT 'w' || key % 3 AS name, wsi, cell_id, CAST(CASE WHEN key % 4 > 0 THEN key END AS VARCHAR) AS other_id FROM cells")
def k4_matches_there_and_back(spark, sf_dir):
    key, path = F.col("key"), scratch(spark, "matches")
    sinks.write_matches(d.cells(spark, sf_dir).select(F.concat(F.lit("w"), (key % 3).cast("string")).alias("name"), "wsi", "cell_id", F.when(key % 4 > 0, key.cast("string")).alias("other_id")), path)
    return spark.read.parquet(path).select("name", "wsi", "cell_id", "other_id")


@query(f"WITH {RUNS} SELECT condition, split_idx, metric, metric > 50 AS stale FROM runs UNION ALL SELECT condition, split_idx, metric, NULL FROM runs WHERE split_idx < 2")
def k6_trials_there_and_back(spark, sf_dir):
    rows, path = d.runs(spark, sf_dir), scratch(spark, "trials")
    sinks.append(rows.withColumn("stale", F.col("metric") > 50), path, "condition")
    sinks.append(rows.filter("split_idx < 2").withColumn("stale", F.lit(None).cast("boolean")), path, "condition")
    return spark.read.parquet(path).select("condition", "split_idx", "metric", "stale")


@query(f"WITH {RUNS} SELECT condition, split_idx, metric, true AS rebuilt FROM runs WHERE split_idx > 2")
def k11_cache_with_meta(spark, sf_dir):
    path, rows = scratch(spark, "cache"), d.runs(spark, sf_dir)
    sinks.cache_with_meta(spark, path, {"least": 0}, lambda: rows)
    found, stale = sinks.cache_with_meta(spark, path, {"least": 2}, lambda: rows.filter("split_idx > 2"))
    return found.withColumn("rebuilt", F.lit(stale))


@query(f"WITH {POLY} SELECT 's9' AS wsi, cell_id, 4 AS n_points, x0 AS xmin, y0 AS ymin, x0 + w AS xmax, y0 + h AS ymax FROM poly")
def s4_g1_boundaries_there_and_back(spark, sf_dir):
    path = scratch(spark, "boundaries")
    rows = d.polygons(spark, sf_dir).select("cell_id", F.posexplode(F.concat("ring", F.slice("ring", 1, 1))).alias("vertex", "p"))
    rows.select("cell_id", "vertex", F.col("p.x").alias("vertex_x"), F.col("p.y").alias("vertex_y")).orderBy("cell_id", "vertex").write.parquet(path)
    rebuilt = rings.build_polygon(readers.read_boundaries(spark, path, "s9", "nucleus"))
    return rebuilt.select("wsi", "cell_id", F.size("ring").alias("n_points"), rings.bbox(F.col("ring")).alias("b")).select("wsi", "cell_id", "n_points", "b.*")


@query("SELECT DISTINCT 'part' AS dataset, 'parquet' AS kind, false AS duplicate, count(*) OVER () AS n FROM (VALUES (1)) t(x)")
def s17_inventory(spark, sf_dir):
    path = scratch(spark, "inventory")
    d.table(spark, sf_dir, "part").coalesce(1).write.parquet(path)
    return readers.inventory(spark, path).groupBy(F.regexp_extract("name", "^([a-z]+)-", 1).alias("dataset"), "kind", "duplicate").agg(F.count("*").alias("n"))


@query(f"WITH {CELLS} SELECT wsi, cell_id, CAST(key % 7 AS DOUBLE) AS mean_intensity, CAST(key % 5 AS DOUBLE) AS area FROM cells")
def s19_dapi_stats(spark, sf_dir):
    path, key = scratch(spark, "dapi"), F.col("key")
    d.cells(spark, sf_dir).select("wsi", "cell_id", (key % 7).cast("double").alias("mean_intensity"), (key % 5).cast("double").alias("area")).write.parquet(path)
    return readers.read_dapi_stats(spark, path)
