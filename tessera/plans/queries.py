"""Registered queries over the given tables, named after the operators that they apply, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import labels, rings, scalars, vectors
from tessera.operators import expression, joins, models, sampling, space, stats, tables
from tessera.plans import domain as d
from tessera.plans.domain import CELLS, CLASSES, EMB, EXPR, MASKED, POLY, PRED, RUNS
from tessera.sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def r6(c: Column | str) -> Column:
    return F.round(c if isinstance(c, Column) else F.col(c), 6)


def signed6(c: Column) -> Column:
    """c as a double, rounded; what rounds to zero keeps its sign, as in SQL."""
    x = c.cast("double")
    return F.when(r6(x) == 0, F.signum(x) * 0.0).otherwise(r6(x))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


# ---- space

_NEAR = f"""WITH {CELLS}, near AS (SELECT a.wsi, a.cell_id, b.cell_id AS other_id, a.cell_type, b.cell_type AS other_type, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS distance, a.x AS ax, a.y AS ay, b.x AS ox, b.y AS oy
  FROM cells a JOIN cells b ON a.wsi = b.wsi AND abs(a.x - b.x) <= 112 AND abs(a.y - b.y) <= 112)"""
_COUNTS = ", ".join(f"count(*) FILTER (other_type = '{c}') AS n_{c}" for c in CLASSES)


@query(_NEAR + ", s AS (SELECT wsi, cell_id, count(*) AS n, " + _COUNTS + " FROM near GROUP BY ALL) SELECT wsi, cell_id, " + ", ".join(f"round(n_{c} / n, 6) AS f_{c}" for c in CLASSES) + ", true AS valid FROM s")
def composition_at_px(spark, sf_dir):
    cells = d.cells(spark, sf_dir)
    return rounded(space.composition(space.window_stats(cells, cells, 224, CLASSES), CLASSES), *[f"f_{c}" for c in CLASSES])


@query(_NEAR + " SELECT wsi, cell_id, count(*) AS n, " + _COUNTS + " FROM near GROUP BY ALL")
def a3_window_stats(spark, sf_dir):
    cells = d.cells(spark, sf_dir)
    return space.window_stats(cells, cells, 224, CLASSES)


@query(_NEAR + " SELECT wsi, cell_id, count(*) AS n, round(ln(1 + count(*)), 6) AS log_n, round(count(*) * (100.0 / 224) * (100.0 / 224), 6) AS density FROM near GROUP BY ALL")
def a5_cell_density(spark, sf_dir):
    cells = d.cells(spark, sf_dir)
    stats_ = space.window_stats(cells, cells, 224, [])
    return stats_.select("wsi", "cell_id", "n", r6(scalars.log1p_target(F.col("n"))).alias("log_n"), r6(scalars.density(F.col("n"), 224)).alias("density"))


@query(_NEAR + " SELECT wsi, cell_id, other_id FROM near WHERE cell_id <> other_id")
def j4_window_join(spark, sf_dir):
    cells = d.cells(spark, sf_dir)
    return space.window_join(cells, cells, 224, include_self=False).select("wsi", "cell_id", "other_id")


@query(_NEAR + " SELECT wsi, cell_id, other_id, round(distance, 6) AS distance FROM near WHERE cell_id <> other_id AND distance <= 60")
def j5_radius_join(spark, sf_dir):
    cells = d.cells(spark, sf_dir)
    return rounded(space.radius_join(cells, cells, 60).select("wsi", "cell_id", "other_id", "distance"), "distance")


@query(f"""WITH {CELLS}, r AS (SELECT a.wsi, a.cell_id, b.cell_id AS other_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS distance FROM cells a JOIN cells b ON a.wsi = b.wsi AND a.cell_id <> b.cell_id),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY wsi, cell_id ORDER BY distance, other_id) AS INTEGER) AS rank FROM r) SELECT wsi, cell_id, rank, other_id, round(distance, 6) AS distance FROM k WHERE rank <= 5""")
def j6_knn_join(spark, sf_dir):
    return rounded(space.knn_join(d.cells(spark, sf_dir), 5), "distance")


@query(_NEAR + """ SELECT c.wsi, c.cell_id, count(other_id) AS n, round(avg(CAST(other_type <> c.cell_type AS INTEGER)), 6) AS heterotypic, count(other_id) = 0 AS isolated
 FROM cells c LEFT JOIN (SELECT * FROM near WHERE cell_id <> other_id AND abs(ax - ox) <= 24 AND abs(ay - oy) <= 24) n ON n.wsi = c.wsi AND n.cell_id = c.cell_id GROUP BY c.wsi, c.cell_id""")
def a6_neighbor_types(spark, sf_dir):
    return rounded(space.neighbor_type_stats(d.cells(spark, sf_dir), 48), "heterotypic")


@query(_NEAR + """, v AS (SELECT wsi, cell_id, other_type, count(*) AS n FROM near WHERE cell_id <> other_id AND distance <= 56 GROUP BY ALL),
 m AS (SELECT wsi, cell_id, other_type AS majority, row_number() OVER (PARTITION BY wsi, cell_id ORDER BY n DESC, other_type) AS r FROM v) SELECT c.wsi, c.cell_id, majority FROM cells c LEFT JOIN (SELECT * FROM m WHERE r = 1) m ON m.wsi = c.wsi AND m.cell_id = c.cell_id""")
def a11_majority_label(spark, sf_dir):
    return space.majority_label(d.cells(spark, sf_dir), 56, "cell_type")


_OFFSETS = "offsets AS (SELECT *, CASE WHEN key % 3 = 0 THEN CAST(key % 11 AS DOUBLE) END AS dx, CASE WHEN key % 3 = 0 THEN CAST(key % 7 AS DOUBLE) END AS dy FROM cells)"


def _offsets(spark, sf_dir):
    some = F.col("key") % 3 == 0
    return d.cells(spark, sf_dir).withColumns({"dx": F.when(some, (F.col("key") % 11).cast("double")), "dy": F.when(some, (F.col("key") % 7).cast("double"))})


@query(f"""WITH {CELLS}, {_OFFSETS}, j AS (SELECT a.wsi, a.cell_id, b.dx, b.dy FROM offsets a JOIN offsets b ON a.wsi = b.wsi AND b.dx IS NOT NULL AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 112 * 112)
SELECT c.wsi, c.cell_id, round(avg(j.dx), 6) AS dx, round(avg(j.dy), 6) AS dy, count(j.dx) AS n_used FROM cells c LEFT JOIN j ON j.wsi = c.wsi AND j.cell_id = c.cell_id GROUP BY c.wsi, c.cell_id""")
def a10_average_offsets(spark, sf_dir):
    return rounded(space.average_offsets(_offsets(spark, sf_dir)), "dx", "dy")


_ORIENTED = "oriented AS (SELECT *, CAST(key * 13 % 180 AS DOUBLE) AS orientation FROM cells), det AS (SELECT * FROM oriented WHERE key % 2 = 0), ref AS (SELECT * FROM oriented WHERE key % 2 = 1)"


@query(f"""WITH {CELLS}, {_ORIENTED}, w(name, wd, wo, wi) AS (VALUES ('even', 1.0, 1.0, 1.0), ('shape', 1.0, 1.2, 5.0)),
c AS (SELECT a.wsi, a.cell_id, b.cell_id AS other_id, 1 / (1 + sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 15) AS ds, 1 - least(abs(a.orientation - b.orientation) % 180, 180 - abs(a.orientation - b.orientation) % 180) / 90 AS os
  FROM det a JOIN ref b ON a.wsi = b.wsi AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 6400),
s AS (SELECT c.*, name, wd * ds + wo * os AS score, row_number() OVER (PARTITION BY wsi, cell_id, name ORDER BY round(wd * ds + wo * os, 12) DESC, other_id) AS r FROM c, w)
SELECT det.wsi, det.cell_id, w.name, other_id, round(ds, 6) AS distance_score, round(os, 6) AS orientation_score, round(score, 6) AS score FROM det CROSS JOIN w LEFT JOIN s ON s.wsi = det.wsi AND s.cell_id = det.cell_id AND s.name = w.name AND r = 1""")
def j1_match_by_radius(spark, sf_dir):
    cells = d.cells(spark, sf_dir).withColumn("orientation", (F.col("key") * 13 % 180).cast("double"))
    weightings = spark.createDataFrame([("even", 1.0, 1.0, 1.0), ("shape", 1.0, 1.2, 5.0)], "name string, w_distance double, w_orientation double, w_iou double")
    found = space.match_by_radius(cells.filter("key % 2 = 0"), cells.filter("key % 2 = 1"), weightings)
    return rounded(found, "distance_score", "orientation_score", "score").drop("iou_score")


@query(f"WITH {CELLS}, t AS (SELECT *, (x // 112) AS cx, (y // 112) AS cy FROM cells) SELECT wsi, CAST(greatest(0, least(cx * 112 - 56, 100000 - 224)) AS BIGINT) AS patch_x, CAST(greatest(0, least(cy * 112 - 56, 100000 - 224)) AS BIGINT) AS patch_y, count(*) AS n, min(cell_id) AS first FROM t GROUP BY wsi, cx, cy")
def a29_tile_groups(spark, sf_dir):
    tiles = space.tile_groups(d.cells(spark, sf_dir), 100000, 100000)
    return tiles.select("wsi", F.col("patch_x").cast("long"), F.col("patch_y").cast("long"), F.size("cells").cast("long").alias("n"), F.get("cells", F.lit(0))["cell_id"].alias("first"))


@query(f"""WITH {CELLS}, bad AS (SELECT DISTINCT wsi, x_start // 256 AS col, y_start // 256 AS row FROM cells WHERE key % 50 = 0)
SELECT DISTINCT c.wsi, c.cell_id FROM cells c JOIN bad b ON c.wsi = b.wsi AND b.col BETWEEN x_start // 256 AND (x_start + 223) // 256 AND b.row BETWEEN y_start // 256 AND (y_start + 223) // 256""")
def j24_cells_on_bad_tiles(spark, sf_dir):
    cells = d.cells(spark, sf_dir)
    bad = cells.filter("key % 50 = 0").select("wsi", F.floor(F.col("x_start") / 256).alias("col"), F.floor(F.col("y_start") / 256).alias("row")).distinct()
    return space.cells_on_bad_tiles(cells.select("wsi", "cell_id", F.col("x_start").alias("x0"), F.col("y_start").alias("y0")), bad, 256, 224)


@query(f"WITH {CELLS} SELECT wsi, cell_id, x, y FROM cells WHERE x >= 200 AND x < 648 AND y >= 100 AND y < 548")
def j25_cells_in_window(spark, sf_dir):
    return space.cells_in_window(space.cells_in_window(d.cells(spark, sf_dir), 200, 100, 448), 200, 100, 448).select("wsi", "cell_id", "x", "y")


@query(f"""WITH RECURSIVE {POLY}, p AS (SELECT a.wsi, a.cell_id AS a, b.cell_id AS b FROM poly a JOIN poly b ON a.wsi = b.wsi AND a.cell_id <> b.cell_id AND a.x0 <= b.x0 + b.w AND b.x0 <= a.x0 + a.w AND a.y0 <= b.y0 + b.h AND b.y0 <= a.y0 + a.h),
r AS (SELECT wsi, cell_id, cell_id AS c FROM poly UNION SELECT r.wsi, r.cell_id, p.b FROM r JOIN p ON p.wsi = r.wsi AND p.a = r.c),
l AS (SELECT wsi, cell_id, min(c) AS component FROM r GROUP BY wsi, cell_id) SELECT wsi, component, count(*) AS n, string_agg(cell_id, ',' ORDER BY cell_id) AS members FROM l GROUP BY wsi, component""")
def g9_merge_touching(spark, sf_dir):
    merged = space.merge_touching(d.polygons(spark, sf_dir).select("wsi", "cell_id", "ring"))
    return merged.select("wsi", "component", F.size("members").cast("long").alias("n"), F.array_join("members", ",").alias("members"))


# ---- geometry

@query(f"""WITH {POLY} SELECT wsi, cell_id, w * h AS area, round(CASE WHEN w = h THEN 0 ELSE sqrt(1 - (least(w, h) / greatest(w, h)) ** 2) END, 5) AS eccentricity, CAST(CASE WHEN h > w THEN 90 ELSE 0 END AS DOUBLE) AS orientation, x0 + w / 2 AS cx, y0 + h / 2 AS cy FROM poly""")
def g3_shape_descriptors(spark, sf_dir):
    rows = rings.shape_descriptors(d.polygons(spark, sf_dir).select("wsi", "cell_id", "ring"))
    tidy = lambda c: F.round(c, 4)
    return rows.select("wsi", "cell_id", tidy("area").alias("area"), F.round("eccentricity", 5).alias("eccentricity"), (tidy(F.pmod(F.col("orientation") + 1e-6, F.lit(180.0))) + 0.0).alias("orientation"), tidy("cx").alias("cx"), tidy("cy").alias("cy"))


@query(f"""WITH {POLY} SELECT wsi, cell_id, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col FROM poly, range(16) a(r), range(16) b(c)
WHERE x0 % 50 + w >= c * 14 AND x0 % 50 <= (c + 1) * 14 AND y0 % 40 + h >= r * 14 AND y0 % 40 <= (r + 1) * 14
AND c >= floor((x0 % 50) / 14) AND r >= floor((y0 % 40) / 14)""")
def g7_token_overlap(spark, sf_dir):
    rows = d.polygons(spark, sf_dir).withColumns({"ox": F.col("x0") - F.col("x0") % 50, "oy": F.col("y0") - F.col("y0") % 40})
    return rings.token_overlap(rows, ["wsi", "cell_id"], 14.0, 16, "ring", "ox", "oy")


@query(f"WITH {POLY} SELECT wsi, cell_id, x0 AS xmin, y0 AS ymin, x0 + w AS xmax, y0 + h AS ymax, CAST(round_even(x0 + w / 2 - greatest(round_even(greatest(w, h), 0), 1) / 2, 0) AS INTEGER) AS bx, CAST(greatest(round_even(greatest(w, h), 0), 1) AS INTEGER) AS side FROM poly")
def p4_polygon_crop_box(spark, sf_dir):
    rows = d.polygons(spark, sf_dir).withColumn("b", rings.bbox(F.col("ring")))
    box = scalars.polygon_crop_box(*[F.col(f"b.{c}") for c in ("xmin", "ymin", "xmax", "ymax")])
    return rows.withColumn("c", box).select("wsi", "cell_id", "b.*", F.col("c.x0").alias("bx"), F.col("c.side").alias("side"))


# ---- scalars and labels

@query(f"""WITH {CELLS} SELECT wsi, cell_id, x_start + 112 AS cx, greatest(0, least(x_start + 112 - 100, 1000 - 224)) AS x0, string_split(cell_id, '_')[-1] AS barcode, (floor(x / 256) % 2 = 0) AND (floor(y / 256) % 2 = 0) AS on_board,
CAST(least(15, greatest(0, floor((x % 224) / 14))) AS INTEGER) AS token_col, round(cos(2 * radians(key % 180)), 6) + 0.0 AS cos2 FROM cells""")
def p_scalars(spark, sf_dir):
    rows = d.cells(spark, sf_dir)
    return rows.select(
        "wsi", "cell_id", scalars.cell_center(F.col("x_start")).alias("cx"), scalars.clamp_origin(F.col("x"), -100, 1000, 224).alias("x0"), scalars.barcode(F.col("cell_id")).alias("barcode"),
        scalars.checkerboard(F.col("x"), F.col("y"), 256).alias("on_board"), scalars.token_index(F.col("x") % 224, 14, 16).alias("token_col"), (r6(F.get(scalars.angle_to_doubled((F.col("key") % 180).cast("double")), F.lit(0))) + 0.0).alias("cos2"),
    )


@query(f"WITH {CELLS} SELECT raw_type, cell_type AS broad, CASE WHEN raw_type IN ('Epithelial', 'Malignant') THEN 'epithelial_malignant' WHEN raw_type IN ('Neural/Glial', 'Erythrocyte') THEN 'Unknown' ELSE 'non_epithelial_malignant' END AS binary, count(*) AS n FROM cells GROUP BY ALL")
def p7_map_label(spark, sf_dir):
    rows = d.cells(spark, sf_dir).withColumns({"broad": labels.map_label(F.col("raw_type"), "simplified_broad"), "binary": labels.map_label(F.col("raw_type"), "epithelial_malignant_vs_rest")})
    return rows.groupBy("raw_type", "broad", "binary").agg(F.count("*").alias("n"))


@query(f"WITH {CELLS}, k AS (SELECT cell_type, CAST(row_number() OVER (ORDER BY cell_type) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT cell_type FROM cells WHERE cell_type <> 'Unknown')) SELECT cell_type, code, count(*) AS n FROM cells JOIN k USING (cell_type) GROUP BY ALL")
def p10_label_encode(spark, sf_dir):
    known = labels.drop_unknown(d.cells(spark, sf_dir), "cell_type")
    return labels.label_encode(known, "cell_type").groupBy("cell_type", "code").agg(F.count("*").alias("n"))


@query(f"WITH {PRED} SELECT split_idx, CASE WHEN correct AND c2 THEN 'both' WHEN correct THEN 'only_a' WHEN c2 THEN 'only_b' ELSE 'neither' END AS quadrant, count(*) AS n FROM (SELECT *, key % 3 = 0 AS c2 FROM pred) GROUP BY ALL")
def j14_align_predictions(spark, sf_dir):
    a = d.predictions(spark, sf_dir)
    b = a.withColumn("correct", F.col("key") % 3 == 0)
    found = joins.align_predictions(a, b).join(a.select("wsi", "cell_id", "split_idx"), ["wsi", "cell_id"])
    return found.groupBy("split_idx", "quadrant").agg(F.count("*").alias("n"))


# ---- vectors

@query(f"WITH {EMB} SELECT wsi, cell_id, list_transform(range(1, 17), lambda i: round((vector[i] + vector[i + 16] + vector[i + 32] + vector[i + 48]) / 4, 6)) AS pooled, round((vector[1] + vector[49]) / 2, 6) AS two FROM emb")
def t1_pool_tokens(spark, sf_dir):
    rows = d.embeddings(spark, sf_dir)
    two = F.get(vectors.pool_tokens(F.col("tokens"), ["top_left", "cls"]), F.lit(0))
    return rows.select("wsi", "cell_id", F.transform(vectors.pool_tokens(F.col("tokens")), signed6).alias("pooled"), signed6(two).alias("two"))


@query(f"WITH {EMB} SELECT wsi, cell_id, vector[25:28] AS token, CAST(list_position(vector, list_max(vector)) - 1 AS INTEGER) AS top, list_transform(list_zip(vector, range(64)), lambda z: round(CASE WHEN z[2] IN (27, 28, 35, 36) THEN 0.0 ELSE z[1] END, 6)) AS masked FROM emb")
def t2_t4_tokens(spark, sf_dir):
    rows = d.embeddings(spark, sf_dir)
    token = F.transform(vectors.select_token(F.col("vector"), F.lit(1), F.lit(2), 4, 4), lambda x: x.cast("double"))
    masked = vectors.mask_tokens(F.col("vector"), scalars.block_tokens(8, 2), F.lit(0.0))
    return rows.select("wsi", "cell_id", token.alias("token"), vectors.argmax(F.col("vector")).alias("top"), F.transform(masked, signed6).alias("masked"))


@query(f"WITH {EMB}, {MASKED} SELECT a.wsi, a.cell_id, round(1 - list_cosine_similarity(a.vector, b.vector), 5) AS drift FROM emb a JOIN masked b USING (wsi, cell_id)")
def j13_drift(spark, sf_dir):
    rows = d.embeddings(spark, sf_dir)
    return joins.drift(rows, d.masked(rows)).withColumn("drift", F.round("drift", 5))


@query(f"WITH {EMB}, e AS (SELECT unnest(range(64)) AS i, unnest(vector) AS v FROM emb) SELECT CAST(i AS INTEGER) AS dim, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM e GROUP BY i")
def a20_vector_stats(spark, sf_dir):
    return rounded(vectors.vector_stats(d.embeddings(spark, sf_dir), "vector"), "mean", "std")


@query(f"WITH {EMB}, m AS (SELECT list_sum(list_transform(list_zip(a.vector, b.vector), lambda z: z[1] * z[2])) AS ab, list_sum(list_transform(a.vector, lambda z: z)) AS sa, a.* FROM emb a JOIN emb b ON b.key = a.key), s AS (SELECT wsi, cell_id, vector, list_sum(list_transform(vector, lambda x: exp(x))) AS t FROM emb) SELECT wsi, cell_id, round(exp(vector[1]) / t, 6) AS soft FROM s")
def t9_softmax(spark, sf_dir):
    rows = d.embeddings(spark, sf_dir)
    return rows.select("wsi", "cell_id", r6(F.get(vectors.softmax(F.col("vector")), F.lit(0))).alias("soft"))


# ---- expression

@query(f"WITH {EXPR} SELECT wsi, barcode, gene, round(ln(1 + count / CASE WHEN sum(count) OVER (PARTITION BY wsi, barcode) = 0 THEN 1 ELSE sum(count) OVER (PARTITION BY wsi, barcode) END * 100), 6) AS value FROM expr")
def a9_normalize(spark, sf_dir):
    return rounded(expression.normalize_log1p(d.expression(spark, sf_dir)), "value").select("wsi", "barcode", "gene", "value")


_NORM = f"WITH {EXPR}, norm AS (SELECT wsi, barcode, gene, ln(1 + count / sum(count) OVER (PARTITION BY wsi, barcode) * 100) AS value FROM expr), bar AS (SELECT DISTINCT wsi, barcode FROM expr)"


@query(_NORM + """, n AS (SELECT wsi, count(*) AS n FROM bar GROUP BY wsi), m AS (SELECT wsi, gene, sum(value) / any_value(n) AS mean, sqrt(greatest(sum(value * value) / any_value(n) - (sum(value) / any_value(n)) ** 2, 0)) AS std FROM norm JOIN n USING (wsi) WHERE gene IN ('g1', 'g7', 'g20') GROUP BY ALL),
 f AS (SELECT b.wsi, b.barcode, (coalesce(v.value, 0) - mean) / CASE WHEN std > 1e-9 THEN std ELSE 1 END AS z FROM bar b JOIN m USING (wsi) LEFT JOIN norm v ON v.wsi = b.wsi AND v.barcode = b.barcode AND v.gene = m.gene) SELECT wsi, barcode, round(avg(z), 5) + 0.0 AS score FROM f GROUP BY ALL""")
def a8_marker_score(spark, sf_dir):
    rows = d.expression(spark, sf_dir)
    markers = spark.createDataFrame([("g1",), ("g7",), ("g20",)], "gene string")
    found = expression.marker_score(expression.normalize_log1p(rows), d.expression_cells(rows), markers)
    return found.withColumn("score", F.round("score", 5) + 0.0)


@query(f"WITH {EXPR}, t AS (SELECT gene, count AS t, count * 0.5 + CAST(barcode AS BIGINT) % 13 AS p FROM expr) SELECT gene, count(*) AS n, round(corr(t, p), 6) AS pearson FROM t GROUP BY gene")
def a26_gene_pearson(spark, sf_dir):
    rows = d.expression(spark, sf_dir).select("gene", F.col("count").alias("true"), (F.col("count") * 0.5 + F.col("barcode").cast("long") % 13).alias("predicted"))
    return rounded(expression.per_gene_pearson(rows), "pearson")


@query(f"WITH {EXPR} SELECT gene, count(DISTINCT wsi) = (SELECT count(DISTINCT wsi) FROM expr) AS present FROM expr GROUP BY gene")
def j21_gene_presence(spark, sf_dir):
    rows = d.expression(spark, sf_dir)
    return joins.gene_presence(rows.select("gene").distinct(), rows.select("wsi", "gene"))


@query()
def a28_rank_hvgs(spark, sf_dir):
    rows = d.expression(spark, sf_dir)
    return expression.rank_hvgs(rows, d.expression_cells(rows), 20)


# ---- tables

@query(f"WITH {RUNS} SELECT condition, round(avg(metric), 5) AS mean, round(stddev_samp(metric), 5) AS std, count(metric) AS n FROM runs GROUP BY condition")
def a12_mean_std(spark, sf_dir):
    return tables.mean_std_n(d.runs(spark, sf_dir), ["condition"], "metric").withColumns({c: F.round(c, 5) for c in ("mean", "std")})


@query(f"WITH {RUNS} SELECT round(avg(a.metric - b.metric), 5) AS mean, round(stddev_samp(a.metric - b.metric), 5) AS std, count(*) AS n FROM runs a JOIN runs b USING (split_idx) WHERE a.condition = 'click' AND b.condition = 'view'")
def j16_paired_diff(spark, sf_dir):
    return tables.paired_diff(d.runs(spark, sf_dir), ["split_idx"], "condition", "click", "view", "metric").withColumns({c: F.round(c, 5) for c in ("mean", "std")})


@query(f"""WITH {RUNS}, j AS (SELECT a.condition, a.metric - b.metric AS dd FROM runs a JOIN runs b USING (split_idx) WHERE b.condition = 'view'), g AS (SELECT condition, avg(metric) AS m, count(*) AS n FROM runs GROUP BY condition)
SELECT condition, round(any_value(m), 5) AS mean, any_value(n) AS n, round(avg(dd), 5) AS diff_mean, count(dd) AS diff_n FROM g LEFT JOIN j USING (condition) GROUP BY condition""")
def a37_compare(spark, sf_dir):
    found = tables.compare(d.runs(spark, sf_dir), ["split_idx"], "condition", "view", "metric")
    return found.select("condition", F.round("mean", 5).alias("mean"), "n", F.round("diff_mean", 5).alias("diff_mean"), F.coalesce("diff_n", F.lit(0)).alias("diff_n"))


@query(f"WITH {RUNS} SELECT a.condition, round(avg(a.metric / b.metric), 5) AS mean, count(*) AS n FROM runs a JOIN runs b USING (split_idx) WHERE b.condition = 'view' AND b.metric <> 0 GROUP BY a.condition")
def j29_fold_change(spark, sf_dir):
    return tables.fold_change(d.runs(spark, sf_dir), ["split_idx"], "condition", "view", "metric").select("condition", F.round("mean", 5).alias("mean"), "n")


@query("SELECT event_type, round(avg(value), 5) AS mean, round(median(value), 5) AS median, round(stddev_samp(value), 5) AS std, count(value) AS n, round(stddev_samp(value) / sqrt(count(value)), 5) AS sem FROM events GROUP BY event_type")
def a14_describe(spark, sf_dir):
    return tables.describe_by_group(d.table(spark, sf_dir, "events"), "event_type", "value").withColumns({c: F.round(c, 5) for c in ("mean", "median", "std", "sem")})


@query("SELECT count(value) AS n, round(avg(value), 5) AS mean, round(quantile_cont(value, 0.5), 5) AS median, round(quantile_cont(value, 0.05), 5) AS p5, round(quantile_cont(value, 0.95), 5) AS p95, round(min(value), 5) AS min, round(max(value), 5) AS max, count(*) FILTER (value < 1 OR value > 90) AS n_clipped FROM events")
def a15_distribution(spark, sf_dir):
    return tables.distribution_summary(d.table(spark, sf_dir, "events"), "value", 1.0, 90.0).withColumns({c: F.round(c, 5) for c in ("mean", "median", "p5", "p95", "min", "max")})


@query("WITH b AS (SELECT event_type, CAST(least(19, floor((greatest(0.0, least(100.0, value))) / 5.0)) AS INTEGER) AS bin FROM events WHERE value IS NOT NULL) SELECT event_type, bin, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY event_type) * 5.0), 6) AS density FROM b GROUP BY event_type, bin")
def a16_histogram(spark, sf_dir):
    return rounded(tables.histogram(d.table(spark, sf_dir, "events"), "value", 0.0, 100.0, 20, ["event_type"]), "density")


@query("""WITH e AS (SELECT list_distinct(quantile_cont(l_quantity, [i / 8.0 for i in range(9)])) AS e FROM lineitem), b AS (SELECT greatest(len(list_filter(e, lambda x: x < l_quantity)) - 1, 0) AS bin, l_quantity AS x, l_extendedprice AS y FROM lineitem, e)
SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(x), 4) AS x_mean, round(avg(y), 4) AS y_mean, round(stddev_samp(y), 4) AS y_std FROM b GROUP BY bin""")
def a17_quantile_bins(spark, sf_dir):
    found = tables.quantile_bins(d.table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", 8)
    return found.select("bin", "n", *[F.round(c, 4).alias(c) for c in ("x_mean", "y_mean", "y_std")])


@query(f"""WITH {CELLS}, a AS (SELECT wsi, sqrt(3) / 3 * x / 100 - y / 300.0 AS q, 2.0 / 3 * y / 100 AS r FROM cells), b AS (SELECT *, round_even(q, 0) AS rq, round_even(r, 0) AS rr, round_even(-q - r, 0) AS rs FROM a),
c AS (SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs + q + r) AS ds FROM b) SELECT wsi, CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS INTEGER) AS q, CAST(CASE WHEN dq > dr AND dq > ds THEN rr WHEN dr > ds THEN -rq - rs ELSE rr END AS INTEGER) AS r, count(*) AS n FROM c GROUP BY ALL""")
def a18_hexbin(spark, sf_dir):
    return tables.hexbin(d.cells(spark, sf_dir), "x", "y", 100.0, ["wsi"]).drop("log_n")


_CONF = f"WITH {PRED}, l(x) AS (VALUES ('q0'), ('q1'), ('q2')), conf AS (SELECT t.x AS true_label, p.x AS predicted_label, (SELECT count(*) FROM pred WHERE true_label = t.x AND predicted_label = p.x) AS n FROM l t, l p)"


@query(_CONF + " SELECT * FROM conf")
def a22_confusion(spark, sf_dir):
    return tables.confusion_matrix(d.predictions(spark, sf_dir), ["q0", "q1", "q2"])


@query(_CONF + """, s AS (SELECT x AS label, (SELECT sum(n) FROM conf WHERE true_label = x) AS sup, (SELECT sum(n) FROM conf WHERE predicted_label = x) AS pr, (SELECT sum(n) FROM conf WHERE predicted_label = x AND true_label = x) AS tp FROM l),
 f AS (SELECT *, CASE WHEN sup + pr > 0 THEN 2.0 * tp / (sup + pr) ELSE 0 END AS f1 FROM s) SELECT round(sum(tp) / sum(sup), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * sup) / sum(sup), 6) AS weighted_f1, round(avg(CASE WHEN sup > 0 THEN tp / sup END), 6) AS balanced_accuracy FROM f""")
def a23_report(spark, sf_dir):
    report = tables.classification_report(tables.confusion_matrix(d.predictions(spark, sf_dir), ["q0", "q1", "q2"]))
    return rounded(report, *report.columns)


@query("WITH t AS (SELECT l_returnflag, l_extendedprice AS t, l_quantity * 1500.0 AS p, avg(l_extendedprice) OVER (PARTITION BY l_returnflag) AS m FROM lineitem) SELECT l_returnflag, count(*) AS n, round(1 - sum((t - p) ** 2) / sum((t - m) ** 2), 6) AS r2 FROM t GROUP BY l_returnflag")
def a24_r2(spark, sf_dir):
    rows = d.table(spark, sf_dir, "lineitem").withColumn("p", F.col("l_quantity") * 1500.0)
    return rounded(tables.r2_score(rows, "l_extendedprice", "p", ["l_returnflag"]), "r2")


@query(f"WITH {CELLS}, w AS (SELECT wsi, cell_type, cell_id, (count(*) OVER ()) / (6.0 * count(*) OVER (PARTITION BY cell_type)) * ((count(*) OVER ()) / ((SELECT count(DISTINCT wsi) FROM cells) * 1.0 * count(*) OVER (PARTITION BY wsi))) AS w FROM cells) SELECT wsi, cell_id, round(w / avg(w) OVER (), 5) AS weight FROM w")
def a33_sample_weights(spark, sf_dir):
    return tables.sample_weights(d.cells(spark, sf_dir), 6, label="cell_type").select("wsi", "cell_id", F.round("weight", 5).alias("weight"))


@query(f"WITH {CELLS} SELECT s.wsi, k.cell_type, count(c.cell_id) AS n, round(count(c.cell_id) / sum(count(c.cell_id)) OVER (PARTITION BY s.wsi), 6) AS proportion FROM (SELECT DISTINCT wsi FROM cells) s CROSS JOIN (SELECT DISTINCT cell_type FROM cells) k LEFT JOIN cells c ON c.wsi = s.wsi AND c.cell_type = k.cell_type GROUP BY s.wsi, k.cell_type")
def a1_class_counts(spark, sf_dir):
    rows = d.cells(spark, sf_dir)
    return rounded(tables.class_counts(rows, rows.select("cell_type"), ["wsi"], "cell_type"), "proportion")


@query(f"WITH {RUNS} SELECT split_idx, " + ", ".join(f"round(max(metric) FILTER (condition = '{c}'), 6) AS {c}" for c in ("click", "view", "purchase")) + " FROM runs GROUP BY split_idx")
def a13_pivot(spark, sf_dir):
    return rounded(tables.pivot_metric(d.runs(spark, sf_dir), "split_idx", "condition", ["click", "view", "purchase"], "metric"), "click", "view", "purchase")


@query(f"WITH {RUNS} SELECT condition, metric, split_idx FROM (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY metric DESC, split_idx) AS r FROM runs) WHERE r = 1")
def w2_best_trial(spark, sf_dir):
    return tables.select_best_trial(d.runs(spark, sf_dir).withColumnRenamed("split_idx", "trial_idx"), ["condition"], "metric").withColumnRenamed("trial_idx", "split_idx")


@query("WITH r AS (SELECT l_quantity, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rank FROM lineitem) SELECT l_quantity, any_value(CAST(rank AS DOUBLE)) AS rank, count(*) AS n FROM r GROUP BY l_quantity")
def w4_average_rank(spark, sf_dir):
    return tables.average_rank(d.table(spark, sf_dir, "lineitem").select("l_quantity"), "l_quantity").groupBy("l_quantity", "rank").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def l1_top_k(spark, sf_dir):
    return tables.top_k(d.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 25)


@query("WITH q AS (SELECT quantile_cont(o_totalprice, 0.05) AS lo, quantile_cont(o_totalprice, 0.45) AS m1, quantile_cont(o_totalprice, 0.55) AS m2, quantile_cont(o_totalprice, 0.95) AS hi FROM orders) SELECT count(*) FILTER (o_totalprice <= lo) AS bottom, count(*) FILTER (o_totalprice BETWEEN m1 AND m2) AS mid, count(*) FILTER (o_totalprice >= hi) AS top FROM orders, q")
def l2_l3_masks(spark, sf_dir):
    found = tables.quantile_masks(d.table(spark, sf_dir, "orders"), "o_totalprice", {"bottom": (0.0, 0.05), "mid": (0.45, 0.55), "top": (0.95, 1.0)})
    return found.agg(*[F.count_if(c).alias(c) for c in ("bottom", "mid", "top")])


@query("SELECT wsi, n_c AS n, dup FROM (SELECT o_custkey % 7 AS wsi, count(*) AS n_c, dup FROM (SELECT o_custkey, count(*) OVER (PARTITION BY o_custkey) > 1 AS dup FROM orders) GROUP BY o_custkey % 7, dup)")
def w7_duplicates(spark, sf_dir):
    rows = tables.duplicates(d.table(spark, sf_dir, "orders").select("o_custkey"), ["o_custkey"])
    return rows.groupBy((F.col("o_custkey") % 7).alias("wsi"), F.col("duplicate").alias("dup")).agg(F.count("*").alias("n"))


@query(f"WITH {RUNS} SELECT condition, split_idx, metric FROM runs WHERE split_idx < 4 UNION ALL SELECT condition, split_idx, metric FROM runs WHERE split_idx >= 6 AND condition <> 'view'")
def o1_o3_sets(spark, sf_dir):
    rows = d.runs(spark, sf_dir)
    return tables.union_all(rows.filter("split_idx < 4"), rows.filter("split_idx >= 6").join(rows.filter("condition = 'view'").select("condition").distinct(), "condition", "left_anti"))


# ---- sampling

_DRAW = "md5('0|' || wsi || '|' || cell_id)"


@query(f"WITH {CELLS}, r AS (SELECT wsi, cell_id, row_number() OVER (PARTITION BY wsi ORDER BY {_DRAW}, cell_id) AS r, count(*) OVER (PARTITION BY wsi) AS n FROM cells) SELECT wsi, cell_id FROM r WHERE r <= greatest(1, floor(n * 0.05)) AND wsi IN ('s0', 's3')")
def m1_sample_proportion(spark, sf_dir):
    want = spark.createDataFrame([("s0", 0.05), ("s3", 0.05)], "wsi string, proportion double")
    return sampling.sample_proportion(d.cells(spark, sf_dir), want).select("wsi", "cell_id")


@query(f"WITH {CELLS}, r AS (SELECT wsi, cell_id, cell_type, row_number() OVER (PARTITION BY wsi, cell_type ORDER BY {_DRAW}, cell_id) AS r, count(*) OVER (PARTITION BY wsi, cell_type) AS n FROM cells) SELECT wsi, cell_type, count(*) AS n FROM r WHERE NOT (wsi = 's1' AND cell_type = 'Myeloid') AND (NOT (wsi = 's1' AND cell_type = 'Stromal') OR r <= greatest(1, floor(n * 0.1))) GROUP BY ALL")
def m2_sample_cell_types(spark, sf_dir):
    want = spark.createDataFrame([("s1", "Myeloid", 0.0), ("s1", "Stromal", 0.1)], "wsi string, cell_type string, proportion double")
    return sampling.sample_cell_types(d.cells(spark, sf_dir), want).groupBy("wsi", "cell_type").agg(F.count("*").alias("n"))


@query(f"WITH {CELLS}, r AS (SELECT wsi, cell_id, row_number() OVER (ORDER BY {_DRAW}, wsi, cell_id) AS r, count(*) OVER () AS n FROM cells) SELECT wsi, cell_id, CASE WHEN r <= floor(n * 0.7) THEN 'train' WHEN r <= floor(n * 0.85) THEN 'val' ELSE 'test' END AS side FROM r")
def m5_random_split(spark, sf_dir):
    return sampling.random_split(d.cells(spark, sf_dir), ["wsi", "cell_id"], {"train": 0.7, "val": 0.15, "test": 0.15}).select("wsi", "cell_id", "side")


@query(f"WITH {CELLS} SELECT wsi, cell_id, CAST(s AS INTEGER) AS split_idx FROM cells, range(4) t(s) WHERE (CAST(floor(y / 256) AS BIGINT) % 2) * 2 + CAST(floor(x / 256) AS BIGINT) % 2 = s")
def m6_checkerboard_folds(spark, sf_dir):
    return sampling.spatial_checkerboard_folds(d.cells(spark, sf_dir), 256).filter("side = 'test'").drop("side")


@query(f"""WITH {CELLS}, c AS (SELECT wsi, cell_id, CAST(floor(y / 256) AS BIGINT) AS py, CAST(floor(x / 256) AS BIGINT) AS px FROM cells), p AS (SELECT *, (py % 2) * 2 + px % 2 = split_idx AS own FROM (SELECT DISTINCT wsi, py, px FROM c), (SELECT CAST(s AS INTEGER) AS split_idx FROM range(4) t(s))),
r AS (SELECT *, row_number() OVER (PARTITION BY split_idx, own ORDER BY md5('0|' || split_idx || '|' || wsi || '|' || py || '|' || px), wsi, py, px) AS r, count(*) OVER (PARTITION BY split_idx, own) AS n FROM p)
SELECT wsi, cell_id, split_idx, CASE WHEN own THEN 'test' WHEN r <= floor(n * 0.8) THEN 'train' ELSE 'val' END AS side FROM c JOIN r USING (wsi, py, px)""")
def m6_checkerboard_sides(spark, sf_dir):
    return sampling.spatial_checkerboard_folds(d.cells(spark, sf_dir), 256)


# ---- statistics

_XY = "WITH xy AS (SELECT 's' || (o_custkey % 7) AS wsi, o_totalprice AS x, CAST(o_custkey AS DOUBLE) AS y, o_orderkey AS key FROM orders)"


def _xy(spark, sf_dir):
    return d.table(spark, sf_dir, "orders").select(F.concat(F.lit("s"), (F.col("o_custkey") % 7).cast("string")).alias("wsi"), F.col("o_totalprice").alias("x"), F.col("o_custkey").cast("double").alias("y"), F.col("o_orderkey").alias("key"))


@query(_XY + ", r AS (SELECT wsi, rank() OVER (PARTITION BY wsi ORDER BY x) + (count(*) OVER (PARTITION BY wsi, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY wsi ORDER BY y) + (count(*) OVER (PARTITION BY wsi, y) - 1) / 2.0 AS ry FROM xy) SELECT wsi, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY wsi")
def x1_spearman_by_slide(spark, sf_dir):
    return rounded(stats.spearman(_xy(spark, sf_dir), "x", "y", ["wsi"], 20), "rho")


@query(_XY + " SELECT wsi, count(*) AS n, round(corr(x, y), 6) AS r FROM xy GROUP BY wsi")
def x2_pearson_by_slide(spark, sf_dir):
    return rounded(stats.pearson_by_group(_xy(spark, sf_dir), "x", "y"), "r")


@query(_XY + """, m AS (SELECT *, key % 4 = 0 AS a FROM xy WHERE key % 4 < 2), r AS (SELECT *, rank() OVER (PARTITION BY wsi ORDER BY x) + (count(*) OVER (PARTITION BY wsi, x) - 1) / 2.0 AS rx FROM m), s AS (SELECT wsi, count(*) FILTER (a) AS n_a, count(*) FILTER (NOT a) AS n_b, sum(rx) FILTER (a) AS rs FROM r GROUP BY wsi)
SELECT wsi, n_a, n_b, round(2 * (rs - n_a * (n_a + 1) / 2) / (n_a * n_b) - 1, 6) AS delta FROM s WHERE n_a > 0 AND n_b > 0""")
def x7_cliffs_delta(spark, sf_dir):
    rows = _xy(spark, sf_dir).withColumns({"a": F.col("key") % 4 == 0, "b": F.col("key") % 4 == 1})
    return rounded(stats.cliffs_delta(rows, "x", "a", "b", ["wsi"]), "delta")


@query(_XY + ", m AS (SELECT *, key % 4 = 0 AS a FROM xy WHERE key % 4 < 2), r AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx FROM m) SELECT count(*) FILTER (a) AS n_a, count(*) FILTER (NOT a) AS n_b, round(sum(rx) FILTER (a) - count(*) FILTER (a) * (count(*) FILTER (a) + 1) / 2, 3) AS u FROM r")
def x8_mann_whitney(spark, sf_dir):
    rows = _xy(spark, sf_dir).withColumns({"a": F.col("key") % 4 == 0, "b": F.col("key") % 4 == 1})
    return stats.mann_whitney(rows, "x", "a", "b").select("n_a", "n_b", F.round("u", 3).alias("u"))


@query()
def x3_block_permutation(spark, sf_dir):
    return stats.block_permutation_spearman(_xy(spark, sf_dir), "x", "y", "key")


@query()
def x4_stouffer(spark, sf_dir):
    per = stats.spearman(_xy(spark, sf_dir), "x", "y", ["wsi"], 20)
    return stats.stouffer_signed(per.withColumn("p_value", stats.two_sided_p(F.col("rho"), F.col("n"))))


@query()
def x5_cluster_bootstrap(spark, sf_dir):
    rows = _xy(spark, sf_dir).withColumns({"a": F.col("key") % 4 == 0, "b": F.col("key") % 4 == 1})
    return stats.cluster_bootstrap_median_diff(rows, "x", "a", "b", stats.bootstrap_draws(spark, [f"s{i}" for i in range(7)], 2000))


@query()
def x6_bootstrap_corr(spark, sf_dir):
    draws = stats.bootstrap_draws(spark, [f"s{i}" for i in range(7)], 2000)
    return stats.cluster_bootstrap_corr(_xy(spark, sf_dir), "x", "y", draws)


# ---- models

@query()
def e1_ridge(spark, sf_dir):
    rows = d.embeddings(spark, sf_dir).withColumn("y", F.slice("vector", 1, 2)).withColumn("x", F.slice("vector", 3, 62))
    fits = models.ridge_fit(models.gram(rows, "x", "y"), [1.0])
    w, b = fits[1.0]
    return rows.withColumn("p", models.ridge_predict(w, b, F.col("x"))).select("wsi", "cell_id", r6(F.get("p", F.lit(0))).alias("p0"), r6(F.get("p", F.lit(1))).alias("p1"))


@query()
def e4_classifier(spark, sf_dir):
    rows = labels.label_encode(d.embeddings(spark, sf_dir), "label")
    names = [f"c{i}" for i in range(10)]
    model = models.logistic_fit(rows.filter(F.col("key") % 5 != 0), "vector", "code", 1e-3)
    found = models.predict_classes(model, rows.filter(F.col("key") % 5 == 0).select("wsi", "cell_id", "label", "vector"), names, "vector")
    return tables.classification_report(tables.confusion_matrix(found, names, "label"))


@query(f"WITH {EMB} SELECT label, count(*) AS n FROM emb WHERE label IN (SELECT DISTINCT label FROM emb WHERE wsi <> 's0' AND label <> 'c3') AND wsi = 's0' GROUP BY label")
def j23_restrict_classes(spark, sf_dir):
    rows = d.embeddings(spark, sf_dir)
    train = rows.filter("wsi <> 's0' AND label <> 'c3'")
    return joins.restrict_to_train_classes(rows.filter("wsi = 's0'"), train).groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH {CELLS} SELECT wsi, cell_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY wsi), 6) AS proportion, CAST(sum(count(*)) OVER (PARTITION BY wsi) AS BIGINT) AS n_cells, count(*) OVER (PARTITION BY wsi) AS n_classes FROM cells GROUP BY wsi, cell_type")
def k3_dataset_stats(spark, sf_dir):
    rows = sinks.dataset_stats(d.cells(spark, sf_dir), "cell_type").filter("n > 0").withColumnRenamed("label", "cell_type")
    return rounded(rows, "proportion")


@query(f"WITH {RUNS} SELECT condition, split_idx, CASE WHEN split_idx >= 6 THEN 0.0 ELSE metric END AS metric FROM runs")
def k9_upsert(spark, sf_dir):
    rows = d.runs(spark, sf_dir)
    return sinks.upserted(rows, rows.filter("split_idx >= 6").withColumn("metric", F.lit(0.0)), ["condition", "split_idx"])


@query(f"WITH {CELLS} SELECT wsi, cell_id, string_split(cell_id, '_')[2] AS native_cell_id FROM cells")
def s12_native_id(spark, sf_dir):
    return readers.with_native_id(d.cells(spark, sf_dir)).select("wsi", "cell_id", "native_cell_id")


# ---- more operators of the inventory

@query(f"WITH {EMB}, {MASKED}, dr AS (SELECT a.wsi, 1 - list_cosine_similarity(a.vector, b.vector) AS drift FROM emb a JOIN masked b USING (wsi, cell_id)) SELECT wsi, count(*) AS n, round(avg(drift), 5) AS mean, round(median(drift), 5) AS median FROM dr GROUP BY wsi")
def a14_drift_per_slide(spark, sf_dir):
    rows = d.embeddings(spark, sf_dir)
    found = tables.describe_by_group(joins.drift(rows, d.masked(rows)), "wsi", "drift")
    return found.select("wsi", "n", F.round("mean", 5).alias("mean"), F.round("median", 5).alias("median"))


@query(f"""WITH {EMB}, near AS (SELECT a.wsi, a.cell_id, b.vector FROM emb a JOIN emb b ON a.wsi = b.wsi AND b.key = a.key + 7 OR (a.wsi = b.wsi AND b.key = a.key + 14)), e AS (SELECT wsi, cell_id, unnest(range(64)) AS i, unnest(vector) AS v FROM near), m AS (SELECT wsi, cell_id, i, max(v) AS v FROM e GROUP BY ALL)
SELECT wsi, cell_id, list(round(v, 6) ORDER BY i) AS pooled FROM m GROUP BY wsi, cell_id""")
def t7_neighbor_max_pool(spark, sf_dir):
    rows = d.embeddings(spark, sf_dir)
    near = rows.select("wsi", "cell_id", F.explode(F.array(F.col("key") + 7, F.col("key") + 14)).alias("o")).withColumn("other_id", F.concat(F.lit("v"), F.col("o").cast("string")))
    found = models.neighbour_pool(rows, near, "vector")
    return found.select("wsi", "cell_id", F.transform("pooled", signed6).alias("pooled"))


@query(f"WITH {CELLS}, h AS (SELECT *, key % 5 <> 0 AS known FROM cells) SELECT wsi, cell_id, CASE WHEN known THEN x END AS x, known AS valid FROM h")
def j10_resolve_positions(spark, sf_dir):
    cells = d.cells(spark, sf_dir)
    return joins.resolve_positions(cells.select("wsi", "cell_id"), cells.filter("key % 5 <> 0")).select("wsi", "cell_id", "x", "valid")


@query(f"WITH {CELLS}, {EXPR} SELECT c.wsi, count(*) AS n, round(sum(e.count), 3) AS total FROM cells c JOIN expr e ON e.wsi = c.wsi AND e.barcode = string_split(c.cell_id, '_')[2] GROUP BY c.wsi")
def j11_join_expression(spark, sf_dir):
    found = joins.join_expression(d.cells(spark, sf_dir).select("wsi", "cell_id"), d.expression(spark, sf_dir))
    return found.groupBy("wsi").agg(F.count("*").alias("n"), F.round(F.sum("count"), 3).alias("total"))


@query(f"""WITH {CELLS}, {_ORIENTED}, c AS (SELECT a.wsi, a.cell_id, b.cell_id AS other_id, 1 / (1 + sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 15) + 1 - least(abs(a.orientation - b.orientation) % 180, 180 - abs(a.orientation - b.orientation) % 180) / 90 AS score
  FROM det a JOIN ref b ON a.wsi = b.wsi AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 6400), t AS (SELECT *, row_number() OVER (PARTITION BY wsi, cell_id ORDER BY round(score, 12) DESC, other_id) AS r FROM c),
u AS (SELECT *, row_number() OVER (PARTITION BY wsi, other_id ORDER BY round(score, 12) DESC, cell_id) AS q FROM t WHERE r = 1) SELECT wsi, other_id, cell_id, round(score, 6) AS score FROM u WHERE q = 1""")
def j8_best_per_reference(spark, sf_dir):
    cells = d.cells(spark, sf_dir).withColumn("orientation", (F.col("key") * 13 % 180).cast("double"))
    one = spark.createDataFrame([("even", 1.0, 1.0, 0.0)], "name string, w_distance double, w_orientation double, w_iou double")
    found = space.match_by_radius(cells.filter("key % 2 = 0"), cells.filter("key % 2 = 1"), one).withColumn("score", F.round("score", 12))
    return rounded(joins.best_per_reference(found), "score")


@query("WITH p AS (SELECT DISTINCT o_custkey % 40 AS k FROM orders), f AS (SELECT DISTINCT o_custkey % 40 AS k FROM orders WHERE o_custkey % 3 = 0 AND o_custkey < 60) SELECT k FROM p WHERE k NOT IN (SELECT k FROM f)")
def j19_skip_finished(spark, sf_dir):
    orders = d.table(spark, sf_dir, "orders").withColumn("k", F.col("o_custkey") % 40)
    return joins.skip_finished(orders.select("k").distinct(), orders.filter("o_custkey % 3 = 0 AND o_custkey < 60"), ["k"])


@query("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderstatus = 'F') > 0 AND count(*) FILTER (o_orderstatus <> 'F') > 0")
def j20_masked_pairs(spark, sf_dir):
    rows = d.table(spark, sf_dir, "orders").withColumn("masked", F.col("o_orderstatus") == "F")
    return joins.masked_pairs(rows, ["o_custkey"])


@query("SELECT c_custkey AS path, CASE WHEN NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'missing' WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') THEN 'done' ELSE 'to_run' END AS status FROM customer")
def j27_input_status(spark, sf_dir):
    orders = d.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), "o_orderstatus")
    return joins.input_status(d.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path")), orders, orders.filter("o_orderstatus = 'F'"))


@query("SELECT o_custkey AS path, c_name, o_orderkey FROM customer RIGHT JOIN orders ON c_custkey = o_custkey")
def j30_attach_inventory(spark, sf_dir):
    customers = d.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"), "c_name")
    return joins.attach_inventory(customers, d.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), "o_orderkey"))


@query(f"WITH {CELLS} SELECT wsi, cell_id, cell_type || '_' || (row_number() OVER (PARTITION BY wsi ORDER BY key) - 1) AS seq_id FROM cells")
def w3_sequential_id(spark, sf_dir):
    return tables.sequential_id(d.cells(spark, sf_dir), "wsi", F.concat(F.col("cell_type"), F.lit("_")), F.col("key")).select("wsi", "cell_id", "seq_id")


@query("SELECT c_custkey, o_orderkey FROM (SELECT o_custkey AS c_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, o_orderstatus) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n = 1")
def w5_prefer_first(spark, sf_dir):
    rows = d.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    single = rows.groupBy("c_custkey").count().filter("count = 1")
    return tables.prefer_first(rows.join(single, "c_custkey", "left_semi"), "c_custkey", "o_orderstatus", ["P", "O", "F"]).select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, o_orderkey, o_orderstatus FROM (SELECT o_custkey AS c_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, o_orderstatus, o_orderkey) AS r FROM orders) WHERE r = 1")
def w5_prefer_first_each(spark, sf_dir):
    rows = d.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    return tables.prefer_first(rows, "c_custkey", "o_orderstatus", ["P", "O", "F"], "o_orderkey")


@query(f"WITH {CELLS}, q AS (SELECT wsi, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM cells GROUP BY wsi) SELECT wsi, min(y) AS low, max(y) AS high, any_value(q1) AS q1, any_value(q3) AS q3 FROM cells JOIN q USING (wsi) WHERE y BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY wsi")
def a16_whiskers(spark, sf_dir):
    return tables.whisker_limits(d.cells(spark, sf_dir), "wsi", "y")


@query("SELECT event_type, user_id % 4 AS k, count(*) AS n FROM events GROUP BY ALL")
def a34_status_counts(spark, sf_dir):
    return tables.status_counts(d.table(spark, sf_dir, "events").withColumn("k", F.col("user_id") % 4), ["event_type", "k"])


@query(f"WITH {PRED} SELECT split_idx, true_label AS label, count(*) AS n, CASE WHEN split_idx < 6 THEN 'train' ELSE 'test' END AS side FROM pred GROUP BY ALL")
def k5_split_info(spark, sf_dir):
    rows = d.predictions(spark, sf_dir).withColumn("side", F.when(F.col("split_idx") < 6, "train").otherwise("test")).withColumnRenamed("true_label", "label")
    return sinks.split_info(rows)


@query(f"WITH {CELLS}, s AS (SELECT DISTINCT key % 3 AS split_idx, wsi, CASE WHEN (key % 3) = 0 THEN 'test' ELSE 'train' END AS side FROM cells), p AS (SELECT *, (split_idx + 1) / 4.0 AS proportion FROM s) SELECT CAST(-1 AS BIGINT) AS split_idx, wsi, CAST(max(proportion) AS DOUBLE) AS proportion FROM p GROUP BY wsi")
def m3_resolve_splits(spark, sf_dir):
    rows = d.cells(spark, sf_dir).select((F.col("key") % 3).alias("split_idx"), "wsi").distinct()
    rows = rows.withColumns({"side": F.when(F.col("split_idx") == 0, "test").otherwise("train"), "proportion": (F.col("split_idx") + 1) / 4.0})
    return sampling.resolve_splits(rows).filter("split_idx = -1").select(F.col("split_idx").cast("long"), "wsi", "proportion")


@query(f"""WITH {CELLS}, p AS (SELECT DISTINCT CAST(key % 3 AS BIGINT) AS split_idx, CASE WHEN key % 3 = 0 THEN 'test' WHEN key % 3 = 1 AND wsi = 's1' THEN 'val' WHEN key % 3 = 1 AND wsi = 's2' THEN 'test' ELSE 'train' END AS side, wsi, CAST((key % 3 + 1) / 4.0 AS DOUBLE) AS proportion FROM cells)
SELECT *, false AS val_reused_test FROM p
UNION ALL SELECT split_idx, 'val', wsi, proportion, true FROM p WHERE side = 'test' AND split_idx NOT IN (SELECT split_idx FROM p WHERE side = 'val')
UNION ALL SELECT CAST(-1 AS BIGINT), 'pool', wsi, max(proportion), false FROM p GROUP BY wsi""")
def m3_resolve_splits_all(spark, sf_dir):
    rows = d.cells(spark, sf_dir).select((F.col("key") % 3).alias("split_idx"), "wsi").distinct()
    side = F.when(F.col("split_idx") == 0, "test").when((F.col("split_idx") == 1) & (F.col("wsi") == "s1"), "val").when((F.col("split_idx") == 1) & (F.col("wsi") == "s2"), "test").otherwise("train")
    found = sampling.resolve_splits(rows.withColumns({"side": side, "proportion": (F.col("split_idx") + 1) / 4.0}))
    return found.withColumn("split_idx", F.col("split_idx").cast("long"))


@query(f"WITH {CELLS}, r AS (SELECT wsi, cell_id, cell_type, row_number() OVER (PARTITION BY cell_type ORDER BY {_DRAW}, wsi, cell_id) AS r FROM cells) SELECT wsi, cell_id, cell_type FROM r WHERE r <= greatest(1, floor(100 / (SELECT count(DISTINCT cell_type) FROM cells)))")
def m7_stratified(spark, sf_dir):
    return sampling.stratified_sample(d.cells(spark, sf_dir), 100, "cell_type", 0, "wsi", "cell_id").select("wsi", "cell_id", "cell_type")


@query(f"WITH {CELLS}, r AS (SELECT wsi, cell_id, row_number() OVER (PARTITION BY wsi ORDER BY {_DRAW}, wsi, cell_id) AS r FROM cells) SELECT wsi, cell_id FROM r WHERE r <= 20")
def m9_subsample(spark, sf_dir):
    return sampling.subsample(d.cells(spark, sf_dir), 20, 0, "wsi", "cell_id", group=["wsi"]).select("wsi", "cell_id")


@query("WITH q AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s, median(l_tax) AS md, quantile_cont(l_tax, 0.75) - quantile_cont(l_tax, 0.25) AS iq FROM lineitem) SELECT l_returnflag, round(avg((l_quantity - m) / s), 4) + 0.0 AS z, count(*) AS n FROM lineitem, q GROUP BY l_returnflag")
def e7_scale(spark, sf_dir):
    rows = d.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity")
    (scaled,) = models.scale_columns(rows, ["l_quantity"], False)
    return scaled.groupBy("l_returnflag").agg((F.round(F.avg("l_quantity"), 4) + 0.0).alias("z"), F.count("*").alias("n"))


@query()
def a7_expression_divergence(spark, sf_dir):
    rows = expression.normalize_log1p(d.expression(spark, sf_dir))
    cells = d.cells(spark, sf_dir)
    pairs = space.window_join(cells, cells, 112, include_self=False).select("wsi", scalars.barcode(F.col("cell_id")).alias("barcode"), scalars.barcode(F.col("other_id")).alias("other"))
    return expression.expression_divergence(rows, pairs, 50)


@query()
def a19_kde(spark, sf_dir):
    return rounded(tables.gaussian_kde(d.table(spark, sf_dir, "events"), "value", [float(i) for i in range(0, 100, 5)]), "density")


@query()
def e6_pca(spark, sf_dir):
    rows = d.embeddings(spark, sf_dir)
    mean, components = models.pca_fit(rows, "vector", 4)
    largest = np.abs(components).argmax(axis=0)
    components = components * np.sign(components[largest, np.arange(components.shape[1])])  # each one's largest loading is positive
    return models.pca_apply(rows, "vector", mean, components).select("wsi", "cell_id", F.size("vector").alias("k"), *[r6(F.get("vector", F.lit(i))).alias(f"p{i}") for i in range(4)])


@models.register_probe("composition")
def _composition_probe(cells: DataFrame, px: int = 224, label: str = "Stromal") -> DataFrame:
    found = space.composition(space.window_stats(cells, cells, px, CLASSES), CLASSES)
    return found.select("wsi", "cell_id", F.col(f"f_{label}").alias("target"), "valid")


@models.register_probe("cell_count")
def _count_probe(cells: DataFrame, px: int = 224, log: bool = True) -> DataFrame:
    found = space.window_stats(cells, cells, px, [])
    return found.select("wsi", "cell_id", (F.log1p("n") if log else F.col("n").cast("double")).alias("target"), F.col("n").isNotNull().alias("valid"))


@query()
def e9_probe_suite(spark, sf_dir):
    cells = d.cells(spark, sf_dir)
    features = cells.select("wsi", "cell_id", F.array((F.col("x") / 1000.0), (F.col("y") / 1000.0), (F.col("key") % 12).cast("double")).alias("x"))
    sides = spark.createDataFrame([(f"s{i}", "train" if i < 5 else "val" if i == 5 else "test") for i in range(7)], "wsi string, side string")
    found = models.run_probe_suite(cells, features, sides, [{"probe": "composition"}, {"probe": "cell_count", "px": 448}], [0.1, 10.0])
    return spark.createDataFrame([(r["probe"], r["skipped"], float(r.get("test_r2", 0.0))) for r in found], "probe string, skipped boolean, test_r2 double")
