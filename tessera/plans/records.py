"""Queries of result trees, readers, report tables, set operations and expansions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import labels, rings, scalars
from tessera.operators import expression, joins, models, sampling, tables
from tessera.operators import space as space_ops
from tessera.plans import domain as d
from tessera.plans.domain import CELLS, EXPR, POLY, PRED, RUNS
from tessera.plans.queries import query, r6
from tessera.sources import readers, sinks
from tessera.sources.storage import scratch

# ---- result trees


def _tree(rows: DataFrame, name: str, text, *folders: str) -> str:
    """A tree with a text file for each row, in folders named after some columns."""
    path = scratch(rows.sparkSession, name)
    rows.select(*folders, text.alias("value")).write.partitionBy(*folders).text(path)
    return path


def _run_files(spark: SparkSession, sf_dir: str) -> str:
    rows = d.runs(spark, sf_dir).withColumn("split", F.concat(F.lit("split_"), F.col("split_idx").cast("string")))
    m = F.col("metric").cast("string")
    text = F.concat_ws("\n", F.lit("best_config: {lambda: 0.1, name: ridge}"), F.concat(F.lit("val: {f1: "), m, F.lit(", pearson: 0.5, note: none}")), F.concat(F.lit("test: {f1: "), (F.col("metric") / 2).cast("string"), F.lit(", pearson_top: 0.25, done: true}")))
    return _tree(rows, "runs", text, "condition", "split")


@query(f"WITH {RUNS} SELECT condition, 'split_' || split_idx AS split, name, round(CASE name WHEN 'f1' THEN metric / 2 ELSE 0.25 END, 6) AS value FROM runs, (VALUES ('f1'), ('pearson_top')) t(name) WHERE split_idx IN (1, 3)")
def s13_run_tree(spark, sf_dir):
    """Test metrics of two folds: the others' folders are not listed."""
    runs = readers.read_runs(spark, _run_files(spark, sf_dir), ["condition", "split"], "*.txt", {"split": ["split=split_1", "split=split_3"]})
    return readers.long_metrics(runs, "test.", "name").select("condition", "split", "name", r6("value").alias("value"))


@query(f"WITH {RUNS} SELECT condition, 'split_' || split_idx AS split, 2 AS n, 0.5 AS pearson, 0.25 AS pearson_top FROM runs")
def s15_pearson_tree(spark, sf_dir):
    runs = readers.scalar_metrics(readers.read_runs(spark, _run_files(spark, sf_dir), ["condition", "split"], "*.txt"), "pearson")
    return runs.select("condition", "split", F.size("metrics").alias("n"), F.col("metrics")["val.pearson"].alias("pearson"), F.col("metrics")["test.pearson_top"].alias("pearson_top"))


@query(f"""WITH {RUNS} SELECT condition, split_idx, 'count' AS probe, false AS skipped, NULL AS reason, round(metric, 6) AS r2, CASE WHEN split_idx % 2 = 0 THEN condition || '!' END AS detail FROM runs
UNION ALL SELECT condition, split_idx, 'type', split_idx > 4, CASE WHEN split_idx > 4 THEN 'few rows' END, CASE WHEN split_idx > 4 THEN NULL ELSE 0.5 END, CASE WHEN split_idx % 2 = 0 THEN condition || '!' END FROM runs""")
def s14_j18_probe_tree(spark, sf_dir):
    """Probes of each run, skipped ones too, with the details that runs of even folds have."""
    runs = d.runs(spark, sf_dir)
    other = F.when(F.col("split_idx") > 4, "type: {skipped: true, reason: few rows}").otherwise("type: {r2: 0.5, skipped: false}")
    path = _tree(runs, "probes", F.concat(F.lit("count: {r2: "), F.col("metric").cast("string"), F.lit("}\n"), other), "condition", "split_idx")
    found = readers.read_probe_runs(spark, path, ["condition", "split_idx"], "*.txt").withColumn("split_idx", F.col("split_idx").cast("int"))
    detail = runs.filter("split_idx % 2 = 0").select("condition", "split_idx", F.concat("condition", F.lit("!")).alias("detail"))
    return readers.enrich_runs(found, detail, ["condition", "split_idx"]).select("condition", "split_idx", "probe", "skipped", "reason", r6(F.col("metrics")["r2"]).alias("r2"), "detail")


@query(f"WITH {PRED} SELECT split_idx, cell_id, true_label, predicted_label, true_label = predicted_label AS correct, 'UNI2 | cls' AS condition FROM pred")
def s16_read_predictions(spark, sf_dir):
    """Predictions are written as CSV, a folder for each fold, and read with their fold."""
    path = scratch(spark, "folds")
    d.predictions(spark, sf_dir).select("cell_id", "true_label", "predicted_label", F.concat(F.lit("split_"), F.col("split_idx").cast("string")).alias("fold")).write.partitionBy("fold").csv(path, header=True)
    rows = readers.read_predictions(spark, path)
    return rows.select("split_idx", "cell_id", "true_label", "predicted_label", (F.col("true_label") == F.col("predicted_label")).alias("correct"), scalars.condition(F.lit("UNI2"), F.lit("cls")).alias("condition"))


@query(f"""WITH {RUNS}, t AS (SELECT *, condition || '/' || split_idx // 2 AS run, split_idx % 2 AS trial_idx FROM runs), r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY metric DESC NULLS LAST, trial_idx) AS k, count(metric) OVER (PARTITION BY run) AS n_trials FROM t)
SELECT run, trial_idx, metric, n_trials FROM r WHERE k = 1 AND metric IS NOT NULL""")
def k6_summary_of_trials(spark, sf_dir):
    path = scratch(spark, "summary")
    run = F.concat("condition", F.lit("/"), F.floor(F.col("split_idx") / 2).cast("string"))
    trials = d.runs(spark, sf_dir).select(run.alias("run"), (F.col("split_idx") % 2).alias("trial_idx"), "metric", F.col("condition").alias("family"))
    sinks.write_summary(trials, path, ["run"], "metric", "family")
    return spark.read.parquet(path).select("run", "trial_idx", "metric", "n_trials")


# ---- readers


@query("SELECT 'a' AS wsi, CAST(n AS DOUBLE) AS scale, round(1.0 / n, 8) AS inverse_scale, round(-CAST(n + 3 AS DOUBLE) / n, 8) AS inverse_shift, 0.5 AS inverse_y FROM (SELECT count(*) AS n FROM orders)")
def s5_alignment(spark, sf_dir):
    """A matrix whose scale is the number of orders."""
    n, path = d.table(spark, sf_dir, "orders").agg(F.count("*").alias("n")), scratch(spark, "alignment")
    rows = n.select(F.explode(F.array(F.struct(F.col("n").cast("double").alias("a"), F.lit(0.0).alias("b"), (F.col("n") + 3).cast("double").alias("c")), F.struct(F.lit(0.0).alias("a"), F.lit(2.0).alias("b"), F.lit(7.0).alias("c")), F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(1.0).alias("c")))).alias("r")).select("r.*")
    rows.coalesce(1).write.csv(path)
    at = lambda m, i, j: F.col(m)[i][j]
    return readers.read_alignment(spark, path, "a").select("wsi", at("m", 0, 0).alias("scale"), F.round(at("inverse", 0, 0), 8).alias("inverse_scale"), F.round(at("inverse", 0, 2), 8).alias("inverse_shift"), at("inverse", 1, 1).alias("inverse_y"))


@query(f"WITH {POLY} SELECT wsi, cell_id, 4 AS n_points, round(x0 / 0.2125, 4) AS xmin, round(y0 / 0.2125, 4) AS ymin, round((x0 + w) / 0.2125, 4) AS xmax, round((y0 + h) / 0.2125, 4) AS ymax FROM poly WHERE key % 5 > 0")
def s7_nuclei_of_vertices(spark, sf_dir):
    """Vertices in microns to polygons in pixels; of every fifth nucleus there are two vertices only."""
    rows = d.polygons(spark, sf_dir).select("wsi", "cell_id", "key", F.posexplode(F.concat("ring", F.slice("ring", 1, 1))).alias("seq", "p")).filter("key % 5 > 0 OR seq < 2")
    found = readers.nuclei(rows.select("wsi", "cell_id", "seq", F.col("p.x").alias("vertex_x"), F.col("p.y").alias("vertex_y"))).withColumn("b", rings.bbox(F.col("ring")))
    return found.select("wsi", "cell_id", F.size("ring").alias("n_points"), *[F.round(f"b.{c}", 4).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


@query("SELECT CAST(n_nationkey AS DOUBLE) / 100 + CASE n_nationkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS mpp FROM nation")
def s8_pixel_sizes(spark, sf_dir):
    """A file for each nation, with its size under one of three names, and under later names wrong ones."""
    path, key = scratch(spark, "mpp"), F.col("n_nationkey")
    size = lambda plus: key / 100 + plus
    rows = d.table(spark, sf_dir, "nation").select(F.when(key % 3 == 0, size(1)).alias("pixel_size"), F.when(key % 3 < 2, size(2)).alias("pixel_size_um"), size(3).alias("morphology_pixel_size"))
    rows.write.option("maxRecordsPerFile", 1).json(path)
    return readers.resolve_mpp(spark, path)


_FILES = "files AS (SELECT '/d/' || (c_custkey % 3) || '/' || CASE WHEN c_custkey % 10 = 0 THEN '' ELSE 'ds' || (c_custkey % 5) || '_' END || (c_custkey % 400) || CASE WHEN c_custkey % 2 = 0 THEN '.tif' ELSE '.csv' END AS path, c_custkey AS length FROM customer)"


@query(f"""WITH {_FILES}, n AS (SELECT path, length, split_part(path, '/', 4) AS name FROM files) SELECT path, length, name, regexp_extract(name, '\\.([a-z]+)$', 1) AS kind, regexp_extract(name, '^([A-Za-z0-9-]+)[_.]', 1) AS dataset,
  count(*) OVER (PARTITION BY name) > 1 AS duplicate, regexp_extract(name, '^([A-Za-z0-9-]+)[_.]', 1) = '' AS unparsed FROM n""")
def s17_inventory_of_names(spark, sf_dir):
    key = F.col("c_custkey")
    name = F.concat(F.lit("/d/"), (key % 3).cast("string"), F.lit("/"), F.when(key % 10 == 0, "").otherwise(F.concat(F.lit("ds"), (key % 5).cast("string"), F.lit("_"))), (key % 400).cast("string"), F.when(key % 2 == 0, ".tif").otherwise(".csv"))
    return readers.parse_inventory(d.table(spark, sf_dir, "customer").select(name.alias("path"), key.alias("length")))


@query("""WITH f AS (SELECT 'sec_S' || (p_partkey % 90) || '_S' || (p_partkey % 61) || '.tif' AS name FROM part), t AS (SELECT DISTINCT name, unnest(regexp_extract_all(name, 'S[0-9]+')) AS sample FROM f)
SELECT name, sample FROM t WHERE sample NOT IN (SELECT 'S' || (s_suppkey % 50) FROM supplier)""")
def s18_section_coverage(spark, sf_dir):
    key = F.col("p_partkey")
    files = d.table(spark, sf_dir, "part").select(F.concat(F.lit("sec_S"), (key % 90).cast("string"), F.lit("_S"), (key % 61).cast("string"), F.lit(".tif")).alias("name"))
    samples = d.table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), (F.col("s_suppkey") % 50).cast("string")).alias("sample"))
    return readers.section_coverage(files, samples, "S[0-9]+")


# ---- scalars


@query(f"""WITH {CELLS} SELECT wsi, cell_id, y // 300 AS patch_row, x // 300 AS patch_col, CASE WHEN key % 4 = 0 THEN -1 ELSE CAST(key % 12 AS INTEGER) END AS split_idx, key % 4 = 0 AS same_slide, 'm' || key % 3 || ' | t' || key % 2 AS condition, key % 3 = key % 2 AS correct FROM cells""")
def p21_p23_patch_and_condition(spark, sf_dir):
    key = F.col("key")
    label = F.when(key % 4 == 0, "same_slide").otherwise(F.concat(F.lit("fold_"), (key % 12).cast("string")))
    rows = d.cells(spark, sf_dir).withColumn("split_idx", scalars.split_index(label))
    return rows.select("wsi", "cell_id", scalars.patch_row(F.col("y"), 300).alias("patch_row"), scalars.patch_row(F.col("x"), 300).alias("patch_col"), "split_idx", (F.col("split_idx") == -1).alias("same_slide"), scalars.condition(F.concat(F.lit("m"), (key % 3).cast("string")), F.concat(F.lit("t"), (key % 2).cast("string"))).alias("condition"), (key % 3 == key % 2).alias("correct"))


@query("SELECT 'hit' AS asked, o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL UNION ALL SELECT 'none', o_orderstatus, count(*) FROM orders GROUP BY ALL")
def p28_filter_or_keep(spark, sf_dir):
    orders = d.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"))
    of = lambda asked, s: scalars.filter_or_keep(orders, F.col("status") == s).groupBy(F.lit(asked).alias("asked"), "status").agg(F.count("*").alias("n"))
    return of("hit", "P").unionByName(of("none", "no such status"))


@query("SELECT c_custkey, c_acctbal AS m_balance, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS DOUBLE) END AS m_even, CAST(NULL AS DOUBLE) AS m_absent FROM customer")
def p29_flatten_metrics(spark, sf_dir):
    even = F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("double"))
    rows = d.table(spark, sf_dir, "customer").select("c_custkey", F.create_map(F.lit("balance"), F.col("c_acctbal").cast("double"), F.lit("even"), even).alias("metrics"))
    return scalars.flatten_metrics(rows, "metrics", ["balance", "even", "absent"], "m_")


# ---- joins


@query(f"WITH {CELLS}, {EXPR} SELECT c.wsi, c.cell_id, c.x, c.y, count(*) AS n_genes, round(sum(e.count), 4) AS total FROM cells c JOIN expr e ON e.wsi = c.wsi AND e.barcode = CAST(c.key AS VARCHAR) WHERE c.key % 9 > 0 GROUP BY ALL")
def j12_positions_expression(spark, sf_dir):
    """Cells of every ninth key have no position."""
    cells = d.cells(spark, sf_dir).withColumn("x", F.when(F.col("key") % 9 > 0, F.col("x")))
    rows = joins.positions_expression(cells, d.expression(spark, sf_dir))
    return rows.groupBy("wsi", "cell_id", "x", "y").agg(F.count("*").alias("n_genes"), F.round(F.sum("count"), 4).alias("total"))


@query(f"WITH {CELLS}, {PRED}, p AS (SELECT 's' || key % 7 || '_' || key AS cell_id, wsi, predicted_label FROM pred) SELECT p.wsi, p.cell_id, predicted_label, x, y, x IS NOT NULL AS located FROM p LEFT JOIN cells c ON c.wsi = p.wsi AND c.cell_id = p.cell_id")
def j15_attach_coords(spark, sf_dir):
    """Cells are given twice; predictions stay single."""
    rows = d.predictions(spark, sf_dir).select("wsi", F.concat(F.lit("s"), (F.col("key") % 7).cast("string"), F.lit("_"), F.col("key").cast("string")).alias("cell_id"), "predicted_label")
    cells = d.cells(spark, sf_dir)
    return joins.attach_coords(rows, cells.unionByName(cells.withColumn("x", F.col("x") + 1))).select("wsi", "cell_id", "predicted_label", "x", "y", "located")


@query(f"""WITH {PRED}, s AS (SELECT split_idx, true_label AS label, round(avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END), 6) AS value FROM pred GROUP BY ALL), c AS (SELECT split_idx, predicted_label AS label, count(*) AS n FROM pred WHERE split_idx < 6 GROUP BY ALL), w AS (SELECT split_idx, sum(n) AS whole FROM c GROUP BY ALL)
SELECT s.split_idx, s.label, value, CASE WHEN whole IS NOT NULL THEN coalesce(c.n, 0) END AS n, round(CASE WHEN whole IS NOT NULL THEN coalesce(c.n, 0) END / whole, 6) AS proportion FROM s LEFT JOIN c ON c.split_idx = s.split_idx AND c.label = s.label LEFT JOIN w ON w.split_idx = s.split_idx""")
def j17_availability_vs_score(spark, sf_dir):
    rows = d.predictions(spark, sf_dir)
    scores = rows.groupBy("split_idx", F.col("true_label").alias("label")).agg(F.round(F.avg(F.col("correct").cast("double")), 6).alias("value"))
    counts = rows.filter("split_idx < 6").groupBy("split_idx", F.col("predicted_label").alias("label")).agg(F.count("*").alias("n"))
    found = joins.availability_vs_score(scores, counts, ["split_idx"])
    return found.select("split_idx", "label", "value", "n", r6("proportion").alias("proportion"))


# ---- folds, sets, reports


@query(f"""WITH {CELLS}, s AS (SELECT wsi, row_number() OVER (ORDER BY wsi) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT wsi FROM cells)), r AS (SELECT a.i AS split_idx, b.wsi, CASE WHEN a.i = b.i THEN 'test' WHEN (b.i - a.i + a.n) % a.n <= 2 THEN 'val' ELSE 'train' END AS side FROM s a, s b)
SELECT CAST(split_idx AS INTEGER) AS split_idx, side, wsi FROM r UNION ALL SELECT CAST(i AS INTEGER), 'train', 'extra' FROM s""")
def m4_loso_folds(spark, sf_dir):
    slides = sorted(r["wsi"] for r in d.cells(spark, sf_dir).select("wsi").distinct().collect())  # a row a slide
    return sampling.loso_folds(spark, slides, ["extra"], 2)


@query("SELECT DISTINCT c_custkey % 300 AS k, c_nationkey AS nation FROM customer WHERE c_custkey % 2 = 0 INTERSECT SELECT c_custkey % 300, c_nationkey FROM customer WHERE c_custkey % 3 = 0 INTERSECT SELECT c_custkey % 300, c_nationkey FROM customer WHERE c_custkey % 5 > 0")
def o2_intersection(spark, sf_dir):
    key = F.col("c_custkey")
    rows = d.table(spark, sf_dir, "customer").withColumns({"k": key % 300, "nation": F.col("c_nationkey")})
    return tables.intersection(["k", "nation"], rows.filter(key % 2 == 0), rows.filter(key % 3 == 0), rows.filter(key % 5 > 0))


@query("""SELECT k, 'missing' AS side FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 > 0 EXCEPT SELECT o_custkey FROM orders)
UNION ALL SELECT k, 'unexpected' FROM (SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0)""")
def o3_difference(spark, sf_dir):
    """Customers that should have orders and haven't, and customers that have and shouldn't."""
    expected = d.table(spark, sf_dir, "customer").filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("k"))
    return tables.difference(["k"], expected, d.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")))


@query(f"""WITH {RUNS}, b AS (SELECT split_idx, metric AS base FROM runs WHERE condition = 'click') SELECT condition, round(avg(metric), 6) AS mean, round(avg(base), 6) AS base_mean, round(avg(metric - base), 6) AS diff_mean,
  round(CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(metric - base) END, 6) AS diff_std, count(*) AS diff_n, round(avg(metric - base) / abs(avg(base)), 6) AS relative FROM runs JOIN b USING (split_idx) WHERE condition <> 'click' GROUP BY condition""")
def a37_advantage(spark, sf_dir):
    found = tables.advantage(d.runs(spark, sf_dir), ["split_idx"], "condition", "click", "metric")
    return found.withColumns({c: r6(c) for c in ("mean", "base_mean", "diff_mean", "diff_std", "relative")})


@query(f"""WITH {PRED}, s AS (SELECT split_idx, wsi, true_label, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS f FROM pred WHERE split_idx < 3 AND NOT (split_idx = 1 AND wsi = 's3') GROUP BY ALL),
g AS (SELECT true_label AS label, split_idx, printf('%.4f +/- %.4f', avg(f), CASE WHEN count(*) = 1 THEN 0.0 ELSE stddev_samp(f) END) || CASE WHEN count(*) < 7 THEN printf(' (%d/7)', count(*)) ELSE '' END AS t FROM s GROUP BY ALL)
SELECT label, coalesce(max(t) FILTER (split_idx = 0), '-') AS "0", coalesce(max(t) FILTER (split_idx = 1), '-') AS "1", coalesce(max(t) FILTER (split_idx = 2), '-') AS "2" FROM g GROUP BY label""")
def a37_class_layout(spark, sf_dir):
    """Each class's share of hits over slides, by fold; one fold lacks a slide."""
    rows = d.predictions(spark, sf_dir).filter("split_idx < 3 AND NOT (split_idx = 1 AND wsi = 's3')")
    each = rows.groupBy("split_idx", "wsi", F.col("true_label").alias("label")).agg(F.avg(F.col("correct").cast("double")).alias("f"))
    return tables.layout(each, "label", "split_idx", [0, 1, 2], "f", 7)


@query(f"WITH {RUNS} SELECT CAST(row_number() OVER (ORDER BY CASE WHEN split_idx = 2 THEN NULL ELSE metric END DESC NULLS LAST, condition, split_idx) AS INTEGER) AS position, condition, split_idx FROM runs")
def l5_ordered_report(spark, sf_dir):
    rows = d.runs(spark, sf_dir).withColumn("metric", F.when(F.col("split_idx") != 2, F.col("metric")))
    return tables.ordered(rows, F.desc_nulls_last("metric"), F.col("condition"), F.col("split_idx")).select("position", "condition", "split_idx")


@query("""WITH q AS (SELECT median(l_tax) AS md, quantile_cont(l_tax, 0.75) - quantile_cont(l_tax, 0.25) AS iq, median(l_quantity) AS mq, quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS iqq FROM lineitem WHERE l_linenumber < 4)
SELECT l_returnflag, count(*) AS n, round(avg((l_tax - md) / iq), 5) + 0.0 AS tax, round(avg((l_quantity - mq) / iqq), 5) + 0.0 AS quantity FROM lineitem, q GROUP BY l_returnflag""")
def e7_robust_scale(spark, sf_dir):
    """Medians and quartiles of the training rows scale all rows."""
    rows = d.table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_tax").cast("double").alias("tax"), F.col("l_quantity").cast("double").alias("quantity"), "l_linenumber")
    _, scaled = models.scale_columns(rows.filter("l_linenumber < 4"), ["tax", "quantity"], True, rows)
    return scaled.groupBy("l_returnflag").agg(F.count("*").alias("n"), *[(F.round(F.avg(c), 5) + 0.0).alias(c) for c in ("tax", "quantity")])


# ---- expressions and densities in SQL


@query(f"""WITH {CELLS}, {EXPR}, t AS (SELECT wsi, barcode, sum(count) AS s FROM expr GROUP BY ALL), v AS (SELECT e.wsi, e.barcode, gene, ln(1 + count / s * 100) AS value FROM expr e JOIN t USING (wsi, barcode)),
p AS (SELECT a.wsi, CAST(a.key AS VARCHAR) AS barcode, CAST(b.key AS VARCHAR) AS other FROM cells a JOIN cells b ON a.wsi = b.wsi AND a.cell_id <> b.cell_id AND abs(a.x - b.x) <= 56 AND abs(a.y - b.y) <= 56),
n AS (SELECT wsi, barcode, count(*) AS n FROM p GROUP BY ALL), m AS (SELECT p.wsi, p.barcode, gene, sum(value) AS b FROM p JOIN v ON v.wsi = p.wsi AND v.barcode = p.other GROUP BY ALL),
j AS (SELECT coalesce(v.wsi, m.wsi) AS wsi, coalesce(v.barcode, m.barcode) AS barcode, coalesce(value, 0) AS a, coalesce(b, 0) AS b0 FROM v FULL JOIN m ON v.wsi = m.wsi AND v.barcode = m.barcode AND v.gene = m.gene),
s AS (SELECT wsi, barcode, n, sum(a) AS a, sum(b0 / n) AS b, sum(a * a) AS aa, sum(b0 / n * b0 / n) AS bb, sum(a * b0 / n) AS ab FROM j JOIN n USING (wsi, barcode) GROUP BY ALL)
SELECT wsi, barcode, n, round(CASE WHEN n >= 3 AND (aa - a * a / 50) * (bb - b * b / 50) > 1e-15 THEN (ab - a * b / 50) / sqrt((aa - a * a / 50) * (bb - b * b / 50)) END, 5) AS pearson, round(CASE WHEN n >= 3 AND aa * bb > 1e-15 THEN ab / sqrt(aa * bb) END, 5) AS cosine FROM s""")
def a7_divergence_in_sql(spark, sf_dir):
    rows, cells = expression.normalize_log1p(d.expression(spark, sf_dir)), d.cells(spark, sf_dir)
    pairs = space_ops.window_join(cells, cells, 112, include_self=False).select("wsi", scalars.barcode(F.col("cell_id")).alias("barcode"), scalars.barcode(F.col("other_id")).alias("other"))
    found = expression.expression_divergence(rows, pairs, 50)
    return found.select("wsi", "barcode", "n", F.round("pearson", 5).alias("pearson"), F.round("cosine", 5).alias("cosine"))


@query("""WITH h AS (SELECT stddev_samp(value) * power(count(value), -0.2) AS h, count(value) AS n FROM events), p AS (SELECT CAST(5 * i AS DOUBLE) AS x FROM range(20) t(i))
SELECT x, round(sum(exp(-power((x - value) / h, 2) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 8) AS density FROM p, events, h WHERE value IS NOT NULL GROUP BY x""")
def a19_density_in_sql(spark, sf_dir):
    found = tables.gaussian_kde(d.table(spark, sf_dir, "events"), "value", [float(i) for i in range(0, 100, 5)])
    return found.withColumn("density", F.round("density", 8))


# ---- expansions and batch inference

_SLIDES = f"{CELLS}, slides AS (SELECT wsi, max(x_start) + 224 AS width, max(y_start) + 224 AS height FROM cells GROUP BY wsi), xs AS (SELECT wsi, width, height, unnest(range(0, width - 223, 192)) AS x0 FROM slides UNION SELECT wsi, width, height, width - 224 FROM slides), tiles AS (SELECT wsi, x0, y0 FROM (SELECT *, unnest(range(0, height - 223, 192)) AS y0 FROM xs UNION SELECT *, height - 224 FROM xs))"


def _slide_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    slides = d.cells(spark, sf_dir).groupBy("wsi").agg((F.max("x_start") + 224).alias("width"), (F.max("y_start") + 224).alias("height"))
    return space_ops.expand_tiles(slides, 224, 192).select("wsi", "x0", "y0")


@query(f"WITH {_SLIDES} SELECT wsi, x0, y0 FROM tiles")
def f6_expand_tiles(spark, sf_dir):
    return _slide_tiles(spark, sf_dir)


@query(f"WITH {_SLIDES} SELECT wsi, x0, y0, CASE WHEN x0 % 5 > 0 THEN CAST(x0 + y0 AS DOUBLE) END AS first, CASE WHEN x0 % 5 > 0 THEN 3 END AS dims, CASE WHEN x0 % 5 = 0 THEN 'ValueError: no tissue' END AS error FROM tiles")
def f2_e12_score_tiles(spark, sf_dir):
    """Tiles go to an encoder that is made once a task and refuses some of them."""

    def encoder():
        return lambda pdf: [ValueError("no tissue") if x % 5 == 0 else [float(x + y), float(x), float(y)] for x, y in zip(pdf["x0"], pdf["y0"], strict=True)]

    found = models.score_patches(_slide_tiles(spark, sf_dir), encoder, ["x0", "y0"], ["wsi", "x0", "y0"])
    return found.select("wsi", "x0", "y0", F.get("embedding", F.lit(0)).cast("double").alias("first"), F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dims"), "error")


# ---- remaining layouts


@query(f"WITH {CELLS} SELECT wsi, cell_id, CAST(key % 180 AS DOUBLE) AS angle FROM cells")
def p18_angle_there_and_back(spark, sf_dir):
    doubled = scalars.angle_to_doubled(F.col("key") % 180)
    back = scalars.doubled_to_angle(F.get(doubled, F.lit(0)), F.get(doubled, F.lit(1)))
    return d.cells(spark, sf_dir).select("wsi", "cell_id", (F.pmod(F.round(back, 6), F.lit(180.0)) + 0.0).alias("angle"))


@query(f"WITH {CELLS}, n AS (SELECT raw_type AS raw, name, CASE name WHEN 'malignant_vs_rest' THEN CASE WHEN raw_type = 'Malignant' THEN 'epithelial_malignant' WHEN raw_type IN ('Neural/Glial', 'Erythrocyte') THEN 'Unknown' ELSE 'non_malignant' END ELSE CASE WHEN raw_type IN ('Neural/Glial', 'Erythrocyte') THEN 'Unknown' ELSE raw_type END END AS mapped FROM cells, (VALUES ('malignant_vs_rest'), ('identity')) t(name)) SELECT name, raw, mapped, count(*) AS n FROM n GROUP BY ALL")
def f3_named_mappings(spark, sf_dir):
    cells = d.cells(spark, sf_dir)
    of = lambda name: cells.select(F.lit(name).alias("name"), F.col("raw_type").alias("raw"), labels.map_label(F.col("raw_type"), name).alias("mapped"))
    return of("malignant_vs_rest").unionByName(of("identity")).groupBy("name", "raw", "mapped").agg(F.count("*").alias("n"))


@query(f"""WITH {RUNS}, r AS (SELECT condition, split_idx, CASE WHEN condition = 'view' AND split_idx > 0 THEN 0 ELSE metric END AS m FROM runs WHERE NOT (condition = 'click' AND split_idx < 1)), b AS (SELECT split_idx, m AS base FROM r WHERE condition = 'view')
SELECT condition, round(coalesce(avg(CASE WHEN base <> 0 THEN m / base END), avg(m) / nullif(avg(base), 0)), 5) AS mean, round(CASE WHEN count(CASE WHEN base <> 0 THEN m END) = 1 THEN 0 ELSE stddev_samp(CASE WHEN base <> 0 THEN m / base END) END, 5) AS std, count(CASE WHEN base <> 0 THEN m END) AS n FROM r JOIN b USING (split_idx) GROUP BY condition""")
def j29_fold_change_of_zeros(spark, sf_dir):
    """The baseline is 0 in all folds but one, and a condition lacks that one."""
    rows = d.runs(spark, sf_dir).filter("NOT (condition = 'click' AND split_idx < 1)")
    rows = rows.withColumn("metric", F.when((F.col("condition") == "view") & (F.col("split_idx") > 0), 0.0).otherwise(F.col("metric")))
    found = tables.fold_change(rows, ["split_idx"], "condition", "view", "metric")
    return found.select("condition", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"), "n")


@query(f"WITH {CELLS}, a AS (SELECT sqrt(3) / 3 * x / 100 - y / 300.0 AS q, 2.0 / 3 * y / 100 AS r FROM cells), b AS (SELECT *, round_even(q, 0) AS rq, round_even(r, 0) AS rr, round_even(-q - r, 0) AS rs FROM a), c AS (SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs + q + r) AS ds FROM b) SELECT CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS INTEGER) AS q, CAST(CASE WHEN dq > dr AND dq > ds THEN rr WHEN dr > ds THEN -rq - rs ELSE rr END AS INTEGER) AS r, count(*) AS n, round(log10(count(*)), 6) AS log_n FROM c GROUP BY ALL")
def a18_hexbin_pooled(spark, sf_dir):
    return tables.hexbin(d.cells(spark, sf_dir), "x", "y", 100).withColumn("log_n", F.round("log_n", 6))


@query()
def e10_expression_regression(spark, sf_dir):
    """Five genes from position, type and neighbours, the penalty chosen on a slide: each gene's correlation on the test slide."""
    cells, genes = d.cells(spark, sf_dir), [f"g{i}" for i in range(5)]
    features = cells.select("wsi", "cell_id", F.array(F.col("x") / 1000.0, F.col("y") / 1000.0, (F.col("key") % 12).cast("double")).alias("x"))
    counts = joins.join_expression(cells.select("wsi", "cell_id"), expression.normalize_log1p(d.expression(spark, sf_dir)))
    of = lambda g: F.coalesce(F.sum(F.when(F.col("gene") == g, F.col("value"))), F.lit(0.0))
    targets = counts.groupBy("wsi", "cell_id").agg(F.array(*map(of, genes)).alias("values"))
    sides = spark.createDataFrame([(f"s{i}", "train" if i < 5 else "val" if i == 5 else "test") for i in range(7)], "wsi string, side string")
    near = space_ops.window_join(cells, cells, 224, include_self=False).select("wsi", "cell_id", "other_id")
    found, _ = models.expression_regression(features, near, targets, sides, genes, [0.01, 1.0, 100.0])
    return found.groupBy("gene").agg(F.count("*").alias("n"), F.round(F.corr("true", "predicted"), 4).alias("pearson"))


@query()
def e11_grid_trials(spark, sf_dir):
    """Trials of a classifier of the type from position: their metrics on two slides."""
    cells = d.cells(spark, sf_dir).filter("cell_type <> 'Unknown'")
    rows = labels.label_encode(cells.withColumnRenamed("cell_type", "label")).select("wsi", "cell_id", "label", "code", F.array(F.col("x") / 1000.0, F.col("y") / 1000.0, (F.col("key") % 12).cast("double")).alias("x"))
    names = sorted(r["label"] for r in rows.select("label").distinct().collect())  # a row a class
    found = models.grid_search(rows.filter("wsi < 's5'"), rows.filter("wsi >= 's5'"), [{"lambda": v} for v in (0.0, 0.01, 1.0)], names)
    return found.select("trial_idx", "lambda", *[F.round(c, 3).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1", "balanced_accuracy")])


@query(f"""WITH {EXPR}, n AS (SELECT wsi, count(DISTINCT barcode) AS n FROM expr GROUP BY wsi), t AS (SELECT wsi, gene, sum(count) / any_value(n) AS m, any_value(n) AS n FROM expr JOIN n USING (wsi) GROUP BY ALL),
c AS (SELECT e.wsi, e.gene, m, n, least(CAST(count AS DOUBLE), sqrt(n) * sqrt(m) + m) AS c FROM expr e JOIN t USING (wsi, gene)),
v AS (SELECT wsi, gene, round((any_value(n) * any_value(m) * any_value(m) + sum(c * c) - 2 * sum(c) * any_value(m)) / ((any_value(n) - 1) * any_value(m)), 9) AS v FROM c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY wsi ORDER BY v DESC, gene) - 1 AS r FROM v), g AS (SELECT gene, count(*) FILTER (r < 20) AS n_batches, median(r) FILTER (r < 20) AS median_rank FROM r GROUP BY gene)
SELECT gene, n_batches, median_rank, CAST(row_number() OVER (ORDER BY n_batches DESC, median_rank NULLS LAST, gene) - 1 AS INTEGER) AS highly_variable_rank FROM g""")
def a28_variances_of_a_given_trend(spark, sf_dir):
    """Genes ranked where the trend is that of counts without excess: the variance is the mean."""
    rows = d.expression(spark, sf_dir).withColumn("count", F.col("count").cast("double"))
    n = d.expression_cells(rows).groupBy("wsi").agg(F.count("*").alias("_n"))
    mean = rows.groupBy("wsi", "gene").agg(F.sum("count").alias("_s")).join(n, "wsi")
    trend = mean.select("wsi", "gene", (F.col("_s") / F.col("_n")).alias("mean"), F.sqrt(F.col("_s") / F.col("_n")).alias("std"), "_n")
    return expression.ranked_variances(rows, trend, 20)
