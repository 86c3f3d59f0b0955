"""The domain's tables, derived by Spark from the given tables, and the same derivations as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.storage import tasks_for

#: Polygons that a task gets, about.
POLYGONS = 20_000
RAW = ["B_cell", "Endothelial", "Epithelial", "Fibroblast", "Malignant", "Myeloid", "Other_Stromal", "Plasma", "T_NK_cell", "Neural/Glial", "Unknown", "Erythrocyte"]
BROAD = {"B_cell": "Lymphoid", "Endothelial": "Stromal", "Epithelial": "Epithelial", "Fibroblast": "Stromal", "Malignant": "Malignant", "Myeloid": "Myeloid", "Other_Stromal": "Stromal", "Plasma": "Lymphoid", "T_NK_cell": "Lymphoid", "Neural/Glial": "Stromal"}
CLASSES = ["Epithelial", "Lymphoid", "Malignant", "Myeloid", "Stromal"]
TOKENS = ["top_left", "top_right", "bottom_left", "cls"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(names: list[str], index) -> F.Column:
    return F.element_at(F.array(*map(F.lit, names)), (index + 1).cast("int"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """wsi, cell_id, x_start, y_start, x, y, raw_type, cell_type: orders scattered over seven slides whose width follows their number."""
    from tessera.functions.labels import map_label

    orders = table(spark, sf_dir, "orders")
    n = F.broadcast(orders.agg(F.count("*").alias("_n")))  # one row
    width = (224 * F.ceil(F.sqrt(F.col("_n") / 70))).cast("long")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    rows = orders.select("o_orderkey", "o_custkey").crossJoin(n).select(
        F.concat(F.lit("s"), (cust % 7).cast("string")).alias("wsi"), F.concat(F.lit("s"), (cust % 7).cast("string"), F.lit("_"), key.cast("string")).alias("cell_id"),
        ((key * 7919 + cust * 31) % width).alias("x_start"), ((key * 104729 + cust * 57) % width).alias("y_start"), _pick(RAW, key % 12).alias("raw_type"), key.alias("key"),
    )
    return rows.withColumns({"x": F.col("x_start") + 112, "y": F.col("y_start") + 112, "cell_type": map_label(F.col("raw_type"), "simplified_broad")})


_RAW_SQL = "[" + ", ".join(f"'{r}'" for r in RAW) + "]"
_CASE = "CASE raw_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BROAD.items()) + " ELSE 'Unknown' END"
CELLS = f"""cells AS (SELECT *, x_start + 112 AS x, y_start + 112 AS y, {_CASE} AS cell_type FROM (
  SELECT 's' || (o_custkey % 7) AS wsi, 's' || (o_custkey % 7) || '_' || o_orderkey AS cell_id, (o_orderkey * 7919 + o_custkey * 31) % w AS x_start,
         (o_orderkey * 104729 + o_custkey * 57) % w AS y_start, {_RAW_SQL}[1 + o_orderkey % 12] AS raw_type, o_orderkey AS key
  FROM orders, (SELECT CAST(224 * ceil(sqrt(count(*) / 70)) AS BIGINT) AS w FROM orders)))"""


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """wsi, cell_id, label, vector, tokens (four named slices of the vector)."""
    rows = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("s"), (F.col("vec_id") % 7).cast("string")).alias("wsi"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("cell_id"), F.col("vec_id").alias("key"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("label"), F.col("embedding").alias("vector"))
    slices = [x for i, t in enumerate(TOKENS) for x in (F.lit(t), F.slice("vector", 1 + 16 * i, 16))]
    return rows.withColumn("tokens", F.create_map(*slices))


EMB = "emb AS (SELECT 's' || (vec_id % 7) AS wsi, 'v' || vec_id AS cell_id, vec_id AS key, 'c' || label AS label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vector FROM embeddings)"


def masked(emb: DataFrame) -> DataFrame:
    """The same cells with the central dimensions set to zero."""
    return emb.withColumn("vector", F.transform("vector", lambda x, i: F.when((i >= 24) & (i < 40), F.lit(0.0)).otherwise(x)))


MASKED = "masked AS (SELECT wsi, cell_id, list_transform(list_zip(vector, range(64)), lambda z: CASE WHEN z[2] >= 24 AND z[2] < 40 THEN 0.0 ELSE z[1] END) AS vector FROM emb)"


def expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """wsi, barcode, gene, count: quantities of an order's parts, fifty genes."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    tasks = tasks_for(spark, items.count(), 500_000)
    rows = items.select("l_orderkey", "l_partkey", "l_quantity").repartition(tasks, "l_orderkey").join(orders.repartition(tasks, "l_orderkey"), "l_orderkey")
    named = rows.select(F.concat(F.lit("s"), (F.col("o_custkey") % 7).cast("string")).alias("wsi"), F.col("l_orderkey").cast("string").alias("barcode"), F.concat(F.lit("g"), (F.col("l_partkey") % 50).cast("string")).alias("gene"), "l_quantity")
    return named.repartition(tasks, "wsi", "barcode").groupBy("wsi", "barcode", "gene").agg(F.sum("l_quantity").alias("count"))


EXPR = "expr AS (SELECT 's' || (o_custkey % 7) AS wsi, CAST(l_orderkey AS VARCHAR) AS barcode, 'g' || (l_partkey % 50) AS gene, sum(l_quantity) AS count FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)"


def expression_cells(expr: DataFrame) -> DataFrame:
    return expr.select("wsi", "barcode").distinct()


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """wsi, cell_id, split_idx, true_label, predicted_label, correct: labels with one in five turned."""
    rows = table(spark, sf_dir, "labels")
    guess = (F.col("quality") + (F.col("doc_id") % 5 == 0).cast("int") + F.col("toxic")) % 3
    return rows.select(
        F.concat(F.lit("s"), (F.col("doc_id") % 7).cast("string")).alias("wsi"), F.col("doc_id").cast("string").alias("cell_id"), (F.col("doc_id") % 8).cast("int").alias("split_idx"),
        F.concat(F.lit("q"), F.col("quality").cast("string")).alias("true_label"), F.concat(F.lit("q"), guess.cast("string")).alias("predicted_label"), (F.col("quality") == guess).alias("correct"), F.col("doc_id").alias("key"),
    )


PRED = """pred AS (SELECT *, true_label = predicted_label AS correct FROM (SELECT 's' || (doc_id % 7) AS wsi, CAST(doc_id AS VARCHAR) AS cell_id, CAST(doc_id % 8 AS INTEGER) AS split_idx, 'q' || quality AS true_label,
  'q' || ((quality + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END + toxic) % 3) AS predicted_label, doc_id AS key FROM labels))"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """condition, split_idx, metric: one run for each event type and fold."""
    rows = table(spark, sf_dir, "events")
    return rows.groupBy(F.col("event_type").alias("condition"), (F.col("user_id") % 8).cast("int").alias("split_idx")).agg(F.round(F.avg("value"), 6).alias("metric"))


RUNS = "runs AS (SELECT event_type AS condition, CAST(user_id % 8 AS INTEGER) AS split_idx, round(avg(value), 6) AS metric FROM events GROUP BY ALL)"


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """wsi, cell_id, ring, x0, y0, w, h: a rectangle for each part."""
    key = F.col("p_partkey")
    parts = table(spark, sf_dir, "part")
    parts = parts.repartition(tasks_for(spark, parts.count(), POLYGONS), "p_partkey")  # few bytes mean much work
    rows = parts.select(F.concat(F.lit("s"), (key % 7).cast("string")).alias("wsi"), key.alias("key"), key.cast("string").alias("cell_id"), (key * 37 % 2003).cast("double").alias("x0"), (key * 91 % 1999).cast("double").alias("y0"), F.col("p_size").cast("double").alias("w"), (1 + key % 5).cast("double").alias("h"))
    at = lambda dx, dy: F.struct((F.col("x0") + dx).alias("x"), (F.col("y0") + dy).alias("y"))
    return rows.withColumn("ring", F.array(at(F.lit(0.0), F.lit(0.0)), at(F.col("w"), F.lit(0.0)), at(F.col("w"), F.col("h")), at(F.lit(0.0), F.col("h"))))


POLY = "poly AS (SELECT 's' || (p_partkey % 7) AS wsi, p_partkey AS key, CAST(p_partkey AS VARCHAR) AS cell_id, CAST(p_partkey * 37 % 2003 AS DOUBLE) AS x0, CAST(p_partkey * 91 % 1999 AS DOUBLE) AS y0, CAST(p_size AS DOUBLE) AS w, CAST(1 + p_partkey % 5 AS DOUBLE) AS h FROM part)"
