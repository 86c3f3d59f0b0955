"""Readers of the domain's tables. All go through Spark's sources, so any store that Spark reaches will do."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.labels import map_label
from tessera.functions.rings import MICRONS_PER_PIXEL
from tessera.functions.scalars import CENTER, strip_prefix
from tessera.functions.vectors import pool_tokens
from tessera.sources.storage import stored


def resolve_column(columns: list[str], *parts: str) -> str:
    """The first column whose lower-case name holds one of some parts."""
    for part in parts:
        for c in columns:
            if part in c.lower():
                return c
    raise KeyError(f"no column like {parts} in {columns}")


def read_cells(spark: SparkSession, path: str, wsis: list[str] | None = None) -> DataFrame:
    """wsi, cell_id, x_start, y_start, cell_type and the centre x, y; wsis prune partitions."""
    df = spark.read.parquet(path)
    df = df.filter(F.col("wsi").isin(wsis)) if wsis else df
    return df.withColumns({"x": F.col("x_start") + CENTER, "y": F.col("y_start") + CENTER})


def select_embeddings(df: DataFrame, model: str, correction: str, wsis: list[str] | None, tokens: list[str] | None, matching: bool, mapping: str | None, coords: bool = False) -> DataFrame:
    """wsi, cell_id, label, vector (the mean of the chosen read-outs) and the centroids if coords."""
    rows = df.filter((F.col("model") == model) & (F.col("correction") == correction))
    rows = rows.filter(F.col("wsi").isin(wsis)) if wsis else rows
    rows = rows.filter(F.coalesce("matching", F.lit(True))) if matching and "matching" in df.columns else rows
    label = map_label(F.col("cell_label"), mapping) if mapping else F.col("cell_label")
    more = ["x_centroid", "y_centroid"] if coords else []
    kept = ["matching"] if not matching and "matching" in df.columns else []
    return rows.select("wsi", "cell_id", label.alias("label"), pool_tokens(F.col("tokens"), tokens).alias("vector"), *more, *kept)


def read_embeddings(spark: SparkSession, path: str, model: str, correction: str, wsis=None, tokens=None, matching: bool = False, mapping: str | None = None) -> DataFrame:
    return select_embeddings(spark.read.parquet(path), model, correction, wsis, tokens, matching, mapping)


def read_embeddings_with_coords(spark: SparkSession, path: str, model: str, correction: str, wsis=None, tokens=None, matching: bool = False, mapping: str | None = None) -> DataFrame:
    return select_embeddings(spark.read.parquet(path), model, correction, wsis, tokens, matching, mapping, True)


def read_boundaries(spark: SparkSession, path: str, wsi: str, kind: str, format: str = "parquet") -> DataFrame:
    """wsi, cell_id, kind, seq, vertex_x, vertex_y; columns are found by their names, ids become text. seq orders rows as they stand in their files (file, part of it, row), however Spark deals them."""
    df = spark.read.parquet(path) if format == "parquet" else spark.read.csv(path, header=True)
    x, y, cell = resolve_column(df.columns, "vertex_x"), resolve_column(df.columns, "vertex_y"), resolve_column(df.columns, "cell_id", "nucleus_id", "id")
    return df.select(F.lit(wsi).alias("wsi"), F.col(cell).cast("string").alias("cell_id"), F.lit(kind).alias("kind"), F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("row")).alias("seq"), F.col(x).cast("double").alias("vertex_x"), F.col(y).cast("double").alias("vertex_y"))


def read_alignment(spark: SparkSession, path: str, wsi: str) -> DataFrame:
    """wsi, m, inverse of a 3 x 3 matrix; any other shape raises. Nine numbers reach the driver."""
    rows = spark.read.csv(path).limit(4).collect()
    m = np.array([[float(v) for v in r] for r in rows if r[0] is not None])
    if m.shape != (3, 3):
        raise ValueError(f"an alignment has 3 x 3 numbers, not {m.shape}")
    return spark.createDataFrame([(wsi, m.tolist(), np.linalg.inv(m).tolist())], "wsi string, m array<array<double>>, inverse array<array<double>>")


_POINTS = "array<array<double>>"
_GEOMETRY = "type:string,coordinates:string,geometries:string"


def geojson_geometries(spark: SparkSession, path: str) -> DataFrame:
    """f, path, label, type, coordinates of each geometry that isn't a collection: collections, and collections in them, are opened level by level.

    f numbers the features of all files in the order of their names; path is the places within collections. coordinates are text; null geometries stay, with a null type.
    """
    schema = f"features array<struct<geometry:struct<{_GEOMETRY}>,properties:struct<classification:struct<name:string>>>>"
    files = spark.read.schema(schema).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode("features").alias("f", "feature"))
    rows = files.select(F.struct("file", "f").alias("f"), F.array().cast("array<int>").alias("path"), F.col("feature.properties.classification.name").alias("label"), "feature.geometry.*")
    done = []
    while True:
        done.append(rows.filter(F.coalesce(F.col("type") != "GeometryCollection", F.lit(True))).drop("geometries"))
        inner = rows.filter(F.col("type") == "GeometryCollection").select("f", "path", "label", F.posexplode(F.from_json("geometries", f"array<struct<{_GEOMETRY}>>")).alias("i", "g"))
        rows = stored(inner.select("f", F.concat("path", F.array("i")).alias("path"), "label", "g.*"), "geometries")
        if not rows.limit(1).count():
            return reduce(DataFrame.unionByName, done)


def geojson_shapes(spark: SparkSession, path: str, sample: str) -> DataFrame:
    """wsi, cell_id ({sample}_cvit_{i}), label, shape of each polygon in the order of the file, a row for each part of a multi-polygon, with its holes.

    Geometries of other kinds and empty polygons give no row; geojson_skipped counts them. Ids are dealt by one pass over the rows' places in each file, from the number of
    rows in the files before it.
    """
    rows = geojson_geometries(spark, path)
    text, kind = F.col("coordinates"), F.col("type")
    parts = F.when(kind == "Polygon", F.array(F.from_json(text, f"array<{_POINTS}>"))).when(kind == "MultiPolygon", F.from_json(text, f"array<array<{_POINTS}>>"))
    rows = rows.select("f", "path", "label", F.posexplode(parts).alias("part", "rings"))
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    rows = rows.filter(F.size(F.get("rings", F.lit(0))) >= 3).withColumn("shape", F.array(F.transform("rings", lambda r: F.transform(r, point))))
    sizes = rows.groupBy("f.file").agg(F.count("*").alias("_n"))
    starts = sizes.select("file", (F.sum("_n").over(Window.orderBy("file")) - F.col("_n")).alias("_start"))  # a row a file
    rows = rows.withColumn("file", F.col("f.file")).join(F.broadcast(starts), "file")
    number = F.col("_start") + F.row_number().over(Window.partitionBy("file").orderBy("f", "path", "part")) - 1
    return rows.select(F.lit(sample).alias("wsi"), F.concat(F.lit(f"{sample}_cvit_"), number.cast("string")).alias("cell_id"), "label", "shape")


def geojson_skipped(spark: SparkSession, path: str) -> DataFrame:
    """type, n: geometries without a polygon - of other kinds, null ones, and polygons without a ring of three points."""
    text, kind = F.col("coordinates"), F.col("type")
    rings = F.when(kind == "Polygon", F.array(F.from_json(text, f"array<{_POINTS}>"))).when(kind == "MultiPolygon", F.from_json(text, f"array<array<{_POINTS}>>"))
    whole = F.exists(F.coalesce(rings, F.array().cast(f"array<array<{_POINTS}>>")), lambda r: F.coalesce(F.size(F.get(r, F.lit(0))) >= 3, F.lit(False)))
    return geojson_geometries(spark, path).filter(~whole).groupBy(F.coalesce("type", F.lit("none")).alias("type")).agg(F.count("*").alias("n"))


def read_geojson_nuclei(spark: SparkSession, path: str, sample: str) -> DataFrame:
    """wsi, cell_id, label, ring of the polygons of geojson_shapes: their shells alone."""
    return geojson_shapes(spark, path, sample).select("wsi", "cell_id", "label", F.get(F.get("shape", F.lit(0)), F.lit(0)).alias("ring"))


def nuclei(vertices: DataFrame, mpp: float = MICRONS_PER_PIXEL) -> DataFrame:
    """Polygons in pixels of vertices in microns."""
    from tessera.functions.rings import build_polygon

    return build_polygon(vertices.withColumns({"vertex_x": F.col("vertex_x") / mpp, "vertex_y": F.col("vertex_y") / mpp}))


def mpp_of(*keys: Column) -> Column:
    return F.coalesce(*keys, F.raise_error(F.lit("no pixel size")).cast("double"))


def resolve_mpp(spark: SparkSession, path: str) -> DataFrame:
    """mpp: the first that is there of pixel_size, pixel_size_um and morphology_pixel_size; none raises."""
    schema = "pixel_size double, pixel_size_um double, morphology_pixel_size double"
    return spark.read.schema(schema).json(path, multiLine=True).select(mpp_of(F.col("pixel_size"), F.col("pixel_size_um"), F.col("morphology_pixel_size")).alias("mpp"))


def read_expression(spark: SparkSession, path: str, wsis: list[str] | None = None, genes: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    df = df.filter(F.col("wsi").isin(wsis)) if wsis else df
    return df.filter(F.col("gene").isin(genes)) if genes else df


def select_hvgs(hvg: DataFrame, n: int) -> DataFrame:
    """Genes that the test has, by rank (nulls last), with top (the first n). Fewer ranked genes than n raise."""
    rows = hvg.filter("present_in_test").withColumn("_r", F.row_number().over(Window.orderBy(F.asc_nulls_last("highly_variable_rank"), "gene_name")))  # a row per gene
    ranked = F.count("highly_variable_rank").over(Window.partitionBy(F.lit(0)))
    top = F.when(ranked < n, F.raise_error(F.lit(f"fewer than {n} ranked genes")).cast("boolean")).otherwise(F.col("_r") <= n)
    return rows.withColumn("top", top).drop("_r")


def read_hvg_table(spark: SparkSession, path: str, n: int) -> DataFrame:
    return select_hvgs(spark.read.parquet(path), n)


def usable_manifest(df: DataFrame) -> DataFrame:
    """Rows whose status is ok (or missing), converted as a boolean."""
    status = F.lower(F.trim(F.coalesce(F.col("status") if "status" in df.columns else F.lit(None).cast("string"), F.lit("ok"))))
    return df.filter(status == "ok").withColumn("converted", F.lower(F.trim("converted")).isin("true", "1", "yes"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return usable_manifest(spark.read.csv(path, header=True))


def with_native_id(cells: DataFrame) -> DataFrame:
    """cells with native_cell_id: the slide's prefix is stripped on slides where any id has it."""
    prefix = F.concat(F.col("wsi"), F.lit("_"))
    has = cells.groupBy("wsi").agg(F.max(F.startswith("cell_id", prefix)).alias("_has"))
    rows = cells.join(has, "wsi")
    return rows.withColumn("native_cell_id", F.when(F.col("_has"), strip_prefix(F.col("cell_id"), prefix)).otherwise(F.col("cell_id"))).drop("_has")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return with_native_id(read_cells(spark, path))


def _documents(spark: SparkSession, root: str, glob: str, segments: list[str], where: dict[str, list[str]] | None = None) -> DataFrame:
    """path and content of the files whose folder path below root has these segments; only folders that where names are listed."""
    unknown = set(where or {}) - set(segments)
    if unknown:
        raise KeyError(f"no segments {sorted(unknown)} in {segments}")
    folders = ["{" + ",".join(where[s]) + "}" if s in (where or {}) else "*" for s in segments]
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).load("/".join([root.rstrip("/"), *folders]))
    return rows.select("path", "content")


def _segments(segments: list[str]) -> list[Column]:
    """The segments of a path's folders; of a folder named name=value the value."""
    parts = F.split("path", "/")
    return [F.regexp_replace(F.element_at(parts, i - len(segments) - 1), "^[^=]*=", "").alias(s) for i, s in enumerate(segments)]


def read_probe_runs(spark: SparkSession, root: str, segments: list[str], glob: str = "*.yaml", where: dict[str, list[str]] | None = None) -> DataFrame:
    """segments, probe, skipped, reason, metrics (a map) of each probe of each run's YAML file, skipped ones too: {probe: {skipped, reason, name: number ...}}."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                for probe, record in (yaml.safe_load(bytes(content)) or {}).items():
                    record = record or {}
                    numbers = {k: float(v) for k, v in record.items() if isinstance(v, int | float) and not isinstance(v, bool)}
                    rows.append((path, probe, bool(record.get("skipped", False)), record.get("reason"), numbers))
            yield pd.DataFrame(rows, columns=["path", "probe", "skipped", "reason", "metrics"])

    rows = _documents(spark, root, glob, segments, where).mapInPandas(run, "path string, probe string, skipped boolean, reason string, metrics map<string,double>")
    return rows.select(*_segments(segments), "probe", "skipped", "reason", "metrics")


def read_runs(spark: SparkSession, root: str, segments: list[str], glob: str = "*.yaml", where: dict[str, list[str]] | None = None) -> DataFrame:
    """The segments of each YAML file's folder path and its numbers as metrics, a map of dotted names.

    where names the values of some segments: other folders are not listed, so that a part of a large tree is read without walking it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        def flat(prefix: str, value) -> Iterator[tuple[str, float]]:
            if isinstance(value, dict):
                for k, v in value.items():
                    yield from flat(f"{prefix}.{k}" if prefix else str(k), v)
            elif isinstance(value, int | float) and not isinstance(value, bool):
                yield prefix, float(value)

        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "metrics": [dict(flat("", yaml.safe_load(bytes(c)) or {})) for c in pdf["content"]]})

    rows = _documents(spark, root, glob, segments, where).mapInPandas(run, "path string, metrics map<string,double>")
    return rows.select("path", *_segments(segments), "metrics")


def long_metrics(runs: DataFrame, prefix: str, name: str) -> DataFrame:
    """One row for each metric that begins with prefix."""
    keys = [c for c in runs.columns if c != "metrics"]
    rows = runs.select(*keys, F.explode("metrics").alias(name, "value"))
    return rows.filter(F.startswith(name, F.lit(prefix))).withColumn(name, F.substr(name, F.lit(len(prefix) + 1)))


def scalar_metrics(runs: DataFrame, pattern: str) -> DataFrame:
    return runs.withColumn("metrics", F.map_filter("metrics", lambda k, v: k.rlike(pattern) & v.isNotNull()))


def enrich_runs(summary: DataFrame, detail: DataFrame, keys: list[str]) -> DataFrame:
    """Summary rows, skipped ones too, with their detail records."""
    return summary.join(detail, keys, "left")


def read_predictions(spark: SparkSession, root: str, glob: str = "*.csv") -> DataFrame:
    """Predictions of every fold with split_idx from the file's name."""
    df = spark.read.option("header", True).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").csv(root)
    return df.withColumn("split_idx", F.regexp_extract(F.input_file_name(), r"split_(-?\d+)", 1).cast("int"))


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, name, kind, dataset, duplicate of every file; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    return parse_inventory(files)


def parse_inventory(files: DataFrame) -> DataFrame:
    """Names, kinds (endings) and datasets (what comes before the first underscore or point) of paths; names that stand twice are duplicates, those without a dataset unparsed."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.withColumn("name", name).withColumn("kind", F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1)).withColumn("dataset", F.regexp_extract("name", r"^([A-Za-z0-9-]+)[_.]", 1))
    return rows.withColumns({"duplicate": F.count("*").over(Window.partitionBy("name")) > 1, "unparsed": F.col("dataset") == ""})


def section_coverage(files: DataFrame, samples: DataFrame, pattern: str) -> DataFrame:
    """name, sample of the samples that a file's name lists and that no file of their own has."""
    tokens = files.select("name", F.explode(F.regexp_extract_all("name", F.lit(pattern), F.lit(0))).alias("sample")).distinct()
    return tokens.join(samples.select("sample").distinct(), "sample", "left_anti").select("name", "sample")


def read_dapi_stats(spark: SparkSession, path: str) -> DataFrame:
    """wsi, cell_id, mean_intensity, area, measured elsewhere."""
    return spark.read.parquet(path)
