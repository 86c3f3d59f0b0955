"""Scalar column functions of positions, crops, angles, scores and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CENTER = 112


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def cell_center(start: Column, offset: int = CENTER) -> Column:
    return start + offset


def clamp(x: Column, low, high) -> Column:
    return F.greatest(lit(low), F.least(x, lit(high)))


def clamp_origin(x: Column, offset, width, size) -> Column:
    """A crop's origin, shifted inside the slide."""
    return clamp(x + lit(offset), 0, lit(width) - lit(size))


def fixed_crop_origin(center: Column, side: int, width) -> Column:
    return clamp_origin(center, -(side // 2), width, side)


def polygon_crop_box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """struct(x0, y0, side): the square around a box on its longer axis, at least 1 wide, rounded half to even."""
    side = F.greatest(F.bround(F.greatest(xmax - xmin, ymax - ymin), 0), F.lit(1.0)).cast("int")
    origin = lambda a, b: F.bround((a + b) / 2 - side / 2, 0).cast("int")
    return F.struct(origin(xmin, xmax).alias("x0"), origin(ymin, ymax).alias("y0"), side.alias("side"))


def central_block(size: int, token: int, grid: int) -> tuple[int, int]:
    """(first token, first pixel) of the central grid x grid tokens along an axis."""
    first = (size // token - grid) // 2
    return first, first * token


def block_tokens(tokens_per_side: int, grid: int) -> list[int]:
    """Row-major indices of the central grid x grid tokens."""
    first = (tokens_per_side - grid) // 2
    return [r * tokens_per_side + c for r in range(first, first + grid) for c in range(first, first + grid)]


def barcode(cell_id: Column) -> Column:
    return F.element_at(F.split(cell_id, "_"), -1)


def strip_prefix(value: Column, prefix: Column) -> Column:
    return F.when(F.startswith(value, prefix), F.substr(value, F.length(prefix) + 1)).otherwise(value)


def relative_position(rel: Column, scale, size: int) -> Column:
    return clamp(F.bround(rel * lit(scale), 0), 0, size - 1).cast("int")


def token_index(rel: Column, token: int, tokens_per_side: int) -> Column:
    return clamp(F.floor(rel / token), 0, tokens_per_side - 1).cast("int")


def distance_score(distance: Column) -> Column:
    return 1 / (1 + distance / 15)


def orientation_score(difference: Column) -> Column:
    return 1 - difference / 90


def penalty_score(iou: Column, distance: Column, angle: Column, elong_a: Column, elong_b: Column, w_distance=0.5, norm_distance=100.0, w_angle=0.5, norm_angle=90.0) -> Column:
    return iou - w_distance * clamp(distance / norm_distance, 0.0, 1.0) - w_angle * F.least(elong_a, elong_b) * clamp(angle / norm_angle, 0.0, 1.0)


def angle_difference(a: Column, b: Column) -> Column:
    """Smallest difference of two axes, in degrees from 0 to 90."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, 180.0 - d)


def angle_to_doubled(angle: Column) -> Column:
    return F.array(F.cos(F.radians(angle) * 2), F.sin(F.radians(angle) * 2))


def doubled_to_angle(c: Column, s: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(s, c) / 2), F.lit(180.0))


def log1p_target(x: Column) -> Column:
    return F.log1p(x)


def density(count: Column, px) -> Column:
    return count * (100.0 / lit(px)) * (100.0 / lit(px))


def patch_row(v: Column, patch: int) -> Column:
    return F.floor(v / patch)


def checkerboard(x: Column, y: Column, patch: int, parity: tuple[int, int] = (0, 0)) -> Column:
    """Whether a position lies on a patch of the given (row, column) parity."""
    return (F.pmod(patch_row(y, patch), F.lit(2)) == parity[0]) & (F.pmod(patch_row(x, patch), F.lit(2)) == parity[1])


def quadrant(correct_a: Column, correct_b: Column) -> Column:
    return F.when(correct_a & correct_b, "both").when(correct_a & ~correct_b, "only_a").when(~correct_a & correct_b, "only_b").otherwise("neither")


def tokens_segment(keys: Column) -> Column:
    return F.when(F.size(keys) > 0, F.array_join(F.array_sort(keys), "_")).otherwise("default")


def split_index(label: Column) -> Column:
    """The number at the end of a split's name; -1 for a same-slide run."""
    return F.coalesce(F.nullif(F.regexp_extract(label, r"(\d+)$", 1), F.lit("")).cast("int"), F.lit(-1))


def condition(model: Column, tokens: Column) -> Column:
    return F.concat_ws(" | ", model, tokens)


def probe_key(name: Column, px: Column) -> Column:
    return F.when(px.isNull(), name).otherwise(F.concat(name, F.lit("@"), px.cast("string")))


def format_mean_std(mean: Column, std: Column, n: Column, expected: int) -> Column:
    text = F.format_string("%.4f +/- %.4f", mean, F.coalesce(std, F.lit(0.0)))
    return F.when(mean.isNull(), F.lit("-")).when(n < expected, F.concat(text, F.format_string(" (%d/%d)", n, F.lit(expected)))).otherwise(text)


def completeness(n_done: Column, n_skipped: Column, expected: int) -> Column:
    return F.when(n_done + n_skipped == 0, "missing").when(n_skipped == expected, "skipped").when(n_done + n_skipped < expected, "partial").otherwise("done")


def suspicious(tissue_fraction: Column, error: Column) -> Column:
    return error.isNotNull() | (tissue_fraction < 0.2)


def tissue_fraction(tissue: Column, total: Column) -> Column:
    return tissue / F.nullif(total, F.lit(0))


def image_bytes(width: Column, height: Column, shape: Column) -> Column:
    """width * height * 3, or the product of a header's shape ("h,w,c") where they are missing."""
    product = F.aggregate(F.split(shape, r"\s*,\s*"), F.lit(1).cast("long"), lambda a, x: a * x.cast("long"))
    return F.when(width.isNotNull() & height.isNotNull(), width.cast("long") * height * 3).otherwise(product)


def filter_or_keep(df: DataFrame, predicate: Column) -> DataFrame:
    """The rows that match, or all rows if none does."""
    found = df.withColumn("_hit", F.coalesce(predicate, F.lit(False)))
    some = found.agg(F.coalesce(F.max("_hit"), F.lit(False)).alias("_some"))  # one row
    return found.crossJoin(F.broadcast(some)).filter(F.col("_hit") | ~F.col("_some")).drop("_hit", "_some")


def flatten_metrics(df: DataFrame, column: str, keys: list[str], prefix: str) -> DataFrame:
    return df.select("*", *[F.element_at(F.col(column), F.lit(k)).alias(f"{prefix}{k}") for k in keys]).drop(column)


# Grid side, token pixels, prefix tokens, central tokens per side, dimension.
ENCODERS = [
    ("UNI2", 16, 14, 9, 3, 1536), ("Virchow2", 16, 14, 5, 3, 1280), ("H-Optimus-1", 16, 14, 5, 3, 1536), ("Phikon-v2", 14, 16, 1, 2, 1024),
    ("CellViT-HIPT", 16, 16, 1, 2, 384), ("CellViT-SAM", 16, 16, 0, 2, 1280), ("CONCH", 28, 16, 1, 2, 768), ("CTransPath", 7, 32, 0, 1, 768),
]


def encoders(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENCODERS, "encoder string, grid_side int, token_px int, prefix_tokens int, center_tokens int, dim int")
