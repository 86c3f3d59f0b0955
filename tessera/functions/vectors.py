"""Vector functions on arrays of floats; elements are taken as doubles before anything is multiplied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def pool_tokens(tokens: Column, keys: list[str] | None = None) -> Column:
    """Element-wise mean over chosen read-outs of a map; all if none is named."""
    vectors = F.array(*[F.element_at(tokens, F.lit(k)) for k in keys]) if keys else F.map_values(tokens)
    first = doubles(F.get(vectors, F.lit(0)))
    sums = F.aggregate(F.slice(vectors, F.lit(2), F.size(vectors)), first, lambda a, v: F.zip_with(a, v, lambda x, y: x + y.cast("double")))
    return F.transform(sums, lambda x: x / (len(keys) if keys else F.size(tokens)))


def select_token(flat: Column, row: Column, col: Column, side: int, dim: int) -> Column:
    """The vector of a token in a row-major side x side x dim array."""
    return F.slice(flat, (row * side + col) * dim + 1, dim)


def mask_tokens(tokens: Column, block: list[int], mask: Column) -> Column:
    """tokens (an array of vectors) with those of a block overwritten."""
    return F.transform(tokens, lambda t, i: F.when(i.isin(block), mask).otherwise(t))


def cosine_distance(a: Column, b: Column, floor: float = 1e-12) -> Column:
    return 1 - dot(a, b) / (F.greatest(norm(a), F.lit(floor)) * F.greatest(norm(b), F.lit(floor)))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Null where a norm is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def pearson(a: Column, b: Column) -> Column:
    """Null where a variance is zero."""
    n = F.size(a)
    part = lambda x, y: dot(x, y) - total(doubles(x)) * total(doubles(y)) / n
    return part(a, b) / F.nullif(F.sqrt(part(a, a) * part(b, b)), F.lit(0.0))


def let(value: Column, body) -> Column:
    """body of a value that is worked out once, though body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def z_score(v: Column, mean: Column, std: Column, eps: float = 1e-8) -> Column:
    return F.zip_with(F.zip_with(v, mean, lambda x, m: x.cast("double") - m), std, lambda d, s: d / (s + eps))


def argmax(v: Column) -> Column:
    """The first place of the largest element, from 0."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def softmax(v: Column) -> Column:
    powers = let(F.array_max(v).cast("double"), lambda top: F.transform(v, lambda x: F.exp(x.cast("double") - top)))
    return let(powers, lambda p: let(total(p), lambda whole: F.transform(p, lambda x: x / whole)))


def vector_stats(df: DataFrame, vector: str, population: bool = True) -> DataFrame:
    """dim, n, mean, std of each component."""
    std = F.stddev_pop if population else F.stddev_samp
    return df.select(F.posexplode(F.col(vector)).alias("dim", "v")).groupBy("dim").agg(F.count("v").alias("n"), F.avg(F.col("v").cast("double")).alias("mean"), std(F.col("v").cast("double")).alias("std"))


def as_vector(df: DataFrame, keys: list[str], dim: str = "dim", value: str = "v", name: str = "vector") -> DataFrame:
    """Rows (keys, dim, value) gathered to an array in the order of dim."""
    ordered = F.array_sort(F.collect_list(F.struct(dim, value)))
    return df.groupBy(*keys).agg(F.transform(ordered, lambda s: s[value]).alias(name))
