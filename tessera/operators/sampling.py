"""Sampling and splitting. Draws are by hashes of keys, so that a result depends on the rows and the seed only; counts are exact."""

from __future__ import annotations

import itertools
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.tables import _with_group
from tessera.sources.storage import stored

#: Letters of a draw's md5 that name a row's block within its group: 4,096 blocks.
LETTERS = 3
#: Rows of a block whose weights are summed in order by one task.
DRAW_BLOCK = 100_000


def draw(seed, *keys: str) -> Column:
    """The order of a draw: the md5 of seed and keys, which other engines have too."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def _numbered(df: DataFrame, group: list[str], order: Column, *ties: str) -> DataFrame:
    """df with _r, the place within its group by a draw and ties, and _n, the group's rows.

    Rows are dealt into blocks of their group by the draw's first LETTERS letters, and the blocks' sizes are added up, so that no window spans a group.
    """
    blocks = df.withColumn("_o", order).withColumn("_k", F.substring("_o", 1, LETTERS))
    sizes = blocks.groupBy(*group, "_k").agg(F.count("*").alias("_c"))
    own = Window.partitionBy(*(group or [F.lit(0)]))  # at most 16 ** LETTERS rows a group
    before = sizes.withColumns({"_before": F.coalesce(F.sum("_c").over(own.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_n": F.sum("_c").over(own)}).drop("_c")
    placed = blocks.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_k").orderBy("_o", *ties)))
    return _with_group(placed, before if group else F.broadcast(before), [*group, "_k"]).withColumn("_r", F.col("_r") + F.col("_before")).drop("_o", "_k", "_before")


def sample_proportion(cells: DataFrame, proportions: DataFrame, seed=0) -> DataFrame:
    """max(1, floor(n * p)) cells of each slide of proportions (wsi, proportion). A slide that has no cell raises."""
    n = cells.groupBy("wsi").agg(F.count("*").alias("_n"))
    plan = proportions.join(n, "wsi", "left").withColumn("_keep", F.when(F.col("_n").isNull(), F.raise_error(F.concat(F.lit("no usable cells in "), F.col("wsi"))).cast("long")).otherwise(F.greatest(F.lit(1), F.floor(F.col("_n") * F.col("proportion")))))
    rows = plan.select("wsi", "_keep").join(cells, "wsi", "left")  # a slide without cells stays, so that it raises
    return _numbered(rows, ["wsi"], draw(seed, "wsi", "cell_id"), "cell_id").filter(F.col("_r") <= F.col("_keep")).drop("_r", "_n", "_keep")


def sample_cell_types(cells: DataFrame, proportions: DataFrame, seed=0, label: str = "cell_type") -> DataFrame:
    """Of each type of a slide max(1, floor(n * p)) cells; p 0 leaves the type out, a type that isn't listed stays whole."""
    rows = cells.join(proportions.select("wsi", label, "proportion"), ["wsi", label], "left").withColumn("proportion", F.coalesce("proportion", F.lit(1.0)))
    keep = F.when(F.col("proportion") <= 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.col("_n") * F.col("proportion"))))
    return _numbered(rows, ["wsi", label], draw(seed, "wsi", "cell_id"), "cell_id").filter(F.col("_r") <= keep).drop("_r", "_n", "proportion")


def resolve_splits(splits: DataFrame) -> DataFrame:
    """split_idx, side, wsi, proportion, val_reused_test: a fold without val reuses its test slides; split -1 pools every slide with its largest proportion."""
    has = splits.groupBy("split_idx").agg(F.max((F.col("side") == "val").cast("int")).alias("_v"))
    reused = splits.join(has.filter("_v = 0"), "split_idx", "left_semi").filter("side = 'test'").select("split_idx", F.lit("val").alias("side"), "wsi", "proportion", F.lit(True).alias("val_reused_test"))
    pooled = splits.groupBy("wsi").agg(F.max("proportion").alias("proportion")).select(F.lit(-1).alias("split_idx"), F.lit("pool").alias("side"), "wsi", "proportion", F.lit(False).alias("val_reused_test"))
    own = splits.select("split_idx", "side", "wsi", "proportion", F.lit(False).alias("val_reused_test"))
    return own.unionByName(reused).unionByName(pooled)


def loso_folds(spark: SparkSession, slides: list[str], always_train: list[str] = (), n_val: int = 1) -> DataFrame:
    """split_idx, side, wsi: each slide is tested once, the next n_val in the circle validate, the rest trains."""
    rows = []
    for i, test in enumerate(slides):
        val = [slides[(i + 1 + j) % len(slides)] for j in range(min(n_val, len(slides) - 1))]
        rows += [(i, "test", test)] + [(i, "val", v) for v in val] + [(i, "train", s) for s in [*slides, *always_train] if s != test and s not in val]
    return spark.createDataFrame(rows, "split_idx int, side string, wsi string")


def random_split(df: DataFrame, keys: list[str], fractions: dict[str, float], seed=0, group: list[str] | None = None) -> DataFrame:
    """df with side: rows in the order of a draw, cut at int(n * cumulated fraction); the last side takes the rest.

    group: rows are cut within groups.
    """
    rows = _numbered(df, group or [], draw(seed, *keys), *keys)
    names, at, side = list(fractions), 0.0, None
    for name in names[:-1]:
        at += fractions[name]
        hit = F.col("_r") <= F.floor(F.col("_n") * round(at, 9))
        side = F.when(hit, name) if side is None else side.when(hit, name)
    return rows.withColumn("side", side.otherwise(names[-1]) if side is not None else F.lit(names[-1])).drop("_r", "_n")


def spatial_checkerboard_folds(cells: DataFrame, patch: int, seed=0, train: float = 0.8) -> DataFrame:
    """wsi, cell_id, split_idx, side: for each of the four parities, that parity's patches are the test; the others are split by patch."""
    rows = cells.withColumns({"_py": F.floor(F.col("y") / patch), "_px": F.floor(F.col("x") / patch)})
    patches = rows.select("wsi", "_py", "_px").distinct().withColumn("split_idx", F.explode(F.array(*map(F.lit, range(4)))))
    parity = (F.pmod("_py", F.lit(2)) * 2 + F.pmod("_px", F.lit(2))).cast("int")
    test = patches.filter(parity == F.col("split_idx")).withColumn("side", F.lit("test"))
    rest = random_split(patches.filter(parity != F.col("split_idx")), ["split_idx", "wsi", "_py", "_px"], {"train": train, "val": 1 - train}, seed, group=["split_idx"])
    return rows.join(test.unionByName(rest), ["wsi", "_py", "_px"]).select("wsi", "cell_id", "split_idx", "side")


def stratified_sample(df: DataFrame, n: int, label: str, seed=0, *keys: str) -> DataFrame:
    """max(1, n // classes) rows of each class."""
    classes = df.agg(F.count_distinct(label).alias("_classes"))
    rows = _numbered(df, [label], draw(seed, *keys), *keys).crossJoin(F.broadcast(classes))  # one row
    return rows.filter(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.lit(n) / F.col("_classes")))).drop("_r", "_n", "_classes")


def subsample(df: DataFrame, n: int, seed=0, *keys: str, group: list[str] | None = None) -> DataFrame:
    """n rows, or n of each group."""
    if group:
        return _numbered(df, group, draw(seed, *keys), *keys).filter(F.col("_r") <= n).drop("_r", "_n")
    return df.orderBy(draw(seed, *keys), *keys).limit(n)


def _uniform(*parts) -> Column:
    """A number from 0 up to 1 by a hash, with 53 bits."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / float(1 << 53)


def oversample(df: DataFrame, weight: str, n: int, seed=0, *keys: str, group: list[str] | None = None) -> DataFrame:
    """Exactly n draws with replacement in proportion to weight (n of each group), as rows of df with draw, which numbers a row's copies from 1.

    Null, negative and NaN weights count as 0; a total of 0 gives no draws. keys tell rows apart and order them; rows that share keys are
    drawn each. A draw falls on the running sum of weights: rows are dealt to blocks by a hash of their keys, the blocks' totals share the n draws out by one
    multinomial draw (a number for each block of DRAW_BLOCK rows reaches the driver), and within a block the draws, uniform over its total, and the running sums are sorted together, so that
    the last row before a draw is the one it hit. Nothing is joined by range.
    """
    group = group or []
    w = F.coalesce(F.when(F.isnan(F.col(weight).cast("double")) | (F.col(weight) < 0), 0.0).otherwise(F.col(weight).cast("double")), F.lit(0.0))
    rows = stored(df.withColumns({"_w": w, "_id": F.monotonically_increasing_id()}), "weighted")  # ids hold once they are written
    label = F.concat_ws("\x01", *[F.coalesce(F.col(g).cast("string"), F.lit("")) for g in group]) if group else F.lit("")
    own = rows.select(label.alias("_g"), "_id", "_w", *keys)
    if group:
        own = own.join(own.groupBy("_g").agg(F.ceil(F.count("*") / DRAW_BLOCK).cast("int").alias("_k")), "_g")
    else:
        own = own.withColumn("_k", F.lit(max(1, -(-rows.count() // DRAW_BLOCK))))
    dealt = own.withColumn("_b", F.pmod(F.xxhash64(F.lit(str(seed)), *(keys or ["_id"])), F.col("_k")))
    totals = dealt.groupBy("_g", "_b").agg(F.sum("_w").alias("_t")).filter("_t > 0").orderBy("_g", "_b").collect()  # a row a block
    shares = []
    for name, own in itertools.groupby(totals, lambda r: r["_g"]):
        own = list(own)
        t = np.array([r["_t"] for r in own])
        rng = np.random.default_rng(zlib.crc32(f"{seed}|{name}".encode()))
        shares += [(name, r["_b"], r["_t"], int(m)) for r, m in zip(own, rng.multinomial(n, t / t.sum()), strict=True) if m]
    shares = df.sparkSession.createDataFrame(shares, "_g string, _b long, _t double, _m long")
    darts = shares.select("_g", "_b", "_t", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_m"))).alias("_j"))
    darts = darts.select("_g", "_b", (_uniform(F.lit(str(seed)), "_g", "_b", "_j") * F.col("_t")).alias("_at"), F.lit(1).alias("_kind"))
    running = Window.partitionBy("_g", "_b").orderBy(*keys, "_id")
    begin = dealt.filter("_w > 0").withColumn("_at", F.sum("_w").over(running) - F.col("_w")).select("_g", "_b", "_at", F.lit(0).alias("_kind"), "_id")
    board = Window.partitionBy("_g", "_b").orderBy("_at", "_kind", "_id").rowsBetween(Window.unboundedPreceding, 0)
    hit = begin.unionByName(darts, True).withColumn("_hit", F.last("_id", True).over(board)).filter("_kind = 1")
    times = hit.groupBy(F.col("_hit").alias("_id")).agg(F.count("*").alias("_times"))
    return rows.join(times, "_id").withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).drop("_id", "_w", "_times")


def equalised(df: DataFrame, group: str, seed=0, *keys: str) -> DataFrame:
    """Each group drawn with replacement to the size of the largest, every row as likely; draw numbers a row's copies."""
    largest = df.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    even = df.withColumn("_even", F.lit(1.0))
    return oversample(even, "_even", largest, seed, *keys, group=[group]).drop("_even")


def expand_grid(spark: SparkSession, tuned: dict[str, list], fixed: dict[str, list] | None = None) -> DataFrame:
    """trial_idx and one column for each parameter: the product of tuned lists in order, and the first value of fixed ones."""
    lists = {**tuned, **{k: v[:1] for k, v in (fixed or {}).items()}}
    return spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(itertools.product(*lists.values()))], ["trial_idx", *lists])


def spatial_smooth(values: DataFrame, neighbours: DataFrame, value: str) -> DataFrame:
    """wsi, cell_id, smoothed: the mean of a cell's value and its neighbours'."""
    other = values.select("wsi", F.col("cell_id").alias("other_id"), F.col(value).alias("_v"))
    near = neighbours.select("wsi", "cell_id", "other_id").union(values.select("wsi", "cell_id", F.col("cell_id").alias("other_id")))
    return near.join(other, ["wsi", "other_id"]).groupBy("wsi", "cell_id").agg(F.avg("_v").alias("smoothed"))
