"""Joins and aggregates in space. All are equi-joins on (wsi, grid bin) with the exact test behind them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import overlay, polygons
from tessera.functions.rings import bbox
from tessera.functions.scalars import angle_difference, distance_score, orientation_score, penalty_score
from tessera.sources.storage import stored, tasks_for

#: Cells, and polygons, that a task of a join in space gets, about.
CELLS, POLYGONS = 50_000, 20_000
#: Others in a square of the reach, on average, from which matching by shape starts with a smaller one.
NEAR = 64


def _bins(v: Column, reach: float, size: float) -> Column:
    """The bins of a closed interval around v."""
    return F.sequence(F.floor((v - reach) / size), F.floor((v + reach) / size))


def near_join(left: DataFrame, right: DataFrame, reach: float, keys: tuple[str, ...] = ("wsi",), size: float | None = None, tasks: int | None = None) -> DataFrame:
    """Pairs of keys' equals whose positions (left lx, ly; right rx, ry) lie within a closed square of half side reach.

    The right side lies in one bin of width 2 * reach; a left row goes to the bins that its square meets, one or two along an axis. With tasks, bins are
    dealt over so many, and pairs keep their bin (_bx, _by).
    """
    size = float(size or 2 * reach)
    a = left.withColumn("_bx", F.explode(_bins(F.col("lx"), reach, size))).withColumn("_by", F.explode(_bins(F.col("ly"), reach, size)))
    b = right.withColumns({"_bx": F.floor(F.col("rx") / size), "_by": F.floor(F.col("ry") / size)})
    bins = [*keys, "_bx", "_by"]
    a, b = (df.repartition(tasks, *bins) if tasks else df for df in (a, b))
    both = a.join(b, bins).filter((F.abs(F.col("lx") - F.col("rx")) <= reach) & (F.abs(F.col("ly") - F.col("ry")) <= reach))
    return both if tasks else both.drop("_bx", "_by")


def _sides(cells: DataFrame, population: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    left = cells.select("wsi", "cell_id", F.col("x").alias("lx"), F.col("y").alias("ly"))
    right = population.select("wsi", F.col("cell_id").alias("other_id"), F.col("x").alias("rx"), F.col("y").alias("ry"), *[F.col(c).alias(f"other_{c}") for c in columns])
    return left.filter(F.col("lx").isNotNull() & F.col("ly").isNotNull()), right


def window_join(cells: DataFrame, population: DataFrame, px: float, include_self: bool = True, columns: list[str] | None = None) -> DataFrame:
    """wsi, cell_id, other_id (and other_<column>) of the population in the closed px x px square around each cell."""
    left, right = _sides(cells, population, columns or [])
    pairs = near_join(left, right, px / 2)
    return pairs if include_self else pairs.filter(F.col("cell_id") != F.col("other_id"))


def radius_join(cells: DataFrame, population: DataFrame, radius: float, include_self: bool = False, columns: list[str] | None = None) -> DataFrame:
    """As window_join, within a Euclidean radius; distance is added."""
    left, right = _sides(cells, population, columns or [])
    pairs = near_join(left, right, radius).withColumn("distance", F.hypot(F.col("lx") - F.col("rx"), F.col("ly") - F.col("ry"))).filter(F.col("distance") <= radius)
    return pairs if include_self else pairs.filter(F.col("cell_id") != F.col("other_id"))


def knn_join(cells: DataFrame, k: int, parity: bool = False, start: float = 224.0) -> DataFrame:
    """wsi, cell_id, rank, other_id, distance: the k nearest other cells of the slide, ties to the smaller id.

    With parity, k counts the cell itself, as a search that includes it does: k - 1 others are given. Rows whose k-th neighbour is not certain
    within the reach of a round are searched again with twice the reach, up to the slide's extent. Each bin gives a cell's k nearest in it, in tasks of
    about CELLS cells, so what a task sorts doesn't grow with the table.
    """
    k = k - 1 if parity else k
    schema = "wsi string, cell_id string, rank int, other_id string, distance double"
    spark = cells.sparkSession
    if k < 1:
        return spark.createDataFrame([], schema)
    cells = cells.select(F.col("wsi").cast("string"), F.col("cell_id").cast("string"), F.col("x").cast("double"), F.col("y").cast("double")).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    *extent, n = cells.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.count("*")).first()
    extent, tasks = max((v or 0.0) for v in extent), tasks_for(spark, n, CELLS)
    rest, reach, done = cells, start, []

    def nearest(pairs: DataFrame, *keys: str) -> DataFrame:
        return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "wsi", "cell_id").orderBy("distance", "other_id")).cast("int")).filter(F.col("rank") <= k)

    while True:
        pairs = near_join(*_sides(rest, cells, []), reach, tasks=tasks).withColumn("distance", F.hypot(F.col("lx") - F.col("rx"), F.col("ly") - F.col("ry")))
        pairs = pairs.filter((F.col("distance") <= reach) & (F.col("cell_id") != F.col("other_id"))).select("wsi", "_bx", "_by", "cell_id", "other_id", "distance")
        found = nearest(nearest(pairs, "_bx", "_by").repartition(tasks, "wsi", "cell_id"))
        found = stored(found.select("wsi", "cell_id", "rank", "other_id", "distance"), "knn")
        if reach > 1.5 * extent:
            done.append(found)
            break
        full = found.groupBy("wsi", "cell_id").count().filter(F.col("count") >= k).select("wsi", "cell_id")
        done.append(found.join(full, ["wsi", "cell_id"], "left_semi"))
        rest = stored(rest.join(full, ["wsi", "cell_id"], "left_anti"), "knn-rest")
        if not rest.limit(1).count():
            break
        reach *= 2
    return reduce(DataFrame.unionByName, done)


def window_stats(cells: DataFrame, population: DataFrame, px: float, classes: list[str], include_self: bool = True) -> DataFrame:
    """wsi, cell_id, n and n_<class> of the population's types around each cell; cells without any are kept, those without a position are null.

    A bin counts a cell's neighbours before they are sent, in tasks of about CELLS rows.
    """
    rows = cells.count() if population is cells else max(cells.count(), population.count())
    tasks, names = tasks_for(cells.sparkSession, rows, CELLS), ["n", *[f"n_{c}" for c in classes]]
    pairs = near_join(*_sides(cells, population, ["cell_type"]), px / 2, tasks=tasks)
    pairs = pairs if include_self else pairs.filter(F.col("cell_id") != F.col("other_id"))
    in_bin = pairs.groupBy("wsi", "_bx", "_by", "cell_id").agg(F.count("*").alias("n"), *[F.count_if(F.col("other_cell_type") == c).alias(f"n_{c}") for c in classes])
    counts = in_bin.select("wsi", "cell_id", *names).repartition(tasks, "wsi", "cell_id").groupBy("wsi", "cell_id").agg(*[F.sum(c).alias(c) for c in names])
    out = cells.select("wsi", "cell_id", (F.col("x").isNotNull() & F.col("y").isNotNull()).alias("_known")).join(counts, ["wsi", "cell_id"], "left")
    zero = lambda c: F.when(F.col("_known"), F.coalesce(c, F.lit(0))).alias(c)
    return out.select("wsi", "cell_id", *[zero(c) for c in names])


def composition(stats: DataFrame, classes: list[str]) -> DataFrame:
    """Class fractions of a window, and valid (any neighbour)."""
    return stats.select("wsi", "cell_id", *[(F.col(f"n_{c}") / F.nullif(F.col("n"), F.lit(0))).alias(f"f_{c}") for c in classes], (F.coalesce("n", F.lit(0)) > 0).alias("valid"))


def neighbor_type_stats(cells: DataFrame, px: float) -> DataFrame:
    """wsi, cell_id, n, heterotypic (share of neighbours of another type), isolated; the cell itself aside."""
    pairs = window_join(cells, cells, px, False, ["cell_type"]).select("wsi", "cell_id", "other_cell_type")
    out = cells.select("wsi", "cell_id", "cell_type", F.col("x").isNotNull().alias("_known")).join(pairs, ["wsi", "cell_id"], "left")
    stats = out.groupBy("wsi", "cell_id").agg(F.first("_known").alias("_known"), F.count("other_cell_type").alias("n"), F.avg((F.col("other_cell_type") != F.col("cell_type")).cast("double")).alias("heterotypic"))
    known = lambda c: F.when(F.col("_known"), c)
    return stats.select("wsi", "cell_id", known(F.col("n")).alias("n"), known(F.col("heterotypic")).alias("heterotypic"), known(F.col("n") == 0).alias("isolated"))


def majority_label(predictions: DataFrame, radius: float, label: str = "true_label") -> DataFrame:
    """wsi, cell_id, majority: the commonest label within a radius, the cell aside; ties to the first in the alphabet; null without neighbours.

    A cell that stands in several folds counts once.
    """
    return majority_labels(predictions, [radius], label).select("wsi", "cell_id", F.col("majority_0").alias("majority"))


def majority_labels(predictions: DataFrame, radii: list[float], label: str = "true_label") -> DataFrame:
    """wsi, cell_id, its label, and majority_0, majority_1 ... as of majority_label for each radius, from one join within the largest.

    A bin gives the counts of a cell's labels before they are sent, once, in tasks of about CELLS cells.
    """
    single = stored(predictions.select("wsi", "cell_id", F.col("x").cast("double"), F.col("y").cast("double"), label).dropDuplicates(["wsi", "cell_id"]), "cells")
    left, right = _sides(single, single, [label])
    tasks = tasks_for(single.sparkSession, single.count(), CELLS)
    pairs = near_join(left, right, max(radii), tasks=tasks).filter(F.col("cell_id") != F.col("other_id")).withColumn("_d", F.hypot(F.col("lx") - F.col("rx"), F.col("ly") - F.col("ry")))
    other, names = f"other_{label}", [f"_n{i}" for i in range(len(radii))]
    in_bin = pairs.filter(F.col("_d") <= max(radii)).groupBy("wsi", "_bx", "_by", "cell_id", other).agg(*[F.count_if(F.col("_d") <= r).alias(n) for n, r in zip(names, radii, strict=True)])
    counts = in_bin.drop("_bx", "_by").repartition(tasks, "wsi", "cell_id").groupBy("wsi", "cell_id", other).agg(*[F.sum(n).alias(n) for n in names])
    first = lambda n: F.min(F.when(F.col(n) > 0, F.struct(-F.col(n), F.col(other).isNull(), F.col(other).alias("label"))))["label"]
    best = counts.groupBy("wsi", "cell_id").agg(*[first(n).alias(f"majority_{i}") for i, n in enumerate(names)])
    return single.select("wsi", "cell_id", label).join(best, ["wsi", "cell_id"], "left")


def average_offsets(matched: DataFrame, reach: float = 112.0) -> DataFrame:
    """wsi, cell_id, dx, dy, n_used: the mean offset of matched cells within reach, the cell included; null without any."""
    some = matched.filter(F.col("dx").isNotNull())
    pairs = radius_join(matched, some, reach, True, ["dx", "dy"])
    mean = pairs.groupBy("wsi", "cell_id").agg(F.avg("other_dx").alias("dx"), F.avg("other_dy").alias("dy"), F.count("*").alias("n_used"))
    return matched.select("wsi", "cell_id").join(mean, ["wsi", "cell_id"], "left").withColumn("n_used", F.coalesce("n_used", F.lit(0)))


def _contenders(left: DataFrame, right: DataFrame, radius: float, weigh: Callable[[DataFrame, Column], DataFrame], most: Callable[[float], Column], names: int) -> DataFrame:
    """Scored pairs within radius, of left (wsi, cell_id, lx, ly, lring ...) and right (wsi, other_id, rx, ry, rring ...), that hold the best ones of each left row and name.

    Each pair's score is bounded in columns by the two shapes' areas and boxes; of two upright rectangles that is the score. Other overlaps are worked out last: for the
    pair of the highest bound, and then only for those whose bound reaches the best score. The best score goes to the left rows, which meet the right side again, so that
    pairs are not sent. Where more than NEAR others lie in a square of the reach, the reach starts smaller, and doubles up to radius for the rows that a farther
    pair could still win: most(reach) bounds what lies beyond.
    """
    spark, low = left.sparkSession, F.lit(float("-inf"))

    def side(df: DataFrame, p: str, number: str) -> tuple[DataFrame, DataFrame, int]:
        n = df.count()
        whole = df.repartition(tasks_for(spark, n, POLYGONS)).withColumn(number, F.monotonically_increasing_id()).withColumn(f"{p}extent", overlay.shape_extent(F.col(f"{p}ring")))
        whole = stored(whole, "shapes")
        return whole.drop(f"{p}ring"), whole.select(number, f"{p}ring"), n

    (rest, lrings, n_left), (others, rrings, n_right) = side(left, "l", "_i"), side(right, "r", "_j")
    every, found, tasks = rest, [], tasks_for(spark, n_left + n_right, POLYGONS)
    upright = lambda p: F.coalesce(F.col(f"{p}extent.upright"), F.lit(False))
    plain = not any(df.filter(~upright(p)).limit(1).count() for df, p in ((every, "l"), (others, "r")))
    bins = others.select("wsi", F.floor(F.col("rx") / (2 * radius)).alias("_bx"), F.floor(F.col("ry") / (2 * radius)).alias("_by")).distinct().count()
    rounds = 1
    while n_right > NEAR * bins * 4 ** (rounds - 1):
        rounds += 1

    def apart(pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("distance", F.hypot(F.col("lx") - F.col("rx"), F.col("ly") - F.col("ry")))

    def bounded(rows: DataFrame, reach: float) -> DataFrame:
        within = [F.abs(F.col("lx") - F.col("rx")) <= reach, F.abs(F.col("ly") - F.col("ry")) <= reach, F.col("distance") <= reach]  # the cheap ones first
        pairs = apart(near_join(rows, others, reach, tasks=tasks).drop("_bx", "_by")).filter(reduce(lambda x, y: x & y, within)).withColumn("_sure", upright("l") & upright("r"))
        return weigh(pairs, overlay.overlap_bound(F.col("lextent"), F.col("rextent"))).withColumn("_bound", F.coalesce("score", low))

    def exact(pairs: DataFrame) -> DataFrame:
        both = apart(pairs.join(every, "_i").join(others.drop("wsi"), "_j")).join(lrings, "_i").join(rrings, "_j").repartition(tasks)
        return weigh(both, overlay.shape_overlap(F.col("lring"), F.col("rring"), True))

    for k in reversed(range(rounds)):
        reach = radius / 2**k
        known, open_ = F.when(F.col("_sure"), F.col("_bound")), F.when(~F.col("_sure"), F.col("_bound"))
        tops = [] if plain else [F.max(open_).alias("_open"), F.max_by("_j", open_).alias("_j")]
        floors = bounded(rest, reach).groupBy("_i", "name").agg(F.coalesce(F.max(known), low).alias("_floor"), F.max(most(reach)).alias("_most"), *tops)
        floors = stored(floors, "floors")
        if not plain:
            scored = exact(floors.filter(F.col("_open") >= F.col("_floor")).select("_i", "_j", "name")).select("_i", "name", F.col("score").alias("_scored"))
            floors = stored(floors.join(scored, ["_i", "name"], "left").select("_i", "name", F.greatest("_floor", "_scored").alias("_floor"), "_most"), "floors")
        near = rest
        if k:
            settled = floors.filter(F.col("_floor") > F.col("_most") + 1e-9).groupBy("_i").count().filter(F.col("count") == names).select("_i")
            floors = floors.join(settled, "_i", "left_semi")
            rest = stored(rest.join(settled, "_i", "left_anti"), "rest")
        near = near.join(floors.groupBy("_i").agg(F.map_from_entries(F.collect_list(F.struct("name", "_floor"))).alias("_floors")), "_i")
        reached = F.col("_bound") >= F.col("_floors")[F.col("name")] - 1e-9
        close = bounded(near, reach).withColumn("_reached", F.explode(F.when(reached, F.array(F.lit(True)))))  # as a filter it would join the join's condition, and be worked out for all pairs of a bin
        columns = [c for c in close.columns if c not in ("_floors", "_sure", "_bound", "_reached", "lextent", "rextent")]
        if not plain:
            close = stored(close, "close")
            close = close.filter("_sure").select(*columns).unionByName(exact(close.filter("not _sure").select("_i", "_j", "name")).select(*columns))
        found.append(stored(close.select(*columns), "contenders"))
        if k and not rest.limit(1).count():
            break
    return reduce(DataFrame.unionByName, found)


def match_by_radius(detected: DataFrame, reference: DataFrame, weightings: DataFrame, radius: float = 80.0, shapes: bool = False) -> DataFrame:
    """The best reference of each detected cell under each weighting (name, w_distance, w_orientation, w_iou); unmatched cells stay.

    Both sides have wsi, cell_id, x, y, orientation; with shapes also ring (a ring or a shape with holes), which adds the overlap of polygons
    moved to one centroid. Candidates are scored once and weighed by a table of a few rows, whose w_iou is not negative; equal scores (to ten decimals with
    shapes) go to the smaller id.
    """
    more = ["ring"] if shapes else []
    left = detected.select("wsi", "cell_id", F.col("x").alias("lx"), F.col("y").alias("ly"), F.col("orientation").alias("lo"), *[F.col(c).alias(f"l{c}") for c in more])
    right = reference.select("wsi", F.col("cell_id").alias("other_id"), F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("orientation").alias("ro"), *[F.col(c).alias(f"r{c}") for c in more])

    def weigh(pairs: DataFrame, iou: Column) -> DataFrame:
        scored = pairs.withColumns({"distance_score": distance_score(F.col("distance")), "orientation_score": orientation_score(angle_difference(F.col("lo"), F.col("ro"))), "iou_score": iou})
        named = scored.join(F.broadcast(weightings), "name") if "name" in pairs.columns else scored.crossJoin(F.broadcast(weightings))
        return named.withColumn("score", F.col("w_distance") * F.col("distance_score") + F.col("w_orientation") * F.coalesce("orientation_score", F.lit(0.0)) + F.col("w_iou") * F.col("iou_score"))

    def most(reach: float) -> Column:
        near, far = (F.col("w_distance") * distance_score(F.lit(r)) for r in (reach, radius))
        return F.greatest(near, far) + F.greatest("w_orientation", F.lit(0.0)) + F.greatest("w_iou", F.lit(0.0))

    if shapes:
        weighed, score = _contenders(left, right, radius, weigh, most, weightings.count()), F.round("score", 10)
    else:
        pairs = near_join(left, right, radius).withColumn("distance", F.hypot(F.col("lx") - F.col("rx"), F.col("ly") - F.col("ry"))).filter(F.col("distance") <= radius)
        weighed, score = weigh(pairs, F.lit(0.0)), F.col("score")
    best = Window.partitionBy("wsi", "cell_id", "name").orderBy(F.desc(score), "other_id")
    top = weighed.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select("wsi", "cell_id", "name", "other_id", "distance_score", "orientation_score", "iou_score", "score")
    every = detected.select("wsi", "cell_id").crossJoin(F.broadcast(weightings.select("name")))
    return every.join(top, ["wsi", "cell_id", "name"], "left")


def match_merged(reference: DataFrame, detected: DataFrame, radius: float = 100.0, **weights: float) -> DataFrame:
    """wsi, cell_id, other_id, iou, distance, angle, score, dx, dy: the best detected polygon of each reference by overlap less penalties; unmatched ones stay.

    Both have wsi, cell_id, x, y, ring (a ring or a shape with holes), orientation, elongation; equal scores (to ten decimals) go to the smaller id.
    """
    side = lambda df, p: df.select("wsi", F.col("cell_id").alias("cell_id" if p == "l" else "other_id"), *[F.col(c).alias(f"{p}{c}") for c in ("x", "y", "ring", "orientation", "elongation")])

    def weigh(pairs: DataFrame, iou: Column) -> DataFrame:
        scored = pairs.withColumns({"iou": iou, "angle": angle_difference(F.col("lorientation"), F.col("rorientation")), "name": F.lit("all")})
        return scored.withColumn("score", penalty_score(F.col("iou"), F.col("distance"), F.col("angle"), F.col("lelongation"), F.col("relongation"), **weights))

    def most(reach: float) -> Column:
        return penalty_score(F.lit(1.0), F.lit(reach), F.lit(0.0), F.lit(0.0), F.lit(0.0), **weights)

    scored = _contenders(side(reference, "l"), side(detected, "r"), radius, weigh, most, 1)
    best = Window.partitionBy("wsi", "cell_id").orderBy(F.desc(F.round("score", 10)), "other_id")
    top = scored.withColumn("_r", F.row_number().over(best)).filter("_r = 1")
    return reference.select("wsi", "cell_id").join(top.select("wsi", "cell_id", "other_id", "iou", "distance", "angle", "score", (F.col("rx") - F.col("lx")).alias("dx"), (F.col("ry") - F.col("ly")).alias("dy")), ["wsi", "cell_id"], "left")


def touching_pairs(shapes: DataFrame, size: float = 64.0, rings: bool = False) -> DataFrame:
    """wsi, a, b (a < b), with rings also ring_a, ring_b, of polygons (wsi, cell_id, ring) that share a point. Boxes are dealt to the grid bins they meet; a pair is tested in its first common bin."""
    boxed = shapes.select("wsi", "cell_id", "ring", bbox(F.col("ring")).alias("box"))
    b = lambda c: F.floor(F.col(f"box.{c}") / size)
    binned = boxed.withColumn("_bx", F.explode(F.sequence(b("xmin"), b("xmax")))).withColumn("_by", F.explode(F.sequence(b("ymin"), b("ymax"))))
    l = binned.select("wsi", "_bx", "_by", F.col("cell_id").alias("a"), F.col("ring").alias("ra"), F.col("box").alias("ba"))
    r = binned.select("wsi", "_bx", "_by", F.col("cell_id").alias("b"), F.col("ring").alias("rb"), F.col("box").alias("bb"))
    bins, tasks = ["wsi", "_bx", "_by"], tasks_for(shapes.sparkSession, shapes.count(), POLYGONS)
    pairs = l.repartition(tasks, *bins).join(r.repartition(tasks, *bins), bins).filter(F.col("a") < F.col("b"))
    meet = reduce(lambda x, y: x & y, [(F.col(f"ba.{k}min") <= F.col(f"bb.{k}max")) & (F.col(f"bb.{k}min") <= F.col(f"ba.{k}max")) for k in "xy"])
    first = (F.col("_bx") == F.floor(F.greatest("ba.xmin", "bb.xmin") / size)) & (F.col("_by") == F.floor(F.greatest("ba.ymin", "bb.ymin") / size))
    tested = pairs.filter(meet & first).withColumn("_t", polygons.touches(F.col("ra"), F.col("rb")))
    return tested.filter("_t").select("wsi", "a", "b", *([F.col("ra").alias("ring_a"), F.col("rb").alias("ring_b")] if rings else []))


def connected_labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """wsi, cell_id, component: the smallest id reachable. Smallest labels travel along links and then jump to their own label's label."""
    edges = stored(links.select("wsi", "a", "b").union(links.select("wsi", "b", "a")).distinct(), "links")
    labels = stored(nodes.select("wsi", "cell_id", F.col("cell_id").alias("label")), "labels")
    while True:
        heard = edges.join(labels.withColumnRenamed("cell_id", "b"), ["wsi", "b"]).groupBy("wsi", F.col("a").alias("cell_id")).agg(F.min("label").alias("_near"))
        near = labels.join(heard, ["wsi", "cell_id"], "left").select("wsi", "cell_id", F.col("label").alias("_old"), F.least("label", "_near").alias("_new"))
        jump = labels.select("wsi", F.col("cell_id").alias("_new"), F.col("label").alias("_far"))
        labels = stored(near.join(jump, ["wsi", "_new"]).select("wsi", "cell_id", "_old", F.least("_new", "_far").alias("label")), "labels")
        if not labels.filter(F.col("label") != F.col("_old")).limit(1).count():
            return labels.select("wsi", "cell_id", F.col("label").alias("component"))
        labels = labels.drop("_old")


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """wsi, cell_id, root of rows that come by bin and xmin: root is the smallest id of those that a row touches, directly or not, within its bin and batch.

    Rows of a bin that later ones may reach are taken along to the next batch and given again, with the root that they have there.
    """
    carried = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = (t if carried is None else pa.concat_tables([carried, t])).combine_chunks()
        carried, n = None, t.num_rows
        if not n:
            continue
        flat = lambda c: t[c].combine_chunks()
        boxes = np.column_stack([flat(c).to_numpy() for c in ("_xmin", "_ymin", "_xmax", "_ymax")])
        rings = flat("ring")
        rings = rings.chunk(0) if isinstance(rings, pa.ChunkedArray) else rings
        at, points = rings.offsets.to_numpy(), rings.values
        xs, ys = (points.field(c).to_numpy(zero_copy_only=False) for c in "xy")
        order = pc.sort_indices(t["cell_id"]).to_numpy()
        place = np.empty(n, int)
        place[order] = np.arange(n)
        new = np.zeros(n, bool)
        new[0] = True
        for c in ("wsi", "_bx", "_by"):
            codes = flat(c).dictionary_encode().indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        starts = np.flatnonzero(new)

        def ring_of(i: int, at=at, xs=xs, ys=ys) -> np.ndarray:
            return polygons.as_points(np.column_stack([xs[at[i] : at[i + 1]], ys[at[i] : at[i + 1]]]))

        upright = polygons.upright_boxes(at, xs, ys)
        root = np.empty(n, int)
        for first, last in zip(starts, [*starts[1:], n], strict=True):
            labels = polygons.touching_labels(boxes[first:last], upright[first:last], lambda i, first=first: ring_of(first + i))
            least = np.full(last - first, n)
            np.minimum.at(least, labels, place[first:last])
            root[first:last] = order[least[labels]]
        yield pa.RecordBatch.from_arrays([flat("wsi"), flat("cell_id"), flat("cell_id").take(pa.array(root))], ["wsi", "cell_id", "root"])
        open_ = np.zeros(n, bool)
        open_[starts[-1] :] = boxes[starts[-1] :, 2] >= boxes[-1, 0]
        carried = t.filter(pa.array(open_))


def touching_groups(shapes: DataFrame, size: float = 64.0) -> DataFrame:
    """wsi, cell_id, component of polygons (wsi, cell_id, ring): the smallest id of those that touch, directly or not.

    A bin of the grid is walked along x, and each of its polygons gets the smallest id that it is joined with there. So pairs are not kept, however densely
    polygons lie: what is linked are the groups of bins, by the polygons that lie in several.
    """
    boxed = shapes.select("wsi", "cell_id", "ring", bbox(F.col("ring")).alias("_box"))
    b = lambda c: F.floor(F.col(f"_box.{c}") / size)
    binned = boxed.withColumn("_bx", F.explode(F.sequence(b("xmin"), b("xmax")))).withColumn("_by", F.explode(F.sequence(b("ymin"), b("ymax"))))
    tasks = tasks_for(shapes.sparkSession, shapes.count(), POLYGONS)
    dealt = binned.select("wsi", "cell_id", "ring", "_bx", "_by", *[F.col(f"_box.{c}").alias(f"_{c}") for c in ("xmin", "ymin", "xmax", "ymax")])
    dealt = dealt.filter(F.col("wsi").isNotNull() & F.col("cell_id").isNotNull()).repartition(tasks, "wsi", "_bx", "_by").sortWithinPartitions("wsi", "_bx", "_by", "_xmin")
    kinds = dict(shapes.select("wsi", "cell_id").dtypes)
    rooted = dealt.mapInArrow(_roots, f"wsi {kinds['wsi']}, cell_id {kinds['cell_id']}, root {kinds['cell_id']}")
    own = stored(rooted.groupBy("wsi", "cell_id").agg(F.min("root").alias("root"), F.collect_set("root").alias("roots")), "roots")
    links = own.filter(F.size("roots") > 1).select("wsi", F.col("root").alias("a"), F.explode("roots").alias("b")).filter("a <> b").distinct()
    links = stored(links, "root-links")
    ends = links.select("wsi", F.col("a").alias("cell_id")).union(links.select("wsi", F.col("b").alias("cell_id"))).distinct()
    labels = connected_labels(ends, links).select("wsi", F.col("cell_id").alias("root"), "component")
    found = own.select("wsi", "cell_id", "root").join(labels, ["wsi", "root"], "left").select("wsi", "cell_id", F.coalesce("component", "root").alias("component"))
    return shapes.select("wsi", "cell_id").distinct().join(found, ["wsi", "cell_id"], "left").select("wsi", "cell_id", F.coalesce("component", "cell_id").alias("component"))


def merge_touching(shapes: DataFrame) -> DataFrame:
    """wsi, component, members, rings: groups of polygons that touch, as multi-polygons of their members. Rings are gathered only where they are read."""
    rows = shapes.join(touching_groups(shapes), ["wsi", "cell_id"]).groupBy("wsi", "component")
    by_id = F.array_sort(F.collect_list(F.struct("cell_id", "ring")))
    return rows.agg(F.array_sort(F.collect_list("cell_id")).alias("members"), F.transform(by_id, lambda m: m["ring"]).alias("rings"))


def merged_shapes(shapes: DataFrame, tile: float = 256.0, fan: int = 64) -> DataFrame:
    """wsi, component, n_members, shape: the union of each group of polygons (wsi, cell_id, ring) that touch.

    A union is made of unions: at most fan members of a group and tile first, then what came of four times as wide tiles, until each group is one
    row. So no task holds a group's members, only the shapes that are left of them. Groups that are one row are done; later rounds have the others only.
    """
    labels = stored(touching_groups(shapes), "groups")
    box = bbox(F.col("ring"))
    place = lambda c: F.coalesce(box[c], F.lit(0.0))  # noqa: E731  no ring, no place
    rows = shapes.join(labels, ["wsi", "cell_id"]).select("wsi", "component", F.lit(1).cast("long").alias("n_members"), overlay.as_shape(F.col("ring")).alias("shape"), place("xmin").alias("x"), place("ymin").alias("y"), F.xxhash64("cell_id").alias("salt"))
    done = []
    while True:
        at = lambda c: F.floor(F.col(c) / tile + 0.5)  # noqa: B023, E731  the middle tile holds both sides of 0
        rows = rows.withColumns({"_tx": at("x"), "_ty": at("y")})
        keys = ["wsi", "component", "_tx", "_ty"]
        sizes = rows.groupBy(*keys).agg(F.count("*").alias("_size"))
        dealt = rows.join(sizes, keys).groupBy(*keys, F.pmod("salt", F.ceil(F.col("_size") / fan)).alias("_part"))
        merged = dealt.agg(F.sum("n_members").alias("n_members"), F.collect_list("shape").alias("_shapes"), F.min("x").alias("x"), F.min("y").alias("y"), F.min("salt").alias("salt"))
        merged = stored(merged.select("wsi", "component", "n_members", overlay.union_shapes(F.col("_shapes")).alias("shape"), "x", "y", "salt"), "merged")
        several = stored(merged.groupBy("wsi", "component").count().filter("count > 1").select("wsi", "component"), "open-groups")
        if not several.limit(1).count():
            return reduce(DataFrame.unionByName, [*done, merged]).select("wsi", "component", "n_members", "shape")
        done.append(merged.join(several, ["wsi", "component"], "left_anti"))
        rows = stored(merged.join(several, ["wsi", "component"], "left_semi"), "open-shapes")
        tile *= 4


def broadcast_offsets(members: DataFrame, matches: DataFrame) -> DataFrame:
    """The offset of a merged group for each of its members (wsi, cell_id, component), and matched."""
    found = matches.select("wsi", F.col("cell_id").alias("component"), "dx", "dy")
    return members.join(found, ["wsi", "component"], "left").select("wsi", "cell_id", "dx", "dy", F.col("dx").isNotNull().alias("matched"))


def tile_groups(cells: DataFrame, width, height, size: int = 224, core: int = 112) -> DataFrame:
    """wsi, patch_x, patch_y, cells: each cell in the one core that holds it, with its place in the tile around the core, shifted inside the slide."""
    margin = (size - core) // 2
    at = lambda v, w: F.greatest(F.lit(0), F.least(F.floor(v / core) * core - margin, F.lit(w) - size if not isinstance(w, Column) else w - size))
    rows = cells.withColumns({"_cx": F.floor(F.col("x") / core), "_cy": F.floor(F.col("y") / core), "patch_x": at(F.col("x"), width), "patch_y": at(F.col("y"), height)})
    one = F.struct("cell_id", "cell_type", (F.col("x") - F.col("patch_x")).alias("rel_x"), (F.col("y") - F.col("patch_y")).alias("rel_y"))
    return rows.groupBy("wsi", "_cx", "_cy", "patch_x", "patch_y").agg(F.array_sort(F.collect_list(one)).alias("cells")).drop("_cx", "_cy")


def expand_tiles(slides: DataFrame, size: int, stride: int, edge: bool = True) -> DataFrame:
    """slides (wsi, width, height) with x0, y0 of each tile of a grid: whole tiles every stride, and with edge one more at the far side where the grid leaves a rest. Slides smaller than a tile have none."""

    def starts(extent: Column) -> Column:
        last = extent - size
        whole = F.sequence(F.lit(0).cast("long"), last, F.lit(stride).cast("long"))
        rest = F.when((last % stride > 0) & F.lit(edge), F.array(last)).otherwise(F.array().cast("array<bigint>"))
        return F.when(last >= 0, F.concat(whole, rest)).otherwise(F.array().cast("array<bigint>"))

    return slides.withColumn("x0", F.explode(starts(F.col("width").cast("long")))).withColumn("y0", F.explode(starts(F.col("height").cast("long"))))


def cells_on_bad_tiles(cells: DataFrame, bad_tiles: DataFrame, tile: int, crop: int) -> DataFrame:
    """Cells (wsi, cell_id, x0, y0 of their crop) whose crop meets a bad tile (wsi, col, row)."""
    span = lambda c: F.sequence(F.floor(F.col(c) / tile), F.floor((F.col(c) + crop - 1) / tile))
    spread = cells.withColumn("col", F.explode(span("x0"))).withColumn("row", F.explode(span("y0")))
    return spread.join(bad_tiles.select("wsi", F.col("col").cast("long"), F.col("row").cast("long")), ["wsi", "col", "row"], "left_semi").select("wsi", "cell_id").distinct()


def cells_in_window(cells: DataFrame, x0: float, y0: float, size: float) -> DataFrame:
    """Half-open rectangle."""
    return cells.filter((F.col("x") >= x0) & (F.col("x") < x0 + size) & (F.col("y") >= y0) & (F.col("y") < y0 + size))
