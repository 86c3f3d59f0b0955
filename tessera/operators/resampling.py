"""Permutations and bootstraps of rank statistics whose shuffles don't grow with the number of permutations or draws."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.tables import average_rank
from tessera.sources.storage import stored

#: Rows of a group whose ranks are one array. A larger group has several, each of which is sent to each other; each row is still permuted once a permutation.
BLOCK = 1_000_000
#: Rows up to which a permutation is one bijection. A larger group's has the segments of at most so many rows change places, and the rows within each.
SEGMENT = 65_536
#: Pairs of a group's blocks and parts of its permutations that there are at least.
PARTS = 8
#: Rounds of the Feistel network; places that it works out at once.
ROUNDS, HELD = 6, 15_000
#: Slides (clusters) up to which a rank bootstrap keeps its sums: they are a cube of this side.
MAX_SLIDES = 100


def known(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose columns are neither null nor NaN."""
    for c in columns:
        df = df.filter(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    return df


# ---- permutations


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _network(x: np.ndarray, rounds: list[np.ndarray], half: int, kind: type) -> np.ndarray:
    low, bits = kind((1 << half) - 1), kind(np.iinfo(kind).bits // 2)
    factor, half = kind(0x9E3779B97F4A7C15 >> (64 - np.iinfo(kind).bits) | 1), kind(half)
    left, right = x >> half, x & low
    mixed, high = np.empty_like(left), np.empty_like(left)
    for key in rounds:  # in place, which keeps the arrays in the cache
        np.add(right, key, out=mixed)
        np.multiply(mixed, factor, out=mixed)
        np.right_shift(mixed, bits, out=high)
        np.bitwise_xor(mixed, high, out=mixed)
        np.bitwise_and(mixed, low, out=mixed)
        np.bitwise_xor(left, mixed, out=left)
        left, right = right, left
    left <<= half
    left |= right
    return left


def bijection(at: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    """Where each key's permutation of 0 ... n - 1 sends each of at, a row a key: a Feistel network on a power of 4 (256 at least), walked again until it falls below n.

    It counts in 32 bits where they hold n, which is faster; so an n has one network.
    """
    half = max(4, ((n - 1).bit_length() + 1) // 2)  # smaller networks favour some permutations
    kind = np.uint32 if half <= 16 else np.uint64
    with np.errstate(over="ignore"):
        rounds = _mix(np.asarray(keys, np.uint64)[:, None] + np.uint64(0x9E3779B97F4A7C15) * np.arange(1, ROUNDS + 1, dtype=np.uint64)).astype(kind)
        x = np.broadcast_to(np.asarray(at, kind), (len(rounds), len(at)))
        out = _network(x, [rounds[:, r, None] for r in range(ROUNDS)], half, kind).ravel()
        todo = np.flatnonzero(out >= n)
        while len(todo):
            x = _network(out[todo], list(rounds[todo // len(at)].T), half, kind)
            out[todo] = x
            todo = todo[x >= n]
    return out.astype(np.int64).reshape(len(rounds), len(at))


def permutation_keys(seed: int, group_hash: int, permutations: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        own = _mix(_mix(np.array([seed & 0xFFFFFFFFFFFFFFFF], np.uint64) + np.uint64(1)) ^ np.array([group_hash & 0xFFFFFFFFFFFFFFFF], np.uint64))
        return own + _mix(np.asarray(permutations, np.uint64) + np.uint64(7))


def _shuffled(n: int, keys: np.ndarray) -> np.ndarray:
    """Each key's permutation of a few numbers, by sorting; a network would be walked for long."""
    with np.errstate(over="ignore"):
        return np.argsort(_mix(keys[:, None] + np.uint64(0x9E3779B97F4A7C15) * np.arange(1, n + 1, dtype=np.uint64)), axis=1)


def segments(n: int, at_most: int) -> tuple[int, int]:
    """(number, rows) of equal segments of at most so many rows; under number rows are left."""
    number = -(-n // at_most)
    return number, n // number


def _moves(x_at: int, x_end: int, y_at: int, y_end: int, n: int, group: int, seed: int, permutation: np.ndarray, at_most: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, which of the permutations, rows that they are sent to) of rows x_at to x_end whose segment is sent to one that meets y_at to y_end.

    The permutations are those that move whole segments and rows within them: a group of permutations, so the test by them is exact as well. Rows stand in the order of a hash,
    so a segment is a sample of its group. The rows left over are a segment that stays.
    """
    number, size = segments(n, at_most)
    if number == 1:
        yield x_at, permutation, bijection(np.arange(x_at, x_end), n, permutation_keys(seed, group, permutation))
        return
    places = _shuffled(number, permutation_keys(seed, group, permutation))
    for s in range(x_at // size, min(-(-x_end // size), number + 1)):
        first, last = max(x_at, s * size), min(x_end, n if s == number else (s + 1) * size)
        own = size if s < number else n - number * size
        for p, place in zip(permutation, places[:, s] if s < number else np.full(len(permutation), number), strict=True):
            start = int(place) * size
            if start < y_end and start + own > y_at and first < last:
                keys = permutation_keys(seed, group ^ (0x632BE59BD9B4E019 * (int(place) + 1)), np.array([p]))
                for row in range(first, last, HELD):
                    rows = np.arange(row, min(row + HELD, last)) - s * size
                    yield row, np.array([p]), (bijection(rows, own, keys) if own >= 256 else _shuffled(own, keys)[:, rows]) + start


def _products(n_perm: int, seed: int, at_most: int):
    """(permutation, sum of rank products) of pairs of blocks: x ranks from row x_at on, y ranks from y_at on, of a group of n rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n_perm)
        seen = False
        for batch in batches:
            for i in range(batch.num_rows):
                seen = True
                value = lambda c: batch.column(c)[i]  # noqa: B023, E731
                x, y = value("xs").values.to_numpy(False), value("ys").values.to_numpy(False)
                n, x_at, y_at, group, part, parts = (value(c).as_py() for c in ("n", "x_at", "y_at", "group_hash", "part", "parts"))
                own = np.arange(part, n_perm, parts)
                step = max(1, HELD // len(x))
                for some in (own[k : k + step] for k in range(0, len(own), step)):
                    for first, which, to in _moves(x_at, x_at + len(x), y_at, y_at + len(y), n, group, seed, some, at_most):
                        to -= y_at
                        inside = len(y) == n or (to.min() >= 0 and to.max() < len(y))
                        met = y[to] if inside else np.where((to >= 0) & (to < len(y)), y[np.clip(to, 0, len(y) - 1)], 0.0)
                        sums[which] += np.einsum("ij,j->i", met, x[first - x_at : first - x_at + to.shape[1]])  # no BLAS: its threads would wait for those of other tasks
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(n_perm), pa.int32()), pa.array(sums)], ["permutation", "xy"])

    return run


def numbered(rows: DataFrame, group: str, key: str, block: int = BLOCK) -> DataFrame:
    """rows with _n (rows of the group), _block, _start (rows of the group in earlier blocks) and _at (place within the block).

    Rows are dealt to blocks by a hash of the key and numbered within them by another, so that no group is sorted in one task and rows stand in no order that means anything.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"))
    dealt = rows.join(sizes, group).withColumn("_block", F.pmod(F.xxhash64(F.lit(17), key), F.ceil(F.col("_n") / block)).cast("int"))
    blocks = dealt.groupBy(group, "_block").agg(F.count("*").alias("_size"))
    starts = blocks.withColumn("_start", F.sum("_size").over(Window.partitionBy(group).orderBy("_block")) - F.col("_size")).drop("_size")  # a row a block
    return dealt.join(starts, [group, "_block"]).withColumn("_at", F.row_number().over(Window.partitionBy(group, "_block").orderBy(F.xxhash64(F.lit(29), key), key)) - 1)


def block_permutation_spearman(df: DataFrame, x: str, y: str, key: str, group: str = "wsi", n_perm: int = 2000, seed: int = 0, block: int = BLOCK, segment: int = SEGMENT) -> DataFrame:
    """rho, p_value, n: y's ranks are shuffled inside each group n_perm times; p = (exceedances + 1) / (n_perm + 1).

    A permutation is a bijection of row numbers under a key of its own, so none is drawn, sorted or shuffled: each block of a group's x ranks
    meets each block of its y ranks, in tasks that walk their permutations over the two arrays. Rows with a null or NaN x or y or a null group have no part.
    Rows that share a key are numbered in any order; keys should tell rows apart.
    """
    ranked = average_rank(average_rank(known(df, x, y).filter(F.col(group).isNotNull()), x, None, "_rx"), y, None, "_ry").select(F.col(group).alias("_g"), F.col(key).alias("_k"), "_rx", "_ry")
    ranked = stored(ranked, "ranks")
    total = ranked.agg(F.count("*").alias("n"), F.avg("_rx").alias("_mx"), F.avg("_ry").alias("_my"), F.stddev_pop("_rx").alias("_sx"), F.stddev_pop("_ry").alias("_sy"), F.corr("_rx", "_ry").alias("rho"))
    sorted_ranks = F.array_sort(F.collect_list(F.struct("_at", "_rx", "_ry")))
    arrays = numbered(ranked, "_g", "_k", block).groupBy("_g", "_block", "_n", "_start").agg(sorted_ranks.alias("_rows"))  # about block rows each
    arrays = stored(arrays.select("_g", "_block", "_n", "_start", F.transform("_rows", lambda r: r["_rx"]).alias("xs"), F.transform("_rows", lambda r: r["_ry"]).alias("ys")), "rank-blocks")
    xs = arrays.select("_g", F.col("_block").alias("_bx"), F.col("_n").alias("n"), F.col("_start").alias("x_at"), "xs")
    ys = arrays.select("_g", F.col("_block").alias("_by"), F.col("_start").alias("y_at"), "ys")
    blocks = F.ceil(F.col("n") / block)
    pairs = xs.join(ys, "_g").withColumn("parts", F.ceil(F.lit(PARTS) / (blocks * blocks)).cast("int"))
    pairs = pairs.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("group_hash", F.xxhash64("_g"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fixed number, as few rows mean much work
    pairs = pairs.repartition(tasks, "_g", "_bx", "_by", "part").select("n", "x_at", "y_at", "group_hash", "part", "parts", "xs", "ys")
    sums = pairs.mapInArrow(_products(n_perm, seed, segment), "permutation int, xy double").groupBy("permutation").agg(F.sum("xy").alias("_xy"))
    null = sums.crossJoin(F.broadcast(total)).withColumn("_r", (F.col("_xy") / F.col("n") - F.col("_mx") * F.col("_my")) / (F.col("_sx") * F.col("_sy")))  # one row
    hits = null.agg(F.count_if(F.abs("_r") >= F.abs("rho") - 1e-12).alias("_h"))
    return total.crossJoin(hits).select("rho", ((F.col("_h") + 1) / F.lit(n_perm + 1.0)).alias("p_value"), "n")


# ---- rank bootstrap


def _running(size: int):
    """(value, places): for each value of a block in order, the rows below it and half of its own, by slide. Rows come by block and value, each with the totals of the blocks before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, np.zeros(size)
        for batch in batches:
            if not batch.num_rows:
                continue
            counts, befores = (batch.column(c).flatten().to_numpy(False).reshape(-1, size) for c in ("counts", "before"))
            blocks, places = batch.column("block").to_numpy(False), np.empty((batch.num_rows, size))
            starts = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]]))
            for first, last in zip(starts, [*starts[1:], len(blocks)], strict=True):
                own = counts[first:last]
                below = held if blocks[first] == block else befores[first]
                ends = below + np.cumsum(own, axis=0)
                places[first:last] = ends - own / 2
                block, held = blocks[first], ends[-1]
            flat = pa.array(places.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("value"), pa.ListArray.from_arrays(pa.array(np.arange(0, places.size + 1, size, dtype=np.int32)), flat)], ["value", "places"])

    return run


def places_by_slide(rows: DataFrame, value: str, size: int, blocks: int = 64) -> DataFrame:
    """value, places: of each different value, how many rows of each of size slides (_slide, from 0) lie below it, and half of those that equal it.

    Values are counted first, so a frequent one is one row. They are dealt into blocks of values; the blocks' totals are added up, and a block's
    values are walked in order.
    """
    counted = rows.groupBy(F.col(value).alias("value"), "_slide").agg(F.count("*").alias("_c"))
    own = counted.groupBy("value").agg(F.map_from_entries(F.collect_list(F.struct("_slide", "_c"))).alias("_m"))  # a row a slide at most
    own = own.select("value", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0)).cast("double")).alias("counts"))
    cuts = counted.agg(F.percentile_approx("value", [i / blocks for i in range(1, blocks)], 1000).alias("_e"))
    placed = stored(own.crossJoin(F.broadcast(cuts)).withColumn("block", F.size(F.filter("_e", lambda e: e < F.col("value")))).drop("_e"), "values")  # one row
    totals = placed.select("block", F.posexplode("counts")).groupBy("block", "pos").agg(F.sum("col").alias("_t"))
    earlier = totals.withColumn("_b", F.coalesce(F.sum("_t").over(Window.partitionBy("pos").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))  # a row a block
    before = earlier.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_b"))), lambda s: s["_b"]).alias("before"))
    walked = placed.join(F.broadcast(before), "block").repartition("block").sortWithinPartitions("block", "value").select("value", "block", "counts", "before")  # a row a block
    return walked.mapInArrow(_running(size), "value double, places array<double>")


def _moments(size: int):
    """(kind, slide, s, sums over t) of the rows (_slide, a, b): sums of a_s a_t, b_s b_t, a_s b_t, and (kind 3, 4) of a_s and b_s."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cube, line = np.zeros((3, size, size, size)), np.zeros((2, size, size))
        seen = False
        for batch in batches:
            slide = batch.column("_slide").to_numpy(False)
            a, b = (batch.column(c).flatten().to_numpy(False).reshape(-1, size) for c in "ab")
            for g in np.unique(slide):
                x, y, seen = a[slide == g], b[slide == g], True
                for k, (u, v) in enumerate(((x, x), (y, y), (x, y))):
                    cube[k, g] += u.T @ v
                line[0, g] += x.sum(axis=0)
                line[1, g] += y.sum(axis=0)
        if seen:
            rows = [(k, g, s, cube[k, g, s]) for k in range(3) for g in range(size) for s in range(size)] + [(3 + k, g, 0, line[k, g]) for k in range(2) for g in range(size)]
            kinds, slides, places, sums = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(slides, pa.int32()), pa.array(places, pa.int32()), pa.array(list(sums))], ["kind", "slide", "s", "sums"])

    return run


def rank_moments(rows: DataFrame, slides: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows a slide, sums of places [2, slide, s], sums of their products [3, slide, s, t]) of rows (wsi, _x, _y): all that a bootstrap of whole slides needs of their ranks.

    A row's mid-rank in a draw is the sum over slides s of the times that s was drawn and the row's place in s, so sums of ranks and of their products are polynomials of
    the multiplicities, and no row meets a draw. What reaches the driver has the size of a cube of the slides.
    """
    size = len(slides)
    number = F.create_map(*[F.lit(v) for i, s in enumerate(slides) for v in (s, i)])
    own = stored(rows.select(number[F.col("wsi")].alias("_slide"), "_x", "_y"), "slides")
    both = own.join(places_by_slide(own, "_x", size).select(F.col("value").alias("_x"), F.col("places").alias("a")), "_x")
    both = both.join(places_by_slide(own, "_y", size).select(F.col("value").alias("_y"), F.col("places").alias("b")), "_y").select("_slide", "a", "b")
    sums = both.mapInArrow(_moments(size), "kind int, slide int, s int, sums array<double>")
    added = sums.select("kind", "slide", "s", F.posexplode("sums").alias("t", "v")).groupBy("kind", "slide", "s", "t").agg(F.sum("v").alias("v")).filter("v <> 0")
    n, line, cube = np.zeros(size), np.zeros((2, size, size)), np.zeros((3, size, size, size))
    for k, g, s, t, v in added.toPandas().itertuples(index=False):
        if k < 3:
            cube[k, g, s, t] = v
        else:
            line[k - 3, g, t] = v
    for g, c in own.groupBy("_slide").count().collect():
        n[g] = c
    return n, line, cube


def drawn_rho(n: np.ndarray, line: np.ndarray, cube: np.ndarray, w: np.ndarray) -> float | None:
    """Spearman's rho of a draw in which each slide stands w times; None where a side has one value."""
    total = n @ w
    if not total:
        return None
    mean = [w @ line[k] @ w / total for k in range(2)]
    xx, yy, xy = (np.einsum("g,s,t,gst->", w, w, w, cube[k], optimize=True) / total for k in range(3))
    spread = (xx - mean[0] ** 2) * (yy - mean[1] ** 2)
    return float((xy - mean[0] * mean[1]) / np.sqrt(spread)) if min(xx - mean[0] ** 2, yy - mean[1] ** 2) > 1e-9 * max(xx, 1) else None


def rhos_of_draws(rows: DataFrame, draws: DataFrame, slides: list[str]) -> DataFrame:
    """multiset, times, _r of each draw with a rho; draws are dealt to tasks."""
    n, line, cube = rank_moments(rows, slides)
    place = {s: i for i, s in enumerate(slides)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for m, t, own in zip(*(batch.column(c).to_pylist() for c in ("multiset", "times", "own")), strict=True):
                w = np.zeros(len(place))
                for s in own:
                    if s["wsi"] in place:
                        w[place[s["wsi"]]] = s["multiplicity"]
                found.append((m, t, drawn_rho(n, line, cube, w)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.int32(), pa.int32(), pa.float64()), strict=True)], ["multiset", "times", "_r"])

    whole = draws.groupBy("multiset", "times").agg(F.collect_list(F.struct("wsi", "multiplicity")).alias("own"))  # a row a slide at most
    return whole.mapInArrow(run, "multiset int, times int, _r double").filter(F.col("_r").isNotNull())
