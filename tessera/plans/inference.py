"""Queries of statistical tests, resampling and draws with their p values, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import epochs, sampling, stats
from tessera.plans import domain as d
from tessera.plans.domain import CELLS
from tessera.plans.queries import _XY, _xy, query, rounded

#: Student's two-sided tail of a correlation in closed form: a sum over half the degrees of freedom, of which sin is the correlation and cos its complement.
_TAIL = """CASE WHEN nu % 2 = 0 THEN 1 - abs(r) * list_sum(list_transform(range(CAST(nu / 2 AS BIGINT)), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1.0) - lgamma(0.5)) * power(1 - r * r, k)))
  ELSE 1 - 2 / pi() * (asin(abs(r)) + abs(r) * coalesce(list_sum(list_transform(range(CAST((nu - 1) / 2 AS BIGINT)), lambda k: exp(lgamma(k + 1.0) + lgamma(1.5) - lgamma(k + 1.5)) * power(1 - r * r, k + 0.5))), 0)) END"""

_BOTH = _XY + f""", k AS (SELECT *, rank() OVER (PARTITION BY wsi ORDER BY x) + (count(*) OVER (PARTITION BY wsi, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY wsi ORDER BY y) + (count(*) OVER (PARTITION BY wsi, y) - 1) / 2.0 AS ry FROM xy),
c AS (SELECT wsi, count(*) AS n, corr(x, y) AS r, corr(rx, ry) AS rho FROM k GROUP BY wsi),
p AS (SELECT a.*, b.p AS rho_p FROM (SELECT wsi, n, r, rho, {_TAIL} AS r_p FROM (SELECT *, n - 2 AS nu FROM c)) a JOIN (SELECT wsi, {_TAIL} AS p FROM (SELECT wsi, n - 2 AS nu, rho AS r FROM c)) b USING (wsi))"""


@query(_BOTH + " SELECT wsi, n, round(r, 6) AS r, round(rho, 6) AS rho, round(r_p, 7) AS r_p, round(rho_p, 7) AS rho_p FROM p")
def x1_x2_p_values_by_slide(spark, sf_dir):
    found = rounded(stats.correlations_by_group(_xy(spark, sf_dir), "x", "y"), "r", "rho")
    return found.withColumns({c: F.round(c, 7) for c in ("r_p", "rho_p")})


@query(_BOTH + " SELECT count(*) AS n_groups, round(avg(r), 6) AS mean_r, round(stddev_samp(r), 6) AS std_r, round(avg(rho), 6) AS mean_rho, round(stddev_samp(rho), 6) AS std_rho FROM p")
def x2_spread_over_slides(spark, sf_dir):
    found = stats.spread_over_groups(stats.correlations_by_group(_xy(spark, sf_dir), "x", "y"), "r", "rho")
    return rounded(found, "mean_r", "std_r", "mean_rho", "std_rho")


#: Counts of U for samples of a and b rows: the largest rank belongs to either sample. The normal tail is one half less Simpson's sum.
_COUNTS = """counts AS (SELECT 0 AS a, 0 AS b, 0 AS u, CAST(1 AS DOUBLE) AS c UNION ALL
  SELECT a, b, u, sum(c) FROM (SELECT a + 1 AS a, b, u + b AS u, c FROM counts WHERE a < 8 UNION ALL SELECT a, b + 1, u, c FROM counts WHERE b < 24) GROUP BY a, b, u)"""
_NORMAL = "0.5 - z / 1200 / sqrt(2 * pi()) * list_sum(list_transform(range(401), lambda i: CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-power(z * i / 400, 2) / 2)))"


@query(f"""WITH RECURSIVE {_COUNTS}, xy AS (SELECT o_custkey AS cust, o_totalprice AS x, o_orderkey % 8 < 4 AS a FROM orders), k AS (SELECT *, rank() OVER (PARTITION BY cust ORDER BY x) + (count(*) OVER (PARTITION BY cust, x) - 1) / 2.0 AS rx, count(*) OVER (PARTITION BY cust, x) AS t FROM xy),
s AS (SELECT cust, count(*) FILTER (a) AS n_a, count(*) FILTER (NOT a) AS n_b, sum(rx) FILTER (a) AS rs, sum(t * t - 1) AS ties FROM k GROUP BY cust),
m AS (SELECT *, rs - n_a * (n_a + 1) / 2 AS u, n_a + n_b AS n FROM s WHERE n_a > 0 AND n_b > 0),
z AS (SELECT *, (u - n_a * n_b / 2 - 0.5) / sqrt(n_a * n_b / 12 * ((n + 1) - ties / (n * (n - 1)))) AS z, ties = 0 AND least(n_a, n_b) <= 8 AS exact FROM m)
SELECT cust, n_a, n_b, u, round(z, 6) AS z, exact, round(CASE WHEN exact THEN (SELECT sum(c) FILTER (counts.u >= z.u) / sum(c) FROM counts WHERE counts.a = least(n_a, n_b) AND counts.b = greatest(n_a, n_b)) ELSE {_NORMAL} END, 8) AS p_value FROM z""")
def x8_exact_rank_sums(spark, sf_dir):
    """The orders of each customer, of two halves of the keys."""
    half = F.col("o_orderkey") % 8 < 4
    rows = d.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cust"), F.col("o_totalprice").alias("x"), half.alias("a"), (~half).alias("b"))
    return stats.mann_whitney(rows, "x", "a", "b", ["cust"]).withColumns({"z": F.round("z", 6), "p_value": F.round("p_value", 8)})


@query(_XY + f""", m AS (SELECT *, key % 4 = 0 AS a FROM xy WHERE key % 4 < 2), k AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, count(*) OVER (PARTITION BY x) AS t FROM m),
s AS (SELECT count(*) FILTER (a) AS n_a, count(*) FILTER (NOT a) AS n_b, sum(rx) FILTER (a) AS rs, sum(t * t - 1) AS ties FROM k), u AS (SELECT *, rs - n_a * (n_a + 1) / 2 AS u, n_a + n_b AS n FROM s),
z AS (SELECT *, (u - n_a * n_b / 2 - 0.5) / sqrt(n_a * n_b / 12 * ((n + 1) - ties / (n * (n - 1)))) AS z FROM u) SELECT n_a, n_b, round(u, 3) AS u, round(z, 6) AS z, round({_NORMAL}, 8) AS p_value FROM z""")
def x8_rank_sum_p(spark, sf_dir):
    rows = _xy(spark, sf_dir).withColumns({"a": F.col("key") % 4 == 0, "b": F.col("key") % 4 == 1})
    found = stats.mann_whitney(rows, "x", "a", "b").drop("exact")
    return found.withColumns({"u": F.round("u", 3), "z": F.round("z", 6), "p_value": F.round("p_value", 8)})


@query()
def x6_bootstrap_rho(spark, sf_dir):
    """2,000 draws of slides."""
    return stats.cluster_bootstrap_spearman(_xy(spark, sf_dir), "x", "y", stats.bootstrap_draws(spark, [f"s{i}" for i in range(7)], 2000))


@query()
def x9_drift_vs_scores(spark, sf_dir):
    """2,000 permutations a score; the second score turned round."""
    rows = _xy(spark, sf_dir).withColumn("late", F.col("key") % 1000)
    return stats.drift_vs_scores(rows, "x", {"y": 1, "late": -1}, "key")


@query(f"WITH {CELLS} SELECT wsi, (SELECT max(n) FROM (SELECT count(*) AS n FROM cells GROUP BY wsi)) AS n FROM cells GROUP BY wsi")
def m8_equalised_slides(spark, sf_dir):
    """Rows of each slide after it is drawn up to the size of the largest."""
    return sampling.equalised(d.cells(spark, sf_dir), "wsi", 0, "cell_id").groupBy("wsi").agg(F.count("*").alias("n"))


@query(f"""WITH {CELLS}, w AS (SELECT cell_type, count(*) AS n_rows FROM cells GROUP BY cell_type) SELECT (SELECT count(*) FROM cells) AS n_drawn, 0 AS n_strangers, true AS all_within, count(*) AS n_types FROM w""")
def m8_weighted_draws(spark, sf_dir):
    """As many draws as cells, each type as likely: their number, draws of rows that aren't there, and whether every type's share lies within five deviations of its expectation."""
    cells = d.cells(spark, sf_dir)
    types = cells.groupBy("cell_type").agg(F.count("*").alias("n_rows"))  # a row a type
    rows = cells.join(F.broadcast(types), "cell_type").withColumn("weight", 1.0 / F.col("n_rows"))
    n = rows.count()
    drawn = sampling.oversample(rows, "weight", n, 0, "cell_id")
    strangers = drawn.join(cells, "cell_id", "left_anti").count()
    share = drawn.groupBy("cell_type").agg(F.count("*").alias("k"))
    whole = types.join(share, "cell_type", "left").agg(F.sum("k").alias("n_drawn"), F.count("*").alias("n_types"), F.max(F.abs(F.coalesce("k", F.lit(0)))).alias("_max"), F.min(F.coalesce("k", F.lit(0))).alias("_min"))
    p = 1.0 / F.col("n_types")
    far = 5 * F.sqrt(F.lit(n) * p * (1 - p))
    within = (F.col("_max") - n * p <= far) & (n * p - F.col("_min") <= far)
    return whole.select("n_drawn", F.lit(strangers).alias("n_strangers"), within.alias("all_within"), "n_types")


@query()
def e4_e5_epochs(spark, sf_dir):
    """A linear and a hidden head, 30 epochs, rows weighted against their label's share; how often each is right by label."""
    rows = d.embeddings(spark, sf_dir)
    labels = sorted(r["label"] for r in rows.select("label").distinct().collect())  # a row a label
    sizes = rows.groupBy("label").agg(F.count("*").alias("size"))
    coded = rows.join(F.broadcast(sizes), "label").withColumn("code", F.array_position(F.array(*map(F.lit, labels)), F.col("label")) - 1).withColumn("weight", F.lit(1.0) / F.col("size"))
    mean = coded.agg(F.avg("weight")).first()[0]
    coded = coded.withColumn("weight", F.col("weight") / mean)
    out = None
    heads = epochs.train_heads(coded, len(labels), ["cell_id"], [[], [32]], "vector", weight="weight")
    for name, head in zip(("linear", "hidden"), heads, strict=True):
        found = epochs.predict(head, rows, labels, "vector").groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("predicted_label")).alias("right"), F.round(F.avg("prob"), 4).alias("mean_prob"))
        one = found.select(F.lit(name).alias("head"), "label", "n", "right", "mean_prob", F.lit(round(head.losses[-1], 4)).alias("loss"))
        out = one if out is None else out.unionByName(one)
    return out
