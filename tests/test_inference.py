"""p values, permutations, bootstraps and draws against brute force."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import pvalues
from tessera.operators import expression, resampling, sampling, stats


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_correlation_p_is_students(spark):
    rows = [(r, n) for n in (3, 4, 5, 10, 51, 1000) for r in (-1.0, -0.9, -0.2, 0.0, 1e-6, 0.31, 0.999)]
    got = values(spark, rows, "r double, n long", "r", "n", pvalues.correlation_p(F.col("r"), F.col("n")))
    for r, n, p in got:
        steps = 200_000  # the density of a correlation, integrated beyond |r|
        t = np.linspace(math.asin(min(1.0, abs(r))), math.pi / 2, steps + 1)
        mid = (t[1:] + t[:-1]) / 2
        tail = (np.cos(mid) ** (n - 3)).sum() * (t[1] - t[0]) if abs(r) < 1 else 0.0
        whole = math.sqrt(math.pi) * math.exp(math.lgamma((n - 2) / 2) - math.lgamma((n - 1) / 2))
        assert math.isclose(p, 2 * tail / whole, rel_tol=1e-6, abs_tol=1e-12), (r, n, p)
    assert math.isnan(values(spark, [(0.5, 2)], "r double, n long", pvalues.correlation_p(F.col("r"), F.col("n")))[0][0])


def test_normal_tail_and_its_inverse(spark):
    rows = [(z,) for z in (-9.0, -2.0, -0.3, 0.0, 0.5, 1.9999, 2.0, 3.0, 8.0, 30.0)]
    for z, p in values(spark, rows, "z double", "z", pvalues.normal_tail(F.col("z"))):
        assert math.isclose(p, 0.5 * math.erfc(z / math.sqrt(2)), rel_tol=1e-9)
    rows = [(p,) for p in (0.5, 0.4999, 0.3, 0.01, 1e-10, 1e-150, 1e-300)]
    for p, z in values(spark, rows, "p double", "p", pvalues.normal_upper(F.col("p"))):
        assert math.isclose(0.5 * math.erfc(z / math.sqrt(2)), p, rel_tol=1e-7), (p, z)


def test_rank_sum_counts_are_those_of_all_choices():
    for a, b in ((1, 1), (2, 3), (3, 3), (4, 2)):
        want = Counter(sum(c) - a * (a + 1) // 2 for c in itertools.combinations(range(1, a + b + 1), a))
        assert list(pvalues.rank_sum_counts(a, b)) == [want[u] for u in range(a * b + 1)]


def test_rank_sum_p_exact_or_normal(spark):
    rows = [("e", v, i < 3) for i, v in enumerate([5.0, 9.0, 2.0, 1.0, 3.0, 4.0, 6.0])] + [("t", v, i < 3) for i, v in enumerate([1.0, 1.0, 2.0, 3.0, 1.0])] + [("one", 1.0, True)]
    df = spark.createDataFrame(rows, "g string, v double, a boolean").withColumn("b", ~F.col("a"))
    got = {r["g"]: r for r in stats.mann_whitney(df, "v", "a", "b", ["g"]).collect()}
    values_e = [v for g, v, _ in rows if g == "e"]
    u = lambda chosen: sum(x > y for x in chosen for y in values_e if y not in chosen)
    seen = u([5.0, 9.0, 2.0])
    assert set(got) == {"e", "t"} and got["e"]["exact"] and not got["t"]["exact"] and got["e"]["u"] == seen
    assert math.isclose(got["e"]["p_value"], sum(u(c) >= seen for c in itertools.combinations(values_e, 3)) / 35)
    assert math.isclose(got["t"]["p_value"], 0.5 * math.erfc(got["t"]["z"] / math.sqrt(2)), rel_tol=1e-9)


# ---- permutations


def test_bijections_are_permutations_of_every_kind():
    for n in (1, 2, 3, 5, 17, 300):
        assert all(sorted(r) == list(range(n)) for r in resampling.bijection(np.arange(n), n, np.arange(5)))
    seen = Counter(map(tuple, resampling.bijection(np.arange(4), 4, resampling.permutation_keys(3, 11, np.arange(24_000))).tolist()))
    assert len(seen) == 24 and sum((c - 1000) ** 2 / 1000 for c in seen.values()) < 60  # chi-square of 23 degrees


@pytest.mark.parametrize("block", [7, 1000])
def test_permutation_p_is_brute_force(spark, block):
    rng = random.Random(4)
    rows = [(f"s{i % 3}", i, float(rng.randrange(12)), float(rng.randrange(9)) + i / 40) for i in range(90)] + [("s0", 900, None, 1.0), (None, 901, 1.0, 1.0), ("s1", 902, float("nan"), 2.0)]
    df = spark.createDataFrame(rows, "wsi string, key long, x double, y double")
    n_perm = 60
    got = stats.block_permutation_spearman(df, "x", "y", "key", n_perm=n_perm, block=block).first()
    good = pd.DataFrame([r for r in rows[:90]], columns=["wsi", "key", "x", "y"])
    good["rx"], good["ry"] = good.x.rank(), good.y.rank()
    place = {(r["_g"], r["_k"]): (r["_start"] + r["_at"], r["_n"]) for r in resampling.numbered(df.filter("key < 90").select(F.col("wsi").alias("_g"), F.col("key").alias("_k")), "_g", "_k", block).collect()}
    hashes = {r[0]: r[1] for r in df.filter("wsi IS NOT NULL").select("wsi", F.xxhash64("wsi")).distinct().collect()}
    good["at"] = [place[g, k][0] for g, k in zip(good.wsi, good.key, strict=True)]
    rho, hits = np.corrcoef(good.rx, good.ry)[0, 1], 0
    for p in range(n_perm):
        moved = good.ry.copy()
        for g, own in good.groupby("wsi"):
            assert sorted(own["at"]) == list(range(len(own)))
            to = resampling.bijection(own["at"].to_numpy(), len(own), resampling.permutation_keys(0, hashes[g], np.array([p])))[0]
            moved[own.index] = own.set_index("at").ry[to].to_numpy()
        hits += abs(np.corrcoef(good.rx, moved)[0, 1]) >= abs(rho) - 1e-12
    assert got["n"] == 90 and math.isclose(got["rho"], rho, rel_tol=1e-9) and math.isclose(got["p_value"], (hits + 1) / (n_perm + 1))


def test_drift_report_counts_slides_of_the_pooled_sign(spark):
    rows = [(f"s{i % 4}", i, float(i % 50), float((i % 50) * (1 if i % 4 else -1) + i % 7)) for i in range(400)]
    df = spark.createDataFrame(rows, "wsi string, key long, d double, s double")
    for sign in (1, -1):
        r = stats.drift_vs_scores(df, "d", {"s": sign}, "key", n_perm=50).first()
        assert r["n_slides"] == 4 and r["n_same_sign"] == 3 and math.isclose(r["p_value"], 1 / 51) and r["rho"] * sign > 0 and r["stouffer_p"] < 0.05


# ---- bootstraps


@pytest.mark.parametrize("most", [100, 1])
def test_bootstrap_of_ranks_is_that_of_expanded_rows(spark, monkeypatch, most):
    monkeypatch.setattr(stats, "MAX_SLIDES", most)
    rng = random.Random(8)
    rows = [(f"s{i % 4}", float(rng.randrange(15)), float(rng.randrange(15)) + i % 4) for i in range(120)] + [("s1", None, 1.0), ("s4", 3.0, 3.0)]
    df = spark.createDataFrame(rows, "wsi string, x double, y double")
    draws = stats.bootstrap_draws(spark, [f"s{i}" for i in range(5)], 60, 1)
    got = stats.cluster_bootstrap_spearman(df, "x", "y", draws).first()
    frame, found = pd.DataFrame(rows, columns=["wsi", "x", "y"]).dropna(), []
    drawn = draws.toPandas()
    for (_, times), own in drawn.groupby(["multiset", "times"]):
        whole = pd.concat([frame[frame.wsi == w] for w, m in zip(own.wsi, own.multiplicity, strict=True) for _ in range(m)])
        rho = whole.x.rank().corr(whole.y.rank())
        found += [rho] * times if rho == rho else []
    assert math.isclose(got["rho"], frame.x.rank().corr(frame.y.rank()), rel_tol=1e-9) and got["n_valid"] == len(found)
    assert np.allclose([got["ci_lo"], got["ci_hi"]], np.percentile(found, [2.5, 97.5]), atol=1e-9)


# ---- draws with replacement


def test_draws_are_exactly_n_and_follow_weights(spark, monkeypatch):
    monkeypatch.setattr(sampling, "DRAW_BLOCK", 7)
    rows = [(i, w) for i, w in enumerate([1.0, 0.0, 5.0, None, 2.5, -1.0, float("nan")] + [1.0] * 30)]
    df = spark.createDataFrame(rows, "id long, w double")
    n = 20_000
    drawn = sampling.oversample(df, "w", n, 3, "id")
    got = {r["id"]: r["count"] for r in drawn.groupBy("id").count().collect()}
    total = 38.5
    assert sum(got.values()) == n and not {1, 3, 5, 6} & set(got)
    chi = sum((got.get(i, 0) - n * w / total) ** 2 / (n * w / total) for i, w in rows if w and w > 0)
    assert chi < 66  # 32 degrees of freedom, 0.9995
    assert drawn.filter("id = 2").select("draw").distinct().count() == got[2]
    again = {r["id"]: r["count"] for r in sampling.oversample(df.repartition(3), "w", n, 3, "id").groupBy("id").count().collect()}
    assert again == got  # the rows' partitions don't matter
    assert sampling.oversample(df.filter("id in (1, 3)"), "w", 5, 0, "id").count() == 0 and sampling.oversample(df.limit(0), "w", 5, 0, "id").count() == 0
    plan = drawn._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_groups_are_equalised(spark):
    rows = [("a", i) for i in range(50)] + [("b", i) for i in range(3)] + [(None, 7)]
    got = sampling.equalised(spark.createDataFrame(rows, "g string, id long"), "g", 0, "id")
    assert {r["g"]: r["count"] for r in got.groupBy("g").count().collect()} == {"a": 50, "b": 50, None: 50}
    assert set(got.columns) == {"g", "id", "draw"} and got.filter("g = 'b'").select("id").distinct().count() == 3


# ---- trends


def direct(x, y, span=0.3):
    k = max(4, min(len(x), int(np.ceil(span * len(x)))))
    out = []
    for at in x:
        d = np.abs(x - at)
        near = np.argsort(d, kind="stable")[:k]
        w = np.sqrt((1 - (d[near] / max(d[near].max(), 1e-12)) ** 3).clip(0) ** 3)
        out.append(np.linalg.lstsq(np.vander(x[near] - at, 3, increasing=True) * w[:, None], y[near] * w, rcond=None)[0][0])
    return np.array(out)


def test_trend_keeps_quadratics_and_stays_near_the_direct_fits():
    rng = np.random.default_rng(4)
    x = rng.exponential(size=400)
    assert np.allclose(expression.trend(x, 1 + 2 * x - 0.3 * x**2), 1 + 2 * x - 0.3 * x**2, atol=1e-8)
    y = np.sin(x) + 0.1 * rng.normal(size=400)
    assert np.abs(expression.trend(x, y) - direct(x, y)).max() < 0.05
    many = rng.exponential(size=40_000)
    assert len(expression.trend_vertices(np.sort(many), int(40_000 * 0.06))) <= 33  # not more for more points
    for odd in (np.ones(9), np.array([1.0, 1, 1, 1, 2]), np.arange(4.0)):
        assert np.isfinite(expression.trend(odd, odd)).all()
