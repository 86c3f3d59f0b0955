"""Training in epochs against the same run in numpy; the path of ridge penalties and its choice."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import epochs, models


@pytest.mark.parametrize("hidden", [[], [5]])
def test_epochs_are_those_of_numpy(spark, hidden):
    rng = np.random.default_rng(0)
    rows = [(f"c{i}", rng.normal(size=4).tolist(), int(i % 3), float(1 + i % 2)) for i in range(60)] + [("n", None, 1, 1.0), ("m", [0.0] * 4, None, 1.0), ("w", [1.0] * 4, 2, None)]
    df = spark.createDataFrame(rows, "id string, x array<double>, code int, w double")
    got = epochs.train_epochs(df, 3, ["id"], weight="w", epochs=2, batch_rows=16, rate=0.05, decay=0.1, hidden=hidden, seed=3)
    n_batches = 4
    batch = {r["id"]: r["b"] for r in df.select("id", epochs.batch_of(n_batches, 3, "id").alias("b")).collect()}
    head = epochs.Head.start([4, *hidden, 3], 3)
    shapes = [(w.shape, b.shape) for w, b in head.layers]
    v, m, s, t = head.vector(), 0.0, 0.0, 0

    def loss_of(v, own):
        layers, at = [], 0
        for (a, b), _ in shapes:
            layers.append((v[at : at + a * b].reshape(a, b), v[at + a * b : at + a * b + b]))
            at += a * b + b
        total = 0.0
        for _, x, c, w in own:
            h = np.array(x)
            for i, (weights, bias) in enumerate(layers):
                h = h @ weights + bias
                h = np.maximum(h, 0) if i < len(layers) - 1 else h
            total += (w or 0.0) * (np.log(np.exp(h).sum()) - h[c])
        return total / len(own)

    for epoch in range(2):
        losses = []
        for b in epochs.batch_order(n_batches, 3, epoch):
            own = [r for r in rows if r[1] is not None and r[2] is not None and batch[r[0]] == b]
            losses.append(loss_of(v, own))
            g = np.array([(loss_of(v + e, own) - loss_of(v - e, own)) / 2e-6 for e in np.eye(len(v)) * 1e-6])
            t += 1
            m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
            v = v - 0.05 * 0.1 * v - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        assert abs(got.losses[epoch] - np.mean(losses)) < 1e-5
    assert np.abs(got.vector() - v).max() < 1e-4
    out = {r["id"]: (r["predicted_label"], r["prob"]) for r in epochs.predict(got, df, ["a", "b", "c"]).collect()}
    p = got.probabilities(np.array([rows[0][1]]))[0]
    assert out["n"] == (None, None) and out["c0"] == ("abc"[p.argmax()], pytest.approx(p.max()))


def test_heads_learn_and_weights_count(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=2) + (3 if i % 2 else -3)).tolist(), i % 2, 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, x array<double>, code int, w double")
    head = epochs.train_epochs(df, 2, ["id"], epochs=15, batch_rows=64, rate=0.1)
    assert head.losses[-1] < head.losses[0] / 2
    found = epochs.predict(head, df, ["0", "1"])
    assert found.filter(F.col("predicted_label") == F.col("code").cast("string")).count() >= 198
    noise = spark.createDataFrame([(i, rng.normal(size=2).tolist(), i % 2, 9.0 if i % 2 else 1.0) for i in range(200)], "id long, x array<double>, code int, w double")
    one_sided = epochs.train_epochs(noise, 2, ["id"], weight="w", epochs=15, batch_rows=64, rate=0.1)
    assert epochs.predict(one_sided, noise, ["0", "1"]).filter("predicted_label = '1'").count() > 180
    with pytest.raises(ValueError):
        epochs.train_epochs(df.limit(0), 2, ["id"])


def test_one_decomposition_serves_all_penalties():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(40, 5)), rng.normal(size=(40, 3))
    g = {"n": 40.0, "sx": x.sum(axis=0), "sy": y.sum(axis=0), "xx": x.T @ x, "xy": x.T @ y}
    path = models.ridge_fit(g, [0.0, 0.5, 30.0])
    for lam, (w, b) in path.items():
        one_w, one_b = models.ridge_fit(g, [lam])[lam]
        assert np.allclose(w, one_w) and np.allclose(b, one_b)


def test_regression_takes_the_penalty_of_val(spark):
    rng = np.random.default_rng(3)
    sides = {"a": "train", "b": "val", "c": "test"}
    rows, truth = [], {}
    for wsi in sides:
        for i in range(30):
            v = rng.normal(size=2)
            rows.append((wsi, f"{wsi}{i}", v.tolist()))
            truth[wsi, f"{wsi}{i}"] = [float(2 * v[0] + rng.normal() * 0.1), float(v[1])]
    features = spark.createDataFrame(rows, "wsi string, cell_id string, x array<double>")
    near = spark.createDataFrame([(w, c, f"{w}{(int(c[1:]) + 1) % 30}") for w, c, _ in rows], "wsi string, cell_id string, other_id string")
    targets = spark.createDataFrame([(w, c, v) for (w, c), v in truth.items()], "wsi string, cell_id string, values array<double>")
    split = spark.createDataFrame(list(sides.items()), "wsi string, side string")
    found, scores = models.expression_regression(features, near, targets, split, ["g", "h"], [1e9, 0.1])
    got = found.groupBy("gene").agg(F.corr("true", "predicted").alias("r"), F.count("*").alias("n")).collect()
    assert scores[0.1] >= scores[1e9] - 1e-9 and {r["gene"]: r["n"] for r in got} == {"g": 30, "h": 30} and all(r["r"] > 0.98 for r in got)
    assert found.filter("substr(cell_id, 1, 1) <> 'c'").count() == 0


def test_encoders_refuse_rows_and_batches(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "id long, v double").coalesce(1)

    def encoder():
        def encode(pdf):
            if (pdf["v"] == 9).any():
                raise RuntimeError("broken batch")
            return [ValueError("odd") if v % 2 else [v] for v in pdf["v"]]

        return encode

    got = {r["id"]: (r["embedding"], r["error"]) for r in models.score_patches(df, encoder, ["v"], ["id"], batch=4).collect()}
    assert got[0] == ([0.0], None) and got[1] == (None, "ValueError: odd") and got[8] == got[9] == (None, "RuntimeError: broken batch") and len(got) == 10
    assert models.score_patches(df.limit(0), encoder, ["v"], ["id"]).count() == 0


def test_heads_share_jobs_and_a_batch_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3).tolist(), i % 2) for i in range(64)]
    df = spark.createDataFrame(rows, "id long, x array<double>, code int")
    apart = [epochs.train_epochs(df, 2, ["id"], epochs=3, batch_rows=16, rate=0.1, hidden=h) for h in ([], [4])]
    monkeypatch.setattr(epochs, "PIECE", 72)  # three rows
    context = spark.sparkContext
    context.setJobGroup("heads", "heads")
    both = epochs.train_heads(df, 2, ["id"], [[], [4]], epochs=3, batch_rows=16, rate=0.1)
    jobs = len(context.statusTracker().getJobIdsForGroup("heads"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert 12 <= jobs < 20  # four batches, three epochs, both heads in one job
    for one, other in zip(apart, both, strict=True):
        assert np.allclose(one.vector(), other.vector(), atol=1e-9) and np.allclose(one.losses, other.losses)
