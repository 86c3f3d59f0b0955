"""Model fitting: closed-form ridge from one pass of sums, MLlib classifiers, PCA, scaling, probes and grid search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import vector_stats
from tessera.operators.tables import classification_report, confusion_matrix, quantiles, r2_score, select_best_trial, union_all
from tessera.sources.storage import stored, tasks_for

#: Cells whose neighbours' vectors are pooled in a task, about.
CELLS = 50_000
#: Components of a vector whose squared matrix the driver solves at most.
MAX_DIM = 4096


def gram(df: DataFrame, x: str = "x", y: str = "y") -> dict[str, np.ndarray]:
    """n, sums of x and y, X'X and X'Y in one pass: each partition's sums leave it row by row, and a row of the matrix is added up in one stream.

    At most MAX_DIM components, so that the matrix fits the driver.
    """
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    some = known.first()
    if some is None:
        raise ValueError("no rows to fit")
    if (d := len(some[0])) > MAX_DIM:
        raise ValueError(f"{d} components; at most {MAX_DIM}: reduce them first")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                a = np.column_stack([np.ones(len(pdf)), np.stack(pdf[x].to_numpy()).astype(float), np.stack(pdf[y].to_numpy()).astype(float)])
                total = a.T @ a if total is None else total + a.T @ a
        for at in range(0, 0 if total is None else len(total), 256):
            yield pd.DataFrame({"i": range(at, min(at + 256, len(total))), "row": list(total[at : at + 256])})

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for i, row in zip(pdf["i"], pdf["row"], strict=True):
                sums[i] = sums[i] + row if i in sums else np.array(row)
        yield pd.DataFrame({"i": list(sums), "row": list(sums.values())})

    form = "i int, row array<double>"
    rows = known.mapInPandas(partial, form).repartition("i").mapInPandas(added, form).collect()
    m = np.stack([r["row"] for r in sorted(rows, key=lambda r: r["i"])])
    return {"n": m[0, 0], "sx": m[0, 1 : d + 1], "sy": m[0, d + 1 :], "xx": m[1 : d + 1, 1 : d + 1], "xy": m[1 : d + 1, d + 1 :]}


def ridge_fit(g: dict[str, np.ndarray], lambdas: list[float]) -> dict[float, tuple[np.ndarray, np.ndarray]]:
    """Weights and bias for each penalty; the bias is not penalised. One eigendecomposition serves a path of penalties."""
    mx, my = g["sx"] / g["n"], g["sy"] / g["n"]
    xx, xy = g["xx"] - g["n"] * np.outer(mx, mx), g["xy"] - g["n"] * np.outer(mx, my)
    if len(lambdas) == 1:
        path = {lambdas[0]: np.linalg.solve(xx + lambdas[0] * np.eye(len(xx)), xy)}
    else:
        values, axes = np.linalg.eigh(xx)
        turned = axes.T @ xy
        path = {lam: axes @ (turned / np.maximum(values + lam, 1e-12 * max(values[-1], 1e-300))[:, None]) for lam in lambdas}
    return {lam: (w, my - mx @ w) for lam, w in path.items()}


def ridge_predict(w: np.ndarray, b: np.ndarray, x: Column) -> Column:
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(x.to_numpy()).astype(float) @ w + b)) if len(x) else pd.Series([], dtype=object)

    return F.pandas_udf(run, "array<double>")(x)


def standardise(train: DataFrame, x: str, *others: DataFrame, population: bool = False) -> list[DataFrame]:
    """train and others with x standardised by train's means and deviations (+ 1e-8)."""
    stats = vector_stats(train, x, population).orderBy("dim").toPandas()  # a row per component
    mean, std = stats["mean"].to_numpy(), stats["std"].fillna(0.0).to_numpy() + 1e-8

    def run(v: pd.Series) -> pd.Series:
        return pd.Series(list((np.stack(v.to_numpy()).astype(float) - mean) / std)) if len(v) else pd.Series([], dtype=object)

    return [df.withColumn(x, F.pandas_udf(run, "array<double>")(x)) for df in (train, *others)]


def scale_columns(train: DataFrame, columns: list[str], robust: bool, *others: DataFrame) -> list[DataFrame]:
    """Columns less their mean over their population deviation, or less their median over the quartile distance; zero spreads become 1."""
    if robust:
        points = [quantiles(train, c, [0.5, 0.25, 0.75]).first()["q"] for c in columns]  # three numbers a column
        found = [s for q in points for s in (q[0], q[2] - q[1] if q[0] is not None else None)]
    else:
        found = train.agg(*[s for c in columns for s in (F.avg(c), F.stddev_pop(c))]).first()
    out = []
    for df in (train, *others):
        out.append(df.withColumns({c: (F.col(c) - F.lit(found[2 * i])) / F.lit(found[2 * i + 1] or 1.0) for i, c in enumerate(columns)}))
    return out


def pca_fit(train: DataFrame, x: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, components) of at most min(k, dimension, n - 1) components."""
    n = train.count()
    mean = vector_stats(train, x).orderBy("dim").toPandas()["mean"].to_numpy()
    k = max(1, min(k, len(mean), n - 1))
    rows = train.select(array_to_vector(F.transform(x, lambda v: v.cast("double"))).alias("_v"))
    return mean, PCA(k=k, inputCol="_v", outputCol="_p").fit(rows).pc.toArray()


def pca_apply(df: DataFrame, x: str, mean: np.ndarray, components: np.ndarray) -> DataFrame:
    return df.withColumn(x, ridge_predict(components, -mean @ components, F.col(x)))


def logistic_fit(train: DataFrame, x: str = "x", code: str = "code", lam: float = 0.0, weight: str | None = None, max_iter: int = 100):
    """Multinomial: mean cross entropy + lam * the sum of squared weights."""
    rows = train.withColumn("_v", array_to_vector(F.transform(x, lambda v: v.cast("double")))).withColumn(code, F.col(code).cast("double"))
    more = {"weightCol": weight} if weight else {}
    return LogisticRegression(featuresCol="_v", labelCol=code, family="multinomial", regParam=2 * lam, standardization=False, maxIter=max_iter, **more).fit(rows)


def hidden_fit(train: DataFrame, layers: list[int], x: str = "x", code: str = "code", seed: int = 0):
    """A head with hidden layers."""
    rows = train.withColumn("_v", array_to_vector(F.transform(x, lambda v: v.cast("double")))).withColumn(code, F.col(code).cast("double"))
    return MultilayerPerceptronClassifier(featuresCol="_v", labelCol=code, layers=layers, seed=seed, maxIter=100).fit(rows)


def predict_classes(model, df: DataFrame, names: list[str], x: str = "x") -> DataFrame:
    """df with predicted_label and prob, a map of class names."""
    rows = df.withColumn("_v", array_to_vector(F.transform(x, lambda v: v.cast("double"))))
    out = model.transform(rows)
    labels = F.array(*map(F.lit, names))
    prob = F.map_from_arrays(F.slice(labels, 1, F.size(vector_to_array("probability"))), vector_to_array("probability"))
    return out.select(*df.columns, F.get(labels, F.col("prediction").cast("int")).alias("predicted_label"), prob.alias("prob"))


def run_probe(train: DataFrame, val: DataFrame, test: DataFrame, lambdas: list[float], x: str = "x", y: str = "target") -> dict:
    """Sweeps ridge penalties on valid rows of train, keeps the first best on val by r2 and evaluates it on test. Skipped with under ten train rows or no val row."""
    sides = [df.filter(F.col(y).isNotNull() & F.coalesce(F.col("valid"), F.lit(True))).withColumn(y, F.array(F.col(y).cast("double"))) for df in (train, val, test)]
    n_train, n_val = sides[0].count(), sides[1].count()
    if n_train < 10 or n_val == 0:
        return {"skipped": True, "reason": f"{n_train} train and {n_val} val rows", "trials": []}
    sides = standardise(sides[0], x, *sides[1:])
    models = ridge_fit(gram(sides[0], x, y), lambdas)

    def score(df: DataFrame, w, b) -> float:
        rows = df.select(F.get(y, F.lit(0)).alias("t"), F.get(ridge_predict(w, b, F.col(x)), F.lit(0)).alias("p"))
        return r2_score(rows, "t", "p").first()["r2"]

    trials = [{"trial_idx": i, "lambda": lam, "val_r2": score(sides[1], *models[lam])} for i, lam in enumerate(lambdas)]
    best = max(trials, key=lambda t: (t["val_r2"], -t["trial_idx"]))
    return {"skipped": False, "reason": None, "trials": trials, "best": best, "test_r2": score(sides[2], *models[best["lambda"]])}


#: Probes by key: a function from cells to (wsi, cell_id, target, valid).
PROBES: dict[str, Callable[..., DataFrame]] = {}


def register_probe(key: str):
    """Registers a probe's targets under a key; one block of settings may then name it any number of times."""

    def keep(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        PROBES[key] = f
        return f

    return keep


def run_probe_suite(cells: DataFrame, features: DataFrame, sides: DataFrame, settings: list[dict], lambdas: list[float]) -> list[dict]:
    """run_probe for each setting ({"probe": key, "name": ..., parameters}); sides: wsi, side. An unknown key raises."""
    out = []
    base = stored(features.join(sides, "wsi"), "probe-features")
    for one in settings:
        own = dict(one)
        key, name = own.pop("probe"), own.pop("name", one["probe"])
        if key not in PROBES:
            raise KeyError(f"no probe {key!r}; known: {sorted(PROBES)}")
        rows = stored(base.join(PROBES[key](cells, **own), ["wsi", "cell_id"]), "probe")
        parts = [rows.filter(F.col("side") == s) for s in ("train", "val", "test")]
        out.append({"probe": name} | run_probe(*parts, lambdas))
    return out


def grid_search(train: DataFrame, val: DataFrame, trials: list[dict], names: list[str], x: str = "x") -> DataFrame:
    """trial_idx, parameters and val metrics of a classifier for each trial ({"lambda": ...}). Train rows are kept for all trials."""
    train = stored(train, "train")
    rows = None
    for i, trial in enumerate(trials):
        model = logistic_fit(train, x, "code", trial["lambda"], trial.get("weight"))
        report = classification_report(confusion_matrix(predict_classes(model, val, names, x), names, "label"))
        one = report.select(F.lit(i).alias("trial_idx"), F.lit(float(trial["lambda"])).alias("lambda"), "accuracy", "macro_f1", "weighted_f1", "balanced_accuracy")
        rows = one if rows is None else union_all(rows, one)
    return rows


def best_of_grid(trials: DataFrame, metric: str = "macro_f1") -> DataFrame:
    return select_best_trial(trials.withColumn("_k", F.lit(0)), ["_k"], metric).drop("_k")


def score_patches(df: DataFrame, encoder: Callable[[], Callable[[pd.DataFrame], list]], columns: list[str], keep: list[str], batch: int = 256) -> DataFrame:
    """keep, embedding, error of each patch: encoder() is made once for each partition and called with batches of so many rows; a batch that fails says why and the run goes on,
    and so does a row for which the encoder gives an exception instead of an embedding."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keep).schema) + ", embedding array<float>, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        for pdf in (rows.iloc[i : i + batch] for rows in batches for i in range(0, len(rows), batch)):
            out = pdf[keep].copy()
            try:
                found = list(encode(pdf[columns]))
                out["embedding"] = [None if isinstance(v, Exception) else v for v in found]
                out["error"] = [f"{type(v).__name__}: {v}" if isinstance(v, Exception) else None for v in found]
            except Exception as e:  # noqa: BLE001  a user's function may raise anything
                out["embedding"], out["error"] = None, f"{type(e).__name__}: {e}"
            yield out

    return df.select(*dict.fromkeys([*keep, *columns])).mapInPandas(run, schema)


def neighbour_pool(features: DataFrame, neighbours: DataFrame, x: str = "x") -> DataFrame:
    """wsi, cell_id, pooled: element-wise largest of the neighbours' vectors, by component."""
    tasks = tasks_for(features.sparkSession, features.count(), CELLS)
    other = features.select("wsi", F.col("cell_id").alias("other_id"), F.col(x).alias("_x"))
    pairs = neighbours.select("wsi", "cell_id", "other_id").join(other, ["wsi", "other_id"]).repartition(tasks, "wsi", "cell_id")  # a row a pair is sent, not one a component
    top = pairs.select("wsi", "cell_id", F.posexplode("_x").alias("dim", "v")).groupBy("wsi", "cell_id", "dim").agg(F.max("v").alias("v"))
    return top.groupBy("wsi", "cell_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda s: s["v"]).alias("pooled"))


def expression_regression(features: DataFrame, neighbours: DataFrame, targets: DataFrame, sides: DataFrame, genes: list[str], lambdas: list[float], x: str = "x") -> tuple[DataFrame, dict[float, float]]:
    """(wsi, cell_id, gene, true, predicted on the test side, and the mean Pearson correlation over genes on val for each penalty).

    Ridge from a cell's vector and its pooled neighbours to all genes at once (targets: wsi, cell_id, values; sides: wsi, side), at the penalty with the best mean on val, the first
    where two are alike or val is empty.
    """
    pooled = neighbour_pool(features, neighbours, x)
    rows = features.join(pooled, ["wsi", "cell_id"]).withColumn("x", F.concat(F.col(x), "pooled")).select("wsi", "cell_id", "x").join(targets, ["wsi", "cell_id"]).join(sides, "wsi")
    rows = stored(rows, "expression-rows")
    train, val, test = standardise(rows.filter("side = 'train'"), "x", rows.filter("side = 'val'"), rows.filter("side = 'test'"))
    path = ridge_fit(gram(train, "x", "values"), lambdas)
    names = F.array(*map(F.lit, genes))

    def predicted(df: DataFrame, lam: float) -> DataFrame:
        out = df.withColumn("_p", ridge_predict(*path[lam], F.col("x")))
        return out.select("wsi", "cell_id", F.explode(F.arrays_zip(names.alias("gene"), F.col("values").alias("true"), F.col("_p").alias("predicted"))).alias("s")).select("wsi", "cell_id", "s.*")

    def mean_pearson(lam: float) -> float:
        each = predicted(val, lam).groupBy("gene").agg(F.corr("true", "predicted").alias("r"))
        return each.filter(F.col("r").isNotNull() & ~F.isnan("r")).agg(F.coalesce(F.avg("r"), F.lit(-1.0))).first()[0]

    scores = {lam: mean_pearson(lam) for lam in lambdas}
    return predicted(test, max(lambdas, key=lambda lam: scores[lam])), scores
