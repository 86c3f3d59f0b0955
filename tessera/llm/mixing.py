"""Mixing of sources to target weights by soft domain membership.

A classifier learned from labelled rows gives each document its domain posteriors, in steps of 1 / GRID. Document rates r >= floor are fitted so that the
expected tokens of each domain, the sum of r * tokens * posterior, meet their targets in the least-squares sense, by accelerated projected gradient
steps in the tokens' metric (each document's gradient is divided by its tokens): r' = max(floor, y - size * p . residual(y)), y' = r' + b * (r' - r).
A step changes documents of one posterior alike, so the tokens of each posterior are added up once; a step is a job over
those sums, whose number the grid bounds. The steps so far (a few numbers each) give every rate again: no rates are stored between steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let, stored, words

#: Labelled rows that the classifier is fitted on at most, those with the smallest hashes of their ids.
MAX_LABELLED = 2000
FEATURES = 1 << 12
#: Posteriors are multiples of 1 / GRID, as near as their sum of 1 allows.
GRID = 1000
#: A fit has converged once no expected share of tokens is further than TOLERANCE from its target, or PATIENCE steps together lower
#: the sum of squared residuals by less than GAIN (the targets can't be met then). One that hasn't after MOST_STEPS says so.
TOLERANCE, PATIENCE, GAIN, MOST_STEPS = 1e-6, 30, 1e-8, 400
#: Residual of a domain, over all tokens given, up to which a mixture meets its targets.
MET = 1e-4
#: Where no budget is given, the mixture's tokens over the fewest that leave each domain the tokens that came in.
MARGIN = 1.1


def label_domain() -> Column:
    """The domain of a labelled row: 0 plain, 1 good, 2 toxic. A null label counts as 0."""
    return F.when(F.coalesce("toxic", F.lit(0)) > 0, 2).when(F.coalesce("quality", F.lit(0)) > 0, 1).otherwise(0)


DOMAINS = ("plain", "good", "toxic")


def _features(df: DataFrame) -> DataFrame:
    """n_tokens and the hashed presence of the lower-case words."""
    rows = df.withColumn("_words", words(F.lower(F.col("text")))).withColumn("n_tokens", F.size("_words").cast("long"))
    return HashingTF(inputCol="_words", outputCol="_features", numFeatures=FEATURES, binary=True).transform(rows)


def fit_classifier(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED):
    """A multinomial classifier of domains, or None where the labels name fewer than two."""
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label_domain()).cast("double").alias("_label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = _features(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id"))  # at most max_labelled rows
    train = stored(rows.select("_features", "_label"), "labelled")
    if train.select("_label").distinct().count() < 2:
        return None
    return LogisticRegression(featuresCol="_features", labelCol="_label", family="multinomial", regParam=0.02, maxIter=30, probabilityCol="_posterior", rawPredictionCol="_raw", predictionCol="_prediction").fit(train)


def posteriors(documents: DataFrame, model, n_domains: int = len(DOMAINS)) -> DataFrame:
    """doc_id, text_hash, n_tokens, posterior (an array over the domains, on the grid; equal shares without a model)."""
    text, own = F.coalesce("text", F.lit("")), ("doc_id", "text_hash", "n_tokens")
    rows = _features(documents.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))).select(*own, "_features")
    if model is None:
        return rows.select(*own, F.array_repeat(F.lit(1.0 / n_domains), n_domains).alias("posterior"))
    parts = model.transform(rows).select(*own, F.transform(vector_to_array("_posterior"), lambda p: F.round(p * GRID)).alias("parts"))
    whole = F.aggregate("parts", F.lit(0.0), lambda a, x: a + x)
    padded = F.concat(F.col("parts"), F.array_repeat(F.lit(0.0), max(0, n_domains - model.numClasses)))
    return parts.select(*own, let(whole, lambda w: F.transform(padded, lambda x: x / w)).alias("posterior"))


@dataclass(frozen=True)
class Steps:
    """The steps of a fit: rates start at start, and each (residuals at y, size, momentum) takes one."""

    floor: float
    start: float
    taken: tuple[tuple[tuple[float, ...], float, float], ...] = ()
    converged: bool = False

    def rates(self, posterior: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rate, rate a step before, y that the last step began at) for each row of posteriors."""
        r = before = y = at = np.full(len(posterior), self.start)
        for residual, size, momentum in self.taken:
            at = y
            before, r = r, np.maximum(self.floor, at - size * (posterior @ np.array(residual)))
            y = r + momentum * (r - before)
        return r, before, at


def _matrix(column: pd.Series, n: int) -> np.ndarray:
    return np.stack(column.tolist()) if len(column) else np.zeros((0, n))


def rate(posterior: Column, steps: Steps) -> Column:
    """A document's rate: what the steps make of its posterior. Null without one."""

    @F.pandas_udf("double")
    def run(column: pd.Series) -> pd.Series:
        return pd.Series(steps.rates(_matrix(column, 1))[0])

    return run(posterior)


def fit_rates(table: DataFrame, targets: list[float | None], floor: float = 0.0) -> tuple[Steps, np.ndarray]:
    """The steps of the fit, and the expected tokens of each domain after it, as shares of all tokens.

    table: n_tokens, posterior. targets: tokens of each domain as shares of all tokens of the table; None leaves a domain free. A step's size is 1 over the
    largest eigenvalue of the mean of p p' over the documents above the floor (for all, it is safe at any point); it is halved after a step that rises,
    down to the safe one, and momentum starts anew there and where a step turns back. The best step is the last that counts.
    """
    n = len(targets)
    wanted = np.array([t is not None for t in targets])
    aim = np.array([t or 0.0 for t in targets])
    sums = stored(table.filter(F.col("n_tokens") > 0).groupBy("posterior").agg(F.sum("n_tokens").cast("double").alias("tokens")), "posterior-sums")
    total = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0.0))).first()[0]
    steps = Steps(float(floor), max(1.0, float(floor)))
    if not total:
        return replace(steps, converged=True), np.zeros(n)

    def measure(now: Steps, every: bool = False) -> tuple[np.ndarray, float, float]:
        """Expected token shares, whether the last step turned back (positive), and the size for the documents above the floor, or for all."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                p, tokens = _matrix(pdf["posterior"], n), pdf["tokens"].to_numpy()
                r, before, y = now.rates(p)
                free = p[(r > now.floor) | every]
                gram = (free * tokens[(r > now.floor) | every, None]).T @ free
                yield pd.DataFrame({"i": range(n + 1 + n * n), "value": [*((tokens * r) @ p), float(tokens @ ((y - r) * (r - before))), *gram.ravel()]})

        parts = sums.mapInPandas(run, "i int, value double").groupBy("i").agg(F.sum("value"))
        found = dict(tuple(row) for row in parts.collect())  # a few rows
        gram = np.array([found[n + 1 + i] for i in range(n * n)]).reshape(n, n)[np.ix_(wanted, wanted)] / total
        return np.array([found[d] for d in range(n)]) / total, found[n], 1.0 / max(np.linalg.eigvalsh(gram)[-1] if len(gram) else 0.0, 1e-12)

    def residual(reached: np.ndarray) -> np.ndarray:
        return np.where(wanted, reached - aim, 0.0)

    def square(reached: np.ndarray) -> float:
        return float((residual(reached) ** 2).sum())

    reached, _, safe = measure(steps, every=True)
    at_y, t, size, squares, best = reached, 1.0, safe, [square(reached)], (steps, reached)
    ended = False
    while not (ended := ended or np.abs(residual(reached)).max() <= TOLERANCE) and len(steps.taken) < MOST_STEPS:
        before, used = reached, size
        steps = replace(steps, taken=(*steps.taken, (tuple(map(float, residual(at_y))), used, 0.0)))
        reached, turned, free_size = measure(steps)
        squares.append(square(reached))
        momentum = 0.0
        if squares[-1] > squares[-2] or turned > 0:
            t = 1.0
            size = max(safe, size / 2) if squares[-1] > squares[-2] else size
        else:
            t, last = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
            momentum, size = (last - 1) / t, min(free_size, size * 1.2)
        steps = replace(steps, taken=(*steps.taken[:-1], (*steps.taken[-1][:2], momentum)))
        at_y = reached + momentum * (reached - before)  # totals are linear in the rates
        best = (steps, reached) if squares[-1] == min(squares) else best
        ended = len(squares) > PATIENCE and min(squares[:-PATIENCE]) - min(squares) < GAIN
    return replace(best[0], converged=ended), best[1]


@dataclass(frozen=True)
class Fit:
    """What a mixture was asked for and what its rates reach: expected tokens by domain over all tokens given."""

    targets: dict[str, float]
    reached: dict[str, float]
    converged: bool

    @property
    def residual(self) -> dict[str, float]:
        return {d: self.reached[d] - t for d, t in self.targets.items()}

    @property
    def met(self) -> bool:
        return max(map(abs, self.residual.values()), default=0.0) <= MET

    @property
    def tokens(self) -> float:
        """The mixture's tokens over those given."""
        return sum(self.reached.values())

    def __str__(self) -> str:
        each = ", ".join(f"{d} {self.reached[d]:.4f} of {t:.4f} ({self.residual[d]:+.4f})" for d, t in self.targets.items())
        return f"expected tokens over those given, reached of target: {each}; all {self.tokens:.4f}" + ("" if self.converged else "; the fit has not converged")


def fitted_mix(documents: DataFrame, labels: DataFrame, weights: dict[str, float], budget: float | None = 1.0, floor: float = 0.0, max_labelled: int = MAX_LABELLED) -> tuple[DataFrame, Fit]:
    """doc_id, text_hash, n_tokens, posterior, rate of each row of documents, and how near its targets the fit came: floor or posteriors may keep it away.

    weights: the target shares of the domains named, scaled to 1; the other domains are free. budget: the tokens of the named domains in the mixture over all
    tokens given; None takes MARGIN times the fewest that leave each named domain what came in, which rates of 1 and more can meet. A null text is
    empty, has no tokens and takes part with its rate; a null doc_id stays null; rows that repeat count each; an empty table gives
    one; other columns are ignored, whatever their names.
    """
    whole = sum(weights.values())
    shares = {d: w / whole for d, w in weights.items()}
    table = stored(posteriors(documents, fit_classifier(documents, labels, max_labelled)), "posteriors")
    if budget is None:
        came = table.agg(F.sum("n_tokens").alias("all"), *[F.sum(F.col("n_tokens") * F.get("posterior", F.lit(i))).alias(d) for i, d in enumerate(DOMAINS)]).first()
        budget = MARGIN * max((came[d] / came["all"] / w for d, w in shares.items() if w), default=1.0) if came["all"] else 1.0
    targets = {d: budget * w for d, w in shares.items()}
    steps, reached = fit_rates(table, [targets.get(d) for d in DOMAINS], floor)
    return table.withColumn("rate", rate(F.col("posterior"), steps)), Fit(targets, dict(zip(DOMAINS, reached.tolist(), strict=True)), steps.converged)


def mix(documents: DataFrame, labels: DataFrame, weights: dict[str, float], budget: float | None = 1.0, floor: float = 0.0, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of fitted_mix."""
    return fitted_mix(documents, labels, weights, budget, floor, max_labelled)[0]


def copies(mixed: DataFrame, seed: int = 0) -> DataFrame:
    """mixed with copies: the whole part of the rate, and one more with the chance of the rest, by a hash of the id."""
    chance = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    return mixed.withColumn("copies", (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))


def mixed_documents(documents: DataFrame, mixed: DataFrame) -> DataFrame:
    """Each row of documents as often as copies says, with all its columns. Rows of one doc_id and text have one rate and one number of copies."""
    times = copies(mixed).groupBy("doc_id", "text_hash").agg(F.max("copies").alias("copies"))
    rows = documents.select(F.struct("*").alias("row"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    joined = rows.join(times, rows["doc_id"].eqNullSafe(times["doc_id"]) & (rows["text_hash"] == times["text_hash"]))
    return joined.filter(F.col("copies") > 0).select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
