"""Classifier heads trained for a fixed number of epochs in minibatches, with sample weights, by an adaptive-moment optimiser.

Rows are dealt to batches by a hash once and kept, a partition a batch, in memory or on the executors' disks, so a step is one job over its own partition,
without a plan of its own. The driver holds one gradient and the two moments (the size of the head) and makes the step. An epoch visits the batches in an
order of its own. Heads that share rows and batches are trained in the same jobs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Decay of the two moments, and what keeps a step finite.
BETA_1, BETA_2, TINY = 0.9, 0.999, 1e-8
#: Bytes of the vectors that are kept in one piece.
PIECE = 4_000_000


@dataclass
class Head:
    """Layers (weights, bias); between them negative values are cut to 0."""

    layers: list[tuple[np.ndarray, np.ndarray]]
    losses: list[float] = field(default_factory=list)

    @staticmethod
    def start(sizes: list[int], seed: int) -> Head:
        rng = np.random.default_rng(seed)
        draw = lambda a, *shape: rng.uniform(-1 / np.sqrt(a), 1 / np.sqrt(a), shape)
        return Head([(draw(a, a, b), draw(a, b)) for a, b in zip(sizes, sizes[1:], strict=False)])

    def activations(self, x: np.ndarray) -> list[np.ndarray]:
        """The rows before each layer, and the last layer's values."""
        out = [x]
        for i, (w, b) in enumerate(self.layers):
            z = out[-1] @ w + b
            out.append(np.maximum(z, 0) if i < len(self.layers) - 1 else z)
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.activations(x)[-1]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def gradient(self, x: np.ndarray, code: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
        """(sum of weighted cross entropies, its gradient as one vector)."""
        held = self.activations(x)
        z = held[-1] - held[-1].max(axis=1, keepdims=True)
        p = np.exp(z)
        total = p.sum(axis=1, keepdims=True)
        at = np.arange(len(x)), code
        loss = float((weight * (np.log(total[:, 0]) - z[at])).sum())
        delta = p / total
        delta[at] -= 1
        delta *= weight[:, None]
        parts = []
        for i in range(len(self.layers) - 1, -1, -1):
            parts.append(np.concatenate([(held[i].T @ delta).ravel(), delta.sum(axis=0)]))
            if i:
                delta = (delta @ self.layers[i][0].T) * (held[i] > 0)
        return loss, np.concatenate(parts[::-1])

    def vector(self) -> np.ndarray:
        return np.concatenate([np.concatenate([w.ravel(), b]) for w, b in self.layers])

    def replaced(self, v: np.ndarray) -> Head:
        out, at = [], 0
        for w, b in self.layers:
            out.append((v[at : at + w.size].reshape(w.shape), v[at + w.size : at + w.size + b.size]))
            at += w.size + b.size
        return Head(out, self.losses)


@dataclass
class Moments:
    """The optimiser's state."""

    first: np.ndarray
    second: np.ndarray
    steps: int = 0

    def step(self, v: np.ndarray, gradient: np.ndarray, rate: float, decay: float) -> np.ndarray:
        """Parameters after a step whose weight decay is apart from the gradient."""
        self.steps += 1
        self.first = BETA_1 * self.first + (1 - BETA_1) * gradient
        self.second = BETA_2 * self.second + (1 - BETA_2) * gradient**2
        mean, spread = self.first / (1 - BETA_1**self.steps), self.second / (1 - BETA_2**self.steps)
        return v * (1 - rate * decay) - rate * mean / (np.sqrt(spread) + TINY)


def batch_of(n_batches: int, seed: int, *keys: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(n_batches)).cast("int")


def batch_order(n_batches: int, seed: int, epoch: int) -> list[int]:
    return np.random.default_rng([seed, epoch]).permutation(n_batches).tolist()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows' vectors, codes and weights as bytes, in pieces of at most PIECE bytes (a row at least)."""
    for batch in batches:
        n = batch.num_rows
        if n:
            x = batch.column("x").flatten().to_numpy(False).reshape(n, -1).astype(float)
            code, weight = (batch.column(c).to_numpy(False) for c in ("code", "weight"))
            step = max(1, PIECE // (8 * max(x.shape[1], 1)))
            for at in range(0, n, step):
                part = [v[at : at + step] for v in (x, code, weight)]
                yield pa.RecordBatch.from_arrays([pa.array([len(part[0])], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in part]], ["n", "x", "code", "weight"])


def _gradients(heads: list[Head]):
    """(rows, each head's sum of losses, each head's gradient) of a batch's pieces."""

    def run(pieces: Iterator[Row]) -> Iterator[tuple[int, list[float], list[np.ndarray]]]:
        losses, totals, n = [0.0] * len(heads), [0.0] * len(heads), 0
        for piece in pieces:
            x, code, weight = np.frombuffer(piece["x"]).reshape(piece["n"], -1), np.frombuffer(piece["code"], np.int32), np.frombuffer(piece["weight"])
            n += len(x)
            for i, head in enumerate(heads):
                one, g = head.gradient(x, code, weight)
                losses[i], totals[i] = losses[i] + one, totals[i] + g
        if n:
            yield n, losses, totals

    return run


def train_heads(
    train: DataFrame, n_classes: int, keys: list[str], hidden: list[list[int]], x: str = "x", code: str = "code", weight: str | None = None, epochs: int = 30, batch_rows: int = 4096,
    rate: float = 1e-3, decay: float = 1e-2, seed: int = 0,
) -> list[Head]:
    """train_epochs of several heads, each with its hidden layers, on the same batches: a step of all of them is one job."""
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    rows = train.filter(F.col(x).isNotNull() & F.col(code).isNotNull())
    n, dim = rows.agg(F.count("*"), F.first(F.size(x))).first()
    if not n:
        raise ValueError("no rows to train on")
    n_batches = max(1, -(-n // batch_rows))
    dealt = rows.select(F.transform(x, lambda v: v.cast("double")).alias("x"), F.col(code).cast("int").alias("code"), w.alias("weight"), batch_of(n_batches, seed, *keys).alias("batch"))
    kept = dealt.repartitionById(n_batches, F.col("batch")).select("x", "code", "weight").mapInArrow(_packed, "n int, x binary, code binary, weight binary").rdd.persist(StorageLevel.MEMORY_AND_DISK)
    heads = [Head.start([dim, *own, n_classes], seed) for own in hidden]
    vectors = [head.vector() for head in heads]
    moments = [Moments(np.zeros_like(v), np.zeros_like(v)) for v in vectors]
    try:
        for epoch in range(epochs):
            losses: list[list[float]] = [[] for _ in heads]
            for batch in batch_order(n_batches, seed, epoch):
                for size, loss, gradient in train.sparkSession.sparkContext.runJob(kept, _gradients(heads), [batch]):  # one, or none of an empty batch
                    for i, head in enumerate(heads):
                        losses[i].append(loss[i] / size)
                        vectors[i] = moments[i].step(vectors[i], gradient[i] / size, rate, decay)
                        heads[i] = head.replaced(vectors[i])
            for head, own in zip(heads, losses, strict=True):
                head.losses.append(float(np.mean(own)))
    finally:
        kept.unpersist()
    return heads


def train_epochs(
    train: DataFrame, n_classes: int, keys: list[str], x: str = "x", code: str = "code", weight: str | None = None, epochs: int = 30, batch_rows: int = 4096,
    rate: float = 1e-3, decay: float = 1e-2, hidden: list[int] | None = None, seed: int = 0,
) -> Head:
    """A head, linear or with hidden layers, and in losses each epoch's mean loss of its batches.

    A batch's loss is the mean over its rows of the weighted cross entropy; weights count as 1 where none are given. Batches have about batch_rows rows, by a hash of the keys. Rows with a
    null x or code take no part; a null weight is 0; no rows raise.
    """
    return train_heads(train, n_classes, keys, [hidden or []], x, code, weight, epochs, batch_rows, rate, decay, seed)[0]


def predict(head: Head, df: DataFrame, names: list[str], x: str = "x") -> DataFrame:
    """df with predicted_label and prob (of that label); null where x is null."""

    def run(values: pa.Array) -> pa.Array:
        known = values.drop_null()
        out: list = [None] * len(values)
        if len(known):
            p = head.probabilities(known.flatten().to_numpy(False).reshape(len(known), -1).astype(float))
            found = iter(zip(p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True))
            out = [next(found) if ok else None for ok in values.is_valid().to_pylist()]
        return pa.array([None if r is None else {"label": names[r[0]], "prob": r[1]} for r in out], pa.struct([("label", pa.string()), ("prob", pa.float64())]))

    run.__annotations__ = {"values": pa.Array, "return": pa.Array}
    out = df.withColumn("_p", F.arrow_udf(run, "struct<label:string,prob:double>")(F.transform(x, lambda v: v.cast("double"))))
    return out.withColumns({"predicted_label": F.col("_p.label"), "prob": F.col("_p.prob")}).drop("_p")
