"""A quality classifier: random Fourier features of document statistics, ridge scores by summed normal equations, isotonic calibration.

A document is a vector of statistics of its whole text. Cosines of random projections of the standardised statistics approximate a Gaussian
kernel, so that a linear fit on them is a smooth surface over the statistics. Each partition sums Z'Z and Z'y of each fold; the sums
are added row by row of the matrix, and the penalty is the one whose fits without a fold have the least squared error on it. The scores that these
fits give to the fold they left out are dealt into bins and pooled to a monotone curve from score to the share of label 1. All labelled rows that
aren't held out are used; what reaches the driver is one matrix a fold and a row a bin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored
from tessera.llm.toxicity import held_out

#: Random features, width of the kernel in roots of the number of statistics, folds of the labelled rows, and penalties tried (times the number of rows).
FEATURES, WIDTH, FOLDS, PENALTIES = 256, 1.0, 5, (1e-6, 1e-5, 1e-4, 1e-3, 1e-2, 1e-1)
#: Standardised statistics are cut here; bins that the curve is pooled from; seed of the projections; share of the raw score in a score, which orders what is pooled.
CLIP, BINS, SEED, RAW = 4.0, 1000, 12, 0.001
#: Predicted is 1 from this score on.
THRESHOLD = 0.3
#: Tasks that add the partitions' sums; characters whose statistics are computed at once (of one text, if it is longer); words of a window.
SUMS, BLOCK_CHARS, WINDOW = 64, 2_000_000, 20

NAMES = (
    "log_words", "log_word_chars", "long_words", "short_words", "distinct_words", "top_word", "repeated_next", "repeated_pairs", "upper", "upper_words", "title_words", "letters", "digits",
    "symbols", "symbol_words", "marks", "exclamations", "bars", "sentences", "marked_words", "worst_window", "line_words", "repeated_lines", "symbol_lines", "open_lines",
)
SPACE, UPPER, LETTER, DIGIT, SYMBOL, MARK, STOP = (1 << i for i in range(7))


# ---- statistics


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The kinds of each code point, as bits."""
    kinds = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        kinds[i] = SPACE * c.isspace() | UPPER * c.isupper() | LETTER * c.isalpha() | DIGIT * c.isdigit()
    for chars, kind in (("#*$%&|<>", SYMBOL), (".,;:!?", MARK), (".!?", STOP)):
        kinds[[ord(c) for c in chars]] |= kind
    return kinds


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _sequence_hashes(values: np.ndarray, starts: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each run of values that begins at starts (values outside count as nothing)."""
    place = np.arange(len(values)) - starts[np.cumsum(np.bincount(starts, minlength=len(values))) - 1]
    powers = np.cumprod(np.concatenate([[1], np.full(int(place.max()), 0xD6E8FEB86659FD93, np.uint64)]).astype(np.uint64))
    terms = (values.astype(np.uint64) + np.uint64(1)) * powers[place]
    return _mixed(np.add.reduceat(terms if inside is None else terms * inside, starts))


def _distinct(keys: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(different keys, times of the most frequent) of each document."""
    _, at, times = np.unique(_mixed(keys + _mixed(docs.astype(np.uint64) + np.uint64(7))), return_index=True, return_counts=True)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, docs[at], times)
    return np.bincount(docs[at], minlength=n), most


def text_statistics(texts: list[str]) -> np.ndarray:
    """The values of NAMES of each text, all finite, from whole texts; texts without words have zeros. A block's characters are one array."""
    n = len(texts)
    out = np.zeros((n, len(NAMES)))
    if not n:
        return out
    sizes = np.array([len(t) + 1 for t in texts])
    codes = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _kinds()[codes]
    starts = np.cumsum(sizes) - sizes
    inside = (kinds & SPACE) == 0
    before = np.concatenate([[False], inside[:-1]])
    begin = np.flatnonzero(inside & ~before)
    if not len(begin):
        return out
    end = np.flatnonzero(before & ~inside)  # one behind the last character: each text ends with a line end
    chars = lambda kind: np.add.reduceat(((kinds & kind) > 0).astype(np.int64), starts)
    literal = lambda c: np.add.reduceat((codes == ord(c)).astype(np.int64), starts)
    doc = np.repeat(np.arange(n), sizes)[begin]
    per_doc = lambda flags, of=doc: np.bincount(of, flags, minlength=n)

    def within(kind: int) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum((kinds & kind) > 0)])
        return total[end] - total[begin]

    length = end - begin
    symbols, uppers, last = within(SYMBOL) > 0, within(UPPER), codes[end - 1]
    shouted = (length > 1) & (last == ord("!")) & (codes[end - 2] == ord("!"))
    hashes = _sequence_hashes(codes, begin, inside) if begin[0] == 0 else _sequence_hashes(codes[begin[0] :], begin - begin[0], inside[begin[0] :])
    fresh = np.concatenate([[True], doc[1:] != doc[:-1]])
    again = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & ~fresh[1:]])
    words, total = per_doc(np.ones(len(doc))), per_doc(length)
    distinct, most = _distinct(hashes, doc, n)
    follows = np.flatnonzero(~fresh)
    pairs = _distinct(_mixed(hashes[follows - 1]) + hashes[follows], doc[follows], n)[0] if len(follows) else np.zeros(n)

    odd = np.concatenate([[0], np.cumsum(symbols | shouted | again)])
    first = np.flatnonzero(fresh)
    reach = np.maximum(np.arange(len(doc)) + 1 - WINDOW, first[np.cumsum(fresh) - 1])
    worst = np.zeros(n)
    worst[doc[first]] = np.maximum.reduceat(odd[1:] - odd[reach], first)

    line = np.cumsum(codes == 10)[begin]  # the number of line ends before a word
    head = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    line_doc, tail = doc[head], np.concatenate([head[1:], [len(doc)]]) - 1
    lines = per_doc(np.ones(len(head)), line_doc)
    closed = (kinds[end[tail] - 1] & STOP) > 0
    different = _distinct(_sequence_hashes(hashes, head), line_doc, n)[0]
    marked = ((kinds[end - 1] & (LETTER | DIGIT)) == 0) & (length > 1)
    stops = ((kinds & STOP) > 0) & np.concatenate([~inside[1:], [True]])

    w, c, r = np.maximum(words, 1), np.maximum(total, 1), np.maximum(lines, 1)
    columns = (
        np.log1p(words), np.log1p(total / w), per_doc(length > 12) / w, per_doc(length < 3) / w, distinct / w, most / w, per_doc(again) / w, (np.maximum(words - 1, 0) - pairs) / w,
        chars(UPPER) / c, per_doc((uppers > 1) & (uppers == within(LETTER))) / w, per_doc((kinds[begin] & UPPER) > 0) / w, chars(LETTER) / c, chars(DIGIT) / c,
        chars(SYMBOL) / w, per_doc(symbols) / w, chars(MARK) / w, literal("!") / w, literal("|") / w, np.add.reduceat(stops.astype(np.int64), starts) / w, per_doc(marked) / w,
        worst / np.minimum(w, WINDOW), np.log1p(words / r), (lines - different) / r, per_doc(np.logical_or.reduceat(symbols, head), line_doc) / r, per_doc(~closed, line_doc) / r,
    )
    out[:] = np.column_stack(columns)
    out[words == 0] = 0.0
    return out


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, start, held = batch.column("text").to_pylist(), 0, 0
        for i, t in enumerate([*texts, None]):
            if i > start and (t is None or held + len(t) > BLOCK_CHARS):
                own = batch.slice(start, i - start)
                values = pa.array(list(text_statistics(texts[start:i]).astype(np.float32)), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("held_out"), values], ["doc_id", "held_out", "stats"])
                start, held = i, 0
            held += len(t or "")


def statistics(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out and stats (the values of NAMES) of each row, stored, as they are fitted on and scored.

    A null text is empty and has zeros; a null id is held out; repeated rows have equal statistics; other columns are ignored; an empty table gives one.
    """
    rows = documents.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = documents.schema[id_col].dataType.simpleString()
    return stored(rows.mapInArrow(_statistics, f"doc_id {kind}, held_out boolean, stats array<float>"), "statistics")


# ---- model


@dataclass
class Model:
    """Standardisation, projections, weights (the last is the intercept) and the curve's points."""

    mean: np.ndarray
    spread: np.ndarray
    project: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    curve: tuple[np.ndarray, np.ndarray]

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.spread, -CLIP, CLIP)
        return np.column_stack([np.sqrt(2 / len(self.phase)) * np.cos(z @ self.project + self.phase), np.ones(len(z))])

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.features(stats) @ self.weights
        return (1 - RAW) * np.interp(raw, *self.curve) + RAW / (1 + np.exp(-np.clip(raw - 0.5, -30, 30)))


def pooled(at: np.ndarray, rows: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The curve's points by pooling adjacent violators: places at, each with so many rows and rows of label 1. Blocks are centred at their mean place."""
    blocks: list[list[float]] = []
    for x, n, k in sorted(zip(at.tolist(), rows.tolist(), ones.tolist(), strict=True)):
        blocks.append([x * n, n, k])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([x / n for x, n, _ in blocks]), np.array([k / n for _, n, k in blocks])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy(False).reshape(batch.num_rows, -1).astype(float)


def _normal_equations(model: Model):
    """(fold, i, row i of [Z'Z, Z'y, y'y]) of a partition's rows (fold, y, stats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            z, y, fold = model.features(_matrix(batch)), batch.column("y").to_numpy(False), batch.column("fold").to_numpy(False)
            for f in np.unique(fold):
                own = np.column_stack([z[fold == f], y[fold == f]])
                sums[int(f)] = sums.get(int(f), 0) + own.T @ own
        for f, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([f] * len(total)), pa.array(range(len(total))), pa.array(list(total))], ["fold", "i", "sums"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for fold, i, own in zip(batch.column("fold").to_pylist(), batch.column("i").to_pylist(), batch.column("sums"), strict=True):
            total[fold, i] = total.get((fold, i), 0) + own.values.to_numpy(False)
    if total:
        folds, places = zip(*total, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(folds), pa.array(places), pa.array(list(total.values()))], ["fold", "i", "sums"])


def _solved(total: np.ndarray, penalty: float) -> np.ndarray:
    """Ridge weights from [Z'Z, Z'y, y'y]; the intercept, the last of Z, isn't penalised."""
    d = len(total) - 1
    ridge = np.full(d, penalty * total[d - 1, d - 1] + 1e-12)
    ridge[-1] = 1e-12
    return np.linalg.solve(total[:d, :d] + np.diag(ridge), total[:d, d])


def _off_fold_scores(model: Model, weights: dict[int, np.ndarray]):
    """(bin of the score by the fit without the row's fold, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, z = batch.column("fold").to_numpy(False), model.features(_matrix(batch))
            raw = np.array([z[i] @ weights[int(f)] for i, f in enumerate(fold)])
            bins = np.floor(np.clip(raw, -1, 2) * BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column("y")], ["bin", "y"])

    return run


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", features: int = FEATURES, width: float = WIDTH) -> Model:
    """A model of the label, learned from all labelled rows of stats that aren't held out.

    A null label or id is no label; of an id's labels the largest counts; rows that repeat count each. Without both
    labels every score is the share of label 1 (a half without any).
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max(label) > 0).cast("double").alias("y"))
    rows = stats.filter(~F.col("held_out")).join(known, "doc_id").select(F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).alias("fold"), "y", "stats")
    rows = stored(rows, "labelled")
    moments = rows.select(F.posexplode("stats")).groupBy("pos").agg(F.avg("col").alias("mean"), F.stddev_pop("col").alias("spread")).orderBy("pos").collect()
    rng, dims = np.random.default_rng(SEED), len(NAMES)
    mean, spread = np.array([r["mean"] for r in moments] or [0.0] * dims), np.array([r["spread"] for r in moments] or [1.0] * dims)
    project, phase = rng.normal(size=(dims, features)) / (width * np.sqrt(dims)), rng.uniform(0, 2 * np.pi, features)
    model = Model(mean, np.where(spread > 1e-9, spread, 1.0), project, phase, np.zeros(features + 1), (np.zeros(1), np.full(1, 0.5)))
    parts = rows.mapInArrow(_normal_equations(model), "fold long, i long, sums array<double>").repartition(SUMS, "fold", "i").mapInArrow(_added, "fold long, i long, sums array<double>")
    own: dict[int, np.ndarray] = {}
    for r in parts.collect():  # a row for each fold and feature
        own.setdefault(r["fold"], np.zeros((features + 2, features + 2)))[r["i"]] = r["sums"]
    if not own:
        return model
    total = sum(own.values())
    n, ones = total[-2, -2], total[-2, -1]
    if not 0 < ones < n:
        model.curve = np.zeros(1), np.full(1, ones / n)
        return model

    def error(penalty: float) -> float:
        lost = 0.0
        for part in own.values():
            w = np.append(-_solved(total - part if len(own) > 1 else total, penalty), 1.0)
            lost += w @ part @ w
        return lost

    penalty = min(PENALTIES, key=error)
    model.weights = _solved(total, penalty)
    off = {f: _solved(total - part if len(own) > 1 else total, penalty) for f, part in own.items()}
    bins = rows.mapInArrow(_off_fold_scores(model, off), "bin long, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("ones")).collect()
    at, many, marked = (np.array([float(r[c]) for r in bins]) for c in ("bin", "n", "ones"))
    model.curve = pooled((at + 0.5) / BINS, many, marked)
    return model


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = model.score(_matrix(batch))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def score(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from THRESHOLD on) of each row of statistics; nothing is shuffled; an empty table gives one."""
    kind = stats.schema["doc_id"].dataType.simpleString()
    return stats.mapInArrow(_scored(model), f"doc_id {kind}, held_out boolean, score double, predicted int")
