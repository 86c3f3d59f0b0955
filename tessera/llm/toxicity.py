"""Toxicity scores by a weighted finite-state grammar over clauses.

Five transducers read the words of a clause in order, each its own symbols: the insult lexicon finds a word that insults and something it is said
of (a word alone in its clause matches nothing), a threat waits for its target, a target (a pronoun or name that is addressed) marks an insult beside it, a
negation marks what follows it within reach, and reported speech marks the whole rest of the clause. They are tables; compose makes one machine of
them, whose states and symbols are tuples of theirs and which writes what any of them writes. A match so falls into one of five classes: a plain insult, an
addressed one, a threat, a negated match, a reported one. A document's features are the weights of its matches by class, its weightiest clause and the share of
clauses that match; a logistic curve, whose weights of the classes are learned and start from a prior, turns them into a probability.

The insult lexicon and the curve are learned from labelled rows. A word's weight is the log-odds of the most specific
form of it (the word, else its first 7, 6, 5 or 4 letters) that the labelled texts hold often enough, if it stands out
from chance over all forms tried; so inflected and unseen words of a known stem count. The words that threaten, address, negate and report are closed
classes of the documents' languages (English, German, French, Spanish) and are fixed; what a match in their presence is worth is learned.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import astuple, dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on at most, those with the smallest hashes of their ids.
MAX_LABELLED = 3000
STEMS = (7, 6, 5, 4)
#: Documents that must hold a form before it is trusted.
SUPPORT = 4
#: Words whose weights a task keeps at once.
KEPT_WORDS = 500_000

THREATS = frozenset("kill hurt beat destroy punish stab shoot burn töten verletzen schlagen vernichten tuer frapper brûler détruire matar golpear quemar destruir".split())
TARGETS = frozenset("you your yours he she they him her them people du dich dein ihr euch ihnen tu toi vous votre eux lui tú vosotros usted ustedes ellos ellas".split())
NEGATIONS = frozenset("not no never neither nor without nicht kein keine nie niemals ohne ne pas jamais sans nunca jamás sin".split())
REPORTS = frozenset("said says called quoted wrote reported alleged sagte schrieb nannte zitierte berichtete dit écrit appelé cité dijo escribió llamó citó informó".split())

#: What a threat with its target weighs. Classes of matches, and the curve's prior weights of the features: of all matches, of each class but the first, of the weightiest clause, and of the share of clauses.
THREAT_WEIGHT = 3.0
CLASSES = ("plain", "addressed", "threat", "negated", "reported")
PRIOR = (1.0, 0.3, 0.3, -0.5, -0.3, 0.0, 0.0)
#: Words that a negation or a waiting threat reaches.
REACH = 4

_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.!?;:\n]+")


@dataclass(frozen=True)
class Write:
    """What a transition writes: a match (of an insult, of a threat), marks on it, and that the insult last matched was addressed after all."""

    insult: bool = False
    threat: bool = False
    addressed: bool = False
    negated: bool = False
    reported: bool = False
    after_all: bool = False

    def __or__(self, other: Write) -> Write:
        return Write(*(a or b for a, b in zip(astuple(self), astuple(other), strict=True)))

    def matched(self) -> int:
        """The class of a match, as a place in CLASSES."""
        return 4 if self.reported else 3 if self.negated else 2 if self.threat else 1 if self.addressed else 0


@dataclass(frozen=True)
class Transducer:
    """A deterministic transducer: table[state, symbol] is (next state, what is written); state 0 begins a clause."""

    table: dict[tuple, tuple[object, Write]]
    start: object = 0


PASS = Write()


def _counting(begins: str, held: Write, ends: dict[str, Write] | None = None) -> dict[tuple, tuple[object, Write]]:
    """A table that counts REACH words down after the symbol begins; held is written meanwhile, and symbols of ends write theirs and end it."""
    ends = ends or {}
    table: dict[tuple, tuple[object, Write]] = {}
    for k in range(REACH + 1):
        now = held if k else PASS
        table[k, begins] = (REACH, now)
        table[k, "other"] = (max(0, k - 1), now)
        for symbol, write in ends.items():
            table[k, symbol] = (0, write if k else PASS)
    return table


#: The five transducers and their tables.
TRANSDUCERS = {
    "insult": Transducer({(0, "insult"): (0, Write(insult=True)), (0, "other"): (0, PASS)}),
    "negation": Transducer(_counting("negation", Write(negated=True))),
    "report": Transducer({(0, "report"): (1, PASS), (0, "other"): (0, PASS), (1, "report"): (1, Write(reported=True)), (1, "other"): (1, Write(reported=True))}),
    "threat": Transducer(_counting("threat", PASS, {"target": Write(threat=True)})),
    # after a target (1) an insult is addressed; after an insult (2) a target addresses it after all
    "target": Transducer({
        (0, "target"): (1, PASS), (0, "insult"): (2, PASS), (0, "other"): (0, PASS),
        (1, "target"): (1, PASS), (1, "insult"): (0, Write(addressed=True)), (1, "other"): (0, PASS),
        (2, "target"): (1, Write(after_all=True)), (2, "insult"): (2, PASS), (2, "other"): (0, PASS),
    }),
}


def symbols(word: str, weight: float) -> dict[str, str]:
    """What each transducer reads for a word of an insult weight."""
    addressed, insulting = word in TARGETS, weight > 0
    return {
        "insult": "insult" if insulting else "other", "negation": "negation" if word in NEGATIONS else "other", "report": "report" if word in REPORTS else "other",
        "threat": "target" if addressed else "threat" if word in THREATS else "other", "target": "target" if addressed else "insult" if insulting else "other",
    }


def compose(machines: dict[str, Transducer]) -> Transducer:
    """The machine that reads the symbols of all in step: its states and symbols are tuples, and it writes what any of them writes."""
    start = tuple(m.start for m in machines.values())
    alphabets = [sorted({symbol for _, symbol in m.table}) for m in machines.values()]
    table: dict[tuple, tuple[object, Write]] = {}
    states, seen = [start], {start}
    while states:
        state = states.pop()
        for read in itertools.product(*alphabets):
            steps = [m.table[s, r] for m, s, r in zip(machines.values(), state, read, strict=True)]
            write = PASS
            for _, own in steps:
                write = write | own
            after = tuple(s for s, _ in steps)
            table[state, read] = (after, write)
            if after not in seen:
                seen.add(after)
                states.append(after)
    return Transducer(table, start)


@lru_cache(maxsize=8)
def grammar(names: tuple[str, ...] = tuple(TRANSDUCERS)) -> Transducer:
    return compose({n: TRANSDUCERS[n] for n in names})


def clause_weights(tokens: Iterable[tuple[str, float]], names: tuple[str, ...] = tuple(TRANSDUCERS)) -> tuple[float, ...]:
    """The weights of a clause's matches by class, given its words with their insult weights, by the machine composed of some transducers."""
    return _walk([(weight, tuple(symbols(word, weight)[n] for n in names)) for word, weight in tokens], grammar(names))


def _walk(read: list[tuple[float, tuple[str, ...]]], machine: Transducer) -> tuple[float, ...]:
    total = [0.0] * len(CLASSES)
    if len(read) < 2:  # nothing that it could be said of
        return tuple(total)
    table, state, last = machine.table, machine.start, None
    for weight, symbol in read:
        state, write = table[state, symbol]
        if write.after_all and last is not None and last[0] == 0:
            total[0] -= last[1]
            total[1] += last[1]
            last = None
        if write.insult or write.threat:
            own, found = write.matched(), weight if write.insult else THREAT_WEIGHT
            total[own] += found
            last = (own, found) if write.insult else last
    return tuple(total)


def forms(word: str) -> list[str]:
    """The word and its stems, most specific first."""
    return [word] + [f"{word[:n]}*" for n in STEMS if len(word) >= n]


@dataclass
class Lexicon:
    """Insult weights by form; forms of weight 0 are known to be harmless."""

    weights: dict[str, float] = field(default_factory=dict)

    def weight(self, word: str) -> float:
        for f in forms(word):
            known = self.weights.get(f)
            if known is not None:
                return known
        return 0.0


class Forms:
    """The forms of labelled texts, by hash: those of each text, and the forms themselves that SUPPORT texts hold. There are millions, and few are held often enough to be kept as text."""

    def __init__(self, words: list[set[str]]):
        self.of = [np.unique(np.fromiter((hash(f) for w in own for f in forms(w)), np.int64)) for own in words]
        keys, totals = np.unique(np.concatenate([*self.of, np.zeros(0, np.int64)]), return_counts=True)
        often = set(keys[totals >= SUPPORT].tolist())
        self.spelled = {h: f for w in set().union(*words) for f in forms(w) if (h := hash(f)) in often}


def learn_lexicon(known: Forms, chosen: list[int], toxic: np.ndarray) -> Lexicon:
    """From some of the texts; toxic has the label of every text."""
    n1 = int(toxic[chosen].sum())
    n0 = len(chosen) - n1
    if not n1 or not n0:
        return Lexicon()
    counted = {}
    for label in (0, 1):
        own = [known.of[i] for i in chosen if toxic[i] == label]
        counted[label] = dict(zip(*(x.tolist() for x in np.unique(np.concatenate(own), return_counts=True)), strict=True))
    found = {f: (a, b) for h, f in known.spelled.items() if (a := counted[1].get(h, 0)) + (b := counted[0].get(h, 0)) >= SUPPORT}
    rate, chance = n1 / (n1 + n0), math.log(max(2, len(found)))
    weights = {}
    for f, (a, b) in found.items():
        odds = math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
        share = a / (a + b)
        gain = a * math.log(share / rate) + (b * math.log((1 - share) / (1 - rate)) if b else 0.0) if a else 0.0  # log-likelihood over chance
        weights[f] = min(6.0, odds) if odds > 1.5 and gain > chance else 0.0
    return Lexicon(weights)


@lru_cache(maxsize=1 << 16)
def _read(weight: float, own: tuple[str, ...], matches: bool) -> tuple:
    """What is kept of a word, one object for all words that are read alike, as most are."""
    return (weight, own), matches


def features(text: str, weight_of, kept: dict[str, tuple], names: tuple[str, ...] = tuple(TRANSDUCERS)) -> tuple[float, ...]:
    """(log of 1 + the weights of all matches, of those of each class but the first, the weightiest clause's weight, matched clauses to words). kept: what is known of words: weight, symbols, whether it can match."""
    lowered = text.lower()
    words = _WORD.findall(lowered)
    for w in set(words):
        if w not in kept:
            weight = weight_of(w)
            own = symbols(w, weight)
            kept[w] = _read(weight, tuple(own[n] for n in names), weight > 0 or w in THREATS)
    if not any([kept[w][1] for w in words]):
        return (0.0,) * len(PRIOR)
    machine = grammar(names)
    scores = [_walk([kept[w][0] for w in own], machine) for own in map(_WORD.findall, _CLAUSE.split(lowered)) if any([kept[w][1] for w in own])]
    matched = sum(any(s) for s in scores)
    by_class = [max(0.0, sum(c)) for c in zip(*scores, strict=True)]
    return math.log1p(sum(by_class)), *map(math.log1p, by_class[1:]), max(map(sum, scores)), matched / math.sqrt(len(words) + 1)


@dataclass
class Model:
    lexicon: Lexicon
    beta: tuple[float, ...]
    names: tuple[str, ...] = tuple(TRANSDUCERS)

    def probability(self, x: Iterable[float]) -> float:
        z = self.beta[0] + sum(b * v for b, v in zip(self.beta[1:], x, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Newton's method for a small logistic regression whose distance from the prior is penalised."""
    design = np.column_stack([np.ones(len(y)), x])
    prior = np.array([0.0, *PRIOR])
    beta = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (y - p) - ridge * (beta - prior) * len(y) / 100
        bend = (design * (p * (1 - p))[:, None]).T @ design + np.eye(len(beta)) * (ridge * len(y) / 100 + 1e-9)
        step = np.linalg.solve(bend, slope)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, beta))


def fit(texts: list[str], labels: list[int], names: tuple[str, ...] = tuple(TRANSDUCERS)) -> Model:
    """A model from labelled texts. The curve is fitted to scores of texts that the lexicon did not see: each half by the other's lexicon."""
    toxic = np.array(labels, dtype=float)
    if not len(toxic) or toxic.min() == toxic.max():
        rate = float(toxic.mean()) if len(toxic) else 0.0
        rate = min(max(rate, 1e-3), 1 - 1e-3)
        return Model(Lexicon(), (math.log(rate / (1 - rate)), *[0.0] * len(PRIOR)), names)
    known = Forms([set(_WORD.findall(t.lower())) for t in texts])
    x = np.zeros((len(texts), len(PRIOR)))
    for half in (0, 1):
        lexicon = learn_lexicon(known, [i for i in range(len(texts)) if i % 2 != half], toxic)
        kept: dict[str, tuple] = {}
        for i in range(half, len(texts), 2):
            x[i] = features(texts[i], lexicon.weight, kept, names)
    return Model(learn_lexicon(known, list(range(len(texts))), toxic), _logistic(x, toxic), names)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row's label stays unseen: crc32 of its id as text, mod 5, is 0. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def fit_from_labels(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """A model from at most max_labelled labelled rows that aren't held out; a null label or id is no label."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most max_labelled rows
    rows = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).orderBy("doc_id").toPandas()
    return fit(rows["text"].tolist(), [int(v > 0) for v in rows["toxic"]])


def _score(model: Model):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kept: dict[str, tuple] = {}
        for texts in batches:
            out = []
            for text in texts:
                if len(kept) > KEPT_WORDS:
                    kept.clear()
                out.append(model.probability(features(text, model.lexicon.weight, kept, model.names)))
            yield pd.Series(out, dtype=float)

    return F.pandas_udf(run, "double")


def score_toxicity(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """documents with score (0 to 1) and predicted (1 if score >= 0.5), which replace columns of those names.

    Only the text is an input, the whole of it; a null text counts as empty; equal texts score alike; an empty table gives one; nothing is shuffled.
    """
    scored = documents.withColumn("score", _score(model)(F.coalesce(F.col(text_col), F.lit(""))))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
