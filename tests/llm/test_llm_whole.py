"""Operators do their whole job, and say where they can't."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing, nearby

# ---- op7, pipeline


def test_mixing_stage_tells_what_it_reached(spark):
    import corpus_pipeline as c

    good, plain = "clear careful prose explains its subject well", "buy cheap stuff now click here"
    texts = [(i, f"{plain if i % 8 == 0 else good} n{i}") for i in range(80)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 8 != 0), 0) for i in range(80)], "doc_id long, quality int, toxic int")
    weights, budget = {"plain": 0.7, "good": 0.28, "toxic": 0.02}, 1.15
    rows, fit = mixing.fitted_mix(docs, labels, weights, budget, 1.0)
    total = rows.agg(F.sum("n_tokens")).first()[0]
    for i, d in enumerate(mixing.DOMAINS):
        tokens = rows.agg(F.sum(F.col("rate") * F.col("n_tokens") * F.get("posterior", F.lit(i)))).first()[0]
        assert abs(fit.reached[d] - tokens / total) < 1e-9 and abs(fit.targets[d] - weights[d] * budget) < 1e-9
    assert fit.residual["good"] > 0.3 and not fit.met and fit.converged
    # at rates of 1 or more, good can't fall below what came in
    assert fit.reached["good"] >= rows.agg(F.sum(F.col("n_tokens") * F.get("posterior", F.lit(1)))).first()[0] / total - 1e-9
    with pytest.MonkeyPatch.context() as m, pytest.warns(c.MissedTargets, match="good .* of "):
        m.setattr(c, "table", lambda *_: labels)
        m.setattr(mixing, "MARGIN", 0.5)
        c.mix_sources(spark, docs, "")


# ---- op8


def test_long_lists_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(nearby, "BLOCK", 8)
    label = lambda i: 1 if i % 3 == 0 else 5 + i % 2 if i % 5 == 0 else i + 1000
    rows = [(k, i, 9, b"m", label(i)) for k, size in ((1, 200), (2, 5)) for i in range(size)]
    parts = {}
    for r in nearby._dealt(spark.createDataFrame(rows, "key long, doc long, n int, marks binary, label long")).collect():
        parts.setdefault((r["key"], r["part"]), []).append(r)
    assert max(map(len, parts.values())) <= 48 and len([p for p in parts if p[0] == 1]) > 20
    met = Counter()
    for (key, _), own in parts.items():
        for i, a in enumerate(own):
            for b in own[:i]:
                if a["label"] != b["label"] and (a["side"] == 0 or a["side"] != b["side"]):
                    met[key, min(a["doc"], b["doc"]), max(a["doc"], b["doc"])] += 1
    want = {(k, i, j) for k, size in ((1, 200), (2, 5)) for j in range(size) for i in range(j) if label(i) != label(j)}
    assert set(met) == want and set(met.values()) == {1}


def test_long_lists_give_the_same_pairs_and_groups(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    texts = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.randrange(2, 14)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        texts.append((i, " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    sets = docs.select(F.col("doc_id").cast("string"), nearby.shingles(F.col("text"), 4).alias("shingles"))
    signed = sets.mapInPandas(nearby._signed, "doc_id string, n int, set_key binary, signature array<long>").select(F.col("doc_id").cast("long").alias("doc"), "n", "signature")
    lists = nearby.stored(nearby._postings(signed), "postings")
    star = lambda: {tuple(r) for r in nearby._star(lists, 80).collect()}
    groups = lambda: {r["doc_id"]: r["component_id"] for r in nearby.near_duplicates(docs, 4, 80).collect()}
    want_star, want = star(), groups()
    monkeypatch.setattr(nearby, "LIST", 6)
    monkeypatch.setattr(nearby, "BLOCK", 3)
    assert want_star and star() == want_star and groups() == want
