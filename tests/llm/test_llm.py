import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, mixing, nearby, pieces, quality, repeats, secrets, topk, toxicity, warc

DOCS = "doc_id long, text string, source string, lang string, score double"


def docs(spark, texts):
    """With a column whose name clashes with results."""
    return spark.createDataFrame([(i, t, f"src{(i or 0) % 3}", "en", 0.5) for i, t in texts], DOCS)


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "x" * 5000)]


# ---- op1


def brute_repeats(texts, n=50):
    first = {}
    for i, t in sorted(texts):
        b = (t or "").encode()
        for k in range(len(b) - n + 1):
            first.setdefault(b[k : k + n], i)
    out = {}
    for i, t in texts:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - n + 1):
            if first[b[k : k + n]] < i:
                gone[k : k + n] = [True] * n
        out[i] = bytes(x for x, g in zip(b, gone, strict=True) if not g), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
    return out


def test_repeats_are_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    words = ["alpha", "beta", "gämma", "δelta", "no", "of"]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, base = make(40), make(120)
    texts = [*ODD, (6, "x" * 5001), (7, base), (8, base), (9, base[:200] + "!" + base[200:]), (10, make(30) + shared + make(9)), (11, shared + make(60)), (12, "ab" * 90), (13, "ab" * 60), (14, make(5) + base[50:99]), (15, make(5) + base[50:100])]
    def same(**options):
        got = {r["doc_id"]: r for r in repeats.remove_repeats(docs(spark, texts), **options).collect()}
        for i, (left, n, spans) in brute_repeats(texts).items():
            assert (bytes(got[i]["kept"]), got[i]["n_removed"], got[i]["n_spans"]) == (left, n, spans), i

    same(group_bytes=2000, shard_bytes=2000)
    monkeypatch.setattr(repeats, "HOT_GROUPS", 2)
    monkeypatch.setattr(repeats, "BATCH", 3)
    monkeypatch.setattr(repeats, "STEP_BYTES", 700)
    same(group_bytes=1000, shard_bytes=3000)
    assert repeats.remove_repeats(docs(spark, texts).limit(0)).count() == 0


def test_repeats_of_repeated_and_null_ids(spark):
    long = "the same fifty bytes and some more of them, again and again and again"
    rows = docs(spark, [(5, long), (5, long), (None, long), (None, long), (7, "x" + long), (8, None)]).withColumns({"g": F.lit(1), "data": F.lit(2), "kept": F.lit(3)})
    got = Counter((r["doc_id"], r["n_removed"]) for r in repeats.remove_repeats(rows).collect())
    assert got == Counter([(5, 0), (5, 0), (None, len(long)), (None, len(long)), (7, len(long)), (8, 0)])


def test_suffix_family_is_batch_by_batch_brute_force():
    family, rng, seen = repeats.SuffixFamily(), np.random.default_rng(0), {}
    for batch in range(40):
        data = [rng.integers(97, 99, 54, dtype=np.uint8).tobytes() for _ in range(30)]
        suffix = np.array([d[i : i + 50] for d in data for i in range(5)], "S50")
        docs_ = np.sort(rng.integers(100 * batch, 100 * batch + 120, len(suffix)))
        for x, d in zip(suffix.tolist(), docs_.tolist(), strict=True):
            seen[x] = min(d, seen.get(x, d))
        assert family.add(suffix, docs_).tolist() == [seen[x] for x in suffix.tolist()]
        sizes = [len(a) for a, _ in family.levels]
        assert len(sizes) <= 8 and sizes == sorted(sizes, reverse=True) and sum(sizes) == len(seen)
        assert all((a[1:] > a[:-1]).all() for a, _ in family.levels)


# ---- op2


def test_topk_is_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-3, 4, 5).astype(float).tolist()) for i in range(300)]
    rows += [(1000, None), (1001, [1.0, None, 0.0, 0.0, 0.0]), (1002, [float("nan")] * 5), (1003, rows[0][1]), (1004, [float("inf")] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.exact_topk(df, df.filter("vec_id % 50 = 0"), k=7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = [(i, (np.floor(1024 * np.array(v))).astype(int)) for i, v in rows if v and None not in v and np.isfinite(v).all()]
    asked = [g for g in good if g[0] % 50 == 0]
    assert set(got) == {i for i, _ in asked}
    for i, q in asked:
        want = sorted((-int(q @ v), j) for j, v in good if j != i)[:7]
        assert [(j, s) for _, j, s in sorted(got[i])] == [(j, -s) for s, j in want]


def test_topk_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(400)]
    rows += [rows[3], rows[3], (None, rows[0][1]), (500, [1.0, 2.0]), (600, [1.0, 1.0]), (700, [0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "vec", "dim", "block", "score", "rank")})
    asked = df.filter("vec_id % 50 = 0 or vec_id = 3")
    got = {}
    for r in topk.exact_topk(df, asked, k=9).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    known = {i: q for i, q in rows if i is not None and (i % 50 == 0 or i == 3)}
    for i, q in known.items():
        want = sorted((-sum(int(1024 * a) * int(1024 * b) for a, b in zip(q, v, strict=True)), j) for j, v in rows if j is not None and j != i and len(v) == len(q))[:9]
        assert [(j, s) for _, j, s in sorted(got.pop(i))] == [(j, -s) for s, j in want]
    assert not got and topk.exact_topk(df.limit(0), asked).count() == 0 == topk.exact_topk(df, asked.limit(0)).count()


# ---- op3


def test_secrets(spark):
    key, shared = "AKIA" + "Z" * 16, "password=e3b3ed3cc8548923d6"
    texts = [*ODD, (10, f"é {shared} and {key}"), (11, shared), (12, shared), (13, 'token = "' + "a1" * 13 + '"'), (14, "secret: token = abcdefgh"), (15, "Api_Key=Ab3dEf6hIj9kLmNoPqRs"), (16, "x Zz9Zz9Zz9Zz9Zz9Zz9Zz9 y")]
    df = docs(spark, texts)
    got = {r["doc_id"]: r for r in secrets.secret_report(secrets.find_secrets(df, F.col("source"), F.col("source"))).collect()}
    assert (got[10]["n_assign"], got[10]["n_access"], got[10]["spans"].split(",")[0]) == (1, 1, "assign:2:29") and got[10]["n_live"] == 1
    assert got[11]["n_copied"] == 1 and got[14]["n_assign"] == 0 and got[13]["n_hex"] == 1 and got[16]["spans"] == "generic:2:23" and got[1]["spans"] == ""
    kept = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(df, F.col("source"), F.col("source")).collect()}
    assert kept[10] == f"é {shared} and [SECRET]" and kept[1] is None and kept[16] == "x [SECRET] y" and len(kept) == len(texts)


def test_secrets_of_repeats_and_empty_tables(spark):
    rows = docs(spark, [(1, "token=abcdef1"), (1, "token=abcdef1"), (1, "token=abcdef2"), (None, "token=abcdef1"), (None, None)]).withColumns({c: F.lit("mine") for c in ("spans", "row", "text_hash", "hash", "part")})
    found = secrets.find_secrets(rows, F.col("source"), F.col("source"))
    got = Counter((r["doc_id"], r["n_assign"]) for r in secrets.secret_report(found).collect())
    assert got == Counter([(1, 1)] * 3 + [(None, 1), (None, 0)])
    out = secrets.redact_secrets(rows, F.col("source"), F.col("source"))
    assert out.columns == rows.columns and Counter(r["text"] for r in out.collect()) == Counter({"[SECRET]": 4, None: 1})
    assert secrets.find_secrets(rows.limit(0), F.col("source"), F.col("source")).count() == 0


# ---- op4


def by_class(text, names=tuple(toxicity.TRANSDUCERS)):
    found = toxicity.clause_weights([(w, 2.0 if w == "idiot" else 0.0) for w in text.split()], names)
    return {c: v for c, v in zip(toxicity.CLASSES, found, strict=True) if v}


def test_grammar_classes():
    assert by_class("an idiot") == {"plain": 2.0} and by_class("idiot") == {} == by_class("the cat") == by_class("")
    assert by_class("you idiot") == by_class("idiot you") == {"addressed": 2.0} and by_class("the idiot saw an idiot") == {"plain": 4.0}
    assert by_class("not an idiot") == by_class("you are not an idiot") == {"negated": 2.0} and by_class("she said not an idiot") == {"reported": 2.0}
    assert by_class("i will kill you") == {"threat": 3.0} and by_class("kill the lights") == {} == by_class("kill a b c d you") and by_class("never kill you") == {"negated": 3.0}


def apart(tokens):
    """The five transducers one after the other: each writes a row for each word, and the rows are put together at the end."""
    total = dict.fromkeys(toxicity.CLASSES, 0.0)
    rows = {}
    for name, machine in toxicity.TRANSDUCERS.items():
        state, rows[name] = machine.start, []
        for word, weight in tokens:
            state, write = machine.table[state, toxicity.symbols(word, weight)[name]]
            rows[name].append(write)
    last = None
    for i, (_, weight) in enumerate(tokens if len(tokens) > 1 else []):
        if rows["target"][i].after_all and last and last[0] == "plain":
            total["plain"] -= last[1]
            total["addressed"] += last[1]
            last = None
        insult, threat = rows["insult"][i].insult, rows["threat"][i].threat
        if insult or threat:
            own = "reported" if rows["report"][i].reported else "negated" if rows["negation"][i].negated else "threat" if threat else "addressed" if rows["target"][i].addressed else "plain"
            total[own] += weight if insult else toxicity.THREAT_WEIGHT
            last = (own, weight) if insult else last
    return list(total.values())


def test_composed_machine_is_the_five():
    rng = random.Random(8)
    pool = ["idiot", "fool", "kill", "you", "her", "not", "never", "said", "the", "cat", "x" * 60]
    for _ in range(500):
        clause = [(w, 2.5 if w in ("idiot", "fool", "x" * 60) else 0.0) for w in rng.choices(pool, k=rng.randrange(0, 14))]
        assert np.allclose(toxicity.clause_weights(clause), apart(clause))


def test_each_transducer_decides_held_out_scores():
    """Texts whose label hangs on each transducer in turn: without it they are told apart less well."""
    rng = random.Random(3)
    fill = lambda n: " ".join(rng.choice("stone river lamp table window garden paper cloud".split()) for _ in range(n))
    toxic = [lambda: f"{fill(4)} you idiot {fill(3)}", lambda: f"{fill(3)} i will kill you {fill(2)}", lambda: f"{fill(3)} such an idiot {fill(4)}"]
    clean = [lambda: f"{fill(2)} not an idiot {fill(3)}", lambda: f"{fill(2)} she said an idiot {fill(2)}", lambda: f"{fill(2)} kill the lights {fill(4)}", lambda: f"{fill(3)} i will see you {fill(2)} such {fill(2)}", lambda: f"{fill(3)}. idiot. {fill(3)}"]
    pick = lambda y: rng.choice(toxic) if y else rng.choices(clean, [4, 4, 15, 76, 1])[0]
    rows = [(f"{fill(6)}. {pick(y)()}. {fill(5)}", y) for y in (int(rng.random() < 0.5) for _ in range(3000))]
    train, held = rows[:1800], rows[1800:]

    def loss(names):
        model, kept = toxicity.fit([t for t, _ in train], [y for _, y in train], names), {}
        p = [model.probability(toxicity.features(t, model.lexicon.weight, kept, names)) for t, _ in held]
        return -np.mean([np.log(max(1e-9, q if y else 1 - q)) for q, (_, y) in zip(p, held, strict=True)]), np.mean([(q >= 0.5) == y for q, (_, y) in zip(p, held, strict=True)])

    every = tuple(toxicity.TRANSDUCERS)
    whole, right = loss(every)
    assert right > 0.95
    for name in ("insult", "negation", "report", "threat"):
        assert loss(tuple(n for n in every if n != name))[0] > whole + 0.01, name
    # addressed insults differ from plain ones only where the labels make them differ
    rows = [(f"{fill(5)}. {fill(3)} {'you idiot' if y else 'the idiot'} {fill(3)}", y) for y in (i % 2 for i in range(1200))]
    train, held = rows[:800], rows[800:]
    kept = {}
    model = toxicity.Model(toxicity.Lexicon({"idiot": 2.0}), toxicity._logistic(np.array([toxicity.features(t, lambda w: 2.0 * (w == "idiot"), kept) for t, _ in train]), np.array([float(y) for _, y in train])))
    assert np.mean([(model.probability(toxicity.features(t, model.lexicon.weight, {})) >= 0.5) == y for t, y in held]) > 0.97
    alone = tuple(n for n in every if n != "target")
    assert len({toxicity.features(t, model.lexicon.weight, {}, alone) for t, _ in held}) == 1


def test_whole_documents_are_scored_by_the_five(spark):
    model = toxicity.Model(toxicity.Lexicon({"idiot": 2.0, "scum": 3.0}), (-2.0, 1.0, 0.3, 0.3, -0.5, -0.3, 0.1, 0.5))
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["Idiot", "scum", "you", "not", "said", "kill", "her", "the.", "cat;", "a\n", "b!"]) for _ in range(rng.randrange(0, 40))) for _ in range(60)]
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs(spark, list(enumerate(texts))), model).collect()}
    for i, text in enumerate(texts):
        clauses = [[(w, model.lexicon.weights.get(w, 0.0)) for w in re.findall(r"[a-z]+", c)] for c in re.split(r"[.!?;:\n]+", text.lower())]
        found = [apart(c) for c in clauses]
        sums = np.sum(found, axis=0)
        n = sum(map(len, clauses))
        x = [np.log1p(sums.sum()), *np.log1p(sums[1:]), max(map(sum, found)), sum(any(f) for f in found) / np.sqrt(n + 1)] if n else [0.0] * 7
        assert abs(got[i] - 1 / (1 + np.exp(-(model.beta[0] + np.dot(model.beta[1:], x))))) < 1e-9


def test_long_words_are_learned(spark):
    word = "zq" * 40
    texts = [f"{word} plain text {i}" if i // 2 % 2 else f"kind plain text {i}" for i in range(40)]
    model = toxicity.fit(texts, [i // 2 % 2 for i in range(40)])
    rows = docs(spark, [(1, f"some {word} here"), (1, f"some {word} here"), (2, "some kind words"), *ODD]).withColumn("predicted", F.lit("mine"))
    got = toxicity.score_toxicity(rows, model).collect()
    scores = {r["text"]: r["score"] for r in got}
    assert len(got) == 8 and scores[f"some {word} here"] > 0.5 > scores["some kind words"] and scores[""] == scores[None]
    assert toxicity.score_toxicity(rows.limit(0), model).count() == 0


def test_toxicity_held_out(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_from_labels(documents, labels, max_labelled=1500)
    rows = toxicity.score_toxicity(documents.join(labels.select("doc_id", "toxic"), "doc_id").filter(toxicity.held_out()), model).select("score", "predicted", "toxic").collect()
    hit = [r["predicted"] for r in rows if r["toxic"]]
    false = [r["predicted"] for r in rows if not r["toxic"]]
    assert np.mean(hit) > 0.75 and np.mean(false) < 0.03 and all(0 <= r["score"] <= 1 for r in rows)
    odd = toxicity.score_toxicity(docs(spark, ODD), toxicity.fit([], [])).select("score").collect()
    assert len(odd) == len(ODD)
    assert zlib.crc32(b"7") % 5 == spark.sql("SELECT crc32('7') % 5 AS r").first()["r"]


# ---- op5


def test_pieces_round_trip_and_best(spark):
    texts = [*ODD, (6, " leading  and ▁ literal\nline 漢字 🙂 "), (7, "the thing")]
    rows = {r["doc_id"]: r for r in pieces.encode(docs(spark, texts)).collect()}
    assert all(r["round_trip"] for r in rows.values()) and rows[1]["n_tokens"] == 0
    vocab = pieces.vocabulary(pieces.DEFAULT_MODEL)
    for i, t in texts:
        assert pieces.decode_ids(rows[i]["ids"], vocab) == (t or "")

    def best(word):  # plain dynamic programming
        score = [0.0] + [-1e300] * len(word)
        for e in range(1, len(word) + 1):
            for s in range(e):
                if word[s:e] in vocab.pieces:
                    score[e] = max(score[e], score[s] + vocab.pieces[word[s:e]][0])
            if word[e - 1] not in vocab.pieces:
                score[e] = max(score[e], score[e - 1] + pieces.BYTE_SCORE * len(word[e - 1].encode()))
        return score[-1]

    rng = random.Random(3)
    words = ["", "the", "thing", "things", "thedouon", "inha", "▁▁x", "漢字", "été"] + ["".join(rng.choice("aeinrstθ🙂é▁") for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    by_id = {i: s for s, i in vocab.pieces.values()}
    for w, ids in pieces.segment(words, vocab).items():
        assert abs(sum(by_id.get(i, pieces.BYTE_SCORE) for i in ids) - best("▁" + w)) < 1e-9


def test_a_byte_may_come_before_a_piece():
    class Small(pieces.Vocabulary):
        def __init__(self):
            self.pieces = {"▁": (-1.0, 0), "xy": (-5.0, 1), "yz": (-8.0, 2)}
            self.bytes, self.unknown = {ord("x"): 3, ord("y"): 4, ord("z"): 5}, 9
            self.build()

    assert pieces.segment(["xyz"], Small())["xyz"] == (0, 1, 5)


def test_pieces_repeats_long_texts_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(pieces, "BATCH_CHARS", 50)
    texts = [(1, "a b"), (1, "a b"), (None, "a b"), (2, "long word " * 5000)]
    rows = pieces.encode(docs(spark, texts).withColumn("ids", F.lit("mine")).withColumn("n_tokens", F.lit(0))).collect()
    same = [r["ids"] for r in rows if r["doc_id"] != 2]
    assert len(rows) == 4 and same[0] == same[1] == same[2] and all(r["round_trip"] for r in rows)
    assert pieces.encode(docs(spark, texts).limit(0)).count() == 0


# ---- op6


def test_quality_rules(spark):
    body = " ".join("w" + chr(97 + i % 26) + chr(97 + i // 26) for i in range(40))
    line = "The same footer of this host 12"
    texts = [*ODD, (6, body), (7, " ".join(["a b c d e f g h"] * 6)), *[(10 + 3 * i, f"{body} {'abcdef'[i]}\n{line}\n{line}") for i in range(6)], (40, f"short one\n{line}\n" + "\n".join([line] * 5))]
    rows = {r["doc_id"]: r for r in quality.quality_report(docs(spark, texts), F.col("source"), max_documents=3).collect()}
    assert rows[6]["kept"] and rows[7]["base_failed"] and rows[10]["kept"] and rows[10]["n_dup_lines"] == 1 and rows[10]["n_frequent_words"] == 14
    assert not rows[40]["kept"] and rows[1]["n_words"] == 0 and rows[7]["n_repeat_words"] == 48
    kept = {r["doc_id"]: r["text"] for r in quality.remove_frequent_lines(docs(spark, texts), F.col("source"), 3).collect()}
    assert kept[10] == f"{body} a" and kept[1] is None and kept[6] == body


def brute_quality(rows, max_documents, least_words=20, least_share=0.2):
    """Rows of (id, text, host): n_words, n_dup_lines, n_repeat_words, n_frequent_words, kept, text without frequent lines, for each."""
    import re

    split = lambda t: [w for w in re.split("[ \\t-\\r]+", t) if w]
    norm = lambda x: re.sub("[0-9]+", "0", " ".join(split(x)).lower())
    holds = Counter((h, n) for _, t, h in rows for n in {norm(x) for x in (t or "").split("\n") if split(x)})
    out = []
    for _, t, h in rows:
        lines, words = [x for x in (t or "").split("\n")], split(t or "")
        grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {i + j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(8)}
        gone = [bool(split(x)) and holds[h, norm(x)] > max_documents for x in lines]
        frequent = sum(len(split(x)) for x, g in zip(lines, gone, strict=True) if g)
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        left = len(words) - frequent
        kept = not failed and not (frequent and (left < least_words or left < least_share * len(words)))
        with_words = [x for x in lines if split(x)]
        text = None if t is None else "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        out.append((len(words), len(with_words) - len(set(with_words)), len(covered), frequent, kept, text))
    return out


def test_quality_is_brute_force(spark):
    rng = random.Random(11)
    phrases = [" ".join(rng.choice("Ab cd  eF 12 g7 hi\tjk".split(" ")) for _ in range(rng.randrange(1, 14))) for _ in range(12)] + ["", "  ", "Same 1", "same  22 "]
    texts = [(i, "\n".join(rng.choice(phrases) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    texts += [*ODD, (1, "alpha one\nbeta two"), (1, "alpha one\nbeta two"), (None, "left\nSame 1"), (None, "right\nSame 1"), (None, phrases[0])]
    df = docs(spark, texts).withColumns({"row": F.lit(1), "lines": F.lit(2), "at": F.lit(3)})
    want = brute_quality([(i, t, f"src{i % 3}" if i is not None else "srcnull") for i, t in texts], 3)
    host = F.coalesce(F.concat(F.lit("src"), F.col("doc_id") % 3), F.lit("srcnull"))
    got = quality.quality_report(df, host, max_documents=3)
    got = Counter((r["doc_id"], r["n_words"], r["n_dup_lines"], r["n_repeat_words"], r["n_frequent_words"], r["kept"]) for r in got.collect())
    assert got == Counter((i, *w[:5]) for (i, _), w in zip(texts, want, strict=True))
    left = Counter((r["doc_id"], r["text"]) for r in quality.remove_frequent_lines(df, host, 3).collect())
    assert left == Counter((i, w[5]) for (i, _), w in zip(texts, want, strict=True))
    assert quality.quality_report(df.limit(0), host).count() == 0 == quality.remove_frequent_lines(df.limit(0), host).count()


# ---- op7


def least_squares(tokens, p, targets, floor):
    """Projected gradient by brute force, over single documents."""
    a = (tokens[:, None] * p) / tokens.sum()
    r, size = np.full(len(a), max(1.0, floor)), 1 / np.linalg.eigvalsh(p.T @ a)[-1]
    for _ in range(20000):
        r = np.maximum(floor, r - size * (p @ (r @ a - targets)))
    return r @ a


@pytest.mark.parametrize("targets, floor, reachable", [([0.2, 0.5, 0.3], 0.0, True), ([0.9, 0.05, 0.05], 0.5, False), ([0.1, 0.6, 0.3], 1.0, False)])
def test_mixing_is_least_squares(spark, targets, floor, reachable):
    rng = np.random.default_rng(2)
    tokens, p = rng.integers(1, 100, 500), rng.dirichlet([2.0, 2.0, 2.0], 500)
    table = spark.createDataFrame([(i, int(t), q.tolist()) for i, (t, q) in enumerate(zip(tokens, p, strict=True))], "doc_id long, n_tokens long, posterior array<double>")
    steps, now = mixing.fit_rates(table, targets, floor)
    assert np.abs(now - least_squares(tokens, p, np.array(targets), floor)).max() < 2e-4
    assert (np.abs(now - targets).max() < 1e-5) == reachable
    rates = table.select("n_tokens", "posterior", mixing.rate(F.col("posterior"), steps).alias("r")).toPandas()
    assert rates["r"].min() >= floor
    assert np.allclose(sum(t * r * np.array(q) for t, r, q in zip(rates["n_tokens"], rates["r"], rates["posterior"], strict=True)) / tokens.sum(), now)
    assert mixing.fit_rates(table.limit(0), targets)[0].taken == ()


def test_mixing_of_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 8)], "doc_id long, quality int, toxic int")
    rows = docs(spark, [*ODD, (None, "lone words"), (4, "word"), (4, "other word")]).withColumns({"row": F.lit(1), "copies": F.lit(9), "text_hash": F.lit(0)})
    mixed, fit = mixing.fitted_mix(rows, labels, {"plain": 1.0, "good": 1.0}, None, 1.0)
    assert mixed.count() == rows.count() and fit.met
    out = mixing.mixed_documents(rows, mixed)
    assert out.columns == rows.columns and {(r["doc_id"], r["text"]) for r in out.collect()} == {(r["doc_id"], r["text"]) for r in rows.collect()}
    assert mixing.mix(rows.limit(0), labels, {"plain": 1.0}).count() == 0


# ---- op8


def brute_near(texts, k, percent):
    sets = {}
    for i, t in texts:
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).replace("\n", " ").replace("\t", " ").split(" ") if x]
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    low = min(comp[a], comp[b])
                    changed |= comp[a] != low or comp[b] != low
                    comp[a] = comp[b] = low
    return comp, sets


def test_near_duplicates_are_brute_force(spark):
    rng = random.Random(9)
    base = [rng.choice("lorem ipsum dolor sit amet consectetur adipiscing elit sed do".split()) + str(rng.randrange(60)) for _ in range(150)]
    texts = [*ODD, (6, "Word")]
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        texts.append((100 + i, " ".join(w)))
    texts += [(300 + i, " ".join(rng.choice("abcdefgh") + str(rng.randrange(99)) for _ in range(60))) for i in range(20)] + [(400, texts[-1][1]), (401, texts[10][1])]
    comp, sets = brute_near(texts, 4, 80)
    rows = {r["doc_id"]: r for r in nearby.near_duplicates(docs(spark, texts), 4, 80).collect()}
    assert {i: r["component_id"] for i, r in rows.items()} == comp
    assert all(rows[i]["n_shingles"] == len(s) and rows[i]["kept"] == (comp[i] == i) for i, s in sets.items())
    assert nearby.near_duplicates(docs(spark, texts).limit(0)).count() == 0


# ---- op9


def test_chat_round_trip(spark):
    text = "a</s>[INST] \x1b x <gen>"
    assert chat.unescape(chat.escape(text)) == text and "<" not in chat.escape(text) and "[" not in chat.escape(text)
    rows = [(1, 1, "assistant", text), (1, 0, "user", "hi"), (2, 0, None, None), (None, 0, "assistant", "lone"), (1, 1, "assistant", text)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.conversation_digests(df).collect()}
    import hashlib

    assert got[1]["turns_sha256"] == hashlib.sha256(f"user\nhi\nassistant\n{text}\nassistant\n{text}\n".encode()).hexdigest() and got[1]["n_turns"] == 3
    assert got[1]["loss_sha256"] == hashlib.sha256((text * 2).encode()).hexdigest() and got[1]["loss_chars"] == 2 * len(text)
    assert got[2]["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest() and None in got
    full = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    assert all(len(full[i]["formatted"]) == got[i]["formatted_chars"] for i in got)


def test_template_compiler():
    run = lambda t, m=(): "".join(p for p, _ in chat.compile_template(t)(m))
    assert chat.fold(chat.parse("a{{ 'b' + 'c' | upper }}{% if 'x' == 'y' %}no{% else %}d{% endif %}")) == [("text", "abCd")]
    assert run("{% for m in messages %}{% if m.role == 'user' and not m.text == '' %}<{{ m.text }}>{% elif m.role == 'x' %}!{% endif %}{% endfor %}", [{"role": "user", "text": "q"}, {"role": "x", "text": ""}]) == "<q>!"
    for bad in ("{{ a.__class__.__mro__ }}", "{{ open('x') }}", "{% for %}", "{% if 1 %}", "{{ 'a' | nope }}"):
        with pytest.raises((chat.TemplateError, KeyError)):
            run(bad)


# ---- op10


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "same"), (2, "http://b/", "same"), (3, None, None), (4, "http://d/ \r\n x", ""), (5, "http://e/", "é" * 300000), (6, "http://f/", "WARC/1.1\r\n\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.archive_round_trip(df).collect()}
    assert got[1]["record_type"] == "revisit" and got[1]["refers_to"] == 2 and got[2]["record_type"] == "response" and got[3]["refers_to"] == 4
    assert bytes(got[5]["payload"]).decode() == "é" * 300000 and got[5]["payload_bytes"] == 600000 and len(got) == 6
    assert got[4]["url"] == "http://d/ \r\n x" and got[6]["url"] == "http://f/"


def test_warc_sidecar_is_what_is_read(spark):
    import gzip

    rows = [(i, f"http://a/{i}%20é", f"<p>{i % 50}</p>" * (1 + 40000 * (i == 7))) for i in range(120)]
    chunks, index = warc.normalise_archives(warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), archive_bytes=9000))
    files = {}
    for r in sorted(chunks.collect(), key=lambda r: (r["archive"], r["seq"])):
        files[r["archive"]] = files.get(r["archive"], b"") + bytes(r["data"])
    told = sorted(index.collect(), key=lambda r: (r["archive"], r["offset"]))
    assert len(files) > 3 and len(told) == 120 and sum(r["length"] for r in told) == sum(map(len, files.values()))
    for r in told:
        fields, _ = warc.parse_record(gzip.decompress(files[r["archive"]][r["offset"] : r["offset"] + r["length"]]))
        assert (fields["warc-record-id"], fields["warc-type"], fields["warc-target-uri"]) == (r["record_id"], r["record_type"], r["target"])
    assert {(r["page_id"], r["url"]) for r in warc.read_records(chunks, index).collect()} == {r[:2] for r in rows}
    wrong = index.withColumn("offset", F.when(F.col("record_id") == "<urn:page:7>", F.col("offset") + 1).otherwise(F.col("offset")))
    with pytest.raises(Exception, match="(?i)error"):
        warc.read_records(chunks, wrong).collect()
    with pytest.raises(EOFError):
        list(warc.inflated(iter([files[told[0]["archive"]][:-9]])))


def test_warc_odd_rows(spark):
    rows = [(None, "u", "x"), (None, "u", "x"), (-1, None, "x"), (5, "v", "x"), (5, "v", "x"), (None, "w", "lone"), (None, "w", "lone"), (6, "", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"payload": F.lit(1), "archive": F.lit(2), "digest": F.lit(3)})
    got = Counter((r["page_id"], r["url"], r["record_type"], r["refers_to"]) for r in warc.archive_round_trip(df).collect())
    assert got == Counter([(None, "u", "revisit", 5)] * 2 + [(-1, "", "revisit", 5)] + [(5, "v", "response", None)] * 2 + [(None, "w", "response", None)] * 2 + [(6, "", "response", None)])
    small = Counter(r["record_type"] for r in warc.archive_round_trip(df, min_revisit_bytes=2).collect())
    assert small == Counter(response=8)
    assert warc.archive_round_trip(df.limit(0)).count() == 0


# ---- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.001"
    docs_ = spark.read.parquet(f"{sf}/documents.parquet")
    clean = c.remove_toxic(spark, docs_, sf)
    kept = c.remove_near_duplicates(spark, clean, sf)
    comp, _ = brute_near([(r["doc_id"], r["text"]) for r in clean.collect()], 5, 80)
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, x in comp.items() if i == x)
    masked = c.mask_secrets(spark, kept, sf)
    found = secrets.find_secrets(kept, F.col("source"), F.concat_ws("/", "source", "lang"))
    live = {r["doc_id"]: sorted((s["start"], s["stop"]) for s in r["spans"] if s["live"]) for r in found.collect()}

    def hidden(text, spans):
        out, at = "", 0
        for a, b in spans:
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        return out + text[at:]

    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert {r["doc_id"]: r["text"] for r in masked.collect()} == {i: t and hidden(t, live[i]) for i, t in texts.items()}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    _, fit = mixing.fitted_mix(masked, labels, c.WEIGHTS, None, c.FLOOR)
    assert fit.met and abs(fit.reached["plain"] / (fit.reached["plain"] + fit.reached["good"]) - 0.3) < 1e-3
    mixed = c.mix_sources(spark, masked, sf)
    times = Counter(r["doc_id"] for r in mixed.select("doc_id").collect())
    rates = {r["doc_id"]: r["rate"] for r in mixing.mix(masked, labels, c.WEIGHTS, None, c.FLOOR).collect()}
    assert mixed.columns == docs_.columns and set(times) == set(texts) and all(int(rates[i]) <= n <= int(rates[i]) + 1 for i, n in times.items())
    ids = {r["doc_id"]: r for r in c.encode_pieces(spark, mixed, sf).collect()}
    vocab = pieces.vocabulary(pieces.DEFAULT_MODEL)
    final = {r["doc_id"]: r["text"] for r in mixed.collect()}
    assert all(pieces.decode_ids(ids[i]["ids"], vocab) == (t or "") for i, t in final.items())


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.001"
    rows = [(i, t, "en", "s", 0) for i, t in [*ODD, (None, "lone words here"), (4, "word"), (None, None), (9, "key AKIA" + "Z" * 16), (10, "x" * 200000)]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.withColumns({n: F.lit("mine") for n in ("score", "predicted", "_id", "_hash", "_spans", "_copy", "row", "copies", "at", "component_id", "kept")})
    for name, stage in c.STAGES[:-1]:
        got, none = stage(spark, df, sf), stage(spark, df.limit(0), sf)
        assert got.columns == df.columns and none.count() == 0, name
        got = got.collect()
        assert all(r[n] == "mine" for r in got for n in df.columns[5:]), name
        assert {r["doc_id"] for r in got} == {r[0] for r in rows} and len(got) >= len(rows), name
        if name == "secrets":
            assert {r["doc_id"]: r["text"] for r in got}[9] == "key [SECRET]"
    assert c.encode_pieces(spark, df, sf).count() == len(rows)
