"""op11, op12 and op13 against brute force, on odd rows and on held-out rows; levels, long words and repeated ids of earlier operators."""

import hashlib
import heapq
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import alignment, dialogue, kernel, nearby, pieces, repeats

# ---- op11

TURNS = "conv_id long, turn long, role string, text string, cost string, key int"


def cheapest(codes):
    """(cost, audit) by Dijkstra's algorithm over (cost, letters)."""
    done, heap = {}, [(0, "", 0, 0)]
    while heap:
        cost, audit, i, s = heapq.heappop(heap)
        if (i, s) in done:
            continue
        done[i, s] = cost, audit
        for letter, price, to in dialogue._arcs(codes, dialogue.GOAL)[4 * i + s]:
            if letter:
                heapq.heappush(heap, (cost + price, audit + letter, to // 4, to % 4))
    return min(done[len(codes), 0], done[len(codes), 3])


def in_segments(codes):
    ends = {p: e for _, p, e in dialogue._priced(("k", i + 1, c) for i, c in reversed(list(enumerate(codes))))}
    stream = [("k", 0, *[None] * 6)]
    for i, c in enumerate(codes, 1):
        stream += [("k", 1, ends[i], *[None] * 5)] if i in ends else []
        stream.append(("k", 2, None, i, {"s": "system", "u": "user", "a": "assistant"}.get(c.lower(), "x"), "t", None, c))
    return next(dialogue._repaired(iter(stream)))[6:8]


@pytest.mark.parametrize("segment", [2, 5, 64])
def test_auction_finds_the_least_cheapest_edits(monkeypatch, segment):
    monkeypatch.setattr(dialogue, "SEGMENT", segment)
    rng = random.Random(segment)
    for _ in range(150):
        codes = "".join(rng.choice("uaUAsSxXd" + "uaua" * 2) for _ in range(rng.randrange(1, 14)))
        assert in_segments(codes) == cheapest(codes), codes


def test_converged_prices_bound_every_arc():
    arcs = dialogue._arcs("uaXdsUAau", dialogue.GOAL)
    prices = dialogue.auction(arcs, (0, 1, 2, 3))
    assert all(prices[node] <= cost + prices[to] for node, own in enumerate(arcs) for _, cost, to in own)
    assert prices[0] == cheapest("uaXdsUAau")[0]


def test_odd_conversations_are_repaired(spark, monkeypatch):
    monkeypatch.setattr(dialogue, "SEGMENT", 3)
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 0, "assistant", "Yes."), (2, None, None, None), (3, 5, "user", "cut"), (3, 7, "assistant", "x" * 200_000 + "."),
        (None, 0, "user", "Who?"), (None, 0, "user", "Who?"), (None, 1, "tool", "ok."), (4, 0, "", ""), *[(5, t, "user" if t % 2 == 0 else "assistant", f"n{t}.") for t in range(40)],
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS)
    got = {r["conv_id"]: r for r in dialogue.repair(df).collect()}
    assert (got[1]["cost"], got[1]["audit"]) == (0, "KK") and got[1]["repaired_sha256"] == hashlib.sha256(b"user:Hi.\nassistant:Yes.").hexdigest()
    assert (got[2]["blank"], got[2]["cost"], got[2]["audit"], got[2]["gaps"]) == (1, 7, "DIK", 0)  # a null turn comes first
    assert (got[3]["gaps"], got[3]["truncated"], got[3]["cost"], got[3]["audit"]) == (1, 1, 3, "KK")
    assert (got[None]["duplicate"], got[None]["illegal"], got[None]["cost"], got[None]["audit"]) == (1, 2, 7, "KDR")
    assert (got[4]["cost"], got[4]["audit"], got[4]["repaired_sha256"]) == (4, "D", hashlib.sha256(b"").hexdigest())
    assert (got[5]["cost"], got[5]["audit"]) == (0, "K" * 40)
    assert dialogue.repair(df.limit(0)).count() == 0
    more = spark.createDataFrame([(9,), (1,)], "conv_id long")
    left = {r["conv_id"]: r for r in dialogue.repair(df.filter("conv_id = 1"), more).collect()}
    assert set(left) == {1, 9} and (left[9]["audit"], left[9]["cost"], left[9]["repaired_sha256"]) == ("", 0, hashlib.sha256(b"").hexdigest())


def test_damage_follows_the_checksum(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(20) for t in [0, 1, 2, None]]
    got = Counter((r["conv_id"], r["turn"], r["role"], r["text"]) for r in dialogue.damage(spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS)).collect())
    want = Counter()
    for c, t, role, text in rows:
        fate = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        text = "" if fate == 1 else "One Two" if fate == 2 else text
        want[c, t, "user" if fate == 4 else role, text] += {0: 0, 3: 2}.get(fate, 1)
    assert got == +want


# ---- op12


def test_statistics_do_not_depend_on_the_block():
    rng = random.Random(1)
    words = ["a", "Bee", "SHOUT!!", "x|y", "42", "é.", "ünd", "#tag"]
    texts = ["", " \n ", *[" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))).replace("é. ", "é.\n") for _ in range(40)], "z" * 50_000, "\n lead", "same same same"]
    together = kernel.text_statistics(texts)
    assert np.isfinite(together).all() and not together[:2].any()
    assert np.array_equal(together, np.concatenate([kernel.text_statistics([t]) for t in texts]))
    last = dict(zip(kernel.NAMES, together[-1], strict=True))
    assert abs(last["distinct_words"] - 1 / 3) < 1e-12 and abs(last["repeated_next"] - 2 / 3) < 1e-12 and abs(last["repeated_pairs"] - 1 / 3) < 1e-12
    for text, own in zip(texts, together, strict=True):
        split, got = text.split(), dict(zip(kernel.NAMES, own, strict=True))
        if split:
            assert abs(got["distinct_words"] - len(set(split)) / len(split)) < 1e-12 and abs(got["top_word"] - max(Counter(split).values()) / len(split)) < 1e-12
            lines = [x.split() for x in text.split("\n") if x.split()]
            assert abs(got["repeated_lines"] - (1 - len({tuple(x) for x in lines}) / len(lines))) < 1e-12
            odd = [any(c in "#*$%&|<>" for c in w) or w.endswith("!!") or (i > 0 and split[i - 1] == w) for i, w in enumerate(split)]
            assert abs(got["worst_window"] - max(sum(odd[max(0, i - 19) : i + 1]) for i in range(len(split))) / min(20, len(split))) < 1e-12


def test_curve_is_the_isotonic_fit():
    rng = np.random.default_rng(3)
    at, n = np.arange(12.0), rng.integers(1, 9, 12)
    ones = np.minimum(n, rng.integers(0, 9, 12))
    x, y = kernel.pooled(at, n, ones)
    assert (np.diff(y) > 0).all() and (np.diff(x) > 0).all()
    # min-max formula of the isotonic regression
    share = lambda i, j: ones[i : j + 1].sum() / n[i : j + 1].sum()
    fitted = {round(max(min(share(i, j) for j in range(k, 12)) for i in range(k + 1)), 12) for k in range(12)}
    assert fitted == {round(v, 12) for v in y}


def quality_rows(spark, n=600):
    rng, rows = random.Random(7), []
    for i in range(n):
        words = [rng.choice("river stone morning quiet people walk along".split()) + rng.choice("abcdefg") for _ in range(rng.randrange(30, 90))]
        good = i % 4 > 0
        rows.append((i, " ".join(words) + "." if good else " | ".join(words), int(good)))
    docs = spark.createDataFrame([(i, t, "s", 0.5, True) for i, t, _ in rows], "doc_id long, text string, source string, score double, held_out boolean")
    return docs, spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int"), {i: q for i, _, q in rows}


def test_normal_equations_are_those_of_one_table(spark):
    docs, labels, _ = quality_rows(spark, 200)
    stats = kernel.statistics(docs.repartition(7))
    model = kernel.fit(stats, labels, features=16)
    rows = stats.filter("not held_out").join(labels, "doc_id").collect()
    x, y = np.array([r["stats"] for r in rows]), np.array([float(r["quality"]) for r in rows])
    z = model.features(x)
    fits = [np.linalg.solve(z.T @ z + np.diag([p * len(y)] * 16 + [0.0]) + 1e-12 * np.eye(17), z.T @ y) for p in kernel.PENALTIES]
    assert min(np.abs(z @ (w - model.weights)).max() for w in fits) < 1e-6


def test_held_out_rows_are_told_apart(spark):
    docs, labels, truth = quality_rows(spark)
    stats = kernel.statistics(docs)
    model = kernel.fit(stats, labels)
    rows = [r for r in kernel.score(stats, model).collect() if r["held_out"]]
    assert len(rows) > 80 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in rows) / len(rows) > 0.97


def test_odd_rows_are_scored(spark):
    rows = [(1, None), (2, ""), (None, "word"), (3, "x" * 200_000), (4, "good words here."), (4, "good words here."), (6, "bad | bad")]
    docs = spark.createDataFrame([(i, t, 1.0, 2) for i, t in rows], "doc_id long, text string, score double, stats int")
    labels = lambda *own: spark.createDataFrame(list(own), "doc_id long, quality int")
    stats = kernel.statistics(docs)
    for known, want in ((labels(), 0.5), (labels((4, 1), (None, 0), (6, None)), 1.0)):
        got = kernel.score(stats, kernel.fit(stats, known)).collect()
        assert len(got) == len(rows) and all(abs(r["score"] - want) < 0.01 for r in got)
        assert [r["held_out"] for r in got if r["doc_id"] is None] == [True]
    both = kernel.score(stats, kernel.fit(stats, labels((4, 1), (6, 0), (3, 0)))).collect()
    assert len({r["score"] for r in both if r["doc_id"] == 4}) == 1 and all(0 <= r["score"] <= 1 for r in both)
    empty = kernel.statistics(docs.limit(0))
    assert kernel.score(empty, kernel.fit(empty, labels((4, 1)))).count() == 0


# ---- op13


def brute_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    left = Tokenizer.from_file(alignment.BYTE_LEVEL)
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES)
    bytes_a, bytes_b = (alignment.vocabulary(p).bytes.to_pylist() for p in (alignment.BYTE_LEVEL, alignment.PIECES))
    found, counts = [], Counter()
    for text in texts:
        whole = f" {text or ''}".encode()
        a, b = left.encode(f" {text or ''}", add_special_tokens=False).ids, right.encode(text or "")
        if not text or b"".join(bytes_a[i] for i in a) != whole or b"".join(bytes_b[i] for i in b) != whole:
            found.append((0, 0, [], []))
            continue
        ends_a, ends_b = (np.cumsum([len(spelled[i]) for i in ids]).tolist() for ids, spelled in ((a, bytes_a), (b, bytes_b)))
        groups, before = [], -1
        for cut in sorted(set(ends_a) & set(ends_b)):
            groups.append(([i for i, e in zip(a, ends_a, strict=True) if before < e <= cut], [i for i, e in zip(b, ends_b, strict=True) if before < e <= cut]))
            before = cut
        links = [(x[-1], y[-1]) for x, y in groups]
        counts.update(links)
        found.append((len(a), len(b), groups, links))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    text_of = lambda groups: ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    return [
        (n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text_of(groups).encode()).hexdigest() if links else "")
        for n_a, n_b, groups, links in found
    ]


@pytest.mark.parametrize("few", [True, False])
def test_alignment_is_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(alignment, "BLOCK_CHARS", 300)
    if not few:
        monkeypatch.setattr(alignment, "BROADCAST_PAIRS", 3)
        monkeypatch.setattr(alignment, "KEPT_PAIRS", 20)
    rng = random.Random(2)
    odd = [None, "", " ", "\n\n\t x", "naïve Straße — 東京 🙂 <s> </s> <|endoftext|> <0x41> [INST]", "a▁b", "x" * 20_000, " " * 3000, "\x00\x85 ", "é ﬁ"]
    texts = odd + [" ".join(rng.choice(["the", "tokenization", "über", "don't", "12345", "…", "của"]) for _ in range(rng.randrange(1, 80))) for _ in range(30)] + ["again"] * 3
    docs = spark.createDataFrame([(i if i else None, t, 1, 2, 3) for i, t in enumerate(texts)], "doc_id long, text string, row int, pair int, n int")
    columns = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    got = {r["doc_id"]: tuple(r[c] for c in columns) for r in alignment.alignment_report(docs).collect()}
    assert [got[i or None] for i in range(len(texts))] == brute_alignment(texts)
    assert alignment.alignment_report(docs.limit(0)).count() == 0


def test_byte_level_ids_are_the_files_own():
    from tokenizers import Tokenizer

    own, vocab = Tokenizer.from_file(alignment.BYTE_LEVEL), alignment.vocabulary(alignment.BYTE_LEVEL)
    own.encode_special_tokens = True
    points = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}1{c} {c}b{c}{c}!{c}" for c in points]
    assert vocab.encode(texts).to_pylist() == [x.ids for x in own.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]


# ---- earlier operators


@pytest.mark.parametrize("ratio", [0, 8, 10**9])
def test_levels_stay_few_when_batches_shrink(monkeypatch, ratio):
    monkeypatch.setattr(repeats, "MERGE_RATIO", ratio)
    family, rng, seen = repeats.SuffixFamily(), np.random.default_rng(1), {}
    for batch in range(60):
        own = np.array([rng.integers(97, 123, 50, dtype=np.uint8).tobytes() for _ in range(300 - 4 * batch)] + list(seen)[:20], "S50")
        docs = np.full(len(own), batch)
        for x in own.tolist():
            seen.setdefault(x, batch)
        assert family.add(own, docs).tolist() == [seen[x] for x in own.tolist()]
        sizes = [len(a) for a, _ in family.levels]
        assert sum(sizes) == len(seen) and len(sizes) <= np.log2(len(seen)) + 1 and all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
    assert len(family.levels) <= 6


def test_a_word_of_a_million_characters_takes_seconds():
    import time

    vocab = pieces.vocabulary(pieces.DEFAULT_MODEL)
    rng = random.Random(0)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789+/", k=1_000_000))
    began = time.time()
    (ids,) = pieces._ids([text], vocab)
    assert time.time() - began < 30 and pieces.decode_ids(ids, vocab) == text


def test_near_duplicates_of_ids_that_stand_for_several_texts(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "quite another text of its own with some words"), (1, base + " x y z"), (2, base), (2, base), (3, None), (3, "alone here with a few more words"), (None, base), (7, base + " x")]
    df = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, row int, kept boolean")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in nearby.near_duplicates(df, 4, 80).collect())
    want = Counter([(1, 6, 1, True), (1, 60, 1, True), (2, 57, 1, False), (2, 57, 1, False), (3, 0, 3, True), (3, 4, 3, True), (None, 57, None, True), (7, 58, 1, False)])
    assert got == want


def test_chat_of_long_conversations_empty_tables_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    from tessera.llm import chat

    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t} [INST] </s> é") for t in range(3000)] + [(2, 0, "assistant", None), (2, 0, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"n_turns": F.lit("x"), "loss_chars": F.lit(None).cast("string"), "formatted": F.lit(3)})
    got = {r["conv_id"]: r for r in chat.conversation_digests(df).collect()}
    said = "".join(t for _, _, role, t in rows[:3000] if role == "assistant")
    assert got[1]["n_turns"] == 3000 and got[1]["loss_chars"] == len(said) and got[1]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert got[1]["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for _, _, role, t in rows[:3000]).encode()).hexdigest()
    assert (got[2]["n_turns"], got[2]["loss_chars"]) == (2, 0) and got[2]["loss_sha256"] == hashlib.sha256(b"").hexdigest()
    assert chat.conversation_digests(df.limit(0)).count() == 0
