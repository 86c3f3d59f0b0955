"""Near-duplicate documents by an inverted join of MinHash signatures.

Documents of one shingle set form a class; its smallest document stands for it. A representative is posted under its
coordinate-value pairs. Two signatures that agree in at least LEAST of N coordinates must share one of each one's N - LEAST + 1
rarest pairs, so each document is posted under that prefix only: values that many documents hold are skipped, and values that one
document holds fill prefixes without posting anything. Within a list, the signatures that travel with the postings are
compared, which counts all collisions, and pairs below LEAST are dropped where they stand.

Lists of near copies would give all their pairs. In the first round a document is paired in each list with two documents only, the list's first and its most
central one, and of these keeps the nearest and the one that most documents are paired with; in the second, all pairs of a list whose documents the confirmed links of the first have not
joined. A link's common part is so large that the rarest shingles of both, counted among the documents still open, must share one within a prefix whose
length the two sizes give; pairs that don't are dropped without loss.
No task holds a long list: in the first round its two leaders are found by aggregation and joined back to its rows; in the second its rows
are dealt into blocks, and each pair of blocks is a part of its own.
Every link is confirmed on the full shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let, stored, words
from tessera.llm.components import components

#: Coordinates of a signature, and collisions that a pair must have. At a similarity of 0.8, a pair of 64 coordinates has 51 on average,
#: with a deviation of 3.2: 38 lie four deviations below.
N, LEAST = 64, 38
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a list that one task holds at most in the first round, and rows of a block in the second, where rows carry shingles.
LIST, BLOCK = 4096, 1024
#: Documents of a list that are compared at once with all others.
ROWS = 512
#: Ids of documents that are broadcast at most (8 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Parts that the copies of one set are dealt to when they get their component.
PARTS = 16
NO_KEY = np.iinfo(np.int64).max

_RNG = np.random.default_rng(20240229)
_MUL = _RNG.integers(1, 2**63, N, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 2**63, N, dtype=np.uint64)


def shingles(text: Column, k: int) -> Column:
    """Hashes of the distinct k-word shingles of a text: A-Z in lower case; with fewer words than k the whole sequence is one; empty without words."""
    own = words(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER))

    def grams(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(hashes) - (k - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(hashes, i, k)))

    def of(hashes: Column) -> Column:
        return F.when(F.size(hashes) == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(grams(hashes)))

    return let(F.transform(own, lambda w: F.xxhash64(w)), of)


def signature(hashes: np.ndarray) -> np.ndarray:
    """N smallest values of a set, each under its own multiply-shift hash (32 bits)."""
    out = np.full(N, np.iinfo(np.uint32).max, np.uint32)
    x = hashes.view(np.uint64)
    for at in range(0, len(x), 2048):
        mixed = x[at : at + 2048, None] * _MUL + _ADD
        mixed ^= mixed >> np.uint64(29)
        out = np.minimum(out, ((mixed * _MUL) >> np.uint64(32)).astype(np.uint32).min(axis=0))
    return out


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Size, key and signature of each set."""
    for pdf in batches:
        rows = []
        for doc, own in zip(pdf["doc_id"], pdf["shingles"], strict=True):
            own = np.sort(np.asarray(own, dtype=np.int64))
            rows.append((doc, len(own), hashlib.blake2b(own.tobytes(), digest_size=16).digest(), signature(own).astype(np.int64) if len(own) else None))
        yield pd.DataFrame(rows, columns=["doc_id", "n", "set_key", "signature"])


def first_common(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The smallest key that stands in both rows, row by row."""
    out = np.full(len(p), NO_KEY, np.int64)
    for at in range(0, len(p), 4096):
        x, y = p[at : at + 4096], q[at : at + 4096]
        both = (x[:, :, None] == y[:, None, :]).any(axis=2)
        out[at : at + 4096] = np.where(both, x, NO_KEY).min(axis=1)
    return out


def central(marks: np.ndarray) -> int:
    """The row that agrees most with the commonest value of each column."""
    common = np.array([np.bincount(c).argmax() for c in marks.T], np.uint8)
    return int((marks == common).sum(axis=1).argmax())


def _links(first_only: bool, percent: int):
    """Pairs (a, b, collisions) of each part of a list, of rows sorted by list, part and document: with the first and the central one of the list, or all of different labels.

    side: 0 where the part is one block, else 1 or 2, and pairs are of rows of both sides.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if held:
                pdf = pd.concat([*held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            key, part = pdf["key"].to_numpy(), pdf["part"].to_numpy()
            changes = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1]))
            cut = int(changes[-1]) + 1 if len(changes) else 0  # the last list may go on
            held = [pdf.iloc[cut:]]
            if cut:
                yield pairs(pdf.iloc[:cut])
        for pdf in held:
            yield pairs(pdf)

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        key, part, side, doc, n, label = (pdf[c].to_numpy(np.int64) for c in ("key", "part", "side", "doc", "n", "label"))
        marks = np.frombuffer(b"".join(pdf["marks"]), np.uint8).reshape(len(pdf), N)
        begin = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])))
        size = np.diff(np.append(begin, len(key)))
        posted = np.full((len(pdf), N), NO_KEY, np.int64)
        rare = None if first_only else pdf["rare"].tolist()
        if not first_only:
            for i, own in enumerate(pdf["posted"]):
                posted[i, : len(own)] = own
            posted = posted[:, : max(1, int((posted != NO_KEY).sum(axis=1).max()))]
        a, b, c = [], [], []

        def keep(x: np.ndarray, y: np.ndarray) -> None:
            near = (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & (label[x] != label[y])
            x, y = x[near], y[near]
            for at in range(0, len(x), 1 << 16):
                p, q = x[at : at + (1 << 16)], y[at : at + (1 << 16)]
                equal = (marks[p] == marks[q]).sum(axis=1)
                hit = equal >= LEAST
                if not first_only and hit.any():
                    p, q, equal = p[hit], q[hit], equal[hit]
                    hit = first_common(posted[p], posted[q]) == key[p]  # a pair is given by one of its lists
                    for i in np.flatnonzero(hit).tolist():
                        u, v = int(p[i]), int(q[i])
                        common = -(-percent * int(n[u] + n[v]) // (100 + percent))  # what a link has in common at least
                        hit[i] = not set(rare[u][: n[u] - common + 1].tolist()).isdisjoint(rare[v][: n[v] - common + 1].tolist())
                a.append(doc[p[hit]])
                b.append(doc[q[hit]])
                c.append(equal[hit])

        if first_only:
            middle = begin.copy()
            for i in np.flatnonzero(size > 2).tolist():
                middle[i] += central(marks[begin[i] : begin[i] + size[i]])
            for leader in (np.repeat(begin, size), np.repeat(middle, size)):
                rest = np.flatnonzero(leader != np.arange(len(key)))
                keep(leader[rest], rest)
        else:
            for s, m in zip(begin.tolist(), size.tolist(), strict=True):
                if m > 1:
                    for at in range(0, m - 1, ROWS):
                        rows, cols = np.arange(s + at, s + min(at + ROWS, m)), np.arange(s + at, s + m)
                        x, y = np.repeat(rows, len(cols)), np.tile(cols, len(rows))
                        upper = (x < y) & (label[x] != label[y]) & ((side[x] == 0) | (side[x] != side[y]))
                        keep(x[upper], y[upper])
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return pd.DataFrame({"a": join(a), "b": join(b), "collisions": join(c)}).drop_duplicates()

    return run


def _postings(signed: DataFrame) -> DataFrame:
    """key, doc, n, marks (the last byte of each coordinate): each representative under its rarest coordinate-value pairs."""
    pairs = signed.select("doc", F.posexplode("signature").alias("i", "value")).select("doc", F.xxhash64("i", "value").alias("key"))
    shared = pairs.groupBy("key").agg(F.count("*").alias("times")).filter(F.col("times") > 1)
    known = pairs.join(shared, "key").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("times", "key"))).alias("known"))
    # values that one document holds come first in its order: they fill its prefix and post nothing
    left = F.size("known") - F.lit(N - (N - LEAST + 1))
    prefix = known.filter(left > 0).select("doc", F.explode(F.slice("known", F.lit(1), left)).alias("x")).select("doc", "x.key")
    marks = signed.select(F.col("doc").alias("_doc"), "n", F.unhex(F.array_join(F.transform("signature", lambda v: F.lpad(F.hex(v.bitwiseAND(255)), 2, "0")), "")).alias("marks"))
    return prefix.join(marks, F.col("doc") == F.col("_doc")).select("key", "doc", "n", "marks")


def _few(rows: DataFrame) -> DataFrame:
    """rows, broadcast if they are not too many; beyond it both sides of their join are shuffled."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def _candidates(lists: DataFrame, first_only: bool, percent: int) -> DataFrame:
    sorted_lists = lists.repartition("key", "part").sortWithinPartitions("key", "part", "doc").select("key", "part", "side", "doc", "n", "label", "marks", *([] if first_only else ["posted", "rare"]))
    return sorted_lists.mapInPandas(_links(first_only, percent), "a long, b long, collisions long")


def _bytes(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), N)


def _tallied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How often each list has each value of each column of marks, batch by batch."""
    for pdf in batches:
        for key, own in pdf.groupby("key"):
            marks = _bytes(own["marks"])
            times = np.bincount((np.arange(N) * 256 + marks).ravel(), minlength=N * 256)
            at = np.flatnonzero(times)
            yield pd.DataFrame({"key": key, "i": at // 256, "value": at % 256, "times": times[at]})


def _agreeing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(collisions=(_bytes(pdf["marks"]) == _bytes(pdf["common"])).sum(axis=1)).drop(columns="common")


def _colliding(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf = pdf.assign(collisions=(_bytes(pdf["ma"]) == _bytes(pdf["mb"])).sum(axis=1))
        yield pdf.loc[pdf["collisions"] >= LEAST, ["a", "b", "collisions"]]


def _led(rows: DataFrame, percent: int) -> DataFrame:
    """The pairs of the first round from rows of long lists: leaders are found by aggregation and joined back, so no task holds a list."""
    times = rows.select("key", "marks").mapInPandas(_tallied, "key long, i int, value int, times long").groupBy("key", "i", "value").agg(F.sum("times").alias("times"))
    commonest = times.groupBy("key", "i").agg(F.max_by("value", F.struct("times", -F.col("value"))).alias("value"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "value")))  # N values
    common = commonest.groupBy("key").agg(F.unhex(F.array_join(F.transform(ordered, lambda v: F.lpad(F.hex(v["value"]), 2, "0")), "")).alias("common"))
    common = stored(common, "common-marks")
    placed = rows.select("key", "doc", "n", "marks").join(_few(common), "key").mapInPandas(_agreeing, "key long, doc long, n int, marks binary, collisions long")
    row = F.struct("doc", "n", "marks")
    leaders = placed.groupBy("key").agg(F.min_by(row, "doc").alias("low"), F.max_by(row, F.struct("collisions", -F.col("doc"))).alias("middle"))
    leaders = stored(leaders.select("key", F.explode(F.array_distinct(F.array("low", "middle"))).alias("x")), "leaders")
    met = rows.join(_few(leaders), "key").filter(F.col("doc") != F.col("x.doc"))
    near = met.filter(100 * F.least("n", "x.n") >= percent * F.greatest("n", "x.n"))
    pairs = near.select(F.col("x.doc").alias("a"), F.col("doc").alias("b"), F.col("x.marks").alias("ma"), F.col("marks").alias("mb"))
    return pairs.mapInPandas(_colliding, "a long, b long, collisions long")


def _star(lists: DataFrame, percent: int) -> DataFrame:
    """The pairs of the first round."""
    rows = lists.withColumns({"label": F.col("doc"), "part": F.lit(0), "side": F.lit(0)})
    long = stored(lists.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > LIST).select("key"), "long-lists")
    if not long.limit(1).count():
        return _candidates(rows, True, percent)
    return _candidates(rows.join(_few(long), "key", "left_anti"), True, percent).union(_led(lists.join(_few(long), "key", "left_semi"), percent))


def _dealt(lists: DataFrame) -> DataFrame:
    """lists with part and side: each two rows of a list that differ in label meet in one part, and a part holds about two blocks at most.

    A label of more than BLOCK rows of a list has blocks of its own, and blocks of one label don't meet; the others share blocks by label.
    """
    whole = lists.withColumns({"part": F.lit(0).cast("long"), "side": F.lit(0)})
    labels = stored(lists.groupBy("key", "label").agg(F.count("*").alias("held")), "list-labels")
    small = F.when(F.col("held") <= BLOCK, F.col("held")).otherwise(0)
    sizes = labels.groupBy("key").agg(F.sum("held").alias("size"), F.greatest(F.lit(1), F.ceil(F.sum(small) / BLOCK)).alias("shared"))
    long = stored(sizes.filter(F.col("size") > BLOCK).select("key", "shared"), "long-lists")
    if not long.limit(1).count():
        return whole
    large = stored(labels.filter(F.col("held") > BLOCK).select("key", "label", F.ceil(F.col("held") / BLOCK).alias("own")), "long-labels")
    rows = lists.join(_few(long), "key").join(_few(large), ["key", "label"], "left")
    owner = F.when(F.col("own").isNotNull(), F.col("label"))
    number = F.when(F.col("own").isNotNull(), F.pmod(F.xxhash64("doc"), "own")).otherwise(F.pmod(F.xxhash64("label"), "shared"))
    rows = stored(rows.withColumns({"owner": owner, "block": F.struct(F.coalesce(owner, F.lit(-1)).alias("o"), owner.isNull().alias("s"), number.alias("b"))}), "blocks")
    blocks = stored(rows.select("key", "owner", "block").distinct(), "block-names")
    x, y = (blocks.select("key", F.col("owner").alias(f"owner_{c}"), F.col("block").alias(c)) for c in "xy")
    meet = x.join(y, "key").filter((F.col("x") <= F.col("y")) & ~F.coalesce(F.col("owner_x") == F.col("owner_y"), F.lit(False)))
    meet = meet.select("key", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    side = F.when(F.col("x") == F.col("y"), 0).when(F.col("block") == F.col("x"), 1).otherwise(2)
    parts = rows.join(meet, ["key", "block"]).withColumns({"part": F.xxhash64("x", "y"), "side": side}).select(whole.columns)
    return whole.join(_few(long.select("key")), "key", "left_anti").select(whole.columns).union(parts)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough: 100 * intersection >= percent * union."""
    left = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("sb"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return joined.filter(100 * F.col("common") >= percent * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b")


def _sets(documents: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """The full shingle sets of some documents, made from their whole texts."""
    ids = wanted.withColumnRenamed("doc", "_doc")
    texts = documents.join(_few(ids), F.col("doc_id") == F.col("_doc"), "left_semi")
    return texts.select(F.col("doc_id").alias("doc"), shingles(F.col("text"), k).alias("shingles")).dropDuplicates(["doc"])


def _rare(sets: DataFrame, wanted: DataFrame, percent: int) -> DataFrame:
    """doc, rare: the rarest shingles of a document among the wanted ones, as many as a link's prefix can have, rarest first."""
    single = sets.join(wanted, "doc", "left_semi").select("doc", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    times = single.groupBy("shingle").agg(F.count("*").alias("times"))
    ordered = F.array_sort(F.collect_list(F.struct("times", "shingle")))  # a document's own set
    rows = single.join(times, "shingle").groupBy("doc", "n").agg(F.transform(ordered, lambda s: s["shingle"]).alias("all"))
    return rows.select("doc", F.slice("all", F.lit(1), F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1).alias("rare"))


def _grouped(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """set_key, part, component of each class of several rows or with links, for every part, so that a class of many copies is spread over PARTS tasks."""
    known = classes.join(labels, F.col("doc") == F.col("node"), "left").withColumn("component", F.coalesce("component", "doc"))
    several = known.filter((F.col("times") > 1) | (F.col("component") != F.col("doc")))
    return several.select("set_key", "component", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))


def _by_rows(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """near_duplicates of texts some of whose ids stand for several: rows are linked by numbers of their own, and components get their smallest doc_id."""
    rows = stored(texts.withColumn("row", F.monotonically_increasing_id()), "rows")  # numbers hold once they are written
    known = rows.filter(F.col("doc_id").isNotNull())
    found = stored(near_duplicates(known.select(F.col("row").alias("doc_id"), "text"), k, percent), "row-components")
    named = found.join(known.select("row", F.col("doc_id").alias("id")), F.col("doc_id") == F.col("row"))
    smallest = named.groupBy("component_id").agg(F.min("id").alias("least"))
    out = named.join(smallest, "component_id").select(F.col("id").alias("doc_id"), "n_shingles", F.col("least").alias("component_id"))
    others = rows.filter(F.col("doc_id").isNull()).select("doc_id", F.size(shingles(F.col("text"), k)).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(others).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links), kept (doc_id = component_id), a row per row.

    Documents are linked whose sets of k-word shingles have a similarity of percent or more. A text that is null or has no words has an empty set, is linked
    with nothing, and stands for itself. Rows that repeat a doc_id get a row each; where their texts differ each is linked for itself (every row then has a number of its
    own, and a component is named after its smallest doc_id). A null doc_id is linked with nothing, has a null component and is kept. Other columns are ignored.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = texts.select(F.col("doc_id").cast("string"), shingles(F.col("text"), k).alias("shingles"))
    signed = sets.mapInPandas(_signed, "doc_id string, n int, set_key binary, signature array<long>").withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = stored(signed, "signatures")
    full = signed.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    if full.groupBy("doc_id").agg((F.min("set_key") != F.max("set_key")).alias("differ")).filter("differ").limit(1).count():
        return _by_rows(texts, k, percent)
    classes = full.groupBy("set_key").agg(F.min("doc_id").alias("doc"), F.count("*").alias("times"))
    first = full.join(classes, (full["set_key"] == classes["set_key"]) & (full["doc_id"] == classes["doc"]), "left_semi")
    lists = stored(_postings(first.withColumnRenamed("doc_id", "doc").dropDuplicates(["doc"])), "postings")
    star = stored(_star(lists, percent).distinct(), "star")
    hubs = star.groupBy("a").agg(F.count("*").alias("degree"))
    nearest, busiest = F.max_by("a", F.struct("collisions", -F.col("a"))), F.max_by("a", F.struct("degree", -F.col("a")))
    best = star.join(hubs, "a").groupBy("b").agg(nearest.alias("near"), busiest.alias("hub")).select("b", F.explode(F.array_distinct(F.array("near", "hub"))).alias("a"))
    sets = stored(_sets(texts, stored(lists.select("doc").distinct(), "posted"), k), "shingle-sets")
    links = stored(_confirmed(best, sets, percent), "links")
    labels = components(links)
    labelled = lists.join(labels, lists["doc"] == labels["node"], "left").withColumn("label", F.coalesce("component", "doc")).drop("node", "component")
    mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter(F.col("low") != F.col("high"))
    open_lists = stored(labelled.join(mixed, "key", "left_semi"), "open-lists")
    open_lists = _dealt(open_lists).join(_rare(sets, open_lists.select("doc").distinct(), percent), "doc")
    posted = lists.groupBy("doc").agg(F.array_sort(F.collect_list("key")).alias("posted"))  # at most a prefix for each
    open_lists = open_lists.join(posted, "doc")
    open_pairs = _candidates(open_lists, False, percent).select("a", "b").distinct()
    more = stored(_confirmed(open_pairs, sets, percent), "links")
    labels = components(links.union(more))
    members = signed.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")).join(_grouped(classes, labels), ["set_key", "part"], "left")
    out = members.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
