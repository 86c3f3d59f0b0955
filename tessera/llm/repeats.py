"""Exact removal of repeated byte strings by a logarithmic family of suffix arrays.

A byte string of LENGTH bytes is a suffix cut at LENGTH. Suffixes are dealt by their anchor, the smallest hash among the
K-byte strings inside: equal suffixes have equal anchors, and neighbouring suffixes share one, so that they travel together as a
run of bytes. Anchors that only one document holds cannot match and are dropped before any bytes move.

A shard of the index is a family of levels, each a suffix array: distinct suffixes, sorted, each with the smallest document that
holds it. The contents of a shard's runs come in the order of their smallest documents and are cut into batches. A new batch gets its suffix array and
is merge-scanned against every level, smallest documents first found: a suffix that a level holds has its match there, the others are
new and become a level of their own; a level that has not twice the next one's suffixes is merged with it, so there are never more than a logarithm of them. As batches
come in order, no later batch changes what an earlier one found. Runs whose anchor has one content in the whole corpus
need no suffixes: the content is their match.

An anchor that many groups hold could bring any number of contents to one shard. Its runs are cut into single suffixes, which
are dealt by a hash of their own, so that equal suffixes still meet and different ones are spread.

Documents are dealt into groups once; three passes over the groups (anchors, runs, removal) share that exchange. What
travels between groups and shards are packed blocks of one group and one shard.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import blocks_for

LENGTH = 50
#: Bytes of an anchor: long enough that chance repeats are few, short enough that there are few anchors.
K = 16
#: Suffixes of a run at most.
RUN = 64
#: Bytes of text in a group, about, and in one step of the scan for anchors.
GROUP_BYTES, MOST_GROUP_BYTES, STEP_BYTES = 4 << 20, 16 << 20, 1 << 17
#: Groups from which on an anchor is hot, and contents of a batch.
HOT_GROUPS, BATCH = 256, 8192
#: A level this many times as long as a batch is searched, not merged with it.
MERGE_RATIO = 8
NO_DOC = np.iinfo(np.int64).max

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def gram_hashes(data: np.ndarray, k: int = K) -> np.ndarray:
    """A hash of the k bytes from each position on (k a power of two), by joining hashes of halves."""
    x, size = data.astype(np.uint64) + np.uint64(1), 1
    while size < k:
        x = x[:-size] * _A + x[size:]
        x ^= x >> np.uint64(32)
        x *= _C
        size *= 2
    return x ^ (x >> np.uint64(29))


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    rest = w - size
    return np.minimum(h[:-rest], h[rest:]) if rest else h


def runs_of(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, suffixes, anchor) of each run of data, documents laid end to end; ends: where each ends. Suffixes never cross an end."""
    starts_out, counts_out, keys_out = [], [], []
    w = length - K + 1
    for at in range(0, max(0, len(data) - length + 1), STEP_BYTES):
        part = data[at : at + STEP_BYTES + length - 1]
        if len(part) < length:
            break
        least = window_minima(gram_hashes(part), w)
        where = np.arange(at, at + len(least))
        own = slice(np.searchsorted(ends, at, side="right"), np.searchsorted(ends, at + len(least) - 1, side="right") + 1)
        end = np.repeat(ends[own], np.diff(np.minimum(ends[own], at + len(least)), prepend=at))
        inside = where + length <= end
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])
        new[1:] |= end[1:] != end[:-1]
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(least)))
        kept = inside[first]
        first, count = first[kept], count[kept]
        pieces = -(-count // RUN)
        step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(first, pieces) + step * RUN
        starts_out.append(begin + at)
        counts_out.append(np.minimum(RUN, np.repeat(first + count, pieces) - begin))
        keys_out.append(least[begin] >> np.uint64(16))
    if not starts_out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts_out), np.concatenate(counts_out), np.concatenate(keys_out)


def _six(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


class Group:
    """The documents of one group, in the order of their ids, and their runs."""

    def __init__(self, pdf: pd.DataFrame):
        ids = np.array([NO_DOC if v is None else int(v) for v in pdf["doc_id"]], np.int64)
        order = np.argsort(ids, kind="stable")
        self.ids, self.null = ids[order], np.array([v is None for v in pdf["doc_id"]], bool)[order]
        texts = [bytes(pdf["data"].iloc[i]) for i in order]
        self.bytes = b"".join(texts)
        self.data = np.frombuffer(self.bytes, np.uint8)
        self.ends = np.cumsum([len(t) for t in texts]) if texts else np.zeros(0, np.int64)
        self.starts = self.ends - np.array([len(t) for t in texts], np.int64)
        filled = self.ends > self.starts
        self.start, self.count, self.key = runs_of(self.data, self.ends[filled])
        self.doc = np.searchsorted(self.ends, self.start, side="right")

    def keys(self, n_shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchors by shard, whether two documents of the group hold each, and each run's place among them."""
        distinct, place = np.unique(self.key, return_inverse=True)
        low, high = np.full(len(distinct), len(self.ids)), np.full(len(distinct), -1)
        np.minimum.at(low, place, self.doc)
        np.maximum.at(high, place, self.doc)
        shard = (distinct % np.uint64(n_shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return distinct[order], (low != high)[order], back[place]

    def singled(self, runs: np.ndarray, hot: np.ndarray) -> "Runs":
        """Some runs; the hot ones cut into single suffixes, whose keys are hashes of themselves."""
        whole, parts = runs[~hot], runs[hot]
        n = self.count[parts]
        start = np.repeat(self.start[parts], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        key = np.zeros(len(start), np.uint64)
        for at in range(0, len(start), STEP_BYTES >> 3):
            window = self.data[start[at : at + (STEP_BYTES >> 3), None] + np.arange(LENGTH)]
            mixed = np.zeros(len(window), np.uint64)
            for column in window.T:
                mixed = (mixed + column + np.uint64(1)) * _A
                mixed ^= mixed >> np.uint64(29)
            key[at : at + (STEP_BYTES >> 3)] = (mixed * _C) >> np.uint64(16)
        return Runs(*(np.concatenate(x) for x in ((self.start[whole], start), (self.count[whole], np.ones_like(start)), (self.key[whole], key), (self.doc[whole], np.repeat(self.doc[parts], n)))))


@dataclass
class Runs:
    """Where runs start, how many suffixes they have, their keys, and the places of their documents."""

    start: np.ndarray
    count: np.ndarray
    key: np.ndarray
    doc: np.ndarray


def _cuts(shards: np.ndarray, n_shards: int) -> np.ndarray:
    return np.searchsorted(shards, np.arange(n_shards + 1))


def _anchors(n_shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        group = Group(pdf)
        distinct, several, _ = group.keys(n_shards)
        cut = _cuts((distinct % np.uint64(n_shards)).astype(np.int64), n_shards)
        rows = [(s, int(pdf["g"].iloc[0]), _six(distinct[a:b]), np.packbits(several[a:b]).tobytes()) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
        return pd.DataFrame(rows, columns=["shard", "g", "keys", "several"])

    return run


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each block of anchors, which of them two documents hold, and which are hot."""
    blocks = [_from_six(k) for k in pdf["keys"]]
    several = [np.unpackbits(np.frombuffer(s, np.uint8), count=len(b)).astype(bool) for s, b in zip(pdf["several"], blocks, strict=True)]
    every = np.sort(np.concatenate(blocks))
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(every)))  # groups: a group names an anchor once
    twice = np.unique(np.concatenate([every[first[times > 1]], *[b[s] for b, s in zip(blocks, several, strict=True)]]))
    hot = every[first[times >= HOT_GROUPS]]

    def among(b: np.ndarray, known: np.ndarray) -> bytes:
        if not len(known):
            return np.packbits(np.zeros(len(b), bool)).tobytes()
        at = np.searchsorted(known, b)
        at[at == len(known)] = 0
        return np.packbits(known[at] == b).tobytes()

    return pd.DataFrame({"g": pdf["g"], "shard": pdf["shard"], "held": [among(b, twice) for b in blocks], "hot": [among(b, hot) for b in blocks]})


def _contents(group: Group, held: pd.DataFrame, n_shards: int) -> tuple[Runs, np.ndarray, np.ndarray, list[dict[bytes, int]]]:
    """The runs whose anchors are shared, by shard; each one's shard and number among its shard's contents; and by shard the contents with their numbers."""
    distinct, _, place = group.keys(n_shards)
    cut = _cuts((distinct % np.uint64(n_shards)).astype(np.int64), n_shards)
    flags, hot = np.zeros(len(distinct), bool), np.zeros(len(distinct), bool)
    for shard, bits, more in zip(held["shard"], held["held"], held["hot"], strict=True):
        if bits is not None:
            a, b = cut[shard], cut[shard + 1]
            flags[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
            hot[a:b] = np.unpackbits(np.frombuffer(more, np.uint8), count=b - a).astype(bool)
    chosen = np.flatnonzero(flags[place])
    runs = group.singled(chosen, hot[place[chosen]])
    shards = (runs.key % np.uint64(n_shards)).astype(np.int64)
    order = np.argsort(shards, kind="stable")
    runs, shards = Runs(runs.start[order], runs.count[order], runs.key[order], runs.doc[order]), shards[order]
    contents: list[dict[bytes, int]] = []
    numbers, data, tail = [], group.bytes, LENGTH - 1
    begin, stop, cut = runs.start.tolist(), (runs.start + runs.count + tail).tolist(), _cuts(shards, n_shards).tolist()
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        own: dict[bytes, int] = {}
        numbers += [own.setdefault(data[x:y], len(own)) for x, y in zip(begin[a:b], stop[a:b], strict=True)]
        contents.append(own)
    return runs, shards, np.array(numbers, np.int64), contents


def _runs(n_shards: int):
    def run(pdf: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        if len(pdf) and len(held):
            group = Group(pdf)
            runs, shards, numbers, contents = _contents(group, held, n_shards)
            sizes = [len(own) for own in contents]
            offset = np.cumsum([0, *sizes])
            flat, keys = np.full(offset[-1], NO_DOC, np.int64), np.zeros(offset[-1], np.uint64)
            np.minimum.at(flat, offset[shards] + numbers, group.ids[runs.doc])
            keys[offset[shards] + numbers] = runs.key
            packer = zstandard.ZstdCompressor(level=3)
            for shard, own in enumerate(contents):
                if own:
                    mine = slice(offset[shard], offset[shard + 1])
                    rows.append((shard, int(pdf["g"].iloc[0]), _six(keys[mine]), np.fromiter(map(len, own), np.uint8, len(own)).tobytes(), flat[mine].tobytes(), packer.compress(b"".join(own))))
        return pd.DataFrame(rows, columns=["shard", "g", "keys", "lengths", "docs", "contents"])

    return run


def suffixes(contents: list[bytes], length: int = LENGTH) -> np.ndarray:
    """All suffixes of some contents, cut at length, in order."""
    data = np.frombuffer(b"".join(contents), np.uint8)
    sizes = np.array([len(c) for c in contents], np.int64)
    count = sizes - length + 1
    begin = np.cumsum(sizes) - sizes
    where = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, length)[where]).view(f"S{length}").ravel() if len(where) else np.zeros(0, f"S{length}")


Level = tuple[np.ndarray, np.ndarray]


def merge_scan(known: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place in known, whether it holds the suffix) of each suffix of own; both are in order and without repeats.

    The two are merged as two runs of one sequence; where known is many times as long, each suffix is looked up by bisection instead, which reads less.
    """
    if len(known) > MERGE_RATIO * len(own):
        at = np.searchsorted(known, own)
        at[at == len(known)] = 0
        return at, known[at] == own
    order = np.argsort(np.concatenate([known, own]), kind="stable")  # of equal ones, known's comes first
    mine = order >= len(known)
    at = np.maximum(np.cumsum(~mine)[mine] - 1, 0)
    return at, known[at] == own if len(known) else np.zeros(len(own), bool)


class SuffixFamily:
    """Levels of sorted distinct suffixes with the smallest document of each; batches come in the order of their documents.

    A level has at least twice as many suffixes as the next: a smaller one is merged with it, so there are never more than the logarithm of their number.
    """

    def __init__(self) -> None:
        self.levels: list[Level] = []

    def add(self, suffix: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Takes a batch in, and gives the smallest document of each of its suffixes in what the family holds by now."""
        own, first, place = np.unique(suffix, return_index=True, return_inverse=True)
        smallest = np.full(len(own), NO_DOC, np.int64)
        np.minimum.at(smallest, place, docs)
        new = np.ones(len(own), bool)
        for known, its_docs in self.levels:
            at, hit = merge_scan(known, own)
            smallest[hit] = np.minimum(smallest[hit], its_docs[at[hit]])
            new &= ~hit
        if new.any():
            self.levels.append((own[new], smallest[new]))
            while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
                self.levels.append(self.merged(self.levels.pop(), self.levels.pop()))
        return smallest[place]

    @staticmethod
    def merged(a: Level, b: Level) -> Level:
        """Two levels without a common suffix as one."""
        (large, large_docs), (small, small_docs) = (a, b) if len(a[0]) >= len(b[0]) else (b, a)
        at = np.searchsorted(large, small)
        return np.insert(large, at, small), np.insert(large_docs, at, small_docs)


def _match(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each block of runs: the smallest document of each content, or of each of its suffixes where contents of the anchor differ."""
    unpacker = zstandard.ZstdDecompressor()
    index: dict[bytes, int] = {}
    blocks = []
    for row in pdf.itertuples():
        sizes = np.frombuffer(row.lengths, np.uint8).astype(np.int64)
        data, ends = unpacker.decompress(row.contents), np.cumsum(sizes)
        numbers = np.array([index.setdefault(data[a:b], len(index)) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)], np.int64)
        blocks.append((row.g, row.shard, _from_six(row.keys), np.frombuffer(row.docs, np.int64), numbers))
    contents = list(index)
    numbers = np.concatenate([b[4] for b in blocks])
    smallest, keys = np.full(len(contents), NO_DOC, np.int64), np.zeros(len(contents), np.uint64)
    np.minimum.at(smallest, numbers, np.concatenate([b[3] for b in blocks]))
    keys[numbers] = np.concatenate([b[2] for b in blocks])
    _, place, times = np.unique(keys, return_inverse=True, return_counts=True)
    mixed = times[place] > 1
    counts = np.where(mixed, np.fromiter(map(len, contents), np.int64, len(contents)) - LENGTH + 1, 0)
    offset = np.cumsum(counts) - counts
    every = np.zeros(counts.sum(), np.int64)

    def steps(own: np.ndarray) -> np.ndarray:
        """Where the suffixes of some contents stand in every."""
        n = counts[own]
        return np.repeat(offset[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())

    family, order = SuffixFamily(), np.flatnonzero(mixed)
    order = order[np.argsort(smallest[order], kind="stable")]
    for at in range(0, len(order), BATCH):
        own = order[at : at + BATCH]
        every[steps(own)] = family.add(suffixes([contents[i] for i in own.tolist()]), np.repeat(smallest[own], counts[own]))
    rows, packer = [], zstandard.ZstdCompressor(level=1)
    for g, shard, _, _, own in blocks:
        some = own[mixed[own]]
        rows.append((g, shard, np.packbits(mixed[own]).tobytes(), packer.compress(smallest[own].tobytes()), packer.compress(every[steps(some)].tobytes())))
    return pd.DataFrame(rows, columns=["g", "shard", "mixed", "one", "each"])


def _remove(n_shards: int, keep_text: bool):
    def run(pdf: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=OUT)
        group = Group(pdf)
        size = len(group.data)
        cover = np.zeros(size + 1, np.int32)
        if len(found):
            runs, shards, numbers, contents = _contents(group, found[["shard", "held", "hot"]], n_shards)
            docs, cut = group.ids[runs.doc], _cuts(shards, n_shards)
            unpacker = zstandard.ZstdDecompressor()
            for row in found.itertuples():
                if row.one is None:
                    continue
                one = np.frombuffer(unpacker.decompress(row.one), np.int64)
                each = np.frombuffer(unpacker.decompress(row.each), np.int64)
                mixed = np.unpackbits(np.frombuffer(row.mixed, np.uint8), count=len(one)).astype(bool)
                mine = slice(cut[row.shard], cut[row.shard + 1])
                begin, count, doc, number = runs.start[mine], runs.count[mine], docs[mine], numbers[mine]
                whole = ~mixed[number] & (one[number] < doc)
                np.add.at(cover, begin[whole], 1)
                np.add.at(cover, begin[whole] + count[whole] + LENGTH - 1, -1)
                parts = mixed[number]
                if parts.any():
                    begin, count, doc, number = begin[parts], count[parts], doc[parts], number[parts]
                    counts = np.zeros(len(one), np.int64)
                    counts[number] = count
                    offset = np.cumsum(counts) - counts  # mixed contents stand in order
                    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    hit = each[np.repeat(offset[number], count) + step] < np.repeat(doc, count)
                    where = (np.repeat(begin, count) + step)[hit]
                    np.add.at(cover, where, 1)
                    np.add.at(cover, where + LENGTH, -1)
        gone = np.cumsum(cover[:-1]) > 0
        rows = []
        for i, (a, b) in enumerate(zip(group.starts.tolist(), group.ends.tolist(), strict=True)):
            own = gone[a:b]
            left = group.data[a:b][~own].tobytes()
            spans = int(own[:1].sum() + np.count_nonzero(own[1:] & ~own[:-1]))
            rows.append((None if group.null[i] else str(group.ids[i]), b - a, int(own.sum()), spans, hashlib.sha256(left).hexdigest(), left if keep_text else None))
        return pd.DataFrame(rows, columns=OUT)

    return run


OUT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]


def remove_repeats(documents: DataFrame, keep_text: bool = True, group_bytes: int | None = None, shard_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes, if keep_text) of each row of documents.

    Every byte is removed that a string of LENGTH bytes covers which also starts in a document of a smaller doc_id. Texts are taken whole, as UTF-8
    bytes; a null text is empty; rows of one doc_id never match each other; a null doc_id counts as the largest; an empty table gives one; other columns
    are ignored, whatever their names. A run that many documents hold travels once for each group, not once for each document.

    Groups and shards exchange a block for each two that have an anchor in common: never more blocks than anchors, and the fewer the larger the groups, which
    grow with the input (group_bytes, by default a 2000th of it between GROUP_BYTES and MOST_GROUP_BYTES).
    """
    rows = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    total = documents.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_groups = blocks_for(total, group_bytes or min(MOST_GROUP_BYTES, max(GROUP_BYTES, total // 2000)))
    n = blocks_for(total, shard_bytes)
    rows = rows.withColumn("g", F.pmod(F.xxhash64("doc_id", F.octet_length("data")), F.lit(n_groups)).cast("int"))
    groups = rows.groupBy("g")
    anchors = groups.applyInPandas(_anchors(n), "shard int, g int, keys binary, several binary")
    held = anchors.groupBy("shard").applyInPandas(_shared, "g int, shard int, held binary, hot binary")
    runs = groups.cogroup(held.groupBy("g")).applyInPandas(_runs(n), "shard int, g int, keys binary, lengths binary, docs binary, contents binary")
    matched = runs.groupBy("shard").applyInPandas(_match, "g int, shard int, mixed binary, one binary, each binary")
    found = held.join(matched, ["g", "shard"], "full")  # hot suffixes go to shards that the group may have no anchor in
    out = groups.cogroup(found.groupBy("g")).applyInPandas(_remove(n, keep_text), "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
