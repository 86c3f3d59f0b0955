"""Alignment of two tokenizers' tokens, in Arrow columns.

Both tokenizers cut the same bytes (a space and the text). In a block of documents the lists of ids are flattened with the index of
their parent, the tokens' lengths are summed cumulatively within each document, and the two sides meet in a hash join on (document, end).
Where tokens of both sides end together a group ends; each joined pair of tokens is a link. Pairs of ids are counted by
group_by within a block and a task, and Spark adds the tasks' counts up.

A byte-level vocabulary is merged by its file's ids as ranks, which gives the ids of the file's own merges as these stand in the order of
the ids (a file whose merges don't is refused).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored

BYTE_LEVEL, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: How byte-level vocabularies cut a text before they merge, a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of texts (of one text, if it is longer) that are aligned at once: a block's columns take some 200 bytes a character; and pairs of ids that a task counts before it hands them on.
BLOCK_CHARS, KEPT_PAIRS = 1_000_000, 1_000_000
#: Pairs of ids whose counts are broadcast; more are joined by a shuffle.
BROADCAST_PAIRS = 2_000_000
MARK = "▁"

DOCUMENT = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<struct<pair: long, times: long>>"
_LINKS = pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())]))


class Vocabulary:
    """The bytes of each id, as Arrow columns."""

    def __init__(self, spelled: list[bytes]):
        self.bytes = pa.array(spelled, pa.binary())
        self.lengths = pc.cast(pc.binary_length(self.bytes), pa.int64())

    def encode(self, texts: list[str]) -> pa.ListArray:
        """Ids of texts."""
        raise NotImplementedError


class ByteLevel(Vocabulary):
    """A byte-level vocabulary file; its special tokens are plain text within texts."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        known, merges = spec["model"]["vocab"], spec["model"]["merges"]
        order = [known["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in merges]
        if order != sorted(order):
            raise ValueError(f"{path}: the merges are not in the order of their ids")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        special = {t["content"] for t in spec["added_tokens"]}
        ids = {bytes(byte_of[c] for c in token): i for token, i in known.items() if token not in special}
        spelled = [b""] * (1 + max(known.values()))
        for token, i in ids.items():
            spelled[i] = token
        super().__init__(spelled)
        self.engine = tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks=ids, special_tokens={})

    def encode(self, texts: list[str]) -> pa.ListArray:
        return _lists([self.engine.encode_to_numpy(" " + t, disallowed_special=()) for t in texts])


class Pieces(Vocabulary):
    """A SentencePiece model file, which puts the space in front itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        super().__init__([bytes([int(s[3:5], 16)]) if self.model.is_byte(i) else s.replace(MARK, " ").encode() for i, s in zip(ids, map(self.model.id_to_piece, ids), strict=True)])

    def encode(self, texts: list[str]) -> pa.ListArray:
        return _lists([np.array(own, np.int32) for own in self.model.encode(texts, num_threads=1)])


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return ByteLevel(path) if path.endswith(".json") else Pieces(path)


def _lists(own: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, own)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(own) if own else np.zeros(0), pa.int32()))


def _joined(pieces: pa.Array, sizes: np.ndarray) -> pa.Array:
    """Runs of so many pieces, each joined to one."""
    ends = pa.array(np.cumsum(np.concatenate([[0], sizes])), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(ends, pieces), b"" if pa.types.is_binary(pieces.type) else "")


def _spelled(ids: pa.ListArray, vocab: Vocabulary) -> pa.Array:
    """The bytes that each list of ids stands for."""
    return _joined(vocab.bytes.take(pc.list_flatten(ids)), pc.list_value_length(ids).to_numpy(False))


class _Side:
    """One tokenizer's tokens of a block: ids, the document of each, and where each ends within its document."""

    def __init__(self, ids: pa.ListArray, vocab: Vocabulary):
        self.sizes = pc.list_value_length(ids).to_numpy(False).astype(np.int64)
        self.ids, self.doc = pc.list_flatten(ids), pc.list_parent_indices(ids)
        total = pc.cumulative_sum(vocab.lengths.take(self.ids))
        before = np.concatenate([[0], total.to_numpy(False)])[np.concatenate([[0], np.cumsum(self.sizes)[:-1]])] if len(self.sizes) else np.zeros(0, np.int64)
        self.end = pc.subtract(total, pa.array(before, pa.int64()).take(self.doc))

    def table(self, name: str) -> pa.Table:
        return pa.table({"doc": self.doc, "end": self.end, name: pa.array(np.arange(len(self.ids)), pa.int64())})

    def cuts(self, linked: np.ndarray) -> np.ndarray:
        """Tokens that are the last at an end where both sides end."""
        doc, end, cut = self.doc.to_numpy(False), self.end.to_numpy(False), np.zeros(len(self.ids), bool)
        cut[linked] = True
        cut[:-1] &= (end[1:] != end[:-1]) | (doc[1:] != doc[:-1])
        return cut


def _groups_text(a: _Side, b: _Side, cut_a: np.ndarray, cut_b: np.ndarray) -> pa.Array:
    """a1,a2|b1;a3|b2,b3 of each document: all tokens in the order of their groups, A's first, each written behind its separator."""
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b  # groups go on counting over documents, as each ends with a cut
    n = int(cut_a.sum())
    many_a, many_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    place_a = np.arange(len(group_a)) + (np.cumsum(many_b) - many_b)[group_a]
    place_b = np.arange(len(group_b)) + np.cumsum(many_a)[group_b]
    first_a, first_b, of_doc = np.ones(len(group_a), bool), np.ones(len(group_b), bool), np.zeros(len(group_a), bool)
    first_a[1:], first_b[1:] = group_a[1:] != group_a[:-1], group_b[1:] != group_b[:-1]
    of_doc[np.concatenate([[0], np.cumsum(a.sizes)[:-1]])] = True
    ids_a, ids_b = a.ids.to_numpy(False), b.ids.to_numpy(False)
    width = 1 + int(max(ids_a.max(), ids_b.max()))
    written = np.empty(len(ids_a) + len(ids_b), np.int64)
    written[place_a] = ids_a + width * np.where(of_doc, 0, np.where(first_a, 2, 1))
    written[place_b] = ids_b + width * np.where(first_b, 3, 1)
    numbers = pc.cast(pa.array(np.arange(width)), pa.string())
    spelled = pa.concat_arrays([pc.binary_join_element_wise(mark, numbers, "") for mark in ("", ",", ";", "|")])
    return _joined(spelled.take(pa.array(written)), a.sizes + b.sizes)


def align_texts(texts: list[str], vocab_a: Vocabulary, vocab_b: Vocabulary) -> dict[str, list | pa.Array]:
    """Columns of DOCUMENT for a block of texts; those that are empty, or that a side doesn't spell as they are, have no tokens."""
    taken = np.array([i for i, t in enumerate(texts) if t], np.int64)
    own = [texts[i] for i in taken]
    ids_a, ids_b = vocab_a.encode(own), vocab_b.encode(own)
    whole = pa.array([b" " + t.encode() for t in own], pa.binary())
    same = pc.and_(pc.equal(_spelled(ids_a, vocab_a), whole), pc.equal(_spelled(ids_b, vocab_b), whole))
    taken = taken[same.to_numpy(False)]
    n, counts = len(texts), {}
    digests = np.full(n, "", object)
    links = pa.array([[]] * n, _LINKS)
    if len(taken):
        a, b = _Side(ids_a.filter(same), vocab_a), _Side(ids_b.filter(same), vocab_b)
        met = a.table("at_a").join(b.table("at_b"), keys=["doc", "end"], join_type="inner", use_threads=False)
        at_a, at_b = met["at_a"].combine_chunks(), met["at_b"].combine_chunks()
        cut_a, cut_b = a.cuts(at_a.to_numpy(False)), b.cuts(at_b.to_numpy(False))
        digests[taken] = [hashlib.sha256(t.encode()).hexdigest() for t in _groups_text(a, b, cut_a, cut_b).to_pylist()]
        pair = pc.bit_wise_or(pc.shift_left(pc.cast(a.ids.take(at_a), pa.int64()), 32), pc.cast(b.ids.take(at_b), pa.int64()))
        found = pa.table({"doc": met["doc"], "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")]).sort_by("doc")
        docs = taken[found["doc"].to_numpy()]
        ends = np.concatenate([[0], np.cumsum(np.bincount(docs, minlength=n))])
        pairs = pa.StructArray.from_arrays([found["pair"].combine_chunks(), found["count_all"].combine_chunks()], ["pair", "times"])
        links = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs).cast(_LINKS)
        counts = {
            "n_a": (taken, a.sizes), "n_b": (taken, b.sizes), "n_groups": (taken, np.bincount(a.doc.to_numpy(False)[cut_a], minlength=len(taken))),
            "n_links": (taken, np.bincount(met["doc"].to_numpy(), minlength=len(taken))),
        }
    out = {}
    for name in ("n_a", "n_b", "n_groups", "n_links"):
        column = np.zeros(n, np.int64)
        if name in counts:
            column[counts[name][0]] = counts[name][1]
        out[name] = pa.array(column)
    return out | {"groups_sha256": pa.array(digests, pa.string()), "links": links}


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of texts of BLOCK_CHARS together, one text at least."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > BLOCK_CHARS:
            yield start, i
            start, held = i, 0
        held += len(t)
    if texts:
        yield start, len(texts)


def _align(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_cpu_count(1)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for start, stop in _blocks(texts):
                own = batch.slice(start, stop - start)
                found = align_texts(texts[start:stop], vocabulary(path_a), vocabulary(path_b))
                yield pa.RecordBatch.from_pydict({"row": own.column("row"), "doc_id": own.column("doc_id")} | found)

    return run


def _added(held: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(held).group_by("pair", use_threads=False).aggregate([("times", "sum")]).rename_columns(["pair", "times"])


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, times) of a task's documents, handed on when KEPT_PAIRS different ones are held."""
    pa.set_cpu_count(1)
    held, rows = [], 0
    for batch in batches:
        own = pc.list_flatten(batch.column("links"))
        if len(own):
            held.append(_added([pa.table({"pair": own.field("pair"), "times": own.field("times")})]))
            rows += held[-1].num_rows
        if rows > KEPT_PAIRS:
            held = [_added(held)]
            rows = held[0].num_rows
            if rows > KEPT_PAIRS // 2:
                yield from held[0].to_batches()
                held, rows = [], 0
    if held:
        yield from _added(held).to_batches()


def align(documents: DataFrame, vocab_a: str = BYTE_LEVEL, vocab_b: str = PIECES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (a number of each row), doc_id and the columns of DOCUMENT: sizes, groups' digest, and links as pairs of ids (A's above 32 bits).

    Null and empty texts, and texts that a vocabulary doesn't spell byte for byte (as it changes characters), have no tokens. Repeated rows
    and null ids are aligned each; other columns are ignored; an empty table gives one. Nothing is shuffled; a task holds BLOCK_CHARS
    characters, or one text. The result is stored, as it is read twice. The files must be readable on every executor.
    """
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = documents.schema[id_col].dataType.simpleString()
    return stored(rows.mapInArrow(_align(vocab_a, vocab_b), f"row long, doc_id {kind}, {DOCUMENT}"), "alignment")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n (links of the corpus that hold it) and best (whether no pair of its B id has more), stored."""
    counts = aligned.select("links").mapInArrow(_partial_counts, "pair long, times long").groupBy("pair").agg(F.sum("times").alias("n"))
    counts = stored(counts.withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))), "pairs")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))  # a row for each id of B's vocabulary at most
    return counts.join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment_report(documents: DataFrame, vocab_a: str = BYTE_LEVEL, vocab_b: str = PIECES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row, as align says of odd rows.

    A document's different pairs meet the corpus counts, which are broadcast up to BROADCAST_PAIRS pairs and else joined by a shuffle, in
    which a frequent pair has a row a document at most and is left to the skew join.
    """
    aligned = align(documents, vocab_a, vocab_b)
    counts = pair_counts(aligned)
    few = counts.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS
    linked = aligned.select("row", F.inline("links")).join(F.broadcast(counts) if few else counts, "pair")
    sums = linked.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return aligned.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
